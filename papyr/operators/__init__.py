"""Operators on DataFrames: paragraphs in order, request and metric logs."""
