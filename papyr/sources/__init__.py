"""Readers of office containers."""
