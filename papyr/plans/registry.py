"""The registered queries of the engine and the SQL they are checked against."""

from papyr.plans import catalog, delivery, documents, files, flows, structure, text

QUERIES: dict = {**text.QUERIES, **structure.QUERIES, **catalog.QUERIES, **files.QUERIES, **delivery.QUERIES, **documents.QUERIES, **flows.QUERIES}
SQL: dict = {**text.SQL, **structure.SQL, **catalog.SQL, **files.SQL, **delivery.SQL, **documents.SQL, **flows.SQL}
