"""The registered queries, each with the SQL that has to give the same rows."""

from queries import detect, documents, files, mapping, masking, ner, overlaps, reports, tables

MODULES = (detect, overlaps, masking, documents, reports, tables, files, mapping, ner)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
