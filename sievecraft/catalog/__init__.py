"""Registered queries over the reference operators and the SQL that checks them."""

from sievecraft.catalog import coverage, curation, nested, relations, reports, rewriting, samples, scalars, training, vectors

MODULES = (scalars, coverage, curation, relations, samples, vectors, training, reports, rewriting, nested)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
