"""Queries of the executable-metadata operators and the SQL that checks them."""

from golode.plans import queries

QUERIES: dict = dict(queries.QUERIES)
ORACLES: dict = dict(queries.ORACLES)
