"""Registered queries and the SQL they are checked against."""

from assetloom.plans import catalog, flows, questions, records

QUERIES: dict = catalog.QUERIES | questions.QUERIES | records.QUERIES | flows.QUERIES
SQL: dict[str, str] = catalog.SQL | questions.SQL | records.SQL | flows.SQL
