"""All registered queries of the library and their SQL."""

from . import conversations, duplicates, scoring, tables

QUERIES = {**conversations.QUERIES, **duplicates.QUERIES, **tables.QUERIES, **scoring.QUERIES}
SQL = {**conversations.SQL, **duplicates.SQL, **tables.SQL, **scoring.SQL}
