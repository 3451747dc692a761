"""Queries by name, each with the SQL that gives the same rows, if SQL can."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return put
