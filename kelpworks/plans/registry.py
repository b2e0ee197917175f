"""Queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from kelpworks.plans import evaluation, lexical, relational, retrieval, service, structure, texts

MODULES = (retrieval, relational, texts, evaluation, structure, lexical, service)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
