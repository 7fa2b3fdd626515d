"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from tessera.llm import queries as q


def queries():
    return dict(q.QUERIES)


def oracle_sql():
    return dict(q.ORACLE)
