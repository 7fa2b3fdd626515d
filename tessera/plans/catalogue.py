"""All registered relational queries with the SQL that checks them.

A plan is a name, a function of (spark, sf_dir) and, where SQL can express it,
the equivalent statement for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Plan:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def dialect_plan(name: str, sql: str, oracle: str, tables: str) -> Plan:
    """A query in the engine's own dialect over the named tables."""

    def run(spark, sf_dir):
        from tessera.engine import Engine

        return Engine(spark).register_dir(sf_dir, tables.split()).query(sql)

    return Plan(name, run, oracle)


def _plans() -> list[Plan]:
    from tessera.plans import relational, scalars, statements, vectors

    return [*relational.PLANS, *scalars.PLANS, *vectors.PLANS, *statements.PLANS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {p.name: p.run for p in _plans()}


def oracle_sql() -> dict[str, str]:
    return {p.name: p.oracle for p in _plans() if p.oracle}
