"""Every registered plan against the oracle, on the same Parquet files."""

import datetime
import decimal
import os

import duckdb
import pytest

from tessera.plans import catalogue

PLANS = {p.name: p for p in catalogue._plans()}


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan(spark, sf_dir, oracle, name):
    df = PLANS[name].run(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if not PLANS[name].oracle:
        return
    found = oracle.execute(PLANS[name].oracle)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
