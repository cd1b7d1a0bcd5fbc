"""Every registered query against its SQL, at a small scale."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from sessionloom.plans import catalog


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted([tuple(plain(r[k]) for k in order) for r in found])


def answers(sql: str, sf_dir: str):
    with duckdb.connect() as con:
        con.execute("set TimeZone = 'UTC'")
        for file in Path(sf_dir).glob("*.parquet"):
            con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
        got = con.execute(sql)
        return rows([d[0] for d in got.description], got.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.SQL:
        assert got == answers(catalog.SQL[name], sf_dir)


def test_entry_and_registry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns
