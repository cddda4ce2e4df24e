"""Every registered query against its SQL on DuckDB, on the same tables: same columns, same rows."""

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from parcelflow.plans import registry


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v if isinstance(v, int) else str(v)


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def kinds(names, rows):
    return {(n, type(r[i]).__name__) for r in rows for i, n in enumerate(names) if r[i] is not None}


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    got = df.collect()
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = want.fetchall()
    assert kinds(df.columns, got) == kinds(want.columns, rows)
    a, b = bag(df.columns, got), bag(want.columns, rows)
    assert a == b, f"only Spark: {list((a - b).items())[:3]}; only SQL: {list((b - a).items())[:3]}"


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
