"""Every query of the library proper against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = entry.SMALL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {k: f for area in entry.AREAS for k, f in area.QUERIES.items()}
ORACLES = {k: q for area in entry.AREAS for k, q in area.ORACLES.items()}


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    return float(v) if isinstance(v, float | int) and not isinstance(v, bool) else str(v).replace(" 00:00:00", "")


def rows(df: pd.DataFrame) -> list[tuple]:
    """Rows in an order that does not hang on the last digits of a number."""
    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=lambda r: ([str(x) for x in r if not isinstance(x, float)], [f"{x:.5g}" for x in r if isinstance(x, float)]))


def same(a: list[tuple], b: list[tuple]) -> bool:
    close = lambda x, y: math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y
    return len(a) == len(b) and all(close(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = sql.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and same(rows(got), rows(want))
    else:
        assert len(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
