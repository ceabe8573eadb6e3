"""Every engine query that has SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from folio.queries import answers, corpus, fixture_queries, job_queries, statements

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = (answers, corpus, fixture_queries, job_queries, statements)
SQL = corpus.ORACLES | {name: sql for m in MODULES if m is not corpus for name, sql in m.oracles().items()}


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 9) if hasattr(v, "dtype") and v.shape == () or isinstance(v, (int, float)) else str(v)


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    got = __spark_entry__.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_is_registered():
    names = {name for m in MODULES for name in m.queries()}
    assert names <= {*__spark_entry__.queries()} and {*SQL} <= names
