"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from tideglass.plans import contract_queries, dataset_queries, hand_queries, relation_queries, resampling_queries, stream_queries, table_queries, temporal_queries  # noqa: F401
from tideglass.plans.registry import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return None if math.isnan(v) else round(float(v), 9) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=str)
    assert rows(got) == rows(want)


def test_every_query_runs_over_whole_tables():
    assert all("sample" not in s.lower() for s in SQL.values())
