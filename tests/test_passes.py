"""Hands and pairs by passes: the rows of one pass, and no shuffle files of the passes before."""

import time

import pytest
from pyspark.sql import functions as F
from test_queries import SF, duck, plain  # noqa: F401

from tideglass.operators import slices
from tideglass.plans import hand_queries
from tideglass.plans.registry import QUERIES, SQL
from tideglass.sources import scratch, testbed


def shuffled(spark) -> int:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).name().startswith("shuffle_") for i in range(blocks.size()))


@pytest.fixture
def passes(monkeypatch):
    """Small passes; the numbers of them that were run."""
    run = []
    for module in (testbed, hand_queries):
        monkeypatch.setattr(module, "by_passes", lambda spark, n, make, what: run.append((what, n)) or scratch.by_passes(spark, n, make, what))
    monkeypatch.setattr(testbed, "PASS_LINES", 2500)
    monkeypatch.setattr(hand_queries, "PASS_PAIRS", 5000)
    return run


def same(spark, duck, name) -> None:  # noqa: F811
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=str)
    assert sorted(got.columns) == columns and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["hand_score_rollup", "player_max_score", "highest_risk_pair", "review_policy"])
def test_pairs_by_passes(spark, duck, passes, name):  # noqa: F811
    same(spark, duck, name)
    assert {what for what, n in passes if n > 1} == {"seated", "histories"}


def test_hot_pairs_by_passes(spark, duck, passes, monkeypatch):  # noqa: F811
    monkeypatch.setattr(slices, "HOT", 200)
    same(spark, duck, "hand_score_rollup")


def test_hot_pairs_are_those_of_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(slices, "HOT", 3)
    hands = spark.createDataFrame([(i, [(1,), (2,)] if i < 5 else [(i,), (i + 1,), (1,)]) for i in range(10)], "hand_id long, seats array<struct<player_id: long>>")
    pair = spark.createDataFrame([(1, 2)], "player_a long, player_b long").select(slices._bucket(["player_a", "player_b"])).first()[0]
    assert slices.hot_pairs(hands, ("player_a", "player_b")) == [pair]
    assert slices.hot_pairs(hands.where("hand_id > 6"), ("player_a", "player_b")) == []


def test_passes_free_what_they_shuffled(spark):
    before = shuffled(spark)
    out = scratch.by_passes(spark, 3, lambda i: spark.range(1000).where(F.col("id") % 3 == i).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    for _ in range(50):  # Spark deletes them in the background
        if (left := shuffled(spark) - before) <= 0:
            break
        time.sleep(0.1)
    assert left <= 0
    assert out.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get(scratch.FREED, None) is None
    scratch.discard(out)
