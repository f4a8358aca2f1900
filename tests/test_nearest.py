"""All pairs of vectors: the best cosine of each with each group."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import SF

from tideglass.functions import scalars
from tideglass.operators import nearest
from tideglass.plans.registry import QUERIES, SQL


def brute(table, groups=2):
    """id: the best of each group, of (id, vector, group)."""
    fit = lambda v: v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
    unit = lambda v: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
    known = [(i, unit(v) if fit(v) else None, g) for i, v, g in table if i is not None]
    out = {}
    for i, v, _ in known:
        others = [(w, g) for j, w, g in known if j != i]
        for x in range(groups) if others else ():
            best = [float(v @ w) for w, g in others if g == x and v is not None and w is not None and len(w) == len(v)]
            out.setdefault(i, [[] for _ in range(groups)])[x].extend(best)
    return {i: [max(b) if b else None for b in best] for i, best in out.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for i, best in want.items():
        assert [x is None for x in got[i]] == [x is None for x in best], i
        assert all(x is None or abs(x - y) < 1e-12 for x, y in zip(got[i], best, strict=True)), (i, got[i], best)


def test_every_embedding_has_a_pattern_score(spark):
    want = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    got = QUERIES["pattern_scores"](spark, SF).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert len(got) == len(want) and {r.pair_id for r in got} == want
    assert {(r.pair_id, r.pattern_score) for r in got} == set(con.sql(SQL["pattern_scores"]).fetchall())


@pytest.mark.parametrize("rows", [7, 4096])
def test_best_cosines(spark, monkeypatch, rows):
    monkeypatch.setattr(nearest, "ROWS", rows)
    monkeypatch.setattr(nearest, "PART", 16 * 9 * 8 if rows == 7 else nearest.PART)
    r = np.random.default_rng(4)
    v = r.normal(size=(60, 8)).tolist()
    table = [(i, x, [0, 1, None][i % 3]) for i, x in enumerate(v)]
    table += [(100, [0.0] * 8, 0), (101, None, 1), (102, [], 0), (103, v[5], 1), (None, v[1], 0), (104, [1e200] * 8, 0), (105, [-1e-200] * 8, 1), (106, [1.0] * 7 + [float("nan")], 0), (107, [1.0] * 7 + [None], 1), (108, [1.0, 2.0], 0), (109, [2.0, 1.0], 1)]
    table += [(7, v[20], 0), (7, v[21], 1), (7, v[7], 1)]
    df = spark.createDataFrame(table, "id long, vector array<double>, group int")
    got = {x.id: [x.c, x.n] for x in nearest.best_cosines(df, ["c", "n"]).collect()}
    same(got, brute(table))


def test_one_id_has_nothing_to_be_near_to(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 1.0], 1), (None, [1.0, 1.0], 1)], "id long, vector array<double>, group int")
    assert nearest.best_cosines(df, ["c", "n"]).collect() == []
    assert nearest.best_cosines(df.where("id > 1"), ["c", "n"]).collect() == []


@pytest.mark.parametrize("many", [0, 1, 8])
def test_products_that_may_be_the_largest_are_taken_in_doubles(monkeypatch, many):
    """Rows nearer to each other than short floats tell apart, copies, and the same ids in both blocks."""
    monkeypatch.setattr(nearest, "MANY", many)
    monkeypatch.setattr(nearest, "STRIP", 7)
    r = np.random.default_rng(5)
    base = r.normal(size=(5, 64))
    table = [(i % 70, base[i % 5] + r.normal(size=64) * [1, 1e-5, 1e-8, 0][i % 4], i % 3) for i in range(80)]
    blocks = []
    for start in (0, 40):
        some = sorted(table[start : start + 40], key=lambda x: x[2])
        v = np.array([x[1] for x in some])
        sizes = [*np.bincount([x[2] for x in some], minlength=3).tolist(), 0]
        blocks.append((some, nearest._Block(np.array([x[0] for x in some]).tobytes(), v.tobytes(), sizes, v.dtype)))
    best = [np.full((2, 40), -np.inf) for _ in blocks]
    for i, j in ((0, 0), (0, 1), (1, 1)):
        nearest._meet(blocks[i][1], blocks[j][1], best[i], best[j])
    got = {}
    for (some, _), b in zip(blocks, best, strict=True):
        for (i, *_), c in zip(some, b.T.tolist(), strict=True):
            got[i] = [max(x, y) for x, y in zip(c, got.get(i, [-np.inf] * 2), strict=True)]
    same(got, brute([(i, v.tolist(), g) for i, v, g in table]))


def test_rounded_as_in_duckdb(spark):
    values = [i * 5e-7 * s for i in range(0, 60_000, 7) for s in (1, -1)] + [0.0078125, -0.0078125, 0.123415, 0.49999999999999994e-5]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", scalars.rounded(F.col("x"), 5).alias("r")).collect()
    want = duckdb.sql(f"SELECT round(x, 5) FROM (SELECT unnest({values}::DOUBLE[]) AS x)").fetchall()
    assert [x.r for x in got] == [x for (x,) in want]
