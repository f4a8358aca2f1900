"""Whitening against numpy on the distinct vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(rows, components=16):
    """{id: (deviation, [whitened])} up to signs, and the shares, of rows (id, vector)."""
    ok = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(v) for _, v in ok})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in distinct])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes[:, values > values.max() * len(sums) * np.finfo(float).eps]
    values = values[: axes.shape[1]]
    white = {i: np.array([(n * c - s) / n for c, s in zip(v, sums, strict=True)]) @ axes / np.sqrt(values) for i, v in ok}
    return n, {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in ok}, white, values / np.trace(covariance)


def compare(out, fitted, rows, close=1e-8):
    n, deviation, white, share = plain(rows)
    found = out.collect()
    assert len(found) == sum(i in white for i, _ in rows) and {r.vec_id: r.deviation for r in found} == deviation and {r.n for r in found} == {n}
    got = {r.vec_id: np.array(r.whitened) for r in found}
    signs = np.sign(sum(got[i] * white[i] for i in white))
    assert max(np.abs(got[i] * signs - white[i]).max() for i in white) < close
    assert np.allclose(fitted.explained, share, rtol=1e-6) and fitted.identity_error < 1e-9


def test_query_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    _, deviation, white, share = plain(rows)
    got = whitening.op11_whitening(spark, SF).toPandas()
    assert len(got) == len(rows) * 16 and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    for k, part in got.groupby("component"):
        want = np.array([white[i][k - 1] for i in part.vec_id])
        assert min(np.abs(part.whitened - want).max(), np.abs(part.whitened + want).max()) < 1e-8
        assert np.allclose(part.explained, share[k - 1]) and part.deviation.tolist() == [deviation[i] for i in part.vec_id]


@pytest.mark.parametrize("wide", [False, True])
def test_odd_vectors(spark, wide, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_PAIRS", 4)
    r = random.Random(5)
    big = 1e9 if wide else 1.0  # wide: deviations beyond a long
    vectors = [[r.gauss(0, 1) * big, r.gauss(3, 2), -0.01, r.random(), 2.5] for _ in range(60)]
    rows = list(enumerate(vectors)) + [(100 + i, vectors[0]) for i in range(50)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [math.nan] * 5), (203, [0.0, math.inf, 0.0, 0.0, 0.0]), (204, [-math.inf] * 5), (205, [1e300] * 5), (206, []), (207, [1.0]), (None, vectors[1]), (3, vectors[3])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6).withColumns({c: F.lit("clash") for c in ("N", "deviation", "__whitened_", "c0")})
    good = [x for x in rows if x[0] not in (205, 206, 207)]  # entries without a whole number, and other lengths
    out, fitted = whitening.whiten(table)
    assert out.where("c0 = 'clash'").count() == 112 and fitted.vectors.shape == (5, 1 if wide else 3)  # two dimensions do not vary; beside the wide one all others are rounding
    if wide:
        _, deviation, _, _ = plain(good)
        assert {x.vec_id: x.deviation for x in out.collect()} == {i: d if d < 2**63 else None for i, d in deviation.items()}
    else:
        compare(out, fitted, good)


def test_equal_vectors_and_nothing(spark):
    table = spark.createDataFrame([(i, [0.5, 1.0]) for i in range(9)], "vec_id long, embedding array<float>")
    out, fitted = whitening.whiten(table)
    assert fitted.n == 1 and [(r.n, r.deviation, r.whitened) for r in out.collect()] == [(1, 0, [])] * 9 and whitening.by_component(out, fitted).count() == 0
    for none in (table.limit(0), table.withColumn("embedding", F.lit(None).cast("array<float>"))):
        out, fitted = whitening.whiten(none)
        assert fitted is None and out.count() == 0 and whitening.by_component(out, fitted).count() == 0
