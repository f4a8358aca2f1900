"""Whitening of embeddings by their principal components.

1. Entries are quantised to integers; the fit list is each distinct vector once. Partial aggregation takes copies away before the only shuffle.
2. One aggregation yields the number of vectors and the sum, least and largest entry of each dimension.
3. One more, of generated SQL expressions, sums the centred product of every pair of dimensions of the upper triangle. It goes by GROUPS groups of partitions, so
   that what the driver adds up is at most GROUPS rows, whatever the number of tasks. Dimensions that have more than MOST_PAIRS pairs take several of these aggregations.
4. LAPACK decomposes the covariance on the driver: its size is that of the dimensions. Vectors are projected in Arrow batches by a matrix product.

Centring is exact: the mean is a whole number m and a fraction r below 1, and (x - m) - r loses nothing to the size of the entries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.common import without, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
GROUPS, MOST_PAIRS = 64, 2_500
#: Entries from here on have no exact quantised value as a double and are treated as infinite ones.
LARGEST = 2.0**53 / SCALE
RESULT = ("n", "deviation", "whitened")


@dataclass
class Whitening:
    """What was fitted: n vectors, their sums, the components' unit vectors as columns with eigenvalues falling, and the share of the trace of each."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    most_deviation: int
    identity_error: float = math.nan

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums.tolist()], np.int64) if self.n else np.zeros(0, np.int64)

    @property
    def fraction(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums.tolist()])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.fraction

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each vector, the sum of (n x - S)^2, exact; None beyond a long. Longs are used where the fit shows that they are enough."""
        if self.most_deviation < 2**63:
            return ((self.n * x - self.sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums.tolist(), strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]


def quantised(rows: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vectors are whole and finite, with __x, the entries as whole numbers: floor(SCALE c) + SHIFT.

    Vectors of another length than most have (of two lengths as frequent, the larger) can not be whitened together with these and are left out, too.
    """
    vector = F.col(f"`{vector_col}`")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= LARGEST))
    good = rows.where(vector.isNotNull()).where(~bad)
    length = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()  # one row a length
    dims = length["d"] if length else 0
    return good.where(F.size(vector) == dims).withColumn("__x", F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))


def _summed(rows: DataFrame, sums: list[str]) -> list[float]:
    """SQL sums over all rows, by groups of partitions and then on the driver, which adds up GROUPS rows without loss."""
    out = rows.withColumn("__g", F.spark_partition_id() % GROUPS).groupBy("__g").agg(*[F.expr(f"{s} AS s{i}") for i, s in enumerate(sums)]).drop("__g").toArrow()
    return [math.fsum(v for v in c.to_pylist() if v is not None) for c in out.columns]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors __x. Components whose eigenvalue is nothing but rounding are left out; without vectors there is no fit."""
    xs = written(vectors.select("__x").distinct(), "fit-list")
    first = xs.select(F.size("__x").alias("d")).first()
    if first is None:
        return None
    dims = first["d"]
    at = [F.get("__x", F.lit(i)) for i in range(dims)]
    least = xs.agg(F.count(F.lit(1)).alias("n"), *[f(c.cast(t)).alias(f"{k}{i}") for k, f, t in (("s", F.sum, "decimal(38,0)"), ("a", F.min, "long"), ("z", F.max, "long")) for i, c in enumerate(at)]).first()
    n, sums = least["n"], np.array([int(least[f"s{i}"]) for i in range(dims)], object)
    most = sum(max((n * least[f"{k}{i}"] - sums[i]) ** 2 for k in "az") for i in range(dims))
    fitted = Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), np.zeros(0), most)
    if not dims:
        return fitted
    centred = xs.select(*[((at[i] - F.lit(int(m))).cast("double") - F.lit(float(r))).alias(f"c{i}") for i, (m, r) in enumerate(zip(fitted.whole, fitted.fraction, strict=True))])
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    covariance = np.zeros((dims, dims))
    for k in range(0, len(pairs), MOST_PAIRS):
        some = pairs[k : k + MOST_PAIRS]
        for (i, j), v in zip(some, _summed(centred, [f"sum(c{i} * c{j})" for i, j in some]), strict=True):
            covariance[i, j] = covariance[j, i] = v / n
    values, axes = np.linalg.eigh(covariance)  # LAPACK
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0) * dims * np.finfo(float).eps]
    axes = axes[:, order] * np.sign(axes[np.abs(axes[:, order]).argmax(axis=0), order])  # the largest entry of each is positive
    fitted.vectors, fitted.values, fitted.explained = axes, values[order], values[order] / np.trace(covariance)
    fitted.identity_error = identity_error(xs, fitted)
    return fitted


def _projected(batches: Iterator[pa.RecordBatch], fitted: Whitening) -> Iterator[pa.RecordBatch]:
    """The batches with the columns whitened and deviation for __x."""
    k = len(fitted.values)
    for batch in batches:
        x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        white = fitted(x) if k else np.zeros((batch.num_rows, 0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * k, k) if k else np.zeros(batch.num_rows + 1, int), pa.int32()), pa.array(white.ravel()))
        keep = [i for i, c in enumerate(batch.schema.names) if c != "__x"]
        names = [batch.schema.names[i] for i in keep]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), lists, pa.array(fitted.deviations(x), pa.int64())], [*names, "__whitened", "__deviation"])


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__x") + ", __whitened array<double>, __deviation long"


def identity_error(xs: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of (covariance of the whitened fit list - identity), measured on the projected vectors, each centred again."""
    k = len(fitted.values)
    if not k:
        return 0.0
    white = xs.select("__x").mapInArrow(lambda batches: _projected(batches, fitted), "__whitened array<double>, __deviation long")
    white = white.select(*[F.get("__whitened", F.lit(i)).alias(f"w{i}") for i in range(k)])
    means = [s / fitted.n for s in _summed(white, [f"sum(w{i})" for i in range(k)])]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = _summed(white, [f"sum((w{i} - {means[i]!r}D) * (w{j} - {means[j]!r}D))" for i, j in pairs])
    return max(abs(v / fitted.n - (i == j)) for (i, j), v in zip(pairs, products, strict=True))


def whiten(rows: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The rows that have a whole and finite vector, with n, deviation and whitened (an array, the first component first), and what was fitted.

    A null vector, and one with a null, infinite or not-a-number entry, has no row in the result; quantised() says what else. Copies weigh as one vector in
    the fit and each has its row. Where all vectors lie in fewer dimensions than components, there are as many components as dimensions; if all are
    equal, none. deviation is null beyond a long. An empty table gives an empty one and no fit. Input columns named as a result are replaced, other columns pass through.
    """
    found = quantised(without(rows, [x for x in RESULT if x != vector_col]), vector_col)
    found = written(found, "quantised")
    fitted = fit(found, components)
    if fitted is None:
        none = found.drop("__x").withColumns({"n": F.lit(None).cast("long"), "deviation": F.lit(None).cast("long"), "whitened": F.lit(None).cast("array<double>")})
        return none, None
    out = found.mapInArrow(lambda batches: _projected(batches, fitted), _schema(found))
    return out.withColumn("n", F.lit(fitted.n).cast("long")).withColumnsRenamed({"__whitened": "whitened", "__deviation": "deviation"}), fitted


def by_component(out: DataFrame, fitted: Whitening | None, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component, numbered from 1, with the component's share of the variance and the identity error of all."""
    share = F.array(*map(F.lit, map(float, fitted.explained))) if fitted is not None and len(fitted.values) else F.array().cast("array<double>")
    error: Column = F.lit(float(fitted.identity_error) if fitted is not None else None).cast("double")
    rows = out.select(id_col, "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(id_col, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), error.alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    column = "embedding" if "embedding" in vectors.columns else "vector"
    return by_component(*whiten(vectors.select("vec_id", column), vector_col=column))
