"""The best cosine of every row with all other rows of each of some groups, by tiles of blocks of rows.

Rows are packed into blocks, and each two blocks meet once, for both of them: a Cartesian product of blocks, whose tasks read two parts of the blocks' table. No vector is broadcast, sent to
the driver or shuffled once it is packed, and a task holds two parts whatever the table's size. The work is that of all pairs: it grows with the square of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.sources.scratch import discard, written

#: Rows and bytes of a block at most, bytes of a part of blocks at most, parts that are made anyhow of rows enough, rows of a block whose products are taken at a time, and products of a row that are taken anew one by one before all are.
ROWS, BLOCK, PART, SPREAD, STRIP, MANY = 4096, 2 << 20, 64 << 20, 8, 128, 8

#: The setting for the bytes of an Arrow batch: a batch has some blocks, which would fill a task's memory at Spark's own value.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def best_cosines(rows: DataFrame, groups: list[str]) -> DataFrame:
    """id and, under each group's name, the largest cosine of one of the id's rows and another id's row of that group, or null if there is none.

    rows: id, a whole number, vector, and group, the place of its group in groups or null. Rows without an id count for nothing; an id without any other has no row.
    What is null, of another length, not finite or of length zero has no cosine.
    """
    kind = "float" if rows.schema["vector"].dataType.simpleString() == "array<float>" else "double"
    known = rows.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast(f"array<{kind}>").alias("v"), F.coalesce(F.col("group").cast("int"), F.lit(len(groups))).alias("g"))
    n, width = known.agg(F.count("id"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    floats = np.dtype({"float": np.float32, "double": np.float64}[kind])
    row = floats.itemsize * max(0, width) + 8
    split = min(PART, int(rows.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()) * 9 // 10)  # a part's file is read by one task
    parts = max(1, -(-n * row // split), min(SPREAD, -(-n // 1024)))
    packed = known.repartition(parts).mapInArrow(_packed(len(groups), max(1, min(ROWS, BLOCK // row)), floats), "ids binary, vectors binary, sizes array<int>")
    blocks = written(packed.withColumn("k", F.monotonically_increasing_id()), "blocks")
    of = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in ("k", "ids", "vectors", "sizes")])
    tiles = of("a").join(of("b").hint("shuffle_replicate_nl"), F.col("k_a") <= F.col("k_b"))
    found = tiles.mapInArrow(_met(len(groups), floats), "id long, " + ", ".join(f"c{i} double" for i in range(len(groups))))
    spark, was = rows.sparkSession, rows.sparkSession.conf.get(BATCH, None)
    spark.conf.set(BATCH, f"{4 * BLOCK}b")
    try:
        out = written(found.groupBy("id").agg(*[F.max(f"c{i}").alias(g) for i, g in enumerate(groups)]), "best")
    finally:
        spark.conf.unset(BATCH) if was is None else spark.conf.set(BATCH, was)
    discard(blocks)
    return out


def _packed(groups: int, most: int, floats: np.dtype):
    """A function for mapInArrow: blocks of `most` rows of one width at most, in the order of their groups, those of none and those without a cosine last. sizes: how many rows each of these kinds has."""

    def block(ids: np.ndarray, v: np.ndarray, kind: np.ndarray) -> tuple:
        order = np.argsort(kind, kind="stable")
        return ids[order].tobytes(), v[order].tobytes(), np.bincount(kind, minlength=groups + 2).tolist()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            ids, kinds = batch.column("id").to_numpy(zero_copy_only=False), batch.column("g").to_numpy(zero_copy_only=False)
            wide = pc.fill_null(pc.list_value_length(batch.column("v")), 0).to_numpy(zero_copy_only=False)
            for w in np.unique(wide).tolist():
                at = np.flatnonzero(wide == w)
                v, kind = np.zeros((len(at), w), floats), np.full(len(at), groups + 1)
                if w:
                    given = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
                    top = np.abs(given).max(axis=1)
                    good = np.isfinite(top) & (top > 0)
                    v[good] = given[good]
                    kind[good] = kinds[at][good]
                old = kept.get(w)
                one = [np.concatenate(x) for x in zip(old, (ids[at], v, kind), strict=True)] if old else [ids[at], v, kind]
                while len(one[0]) >= most:
                    yield _batch([block(*(x[:most] for x in one))])
                    one = [x[most:] for x in one]
                kept[w] = one
        for one in kept.values():
            if len(one[0]):
                yield _batch([block(*one)])

    return packed


def _batch(blocks: list[tuple]) -> pa.RecordBatch:
    ids, vectors, sizes = zip(*blocks, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(vectors, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))], ["ids", "vectors", "sizes"])


class _Block:
    """Rows of a block: all ids, and in doubles and in short floats the vectors that have a cosine, at length one."""

    def __init__(self, ids: bytes, vectors: bytes, sizes: list[int], floats: np.dtype) -> None:
        self.ids = np.frombuffer(ids, np.int64).copy()
        self.ends = self.ids.min(), self.ids.max()
        self.v = np.frombuffer(vectors, floats).reshape(len(self.ids), -1)[: sum(sizes[:-1])].astype(np.float64)
        if self.v.size:
            self.v /= np.abs(self.v).max(axis=1)[:, None]
            self.v /= np.sqrt(np.einsum("ij,ij->i", self.v, self.v))[:, None]
        self.short = self.v.astype(np.float32)
        ends = np.cumsum(sizes).tolist()
        self.spans = list(zip([0, *ends], ends, strict=False))[:-2]


def _meet(a: _Block, b: _Block, best_a: np.ndarray, best_b: np.ndarray) -> None:
    """Raise the best of each group (rows) for each row of a (columns) to its products with b, and those for b to its products with a."""
    n, width = a.v.shape
    if not n or not len(b.v) or width != b.v.shape[1]:
        return
    slack = (width + 8) * 2.0**-24
    there = b.ids[: len(b.v)]
    shared = np.isin(a.ids[:n], there) if a.ends[0] <= b.ends[1] and b.ends[0] <= a.ends[1] else np.zeros(n, bool)
    room = np.empty((min(STRIP, n), len(b.v)), np.float32)
    for start in range(0, n, STRIP):
        stop = min(start + STRIP, n)
        c = np.matmul(a.short[start:stop], b.short.T, out=room[: stop - start])
        for r in np.flatnonzero(shared[start:stop]):
            c[r, there == a.ids[start + r]] = -np.inf
        for g, (x, y) in enumerate(b.spans):
            if x < y:
                _raise(best_a[g, start:stop], c[:, x:y], a.v[start:stop], b.v[x:y], slack)
        for g, (x, y) in enumerate(a.spans):
            if (x := max(x, start)) < (y := min(y, stop)):
                _raise(best_b[g, : len(b.v)], c[x - start : y - start], b.v, a.v[x:y], slack, down=True)


def _raise(best: np.ndarray, short: np.ndarray, u: np.ndarray, v: np.ndarray, slack: float, down: bool = False) -> None:
    """Raise best, of each row of u, to the largest of its products with v. short: the products in short floats, u by v or, down, v by u, each at most slack off, -inf where there is none; only those that may be the largest are taken anew in doubles."""
    may = lambda top, at: np.flatnonzero((top > -np.inf) & (top.astype(np.float64) + slack >= best[at]))
    at = may(short.max(axis=0 if down else 1), slice(None))
    if not len(at):
        return
    left = np.ascontiguousarray(short.take(at, axis=1).T) if down else short.take(at, axis=0)
    for _ in range(MANY):
        j = left.argmax(axis=1)
        live = may(left[np.arange(len(at)), j], at)
        if len(live) < len(at):
            at, j, left = at[live], j[live], left[live]
        if not len(at):
            return
        best[at] = np.maximum(best[at], np.einsum("ij,ij->i", u[at], v[j]))
        left[np.arange(len(at)), j] = -np.inf
    c = u[at] @ v.T  # many are as near as the nearest
    c[np.isneginf(left)] = -np.inf
    best[at] = np.maximum(best[at], c.max(axis=1))


def _met(groups: int, floats: np.dtype):
    """A function for mapInArrow: of each row of the blocks of a task's tiles the best of each group, where it meets another id."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        a = b = ka = None
        for batch in batches:
            for t in range(batch.num_rows):
                get = lambda s: _Block(*(batch.column(f"{c}_{s}")[t].as_buffer() for c in ("ids", "vectors")), batch.column(f"sizes_{s}")[t].as_py(), floats)  # noqa: B023, E731
                left, kb = (batch.column(f"k_{s}")[t].as_py() for s in "ab")
                a, ka, b = a if left == ka else get("a"), left, get("b")
                for k, x in ((ka, a), (kb, b)):
                    if k not in best:
                        best[k] = x.ids, np.full((groups, len(x.ids)), -np.inf), np.zeros(len(x.ids), bool)
                for k, x, y in ((ka, a, b), (kb, b, a)):
                    best[k][2][:] |= (x.ids != y.ends[0]) | (x.ids != y.ends[1])
                _meet(a, b, best[ka][1], best[kb][1])
        for ids, c, other in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(ids[other]), *[pa.array(x[other], mask=np.isneginf(x[other])) for x in c]], ["id", *[f"c{i}" for i in range(groups)]])

    return met
