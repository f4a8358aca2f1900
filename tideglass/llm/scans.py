"""Running sums within keys over sorted rows, without a task that holds a hot key.

The rows are sorted by (key, order) in ranges, so a long key lies in several of them. One numpy scan of each range, in Arrow batches, yields the sums from the
range's start or the key's; they are written. What a key brings from the ranges before is a window over one row a range, which is broadcast: its size is
the number of ranges. No row is shuffled twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import written

RANGE, ROW = "__range", "__row"


def powers(base: int, exponents: np.ndarray, modulus: int) -> np.ndarray:
    """base ** exponents modulo a number below 2^31, for all exponents at once, by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(base % modulus), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % np.uint64(modulus), out)
        square = square * square % np.uint64(modulus)
        left = left >> np.uint64(1)
    return out


def inverse(base: int, modulus: int) -> int:
    return pow(base, -1, modulus)


def _scan(batches: Iterator[pa.RecordBatch], key: str, sums: tuple[str, ...], modulus: int | None) -> Iterator[pa.RecordBatch]:
    """Replace each column of sums, and ROW, by its running sum within runs of one key; the batches of a task follow each other."""
    last, carried = None, dict.fromkeys([*sums, ROW], 0)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        lengths = np.diff(np.append(starts, n))
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        for name in carried:
            total = np.cumsum(batch.column(name).to_numpy(zero_copy_only=False))  # with a modulus below 2^31, a batch's sum is far from 2^63
            before = np.where(starts > 0, total[starts - 1], 0)
            if keys[0] == last:
                before[0] -= carried[name]
            total -= np.repeat(before, lengths)
            if modulus and name != ROW:
                total %= modulus
            carried[name] = int(total[-1])
            columns[name] = pa.array(total, pa.int64())
        last = keys[-1]
        yield pa.RecordBatch.from_arrays([columns[c] for c in batch.schema.names], schema=batch.schema)


def running(rows: DataFrame, key: str, order: list[str | Column], sums: dict[str, Column] | None = None, *, place: str | None = None, modulus: int | None = None) -> DataFrame:
    """The rows with sums over all rows of the key up to each row, itself included, and as `place` their number.

    key is a long column without nulls; the summed values are longs without nulls, from 0 to below the modulus if there is one. Nulls of the order come
    first; rows that are equal in it get their places in any order. An empty table gives an empty one.
    """
    held = list(sums or {})
    found = rows.withColumns((sums or {}) | {ROW: F.lit(1).cast("long")}).orderBy(key, *order).withColumn(RANGE, F.spark_partition_id())
    local = written(found.mapInArrow(lambda batches, held=tuple(held): _scan(batches, key, held, modulus), found.schema), "scanned")
    held.append(ROW)
    ends = local.groupBy(RANGE).agg(F.min(key).alias("__first"), F.max(key).alias("__last"))
    last = local.join(F.broadcast(ends), RANGE).where(F.col(key) == F.col("__last"))
    totals = last.groupBy(RANGE, "__first", "__last").agg(*[F.max_by(F.col(k), F.col(ROW)).alias(k) for k in held])  # a range's last row of its last key
    within, previous = Window.partitionBy("__last").orderBy(RANGE), Window.orderBy(RANGE)  # one row a range
    totals = totals.withColumns({k: F.sum(k).over(within) for k in held})
    carry = totals.select(F.col(RANGE).alias("__r"), F.col("__first").alias("__k"), F.lag("__last").over(previous).alias("__previous"), *[F.lag(k).over(previous).alias(f"{k}__before") for k in held])
    carry = carry.where(F.col("__previous") == F.col("__k"))
    out = local.join(F.broadcast(carry), (F.col(RANGE) == F.col("__r")) & (F.col(key) == F.col("__k")), "left")
    whole = {k: F.col(k) + F.coalesce(F.col(f"{k}__before"), F.lit(0)) for k in held}
    out = out.withColumns({k: v % F.lit(modulus) if modulus and k != ROW else v for k, v in whole.items()})
    out = out.drop(RANGE, "__r", "__k", "__previous", *[f"{k}__before" for k in held])
    return out.withColumnRenamed(ROW, place) if place else out.drop(ROW)
