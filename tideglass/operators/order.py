"""Places and running sums over a whole table in one order, without a task that holds the table or a hot key.

The rows are sorted by ranges and written with their places; a range's own rows are numbered within it, and the ranges, a few
hundred rows, are summed up over one small window. Equal rows of the order are in one range, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.sources.scratch import written

PART, AT = "__part", "__at"


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    return written(df.orderBy(*order).withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id()}), "ordered")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add the sums over all rows up to each row, itself included."""
    rows = _ranges(df.withColumns({f"__{k}": v for k, v in sums.items()}), order)
    totals = rows.groupBy(PART).agg(*[F.sum(f"__{k}").alias(f"__{k}_all") for k in sums])
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select(F.col(PART).alias("__p"), *[F.coalesce(F.sum(f"__{k}_all").over(before), F.lit(0)).alias(f"__{k}_before") for k in sums])
    inside = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({k: F.sum(f"__{k}").over(inside) for k in sums}).join(F.broadcast(totals), F.col(PART) == F.col("__p"))
    return out.withColumns({k: F.col(k) + F.col(f"__{k}_before") for k in sums}).drop(PART, AT, "__p", *[f"__{k}" for k in sums], *[f"__{k}_before" for k in sums])


def indexed(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """Add the place of each row in this order, from 0."""
    rows = _ranges(df, order)
    counts = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("__n"), F.min(AT).alias("__first"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = counts.select(F.col(PART).alias("__p"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # within a range the ids of the write are consecutive
    out = rows.join(F.broadcast(counts), F.col(PART) == F.col("__p"))
    return out.withColumn(name, (F.col("__before") + F.col(AT) - F.col("__first")).cast("long")).drop(PART, AT, "__p", "__first", "__before")
