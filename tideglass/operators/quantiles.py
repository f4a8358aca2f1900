"""Exact quantiles with linear interpolation, by ranges of the values: no task holds the distinct values of a table or of a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.operators import slices


def quantiles(df: DataFrame, value: Column, fractions: list[float], by: list[str] | None = None) -> DataFrame:
    """One row a group (one in all without `by`, none for an empty table) with q, the quantiles of its values as doubles in the order of the fractions.

    Nulls are left out; a NaN is larger than all numbers. Equal values shrink to one row with their count; running counts over sorted ranges give each value its ranks, and only the
    values at the two ranks beside each quantile go on, so what meets in one group is twice the fractions.
    """
    keys = by or []
    counts = df.select(*keys, value.cast("double").alias("__v")).where("__v is not null").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    if not keys:
        counts, keys = counts.withColumn("__all", F.lit(0)), ["__all"]
    ranked = slices.before(counts, keys, [F.col("__v")], sums={"__before": F.col("__n")}).withColumn("__before", F.coalesce("__before", F.lit(0)))
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__total")).select("__total", *[F.col(k).alias(f"__k_{k}") for k in keys])
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        on = one if on is None else on & one
    place = [(F.col("__total") - 1) * F.lit(f) for f in fractions]
    want = F.array(*[F.struct(F.lit(2 * i + up).alias("i"), (F.ceil(p) if up else F.floor(p)).alias("rank")) for i, p in enumerate(place) for up in (0, 1)])
    hit = F.filter(want, lambda w: (w["rank"] >= F.col("__before")) & (w["rank"] < F.col("__before") + F.col("__n")))
    found = ranked.join(total, on).select(*keys, "__v", "__total", F.explode(hit).alias("x"))
    ends = [F.max(F.when(F.col("x.i") == i, F.col("__v"))).alias(f"__e{i}") for i in range(2 * len(fractions))]
    g = found.groupBy(*keys).agg(F.first("__total").alias("__total"), *ends)

    def between(i: int) -> Column:
        low, high, at = F.col(f"__e{2 * i}"), F.col(f"__e{2 * i + 1}"), place[i]
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return g.select(*(by or []), F.array(*[between(i) for i in range(len(fractions))]).alias("q"))


def of_columns(df: DataFrame, columns: dict[str, Column], fractions: list[float]) -> dict[str, list[float | None]]:
    """The quantiles of several columns at once; those of a column without a value are None. What reaches the driver is a few numbers a column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), v.cast("double").alias("v")) for c, v in columns.items()])).alias("x")).select("x.*")
    found = {r.c: list(r.q) for r in quantiles(long, F.col("v"), fractions, ["c"]).collect()}
    return {c: found.get(c, [None] * len(fractions)) for c in columns}
