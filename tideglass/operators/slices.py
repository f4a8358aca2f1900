"""Running aggregates of each key in an order of time, without a task that holds a hot key.

Rows are counted by buckets of their keys first. Those of buckets of up to HOT rows take one exchange by the keys and a window over each. The other rows
are sorted by (keys, order) in ranges and written, so a key with a third of all rows lies in a third of the ranges: slices of its time. Within a slice
a window does the work; what a key brings from its slices before is one row for each range: sums that were added up over the ranges and last values that were carried on.
Those rows are broadcast: their number is that of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.operators.order import AT, PART, _ranges
from tideglass.operators.pairs import pairs_of_hands

#: Keys fall into so many buckets by hash; the keys of a bucket with more rows than HOT go by slices.
BUCKETS, HOT = 16_384, 1_000_000


def _bucket(keys: list[str | Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def hot_buckets(df: DataFrame, keys: list[str]) -> list[int]:
    """Buckets of keys with more than HOT rows, BUCKETS at most. What is shuffled is a count a bucket and task."""
    counts = df.groupBy(_bucket(keys).alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    return sorted(r.b for r in counts.select("b").collect())


def hot_pairs(hands: DataFrame, keys: tuple[str, str], seats: str = "seats") -> list[int]:
    """hot_buckets() of pairs of the players that hands have in an array of structs. A pair has no more hands than either player, so pairs are made and counted only for players of hot buckets, if there are any."""
    found = hot_buckets(hands.select(F.explode(f"{seats}.player_id").alias("player_id")), ["player_id"])
    return hot_buckets(pairs_of_hands(hands, (), seats, lambda player: _bucket([player]).isin(found)), [*keys]) if found else []


def parted(df: DataFrame, keys: list[str], hot: list[int] | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of other keys, and those of hot buckets (None if there are none). hot: hot_buckets() of these keys or of coarser ones, if known."""
    hot = hot_buckets(df, keys) if hot is None else hot
    among = _bucket(keys).isin(hot)
    return (df.where(~among), df.where(among)) if hot else (df, None)


def before(df: DataFrame, keys: list[str], order: list[Column], *, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, hot: list[int] | None = None) -> DataFrame:
    """Add what the earlier rows of the same keys hold, the row itself left out: sums (null where there is no earlier row) and the last value that is not null.

    Null keys are a key like any other. Rows that are equal in the order follow each other in any order, so put into it what tells them apart. An empty table
    gives an empty one. hot: see parted().
    """
    sums, lasts = sums or {}, lasts or {}
    cold, large = parted(df, keys, hot)
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cold.withColumns({k: F.sum(v).over(earlier) for k, v in sums.items()} | {k: F.last(v, ignorenulls=True).over(earlier) for k, v in lasts.items()})
    return out if large is None else out.unionByName(_sliced(large, keys, order, sums, lasts))


def _sliced(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """The same by ranges of the keys' time."""
    values = {f"__{k}": v for k, v in (sums | lasts).items()}
    rows = _ranges(df.withColumns(values), [*map(F.col, keys), *order])
    key = F.struct(*[F.coalesce(F.to_json(F.struct(F.col(k).alias("k"))), F.lit("")).alias(k) for k in keys])  # as text, so that nulls compare
    ends = rows.groupBy(PART).agg(F.min_by(key, AT).alias("__first"), F.max_by(key, AT).alias("__final"))
    tail = rows.join(F.broadcast(ends), PART).where(key == F.col("__final"))
    known = lambda k: F.when(F.col(f"__{k}").isNotNull(), F.col(AT))
    totals = tail.groupBy(PART, "__first", "__final").agg(*[F.sum(f"__{k}").alias(k) for k in sums], *[F.max_by(F.col(f"__{k}"), known(k)).alias(k) for k in lasts])
    along, parts = Window.partitionBy("__final").orderBy(PART), Window.orderBy(PART)  # one row a range
    totals = totals.withColumns({k: F.sum(k).over(along) for k in sums} | {k: F.last(k, ignorenulls=True).over(along) for k in lasts})
    carry = totals.select(F.col(PART).alias("__p"), F.col("__first").alias("__k"), F.lag("__final").over(parts).alias("__was"), *[F.lag(k).over(parts).alias(f"{k}__carried") for k in [*sums, *lasts]])
    carry = carry.where(F.col("__was") == F.col("__k")).drop("__was")
    inside = Window.partitionBy(PART, *keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({k: F.sum(f"__{k}").over(inside) for k in sums} | {k: F.last(f"__{k}", ignorenulls=True).over(inside) for k in lasts})
    out = out.join(F.broadcast(carry), (F.col(PART) == F.col("__p")) & (key == F.col("__k")), "left")
    whole = {k: F.when(F.col(k).isNull() & F.col(f"{k}__carried").isNull(), None).otherwise(F.coalesce(k, F.lit(0)) + F.coalesce(f"{k}__carried", F.lit(0))) for k in sums}
    out = out.withColumns(whole | {k: F.coalesce(k, f"{k}__carried") for k in lasts})
    return out.drop(PART, AT, "__p", "__k", *values, *[f"{k}__carried" for k in [*sums, *lasts]])


def counted_before(queries: DataFrame, keys: list[str], time: str, events: DataFrame, event_time: str, name: str, weight: Column | None = None, hot: list[int] | None = None) -> DataFrame:
    """The queries with the sum of weights (1 each) of the events of their keys at strictly earlier times, 0 if there is none. events has the keys under the same names."""
    marks = events.select(*keys, F.col(event_time).alias("__t"), F.lit(1).alias("__kind"), (F.lit(1) if weight is None else weight).cast("long").alias("__w"))
    asked = queries.withColumns({"__t": F.col(time), "__kind": F.lit(0), "__w": F.lit(0).cast("long")})
    both = asked.unionByName(marks, allowMissingColumns=True)
    out = before(both, keys, [F.col("__t"), F.col("__kind")], sums={name: F.col("__w")}, hot=hot)  # queries of a time stand before its events
    return out.where("__kind = 0").drop("__t", "__kind", "__w").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
