"""Splits of datasets without leaks, their audits, and components of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.operators.order import indexed
from tideglass.operators.components import connected_components
from tideglass.sources.scratch import discard, written

TEMPORAL = ((0.70, "train"), (0.15, "validation"))


def ordered_index(df: DataFrame, time: str, tie: str) -> DataFrame:
    """Add index, the place of each row in the order of (time, tie), from 0, and total. Rows without a time come last.

    Ranges of the order, so a day or a time with a third of all rows is split where its ties differ.
    """
    out = indexed(df, [F.asc_nulls_last(time), F.asc_nulls_last(tie)])
    return out.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))  # one row


def shares(n: Column) -> tuple[Column, Column]:
    """How many of n in order train and how many validate: 70 % and 15 %, rounded down and one at least; if nothing is left for test, all but two train."""
    (a, _), (b, _) = TEMPORAL
    train, validation = F.greatest(F.floor(n * a), F.lit(1)), F.greatest(F.floor(n * b), F.lit(1))
    crowded = train + validation >= n
    return F.when(crowded, n - 2).otherwise(train), F.when(crowded, F.lit(1)).otherwise(validation)


def _three(n: Column) -> Column:
    return F.when(n < 3, F.raise_error(F.lit("a split by time takes three hands at least")).cast("string"))


def temporal_split(hands: DataFrame, time: str = "played_at", tie: str = "hand_id") -> DataFrame:
    """Hands in the order of time by shares(): train, then validation, then test. Fewer than three hands, unless there is none, are an error."""
    train, validation = shares(F.col("total"))
    i = ordered_index(hands, time, tie)
    return i.withColumn("split", _three(F.col("total")).when(F.col("index") < train, "train").when(F.col("index") < train + validation, "validation").otherwise("test"))


def boundary_split(hands: DataFrame, time: str = "played_at", tie: str = "hand_id") -> DataFrame:
    """As temporal_split, but cut at 70 % and at 85 % of the hands, both rounded down: each part has one hand at least."""
    n = F.col("total")
    first = F.greatest(F.floor(n * 0.70), F.lit(1))
    second = F.least(n - 1, F.greatest(first + 1, F.floor(n * 0.85)))
    return ordered_index(hands, time, tie).withColumn("split", _three(n).when(F.col("index") < first, "train").when(F.col("index") < second, "validation").otherwise("test"))


def cycle_split(df: DataFrame, time: str, tie: str) -> DataFrame:
    """14 of every 20 rows in order train, 3 validation, 3 test."""
    turn = F.pmod(F.col("index"), F.lit(20))
    return ordered_index(df, time, tie).withColumn("split", F.when(turn < 14, "train").when(turn < 17, "validation").otherwise("test"))


def group_fold(group: str, folds: int):
    """A fold by hash: all rows of a group fall into one."""
    return F.pmod(F.xxhash64(group), F.lit(folds))


def stratified_folds(rows: DataFrame, group: str, label: str, folds: int, order: Column | None = None) -> DataFrame:
    """One row a group with positive, whether any of its rows is, and fold: groups of either kind are dealt out in turn, so folds differ by one or so.

    The order in which they are dealt is that of a hash unless one is given.
    """
    g = rows.groupBy(group).agg(F.max(F.col(label).cast("int")).alias("positive"))
    return indexed(g, [F.desc("positive"), F.xxhash64(group) if order is None else order, F.asc(group)]).withColumn("fold", F.pmod("index", F.lit(folds)).cast("int")).drop("index")


def overlap_audit(assigned: DataFrame, members: DataFrame, key: str, member: str) -> DataFrame:
    """Members that occur in more than one split; a leak-free assignment gives no row."""
    seen = members.join(assigned.select(key, "split"), key).groupBy(member).agg(F.count_distinct("split").alias("splits"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("in_splits"))
    return seen.where("splits > 1")


def order_audit(assigned: DataFrame, time: str = "played_at") -> DataFrame:
    """One row a split with its first and last time, and whether it starts before the one before has ended."""
    rank = F.array_position(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), F.col("split"))
    s = assigned.groupBy("split").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("rows")).withColumn("rank", rank)
    return s.withColumn("crosses", F.coalesce(F.col("first") < F.lag("last").over(Window.orderBy("rank")), F.lit(False))).drop("rank")  # three rows


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node and component, its smallest member, by large star and small star: the rounds grow with the logarithm of the nodes, however long the paths are.

    Edges with a null end count for nothing; a node with a loop alone is a component.
    """
    both = written(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")), "given")
    alone = both.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return connected_components(both, most_rounds).unionAll(alone).groupBy("node").agg(F.min("component").alias("component"))


def cold_start(hands: DataFrame, members: DataFrame, hand: str = "hand_id", member: str = "player_id", turn: Column | None = None) -> DataFrame:
    """Hands whose members all fall into one split by hash: 14 of 20 folds train, 3 validation, 3 test. No member is in two splits.

    Hands whose members are of several splits are in none, split null; so are hands without members. turn, from 0 to 19, may stand for the hash.
    """
    turn = group_fold(member, 20) if turn is None else turn
    side = F.when(turn < 14, "train").when(turn < 17, "validation").otherwise("test")
    of = members.groupBy(hand).agg(F.min(side).alias("low"), F.max(side).alias("high"))
    return hands.join(of, hand, "left").withColumn("split", F.when(F.col("low") == F.col("high"), F.col("low"))).drop("low", "high")


def new_relationship(hands: DataFrame, pairs: DataFrame, time: str = "played_at", hand: str = "hand_id", pair: str = "pair_key") -> DataFrame:
    """Hands with split, so that no positive relation of validation or test is seen in train.

    pairs: hand, pair_key and positive, whether the pair is positive in that hand; a pair is positive if it is in any. Positive pairs that meet in a hand are
    one component. Components in the order of their smallest pair go 70 % to train, 15 % to validation, both rounded down and one at
    least, the rest to test; one component is test, two are validation and test. Hands with a positive pair follow it; the others, in the order
    of time, go by a cycle of 14, 3 and 3. No positive pair is an error.
    """
    positive = written(pairs.groupBy(pair).agg(F.bool_or("positive").alias("p")).where("p").select(F.col(pair).alias("pp")), "positive")
    seen = written(pairs.select(hand, pair).distinct().join(positive, F.col(pair) == F.col("pp"), "left_semi"), "seen")
    first = seen.groupBy(hand).agg(F.min(pair).alias("a"))
    joined = seen.join(first, hand).select("a", F.col(pair).alias("b"))
    of = written(components(joined).withColumnRenamed("node", "c_pair"), "relations")
    groups = indexed(of.select("component").distinct(), [F.asc("component")])
    n = groups.count()
    if not n:
        raise ValueError("there is no positive pair")
    train, validation = (0, n - 1) if n < 3 else (max(1, int(n * 0.70)), max(1, int(n * 0.15)))
    if n >= 3 and train + validation >= n:
        train, validation = n - 2, 1
    side = F.when(F.col("index") < train, "train").when(F.col("index") < train + validation, "validation").otherwise("test")
    of_hand = seen.join(of, F.col(pair) == F.col("c_pair")).join(groups, "component").groupBy(hand).agg(F.min(side).alias("__own"))
    all_ = written(hands.join(of_hand, hand, "left"), "hands")
    free = cycle_split(all_.where("__own is null"), time, hand).drop("index", "total")
    return all_.where("__own is not null").withColumn("split", F.col("__own")).unionByName(free).drop("__own")
