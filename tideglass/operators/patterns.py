"""Patterns in the sequence of actions of a hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gap_bonus(gap: Column, most: int) -> Column:
    return 0.12 * F.greatest(F.lit(0.0), (most - gap + 1) / F.lit(float(most)))


def action_patterns(actions: DataFrame, big_blind: float = 2.0, max_gap: int = 3, min_call_bb: float = 2.0) -> DataFrame:
    """One row for each pattern that an action completes: hand_id, sequence_no, pattern, player_id, counterparty_id, score.

    Every look-back is a window over the hand in the order of sequence_no; gaps are differences of it. A hand is one exchange.
    """
    w = Window.partitionBy("hand_id").orderBy("sequence_no").rowsBetween(Window.unboundedPreceding, -1)
    kind, me = F.col("action_type"), F.col("player_id")
    here = F.struct(F.col("player_id").alias("p"), F.col("sequence_no").alias("s"))
    raise_ = (F.col("street") == "preflop") & (kind == "raise")
    aggressive = kind.isin("bet", "raise")
    a = actions.withColumns({
        "bb": F.col("amount") / max(big_blind or 1.0, 1e-6), "raisers": F.collect_set(F.when(raise_, me)).over(w), "raises": F.collect_list(F.when(raise_, here)).over(w),
        "aggressor": F.last(F.when(aggressive, here), ignorenulls=True).over(w),
    }).withColumn("before", F.lag(F.struct("player_id", "action_type", "sequence_no")).over(Window.partitionBy("hand_id", "street").orderBy("sequence_no")))
    others = F.filter("raises", lambda x: x["p"] != me)
    n_others = F.size(F.array_remove("raisers", me))
    amount = F.least(F.lit(0.12), F.col("bb") / 40)
    gap, back = F.col("sequence_no") - F.col("aggressor.s"), F.col("sequence_no") - F.col("before.sequence_no")
    recent = (F.col("aggressor.p") != me) & (gap > 0) & (gap <= max_gap)
    passive = kind.isin("check", "call") & (F.col("street") != "preflop") & F.col("before.action_type").isin("check", "call") & (F.col("before.player_id") != me) & (back <= max_gap)
    found = [
        (raise_ & (n_others > 0), "preflop_squeeze", F.element_at(others, -1)["p"], F.least(F.lit(0.95), 0.62 + 0.08 * F.least(n_others, F.lit(3)) + amount)),
        ((kind == "fold") & recent, "raise_fold_benefit", F.col("aggressor.p"), F.least(F.lit(0.90), 0.55 + F.when(F.col("street") == "preflop", 0.05).otherwise(0.0) + _gap_bonus(gap, max_gap))),
        ((kind == "call") & (F.col("bb") >= min_call_bb) & recent, "call_down_transfer", F.col("aggressor.p"), F.least(F.lit(0.88), 0.50 + _gap_bonus(gap, max_gap) + amount)),
        (passive, "soft_play_passive_chain", F.col("before.player_id"), F.least(F.lit(0.78), 0.42 + _gap_bonus(back, max_gap))),
    ]
    rows = F.array(*[F.when(c, F.struct(F.lit(name).alias("pattern"), who.alias("counterparty_id"), score.alias("score"))) for c, name, who, score in found])
    return a.select("hand_id", "sequence_no", "player_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("hand_id", "sequence_no", "player_id", "x.*")


def score_by_player(patterns: DataFrame) -> DataFrame:
    """The highest score of a pattern that a player takes part in on either side, per hand."""
    both = patterns.select("hand_id", F.explode(F.array("player_id", "counterparty_id")).alias("player_id"), "score")
    return both.groupBy("hand_id", "player_id").agg(F.max("score").alias("pattern_score"))
