"""Pairs of players of a hand: statistics, rolling memory and features of the current hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS, EPS_PAIR = 1e-6, 1e-9
#: What features of pairs take from the seats.
SEAT = ("won_amount", "invested", "aggressive", "folds", "raised", "saw_flop", "saw_river")


def pair_rows(players: DataFrame, carry: tuple[str, ...] = ("won_amount",), hand: str = "hand_id", player: str = "player_id") -> DataFrame:
    """One row for each two players of a hand, player_a < player_b, with the carried columns of both as x_a and x_b.

    An equality on the hand with a residual comparison: a hash or sort-merge join whose output is quadratic in a table's seats only.
    """
    a = players.select(hand, F.col(player).alias("player_a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    b = players.select(F.col(hand).alias("__hand"), F.col(player).alias("player_b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return a.join(b, (F.col(hand) == F.col("__hand")) & (F.col("player_a") < F.col("player_b"))).drop("__hand")


def pair_stats(players: DataFrame, min_hands: int = 2) -> DataFrame:
    """Chip transfer, fold benefit and soft play of each pair over all its hands; soft play is 0 or 1: they never both won."""
    both = (F.col("won_amount_a") > 0) & (F.col("won_amount_b") > 0)
    g = pair_rows(players).groupBy("player_a", "player_b").agg(
        F.count(F.lit(1)).alias("hands_together"), F.sum("won_amount_a").alias("sa"), F.sum("won_amount_b").alias("sb"), (~F.bool_or(both)).cast("double").alias("soft_play_frequency"),
    )
    n = F.col("hands_together")
    g = g.withColumns({"chip_transfer_ratio": F.col("sb") / (F.col("sa") + EPS), "fold_benefit_ratio": (F.col("sb") / n) / (F.abs(F.col("sa") / n) + EPS), "showdown_avoidance_rate": F.col("soft_play_frequency")})
    transfer = F.least(F.greatest(F.col("chip_transfer_ratio"), F.lit(0.0)), F.lit(5.0)) / 5
    score = F.col("soft_play_frequency") * 30 + transfer * 30 + F.col("showdown_avoidance_rate") * 20
    return g.withColumn("pair_score", score).where(n >= min_hands).drop("sa", "sb")


def pair_memory(players: DataFrame, order: tuple[str, ...] = ("hand_id",)) -> DataFrame:
    """The running memory of a pair after each of its hands, the hand itself included; soft play is a rate here."""
    both = (F.col("won_amount_a") > 0) & (F.col("won_amount_b") > 0)
    w = Window.partitionBy("player_a", "player_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    m = pair_rows(players).withColumns({"n": F.count(F.lit(1)).over(w), "sa": F.sum("won_amount_a").over(w), "sb": F.sum("won_amount_b").over(w), "no_cowin": F.sum((~both).cast("int")).over(w)})
    m = m.withColumns({"transfer": F.col("sb") / (F.abs("sa") + EPS), "soft_play": F.col("no_cowin") / F.col("n"), "fold_benefit": (F.col("sb") / F.col("n")) / (F.abs(F.col("sa") / F.col("n")) + EPS)})
    part = lambda x, most: F.least(F.lit(1.0), x / most)
    score = 0.25 * part(F.col("n"), 5) + 0.30 * F.col("soft_play") + 0.25 * part(F.abs("transfer"), 3) + 0.20 * part(F.abs("fold_benefit"), 3)
    m = m.withColumn("memory_score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    return m.select("hand_id", F.concat_ws("|", "player_a", "player_b").alias("pair_key"), "player_a", "player_b", "n", "transfer", "soft_play", "fold_benefit", "memory_score")


def most_recent_pairs(memory: DataFrame, most: int, parts: int | None = None) -> DataFrame:
    """The `most` pairs that played last: a bounded report, as a cache with that capacity would hold. parts: into how many the rows are dealt, as set if not given."""
    dealt = memory.select("pair_key", "hand_id")
    dealt = dealt.repartition(parts, "pair_key") if parts else dealt
    last = dealt.groupBy("pair_key").agg(F.max("hand_id").alias("last_hand"))
    return last.orderBy(F.desc("last_hand"), "pair_key").limit(most)


def pairs_of_hands(hands: DataFrame, carry: tuple[str, ...], seats: str = "seats", only: Callable[[Column], Column] | None = None) -> DataFrame:
    """pair_rows() of hands that have their seats in an array of structs (player_id and the carried fields): no exchange. The other columns stay, the array goes. only: which players are wanted as player_a."""
    rest = [c for c in hands.columns if c != seats]
    one = hands.select(*rest, seats, F.inline(F.transform(F.filter(seats, lambda x: only(x["player_id"])) if only else seats, lambda x: F.struct(x.alias("__a")))))
    later = F.filter(seats, lambda y: y["player_id"] > F.col("__a.player_id"))
    both = one.select(*rest, "__a", F.inline(F.transform(later, lambda y: F.struct(y.alias("__b")))))
    return both.select(*rest, *[F.col(f"__{x}.player_id").alias(f"player_{x}") for x in "ab"], *[F.col(f"__{x}.{c}").alias(f"{c}_{x}") for c in carry for x in "ab"])


def action_summary(actions: DataFrame) -> DataFrame:
    """Per (hand, player): money, aggressive actions, folds, whether raised, saw the flop, saw the river."""
    kind, street = F.col("action_type"), F.col("street")
    return actions.groupBy("hand_id", "player_id").agg(
        F.sum("amount").alias("invested"), F.count_if(kind.isin("bet", "raise")).alias("aggressive"), F.count_if(kind == "fold").alias("folds"),
        F.bool_or(kind == "raise").alias("raised"), F.bool_or(street == "flop").alias("saw_flop"), F.bool_or(street == "river").alias("saw_river"),
    )


def current_hand(hands: DataFrame, players: DataFrame, actions: DataFrame) -> DataFrame:
    """Features of each pair in the hand itself; ratios are to the pot, rounded half-even to nine digits."""
    seats = players.select("hand_id", "player_id", "won_amount").join(action_summary(actions), ["hand_id", "player_id"], "left").fillna(0, subset=["invested", "aggressive", "folds"]).fillna(False, subset=["raised", "saw_flop", "saw_river"])
    p = pair_rows(seats, SEAT).join(hands.select("hand_id", "table_id", "played_at", "pot_size"), "hand_id")
    return with_pair_features(p)


def with_pair_features(p: DataFrame) -> DataFrame:
    """Pairs of a hand, with SEAT of both sides and pot_size, and their features."""
    pot = F.greatest(F.col("pot_size"), F.lit(EPS_PAIR))
    a_fold = (F.col("folds_a") > 0) & (F.col("won_amount_b") > 0)
    b_fold = (F.col("folds_b") > 0) & (F.col("won_amount_a") > 0)
    r = lambda x: F.bround(x, 9)
    return p.withColumns({
        "pair_key": F.concat_ws(":", "player_a", "player_b"), "invested_ratio_a": r(F.col("invested_a") / pot), "invested_ratio_b": r(F.col("invested_b") / pot), "won_ratio_a": r(F.col("won_amount_a") / pot), "won_ratio_b": r(F.col("won_amount_b") / pot),
        "both_saw_flop": F.col("saw_flop_a") & F.col("saw_flop_b"), "both_saw_river": F.col("saw_river_a") & F.col("saw_river_b"), "both_raised": F.col("raised_a") & F.col("raised_b"),
        "a_fold_b_win": a_fold, "b_fold_a_win": b_fold, "one_folded_other_won": a_fold | b_fold,
    })
