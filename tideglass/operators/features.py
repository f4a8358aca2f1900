"""Features of a player in a hand, hole-card strength and rule flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.sources.testbed import RANKS, STREETS

EPS = 1e-6
#: The stack that ratios assume, and the order of seats.
ASSUMED_STACK = 100.0
SEAT_INDEX = {"UTG": 0, "MP": 1, "CO": 2, "BTN": 3, "SB": 4, "BB": 5}
RULES = ("PRE_MW", "PRE_OFOLD_COMMIT", "POST_OFOLD_COMMIT", "HIGH_INVEST_FOLD", "POSITION_ANOMALY")
RULE_WEIGHTS = {"PRE_MW": 20, "PRE_OFOLD_COMMIT": 30, "POST_OFOLD_COMMIT": 35, "HIGH_INVEST_FOLD": 25, "POSITION_ANOMALY": 10}
VERBS = ("bet", "raise", "call", "check", "fold")


def hole_features(cards: Column) -> dict[str, Column]:
    """Eight numbers of a pair of cards such as "As Kd"; all 0 for a null or one card only."""
    known = cards.isNotNull() & cards.contains(" ")
    one, two = F.split(cards, " ")[0], F.split(cards, " ")[1]
    rank = lambda c: F.instr(F.lit(RANKS), F.substring(c, 1, 1)) - 1
    high, low = F.greatest(rank(one), rank(two)), F.least(rank(one), rank(two))
    pair, suited = (high == low).cast("int"), (F.substring(one, 2, 1) == F.substring(two, 2, 1)).cast("int")
    strength = F.least(F.lit(1.0), (high + low) / 24 + 0.25 * pair + 0.05 * suited + 0.03 * (high - low <= 1).cast("int"))
    found = {"rank1": rank(one), "rank2": rank(two), "gap": high - low, "is_suited": suited, "is_pair": pair, "hand_strength": strength, "high_card": high, "low_card": low}
    return {k: F.when(known, v.cast("double")).otherwise(F.lit(0.0)) for k, v in found.items()}


def street_features(actions: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """Per (hand_id, player_id): counts, money and aggression on each street, and more aggregates, in one aggregation without a pivot or an outer join."""
    on = lambda s, cond=None: F.col("street") == s if cond is None else (F.col("street") == s) & cond
    aggs = []
    for s in STREETS:
        for v in VERBS:
            aggs.append(F.count_if(on(s, F.col("action_type") == v)).cast("double").alias(f"{s}_{v}s"))
        aggs.append(F.sum(F.when(on(s), F.col("amount")).otherwise(0.0)).alias(f"{s}_invested"))
        aggs.append(F.count_if(on(s)).alias(f"__{s}"))
    aggs += [F.sum("amount").alias("total_invested"), F.min(F.when(F.col("action_type") == "fold", F.array_position(F.array(*map(F.lit, STREETS)), F.col("street")))).alias("__fold")]
    out = actions.groupBy("hand_id", "player_id").agg(*aggs, *(more or []))
    for s in STREETS:
        out = out.withColumn(f"{s}_aggression", (F.col(f"{s}_bets") + F.col(f"{s}_raises")) / (F.col(f"{s}_calls") + F.col(f"{s}_checks") + EPS))
    saw = {f"saw_{s}": (F.col(f"__{s}") > 0).cast("int") for s in STREETS[1:]}
    return out.withColumns({**saw, "saw_showdown": (F.col("__river") > 0).cast("int"), "first_fold_street": F.when(F.col("__fold") > 0, F.get(F.array(*map(F.lit, STREETS)), F.col("__fold").cast("int") - 1))}).drop("__fold", *[f"__{s}" for s in STREETS])


def hand_features(hands: DataFrame, actions: DataFrame) -> DataFrame:
    per = actions.groupBy("hand_id").agg(
        F.count_distinct(F.when((F.col("street") == "preflop") & (F.col("action_type") == "raise"), F.col("player_id"))).alias("num_raisers_preflop"),
        F.count_distinct(F.when(F.col("street") == "flop", F.col("player_id"))).alias("num_saw_flop"),
    )
    return hands.select("hand_id", F.col("num_players").alias("num_players_hand"), "pot_size", (F.col("pot_size") / (ASSUMED_STACK + EPS)).alias("pot_to_stack_ratio")).join(per, "hand_id", "left")


def player_hand_features(hands: DataFrame, actions: DataFrame, players: DataFrame, big_blind: float = 2.0) -> DataFrame:
    """One row for each player of a hand. Who did not act on a street has 0 there. Three exchanges by hand or (hand, player)."""
    return with_hand_features(players.join(street_features(actions), ["hand_id", "player_id"], "left").join(hand_features(hands, actions), "hand_id", "left"), big_blind)


def with_hand_features(wide: DataFrame, big_blind: float = 2.0) -> DataFrame:
    """The rest of player_hand_features(), of rows that have the player's, the streets' and the hand's columns."""
    numbers = [c for c, t in wide.dtypes if t in ("double", "int", "bigint") and c not in ("hand_id", "player_id")]
    wide = wide.fillna(0, subset=numbers)
    seat = F.coalesce(F.create_map(*[F.lit(x) for p in SEAT_INDEX.items() for x in p])[F.col("position")], F.lit(0))
    raises = sum((F.col(f"{s}_bets") + F.col(f"{s}_raises") for s in STREETS), F.lit(0.0))
    calls = sum((F.col(f"{s}_calls") + F.col(f"{s}_checks") for s in STREETS), F.lit(0.0))
    return wide.withColumns({
        **hole_features(F.col("hole_cards")), "position_idx": seat.cast("int"), "stack_bb": F.col("stack_start") / big_blind,
        "is_blind": F.col("position").isin("SB", "BB").cast("int"), "is_late": F.col("position").isin("BTN", "CO").cast("int"),
        "total_invest_ratio": F.col("total_invested") / (F.col("stack_start") + EPS), "total_aggression": raises / (calls + EPS),
    })


def flagged(features: DataFrame) -> DataFrame:
    """The features with flags, score and the triggered rules of each player-hand; with fewer than three players nothing is triggered."""
    eligible = F.col("num_players_hand") >= 3
    post = sum((F.col(f"{s}_bets") + F.col(f"{s}_raises") for s in STREETS[1:]), F.lit(0.0)) / (sum((F.col(f"{s}_calls") + F.col(f"{s}_checks") for s in STREETS[1:]), F.lit(0.0)) + EPS)
    fold = F.col("first_fold_street")
    flags = {
        "PRE_MW": (F.col("num_raisers_preflop") >= 2) & (F.col("num_saw_flop") >= 3),
        "PRE_OFOLD_COMMIT": (F.col("preflop_invested") >= 50) & (fold == "preflop"),
        "POST_OFOLD_COMMIT": (F.col("total_invested") >= 50) & (F.col("saw_flop") == 1) & fold.isin(*STREETS[1:]),
        "HIGH_INVEST_FOLD": (F.col("total_invested") >= 30) & fold.isNotNull(),
        "POSITION_ANOMALY": (F.col("is_late") == 1) & (F.col("preflop_aggression") < 0.5) & (post > 1.5),
    }
    on = {k: F.coalesce(eligible & v, F.lit(False)) for k, v in flags.items()}
    score = sum((F.when(v, RULE_WEIGHTS[k]).otherwise(0) for k, v in on.items()), F.lit(0))
    triggered = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in on.items()]), lambda x: x.isNotNull())
    return features.withColumns({k.lower(): v for k, v in on.items()} | {"rule_score": score.cast("long"), "triggered": triggered})


def rule_flags(features: DataFrame) -> DataFrame:
    """Of flagged() the flags, score and triggered rules alone."""
    return flagged(features).select("hand_id", "player_id", *[k.lower() for k in RULES], "rule_score", "triggered")
