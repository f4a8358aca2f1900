"""Context features of pairs, preprocessing, labels, gates of datasets, lineage views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.operators.quantiles import of_columns
from tideglass.functions.scalars import BANKROLL, STAKES, age_days, filled, one_hot, ordinal


def pair_context(pairs: DataFrame) -> DataFrame:
    """Features of two contexts at the time of a hand. Missing contexts count as 0 and false, with a flag.

    pairs: played_at and, for a and b, account_created_at, skill_rating, bankroll_bucket, preferred_stake_bucket, country_bucket, device_id, network_id, each with _a and _b.
    """
    skill = {s: F.coalesce(F.col(f"skill_rating_{s}"), F.lit(0.0)) for s in "ab"}
    age = {s: age_days(F.col("played_at"), F.col(f"account_created_at_{s}")) for s in "ab"}
    same = lambda c: F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False))
    bank = {s: ordinal(F.col(f"bankroll_bucket_{s}"), BANKROLL) for s in "ab"}
    stake = {s: ordinal(F.col(f"preferred_stake_bucket_{s}"), STAKES) for s in "ab"}
    return pairs.withColumns({
        "context_missing_a": F.col("account_created_at_a").isNull(), "context_missing_b": F.col("account_created_at_b").isNull(), "skill_a": skill["a"], "skill_b": skill["b"], "skill_distance": F.bround(F.abs(skill["a"] - skill["b"]), 9),
        "age_days_a": age["a"], "age_days_b": age["b"], "same_device": same("device_id"), "same_network": same("network_id"), "same_country": same("country_bucket"),
        "bankroll_distance": F.abs(bank["a"] - bank["b"]), "stake_distance": F.abs(stake["a"] - stake["b"]),
    })


class Preprocessor:
    """Medians and categories of a training table, and their use on others. What reaches the driver is a number a column and the categories."""

    def __init__(self, train: DataFrame, numeric: list[str], categorical: list[str]) -> None:
        finite = {c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf")), F.col(c).cast("double")) for c in numeric}
        kinds = [F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in categorical]
        middle = of_columns(train, finite, [0.5]) if numeric else {}
        self.median = {c: middle[c][0] if middle[c][0] is not None else 0.0 for c in numeric}
        row = train.agg(*kinds).first() if categorical else {}
        self.known = {c: list(row[c]) for c in categorical}

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*keep, *[filled(F.col(c), m).alias(c) for c, m in self.median.items()], *[x for c, k in self.known.items() for x in one_hot(F.col(c).cast("string"), k, c)])


def independent_labels(labels: DataFrame, allowed: tuple[str, ...] = ("synthetic", "analyst"), circular: tuple[str, ...] = ("rule_derived",), provenance: str = "provenance") -> DataFrame:
    """Add independent: true for allowed provenances, false for circular ones; any other one is an error."""
    p = F.col(provenance)
    return labels.withColumn("independent", F.when(p.isin(*allowed), True).when(p.isin(*circular), False).otherwise(F.raise_error(F.concat(F.lit("unknown provenance "), F.coalesce(p, F.lit("null")))).cast("boolean")))


def feedback_labels(feedback: DataFrame) -> DataFrame:
    """Training labels of analysts' decisions; inconclusive ones give none."""
    label = F.when(F.col("disposition") == "confirmed", 1).when(F.col("disposition") == "dismissed", 0)
    return feedback.withColumn("label", label).where("label is not null")


def scenario_sets(rows: DataFrame, family: str, hand: str = "hand_id") -> DataFrame:
    """Each hand as positive (a positive row of the family), other (positive rows of other families only) or normal."""
    positive = F.col("label") == 1
    g = rows.groupBy(hand).agg(F.bool_or(positive & (F.col("family") == family)).alias("own"), F.bool_or(positive).alias("any"))
    return g.select(hand, F.when(F.col("own"), "positive").when(F.col("any"), "other").otherwise("normal").alias("kind"))


def gates(rows: DataFrame, hand: str = "hand_id", time: str = "played_at", player: str = "player_id") -> DataFrame:
    """Broken rules of a split dataset as rows (rule, subject): a hand in two splits, a player in two, train not before validation. None if all hold."""
    two = lambda key, rule: rows.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("subject"))
    ends = rows.agg(F.max(F.when(F.col("split") == "train", F.col(time))).alias("train"), F.min(F.when(F.col("split") == "validation", F.col(time))).alias("validation"))
    late = ends.where("train >= validation").select(F.lit("train_before_validation").alias("rule"), F.col("train").cast("string").alias("subject"))
    return two(hand, "hand_in_one_split").unionAll(two(player, "player_in_one_split")).unionAll(late)


def private_columns(df: DataFrame, names: tuple[str, ...] = ("is_collusive", "collusion_pair_id", "label_available_at", "target")) -> DataFrame:
    """Broken rules of a public table's columns: one row for each name that must not be there, in any case of letters."""
    there = [c for c in df.columns if c.lower() in names]
    return df.sparkSession.createDataFrame([("private_column", c) for c in there], "rule string, subject string")


def disjoint_members(rows: DataFrame, member: str = "player_id") -> DataFrame:
    """Members that are in several splits, as broken rules."""
    return rows.where("split is not null").groupBy(member).agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("member_in_one_split").alias("rule"), F.col(member).cast("string").alias("subject"))


def protected_pairs(rows: DataFrame, pair: str = "pair_key") -> DataFrame:
    """Pairs that are positive in validation or test and occur in train, as broken rules. rows: pair_key, split and positive."""
    g = rows.groupBy(pair).agg(F.bool_or(F.col("positive") & F.col("split").isin("validation", "test")).alias("late"), F.bool_or(F.col("split") == "train").alias("train"))
    return g.where("late and train").select(F.lit("protected_pair_in_train").alias("rule"), F.col(pair).cast("string").alias("subject"))


def one_scope(df: DataFrame, columns: list[str]) -> dict:
    """The one combination of the columns' values that the table has; none or several are an error. Two rows at most reach the driver."""
    found = df.select(*columns).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"the table has {'no' if not found else 'more than one'} scope of {', '.join(columns)}")
    return found[0].asDict()


def quantile_parts(df: DataFrame, column: str, q: float = 0.75) -> DataFrame:
    """Add high: whether the column is at or above its quantile, interpolated. Null is not high."""
    limit = of_columns(df, {"limit": F.col(column)}, [q])["limit"][0]
    return df.withColumn("high", F.coalesce(F.col(column) >= F.lit(limit).cast("double"), F.lit(False)))


def first_pairs(pairs: DataFrame, hands: DataFrame, most: int, order: tuple[str, ...] = ("hand_id", "player_a", "player_b")) -> DataFrame:
    """The first `most` pairs of the hands, in order: a bounded report, limited within tasks."""
    return pairs.join(hands.select("hand_id").distinct(), "hand_id", "left_semi").orderBy(*order).limit(most)


def candidate_pairs(stats: DataFrame, hands: DataFrame, most: int, min_score: float = 0.6, score: str = "pair_memory_score") -> DataFrame:
    """Pairs of one of the hands or with a score of min_score or more, the `most` with the highest scores, ties by hand and pair: a bounded report."""
    in_hands = stats.join(hands.select("hand_id").distinct().withColumn("__in", F.lit(True)), "hand_id", "left")
    some = in_hands.where(F.col("__in") | (F.col(score) >= min_score)).drop("__in")
    return some.orderBy(F.desc(score), "hand_id", "player_a", "player_b").limit(most)


def with_lineage(evidence: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence with the model runs of the scores that refer to it, or nulls."""
    return evidence.join(references, keys, "left")


def alert_review(alerts: DataFrame, decisions: DataFrame, scores: DataFrame) -> DataFrame:
    """Alerts with the decision and the score that their JSON payloads name; what is missing is null."""
    a = alerts.select("alert_id", F.get_json_object("payload", "$.decision_id").alias("decision_id"), F.get_json_object("payload", "$.score_id").alias("score_id"))
    d = decisions.select(F.get_json_object("payload", "$.id").alias("decision_id"), F.get_json_object("payload", "$.outcome").alias("outcome"))
    s = scores.select(F.get_json_object("payload", "$.id").alias("score_id"), F.get_json_object("payload", "$.score").cast("double").alias("score"), F.size(F.from_json(F.get_json_object("payload", "$.pairs"), "array<string>")).alias("pairs"))
    return a.join(d, "decision_id", "left").join(s, "score_id", "left")


def expected_firings(expected: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each expectation (case_id, rule_id, hands as an array, at_least) with how often and in how many of its hands the rule fired, and whether that is enough."""
    e = expected.withColumn("hand_id", F.explode("hands"))
    g = e.join(evidence.select("rule_id", "hand_id", F.lit(1).alias("hit")), ["rule_id", "hand_id"], "left").groupBy("case_id", "rule_id", "at_least").agg(F.count("hit").alias("firings"), F.count_distinct(F.when(F.col("hit") == 1, F.col("hand_id"))).alias("fired_hands"))
    return g.withColumn("met", F.col("fired_hands") >= F.col("at_least"))


def restored(current: DataFrame, snapshot: DataFrame, lost: DataFrame, key: str) -> DataFrame:
    """The table with the rows of the lost keys as a dated snapshot has them; a lost key that the snapshot lacks is an error."""
    back = snapshot.join(lost.select(key).distinct(), key, "left_semi")
    missing = lost.select(key).distinct().join(snapshot, key, "left_anti")
    if not missing.isEmpty():
        raise ValueError("the snapshot lacks keys that are to be restored")
    return current.join(lost.select(key).distinct(), key, "left_anti").unionByName(back)


def pattern_scores(near: DataFrame) -> DataFrame:
    """Score of each pair from its nearest neighbours: clip(max(c - n, c / 2), 0, 1), c and n the best cosines of the colluding and the normal set, 0 where null.

    near: pair_id, c and n, as best_cosines gives them.
    """
    j = near.fillna(0.0, subset=["c", "n"])
    return j.withColumn("pattern_score", F.least(F.greatest(F.greatest(F.col("c") - F.col("n"), F.col("c") * 0.5), F.lit(0.0)), F.lit(1.0)))
