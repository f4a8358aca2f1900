"""Governed rules, scores, calibration, review policy and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.sources.files import uuid5

#: The namespace of ids of evidence (that of URLs) and what they are made of, in this order.
EVIDENCE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
IDENTITY = ("tenant_id", "product_id", "dataset_id", "dataset_split", "rule_id", "rule_version", "entity_type", "entity_key", "hand_id", "observation_revision", "effective_at", "feature_definition_version")
# The six stateless pair rules as (id, feature, comparison, threshold, multiplier).
PAIR_RULES = (
    ("pair.one-folded-other-won", "one_folded_other_won", "eq", 1.0, 100.0),
    ("pair.same-device", "same_device", "eq", 1.0, 100.0),
    ("pair.same-network", "same_network", "eq", 1.0, 100.0),
    ("pair.outcome-asymmetry", "outcome_asymmetry", "gt", 0.0, 100.0),
    ("pair.a-fold-b-win-rate", "a_fold_b_win_rate", "gt", 0.0, 100.0),
    ("pair.b-fold-a-win-rate", "b_fold_a_win_rate", "gt", 0.0, 100.0),
)
ENSEMBLE_WEIGHTS = {"m1": 0.23, "m2": 0.23, "m3": 0.23, "m4": 0.09, "m5": 0.10, "rule": 0.12}
#: The two published sets of limits, which disagree: (high, medium).
RISK_LIMITS = {"dashboard": (0.80, 0.50), "scorer": (0.75, 0.50)}


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def rules_only_score(coerce: bool = True) -> Column:
    """0.2 fold + 0.2 device + 0.2 network + 0.15 asymmetry + 0.25 the larger directional rate, in 0..1. coerce: nulls count as 0, else an error."""
    def f(name: str) -> Column:
        c = F.col(name).cast("double")
        return F.coalesce(c, F.lit(0.0)) if coerce else F.when(c.between(0, 1), c).otherwise(F.raise_error(F.lit(f"{name} must be in [0, 1]")).cast("double"))

    return clip(0.2 * f("one_folded_other_won") + 0.2 * f("same_device") + 0.2 * f("same_network") + 0.15 * f("outcome_asymmetry") + 0.25 * F.greatest(f("a_fold_b_win_rate"), f("b_fold_a_win_rate")), 0.0, 1.0)


def rule_evidence(pairs: DataFrame, keys: list[str], enabled: list[str] | None = None) -> DataFrame:
    """One row for each enabled rule that a pair fires: the keys, rule_id, rule_version, observed value and raw score. None: all rules."""
    return pairs.select(*keys, F.explode(fired(enabled)).alias("x")).select(*keys, "x.*")


def fired(enabled: list[str] | None = None) -> Column:
    """The enabled rules that a pair fires, as an array of structs: rule_id, rule_version, observed, raw_score."""
    rows = []
    for rule, feature, comparison, limit, times in PAIR_RULES:
        if enabled is None or rule in enabled:
            v = _observed(rule, feature)
            rows.append(F.when(_fires(v, comparison, limit), F.struct(F.lit(rule).alias("rule_id"), F.lit(1).alias("rule_version"), v.alias("observed"), (v * times).alias("raw_score"))))
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def _observed(rule: str, feature: str) -> Column:
    v = F.col(feature).cast("double")
    return F.when(v.between(0, 1), v).otherwise(F.raise_error(F.lit(f"{rule}: {feature} must be in [0, 1]")).cast("double"))


def _fires(v: Column, comparison: str, limit: float) -> Column:
    return (v == limit) if comparison == "eq" else (v > limit)


def fires() -> dict[str, Column]:
    """Of each rule whether a pair fires it, under fires_0, fires_1, …: a few bits of a row, where a table holds many. fired_ids() are the ids again."""
    return {f"fires_{i}": _fires(_observed(rule, feature), comparison, limit) for i, (rule, feature, comparison, limit, _) in enumerate(PAIR_RULES)}


def fired_ids() -> Column:
    return F.filter(F.array(*[F.when(F.col(f"fires_{i}"), F.lit(r[0])) for i, r in enumerate(PAIR_RULES)]), lambda x: x.isNotNull())


def evidence_id(parts: dict[str, Column]) -> Column:
    """The id of a rule's evidence that every system arrives at: a name-based UUID of its twelve parts. The revision is 1 unless given, the time is in UTC. A part that is null makes it null."""
    parts = {"observation_revision": F.lit(1)} | parts
    utc = F.to_utc_timestamp(parts["effective_at"].cast("timestamp"), F.current_timezone())
    parts["effective_at"] = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    joined = [x for name in IDENTITY for x in (F.lit("\x1f"), parts[name].cast("string"))][1:]
    return uuid5(EVIDENCE, F.concat(*joined))


def identified(evidence: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Evidence with rule_event_id; rule_id and rule_version are its own columns."""
    return evidence.withColumn("rule_event_id", evidence_id({"rule_id": F.col("rule_id"), "rule_version": F.col("rule_version")} | parts))


def rollout(rules: DataFrame, enabled: DataFrame) -> DataFrame:
    """Evidence of rules that a rollout table (rule_id, enabled) switches on; rules that it does not name are off."""
    return rules.join(enabled.where("enabled").select("rule_id"), "rule_id", "left_semi")


def calibrate(p: Column, slope: float, intercept: float) -> Column:
    p = clip(p, 1e-6, 1 - 1e-6)
    return 1 / (1 + F.exp(-(slope * F.ln(p / (1 - p)) + intercept)))


def ensemble(rule_score: Column, models: dict[str, Column]) -> Column:
    """Weighted sum of model scores and the rule score over 120, clipped to 0..1."""
    return clip(sum((ENSEMBLE_WEIGHTS[k] * c for k, c in models.items()), ENSEMBLE_WEIGHTS["rule"] * rule_score / 120), 0.0, 1.0)


def alerts(scored: DataFrame, models: dict[str, Column], rule_score: Column, threshold: float, limits: str = "scorer", source: str = "batch") -> DataFrame:
    """hand_id, player_id, risk_score, risk_level, model_scores (a struct of the models, the rules and the whole, with its source) and status of scores at or above the threshold."""
    score = ensemble(rule_score, models)
    parts = F.struct(*[c.cast("double").alias(k) for k, c in models.items()], rule_score.cast("double").alias("rule_score"), score.alias("meta"), F.lit(source).alias("source"))
    out = scored.select("hand_id", "player_id", score.alias("risk_score"), parts.alias("model_scores")).where(F.col("risk_score") >= threshold)
    return out.withColumns({"risk_level": risk_level(F.col("risk_score"), limits), "status": F.lit("pending")})


def risk_level(score: Column, limits: str) -> Column:
    high, medium = RISK_LIMITS[limits]
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def score_hands(pairs: DataFrame, threshold: float, probability: str = "probability", strict: bool = False) -> DataFrame:
    """Per hand: the highest probability, whether it alerts, and the number of pairs. A hand without all of its pairs is left out; with strict it is an error.

    pairs: hand_id, num_players, player_a, player_b, probability.
    """
    return whole_hands(hand_parts(pairs, probability), threshold, strict)


def hand_parts(pairs: DataFrame, probability: str = "probability") -> DataFrame:
    """What score_hands() takes of some of a hand's pairs."""
    return pairs.groupBy("hand_id").agg(F.max(probability).alias("hand_score"), F.count(F.lit(1)).alias("pairs"), F.max("num_players").alias("n"), F.min("num_players").alias("least"))


def whole_hands(parts: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """score_hands() of hand_parts() of all of the pairs."""
    g = parts.groupBy("hand_id").agg(F.max("hand_score").alias("hand_score"), F.sum("pairs").alias("pairs"), F.max("n").alias("n"), F.min("least").alias("least"))
    whole = F.coalesce(F.col("n") == F.col("least"), F.lit(False)) & (F.col("pairs") == F.col("n") * (F.col("n") - 1) / 2)
    if strict:
        whole = F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("pairs are missing in hand "), F.col("hand_id").cast("string"))).cast("boolean"))
    return g.where(whole).select("hand_id", "hand_score", (F.col("hand_score") >= threshold).alias("alert"), "pairs")


def player_scores(pairs: DataFrame, probability: str = "probability") -> DataFrame:
    both = pairs.select("hand_id", F.explode(F.array("player_a", "player_b")).alias("player_id"), F.col(probability).alias("p"))
    return both.groupBy("hand_id", "player_id").agg(F.max("p").alias("player_score"))


def highest_pair(pairs: DataFrame, probability: str = "probability") -> DataFrame:
    """The pair with the highest probability of each hand; the first by key of equal ones."""
    return pairs.groupBy("hand_id").agg(F.max_by(F.struct("player_a", "player_b", F.col(probability).alias("top_score")), F.struct(F.col(probability), -F.col("player_a"), -F.col("player_b"))).alias("x")).select("hand_id", "x.*")


def review(scores: DataFrame, evidence: DataFrame, policy: DataFrame, keys: list[str]) -> DataFrame:
    """Decision of each scored row: mandatory_review with a hard rule, else review_recommended above the threshold, else no_review.

    scores: keys and above (boolean). evidence: keys and rule_id. policy: rule_id and category, hard or soft. A rule without a category is an error.
    """
    category = F.coalesce("category", F.raise_error(F.concat(F.lit("ungoverned rule "), F.col("rule_id"))).cast("string"))
    governed = evidence.join(F.broadcast(policy), "rule_id", "left").withColumn("category", category)  # a policy is a short list
    hard = governed.where("category = 'hard'").groupBy(*keys).agg(F.array_sort(F.collect_set(F.concat(F.lit("hard-rule."), "rule_id", F.lit(".v1")))).alias("hard"))
    return _decided(scores.join(hard, keys, "left"))


def review_rows(scores: DataFrame, policy: DataFrame) -> DataFrame:
    """review() of rows that carry the ids of their own rules, in an array `rules`: no exchange. The array goes."""
    entries = policy.agg(F.map_from_entries(F.collect_set(F.struct("rule_id", "category"))).alias("policy"))  # one row, as long as the list of rules
    category = lambda x: F.coalesce(F.col("policy")[x], F.raise_error(F.concat(F.lit("ungoverned rule "), x)).cast("string"))
    hard = F.array_sort(F.array_distinct(F.transform(F.filter("rules", lambda x: category(x) == "hard"), lambda x: F.concat(F.lit("hard-rule."), x, F.lit(".v1")))))
    return _decided(scores.crossJoin(F.broadcast(entries)).withColumn("hard", F.when(F.size(hard) > 0, hard)).drop("policy", "rules"))


def _decided(out: DataFrame) -> DataFrame:
    reasons = F.concat(F.when(F.col("above"), F.array(F.lit("model-threshold"))).otherwise(F.array().cast("array<string>")), F.coalesce("hard", F.array().cast("array<string>")))
    return out.withColumn("outcome", F.when(F.col("hard").isNotNull(), "mandatory_review").when(F.col("above"), "review_recommended").otherwise("no_review")).withColumn("reasons", F.concat_ws(",", reasons)).drop("hard")
