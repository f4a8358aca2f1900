"""Metrics of rules and rankings, thresholds, bootstrap intervals, drift and monitoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.operators.order import indexed, running
from tideglass.operators.quantiles import of_columns, quantiles
from tideglass.operators.resampling import drawn_sums
from tideglass.sources.files import uuid5
from tideglass.sources.scratch import written


def _div(a: Column, b: Column, empty: float | None) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def rule_counts(rows: DataFrame, by: list[str] = [], label: str = "label", fired: str = "fired", group: str = "hand_id") -> DataFrame:  # noqa: B006
    """Confusion counts, rates and volume per 1000 hands. Precision without a firing is 0; recall without a positive is null."""
    y, f = F.col(label) == 1, F.col(fired)
    c = rows.groupBy(*by).agg(F.count_if(y & f).alias("tp"), F.count_if(~y & f).alias("fp"), F.count_if(y & ~f).alias("fn"), F.count_if(~y & ~f).alias("tn"), F.count_distinct(group).alias("hands"))
    c = c.withColumns({"precision": _div(F.col("tp"), F.col("tp") + F.col("fp"), 0.0), "recall": _div(F.col("tp"), F.col("tp") + F.col("fn"), None), "false_positive_rate": _div(F.col("fp"), F.col("fp") + F.col("tn"), None)})
    return c.withColumns({"fired_rate": _div(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), 0.0), "volume_per_1000": _div(1000 * (F.col("tp") + F.col("fp")), F.col("hands"), 0.0)})


def segments(rows: DataFrame, of: dict[str, Column]) -> DataFrame:
    """Each row once for each segment that it belongs to: segment. One pass, whatever the number of segments."""
    each = F.array(*[F.when(c, F.lit(k)) for k, c in of.items()])
    return rows.withColumn("segment", F.explode(F.filter(each, lambda x: x.isNotNull())))


def _by_score(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Counts of each distinct score with the sums of it and all higher ones, whatever the scores' range. Rows without a score count for nothing."""
    g = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    return running(g, [F.desc("s")], {"cum_pos": F.col("pos"), "cum_n": F.col("n")})


def ranking_metrics(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: PR-AUC by steps, ROC-AUC with half of ties, Brier score, positives and rows. Null where a side is empty."""
    g = _by_score(rows, label, score)
    neg = F.col("n") - F.col("pos")
    cum_neg = F.col("cum_n") - F.col("cum_pos")
    one = g.agg(
        F.sum("pos").alias("p"), F.sum(neg).alias("q"), F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("pr"), F.sum(F.col("pos") * cum_neg).cast("double").alias("a"), F.sum(F.col("pos") * neg).cast("double").alias("h"),
        F.sum(F.col("pos") * (1 - F.col("s")) * (1 - F.col("s")) + neg * F.col("s") * F.col("s")).alias("brier"),
    )
    p, q = F.col("p"), F.col("q")
    # a positive beats the negatives that are not above it, and half of those that tie
    roc = _div(p * q - F.col("a") + F.col("h") / 2, p * q, None)
    return one.select(_div(F.col("pr"), p, None).alias("pr_auc"), roc.alias("roc_auc"), _div(F.col("brier"), p + q, None).alias("brier"), p.alias("positives"), (p + q).alias("rows"))


def threshold_search(rows: DataFrame, max_alert_rate: float = 1.0, label: str = "label", score: str = "score") -> DataFrame:
    """The threshold with the largest (F1, recall, precision, threshold) among those that alert at most this share of rows."""
    g = _by_score(rows, label, score)
    total = rows.agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("total"))
    g = g.crossJoin(F.broadcast(total)).where(F.col("cum_n") <= F.greatest(F.lit(1), F.floor(F.col("total") * max_alert_rate)))  # one row
    precision, recall = F.col("cum_pos") / F.col("cum_n"), _div(F.col("cum_pos"), F.col("p"), 0.0)
    f1 = _div(2 * precision * recall, precision + recall, 0.0)
    best = g.agg(F.max(F.struct(F.round(f1, 12).alias("f1"), F.round(recall, 12).alias("recall"), F.round(precision, 12).alias("precision"), F.col("s").alias("threshold"))).alias("x"))
    return best.select("x.*")


def at_budget(rows: DataFrame, rate: float, label: str = "label", score: str = "score", tie: str = "row_id", hand: str = "hand_id") -> DataFrame:
    """Precision, recall and false positives per 1000 hands of the first max(1, floor(n rate)) rows by score, ties by id."""
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(hand).alias("hands")).first()
    c = precision_at(rows, [max(1, int(whole["n"] * rate))], label, score, tie)
    p = rows.agg(F.sum(F.col(label).cast("long"))).first()[0]
    return c.select("alerts", "tp", F.col("precision").alias("precision_at_budget"), _div(F.col("tp"), F.lit(p), None).alias("recall_at_budget"), ((F.col("alerts") - F.col("tp")) * 1000 / F.lit(whole["hands"])).alias("fp_per_1000"))


def precision_at(rows: DataFrame, places: list[int], label: str = "label", score: str = "score", tie: str = "row_id") -> DataFrame:
    """k, alerts (k, or all rows if there are fewer), tp and precision of the first k rows by score, ties by id, for each k.

    Scores above the k-th row's count as a whole; only rows with that very score are put in order, by ranges of their ids.
    """
    g = written(_by_score(rows, label, score), "scores")
    top = g.agg(F.max("cum_n").alias("n"), F.max("cum_pos").alias("p")).first()
    out = []
    for k in places:
        limit = g.where(F.col("cum_n") >= k).agg(F.max_by(F.struct("s", "pos", "n", "cum_pos", "cum_n"), "s").alias("x")).first()["x"]
        if limit is None:
            out.append((k, top["n"] or 0, top["p"] or 0))
            continue
        above = limit["cum_n"] - limit["n"]
        tied = indexed(rows.where(F.col(score) == F.lit(limit["s"])).select(F.col(label).cast("long").alias("y"), F.col(tie).alias("t")), [F.asc("t")], "place")
        tp = tied.where(F.col("place") < k - above).agg(F.coalesce(F.sum("y"), F.lit(0))).first()[0]
        out.append((k, k, limit["cum_pos"] - limit["pos"] + tp))
    c = rows.sparkSession.createDataFrame(out, "k long, alerts long, tp long")
    return c.withColumn("precision", _div(F.col("tp"), F.col("alerts"), 0.0))


def bootstrap(rows: DataFrame, replicates: int = 200, seed: int = 7, label: str = "label", fired: str = "fired", group: str = "hand_id") -> DataFrame:
    """Percentile intervals of precision and recall when whole hands are drawn: three counters a hand, with weights that are Poisson(1) from an md5 of seed and hand.

    Rows shrink to one a hand first; each task adds its hands up for all replicates at once.
    """
    y, f = F.col(label) == 1, F.col(fired)
    hands = rows.groupBy(group).agg(F.count_if(y & f).alias("tp"), F.count_if(~y & f).alias("fp"), F.count_if(y & ~f).alias("fn"))
    sums = drawn_sums(hands, group, ["tp", "fp", "fn"], replicates, seed)
    m = sums.select(_div(F.col("tp"), F.col("tp") + F.col("fp"), 0.0).alias("precision"), _div(F.col("tp"), F.col("tp") + F.col("fn"), None).alias("recall"))
    ends = F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))
    return m.agg(F.percentile("precision", ends).alias("p"), F.percentile("recall", ends).alias("r")).select(*[F.col(c)[i].alias(f"{n}_{e}") for c, n in (("p", "precision"), ("r", "recall")) for i, e in enumerate(("low", "mid", "high"))])


def seed_summary(results: DataFrame, by: list[str], value: str) -> DataFrame:
    return results.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.max(value) - F.min(value)).alias("range"))


def histogram_edges(reference: DataFrame, column: str, bins: int = 10) -> list[float]:
    """The distinct interior quantiles of the reference; outer bins are open."""
    q = of_columns(reference, {"q": F.col(column)}, [i / bins for i in range(1, bins)])["q"]
    return sorted({x for x in q if x is not None})


def binned(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """bin (0 to len(edges)) and proportion of rows; bins are closed below and open above, bins without a row have 0."""
    bin_ = sum(((F.col(column) >= e).cast("int") for e in edges), F.lit(0))
    counts = df.where(F.col(column).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(counts, "bin", "left").fillna(0, subset=["n"])
    total = filled.agg(F.sum("n").alias("total"))
    return filled.crossJoin(F.broadcast(total)).select("bin", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("proportion"))  # one row


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability index over the reference's deciles: proportions clipped at 1e-6 and renormalised."""
    edges = histogram_edges(reference, column, bins)
    e = binned(reference, column, edges).select("bin", F.greatest("proportion", F.lit(1e-6)).alias("e"))
    a = binned(current, column, edges).select("bin", F.greatest("proportion", F.lit(1e-6)).alias("a"))
    j = e.join(a, "bin")
    total = F.broadcast(j.agg(F.sum("e").alias("te"), F.sum("a").alias("ta")))  # one row
    j = j.crossJoin(total).select((F.col("e") / F.col("te")).alias("e"), (F.col("a") / F.col("ta")).alias("a"))
    return j.agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi"))


def tvd(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Half the sum of differences of the frequencies of categories; null is a category."""
    def share(df: DataFrame, name: str) -> DataFrame:
        c = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("__MISSING__")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("k", (F.col("n") / F.col("t")).alias(name))  # one row

    both = share(reference, "e").join(share(current, "a"), "k", "full")
    return both.agg((0.5 * F.sum(F.abs(F.coalesce("e", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))))).alias("tvd"))


def drift_status(value: Column) -> Column:
    return F.when(value >= 0.25, "critical").when(value >= 0.10, "warning").otherwise("ok")


def drift_report(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str], bins: int = 10) -> DataFrame:
    """feature, kind ("psi" or "tvd"), value and status of each column, and of all: feature "*", kind "worst", the largest value and the worst status.

    Columns become rows first, so the whole report is one aggregation of each table, whatever the number of columns. Values that are null or not finite are left out;
    of categories null is one. Bins are between the reference's distinct quantiles, outer ones open; proportions are clipped at 1e-6 and renormalised.
    """
    def long(df: DataFrame) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in numeric]))
        return df.select(each.alias("x")).select("x.*").where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))

    ends = [i / bins for i in range(1, bins)]
    edges = written(quantiles(long(reference), F.col("v"), ends, ["feature"]).select("feature", F.array_sort(F.array_distinct("q")).alias("edges")), "edges") if numeric else None

    def shares(df: DataFrame, name: str) -> DataFrame:
        binned_ = long(df).join(F.broadcast(edges), "feature").select("feature", F.size(F.filter("edges", lambda e: e <= F.col("v"))).alias("bin"))  # one row a column
        n = binned_.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
        every = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin")).join(n, ["feature", "bin"], "left").fillna(0, subset=["n"])
        total = Window.partitionBy("feature")  # bins of a column
        p = F.greatest(F.when(F.sum("n").over(total) > 0, F.col("n") / F.sum("n").over(total)).otherwise(0.0), F.lit(1e-6))
        return every.select("feature", "bin", p.alias("p")).select("feature", "bin", (F.col("p") / F.sum("p").over(total)).alias(name))

    parts = []
    if numeric:
        j = shares(reference, "e").join(shares(current, "a"), ["feature", "bin"])
        parts.append(j.groupBy("feature").agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("value")).select("feature", F.lit("psi").alias("kind"), "value"))
    for c in categorical:
        parts.append(tvd(reference, current, c).select(F.lit(c).alias("feature"), F.lit("tvd").alias("kind"), F.col("tvd").alias("value")))
    each = written(reduce(DataFrame.unionAll, parts).withColumn("status", drift_status(F.col("value"))), "drift")
    worst = each.agg(F.lit("*").alias("feature"), F.lit("worst").alias("kind"), F.max("value").alias("value"), drift_status(F.max("value")).alias("status"))
    return each.unionAll(worst)


#: Statuses of a monitored rule, the worst first, and the order in which a report takes the worst.
STATUSES = ("critical", "warning", "insufficient_data", "disabled", "ok")
#: The namespace of alert ids and what they are made of, in this order, before the sorted reasons.
MONITORING = "95c9b135-90b4-5e47-a27f-45d3cce9c277"
ALERT = ("tenant_id", "product_id", "window_id", "rule_id", "rule_version", "evaluation_id", "baseline_sha256", "rollout_id", "model_name", "model_run_id")


def rule_monitoring(firings: DataFrame, baseline: DataFrame, *, min_hands: int, min_positives: int, min_firings: int, max_bad_labels: int = 0, rate_abs: float = 0.02, rate_rel: float = 0.5, precision_ratio: float = 0.5, volume_ratio: float = 2.0) -> DataFrame:
    """Each rule of the baseline over a window of labelled rows: observed figures, status, reasons, what it lacks to be judged and, where it is bad, the id of its alert.

    firings: rule_id, rule_version, enabled, pair_rows, labelled_hands, positives, firings, true_positives, of the whole window circular_labels and unknown_labels, and its
    tenant_id, product_id, window_id, rollout_id, model_name and model_run_id. baseline: rule_id, rule_version, base_rate, base_precision, base_volume, evaluation_id,
    baseline_sha256. The band of the rate is base_rate more or less max(rate_abs, rate_rel * base_rate). Circular or unknown labels above max_bad_labels
    make every enabled rule critical. Else a rule that lacks hands, positives or firings is insufficient_data; of the reasons two or more are critical, one is a warning. Rules of the
    baseline without a row in the window have null figures and are insufficient_data. An alert's id is a name-based UUID of what ALERT names and the sorted reasons, so that
    a repeated report repeats it.
    """
    key = ["rule_id", "rule_version"]
    w = baseline.join(firings, key, "left")
    w = w.withColumns({"firing_rate": _div(F.col("firings"), F.col("pair_rows"), 0.0), "precision": _div(F.col("true_positives"), F.col("firings"), 0.0), "recall": _div(F.col("true_positives"), F.col("positives"), None), "volume_per_1000": _div(F.col("firings") * 1000.0, F.col("labelled_hands"), 0.0)})
    band = F.greatest(F.lit(rate_abs), rate_rel * F.col("base_rate"))
    labels = F.array_compact(F.array(*[F.when(F.col(f"{k}_labels") > max_bad_labels, f"{k}_label_rows_above_maximum") for k in ("circular", "unknown")]))
    figures = F.array_compact(F.array(
        F.when(F.col("volume_per_1000") > volume_ratio * F.col("base_volume"), "alert_volume_above_baseline_ratio"), F.when(F.col("firing_rate") > F.col("base_rate") + band, "firing_rate_above_baseline_band"),
        F.when(F.col("firing_rate") < F.greatest(F.lit(0.0), F.col("base_rate") - band), "firing_rate_below_baseline_band"), F.when(F.col("precision") < precision_ratio * F.col("base_precision"), "precision_below_baseline_ratio"),
    ))
    least = (("labeled_hands", "labelled_hands", min_hands), ("positive_labels", "positives", min_positives), ("rule_firings", "firings", min_firings))
    lacks = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c) < m, F.lit(True)), F.concat(F.lit(f"{name}_below_minimum:"), F.coalesce(F.col(c), F.lit(0)).cast("string"), F.lit(f"<{m}"))) for name, c, m in least]))
    off, bad, few = F.coalesce(~F.col("enabled"), F.lit(False)), F.size("__labels") > 0, F.size("__lacks") > 0
    w = w.withColumns({"__labels": labels, "__lacks": lacks, "__figures": figures})
    n = F.size("__figures")
    w = w.withColumn("status", F.when(off, "disabled").when(bad, "critical").when(few, "insufficient_data").when(n >= 2, "critical").when(n == 1, "warning").otherwise("ok"))
    reasons = F.when(off | bad, F.col("__labels")).when(few, F.array().cast("array<string>")).otherwise(F.col("__figures"))
    w = w.withColumns({"reasons": F.concat_ws(",", F.array_sort(reasons)), "lacks": F.concat_ws(",", "__lacks")}).drop("__labels", "__lacks", "__figures")
    name = F.concat(*[x for c in (*ALERT, "reasons") for x in (F.lit("|"), F.col(c).cast("string"))][1:])
    return w.withColumn("alert_id", F.when(F.col("status").isin("warning", "critical"), uuid5(MONITORING, name)))


def overall_status(rules: DataFrame) -> DataFrame:
    """One row: the worst status of the rules, how many have each, and the number of alerts. Without rules it is ok."""
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_rules") for s in STATUSES]
    c = rules.agg(F.count(F.lit(1)).alias("rules"), *counts, F.count("alert_id").alias("alerts"))
    worst = F.lit("ok")
    for s in reversed(STATUSES[:-1]):
        worst = F.when(F.col(f"{s}_rules") > 0, s).otherwise(worst)
    return c.select(worst.alias("status"), "rules", *[f"{s}_rules" for s in STATUSES], "alerts")
