"""Queries over derived contexts, labels and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions import scalars
from tideglass.operators import datasets, nearest, splits
from tideglass.plans.registry import query
from tideglass.sources import files
from tideglass.sources import testbed as T


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """A profile of each customer, at fixed fields: created at the first order's day count, buckets by segment and balance.

    Every 13th customer has none: those are the missing contexts that pair_context has to answer. All orders are in its result.
    """
    c = T.table(spark, d, "customer")
    bank = F.when(F.col("c_acctbal") < 2000, "low").when(F.col("c_acctbal") < 6000, "MEDIUM").when(F.col("c_acctbal") < 9000, "high")
    stake = F.when(F.col("c_custkey") % 5 == 0, "micro").when(F.col("c_custkey") % 5 == 1, "low").when(F.col("c_custkey") % 5 == 2, "medium").otherwise("high")
    created = F.timestamp_add("DAY", (F.col("c_custkey") % 900).cast("int"), F.lit("1992-01-01").cast("timestamp_ntz"))
    return c.where("c_custkey % 13 <> 0").select("c_custkey", created.alias("account_created_at"), (F.col("c_acctbal") / 100).alias("skill_rating"), bank.alias("bankroll_bucket"), stake.alias("preferred_stake_bucket"), F.col("c_nationkey").cast("string").alias("country_bucket"), (F.col("c_custkey") % 20).alias("device_id"), (F.col("c_custkey") % 7).alias("network_id"))


_PROFILES = "WITH prof AS (SELECT c_custkey AS k, TIMESTAMP '1992-01-01' + to_days((c_custkey % 900)::INT) AS created, c_acctbal / 100 AS skill, CASE WHEN c_acctbal < 2000 THEN 0 WHEN c_acctbal < 6000 THEN 1 WHEN c_acctbal < 9000 THEN 2 ELSE 0 END AS bank, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS stake, c_nationkey AS country FROM customer WHERE c_custkey % 13 <> 0)"


@query(
    "pair_context",
    _PROFILES
    + """ SELECT o_orderkey AS hand_id, a.k IS NULL AS context_missing_a, b.k IS NULL AS context_missing_b, round(abs(coalesce(a.skill, 0) - coalesce(b.skill, 0)), 6) AS skill_distance,
  round(coalesce(greatest(epoch(o_orderdate) - epoch(a.created), 0) / 86400, 0), 6) AS age_days_a, round(coalesce(greatest(epoch(o_orderdate) - epoch(b.created), 0) / 86400, 0), 6) AS age_days_b,
  coalesce(a.k % 20 = b.k % 20, false) AS same_device, coalesce(a.k % 7 = b.k % 7, false) AS same_network, coalesce(a.country = b.country, false) AS same_country, abs(coalesce(a.bank, 0) - coalesce(b.bank, 0))::BIGINT AS bankroll_distance, abs(coalesce(a.stake, 0) - coalesce(b.stake, 0))::BIGINT AS stake_distance
FROM orders LEFT JOIN prof a ON a.k = o_custkey LEFT JOIN prof b ON b.k = o_custkey + 1""",
)
def _pair_context(spark: SparkSession, d: str) -> DataFrame:
    p = _profiles(spark, d)
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("hand_id"), F.col("o_orderdate").alias("played_at"), F.col("o_custkey").alias("ka"), (F.col("o_custkey") + 1).alias("kb"))
    for s in "ab":
        o = o.join(p.select(F.col("c_custkey").alias(f"k_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in p.columns[1:]]), F.col(f"k{s}") == F.col(f"k_{s}"), "left")
    out = datasets.pair_context(o)
    return out.select("hand_id", "context_missing_a", "context_missing_b", F.round("skill_distance", 6).alias("skill_distance"), F.round("age_days_a", 6).alias("age_days_a"), F.round("age_days_b", 6).alias("age_days_b"), "same_device", "same_network", "same_country", F.col("bankroll_distance").cast("long").alias("bankroll_distance"), F.col("stake_distance").cast("long").alias("stake_distance"))


@query("preprocessed", "WITH m AS (SELECT quantile_cont(value, 0.5) AS med FROM events WHERE event_id % 10 < 7 AND value < 150) SELECT event_id, round(CASE WHEN value < 150 THEN value ELSE med END, 6) AS value, " + ", ".join(f"(event_type = '{k}')::INT::DOUBLE AS is_{k}" for k in ("click", "error", "purchase", "view")) + ", (event_type NOT IN ('click', 'error', 'purchase', 'view'))::INT::DOUBLE AS is_other FROM events, m")
def _preprocessed(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").withColumn("value", F.when(F.col("value") < 150, F.col("value")))
    p = datasets.Preprocessor(e.where("event_id % 10 < 7 and event_type <> 'signup'").select("value", "event_type"), [], ["event_type"])
    p.median = datasets.Preprocessor(e.where("event_id % 10 < 7"), ["value"], []).median
    t = p.transform(e, ["event_id"])
    return t.select("event_id", F.round("value", 6).alias("value"), *[F.col(f"`event_type={k}`").alias(f"is_{k}") for k in ("click", "error", "purchase", "view")], F.col("`event_type=<other>`").alias("is_other"))


@query("evidence_lineage", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority AS model_run FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'")
def _lineage(spark: SparkSession, d: str) -> DataFrame:
    runs = T.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("model_run"))
    return datasets.with_lineage(T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), runs, ["l_orderkey"])


@query("alert_review", "SELECT o_orderkey AS alert_id, o_custkey::VARCHAR AS decision_id, (o_orderkey % 100)::VARCHAR AS score_id, c_mktsegment AS outcome, round((o_orderkey % 100) / 100, 6) AS score, CASE WHEN o_orderkey % 100 < 50 THEN 2 END::BIGINT AS pairs FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def _alert_review(spark: SparkSession, d: str) -> DataFrame:
    """All orders are alerts; customers with an odd key have no decision, so that half of the alerts are still to be decided."""
    js = lambda **k: F.to_json(F.struct(*[v.alias(n) for n, v in k.items()])).alias("payload")
    alerts = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("alert_id"), js(decision_id=F.col("o_custkey").cast("string"), score_id=(F.col("o_orderkey") % 100).cast("string")))
    decisions = T.table(spark, d, "customer").where("c_custkey % 2 = 0").select(js(id=F.col("c_custkey").cast("string"), outcome=F.col("c_mktsegment")))
    scores = spark.range(100).select(js(id=F.col("id").cast("string"), score=F.col("id") / 100, pairs=F.when(F.col("id") < 50, F.array(F.lit("1:2"), F.lit("1:3")))))
    out = datasets.alert_review(alerts, decisions, scores)
    return out.select("alert_id", "decision_id", "score_id", "outcome", F.round("score", 6).alias("score"), F.when(F.col("pairs") >= 0, F.col("pairs").cast("long")).alias("pairs"))


@query("label_independence", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'synthetic' WHEN 'O' THEN 'rule_derived' ELSE 'analyst' END AS provenance, o_orderstatus <> 'O' AS independent FROM orders")
def _independence(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("o_orderstatus") == "F", "synthetic").when(F.col("o_orderstatus") == "O", "rule_derived").otherwise("analyst")
    return datasets.independent_labels(T.table(spark, d, "orders").select("o_orderkey", p.alias("provenance")))


@query("feedback_labels", "SELECT event_id, (event_type = 'purchase')::INT AS label FROM events WHERE event_type IN ('purchase', 'error')")
def _feedback(spark: SparkSession, d: str) -> DataFrame:
    f = F.when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "error", "dismissed").otherwise("inconclusive")
    return datasets.feedback_labels(T.table(spark, d, "events").select("event_id", f.alias("disposition"))).select("event_id", "label")


@query("scenario_sets", "SELECT l_orderkey AS hand_id, CASE WHEN bool_or(l_returnflag = 'R' AND l_suppkey % 3 = 1) THEN 'positive' WHEN bool_or(l_returnflag = 'R') THEN 'other' ELSE 'normal' END AS kind FROM lineitem GROUP BY 1")
def _scenarios(spark: SparkSession, d: str) -> DataFrame:
    family = scalars.scenario_family(F.concat(F.lit("pair-"), F.col("l_suppkey").cast("string")), ["ring", "soft", "dump"])
    rows = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hand_id"), (F.col("l_returnflag") == "R").cast("int").alias("label"), family.alias("family"))
    return datasets.scenario_sets(rows, "soft")


_ASSIGNED = "WITH o AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), a AS (SELECT *, CASE WHEN i < floor(n * 0.70) THEN 'train' WHEN i < floor(n * 0.70) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM o)"


@query("dataset_gates", _ASSIGNED + " SELECT 'player_in_one_split' AS rule, o_custkey::VARCHAR AS subject FROM a JOIN orders USING (o_orderkey) GROUP BY 2 HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'train_before_validation', strftime(t, '%Y-%m-%d %H:%M:%S') FROM (SELECT max(o_orderdate) FILTER (split = 'train') AS t, min(o_orderdate) FILTER (split = 'validation') AS v FROM a) WHERE t >= v")
def _gates(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("hand_id"), F.col("o_orderdate").alias("played_at"), F.col("o_custkey").alias("player_id"))
    return datasets.gates(splits.temporal_split(o))


@query("expected_firings", "SELECT n_nationkey AS case_id, 'R' AS rule_id, count(hit)::BIGINT AS firings, count(DISTINCT CASE WHEN hit = 1 THEN h END) AS fired_hands, count(DISTINCT CASE WHEN hit = 1 THEN h END) >= 2 AS met FROM (SELECT n_nationkey, unnest(range(n_nationkey * 4, n_nationkey * 4 + 4)) AS h FROM nation) LEFT JOIN (SELECT l_orderkey, 1 AS hit FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = h GROUP BY 1")
def _expected(spark: SparkSession, d: str) -> DataFrame:
    """Each nation is a case that expects firings in four hands of its own; all line items are the evidence."""
    k = F.col("n_nationkey").cast("long")
    e = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("case_id"), F.lit("R").alias("rule_id"), F.sequence(k * 4, k * 4 + 3).alias("hands"), F.lit(2).alias("at_least"))
    ev = T.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_returnflag").alias("rule_id"), F.col("l_orderkey").alias("hand_id"))
    return datasets.expected_firings(e, ev).select("case_id", "rule_id", "firings", "fired_hands", "met")


@query("restored", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 1 THEN 'NEWER' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _restored(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two remainders are lost or broken and come back; rows of another are newer than the snapshot and stay."""
    c = T.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    now = c.where("c_custkey % 9 <> 4").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 == 5, "BROKEN").when(F.col("c_custkey") % 9 == 1, "NEWER").otherwise(F.col("c_mktsegment")))
    return datasets.restored(now, c, c.where("c_custkey % 9 in (4, 5)"), "c_custkey")


_NEAR = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("pattern_scores", f"WITH s AS (SELECT a.vec_id AS pair_id, coalesce(max(CASE WHEN b.label < 3 THEN round({_NEAR}, 6) END), 0) AS c, coalesce(max(CASE WHEN b.label >= 3 THEN round({_NEAR}, 6) END), 0) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1) SELECT pair_id, round(least(greatest(greatest(c - n, c * 0.5), 0), 1), 5) AS pattern_score FROM s")
def _pattern(spark: SparkSession, d: str) -> DataFrame:
    group = F.when(F.col("label") < 3, 0).when(F.col("label") >= 3, 1)
    near = nearest.best_cosines(T.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), group.alias("group")), ["c", "n"])
    out = datasets.pattern_scores(near.select(F.col("id").alias("pair_id"), *[scalars.rounded(F.col(x), 6).alias(x) for x in "cn"]))
    return out.select("pair_id", scalars.rounded(F.col("pattern_score"), 5).alias("pattern_score"))


@query("metrics_page", "SELECT 'rule_firings{rule=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def _metrics_page(spark: SparkSession, d: str) -> DataFrame:
    g = T.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(scalars.metric_line("rule_firings", {"rule": F.col("event_type")}, F.col("n")).alias("line"))


@query("event_ids", "SELECT event_id, sha256(event_type || ':' || user_id) AS sha FROM events")
def _ids(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", F.sha2(F.concat_ws(":", "event_type", "user_id"), 256).alias("sha"))


@query("ordered_hashes", "SELECT user_id, sha256(string_agg(event_id::VARCHAR, chr(10) ORDER BY ts)) AS sha FROM events GROUP BY 1")
def _ordered(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").groupBy("user_id").agg(files.ordered_hash(F.col("ts"), F.col("event_id")).alias("sha"))
