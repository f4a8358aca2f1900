"""Queries over scopes, pages, drift, folds, alerts with their parts, and encoded sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions.scalars import identifier
from tideglass.operators import features, graph, history, metrics, rules, splits
from tideglass.plans.hand_queries import CURRENT, FLAGS, folds, player_hands
from tideglass.plans.registry import query
from tideglass.sources import files, loads
from tideglass.sources import testbed as T

BED = T.SQL


def _psi(c: str) -> str:
    share = lambda t: f"SELECT b.b, greatest(coalesce(n, 0) / (SELECT count(*) FROM {t}), 1e-6) AS p FROM {c}_b b LEFT JOIN (SELECT len(list_filter(q, lambda z: z <= {c})) AS b, count(*) AS n FROM {t}, {c}_q GROUP BY 1) USING (b)"
    return f"""{c}_q AS (SELECT list_sort(list_distinct(quantile_cont({c}::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS q FROM old), {c}_b AS (SELECT unnest(range(0, len(q) + 1)) AS b FROM {c}_q),
{c}_e AS ({share("old")}), {c}_a AS ({share("new")}), {c}_v AS (SELECT '{c}' AS feature, 'psi' AS kind, sum((a - e) * ln(a / e)) AS value FROM (SELECT x.p / (SELECT sum(p) FROM {c}_e) AS e, y.p / (SELECT sum(p) FROM {c}_a) AS a FROM {c}_e x JOIN {c}_a y USING (b)))"""


_DRIFT = f"""WITH o AS (SELECT o_totalprice, o_custkey % 100 + CASE WHEN o_orderkey % 2 = 1 THEN 15 ELSE 0 END AS shifted, CASE WHEN o_orderkey % 2 = 1 AND o_custkey % 3 = 0 THEN 'NEW' ELSE o_orderpriority END AS kind, o_orderkey % 2 AS half FROM orders),
old AS (SELECT * FROM o WHERE half = 0), new AS (SELECT * FROM o WHERE half = 1), {_psi("o_totalprice")}, {_psi("shifted")},
t AS (SELECT 'kind' AS feature, 'tvd' AS kind, 0.5 * sum(abs(coalesce(x.p, 0) - coalesce(y.p, 0))) AS value FROM (SELECT kind, count(*) / (SELECT count(*) FROM old) AS p FROM old GROUP BY 1) x FULL JOIN (SELECT kind, count(*) / (SELECT count(*) FROM new) AS p FROM new GROUP BY 1) y USING (kind)),
v AS (SELECT * FROM o_totalprice_v UNION ALL SELECT * FROM shifted_v UNION ALL SELECT * FROM t), w AS (SELECT * FROM v UNION ALL SELECT '*', 'worst', max(value) FROM v)
SELECT feature, kind, round(value, 6) AS value, CASE WHEN value >= 0.25 THEN 'critical' WHEN value >= 0.10 THEN 'warning' ELSE 'ok' END AS status FROM w"""


@query("drift_report", _DRIFT)
def _drift(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("o_orderkey") % 2 == 1
    o = T.table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 100 + F.when(odd, 15).otherwise(0)).alias("shifted"), F.when(odd & (F.col("o_custkey") % 3 == 0), "NEW").otherwise(F.col("o_orderpriority")).alias("kind"))
    return metrics.drift_report(o.where(~odd), o.where(odd), ["o_totalprice", "shifted"], ["kind"]).withColumn("value", F.round("value", 6))


@query(
    "fold_rule_peers",
    CURRENT
    + """, w AS (SELECT hand_id, pair_key, count(*) OVER w AS n, sum(afbw::INT) OVER w AS a, sum(bfaw::INT) OVER w AS b FROM cur WINDOW w AS (PARTITION BY pair_key ORDER BY played_at RANGE BETWEEN INTERVAL 8760 HOUR PRECEDING AND CURRENT ROW))
SELECT hand_id, pair_key, n AS window_n, greatest(a, b)::BIGINT AS fold_count, CASE WHEN a >= b THEN 'a' ELSE 'b' END AS direction, round_even(greatest(a, b) / n, 9) AS fold_rate, n >= 5 AND greatest(a, b) >= 3 AND round_even(greatest(a, b) / n, 9) >= 0.6 AS fired FROM w""",
)
def _fold_peers(spark: SparkSession, d: str) -> DataFrame:
    return folds(spark, d, "all").select("hand_id", "pair_key", "window_n", "fold_count", "direction", "fold_rate", "fired")


@query(
    "alerts_emitted",
    FLAGS
    + """, s AS (SELECT hand_id, player_id, CASE WHEN ok THEN 20 * f1::INT + 30 * f2::INT + 35 * f3::INT + 25 * f4::INT + 10 * f5::INT ELSE 0 END AS score, hand_strength AS m1, least(1, total_aggression) AS m2, least(1, total_invest_ratio) AS m3, saw_river AS m4, is_late AS m5 FROM flags),
e AS (SELECT *, least(greatest(0.12 * score / 120 + 0.23 * m1 + 0.23 * m2 + 0.23 * m3 + 0.09 * m4 + 0.10 * m5, 0), 1) AS r FROM s)
SELECT hand_id, player_id, round(r, 6) AS risk_score, CASE WHEN r >= 0.75 THEN 'HIGH' WHEN r >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, round(m1, 6) AS m1, score::DOUBLE AS rule_score, 'batch' AS source FROM e WHERE r >= 0.4""",
)
def _alerts(spark: SparkSession, d: str) -> DataFrame:
    s = features.flagged(player_hands(spark, d))
    models = {"m1": F.col("hand_strength"), "m2": F.least(F.lit(1.0), "total_aggression"), "m3": F.least(F.lit(1.0), "total_invest_ratio"), "m4": F.col("saw_river"), "m5": F.col("is_late")}
    a = rules.alerts(s, models, F.col("rule_score"), 0.4)
    return a.select("hand_id", "player_id", F.round("risk_score", 6).alias("risk_score"), "risk_level", F.round("model_scores.m1", 6).alias("m1"), "model_scores.rule_score", "model_scores.source")


@query("admin_page", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def _page(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return files.page(o, {"o_orderstatus": ["F", "P"], "o_orderkey": []}, [F.desc("o_totalprice"), F.asc("o_orderkey")], 5000)


@query("scoped_events", "SELECT event_id, CASE WHEN user_id % 5 NOT IN (1, 2, 3) THEN 'tenant' WHEN event_type NOT IN ('purchase', 'view') THEN 'event_type' WHEN event_type = 'view' AND event_id % 4 <> 1 OR event_type = 'purchase' AND event_id % 4 <> 2 THEN 'schema_version' WHEN event_id % 3 = 0 THEN 'dataset' END AS scope FROM events")
def _scoped(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 5).cast("string").alias("tenant_id"), (F.col("event_id") % 4).cast("int").alias("schema_version"), F.when(F.col("event_id") % 3 == 0, "live").otherwise("sim-1").alias("dataset_id"))
    return files.scoped(e, ["1", "2", "3"], {"view": 1, "purchase": 2}).select("event_id", "scope")


@query("scope_counts", "SELECT coalesce(scope, 'accepted') AS scope, event_type, count(*) AS n FROM (SELECT event_type, CASE WHEN user_id % 5 NOT IN (1, 2, 3) THEN 'tenant' WHEN event_type NOT IN ('purchase', 'view') THEN 'event_type' WHEN event_type = 'view' AND event_id % 4 <> 1 OR event_type = 'purchase' AND event_id % 4 <> 2 THEN 'schema_version' WHEN event_id % 3 = 0 THEN 'dataset' END AS scope FROM events) GROUP BY ALL")
def _scope_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _scoped(spark, d).join(T.table(spark, d, "events").select("event_id", "event_type"), "event_id")
    return s.groupBy(F.coalesce("scope", F.lit("accepted")).alias("scope"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_folds", "WITH g AS (SELECT l_orderkey AS hand_id, max((l_returnflag = 'R' AND l_discount >= 0.08)::INT) AS positive FROM lineitem GROUP BY 1) SELECT hand_id, positive, ((row_number() OVER (ORDER BY positive DESC, hand_id * 7919 % 10007, hand_id) - 1) % 5)::INT AS fold FROM g")
def _folds(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hand_id"), ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08)).alias("label"))
    return splits.stratified_folds(rows, "hand_id", "label", 5, F.expr("hand_id * 7919 % 10007").asc())


@query("upsert_latest", "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 2 THEN 'new' ELSE 'old' END AS v, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 2 THEN 1 + c_custkey % 3 ELSE 2 - (c_custkey % 3 <> 2)::INT END AS version FROM customer")
def _upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    c, k = T.table(spark, d, "customer"), F.col("c_custkey")
    old = c.select(k.alias("k"), F.lit("old").alias("v"), (2 - (k % 3 != 2).cast("long")).alias("version"))
    new = c.where("c_custkey % 4 = 0").select(k.alias("k"), F.lit("new").alias("v"), F.when(k % 3 == 2, 1).otherwise(1 + k % 3).cast("long").alias("version"))
    return loads.upsert_latest(old, new, ["k"], "version")


@query("split_actions", BED + ", s AS (SELECT hand_id, CASE WHEN table_id % 3 = 0 THEN 'TRAIN' WHEN table_id % 3 = 1 THEN 'Validation' ELSE 'test' END AS dataset_split FROM hands) SELECT lower(dataset_split) AS split, count(*) AS actions, count(DISTINCT hand_id) AS hands FROM actions JOIN s USING (hand_id) WHERE lower(dataset_split) IN ('train', 'validation') GROUP BY 1")
def _split_actions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("table_id") % 3
    h = T.hands(spark, d).select("hand_id", F.when(t == 0, "TRAIN").when(t == 1, "Validation").otherwise("test").alias("dataset_split"))
    j = T.actions(spark, d).join(h.where(F.lower("dataset_split").isin("train", "validation")), "hand_id")
    return j.groupBy(F.lower("dataset_split").alias("split")).agg(F.count(F.lit(1)).alias("actions"), F.count_distinct("hand_id").alias("hands"))


@query("node_labels", BED + " SELECT player_id, max((won_amount > 50)::INT) AS label FROM players GROUP BY 1")
def _node_labels(spark: SparkSession, d: str) -> DataFrame:
    return T.players(spark, d).groupBy("player_id").agg(F.max((F.col("won_amount") > 50).cast("int")).alias("label"))


@query("scaled_sequences", BED + ", sc AS (SELECT quantile_cont(amount, 0.95) AS s FROM actions JOIN hands USING (hand_id) WHERE table_id < 35 AND amount > 0) SELECT player_id, count(*)::BIGINT AS real_steps, floor(sum(amount::FLOAT / s::FLOAT) * 10 + 0.00314159) / 10 AS scaled_amount FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY hand_id DESC, sequence_no DESC) AS n FROM actions), sc WHERE n <= 60 GROUP BY 1")
def _scaled(spark: SparkSession, d: str) -> DataFrame:
    a = T.actions(spark, d)
    train = a.join(T.hands(spark, d).where("table_id < 35").select("hand_id"), "hand_id", "left_semi")
    s = graph.sequences(a, scale=graph.amount_scale(train))
    real = F.aggregate("mask", F.lit(0).cast("long"), lambda x, y: x + y)
    total = F.aggregate("steps", F.lit(0.0), lambda x, y: x + y[2].cast("double"))
    return s.select("player_id", real.alias("real_steps"), (F.floor(total * 10 + 0.00314159) / 10.0).alias("scaled_amount"))


@query("identifiers", "SELECT c_custkey, regexp_full_match(CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '_') ELSE '9' || c_mktsegment END, '[A-Za-z_][A-Za-z0-9_]*') AS plain FROM customer")
def _identifiers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.col("c_name")).when(k == 1, F.replace("c_name", F.lit("#"), F.lit("_"))).otherwise(F.concat(F.lit("9"), "c_mktsegment"))
    return T.table(spark, d, "customer").select("c_custkey", identifier(name).alias("plain"))
