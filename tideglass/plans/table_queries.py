"""Queries over contexts, orders, labels, documents' labels and vectors: joins in time, loads, splits, metrics and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import graph, history, metrics, splits
from tideglass.operators.quantiles import quantiles
from tideglass.operators.resampling import poisson_limits
from tideglass.plans.registry import query
from tideglass.sources import cdc, files, loads
from tideglass.sources import testbed as T

BED = T.SQL

_AS_OF = " SELECT o.event_id, o.user_id, c.context_version AS ctx_context_version, c.device_id AS ctx_device_id, c.network_id AS ctx_network_id, CASE WHEN c.user_id IS NULL THEN 'missing' ELSE 'matched' END AS status FROM observations o ASOF LEFT JOIN contexts c ON o.user_id = c.user_id AND o.observed_at {op} c.effective_at"


def _as_of(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    j = history.as_of(T.observations(spark, d), T.contexts(spark, d), "user_id", "observed_at", "effective_at", ("context_version", "event_id"), strict=strict)
    return j.select("event_id", "user_id", "ctx_context_version", "ctx_device_id", "ctx_network_id", F.when(F.col("ctx_event_id").isNull(), "missing").otherwise("matched").alias("status"))


@query("asof_context", BED + _AS_OF.format(op=">="))
def _asof(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d, False)


@query("asof_context_strict", BED + _AS_OF.format(op=">"))
def _asof_strict(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d, True)


@query("context_scd2", BED + " SELECT user_id, context_version, effective_at, lead(effective_at) OVER w AS effective_to, lead(effective_at) OVER w IS NULL AS is_current FROM contexts WINDOW w AS (PARTITION BY user_id ORDER BY effective_at, context_version, event_id)")
def _scd2(spark: SparkSession, d: str) -> DataFrame:
    return history.scd2(T.contexts(spark, d)).select("user_id", "context_version", "effective_at", "effective_to", "is_current")


@query("context_current", BED + " SELECT user_id, context_version, device_id, network_id FROM contexts QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY context_version DESC) = 1")
def _current(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(T.contexts(spark, d), ["user_id"], [F.desc("context_version")]).select("user_id", "context_version", "device_id", "network_id")


@query("latest_revision", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _latest(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(T.table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("log_minutes_gap", "SELECT event_id, round(coalesce(ln(1 + (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 6e7), 0), 6) AS log_minutes_gap FROM events")
def _gap(spark: SparkSession, d: str) -> DataFrame:
    return history.log_minutes_gap(T.table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", F.round("log_minutes_gap", 6).alias("log_minutes_gap"))


@query("user_running_24h", "SELECT event_id, count(*) OVER w AS events_24h, round(sum(value) OVER w, 4) AS value_24h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)")
def _running(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    w = "(partition by user_id order by ts range between interval 24 hours preceding and current row)"
    return e.select("event_id", F.expr(f"count(*) over {w}").alias("events_24h"), F.round(F.expr(f"sum(value) over {w}"), 4).alias("value_24h"))


_SPLIT = BED + """, o AS (SELECT hand_id, played_at, row_number() OVER (ORDER BY played_at, hand_id) - 1 AS i, count(*) OVER () AS n FROM hands),
sh AS (SELECT *, CASE WHEN greatest(floor(n * 0.70), 1) + greatest(floor(n * 0.15), 1) >= n THEN n - 2 ELSE greatest(floor(n * 0.70), 1) END AS train,
  CASE WHEN greatest(floor(n * 0.70), 1) + greatest(floor(n * 0.15), 1) >= n THEN 1 ELSE greatest(floor(n * 0.15), 1) END AS validation FROM o)"""


@query("temporal_split", _SPLIT + " SELECT hand_id, i::BIGINT AS index, CASE WHEN i < train THEN 'train' WHEN i < train + validation THEN 'validation' ELSE 'test' END AS split FROM sh")
def _temporal(spark: SparkSession, d: str) -> DataFrame:
    return splits.temporal_split(T.hands(spark, d)).select("hand_id", "index", "split")


@query(
    "boundary_split",
    _SPLIT
    + """
SELECT hand_id, i::BIGINT AS index, CASE WHEN i < greatest(floor(n * 0.70), 1) THEN 'train'
  WHEN i < least(n - 1, greatest(greatest(floor(n * 0.70), 1) + 1, floor(n * 0.85))) THEN 'validation' ELSE 'test' END AS split FROM o
""",
)
def _boundaries(spark: SparkSession, d: str) -> DataFrame:
    return splits.boundary_split(T.hands(spark, d)).select("hand_id", "index", "split")


@query("cycle_split", _SPLIT + " SELECT hand_id, CASE WHEN i % 20 < 14 THEN 'train' WHEN i % 20 < 17 THEN 'validation' ELSE 'test' END AS split FROM o")
def _cycle(spark: SparkSession, d: str) -> DataFrame:
    return splits.cycle_split(T.hands(spark, d), "played_at", "hand_id").select("hand_id", "split")


_ASSIGNED = _SPLIT + ", assigned AS (SELECT hand_id, played_at, CASE WHEN i < train THEN 'train' WHEN i < train + validation THEN 'validation' ELSE 'test' END AS split FROM sh)"


@query("split_overlap_audit", _ASSIGNED + " SELECT player_id, count(DISTINCT split) AS splits, string_agg(DISTINCT split, ',' ORDER BY split) AS in_splits FROM players JOIN assigned USING (hand_id) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def _overlap(spark: SparkSession, d: str) -> DataFrame:
    return splits.overlap_audit(splits.temporal_split(T.hands(spark, d)), T.players(spark, d), "hand_id", "player_id")


@query("split_order_audit", _ASSIGNED + ", s AS (SELECT split, min(played_at) AS first, max(played_at) AS last, count(*) AS rows FROM assigned GROUP BY 1) SELECT *, coalesce(first < lag(last) OVER (ORDER BY list_position(['train', 'validation', 'test'], split)), false) AS crosses FROM s")
def _order(spark: SparkSession, d: str) -> DataFrame:
    return splits.order_audit(splits.temporal_split(T.hands(spark, d)))


_EDGES = "WITH RECURSIVE e AS (SELECT c_custkey AS x, (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS y FROM customer), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT x AS node, x AS r FROM b UNION SELECT b.y, r.r FROM r JOIN b ON b.x = r.node)"


@query("relationship_components", _EDGES + " SELECT node, min(r) AS component FROM r GROUP BY 1")
def _components(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    n = c.count()
    return splits.components(c.select(F.col("c_custkey").alias("a"), ((F.col("c_custkey") * 7 + 3) % n).alias("b")))


_RULE = "WITH p AS (SELECT l_orderkey AS hand_id, (l_suppkey % 5 = 0)::INT AS label, l_discount >= 0.05 AS fired, round(l_discount * 10 + l_tax, 6) / 2 AS score, l_returnflag AS flag, l_linestatus AS status FROM lineitem)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hand_id"), (F.col("l_suppkey") % 5 == 0).cast("int").alias("label"), (F.col("l_discount") >= 0.05).alias("fired"), (F.round(F.col("l_discount") * 10 + F.col("l_tax"), 6) / 2).alias("score"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


_COUNTS = "count(*) FILTER (label = 1 AND fired) AS tp, count(*) FILTER (label = 0 AND fired) AS fp, count(*) FILTER (label = 1 AND NOT fired) AS fn, count(*) FILTER (label = 0 AND NOT fired) AS tn, count(DISTINCT hand_id) AS hands"
_RATES = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS false_positive_rate, round((tp + fp) / (tp + fp + fn + tn), 6) AS fired_rate, round(1000 * (tp + fp) / hands, 6) AS volume_per_1000"
_RATE_NAMES = ("precision", "recall", "false_positive_rate", "fired_rate", "volume_per_1000")


@query("rule_point_metrics", _RULE + f" SELECT *, {_RATES} FROM (SELECT {_COUNTS} FROM p)")
def _point(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rule_counts(predictions(spark, d)).withColumns({c: F.round(c, 6) for c in _RATE_NAMES})


@query("segment_metrics", _RULE + f" SELECT *, {_RATES} FROM (SELECT segment, {_COUNTS} FROM (SELECT *, unnest(list_filter(['all', CASE WHEN flag = 'R' THEN 'returned' END, CASE WHEN status = 'O' THEN 'open' END, CASE WHEN score < 0.2 THEN 'low score' END], lambda x: x IS NOT NULL)) AS segment FROM p) GROUP BY 1)")
def _segments(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.segments(predictions(spark, d), {"all": F.lit(True), "returned": F.col("flag") == "R", "open": F.col("status") == "O", "low score": F.col("score") < 0.2})
    return metrics.rule_counts(s, ["segment"]).withColumns({c: F.round(c, 6) for c in _RATE_NAMES})


_RANK = _RULE + """, g AS (SELECT score AS s, sum(label) AS pos, count(*) AS n FROM p GROUP BY 1), c AS (SELECT *, n - pos AS neg, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY s DESC)), t AS (SELECT sum(pos) AS pt, sum(neg) AS nt FROM c)"""


@query("ranking_metrics", _RANK + " SELECT round(sum(pos * cp / cn) / max(pt), 6) AS pr_auc, round(sum(pos * (nt - (cn - cp) + neg / 2)) / max(pt * nt), 6) AS roc_auc, round(sum(pos * (1 - s) * (1 - s) + neg * s * s) / max(pt + nt), 6) AS brier, max(pt)::BIGINT AS positives, max(pt + nt)::BIGINT AS rows FROM c, t")
def _ranking(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ranking_metrics(predictions(spark, d)).withColumns({c: F.round(c, 6) for c in ("pr_auc", "roc_auc", "brier")})


@query("threshold_search", _RANK + " SELECT f1, recall, precision, threshold FROM (SELECT round(2 * (cp / cn) * (cp / pt) / (cp / cn + cp / pt), 12) AS f1, round(cp / pt, 12) AS recall, round(cp / cn, 12) AS precision, s AS threshold FROM c, t WHERE cn <= floor((pt + nt) * 0.3)) ORDER BY f1 DESC, recall DESC, precision DESC, threshold DESC LIMIT 1")
def _threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.threshold_search(predictions(spark, d), 0.3)


@query("alert_budget", "WITH p AS (SELECT event_id AS row_id, user_id AS hand_id, (event_type = 'purchase')::INT AS label, value AS score FROM events), k AS (SELECT greatest(1, floor(count(*) * 0.02)) AS k, sum(label) AS pt, count(DISTINCT hand_id) AS h FROM p), a AS (SELECT * FROM p QUALIFY row_number() OVER (ORDER BY score DESC, row_id) <= (SELECT k FROM k)) SELECT count(*) AS alerts, sum(label)::BIGINT AS tp, round(sum(label) / count(*), 6) AS precision_at_budget, round(sum(label) / max(pt), 6) AS recall_at_budget, round((count(*) - sum(label)) * 1000 / max(h), 6) AS fp_per_1000 FROM a, k")
def _budget(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("hand_id"), (F.col("event_type") == "purchase").cast("int").alias("label"), F.col("value").alias("score"))
    return metrics.at_budget(p, 0.02).withColumns({c: F.round(c, 6) for c in ("precision_at_budget", "recall_at_budget", "fp_per_1000")})


_DRAWS = 200


@query(
    "bootstrap_intervals",
    _RULE
    + f""", h AS (
  SELECT hand_id, count(*) FILTER (label = 1 AND fired) AS tp, count(*) FILTER (label = 0 AND fired) AS fp, count(*) FILTER (label = 1 AND NOT fired) AS fn FROM p GROUP BY 1),
x AS (
  SELECT b * 4 + j AS r, tp, fp, fn, ('0x' || substr(md5('7|' || hand_id || '|' || b), j * 8 + 1, 8))::BIGINT AS x
  FROM h, range(0, {_DRAWS // 4}) AS t(b), range(0, 4) AS u(j)),
w AS (SELECT r, tp, fp, fn, {" + ".join(f"(x >= {limit})::INT" for limit in poisson_limits())} AS w FROM x),
m AS (
  SELECT r, CASE WHEN sum(w * (tp + fp)) > 0 THEN sum(w * tp) / sum(w * (tp + fp)) ELSE 0 END AS p, CASE WHEN sum(w * (tp + fn)) > 0 THEN sum(w * tp) / sum(w * (tp + fn)) END AS q FROM w GROUP BY r)
SELECT {", ".join(f"round(quantile_cont({c}, {e}), 9) AS {n}_{k}" for c, n in (("p", "precision"), ("q", "recall")) for e, k in ((0.025, "low"), (0.5, "mid"), (0.975, "high")))} FROM m""",
)
def _bootstrap(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.bootstrap(predictions(spark, d), _DRAWS)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("seed_summary", "SELECT l_suppkey % 5 AS seed, round(min(l_discount), 6) AS min, round(max(l_discount), 6) AS max, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std, round(max(l_discount) - min(l_discount), 6) AS range FROM lineitem GROUP BY 1")
def _seeds(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.seed_summary(T.table(spark, d, "lineitem").withColumn("seed", F.col("l_suppkey") % 5), ["seed"], "l_discount")
    return s.withColumns({c: F.round(c, 6) for c in ("min", "max", "mean", "std", "range")})


_DRIFT = "WITH r AS (SELECT value FROM events WHERE ts < (SELECT min(ts) + INTERVAL 15 DAY FROM events)), c AS (SELECT value FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 15 DAY FROM events)), edges AS (SELECT list_sort(list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e FROM r), bins AS (SELECT unnest(range(0, len(e) + 1)) AS bin FROM edges), rb AS (SELECT len(list_filter(e, lambda x: x <= value)) AS bin, count(*) AS n FROM r, edges GROUP BY 1), cb AS (SELECT len(list_filter(e, lambda x: x <= value)) AS bin, count(*) AS n FROM c, edges GROUP BY 1), s AS (SELECT bin, coalesce(rb.n, 0) / (SELECT count(*) FROM r) AS ep, coalesce(cb.n, 0) / (SELECT count(*) FROM c) AS ap FROM bins LEFT JOIN rb USING (bin) LEFT JOIN cb USING (bin))"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = T.table(spark, d, "events")
    cut = e.agg(F.min("ts") + F.expr("INTERVAL 15 DAYS")).first()[0]
    return e.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz")), e.where(F.col("ts") >= F.lit(cut).cast("timestamp_ntz"))


@query("psi", _DRIFT + ", k AS (SELECT greatest(ep, 1e-6) / sum(greatest(ep, 1e-6)) OVER () AS e, greatest(ap, 1e-6) / sum(greatest(ap, 1e-6)) OVER () AS a FROM s) SELECT round(sum((a - e) * ln(a / e)), 6) AS psi, CASE WHEN sum((a - e) * ln(a / e)) >= 0.25 THEN 'critical' WHEN sum((a - e) * ln(a / e)) >= 0.1 THEN 'warning' ELSE 'ok' END AS status FROM k")
def _psi(spark: SparkSession, d: str) -> DataFrame:
    r, c = _halves(spark, d)
    return metrics.psi(r, c, "value").select(F.round("psi", 6).alias("psi"), metrics.drift_status(F.col("psi")).alias("status"))


@query("histogram_bins", _DRIFT + " SELECT bin::INT AS bin, round(ap, 6) AS proportion FROM s")
def _histogram(spark: SparkSession, d: str) -> DataFrame:
    r, c = _halves(spark, d)
    return metrics.binned(c, "value", metrics.histogram_edges(r, "value")).withColumn("proportion", F.round("proportion", 6))


@query("tvd", "WITH r AS (SELECT event_type AS k, count(*) / sum(count(*)) OVER () AS p FROM events WHERE ts < (SELECT min(ts) + INTERVAL 15 DAY FROM events) GROUP BY 1), c AS (SELECT event_type AS k, count(*) / sum(count(*)) OVER () AS p FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 15 DAY FROM events) GROUP BY 1) SELECT round(0.5 * sum(abs(coalesce(r.p, 0) - coalesce(c.p, 0))), 6) AS tvd FROM r FULL JOIN c USING (k)")
def _tvd(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tvd(*_halves(spark, d), "event_type").withColumn("tvd", F.round("tvd", 6))


@query("vector_topk", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0) SELECT query_id, vec_id AS found_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) DESC, vec_id) AS place FROM q JOIN embeddings ON vec_id <> query_id QUALIFY place <= 10")
def _topk(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "embeddings").select("vec_id", "embedding")
    return graph.cosine_top_k(e, e.where("vec_id % 50 = 0"), 10)


@query("kpi_counts", "SELECT (SELECT count(*) FROM orders) AS hands, (SELECT count(*) FROM lineitem) AS actions, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS players, (SELECT count(*) FROM events WHERE event_type = 'error') AS alerts")
def _kpi(spark: SparkSession, d: str) -> DataFrame:
    one = T.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("hands"))
    lines = T.table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("actions"), F.count_distinct("l_suppkey").alias("players"))
    return one.crossJoin(lines).crossJoin(T.table(spark, d, "events").where("event_type = 'error'").agg(F.count(F.lit(1)).alias("alerts")))  # rows of totals


@query("topic_progress", "SELECT event_type AS topic, user_id % 4 AS partition, max(event_id) AS last_offset, max(event_id) + 1 AS required_offset, count(*) AS records, max(ts) AS last_at FROM events GROUP BY 1, 2")
def _progress(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").groupBy(F.col("event_type").alias("topic"), (F.col("user_id") % 4).alias("partition"))
    return e.agg(F.max("event_id").alias("last_offset"), (F.max("event_id") + 1).alias("required_offset"), F.count(F.lit(1)).alias("records"), F.max("ts").alias("last_at"))


@query("source_vs_routed", "SELECT c_nationkey AS nation, count(*) AS source_rows, count(s_nationkey) AS routed_rows, bool_or(s_nationkey IS NOT NULL) AS eligible FROM customer LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000) ON s_nationkey = c_nationkey GROUP BY 1")
def _routed(spark: SparkSession, d: str) -> DataFrame:
    s = T.table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey").distinct()
    j = T.table(spark, d, "customer").join(s, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    return j.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("source_rows"), F.count("s_nationkey").alias("routed_rows"), F.bool_or(F.col("s_nationkey").isNotNull()).alias("eligible"))


@query("alerts_filtered", "SELECT event_id, user_id, value, CASE WHEN value >= 0.8 THEN 'HIGH' WHEN value >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM events WHERE event_type IN ('error', 'click') ORDER BY value DESC, event_id LIMIT 100")
def _alerts(spark: SparkSession, d: str) -> DataFrame:
    from tideglass.operators.rules import risk_level

    e = files.in_list(T.table(spark, d, "events"), "event_type", ["error", "click"])
    return e.orderBy(F.desc("value"), "event_id").limit(100).select("event_id", "user_id", "value", risk_level(F.col("value"), "dashboard").alias("level"))


@query("training_examples", "WITH f AS (SELECT l_orderkey AS hand_id, l_suppkey AS player_id, max(l_shipdate) AS played_at, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2), y AS (SELECT o_orderkey AS hand_id, o_orderdate AS available_at, o_orderstatus = 'F' AS label FROM orders) SELECT hand_id, player_id, round(qty, 4) AS qty, label FROM f JOIN y USING (hand_id) WHERE available_at + INTERVAL 60 DAY >= played_at")
def _training(spark: SparkSession, d: str) -> DataFrame:
    f = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("hand_id"), F.col("l_suppkey").alias("player_id")).agg(F.max("l_shipdate").alias("played_at"), F.sum("l_quantity").alias("qty"))
    y = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("hand_id"), F.col("o_orderdate").alias("available_at"), (F.col("o_orderstatus") == "F").alias("label"))
    return f.join(y, "hand_id").where(F.expr("available_at + INTERVAL 60 DAYS >= played_at")).select("hand_id", "player_id", F.round("qty", 4).alias("qty"), "label")


@query("challenge_eval", "SELECT c_custkey, coalesce(round(max(o_totalprice), 2), 0) AS alert_score, count(o_orderkey) AS alerts FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def _challenge(spark: SparkSession, d: str) -> DataFrame:
    best = T.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.round(F.max("o_totalprice"), 2).alias("alert_score"), F.count("o_orderkey").alias("alerts"))
    return T.table(spark, d, "customer").select("c_custkey").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("alert_score", F.lit(0.0)).alias("alert_score"), F.coalesce("alerts", F.lit(0)).alias("alerts"))


@query("dedup_events", "SELECT user_id, event_type, max(event_id) AS event_id, count(*) AS copies FROM events GROUP BY 1, 2")
def _dedup(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select(F.concat_ws(":", "user_id", "event_type").alias("id"), "user_id", "event_type", "event_id")
    return loads.keep_last(e, "id", "event_id").select("user_id", "event_type", "event_id", "copies")


@query("collision_check", "SELECT o_custkey AS id, count(DISTINCT o_orderstatus) AS contents FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def _collisions(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.struct("o_orderstatus").alias("content"))
    return loads.collisions(o, "id", "content")


@query("upsert", "SELECT c_custkey, round(CASE WHEN n.k IS NOT NULL THEN c_acctbal + 1 ELSE c_acctbal END, 4) AS c_acctbal FROM customer LEFT JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 = 0) n ON n.k = c_custkey")
def _upsert(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return loads.upsert(c, new, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("insert_status", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN 'inserted' WHEN c_custkey % 2 = 0 THEN 'duplicate' ELSE 'collision' END AS status FROM customer")
def _insert_status(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    old = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.sha2(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("other"), 256).alias("sha"))
    return loads.insert_status(old, c.select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("sha")), "id", "sha").select("id", "status")


@query("dead_letters", "SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unsupported_type' END AS c1, CASE WHEN value < 5 THEN 'low_value' END AS c2 FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') OR value < 5")
def _dead(spark: SparkSession, d: str) -> DataFrame:
    rules = {"unsupported_type": ~F.col("event_type").isin("view", "click", "purchase"), "low_value": F.col("value") < 5}
    bad = loads.validate(T.table(spark, d, "events"), rules).where(F.size("errors") > 0)
    return bad.select("event_id", *[F.when(F.array_contains("errors", r), r).alias(c) for r, c in (("unsupported_type", "c1"), ("low_value", "c2"))])


@query("compare_rows", "WITH a AS (SELECT c_custkey AS id, c_mktsegment AS x, round(c_acctbal, 2) AS y FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS x, round(c_acctbal, 2) AS y FROM customer WHERE c_custkey % 11 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'right_only' WHEN b.id IS NULL THEN 'left_only' ELSE 'different' END AS difference, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'x' ELSE '' END AS fields FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.x IS DISTINCT FROM b.x OR a.y IS DISTINCT FROM b.y")
def _compare(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("x"), F.round("c_acctbal", 2).alias("y"))
    b = c.where("id % 11 <> 0").withColumn("x", F.when(F.col("id") % 5 == 0, "CHANGED").otherwise(F.col("x")))
    return loads.compare(c.where("id % 7 <> 0"), b, "id").withColumn("fields", F.concat_ws(",", "fields"))


@query("key_set_difference", "SELECT c_custkey AS k, 'left_only' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right_only' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def _keys(spark: SparkSession, d: str) -> DataFrame:
    return loads.key_differences(T.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), T.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("merged_events", "SELECT ts, event_id, event_type, priority FROM (SELECT ts, event_id, event_type, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS priority FROM events)")
def _merged(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("ts", "event_id", "event_type")
    priority = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    parts = [e.where(F.col("event_type") == k) for k in ("signup", "view", "purchase", "error", "click")]
    return files.merged([p.withColumn("priority", priority) for p in parts], ["ts", "priority", "event_id"])


@query("population_hash", "SELECT n_regionkey AS g, sha256(string_agg(n_name, chr(10) ORDER BY n_name)) AS members_sha256 FROM (SELECT DISTINCT n_regionkey, n_name FROM nation) GROUP BY 1")
def _hash(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("g")).agg(files.population_hash(F.col("n_name")).alias("members_sha256"))


@query("ingest_latency", "SELECT quantile_cont(l, 0.5) AS p50, round(quantile_cont(l, 0.95), 6) AS p95, max(l) AS worst FROM (SELECT epoch(l_shipdate) - epoch(o_orderdate) AS l FROM lineitem JOIN orders ON o_orderkey = l_orderkey)")
def _latency(spark: SparkSession, d: str) -> DataFrame:
    j = T.table(spark, d, "lineitem").join(T.table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    late = (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).cast("double")
    middle = quantiles(j.select(late.alias("l")), F.col("l"), [0.5, 0.95])
    return middle.crossJoin(F.broadcast(j.agg(F.max(late).alias("worst")))).select(F.col("q")[0].alias("p50"), F.round(F.col("q")[1], 6).alias("p95"), "worst")  # one row each


@query("cdc_events", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'operation' WHEN user_id % 10 = 3 THEN 'checksum' END AS reject FROM events")
def _cdc(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    body = F.to_json(F.struct("event_id", "user_id", "value"))
    after = F.struct(F.col("event_id").cast("string").alias("id"), F.lit("json-v1").alias("codec_version"), F.base64(body.cast("binary")).alias("payload"), F.when(F.col("user_id") % 10 == 3, "bad").otherwise(F.sha2(body, 256)).alias("payload_sha256"), F.lit("validation").alias("dataset_split"))
    records = e.select(F.to_json(F.struct(F.when(F.col("event_type") == "error", "u").otherwise("c").alias("op"), after.alias("after"), F.struct(F.lit(7).alias("txId"), F.lit("ml_outbox").alias("table")).alias("source"))).alias("value"))
    out = cdc.adapt(records, codecs=("json-v1",), table="ml_outbox")
    return out.select(F.col("id").cast("long").alias("event_id"), "reject")


@query("hourly_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _hourly(spark: SparkSession, d: str) -> DataFrame:
    g = T.table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "value")


@query("activity_cube", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _cube(spark: SparkSession, d: str) -> DataFrame:
    g = T.table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return g.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "qty")
