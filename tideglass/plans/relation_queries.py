"""Queries over relations of players, cohorts, monitoring, payloads and routed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import datasets, graph, history, metrics, pairs, rules, splits
from tideglass.plans.registry import query, uuid5_sql
from tideglass.sources import cdc, files, loads
from tideglass.sources import testbed as T

BED = T.SQL
_PAIRS = BED + ", pr AS (SELECT a.hand_id, a.player_id AS player_a, b.player_id AS player_b, a.won_amount AS wa, b.won_amount AS wb FROM players a JOIN players b ON a.hand_id = b.hand_id AND a.player_id < b.player_id)"


def _graph_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of each hand; a player's device and network are numbers of theirs."""
    p = T.met(spark, d)
    of = {f"{n}_{s}": F.pmod(F.col(f"player_{s}"), F.lit(m)) for n, m in (("device", 5), ("network", 3)) for s in "ab"}
    return p.withColumns(of)


@query(
    "pair_graph_features",
    _PAIRS
    + """, p AS (SELECT pr.*, table_id, played_at FROM pr JOIN hands USING (hand_id)), s AS (SELECT DISTINCT x AS p, table_id FROM (SELECT player_a AS x, table_id FROM p UNION ALL SELECT player_b, table_id FROM p)),
n AS (SELECT player_a AS u, player_b AS v FROM p UNION SELECT player_b, player_a FROM p), e AS (SELECT player_a, player_b, count(*) AS hands FROM p GROUP BY 1, 2),
g AS (SELECT player_a, player_b, played_at, hand_id, (epoch(played_at) - epoch(lag(played_at) OVER (PARTITION BY player_a, player_b ORDER BY played_at, hand_id))) / 60 AS gap FROM p QUALIFY row_number() OVER (PARTITION BY player_a, player_b ORDER BY played_at DESC, hand_id DESC) = 1),
c AS (SELECT player_a, player_b, count(*) AS tables FROM e JOIN s x ON x.p = player_a JOIN s y ON y.p = player_b AND y.table_id = x.table_id GROUP BY 1, 2),
k AS (SELECT player_a, player_b, count(*) AS common FROM e JOIN n x ON x.u = player_a JOIN n y ON y.u = player_b AND y.v = x.v GROUP BY 1, 2), d AS (SELECT u, count(*) AS deg FROM n GROUP BY 1), us AS (SELECT DISTINCT u FROM n),
dev AS (SELECT u % 5 AS k, count(*) AS n FROM us GROUP BY 1), net AS (SELECT u % 3 AS k, count(*) AS n FROM us GROUP BY 1)
SELECT player_a, player_b, round(ln(1 + hands), 6) AS log_hands, round(coalesce(ln(1 + gap), 0), 6) AS log_minutes, round(CASE WHEN x.deg + y.deg - 2 - coalesce(common, 0) > 0 THEN coalesce(common, 0) / (x.deg + y.deg - 2 - coalesce(common, 0)) ELSE 0 END, 6) AS jaccard,
  player_a % 5 = player_b % 5 AS same_device, player_a % 3 = player_b % 3 AS same_network, round(ln(1 + coalesce(tables, 0)), 6) AS log_tables, player_b = player_a + 7 AS direct_link,
  round(ln(1 + CASE WHEN player_a % 5 = player_b % 5 THEN dev.n ELSE 0 END + CASE WHEN player_a % 3 = player_b % 3 THEN net.n ELSE 0 END), 6) AS log_shared
FROM e JOIN g USING (player_a, player_b) LEFT JOIN c USING (player_a, player_b) LEFT JOIN k USING (player_a, player_b) JOIN d x ON x.u = player_a JOIN d y ON y.u = player_b JOIN dev ON dev.k = player_a % 5 JOIN net ON net.k = player_a % 3""",
)
def _pair_graph(spark: SparkSession, d: str) -> DataFrame:
    links = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_suppkey") + 7).alias("other_user_id"))
    out = graph.pair_graph_features(_graph_pairs(spark, d), links)
    return out.withColumns({c: F.round(c, 6) for c in ("log_hands", "log_minutes", "jaccard", "log_tables", "log_shared")})


@query("resource_neighbours", "WITH u AS (SELECT o_custkey % 97 AS resource_id, o_custkey AS user_id, max(o_orderdate) AS last_used FROM orders GROUP BY 1, 2) SELECT resource_id, user_id, last_used, row_number() OVER (PARTITION BY resource_id ORDER BY last_used DESC, user_id) AS place FROM u QUALIFY place <= 4")
def _resources(spark: SparkSession, d: str) -> DataFrame:
    return graph.resource_neighbours(T.table(spark, d, "orders").select((F.col("o_custkey") % 97).alias("resource_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("used_at")))


#: The window's and the baseline's identities; a third window has labels that may not be used.
_MARKS = {"tenant_id": "sim", "product_id": "poker", "rollout_id": "r-1", "model_name": "pair", "model_run_id": "run-7"}
_BASE = {"evaluation_id": "eval-3", "baseline_sha256": "ab12"}
_FIRED = (
    """WITH w AS (
  SELECT CASE WHEN l_linenumber <= 5 THEN 'w1' ELSE 'w2' END AS window_id, 'rule-' || l_returnflag || l_linestatus AS rule_id, (l_linestatus = 'F' OR l_returnflag <> 'N') AS enabled,
    count(*) FILTER (l_discount >= 0.05) AS firings, count(*) FILTER (l_discount >= 0.05 AND l_suppkey % 5 = 0) AS tp, count(*) AS pair_rows,
    count(DISTINCT l_orderkey) AS hands, count(*) FILTER (l_suppkey % 5 = 0) AS pos
  FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT CASE WHEN l_linenumber <= 5 THEN 'w1' ELSE 'w2' END AS window_id, count(*) FILTER (l_linenumber = 7) AS unknown FROM lineitem GROUP BY 1),
b AS (
  SELECT * FROM (VALUES ('rule-AF', 0.5, 0.2, 600.0), ('rule-AO', 0.1, 0.2, 600.0), ('rule-NF', 0.5, 0.9, 100.0), ('rule-NO', 0.5, 0.2, 600.0), ('rule-RF', 0.5, 0.2, 10.0), ('rule-XX', 0.5, 0.2, 10.0))
    t(rule_id, br, bp, bv)),
j AS (
  SELECT b.*, g.window_id, g.unknown, w.* EXCLUDE (rule_id, window_id), CASE WHEN pair_rows > 0 THEN firings / pair_rows ELSE 0 END AS fr,
    CASE WHEN firings > 0 THEN tp / firings ELSE 0 END AS pc, CASE WHEN pos > 0 THEN tp / pos END AS rc, CASE WHEN hands > 0 THEN firings * 1000 / hands ELSE 0 END AS vo
  FROM b CROSS JOIN g LEFT JOIN w ON w.rule_id = b.rule_id AND w.window_id = g.window_id),
r AS (
  SELECT *, list_filter([CASE WHEN vo > 2 * bv THEN 'alert_volume_above_baseline_ratio' END, CASE WHEN fr > br + greatest(0.02, 0.5 * br) THEN 'firing_rate_above_baseline_band' END,
      CASE WHEN fr < greatest(0, br - greatest(0.02, 0.5 * br)) THEN 'firing_rate_below_baseline_band' END, CASE WHEN pc < 0.5 * bp THEN 'precision_below_baseline_ratio' END], lambda x: x IS NOT NULL) AS why,
    list_filter([CASE WHEN coalesce(hands, 0) < 20 THEN 'labeled_hands_below_minimum:' || coalesce(hands, 0) || '<20' END, CASE WHEN coalesce(pos, 0) < 5 THEN 'positive_labels_below_minimum:' || coalesce(pos, 0) || '<5' END,
      CASE WHEN coalesce(firings, 0) < 5 THEN 'rule_firings_below_minimum:' || coalesce(firings, 0) || '<5' END], lambda x: x IS NOT NULL) AS lack,
    unknown > 0 AND enabled IS NOT NULL AS bad, coalesce(NOT enabled, false) AS off
  FROM j),
s AS (
  SELECT window_id, rule_id, fr, pc, rc, vo, array_to_string(lack, ',') AS lacks,
    CASE WHEN off THEN 'disabled' WHEN bad THEN 'critical' WHEN len(lack) > 0 THEN 'insufficient_data' WHEN len(why) >= 2 THEN 'critical' WHEN len(why) = 1 THEN 'warning' ELSE 'ok' END AS status,
    CASE WHEN (off OR bad) AND unknown > 0 THEN 'unknown_label_rows_above_maximum' WHEN off OR bad OR len(lack) > 0 THEN '' ELSE array_to_string(why, ',') END AS reasons
  FROM r)"""
)


def _monitored(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem").withColumn("window_id", F.when(F.col("l_linenumber") <= 5, "w1").otherwise("w2"))
    fired, positive = F.col("l_discount") >= 0.05, F.col("l_suppkey") % 5 == 0
    w = li.groupBy("window_id", F.concat(F.lit("rule-"), "l_returnflag", "l_linestatus").alias("rule_id"), ((F.col("l_linestatus") == "F") | (F.col("l_returnflag") != "N")).alias("enabled")).agg(F.count_if(fired).alias("firings"), F.count_if(fired & positive).alias("true_positives"), F.count(F.lit(1)).alias("pair_rows"), F.count_distinct("l_orderkey").alias("labelled_hands"), F.count_if(positive).alias("positives"))
    labels = li.groupBy("window_id").agg(F.count_if(F.col("l_linenumber") == 7).alias("unknown_labels")).withColumn("circular_labels", F.lit(0).cast("long"))
    w = w.join(labels, "window_id").withColumns({"rule_version": F.lit(1)} | {k: F.lit(v) for k, v in _MARKS.items()})
    base = [("AF", 0.5, 0.2, 600.0), ("AO", 0.1, 0.2, 600.0), ("NF", 0.5, 0.9, 100.0), ("NO", 0.5, 0.2, 600.0), ("RF", 0.5, 0.2, 10.0), ("XX", 0.5, 0.2, 10.0)]
    b = spark.createDataFrame([(f"rule-{k}", 1, *x) for k, *x in base], "rule_id string, rule_version int, base_rate double, base_precision double, base_volume double")
    b = b.withColumns({k: F.lit(v) for k, v in _BASE.items()})
    one = lambda k: metrics.rule_monitoring(w.where(F.col("window_id") == k), b, min_hands=20, min_positives=5, min_firings=5).withColumn("window_id", F.lit(k))
    return one("w1").unionByName(one("w2"))


@query(
    "rule_monitoring",
    _FIRED
    + f"""
SELECT window_id, rule_id, round(fr, 6) AS firing_rate, round(pc, 6) AS precision, round(rc, 6) AS recall, round(vo, 6) AS volume_per_1000, status, reasons, lacks,
  CASE WHEN status IN ('warning', 'critical') THEN {uuid5_sql('h')} END AS alert_id
FROM (SELECT *, sha1(unhex('{metrics.MONITORING.replace('-', '')}') || encode('sim|poker|' || window_id || '|' || rule_id || '|1|eval-3|ab12|r-1|pair|run-7|' || reasons)) AS h FROM s)
""",
)
def _monitoring(spark: SparkSession, d: str) -> DataFrame:
    names = ("firing_rate", "precision", "recall", "volume_per_1000")
    return _monitored(spark, d).select("window_id", "rule_id", *[F.round(c, 6).alias(c) for c in names], "status", "reasons", "lacks", "alert_id")


@query("monitoring_summary", _FIRED + " SELECT CASE WHEN bool_or(status = 'critical') THEN 'critical' WHEN bool_or(status = 'warning') THEN 'warning' WHEN bool_or(status = 'insufficient_data') THEN 'insufficient_data' WHEN bool_or(status = 'disabled') THEN 'disabled' ELSE 'ok' END AS status, count(*) AS rules, count(*) FILTER (status = 'critical') AS critical_rules, count(*) FILTER (status = 'warning') AS warning_rules, count(*) FILTER (status = 'insufficient_data') AS insufficient_data_rules, count(*) FILTER (status = 'disabled') AS disabled_rules, count(*) FILTER (status = 'ok') AS ok_rules, count(*) FILTER (status IN ('critical', 'warning')) AS alerts FROM s")
def _summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.overall_status(_monitored(spark, d))


@query("precision_at_k", "WITH p AS (SELECT (l_suppkey % 5 = 0)::INT AS y, row_number() OVER (ORDER BY round(l_discount * 10 + l_tax, 6) / 2 DESC, l_orderkey * 100 + l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) SELECT x::BIGINT AS k, count(*) AS alerts, sum(y)::BIGINT AS tp, round(avg(y), 9) AS precision FROM p JOIN (SELECT unnest([100, 1000]) AS x) ON p.k <= x GROUP BY 1")
def _precision_at(spark: SparkSession, d: str) -> DataFrame:
    tie = F.struct((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("a"), "l_partkey", "l_suppkey")
    rows = T.table(spark, d, "lineitem").select((F.col("l_suppkey") % 5 == 0).cast("int").alias("label"), (F.round(F.col("l_discount") * 10 + F.col("l_tax"), 6) / 2).alias("score"), tie.alias("row_id"))
    return metrics.precision_at(rows, [100, 1000]).withColumn("precision", F.round("precision", 9))


@query("cold_start_split", "WITH x AS (SELECT o_orderkey AS hand_id, (l_suppkey * 7919) % 20 AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey), s AS (SELECT hand_id, CASE WHEN f < 14 THEN 'train' WHEN f < 17 THEN 'validation' ELSE 'test' END AS s FROM x) SELECT o_orderkey AS hand_id, CASE WHEN min(s) = max(s) THEN min(s) END AS split FROM orders LEFT JOIN s ON s.hand_id = o_orderkey GROUP BY 1")
def _cold(spark: SparkSession, d: str) -> DataFrame:
    members = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hand_id"), "l_suppkey")
    return splits.cold_start(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("hand_id")), members, member="l_suppkey", turn=F.pmod(F.col("l_suppkey") * 7919, F.lit(20)))


@query("cold_start_gate", "SELECT 'member_in_one_split' AS rule, '' AS subject WHERE false")
def _cold_gate(spark: SparkSession, d: str) -> DataFrame:
    members = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hand_id"), F.col("l_suppkey").alias("player_id"))
    return datasets.disjoint_members(members.join(splits.cold_start(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("hand_id")), members), "hand_id"))


def _relations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each part is a pair; it is positive in the hands of large returned items."""
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("hand_id"), F.col("o_orderdate").alias("played_at"))
    p = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hand_id"), F.col("l_partkey").cast("string").alias("pair_key"), ((F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.1) & (F.col("l_returnflag") == "R")).alias("positive"))
    return o, p


_POSITIVE = """WITH RECURSIVE h AS (SELECT o_orderkey AS hand_id, o_orderdate AS played_at FROM orders), p AS (SELECT l_orderkey AS hand_id, l_partkey::VARCHAR AS pair_key, l_quantity >= 50 AND l_discount >= 0.1 AND l_returnflag = 'R' AS positive FROM lineitem),
pos AS (SELECT DISTINCT pair_key FROM p WHERE positive), s AS (SELECT DISTINCT hand_id, pair_key FROM p WHERE pair_key IN (SELECT pair_key FROM pos))"""


@query("positive_relations", _POSITIVE + " SELECT hand_id, count(*) AS positive_pairs, min(pair_key) AS first_pair FROM s GROUP BY 1")
def _positive(spark: SparkSession, d: str) -> DataFrame:
    _, p = _relations(spark, d)
    positive = p.groupBy("pair_key").agg(F.bool_or("positive").alias("p")).where("p")
    return p.select("hand_id", "pair_key").distinct().join(positive, "pair_key", "left_semi").groupBy("hand_id").agg(F.count(F.lit(1)).alias("positive_pairs"), F.min("pair_key").alias("first_pair"))


@query(
    "new_relationship_split",
    _POSITIVE
    + """, e AS (SELECT DISTINCT x.pair_key AS a, y.pair_key AS b FROM s x JOIN s y USING (hand_id)), r AS (SELECT a AS node, a AS r FROM e UNION SELECT e.b, r.r FROM r JOIN e ON e.a = r.node), c AS (SELECT node, min(r) AS component FROM r GROUP BY 1),
g AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT component FROM c)),
z AS (SELECT *, CASE WHEN n < 3 THEN 0 WHEN greatest(1, floor(n * 0.70::DOUBLE)) + greatest(1, floor(n * 0.15::DOUBLE)) >= n THEN n - 2 ELSE greatest(1, floor(n * 0.70::DOUBLE)) END AS t, CASE WHEN n < 3 THEN n - 1 WHEN greatest(1, floor(n * 0.70::DOUBLE)) + greatest(1, floor(n * 0.15::DOUBLE)) >= n THEN 1 ELSE greatest(1, floor(n * 0.15::DOUBLE)) END AS v FROM g),
o AS (SELECT hand_id, min(CASE WHEN i < t THEN 'train' WHEN i < t + v THEN 'validation' ELSE 'test' END) AS split FROM s JOIN c ON c.node = s.pair_key JOIN z USING (component) GROUP BY 1),
f AS (SELECT hand_id, (row_number() OVER (ORDER BY played_at, hand_id) - 1) % 20 AS i FROM h WHERE hand_id NOT IN (SELECT hand_id FROM o))
SELECT hand_id, split FROM o UNION ALL SELECT hand_id, CASE WHEN i < 14 THEN 'train' WHEN i < 17 THEN 'validation' ELSE 'test' END FROM f""",
)
def _new_relationship(spark: SparkSession, d: str) -> DataFrame:
    return splits.new_relationship(*_relations(spark, d)).select("hand_id", "split")


@query("protected_pairs_gate", "SELECT 'protected_pair_in_train' AS rule, '' AS subject WHERE false")
def _protected(spark: SparkSession, d: str) -> DataFrame:
    o, p = _relations(spark, d)
    s = splits.new_relationship(o, p)
    return datasets.protected_pairs(p.join(s.select("hand_id", "split"), "hand_id"))


@query("private_columns_gate", "SELECT 'private_column' AS rule, 'target' AS subject")
def _private(spark: SparkSession, d: str) -> DataFrame:
    return datasets.private_columns(T.table(spark, d, "lineitem").withColumn("target", F.lit(0)))


@query("merged_labels", "SELECT o_orderkey AS hand_id, o_totalprice > 100000 AS label, o_orderpriority AS provenance FROM orders")
def _merged_labels(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    labels = o.select(F.col("o_orderkey").alias("hand_id"), (F.col("o_totalprice") > 100000).alias("label"), F.col("o_orderpriority").alias("provenance"))
    return loads.merged_one_to_one(o.select(F.col("o_orderkey").alias("hand_id")), labels, ["hand_id"], ["label", "provenance"])


@query("conflicting_versions", BED + ", v AS (SELECT user_id, (context_version + 1) // 2 AS context_version, event_id FROM contexts) SELECT user_id, context_version, count(DISTINCT event_id) AS events FROM v GROUP BY 1, 2 HAVING count(DISTINCT event_id) > 1")
def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    return history.conflicting_versions(T.contexts(spark, d).withColumn("context_version", F.expr("(context_version + 1) div 2")))


@query("lookup_dead_letters", BED + " SELECT event_id, 'context-not-found' AS reason FROM observations o WHERE NOT EXISTS (SELECT 1 FROM contexts c WHERE c.user_id = o.user_id AND c.effective_at <= o.observed_at)")
def _not_found(spark: SparkSession, d: str) -> DataFrame:
    j = history.as_of(T.observations(spark, d), T.contexts(spark, d), "user_id", "observed_at", "effective_at", ("context_version", "event_id"))
    _, dead = history.found_or_dead(j, "ctx_event_id", "hands", "context", "context-not-found")
    return dead.select(F.get_json_object("raw_value", "$.event_id").cast("long").alias("event_id"), "reason")


@query("pattern_parts", "SELECT o_orderkey, o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.75) FROM orders) AS high FROM orders")
def _parts(spark: SparkSession, d: str) -> DataFrame:
    return datasets.quantile_parts(T.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "high")


@query("first_pairs", _PAIRS + " SELECT hand_id, player_a, player_b FROM pr WHERE hand_id IN (SELECT hand_id FROM hands WHERE table_id < 25) ORDER BY 1, 2, 3 LIMIT 500")
def _first_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = pairs.pair_rows(T.players(spark, d).select("hand_id", "player_id"), ())
    return datasets.first_pairs(p, T.hands(spark, d).where("table_id < 25"), 500).select("hand_id", "player_a", "player_b")


@query("candidate_pairs", _PAIRS + ", s AS (SELECT *, ((player_a * 31 + player_b * 17 + hand_id) % 100) / 100 AS pair_memory_score FROM pr) SELECT hand_id, player_a, player_b, pair_memory_score FROM s WHERE hand_id IN (SELECT hand_id FROM hands WHERE table_id = 3) OR pair_memory_score >= 0.98 ORDER BY pair_memory_score DESC, hand_id, player_a, player_b LIMIT 300")
def _candidates(spark: SparkSession, d: str) -> DataFrame:
    p = pairs.pair_rows(T.players(spark, d).select("hand_id", "player_id"), ())
    p = p.withColumn("pair_memory_score", ((F.col("player_a") * 31 + F.col("player_b") * 17 + F.col("hand_id")) % 100) / 100)
    return datasets.candidate_pairs(p, T.hands(spark, d).where("table_id = 3"), 300, 0.98).select("hand_id", "player_a", "player_b", "pair_memory_score")


@query("payload_differences", """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS c, o_custkey % 4 AS n FROM orders) SELECT k, path, expected, actual FROM (
  SELECT k, 'payload.a' AS path, '"' || s || '"' AS expected, CASE WHEN c % 3 = 0 THEN '"x"' ELSE '"' || s || '"' END AS actual FROM o UNION ALL
  SELECT k, 'payload.list.length', '2', (1 + n)::VARCHAR FROM o UNION ALL
  SELECT k, 'payload.list[1]', c::VARCHAR, (c + (c % 5 = 0)::INT)::VARCHAR FROM o WHERE n >= 1) WHERE expected <> actual""")
def _payloads(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    c = F.col("o_custkey")
    js = lambda a, items: F.to_json(F.struct(a.alias("a"), items.alias("list")))
    one = o.select(F.col("o_orderkey").alias("k"), js(F.col("o_orderstatus"), F.array(F.lit(1).cast("long"), c)).alias("payload"))
    items = F.slice(F.array(F.lit(1).cast("long"), c + (c % 5 == 0).cast("int"), c, c), F.lit(1), (1 + c % 4).cast("int"))
    two = o.select(F.col("o_orderkey").alias("k"), js(F.when(c % 3 == 0, "x").otherwise(F.col("o_orderstatus")), items).alias("payload"))
    return loads.payload_differences(one, two, "k")


@query("routed_records", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'u' || user_id WHEN 'signup' THEN 'e' || event_id END AS entity_key, CASE event_type WHEN 'purchase' THEN event_id WHEN 'signup' THEN 1 END::BIGINT AS revision FROM events")
def _routed(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"purchase": (F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id")), "signup": (F.concat(F.lit("e"), F.col("event_id").cast("string")), F.lit(1).cast("long"))}
    return loads.route(T.table(spark, d, "events"), kinds).select("event_id", "entity_key", "revision")


@query("outbox_allowed", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'signup')")
def _outbox(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame([("purchase",), ("signup",), ("purchase",)], "event_type string")
    return cdc.route_outbox(T.table(spark, d, "events"), allowed, "event_type").select("event_id")


@query("replaced_days", "SELECT o_orderkey, o_orderstatus, false AS fresh FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'P', true FROM orders WHERE o_orderkey % 3 = 1")
def _replaced(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 3 = 1").select("o_orderkey", F.lit("P").alias("o_orderstatus"), F.lit(True).alias("fresh"))
    return loads.delete_then_append(o.withColumn("fresh", F.lit(False)), new, "o_orderstatus")[0]


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Nested hand events: players and actions as arrays, with private labels in the players."""
    players = T.players(spark, d).groupBy("hand_id").agg(F.collect_list(F.struct("player_id", "won_amount", (F.col("player_id") % 9 == 0).alias("is_suspicious"), F.lit("c1").alias("collusion_pair_id"))).alias("players"))
    actions = T.actions(spark, d).groupBy("hand_id").agg(F.collect_list(F.struct("sequence_no", "player_id", F.when(F.col("sequence_no") > 1, F.col("amount")).alias("amount"))).alias("actions"))
    return players.join(actions, "hand_id")


@query("hand_tables", BED + " SELECT hand_id, 'action' AS kind, player_id, CASE WHEN sequence_no > 1 THEN round(amount, 6) ELSE 0 END AS amount FROM actions UNION ALL SELECT hand_id, 'player', player_id, round(won_amount, 6) FROM players")
def _hand_tables(spark: SparkSession, d: str) -> DataFrame:
    _, actions, players = files.hand_tables(_events(spark, d))
    return actions.select("hand_id", F.lit("action").alias("kind"), "player_id", F.round("amount", 6).alias("amount")).unionAll(players.select("hand_id", F.lit("player"), "player_id", F.round("won_amount", 6)))


@query("labels_apart", BED + " SELECT hand_id, player_id, player_id % 9 = 0 AS is_suspicious, 'c1' AS collusion_pair_id FROM players")
def _labels_apart(spark: SparkSession, d: str) -> DataFrame:
    public, private = files.without_labels(_events(spark, d))
    if files.forbidden_fields(public.schema):
        raise ValueError("labels are left in the public table")
    return private


@query("flattened", "SELECT o_orderkey, o_orderstatus AS head_status, o_custkey AS head_customer, o_totalprice > 100000 AS tail_large FROM orders")
def _flattened(spark: SparkSession, d: str) -> DataFrame:
    nested = T.table(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("head"), F.struct((F.col("o_totalprice") > 100000).alias("large")).alias("tail"))
    return files.flatten(nested, {"head": "head_", "tail": "tail_"})


@query("projected_vectors", "WITH s AS (SELECT c_custkey, least(greatest(c_acctbal / 1000, -10), 10) AS x, c_nationkey::DOUBLE AS y0 FROM customer), p AS (SELECT c_custkey, 0.5 * x - least(y0, 10) AS a, 2 * x AS b FROM s) SELECT c_custkey, round(CASE WHEN a * a + b * b > 0 THEN a / sqrt(a * a + b * b) ELSE 0 END, 6) AS a, round(CASE WHEN a * a + b * b > 0 THEN b / sqrt(a * a + b * b) ELSE 0 END, 6) AS b FROM p")
def _projected(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    v = graph.project([F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")], [[0.5, 2.0], [-1.0, 0.0]])
    return c.select("c_custkey", v.alias("v")).select("c_custkey", F.round(F.col("v")[0], 6).alias("a"), F.round(F.col("v")[1], 6).alias("b"))


@query("rule_rollout", "SELECT o_orderkey, rule_id FROM orders, (VALUES ('pair.same-device'), ('pair.same-network'), ('pair.outcome-asymmetry')) r(rule_id) WHERE CASE rule_id WHEN 'pair.same-device' THEN o_custkey % 4 = 0 WHEN 'pair.same-network' THEN o_custkey % 3 = 0 ELSE o_orderkey % 2 = 1 END AND rule_id <> 'pair.same-network'")
def _rollout(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    none = {c: F.lit(0.0) for c in ("a_fold_b_win_rate", "b_fold_a_win_rate")}
    p = o.withColumns({"one_folded_other_won": F.lit(0), "same_device": (F.col("o_custkey") % 4 == 0).cast("int"), "same_network": (F.col("o_custkey") % 3 == 0).cast("int"), "outcome_asymmetry": F.pmod("o_orderkey", F.lit(2)).cast("double") / 2, **none})
    enabled = [r[0] for r in rules.PAIR_RULES if r[0] != "pair.same-network"]
    return rules.rule_evidence(p, ["o_orderkey"], enabled).select("o_orderkey", "rule_id")
