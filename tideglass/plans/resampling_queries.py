"""Bootstrap intervals of ranking metrics, and paired differences of two scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import resampling
from tideglass.plans.registry import query
from tideglass.sources import testbed as T

REPLICATES, SEED = 24, 7


def scored(spark: SparkSession, d: str) -> DataFrame:
    row = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    tie = F.struct(row.alias("a"), "l_partkey", "l_suppkey", "l_extendedprice")
    score = lambda c: F.round(c, 6)
    return T.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("hand_id"), tie.alias("row_id"), (F.col("l_suppkey") % 5 == 0).cast("int").alias("label"), (F.col("l_discount") >= 0.05).alias("fired"),
        score((F.col("l_discount") * 10 + F.col("l_tax")) / 2).alias("score"), score(F.pmod(F.col("l_suppkey") * 37 + F.col("l_partkey"), F.lit(101)) / F.lit(101.0)).alias("other"),
    )


def _metrics_sql(score: str) -> str:
    """The metrics of each replicate, as common table expressions that end with m."""
    weight = " + ".join(f"(x >= {limit})::INT" for limit in resampling.poisson_limits())
    return f"""
p AS (
  SELECT l_orderkey AS hand_id, (l_suppkey % 5 = 0)::INT AS y, (l_discount >= 0.05)::INT AS f, {score} AS s,
    row_number() OVER (ORDER BY {score} DESC, l_orderkey * 100 + l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o
  FROM lineitem),
h AS (
  SELECT hand_id, b * 4 + j AS r, ('0x' || substr(md5('{SEED}|' || hand_id || '|' || b), j * 8 + 1, 8))::BIGINT AS x
  FROM (SELECT DISTINCT hand_id FROM p), range(0, {REPLICATES // 4}) AS t(b), range(0, 4) AS u(j)),
w AS (SELECT r, p.*, {weight} AS w FROM p JOIN h ON h.hand_id = p.hand_id),
t AS (
  SELECT r, sum(w * y) AS pos, sum(w) AS every, sum(w * y * f) AS tp, sum(w * f) AS alerts, sum(w * (s - y) * (s - y)) AS brier, greatest(1, floor(sum(w) * 0.02)) AS allowed,
    (SELECT count(DISTINCT hand_id) FROM p) AS hands
  FROM w GROUP BY r),
g AS (SELECT r, s, sum(w * y) AS gp, sum(w) AS gn FROM w GROUP BY r, s),
c AS (SELECT *, sum(gp) OVER z AS cp, sum(gn) OVER z AS cn FROM g WINDOW z AS (PARTITION BY r ORDER BY s DESC)),
a AS (
  SELECT c.r, sum(gp * CASE WHEN cn > 0 THEN cp / cn ELSE 0 END) AS pr, sum(gp * ((every - pos) - (cn - cp) + 0.5 * (gn - gp))) AS co
  FROM c JOIN t ON t.r = c.r GROUP BY c.r),
b AS (
  SELECT r, sum(least(greatest(allowed - before, 0), w)) AS chosen, sum(y * least(greatest(allowed - before, 0), w)) AS chosen_pos
  FROM (SELECT w.r, w.w, w.y, allowed, sum(w.w) OVER (PARTITION BY w.r ORDER BY o) - w.w AS before FROM w JOIN t ON t.r = w.r) GROUP BY r),
m AS (
  SELECT t.r, CASE WHEN pos > 0 THEN pr / pos END AS pr_auc, CASE WHEN pos * (every - pos) > 0 THEN co / (pos * (every - pos)) END AS roc_auc, brier / every AS brier_score,
    CASE WHEN alerts > 0 THEN tp / alerts ELSE 0 END AS precision, CASE WHEN pos > 0 THEN tp / pos END AS recall, CASE WHEN alerts + pos > 0 THEN 2 * tp / (alerts + pos) ELSE 0 END AS f1, alerts / every AS alert_rate,
    CASE WHEN pos > 0 THEN chosen_pos / pos END AS recall_at_alert_budget, CASE WHEN chosen > 0 THEN chosen_pos / chosen ELSE 0 END AS precision_at_alert_budget, (alerts - tp) * 1000 / hands AS false_positives_per_1000_hands
  FROM t JOIN a ON a.r = t.r JOIN b ON b.r = t.r)"""


_SCORE, _OTHER = "round((l_discount * 10 + l_tax) / 2, 6)", "round(((l_suppkey * 37 + l_partkey) % 101) / 101.0, 6)"
_LONG = ", ".join(resampling.METRICS)
_ENDS = "round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.975), 6) AS upper, count(v) AS effective"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("lower", "median", "upper")})


@query("ranking_bootstrap", f"WITH {_metrics_sql(_SCORE)} SELECT metric, {_ENDS} FROM (UNPIVOT (SELECT * EXCLUDE (r) FROM m) ON {_LONG} INTO NAME metric VALUE v) GROUP BY metric")
def _ranking_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resampling.intervals(resampling.replicate_metrics(scored(spark, d), REPLICATES, SEED)))


_DIFF = ", ".join(f"one.{m} - two.{m} AS {m}" for m in resampling.METRICS)


@query(
    "paired_bootstrap",
    f"""WITH one AS (WITH {_metrics_sql(_SCORE)} SELECT * FROM m), two AS (WITH {_metrics_sql(_OTHER)} SELECT * FROM m),
d AS (SELECT {_DIFF} FROM one JOIN two ON one.r = two.r)
SELECT metric, {_ENDS} FROM (UNPIVOT d ON {_LONG} INTO NAME metric VALUE v) GROUP BY metric""",
)
def _paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resampling.paired_differences(scored(spark, d), "score", "other", REPLICATES, SEED))
