"""Sharding by proportional stratified interleaving, as DataFrame operations only.

Rows are shuffled by a seeded hash and ranked within their source. Sorted by (rank - 1/2) / size of the source, every stretch of
the order holds the sources in proportion; it is cut into shards of equal counts.

Both rankings are built from buckets, so that no task holds a whole source or the whole table. The hash is uniform, and so is the
fractional rank, so stretches of either make buckets of even size whatever the source; offsets come from the counts of buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.llm.common import documents, without

SHARDS, SEED, LEAST_PER_BUCKET = 8, "tideglass", 2_000
RESULT = ("law", "shard", "slot", "position", "grown_shard")


def ranked(rows: DataFrame, over: list[str], bucket: str, order: list[Column]) -> DataFrame:
    """Add __rank, from 1 within over, by bucket and then order: the rows before the bucket plus the place in it."""
    counts = rows.groupBy(*over, bucket).agg(F.count(F.lit(1)).alias("__n"))
    # one row for each bucket: the square root of the rows, and a few for each source
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*over).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy(*over, bucket).orderBy(*order))
    keys = [*over, bucket]
    before = before.select(*[F.col(k).alias(f"__b_{i}") for i, k in enumerate(keys)], F.coalesce("__before", F.lit(0)).alias("__before"))
    on = None
    for i, k in enumerate(keys):
        one = F.col(k).eqNullSafe(F.col(f"__b_{i}"))
        on = one if on is None else on & one
    return rows.withColumn("__place", place.cast("long")).join(before, on).withColumn("__rank", F.col("__before") + F.col("__place")).drop(*[f"__b_{i}" for i in range(len(keys))], "__before", "__place")


def shard_rows(docs: DataFrame, *, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", least_per_bucket: int = LEAST_PER_BUCKET) -> DataFrame:
    """All rows of docs with shard (from 0), slot (from 0 in the shard, gapless) and position (from 0 over all).

    Counts of shards differ by one row at most, and in each shard a source has its share of the table to within a row or so.
    A null source is a source of its own. Rows are ordered by md5 of the seed and the id; equal ids, null ones among them, by
    the hash of the whole row; rows that repeat in all columns are interchangeable, and so their places are. An empty table gives
    an empty one. With fewer rows than shards, some shards have none. Input columns named as a result are replaced.
    """
    rows = without(docs, RESULT)
    rows = rows.withColumns({"__source": F.col(source_col), "__key": F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"))), "__tie": F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])})
    sizes = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("__size"))
    total = docs.count()
    rows_per_bucket = max(least_per_bucket, math.isqrt(total))
    buckets = max(1, -(-total // rows_per_bucket))
    sized = rows.join(sizes.select(F.col("__source").alias("__s"), "__size"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    # The first 32 bits of the key, as a number below 2^32, scaled to the source's own number of buckets.
    stretch = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * F.ceil(F.col("__size") / rows_per_bucket) / F.lit(2**32)).cast("long")
    within = ranked(sized.withColumn("__bucket", stretch), ["__source"], "__bucket", [F.col("__key"), F.col("__tie")])
    # (rank - 1/2) / size in exact integers, scaled to 2^40
    share = F.expr(f"(cast(2 * __rank - 1 as decimal(20, 0)) * {2**40}) div cast(2 * __size as decimal(20, 0))")
    spread = within.withColumns({"__share": share, "__in_source": F.col("__rank")}).drop("__rank", "__bucket", "__key", "__tie", "__size")
    spread = spread.withColumn("__stretch", F.expr(f"(cast(__share as decimal(20, 0)) * {buckets}) div {2**40}"))
    placed = ranked(spread, [], "__stretch", [F.col("__share"), F.col("__source").asc_nulls_last(), F.col("__in_source")])
    out = placed.withColumn("position", F.col("__rank") - 1)
    out = out.withColumn("shard", F.expr(f"cast((position * {shards}) div {max(1, total)} as int)"))
    out = out.withColumn("slot", F.col("position") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}"))
    out = out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
    return out.drop("__source", "__share", "__stretch", "__in_source", "__rank")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


ORACLE_SQL = f"""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}|' || doc_id)) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents),
p AS (SELECT doc_id, row_number() OVER (ORDER BY (2 * k - 1)::HUGEINT * {2**40} // (2 * n), source NULLS LAST, k) - 1 AS position, count(*) OVER () AS total FROM r)
SELECT doc_id, (position * {SHARDS} // total)::INT AS shard, position - (((position * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS}) AS slot FROM p
"""
#: The same with the other columns. crc32 is not among DuckDB's functions: a table of its 256 steps, made by rule, is applied to the bytes of each text.
ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
s AS (
  SELECT doc_id, octet_length(encode(x)) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, crc)
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32, 'rows' AS law, o.shard, o.slot, NULL::INT AS grown_shard
FROM s JOIN ({ORACLE_SQL}) o ON o.doc_id = s.doc_id
"""
