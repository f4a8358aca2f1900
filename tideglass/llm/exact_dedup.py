"""Exact dedup by progressive refinement: length, then hash of a prefix, then hash of the whole text.

1. One scan yields narrow keys: id, length, hash of the prefix. Rows are grouped by length, then by prefix within the lengths that
   occur twice. Each grouping is a partial aggregation, so a group that holds a third of all rows shrinks to one row a task.
2. A second scan computes the whole text's hash, in the scan, of what a Bloom filter of the surviving (length, prefix) lets through. Only
   the hash is shuffled, never a text.
3. Verdicts by (id, hash) go back to the rows that have such a hash; all others are without equals and are passed on as they are.

Both joins by hash are between plain tables, which AQE can split where a group is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.bloom import Bloom
from tideglass.llm.common import ascii_lower, documents, without, written

PREFIX_CHARS = 64
RESULT = ("keep_id", "group_size", "kept")


def normalised(text: Column) -> Column:
    """Two texts are equal when this is: null as empty, A-Z in lower case."""
    return ascii_lower(F.coalesce(text, F.lit("")))


class Refinement:
    """The three steps over docs. hashed: id and hash of each row that may have equals; groups: hash, keep_id and group_size of what is equal."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> None:
        self.id_col, self.text = id_col, F.col(text_col).cast("string")
        text = F.coalesce(self.text, F.lit(""))
        self.length, self.prefix = F.octet_length(text), F.xxhash64(normalised(F.substring(text, 1, prefix_chars)))
        narrow = written(docs.select(self.length.alias("length"), self.prefix.alias("prefix")), "dedup-keys")
        # both groupings from one table of counts, which has one row for a group of copies of any size
        counts = written(narrow.groupBy("length", "prefix").count(), "dedup-counts")
        lengths = counts.groupBy("length").agg(F.sum("count").alias("n")).where("n > 1").select("length")
        alive = written(counts.where("count > 1").join(lengths, "length", "left_semi").select("length", "prefix"), "dedup-alive")
        self.bloom = Bloom(alive, F.xxhash64("length", "prefix"))
        hashed = self.with_hash(docs.select(id_col, text_col)).where("__sha is not null").select(F.col(id_col).alias("id"), F.col("__sha").alias("sha"))
        self.hashed = written(hashed, "dedup-hashes")
        groups = self.hashed.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
        self.groups = written(groups, "dedup-groups")

    def with_hash(self, rows: DataFrame) -> DataFrame:
        """Add __sha, the hash of the whole text where length and prefix may have survived, else null."""
        some = self.bloom.may_hold(F.xxhash64(self.length, self.prefix))
        return self.bloom.beside(rows).withColumn("__sha", F.when(some, F.sha2(normalised(self.text), 256))).drop(self.bloom.field)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """All rows of docs with keep_id, group_size and kept.

    Null texts equal empty ones. The row with the largest id stays (kept); null ids sort below all others. group_size counts all
    rows. Rows that repeat id and text are one document that occurs several times: each has its verdict. A document without equals
    has its own id as keep_id and 1 as group_size. An empty table gives an empty one. Other columns pass through; columns of docs
    named as a result are replaced.
    """
    steps = Refinement(docs, id_col, text_col, prefix_chars)
    rows = steps.with_hash(without(docs, [x for x in RESULT if x not in (id_col, text_col)]))
    alone = rows.where("__sha is null").withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    found = rows.where("__sha is not null").join(steps.groups, F.col("__sha") == F.col("sha"), "left")
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    found = found.withColumns({"keep_id": keep, "group_size": F.coalesce("group_size", F.lit(1).cast("long")), "kept": F.col(id_col).eqNullSafe(keep)})
    return alone.unionByName(found.drop("sha")).drop("__sha")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of docs, whole, that stay: of equal texts the one with the largest id, and of rows that repeat id and text one.

    What has no equals goes on from the scan. Of the rest a second Bloom filter lets the ids and hashes that stay through, so the
    texts that are shuffled are about one for each group.
    """
    steps = Refinement(docs, id_col, text_col, prefix_chars)
    rows = steps.with_hash(docs.withColumn("__id", F.col(id_col)))
    stay = written(steps.hashed.groupBy("sha").agg(F.max("id").alias("stay")), "dedup-stay")
    known = Bloom(stay, F.xxhash64("stay", "sha"))
    some = known.beside(rows.where("__sha is not null")).where(known.may_hold(F.xxhash64("__id", "__sha"))).drop(known.field)
    some = some.join(stay, (F.col("__sha") == F.col("sha")) & F.col("__id").eqNullSafe(F.col("stay")), "left_semi").dropDuplicates(["__id", "__sha"])
    return rows.where("__sha is null").unionByName(some).drop("__id", "__sha")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256))
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
