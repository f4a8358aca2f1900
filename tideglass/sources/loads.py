"""Load semantics: upserts, idempotent inserts, collisions, dead letters, comparisons."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new does not have."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of each key with the largest version, of old and new; of equal versions the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__new")).alias("x")).select(*keys, "x.*")


def delete_then_append(old: DataFrame, new: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Old without any row of the new rows' values of column, then the new rows; and how many rows were deleted.

    What is joined is the distinct values, and old is counted by value first: a value that many rows of both sides share is met once.
    """
    values = new.select(column).distinct()
    gone = old.groupBy(column).agg(F.count(F.lit(1)).alias("n")).join(values, column, "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return old.join(values, column, "left_anti").unionByName(new), gone


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def insert_status(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Each new row with status: inserted if its key is not there, duplicate if it is with the same content, collision with another."""
    there = old.select(F.col(key).alias("__k"), F.col(content).alias("__c"))
    j = new.join(there, F.col(key) == F.col("__k"), "left")
    return j.withColumn("status", F.when(F.col("__k").isNull(), "inserted").when(F.col(content) == F.col("__c"), "duplicate").otherwise("collision")).drop("__k", "__c")


def checked_insert(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """The new rows whose key is not there yet; a key that is there with other content is an error."""
    s = insert_status(old, new, key, content)
    clash = F.raise_error(F.concat(F.lit("other content of key "), F.col(key).cast("string"))).cast("boolean")
    return s.where(F.when(F.col("status") == "collision", clash).otherwise(F.col("status") == "inserted")).drop("status")


def collisions(records: DataFrame, key: str, content: str) -> DataFrame:
    """Keys with more than one content, by the hash of its JSON: a batch with any of these must not be loaded."""
    sha = F.sha2(F.to_json(F.col(content)), 256)
    return records.groupBy(key).agg(F.count_distinct(sha).alias("contents")).where("contents > 1")


def keep_last(records: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is last in order, with copies, the number of rows of the key. Combined before the shuffle."""
    rest = [c for c in records.columns if c != key]
    g = records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x"), F.count(F.lit(1)).alias("copies"))
    return g.select(key, "x.*", "copies")


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add errors, the names of the rules that a row breaks; a null condition does not break a rule."""
    return df.withColumn("errors", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull()))


def dead_letters(invalid: DataFrame, topic: str, stage: str, raw: Column) -> DataFrame:
    return invalid.select(F.lit(topic).alias("source_topic"), F.lit(stage).alias("stage"), F.concat_ws(",", "errors").alias("reason"), raw.alias("raw_value"))


def replace_references(old: DataFrame, new: DataFrame, owner: str, reference: str) -> DataFrame:
    """Links of owners: those of the owners in new become exactly the new lists; others stay. new: owner and an array of references."""
    return old.join(new.select(owner), owner, "left_anti").unionByName(new.select(owner, F.explode(reference).alias(reference)).distinct())


def route(records: DataFrame, kinds: dict[str, tuple[Column, Column]], kind: str = "event_type") -> DataFrame:
    """Add entity_key and revision by the kind of event; kinds that are not listed have nulls."""
    pick = lambda i: reduce(lambda a, k: a.when(F.col(kind) == k, kinds[k][i]), list(kinds)[1:], F.when(F.col(kind) == next(iter(kinds)), kinds[next(iter(kinds))][i]))
    return records.withColumn("entity_key", pick(0)).withColumn("revision", pick(1))


def compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ: left_only, right_only or different, with the names of the fields. A key that repeats is an error."""
    fields = [c for c in a.columns if c != key]
    one = lambda df, p: df.groupBy(F.col(key).alias(f"{p}k")).agg(F.count(F.lit(1)).alias(f"{p}n"), *[F.first(c).alias(f"{p}{c}") for c in fields])
    j = one(a, "l_").join(one(b, "r_"), F.col("l_k") == F.col("r_k"), "full")
    once = F.when((F.coalesce("l_n", F.lit(1)) > 1) | (F.coalesce("r_n", F.lit(1)) > 1), F.raise_error(F.concat(F.lit("repeated key "), F.coalesce("l_k", "r_k").cast("string")))).otherwise(F.coalesce("l_k", "r_k"))
    unlike = F.filter(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    both = F.col("l_k").isNotNull() & F.col("r_k").isNotNull()
    out = j.select(once.alias(key), F.when(F.col("l_k").isNull(), "right_only").when(F.col("r_k").isNull(), "left_only").otherwise("different").alias("difference"), F.when(both, unlike).otherwise(F.array().cast("array<string>")).alias("fields"))
    return out.where((F.col("difference") != "different") | (F.size("fields") > 0))


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only; two equal sets give no row."""
    left = a.select(key).distinct().join(b, key, "left_anti").withColumn("side", F.lit("left_only"))
    return left.unionByName(b.select(key).distinct().join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


def merged_one_to_one(a: DataFrame, b: DataFrame, keys: list[str], required: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows of a with those of b. A key that repeats on either side is an error, and so is a required column of b that is null or missing.

    Both sides are counted in the join's own exchange by the keys; the errors are raised by the tasks that see them.
    """
    w = Window.partitionBy(*keys)
    one = lambda df, n: df.withColumn(n, F.count(F.lit(1)).over(w))
    j = one(a, "__a").join(one(b, "__b"), keys, "left")
    name = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    twice = F.when((F.col("__a") > 1) | (F.coalesce("__b", F.lit(0)) > 1), F.raise_error(F.concat(F.lit("repeated key "), name)).cast("boolean")).otherwise(True)
    lacking = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in required], F.lit(False))
    whole = F.when(lacking, F.raise_error(F.concat(F.lit("incomplete row of key "), name)).cast("boolean")).otherwise(True)
    return j.where(twice).where(whole).drop("__a", "__b")


_PATHS = "array<struct<path: string, value: string>>"


def _leaves(documents: pd.Series) -> pd.Series:
    """Paths and JSON values of each document's leaves; lists also have their length. What does not parse has one leaf, its text."""
    def walk(x: object, path: str, out: list) -> list:
        if isinstance(x, dict):
            for k in sorted(x):
                walk(x[k], f"{path}.{k}", out)
        elif isinstance(x, list):
            out.append((f"{path}.length", str(len(x))))
            for i, y in enumerate(x):
                walk(y, f"{path}[{i}]", out)
        else:
            out.append((path, json.dumps(x)))
        return out

    def one(text: str | None) -> list | None:
        if text is None:
            return None
        try:
            return walk(json.loads(text), "payload", [])
        except ValueError:
            return [("payload", text)]

    return documents.map(one)


def payload_differences(expected: DataFrame, actual: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """key, path, expected and actual (JSON, null where the path is not there) of each leaf that differs between two tables of JSON payloads.

    Lists of unequal length differ in path.length; their common elements are compared, the others not. A key of one side only differs
    in all its leaves. Null payloads have no leaf. Documents are flattened in Arrow batches; the comparison is a join by key and path.
    """
    flat = F.pandas_udf(_leaves, _PATHS)
    side = lambda df, n: df.select(F.col(key).alias("key"), F.explode(flat(F.col(payload))).alias("x")).select("key", F.col("x.path").alias("path"), F.col("x.value").alias(n))
    both = side(expected, "expected").join(side(actual, "actual"), ["key", "path"], "full").where(~F.col("expected").eqNullSafe(F.col("actual")))
    lengths = both.where(F.col("path").endswith(".length") & F.col("expected").isNotNull() & F.col("actual").isNotNull())
    lengths = lengths.select(F.col("key").alias("l_key"), F.concat(F.expr("substring(path, 1, length(path) - 7)"), F.lit("[")).alias("list"), F.least(F.col("expected").cast("int"), F.col("actual").cast("int")).alias("common"))
    rest = F.expr("substring(path, length(list) + 1)")
    beyond = F.col("path").startswith(F.col("list")) & (F.regexp_extract(rest, r"^(\d+)\]", 1).try_cast("int") >= F.col("common"))
    out = both.join(lengths, (F.col("key") == F.col("l_key")) & beyond, "left_anti")
    return out.select(F.col("key").alias(key), "path", "expected", "actual")


def write_digested(df: DataFrame, path: str) -> DataFrame:
    """Write Parquet with zstd; returns file, bytes and sha256 of each file, which tasks compute from what was written."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
