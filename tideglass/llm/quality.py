"""Quality rules: base rules on words, then the frequency of lines across documents.

Lines are normalised (A-Z in lower case, runs of digits as 0 unless fold_digits is false, blanks folded) and hashed. For each host, the distinct
documents that hold a line are counted; each row is a document, so copies of a text count as often as they occur. A line that more than
max_docs documents of the host hold is boilerplate there and is removed; the limit is absolute, so that the verdict on a line does not
loosen as its host grows (max_share can ask for a share of the host besides). A document that keeps less than min_left of its words is depleted and rejected.

One pass over the texts yields a few numbers and the hashes of the lines, which are written; all else runs on those. Equal texts of a host are
one row with the number of their documents. Counts are partial sums before each shuffle, one row a (host, line) and task. Lines
above the limit are joined back by a sort-merge join between plain tables, which AQE splits.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.common import documents, without, written
from tideglass.llm.tokens import slices

MIN_WORDS, MAX_REPEATED, MAX_DOCS, MAX_SHARE, MIN_LEFT = 50, 50, 20, 0.0, 0.5
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_lines", "n_left_words", "kept", "clean_text")
SYMBOLS, BLANKS, _DIGITS = "#*$%&|<>", " \t\n\x0b\x0c\r", re.compile(rb"[0-9]+")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text holds twice or more, the first time included."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    n = [numbers.setdefault(w, len(numbers)) for w in words]
    if len(numbers) == len(n):
        return 0
    windows = list(zip(n, n[1:], n[2:]))  # noqa: B905  the lengths differ by design
    count = Counter(windows)
    if len(count) == len(windows):
        return 0
    total, covered = 0, 0  # covered: the first word that no window before covers
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def line_key(line: str, fold_digits: bool = True) -> bytes:
    plain = b" ".join(line.encode("utf-8", "surrogatepass").lower().split())
    return hashlib.md5(_DIGITS.sub(b"0", plain) if fold_digits else plain, usedforsecurity=False).digest()


def text_numbers(text: str, fold_digits: bool = True) -> tuple[int, int, int, int, int, list[bytes], list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; of the lines with a word: keys, places, numbers of words."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [(i, x, n) for i, x in enumerate(text.split("\n")) if (n := len(x.encode("utf-8", "surrogatepass").split()))]
    chars = len(text) - sum(text.count(b) for b in BLANKS)
    dup = len(lines) - len({x for _, x, _ in lines})
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), dup, repeated_words(words), [line_key(x, fold_digits) for _, x, _ in lines], [i for i, _, _ in lines], [n for _, _, n in lines]


NUMBERS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _numbers(batches: Iterator[pa.RecordBatch], fold_digits: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            *numbers, keys, places, counts = zip(*(text_numbers(t, fold_digits) for t in part.column("text").to_pylist()), strict=True)
            flat = pa.StructArray.from_arrays([pa.array([x for y in keys for x in y], pa.binary()), pa.array([x for y in places for x in y], pa.int32()), pa.array([x for y in counts for x in y], pa.int32())], ["k", "i", "n"])
            ends = pa.array([0, *itertools.accumulate(map(len, keys))], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("host"), part.column("key"), *(pa.array(x, pa.int64()) for x in numbers), pa.ListArray.from_arrays(ends, flat)], ["host", "key", *NUMBERS.replace(" long", "").split(", "), "lines"])


def quality_rules(docs: DataFrame, *, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, fold_digits: bool = True, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """All rows of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_frequent_lines, n_left_words, kept and clean_text.

    base_failed: fewer than min_words words, or more than max_repeated percent of them in repeated windows. A line is frequent if more
    than max_docs documents of the host and more than max_share of them hold it. clean_text is the text without those lines. kept: not
    base_failed, and at least min_left of the words left. A null host is a host of its own; a null or empty text has no words and fails. Rows that
    repeat get equal results. An empty table gives an empty one. Input columns named as a result are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = without(docs, [x for x in RESULT if x not in (host_col, text_col)]).withColumns({"__host": F.col(host_col).cast("string"), "__key": F.unhex(F.md5(text))})
    schema = f"host string, key binary, {NUMBERS}, lines array<struct<k: binary, i: int, n: int>>"
    numbers = rows.select(F.col("__host").alias("host"), F.col("__key").alias("key"), text.alias("text")).mapInArrow(lambda batches: _numbers(batches, fold_digits), schema)
    found = [x.name for x in numbers.schema if x.name not in ("host", "key")]
    texts = written(numbers.groupBy("host", "key").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in found]), "texts")
    held = texts.select("host", "copies", F.explode(F.array_distinct(F.col("lines.k"))).alias("k")).groupBy("host", "k").agg(F.sum("copies").alias("docs"))
    hosts = texts.groupBy("host").agg(F.sum("copies").alias("of")).select(F.col("host").alias("h"), "of")  # one row a host
    frequent = held.where(F.col("docs") > max_docs).join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("docs") > max_share * F.col("of"))
    frequent = written(frequent.select(F.col("host").alias("h"), F.col("k").alias("fk")), "frequent-lines")
    lines = texts.select("host", "key", F.inline("lines"))
    gone = lines.join(frequent, F.col("host").eqNullSafe(F.col("h")) & (F.col("k") == F.col("fk"))).groupBy("host", "key").agg(F.sum("n").alias("gone"), F.collect_list("i").alias("places"))
    gone = gone.select(F.col("host").alias("gh"), F.col("key").alias("gk"), "gone", "places")
    of_text = texts.drop("lines", "copies").join(gone, F.col("host").eqNullSafe(F.col("gh")) & (F.col("key") == F.col("gk")), "left").drop("gh", "gk")
    of_text = written(of_text, "text-numbers")
    out = rows.join(of_text, rows["__host"].eqNullSafe(of_text["host"]) & (rows["__key"] == of_text["key"])).drop("host", "key")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    clean = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(F.coalesce("places", F.array().cast("array<int>")), i)), "\n")
    out = out.withColumns({"base_failed": failed, "n_frequent_lines": F.coalesce(F.size("places"), F.lit(0)).cast("long"), "n_left_words": left})
    out = out.withColumn("n_frequent_lines", F.greatest("n_frequent_lines", F.lit(0).cast("long")))
    out = out.withColumns({"kept": ~F.col("base_failed") & (F.col("n_left_words") >= min_left * F.col("n_words")), "clean_text": F.when(F.col(text_col).isNotNull(), clean)})
    return out.drop("__host", "__key", "gone", "places")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_lines", "n_left_words")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, source, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
wi AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM wi QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + o AS p FROM again, range(0, 3) AS r(o)) GROUP BY 1),
l0 AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM w),
l AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n, regexp_replace(array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' '), '[0-9]+', '0', 'g') AS k FROM l0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE n > 0 GROUP BY 1),
f AS (SELECT source, k FROM (SELECT source, k, count(DISTINCT doc_id) AS docs FROM l WHERE n > 0 GROUP BY ALL) WHERE docs > {MAX_DOCS}),
gone AS (SELECT doc_id, sum(n) AS n, count(*) AS c FROM l JOIN f USING (source, k) WHERE n > 0 GROUP BY 1),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.c, 0)::BIGINT AS n_frequent_lines, (len(ws) - coalesce(gone.n, 0))::BIGINT AS n_left_words
  FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id)
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND n_left_words >= {MIN_LEFT} * n_words AS kept FROM s
"""
