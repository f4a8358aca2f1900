"""Line dedup across documents, as DataFrame operations only.

1. A scan explodes the lines and keeps (document, position, hash of the normalised line) of those that are long enough; a narrow table.
2. Hashes are counted by rows, which is a partial sum before the shuffle. That count is no smaller than the count of documents, so a Bloom filter of
   the few hashes that reach the threshold picks the rows for the exact count: distinct (hash, document), spread by both, then one
   partial count a hash. The largest document of each hash comes with it.
3. Positions that go are gathered for each document, which bounds the list by the document. Another Bloom filter parts the documents that lose
   lines, whose texts meet their positions and are put together again by position, from all others, which are passed on from the scan.

A line that a third of all documents hold is one row a task in step 2 and a key of a sort-merge join between plain tables, which AQE splits, in step 3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.bloom import Bloom
from tideglass.llm.common import ascii_lower, documents, without, written

LEAST_CHARS, LEAST_DOCS, BLANKS = 20, 3, " \t\n\x0b\x0c\r"
RESULT = ("n_lines", "n_dropped", "clean_text")


def line_key(line: Column) -> Column:
    """Lines are equal when this is: ASCII blanks stripped at both ends, A-Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def without_places(lines: Column, places: Column) -> Column:
    """The lines that are not at these places, which ascend from 0: the stretches between them, in linear time."""
    n, m = F.size(lines), F.size(places)
    start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.element_at(places, F.greatest(j, F.lit(1))) + 1)
    end = lambda j: F.when(j == m, n).otherwise(F.element_at(places, F.least(j + 1, m)))
    stretches = F.transform(F.sequence(F.lit(0), m), lambda j: F.slice(lines, start(j) + 1, end(j) - start(j)))
    return F.when(m == 0, lines).otherwise(F.flatten(stretches))


def line_dedup(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs with n_lines, n_dropped and clean_text, the text without repeated lines.

    A text is split at line feeds; a null or empty one is one empty line, and clean_text of a null is empty. A line whose key has least_chars code points or
    more, found in least_docs documents or more, goes from all of them but the one with the largest id, which keeps all lines that
    have that key. Documents are counted by id: rows that repeat an id are one document, and each of them has its verdict; null ids are one document and sort below all
    others. An empty table gives an empty one. Other columns pass through; columns of docs named as a result are replaced.
    """
    rows = without(docs, [x for x in RESULT if x not in (id_col, text_col)])
    text, key = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.unhex(F.md5(F.col("__text")))
    own = rows.select(F.col(id_col).alias("id"), text.alias("__text")).select("id", key.alias("own"), F.posexplode(F.split("__text", "\n", -1)).alias("place", "line"))
    own = own.select("id", "own", "place", line_key(F.col("line")).alias("line")).where(F.char_length("line") >= least_chars)
    lines = written(own.select("id", "own", "place", F.unhex(F.md5("line")).alias("k")), "lines")

    often = written(lines.groupBy("k").count().where(F.col("count") >= least_docs).select("k"), "often")
    known = Bloom(often, F.xxhash64("k"))
    some = written(known.beside(lines).where(known.may_hold(F.xxhash64("k"))).drop(known.field), "often-lines")
    frequent = some.select("k", "id").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keep")).where(F.col("docs") >= least_docs)
    frequent = written(frequent.select(F.col("k").alias("fk"), "keep"), "frequent-lines")
    gone = some.join(frequent, F.col("k") == F.col("fk")).where(~F.col("id").eqNullSafe(F.col("keep")))
    gone = written(gone.groupBy("id", "own").agg(F.array_sort(F.collect_set("place")).alias("__places")), "places")
    gone = gone.withColumnsRenamed({"id": "__id", "own": "__own_too"})

    losing = Bloom(gone, F.xxhash64("__id"))
    beside, maybe = losing.beside(rows.withColumn("__text", text)), losing.may_hold(F.xxhash64(id_col))
    whole = beside.where(~maybe).drop(losing.field)
    feeds = F.char_length("__text") - F.char_length(F.replace(F.col("__text"), F.lit("\n"), F.lit(""))) + 1
    whole = whole.withColumns({"n_lines": feeds.cast("long"), "n_dropped": F.lit(0).cast("long"), "clean_text": F.col("__text")})
    part = beside.where(maybe).drop(losing.field).withColumn("__own", key)
    part = part.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__own_too")), "left").drop("__id", "__own_too")
    places = F.coalesce("__places", F.array().cast("array<int>"))
    split = F.split("__text", "\n", -1)
    part = part.withColumns({"n_lines": F.size(split).cast("long"), "n_dropped": F.size(places).cast("long"), "clean_text": F.array_join(without_places(split, places), "\n")})
    return whole.drop("__text").unionByName(part.drop("__text", "__own", "__places"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM l),
f AS (
  SELECT k, max(doc_id) AS keep FROM k WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
v AS (
  SELECT k.doc_id, k.i, k.line, f.k IS NOT NULL AND k.doc_id <> f.keep AS gone FROM k LEFT JOIN f ON k.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id
"""
