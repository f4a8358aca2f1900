"""Language identification by rank-order profiles.

A profile is the list of the TOP most frequent character n-grams, n from 1 to 3, of letters and word boundaries. The distance of a
document to a language is the sum over the document's own TOP n-grams of how far each is from its place in the language's list, TOP
where it is not in it. The language with the least distance wins.

Profiles are learned from a bounded sample, TRAIN documents a language at most, those with the smallest hashes of their ids, which a threshold
on the hash picks out before they are ranked; the counts are summed by Spark, and TOP rows a language reach the driver. Scoring is one pass of Arrow batches without a shuffle, over whole texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tideglass.llm.common import documents, thinned, without, written
from tideglass.llm.tokens import slices

TOP, TRAIN, FOLDS, HELD = 300, 2_000, 5, 0
#: Stands for a boundary of words: not 0, as n-grams of different lengths must differ, and not a letter.
EDGE = 1
RESULT = ("lang_pred", "score", "held_out")


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


@cache
def _letters() -> np.ndarray:
    """True at the code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the text in ascending order and their counts. An n-gram is up to three code points of 21 bits; EDGE is a boundary."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[code]
    code = np.concatenate([[EDGE], np.where(letter, code, EDGE), [EDGE]])
    code = code[np.concatenate([[True], (code[1:] != EDGE) | (code[:-1] != EDGE)])]
    two = code[:-1] << 21 | code[1:]
    three = two[:-1] << 21 | code[2:]
    # the boundary is no n-gram by itself, and none lies across a boundary
    return np.unique(np.concatenate([code[code != EDGE], two[(code[:-1] != EDGE) | (code[1:] != EDGE)], three[code[1:-1] != EDGE]]), return_counts=True)


def top(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent, in this order; ties in ascending order of the n-grams."""
    if len(keys) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.argsort(-counts, kind="stable")][:n]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]], size: int) -> None:
        self.names, self.size = sorted(ranked), size
        self.sorted = [np.argsort(np.array(ranked[x], np.int64)) for x in self.names]
        self.keys = [np.array(ranked[x], np.int64)[o] for x, o in zip(self.names, self.sorted, strict=True)]

    def distances(self, own: np.ndarray) -> list[int]:
        place, out = np.arange(len(own)), []
        for keys, ranks in zip(self.keys, self.sorted, strict=True):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            out.append(int(np.where(keys[at] == own, np.abs(ranks[at] - place), self.size).sum()))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        own = top(*grams(text), self.size)
        if not len(own) or not self.names:
            return "und", 0.0
        d = self.distances(own)
        best = min(range(len(d)), key=lambda i: (d[i], self.names[i]))
        return self.names[best], 1.0 - d[best] / (self.size * len(own))


def learn(docs: DataFrame, *, train: int = TRAIN, size: int = TOP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the languages of docs from rows with text and language; languages whose texts have no letter are not learned."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("own"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    narrow = written(known.select(F.col("own").alias("i"), "lang", F.xxhash64("own", "lang").alias("h")), "ids")
    of = narrow.groupBy("lang").agg(F.count(F.lit(1)).alias("of")).withColumnRenamed("lang", "l")
    few = thinned(narrow.join(F.broadcast(of), F.col("lang") == F.col("l")), "h", train, F.col("of")).select("i", "lang", "h").distinct()  # one row a language
    sample = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "i"))).where(F.col("nth") <= train)
    sample = F.broadcast(written(sample.select("i", F.col("lang").alias("l")), "sample"))  # train rows a language at most
    texts = known.join(sample, F.col("own").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("l")), "left_semi").dropDuplicates(["own", "lang"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                by: dict[str, list] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(grams(text))
                for lang, found in by.items():
                    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    counts = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "place", "gram").collect()
    ranked: dict[str, list[int]] = {}
    for lang, _, gram in sorted(rows):
        ranked.setdefault(lang, []).append(gram)
    return Profiles(ranked, size)


def predict(docs: DataFrame, profiles: Profiles, *, text_col: str = "text") -> DataFrame:
    """All rows of docs with lang_pred and score, 1 - distance / largest distance. A text that is null or has no letter is "und", 0.

    Equal distances go to the language that sorts first. Without any profile all are "und". Input columns named as a result are replaced.
    """
    rows = without(docs, [x for x in RESULT[:2] if x != text_col])
    order = list(rows.columns)
    text_at = order.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in (x.as_py() for x in batch.column(text_at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*order, "lang_pred", "score"])

    return rows.mapInArrow(scored, StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = learn(docs.where(fold(F.col("doc_id"), FOLDS) != HELD))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return predict(docs.select("doc_id", "text"), profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")
