"""Best-fit packing by patterns fitted with non-negative least squares.

The driver plans on the histogram of lengths, whose size is that of the sequence and not of the corpus:

1. Lengths are put into bins of BIN tokens, rounded up. Patterns are the multisets of up to three bins, and of four on a coarser grid,
   that fill a sequence exactly.
2. Non-negative least squares finds how often to use each pattern so that they use up the histogram; short lengths weigh less, as
   they fill gaps later. Counts are rounded down, and down again where the histogram has too few.
3. The residual, exact lengths by now, is packed best-fit in descending order, many equal sequences at a time, first into what the
   patterns leave free.

The plan is a list of intervals: of the documents of one length, in the order of their rank, which go to which run of
sequences. Ranks within a length are built from buckets by hash, so a length that a third of the corpus has is spread over tasks.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.llm.common import documents, give_back, without, written
from tideglass.llm.sharding import ranked
from tideglass.llm.tokens import CHARS, END_ID, MEMO, encoder, model_path, slices

MAX_TOKENS, BIN, COARSE, LEAST_PER_BUCKET = 4096, 16, 4, 200
RESULT = ("sequence_id", "offset")


def tokenise(docs: DataFrame, *, max_tokens: int = MAX_TOKENS, tokenizer: str | None = None, end_id: int = END_ID, ids: bool = True, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO, chars: int = CHARS) -> DataFrame:
    """Pieces of whole texts: doc_id, piece, start, length, ids_crc32 and, unless ids is false, ids (binary, little-endian unsigned 32-bit).

    A document is the ids of its text (null: empty) and the end id. memo bounds the stretches of text that a worker remembers, chars the text that it has in parts at a time. Only one longer than max_tokens is cut. Null ids and rows that
    repeat are encoded as all others.
    """
    path = tokenizer or model_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, width = encoder(path, end_id, most=memo), 4 * max_tokens
        for batch in batches:
            for part in slices(batch, "text", chars):
                rows = [(i, k // width, k // 4, len(p := x[k : k + width]) // 4, zlib.crc32(p), p) for i, x in zip(part.column("doc_id").to_pylist(), e(part.column("text").to_pylist()), strict=True) for k in range(0, len(x), width)]
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])
        give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, schema)


def patterns(bins: int, coarse: int = COARSE) -> list[tuple[int, ...]]:
    """Multisets of bins 1..bins that add up to bins: of one to three bins, and of four whose members are multiples of coarse."""
    found: list[tuple[int, ...]] = [(bins,)]
    found += [(a, bins - a) for a in range(1, bins // 2 + 1)]
    found += [(a, b, bins - a - b) for a in range(1, bins // 3 + 1) for b in range(a, (bins - a) // 2 + 1)]
    u = bins // coarse
    if u * coarse == bins:
        found += [tuple(coarse * x for x in (a, b, c, u - a - b - c)) for a in range(1, u // 4 + 1) for b in range(a, (u - a) // 3 + 1) for c in range(b, (u - a - b) // 2 + 1)]
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """The x >= 0 that makes |a x - b| least, by active sets."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance:
            break
        active[j] = True
        while True:
            k = np.flatnonzero(active)
            p = a[:, k]
            s = np.linalg.solve(p.T @ p + 1e-9 * np.eye(len(k)), p.T @ b)
            if s.min() > 0:
                x[:] = 0
                x[k] = s
                break
            low = s <= 0
            now = x[k]
            step = float((now[low] / np.maximum(now[low] - s[low], 1e-300)).min())
            x[k] = now + step * (s - now)
            x[k[x[k] <= 1e-12 * max(1.0, x.max())]] = 0
            x[k[low & (x[k] <= 0)]] = 0
            active &= x > 0
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], max_tokens: int = MAX_TOKENS, width: int = BIN) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Intervals (length, first rank, last rank, first sequence, rank in the run, documents a sequence), and the number of sequences.

    A document of this length and a rank r between the two goes to sequence first + (rank in the run + r - first rank) // documents.
    """
    if bad := [x for x in histogram if not 0 < x <= max_tokens]:
        raise ValueError(f"lengths have to be from 1 to {max_tokens}: {bad[:5]}")
    while max_tokens % width:
        width //= 2
    bins = max_tokens // width
    of_bin: dict[int, list[int]] = {}
    for x in sorted(histogram, reverse=True):
        of_bin.setdefault(-(-x // width), []).append(x)
    count = np.array([0] + [sum(histogram[x] for x in of_bin.get(b, [])) for b in range(1, bins + 1)], np.float64)
    known = [p for p in patterns(bins) if all(count[b] for b in p)]
    used, intervals, runs, sequences = [0] * (bins + 1), [], [], 0

    def take(b: int, n: int, first: int, each: int) -> int:
        """The next n of bin b, the longest first, each to a sequence; returns the longest of them."""
        lo, hi, before, longest = used[b], used[b] + n, 0, 0
        for x in of_bin[b]:
            i, j = max(lo, before), min(hi, before + histogram[x])
            if i < j:
                intervals.append((x, i - before, j - before - 1, first, i - lo, each))
                longest = max(longest, x)
            before += histogram[x]
        used[b] = hi
        return longest

    if known:
        a = np.zeros((bins + 1, len(known)))
        for j, p in enumerate(known):
            for b in p:
                a[b, j] += 1
        weight = np.minimum(1.0, np.arange(bins + 1) / (bins / 8)) * 0.9 + 0.1
        scale = max(1.0, count.max())
        repeat = nnls(a * weight[:, None], count * weight / scale) * scale
        for j in np.argsort(-repeat, kind="stable"):
            need = {b: known[j].count(b) for b in known[j]}
            n = min([int(repeat[j] + 1e-6), *(int((count[b] - used[b]) // k) for b, k in need.items())])
            if n > 0:
                filled = sum(k * take(b, n * k, sequences, k) for b, k in need.items())
                runs.append((sequences, n, max_tokens - filled))
                sequences += n
    free: dict[int, list[tuple[int, int]]] = {}  # room: runs (first sequence, sequences) that have it
    rooms: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if room not in free:
            free[room] = []
            insort(rooms, room)
        free[room].append((first, n))

    for first, n, room in runs:
        if room > 0:
            put(room, first, n)
    for b in range(bins, 0, -1):
        before = 0
        for x in of_bin.get(b, []):
            at = min(histogram[x], max(0, used[b] - before))
            before += histogram[x]
            left = histogram[x] - at
            while left:
                i = bisect_left(rooms, x)
                if i == len(rooms):
                    each = max_tokens // x
                    n = max(1, left // each)
                    each = min(each, left)
                    put_first, sequences = sequences, sequences + n
                    room = max_tokens
                else:
                    room = rooms[i]
                    put_first, n = free[room].pop()
                    if not free[room]:
                        del free[room]
                        rooms.pop(i)
                    each = min(room // x, max(1, left // n))
                    if left < n:
                        put(room, put_first + left, n - left)
                        n = left
                m = min(left, n * each)
                intervals.append((x, at, at + m - 1, put_first, 0, each))
                if room - each * x > 0:
                    put(room - each * x, put_first, n)
                at, left = at + m, left - m
    return intervals, sequences


def pack(pieces: DataFrame, *, max_tokens: int = MAX_TOKENS, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """All rows of pieces with sequence_id (from 0, gapless) and offset in the sequence (gapless from 0).

    length_col is from 1 to max_tokens, anything else is an error. `order` names columns that tell rows apart; rows that repeat are
    interchangeable. An empty table gives an empty one. Input columns named as a result are replaced. pieces is read three times: hand in a written table.
    """
    pieces = without(pieces, RESULT)
    # one row for each length: max_tokens at most
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}
    intervals, _ = plan(histogram, max_tokens)
    by_length: dict[int, list] = {}
    for x, *rest in intervals:
        by_length.setdefault(x, []).append(tuple(rest))
    spark = pieces.sparkSession
    steps = spark.createDataFrame([(x, histogram[x], sorted(v)) for x, v in by_length.items()], "l long, n long, steps array<struct<lo: long, hi: long, first: long, k: long, each: long>>")
    total = sum(histogram.values())
    per_bucket = max(LEAST_PER_BUCKET, math.isqrt(total))
    sized = pieces.join(F.broadcast(steps.select("l", "n")), F.col(length_col) == F.col("l")).drop("l")
    sized = sized.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.ceil(F.col("n") / per_bucket))).drop("n")
    rows = ranked(sized, [length_col], "__bucket", [F.col(c) for c in order]).drop("__bucket")
    rows = rows.join(F.broadcast(steps.select("l", "steps")), F.col(length_col) == F.col("l")).withColumn("__r", F.col("__rank") - 1)
    step = F.filter("steps", lambda s: (s["lo"] <= F.col("__r")) & (F.col("__r") <= s["hi"]))[0]
    rows = rows.withColumn("__step", step).withColumn("sequence_id", F.expr("__step.first + (__step.k + __r - __step.lo) div __step.each"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.col(length_col).desc(), *order, "__r").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(length_col).over(ahead), F.lit(0)).cast("long")).drop("l", "steps", "__r", "__rank", "__step")


def pack_documents(docs: DataFrame, *, max_tokens: int = MAX_TOKENS, ids: bool = True, **options: object) -> DataFrame:
    """Encode and pack: the columns of tokenise with sequence_id and offset. Texts are encoded once, into a written table.

    Places are found on numbers alone. Ids stay in that table until each piece meets its place, by a number of the row in it, so they are shuffled once.
    """
    pieces = written(tokenise(docs, max_tokens=max_tokens, ids=ids, **options).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    packed = pack(pieces.drop("ids"), max_tokens=max_tokens, order=("doc_id", "piece", "__row"))
    if ids:
        packed = packed.join(pieces.select(F.col("__row").alias("__at"), "ids"), F.col("__row") == F.col("__at")).drop("__at")
        columns = [*[c for c in pieces.columns if c != "__row"], *RESULT]
        return packed.select(*columns)
    return packed.drop("__row")


def assembled(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, length and ids (binary) of pieces with their ids, each piece at its offset. A group is one sequence, max_tokens ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = F.reduce("parts", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", whole.alias("ids"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
