"""Bootstrap of ranking metrics: all replicates in one pass over the rows in the order of their scores.

A replicate gives each group (a hand) a weight, Poisson(1) from the digits of an md5, so whole groups are drawn and SQL can draw the same. Rows are sorted by score in ranges
and never multiplied: a row carries its replicates as a vector of small numbers, drawn before the sort, where rows of a group often lie together, and once for all scores. The ranges' totals, one row a range, are summed up to what lies before each range, and
a second pass adds up each range's share of every metric. A score that a third of the rows share lies in many ranges: its total is summed over them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tideglass.sources.scratch import discard, written

METRICS = ("pr_auc", "roc_auc", "brier_score", "precision", "recall", "f1", "alert_rate", "recall_at_alert_budget", "precision_at_alert_budget", "false_positives_per_1000_hands")
CHUNK = 2_000


def poisson_limits(most: int = 12) -> list[int]:
    """Of a 32-bit number, from where on the weight is 1, 2 and so on: the distribution function of Poisson(1)."""
    limits, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        limits.append(int(total * 2**32))
    return limits


def weights_of(groups: list, replicates: int, seed: int) -> np.ndarray:
    """A row of weights for each group: four replicates from each md5 of seed, group and block."""
    blocks = -(-replicates // 4)
    digits = b"".join(hashlib.md5(f"{seed}|{g}|{b}".encode(), usedforsecurity=False).digest() for g in groups for b in range(blocks))
    numbers = np.frombuffer(digits, ">u4").reshape(len(groups), 4 * blocks)[:, :replicates]
    return np.searchsorted(np.array(poisson_limits()), numbers, "right").astype(np.uint8)


def _drawn(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows with their weights in place of their group; those of a batch's group are drawn once."""
    for batch in batches:
        if batch.num_rows:
            groups = batch.column("grp").dictionary_encode()
            w = weights_of(groups.dictionary.to_pylist(), replicates, seed)[groups.indices.to_numpy()]
            names = [n for n in batch.schema.names if n != "grp"]
            vectors = pa.FixedSizeBinaryArray.from_buffers(pa.binary(replicates), len(w), [None, pa.py_buffer(np.ascontiguousarray(w))])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), vectors.cast(pa.binary())], [*names, "w"])


def _chunks(batches: Iterator[pd.DataFrame], replicates: int) -> Iterator[pd.DataFrame]:
    """Sorted rows as chunks with their weights, and at the end of a range its totals and those of its first and last score."""
    part, total, ends, number = None, np.zeros((2, replicates), np.int64), {}, 0
    for batch in batches:
        for k in range(0, len(batch), CHUNK):
            rows = batch.iloc[k : k + CHUNK]
            part = int(rows["part"].iloc[0])
            w = np.frombuffer(b"".join(rows["w"]), np.uint8).reshape(len(rows), replicates)
            y, score = rows["y"].to_numpy(np.int64), rows["score"].to_numpy(float)
            both = np.stack([(w * y[:, None]).sum(0), w.sum(0, dtype=np.int64)])
            total += both
            for s in {score[0], score[-1]} | ({next(reversed(ends))} if ends else set()):
                at = score == s
                if at.any():
                    ends[s] = ends.get(s, 0) + np.stack([(w[at] * y[at][:, None]).sum(0), w[at].sum(0, dtype=np.int64)])
            if len(ends) > 2:  # the first one and the last one of the range
                names = list(ends)
                ends = {names[0]: ends[names[0]], score[-1]: ends[score[-1]]}
            yield pd.DataFrame([(part, number, score.tobytes(), y.astype(np.uint8).tobytes(), rows["fired"].to_numpy(np.uint8).tobytes(), w.tobytes(), None)], columns=_CHUNK)
            number += 1
    if part is not None:
        summary = np.stack([total, *ends.values()]).tobytes()
        yield pd.DataFrame([(part, -1, np.array(list(ends)).tobytes(), None, None, None, summary)], columns=_CHUNK)


_CHUNK = ["part", "number", "score", "y", "fired", "w", "summary"]


def _shares(batches: Iterator[pd.DataFrame], before: dict, tied: dict, total: np.ndarray, allowed: np.ndarray, replicates: int) -> Iterator[pd.DataFrame]:
    """Each range's share of what the metrics are sums of, as one row of vectors."""
    part, out, cum, open_ = None, None, None, None

    def close() -> None:
        s, start, got = open_
        if s in tied:
            first, got = tied[s]
            if first != part:
                return  # the range where the score starts has counted it
        pos, every = got
        c_pos, c_all = start + got
        out["pr"] += pos * np.divide(c_pos, c_all, out=np.zeros(replicates), where=c_all > 0)
        out["concordant"] += pos * ((total[1] - total[0]) - (c_all - c_pos) + 0.5 * (every - pos))

    def row() -> pd.DataFrame:
        return pd.DataFrame([(part, np.stack([out[k] for k in SHARES]).tobytes())], columns=["part", "shares"])

    for batch in batches:
        for p, scores, y, fired, w in zip(*(batch[c] for c in ("part", "score", "y", "fired", "w")), strict=True):
            if p != part:
                if part is not None:
                    close()
                    yield row()
                part, out, cum, open_ = int(p), {k: np.zeros(replicates) for k in SHARES}, before[int(p)].astype(float), None
            score, y, fired = np.frombuffer(scores), np.frombuffer(y, np.uint8).astype(float), np.frombuffer(fired, np.uint8).astype(float)
            w = np.frombuffer(w, np.uint8).reshape(len(score), replicates).astype(float)
            out["brier"] += ((score - y) ** 2) @ w
            out["alerts"] += fired @ w
            out["tp"] += (fired * y) @ w
            if (cum[1] < allowed).any():
                rows_before = cum[1] + np.cumsum(w, axis=0) - w
                chosen = np.clip(allowed - rows_before, 0, w)
                out["chosen"] += chosen.sum(0)
                out["chosen_pos"] += y @ chosen
            starts = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
            pos, every = np.add.reduceat(w * y[:, None], starts), np.add.reduceat(w, starts)
            for i, k in enumerate(starts):
                got = np.stack([pos[i], every[i]])
                if open_ is not None and open_[0] == score[k]:
                    open_ = (open_[0], open_[1], open_[2] + got)
                else:
                    if open_ is not None:
                        close()
                    open_ = (score[k], cum.copy(), got)
                cum = cum + got
    if part is not None:
        close()
        yield row()


SHARES = ("pr", "concordant", "brier", "alerts", "tp", "chosen", "chosen_pos")


def replicate_metrics(rows: DataFrame, replicates: int = 200, seed: int = 7, *, max_alert_rate: float = 0.02, label: str = "label", score: str = "score", fired: str = "fired", group: str = "hand_id", tie: str = "row_id") -> DataFrame:
    """A row for each replicate, from 0, with METRICS of the weighted rows; what has no denominator is null, a precision without an alert is 0.

    The budget is max_alert_rate of the drawn rows, rounded down, one at least, in the order of falling scores and then `tie`; rows equal in both may change places. Equal scores count as one
    step of the curves. Rows without a label, score or group are an error of the caller's and are left out. An empty table gives an empty one.
    """
    drawn, (hands,) = _draw(rows, (score,), replicates, seed, label, fired, group, tie)
    out = _metrics(drawn, "score0", hands, replicates, max_alert_rate)
    discard(drawn)
    return out


def _draw(rows: DataFrame, scores: tuple[str, ...], replicates: int, seed: int, label: str, fired: str, group: str, tie: str) -> tuple[DataFrame, list[int]]:
    """The rows as a table with score0 and so on, tie, y, fired and their weights w, and how many groups each score is known in."""
    names = [f"score{i}" for i in range(len(scores))]
    kept = rows.where(F.col(label).isNotNull() & F.col(group).isNotNull() & F.coalesce(*scores).isNotNull())
    kept = kept.select(*[F.col(c).cast("double").alias(n) for c, n in zip(scores, names, strict=True)], F.col(tie).alias("tie"), F.col(label).cast("int").alias("y"), F.coalesce(F.col(fired), F.lit(False)).alias("fired"), F.col(group).cast("string").alias("grp"))
    known = kept.groupBy("grp").agg(*[F.bool_or(F.col(n).isNotNull()).alias(n) for n in names])
    hands = list(known.agg(*[F.count_if(n).alias(n) for n in names]).first())
    schema = StructType([f for f in kept.schema.fields if f.name != "grp"] + [StructField("w", BinaryType())])
    return written(kept.mapInArrow(lambda b: _drawn(b, replicates, seed), schema), "drawn"), hands


def _metrics(drawn: DataFrame, score: str, hands: int, replicates: int, max_alert_rate: float) -> DataFrame:
    spark, kept = drawn.sparkSession, drawn.where(F.col(score).isNotNull()).select(F.col(score).alias("score"), "tie", "y", "fired", "w")
    ranges = kept.orderBy(F.desc("score"), "tie").withColumn("part", F.spark_partition_id()).drop("tie")
    schema = "part int, number int, score binary, y binary, fired binary, w binary, summary binary"
    chunks = written(ranges.mapInPandas(lambda b: _chunks(b, replicates), schema), "chunks")
    before, tied, total = {}, {}, np.zeros((2, replicates), np.int64)
    for r in chunks.where("number = -1").select("part", "score", "summary").orderBy("part").collect():  # one row a range
        sums = np.frombuffer(r.summary, np.int64).reshape(-1, 2, replicates)
        before[r.part], total = total, total + sums[0]
        for s, got in zip(np.frombuffer(r.score).tolist(), sums[1:], strict=True):
            first, had = tied.get(s, (r.part, 0))
            tied[s] = (first, had + got)
    result = "replicate int, " + ", ".join(f"{m} double" for m in METRICS)
    if not before:
        discard(chunks)
        return spark.createDataFrame([], result)
    allowed = np.maximum(1, np.floor(total[1] * max_alert_rate))
    shares = chunks.where("number >= 0").repartition("part").sortWithinPartitions("part", "number")
    found = shares.mapInPandas(lambda b: _shares(b, before, tied, total, allowed, replicates), "part int, shares binary").orderBy("part").collect()  # one row a range
    discard(chunks)
    x = dict(zip(SHARES, sum(np.frombuffer(f.shares).reshape(len(SHARES), replicates) for f in found), strict=True))
    pos, every = total[0].astype(float), total[1].astype(float)
    over = lambda a, b, empty=None: [float(u / v) if v > 0 else empty for u, v in zip(a, b, strict=True)]
    fp, fn = x["alerts"] - x["tp"], pos - x["tp"]
    columns = {
        "pr_auc": over(x["pr"], pos), "roc_auc": over(x["concordant"], pos * (every - pos)), "brier_score": over(x["brier"], every), "precision": over(x["tp"], x["alerts"], 0.0), "recall": over(x["tp"], pos),
        "f1": over(2 * x["tp"], 2 * x["tp"] + fp + fn, 0.0), "alert_rate": over(x["alerts"], every), "recall_at_alert_budget": over(x["chosen_pos"], pos), "precision_at_alert_budget": over(x["chosen_pos"], x["chosen"], 0.0),
        "false_positives_per_1000_hands": (fp * 1000 / hands).tolist(),
    }
    return spark.createDataFrame([(i, *values) for i, values in enumerate(zip(*(columns[m] for m in METRICS), strict=True))], result)


def drawn_sums(groups: DataFrame, group: str, counters: list[str], replicates: int = 200, seed: int = 7) -> DataFrame:
    """A row for each replicate with the weighted sums of the counters over the groups, one row each. A task passes on one row of vectors; no group is multiplied."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(counters), replicates))
        for batch in batches:
            for k in range(0, len(batch), CHUNK):
                rows = batch.iloc[k : k + CHUNK]
                total += rows[counters].to_numpy(float).T @ weights_of(rows["grp"].tolist(), replicates, seed).astype(float)
        yield pd.DataFrame({"replicate": np.arange(replicates)} | dict(zip(counters, total.astype(np.int64), strict=True)))

    rows = groups.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("grp"), *counters)
    parts = rows.mapInPandas(add, "replicate int, " + ", ".join(f"{c} long" for c in counters))
    return parts.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in counters])


def intervals(replicated: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Of each column of replicates but their number: metric, lower, median, upper (linear quantiles of those that are known) and effective, how many these are. Rows are replicates: a few hundred."""
    names = [c for c in replicated.columns if c != "replicate"]
    alpha = (1 - confidence) / 2
    long = replicated.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in names])).alias("x")).select("x.*")
    q = F.percentile("v", F.array(*[F.lit(e) for e in (alpha, 0.5, 1 - alpha)]))
    return long.groupBy("metric").agg(q.alias("q"), F.count("v").alias("effective")).select("metric", F.col("q")[0].alias("lower"), F.col("q")[1].alias("median"), F.col("q")[2].alias("upper"), "effective")


def paired_differences(
    rows: DataFrame, candidate: str, baseline: str, replicates: int = 200, seed: int = 7, *, max_alert_rate: float = 0.02, label: str = "label", fired: str = "fired", group: str = "hand_id", tie: str = "row_id",
) -> DataFrame:
    """Intervals of the differences of METRICS, candidate less baseline, over the same draws: as good as independent of how hard the drawn hands are."""
    drawn, hands = _draw(rows, (candidate, baseline), replicates, seed, label, fired, group, tie)
    one, two = (_metrics(drawn, f"score{i}", hands[i], replicates, max_alert_rate) for i in range(2))
    discard(drawn)
    both = one.join(two.select("replicate", *[F.col(m).alias(f"{m}__base") for m in METRICS]), "replicate")
    return intervals(both.select("replicate", *[(F.col(m) - F.col(f"{m}__base")).alias(m) for m in METRICS]))
