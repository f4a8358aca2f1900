"""Streaming jobs: windows with watermarks, deduplication, running state of pairs, dead letters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tideglass.sources.loads import dead_letters, validate



def json_stream(spark: SparkSession, folder: str, schema: StructType | str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)


def deduplicated(events: DataFrame, ids: list[str], time: str, delay: str = "30 seconds") -> DataFrame:
    """Each id once while its first delivery is within the watermark's delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(ids)


def windowed(events: DataFrame, time: str, keys: list[str], size: str, value: str, delay: str = "30 seconds", slide: str | None = None) -> DataFrame:
    """Counts and sums of event-time windows that the watermark has closed."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = events.withWatermark(time, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


PAIR_OUT = "pair_key string, hand_id long, n long, soft_play double, transfer double"
PAIR_STATE = "n long, sa double, sb double, quiet long"


def _remember(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values("hand_id")
    n, sa, sb, quiet = state.get if state.exists else (0, 0.0, 0.0, 0)
    quiet_now = ~((rows.won_amount_a > 0) & (rows.won_amount_b > 0))
    count = n + pd.Series(range(1, len(rows) + 1), index=rows.index)
    a, b, q = sa + rows.won_amount_a.cumsum(), sb + rows.won_amount_b.cumsum(), quiet + quiet_now.astype("int64").cumsum()
    state.update((int(count.iloc[-1]), float(a.iloc[-1]), float(b.iloc[-1]), int(q.iloc[-1])))
    state.setTimeoutDuration(720 * 3_600_000)
    yield pd.DataFrame({"pair_key": key[0], "hand_id": rows.hand_id, "n": count, "soft_play": q / count, "transfer": b / (a.abs() + 1e-6)})


def running_pairs(pairs: DataFrame) -> DataFrame:
    """The memory of each pair after each of its hands, in the order of arrival; a pair that rests for 720 hours is forgotten.

    A pair's rows of one micro-batch come in Arrow batches; its state is four numbers.
    """
    return pairs.groupBy("pair_key").applyInPandasWithState(_remember, PAIR_OUT, PAIR_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def unruly_deliveries(events: DataFrame, ids: list[str], time: str, seed: int = 7, late: float = 0.1, twice: float = 0.1, most_seconds: int = 600) -> DataFrame:
    """Events as a bad network would deliver them, for tests: delivered_at, and delivery 1, or 2 of what comes twice.

    A share of events is late by up to most_seconds and a share comes twice, the second time later; which ones follows from hashes of ids and
    seed, so a run can be repeated. Sorting by delivered_at gives the order.
    """
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *ids), F.lit(1_000_003)) / 1_000_003.0
    delay = F.when(u("late") < late, u("by") * most_seconds).otherwise(u("jitter"))
    each = F.when(u("twice") < twice, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = events.withColumn("delivery", F.explode(each))
    micros = F.unix_micros(F.col(time).cast("timestamp")) + ((delay + (F.col("delivery") - 1) * u("again") * most_seconds) * 1e6).cast("long")
    return out.withColumn("delivered_at", F.timestamp_micros(micros))


def split_invalid(rules: dict[str, Column], valid_to: str, dead_to: str, topic: str, stage: str, key: str):
    """A function for foreachBatch: rows that keep the rules go to one folder as keyed JSON, the others to another as dead letters."""
    def process(batch: DataFrame, number: int) -> None:
        checked = validate(batch, rules).persist()
        good = checked.where(F.size("errors") == 0)
        good.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*batch.columns)).alias("value")).write.mode("overwrite").parquet(f"{valid_to}/batch={number}")
        bad = checked.where(F.size("errors") > 0)
        dead_letters(bad, topic, stage, F.to_json(F.struct(*batch.columns))).write.mode("overwrite").parquet(f"{dead_to}/batch={number}")
        checked.unpersist()

    return process


def union(streams: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
