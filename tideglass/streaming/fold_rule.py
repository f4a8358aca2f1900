"""The rule of repeated folds over deliveries that are late, repeated, corrected or at odds, as keyed state.

A pair's state is the hands of its horizon, each with the latest revision that was taken. A correction takes its predecessor's place and the window is evaluated again.
The same state serves a stream and, read in the order of arrival, a table: one pass over a sorted shuffle with one pair's horizon in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideglass.streaming.temporal import ticked

SECOND, HOUR = 1_000_000, 3_600_000_000
OUT = "scope string, pair_key string, hand_id long, snapshot_revision int, arrived long, status string, window_hands int, direction string, fold_count int, fold_rate double, fired boolean"
NAMES = [c.split(" ")[0] for c in OUT.split(", ")]
#: Statuses whose delivery leaves no answer of the window.
SILENT = ("too_late", "stale", "too_late_correction", "conflict")


@dataclass(frozen=True)
class FoldRule:
    """The governed rule's window, horizon of corrections, lateness, and limits."""

    window_hours: int = 24
    correction_hours: int = 48
    lateness_seconds: int = 120
    min_hands: int = 5
    min_count: int = 3
    min_rate: float = 0.6
    strict: bool = True


class PairWindow:
    """One pair's hands within the horizon of its newest hand."""

    def __init__(self, rule: FoldRule, seen: dict | None = None, newest: int | None = None) -> None:
        self.rule, self.seen, self.newest = rule, seen or {}, newest
        self.least = min((o[0] for _, o in self.seen.values()), default=None)  # no hand is older

    def status(self, hand: int, revision: int, observed: tuple, mark: int | None) -> str:
        known = self.seen.get(hand)
        if known is None:
            late = mark is not None and observed[0] < mark - self.rule.lateness_seconds * SECOND
            return "too_late" if late else "accepted"
        if revision != known[0]:
            if revision < known[0]:
                return "stale"
            beyond = observed[0] < self.newest - self.rule.correction_hours * HOUR
            return "too_late_correction" if beyond else "corrected"
        return "duplicate" if observed == known[1] else "conflict"

    def take(self, hand: int, revision: int, observed: tuple, mark: int | None) -> tuple:
        """Status, hands of the window, direction, folds in it, their rate and whether the rule fires. observed: played (microseconds), a folds and b wins, b folds and a wins, event id."""
        status = self.status(hand, revision, observed, mark)
        if status == "conflict" and self.rule.strict:
            raise ValueError(f"hand {hand} has two contents of revision {revision}")
        if status in SILENT:
            return status, 0, None, 0, 0.0, False
        if status != "duplicate":
            self.seen[hand] = (revision, observed)
            self.newest = observed[0] if self.newest is None else max(self.newest, observed[0])
            oldest = self.newest - self.rule.correction_hours * HOUR
            self.least = observed[0] if self.least is None else min(self.least, observed[0])
            if self.least < oldest:
                for h in [h for h, (_, o) in self.seen.items() if o[0] < oldest]:
                    del self.seen[h]
                self.least = min((o[0] for _, o in self.seen.values()), default=None)
        end, n, a, b = observed[0], 0, 0, 0
        start = end - self.rule.window_hours * HOUR
        for _, o in self.seen.values():
            if start <= o[0] <= end:
                n, a, b = n + 1, a + o[1], b + o[2]
        most = max(a, b)
        rate = round(most / n, 9) if n else 0.0
        fired = n >= self.rule.min_hands and most >= self.rule.min_count and rate >= self.rule.min_rate
        return status, n, "a" if a >= b else "b", most, rate, fired


def _observed(r: object) -> tuple:
    return int(r.played), bool(r.a_fold_b_win), bool(r.b_fold_a_win), r.event_id


class _Rule(StatefulProcessor):
    def __init__(self, rule: FoldRule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hands = handle.getMapState("hands", "hand_id long", "revision int, played long, a boolean, b boolean, event_id string")
        self.newest = handle.getValueState("newest", "played long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows))
        data = data[data["data"].astype(bool)].sort_values("arrived")
        if data.empty:
            return
        kept = {k[0]: (v[0], tuple(v[1:])) for k, v in self.hands.iterator()}
        window = PairWindow(self.rule, dict(kept), self.newest.get()[0] if self.newest.exists() else None)
        mark = timerValues.getCurrentWatermarkInMs()
        out = []
        for r in data.itertuples():
            out.append((*key, r.hand_id, r.snapshot_revision, r.arrived, *window.take(int(r.hand_id), int(r.snapshot_revision), _observed(r), mark * 1000 if mark > 0 else None)))
        for hand in kept.keys() - window.seen.keys():
            self.hands.removeKey((hand,))
        for hand, (revision, observed) in window.seen.items():
            if kept.get(hand) != (revision, observed):
                self.hands.updateValue((hand,), (revision, *observed))
        if window.newest is not None:
            self.newest.update((window.newest,))
            self.handle.registerTimer(self._ends(window.newest))
        yield pd.DataFrame(out, columns=NAMES)

    def _ends(self, newest: int) -> int:
        """From then on all that is not too late would make the whole state too old."""
        return (newest + self.rule.correction_hours * HOUR + self.rule.lateness_seconds * SECOND) // 1000 + 1

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists() and self._ends(self.newest.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.hands.clear()
            self.newest.clear()
        return iter(())


def fold_stream(deliveries: DataFrame, rule: FoldRule | None = None) -> DataFrame:
    """Each delivery of a stream with its status and what the rule says of the window that ends with its hand.

    deliveries: scope, pair_key, hand_id, snapshot_revision, played_at, a_fold_b_win, b_fold_a_win, event_id, arrived. accepted: a hand that is not known. too_late: such a one,
    played lateness_seconds before the watermark; it is not kept. stale: an older revision than the one that is kept. duplicate: the same with the same content. conflict: the
    same with other content; strict makes it an error, else such rows can be made dead letters. corrected: a newer one, which takes its place, unless it is played
    correction_hours before the pair's newest hand (too_late_correction). Hands older than that horizon are forgotten, and a pair as a whole once the watermark is past it.
    Within a micro-batch deliveries go by `arrived`, and the watermark is that of the batch before.
    """
    rows = ticked(deliveries.withColumn("played", F.unix_micros(F.col("played_at").cast("timestamp"))), "played_at")
    return rows.groupBy("scope", "pair_key").transformWithStateInPandas(_Rule(rule or FoldRule()), OUT, "append", "EventTime")


def fold_replay(deliveries: DataFrame, rule: FoldRule | None = None) -> DataFrame:
    """The same over a table, by the order of `arrived` within each pair; `watermark` (null: none) is a column, what the watermark was on arrival.

    One pass over rows sorted by pair and arrival: a pair's rows are read one after the other, as each answer hangs on the one before, with its horizon in memory. Rows without
    a pair, hand or time belong to no state and are left out.
    """
    rule, columns = rule or FoldRule(), ["scope", "pair_key", "hand_id", "snapshot_revision", "arrived", "a_fold_b_win", "b_fold_a_win", "event_id"]

    names = ("hand_id", "snapshot_revision", "mark", "played", "a_fold_b_win", "b_fold_a_win", "event_id")
    answer = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.bool_()]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, window = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            scope, pair = batch.column("scope"), batch.column("pair_key")
            other = pc.or_(pc.not_equal(scope[1:], scope[:-1]), pc.not_equal(pair[1:], pair[:-1])).to_pylist()
            other.insert(0, last != (scope[0].as_py(), pair[0].as_py()))
            last, out = (scope[-1].as_py(), pair[-1].as_py()), []
            for new, hand, revision, mark, *observed in zip(other, *(batch.column(c).to_pylist() for c in names), strict=True):
                if new:
                    window = PairWindow(rule)
                out.append(window.take(hand, revision, tuple(observed), mark))
            keys = [batch.column(c) for c in NAMES[:5]]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), answer, strict=True))], NAMES)

    rows = deliveries.where("scope is not null and pair_key is not null and hand_id is not null and played_at is not null")
    rows = rows.select(*columns, F.unix_micros(F.col("played_at").cast("timestamp")).alias("played"), F.unix_micros(F.col("watermark").cast("timestamp")).alias("mark"))
    rows = rows.fillna(False, subset=["a_fold_b_win", "b_fold_a_win"])
    return rows.repartition("scope", "pair_key").sortWithinPartitions("scope", "pair_key", "arrived").mapInArrow(replay, OUT)
