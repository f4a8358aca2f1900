"""Streams over small files give what a batch over all rows gives."""

import json
import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideglass.operators import pairs
from tideglass.streaming import jobs, temporal

T0 = datetime(2026, 7, 21)
EVENT = "kind string, hand_id string, event_id string, user_id string, at timestamp, context_version int, device_id string, arrived long"


def write(folder, rows, n):
    folder.mkdir(exist_ok=True)
    file = folder / f"{n}.json"
    file.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))  # files are read in the order of their times


def stream(df, spark, name, tmp_path, mode="append"):
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a query keeps the number it starts with; few keys need no more
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    ends = time.time() + 120
    # with timeouts in processing time a query goes on with batches without rows
    while not q.awaitTermination(0.3) and time.time() < ends and not (len(q.recentProgress) > 3 and all(p["numInputRows"] == 0 for p in q.recentProgress[-3:])):
        pass
    q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.table(name)


def test_running_pairs_match_the_batch(spark, tmp_path):
    players = spark.createDataFrame([(h, p, float((h * p) % 7 - 3)) for h in range(12) for p in range(3)], "hand_id long, player_id long, won_amount double")
    rows = pairs.pair_rows(players).withColumn("pair_key", F.concat_ws("|", "player_a", "player_b"))
    for n in range(3):
        write(tmp_path / "in", [r.asDict() for r in rows.where(f"hand_id div 4 = {n}").collect()], n)
    schema = "hand_id long, pair_key string, won_amount_a double, won_amount_b double"
    got = stream(jobs.running_pairs(jobs.json_stream(spark, str(tmp_path / "in"), schema)), spark, "running", tmp_path)
    key = ["pair_key", "hand_id", "n", F.round("soft_play", 9), F.round("transfer", 9)]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, pairs.pair_memory(players).select(*key).collect()))


def test_windows_and_duplicates(spark, tmp_path):
    at = lambda s: (T0 + timedelta(seconds=s)).isoformat()
    write(tmp_path / "in", [{"id": "a", "t": at(0), "k": "x", "v": 1.0}, {"id": "a", "t": at(0), "k": "x", "v": 1.0}, {"id": "b", "t": at(50), "k": "x", "v": 2.0}], 0)
    write(tmp_path / "in", [{"id": "c", "t": at(200), "k": "x", "v": 4.0}], 1)
    write(tmp_path / "in", [{"id": "d", "t": at(201), "k": "x", "v": 4.0}], 2)  # rows are late by the watermark of the batch before
    write(tmp_path / "in", [{"id": "late", "t": at(1), "k": "x", "v": 9.0}], 3)
    events = jobs.json_stream(spark, str(tmp_path / "in"), "id string, t timestamp, k string, v double")
    once = stream(jobs.deduplicated(events, ["id"], "t"), spark, "once", tmp_path)
    assert sorted(r.id for r in once.collect())[:3] == ["a", "b", "c"]
    closed = stream(jobs.windowed(events, "t", ["k"], "1 minute", "v"), spark, "closed", tmp_path)
    assert [(r.n, r.total) for r in closed.orderBy("start").collect()][0] == (3, 4.0)


def test_dead_letters(spark, tmp_path):
    write(tmp_path / "in", [{"id": "a", "v": 1.0}, {"id": "b", "v": -1.0}], 0)
    events = jobs.json_stream(spark, str(tmp_path / "in"), "id string, v double")
    sink = jobs.split_invalid({"negative": F.col("v") < 0}, str(tmp_path / "ok"), str(tmp_path / "dead"), "t", "s", "id")
    events.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.key for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["a"]
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["negative"]


def at(seconds):
    return (T0 + timedelta(seconds=seconds)).isoformat()


def hand(h, user, s):
    return {"kind": "hand", "hand_id": h, "user_id": user, "at": at(s)}


def context(e, user, s, version=1, device="d"):
    return {"kind": "context", "event_id": e, "user_id": user, "at": at(s), "context_version": version, "device_id": device}


def joined(spark, tmp_path, batches, name):
    n = 0
    for i, b in enumerate(batches):
        for r in b:
            n += 1
            r["arrived"] = n
        write(tmp_path / f"in-{name}", b, i)
    return stream(temporal.context_join(jobs.json_stream(spark, str(tmp_path / f"in-{name}"), EVENT)), spark, name, tmp_path)


def test_context_join(spark, tmp_path):
    got = joined(spark, tmp_path, [
        [context("c1", "u1", -60), hand("h1", "u1", 0), hand("h2", "u2", 0)],
        [context("c2", "u2", -5)],  # late, before the deadline
        [hand("h3", "u3", 1), context("tick", "x", 40)],  # the watermark passes all three
        [context("tick2", "x", 41, 2)],
        [context("c3", "u3", -10)],  # corrects a missing one
        [context("c3", "u3", -10), hand("h1", "u1", 0), context("c9", "u1", -50)],  # repeated deliveries, and a version that is taken
        [context("far", "x", 2000, 3)],
        [context("far2", "x", 2001, 4)],
        [context("c4", "u1", -1, 2), hand("h4", "u2", 5)],  # beyond the horizon; a hand after its time is answered at once
    ], "joined")
    rows = sorted((r.hand_id or "", r.revision, r.status, r.context_event_id) for r in got.collect())
    assert rows == [("", 0, "conflict", "c9"), ("h1", 1, "matched", "c1"), ("h2", 1, "matched_late", "c2"), ("h3", 1, "missing", None), ("h3", 2, "corrected", "c3"), ("h4", 1, "matched", "c2")]


def test_replay_follows_event_time(spark, tmp_path):
    row = lambda h, s, a, b, revision=1: {"pair_key": "a|b", "hand_id": h, "revision": revision, "played_at": at(s), "won_amount_a": a, "won_amount_b": b}
    other = lambda s: {"pair_key": "x|y", "hand_id": 100 + s, "revision": 1, "played_at": at(s), "won_amount_a": 0.0, "won_amount_b": 0.0}
    for n, b in enumerate([[row(3, 30, 1.0, 1.0), row(1, 10, 2.0, -1.0)], [row(2, 20, 0.0, 4.0)], [other(60)], [other(61)], [row(2, 20, 9.0, 9.0, 2)], [other(62)]]):
        write(tmp_path / "in", b, n)
    schema = "pair_key string, hand_id long, revision int, played_at timestamp, won_amount_a double, won_amount_b double"
    got = stream(temporal.ordered_replay(jobs.json_stream(spark, str(tmp_path / "in"), schema)), spark, "replayed", tmp_path)
    rows = [(r.hand_id, r.revision, r.n, round(r.soft_play, 6), round(r.transfer, 4)) for r in got.where("pair_key = 'a|b'").collect()]
    # the second row came behind the first batch's watermark, and is still put in its place after what was emitted
    assert sorted(rows)[0][:3] == (1, 1, 1) and {r[2] for r in rows if r[1] == 1} == {1, 2, 3}
    assert [r[2:] for r in rows if r[0] == 2][0] == [r[2:] for r in rows if r[0] == 2][1]


def test_assembled_hands(spark, tmp_path):
    row = lambda h, p, s: {"hand_id": h, "pair_key": p, "num_players": 3, "score": s}
    for n, b in enumerate([[row("h", "a:b", 0.1), row("h", "a:b", 0.2), row("i", "a:b", 0.3)], [row("h", "a:c", 0.9), row("h", "b:c", 0.4)], [row("h", "a:b", 0.99)]]):
        write(tmp_path / "in", b, n)
    got = stream(temporal.assembled_hands(jobs.json_stream(spark, str(tmp_path / "in"), "hand_id string, pair_key string, num_players int, score double")), spark, "assembled", tmp_path)
    assert [tuple(r) for r in got.collect()] == [("h", 3, 0.9)]


def test_stream_with_memory(spark, tmp_path):
    write(tmp_path / "in", [{"hand_id": "h", "pair_key": "a:b"}, {"hand_id": "h", "pair_key": "a:c"}], 0)
    memory = spark.createDataFrame([("a:b", 4, 0.5)], "pair_key string, n long, soft_play double")
    got = stream(temporal.with_memory(jobs.json_stream(spark, str(tmp_path / "in"), "hand_id string, pair_key string"), memory), spark, "remembered", tmp_path)
    assert sorted((r.pair_key, r.memory_n) for r in got.collect()) == [("a:b", 4), ("a:c", None)]


def test_unruly_deliveries_can_be_repeated(spark):
    events = spark.range(400).select(F.col("id"), F.timestamp_seconds(F.lit(1_784_592_000) + F.col("id")).alias("t"))
    one, two = ([tuple(r) for r in jobs.unruly_deliveries(events, ["id"], "t").orderBy("delivered_at", "id", "delivery").collect()] for _ in range(2))
    ids = [r[0] for r in one]
    assert one == two and set(ids) == set(range(400)) and 400 < len(ids) < 500 and ids != sorted(ids) and all(r[3] >= r[1] for r in one)
