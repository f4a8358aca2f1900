"""Running aggregates in slices of time, the graph before each hand, and the fold rule over deliveries, against plain replays."""

import collections
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import at, stream, write
from tideglass.operators import slices, temporal_graph
from tideglass.streaming import fold_rule, jobs

T0 = datetime(2026, 7, 21)


@pytest.fixture
def ranges(spark):
    """Sorts into several ranges, however small the tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_aggregates_of_a_hot_key(ranges):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", None, "a", "b"]), i, r.choice([None, r.randrange(9)])) for i in range(600)]
    df = ranges.createDataFrame(rows, "k string, t int, v long").repartition(5)
    out = slices.before(df, ["k"], [F.col("t")], sums={"n": F.lit(1)}, lasts={"last": F.col("v")})
    assert out.count() == 600
    seen, want = collections.defaultdict(lambda: [None, None]), {}
    for k, t, v in rows:
        want[t] = tuple(seen[k])
        seen[k] = [(seen[k][0] or 0) + 1, v if v is not None else seen[k][1]]
    assert {x.t: (x.n, x["last"]) for x in out.collect()} == want
    assert slices.before(df.limit(0), ["k"], [F.col("t")], sums={"n": F.lit(1)}).count() == 0


def plain_graph(hands, contexts, sessions, links):
    """The features of each (hand, pair) by a replay of the whole past, one hand at a time."""
    out = {}
    for h, table, t, players in hands:
        past = [x for x in hands if x[2] < t]
        met = collections.defaultdict(set)
        for _, _, _, ps in past:
            for a in ps:
                met[a] |= set(ps) - {a}
        state = lambda rows, u: max((x for x in rows if x[0] == u and x[1] < t), key=lambda x: x[1:3], default=None)
        now = {u: state(contexts, u) for u in {c[0] for c in contexts}}
        tables = lambda u: {x[1] for x in sorted((x for x in past if u in x[3]), key=lambda x: (x[2], x[0]))[-16:]}
        for a in players:
            for b in (p for p in players if p > a):
                together = [x[2] for x in past if a in x[3] and b in x[3]]
                left, right = met[a] - {b}, met[b] - {a}
                ca, cb, sa, sb = now.get(a), now.get(b), state(sessions, a), state(sessions, b)
                same = [bool(ca and cb and ca[k] is not None and ca[k] == cb[k]) for k in (3, 4)]
                shared = sum(sum(1 for c in now.values() if c and c[k] == ca[k]) for k, s in zip((3, 4), same, strict=True) if s)
                out[h, a, b] = (
                    math.log1p(len(together)), math.log1p((t - max(together)).total_seconds() / 60) if together else 0.0, len(left & right) / max(1, len(left | right)), *same,
                    bool(sa and sb and sa[2] == sb[2]), math.log1p(len(tables(a) & tables(b))), any({x[0], x[1]} == {a, b} and x[2] < t for x in links), math.log1p(shared),
                )
    return out


@pytest.mark.parametrize("dense", [False, True])
def test_graph_before_each_hand(ranges, dense, monkeypatch):
    monkeypatch.setattr(temporal_graph, "BLOCK", 40)  # several groups of few players
    monkeypatch.setattr(temporal_graph, "QUERIES", 20)
    r = random.Random(3)
    when = lambda n: T0 + timedelta(hours=r.randrange(n))
    hands = [(h, r.randrange(6), when(40), sorted(r.sample(range(12), r.randrange(2, 5)))) for h in range(60)]
    contexts = [(u, when(40), v, r.choice([None, 1, 2]), r.randrange(2)) for v, u in enumerate([*range(11)] * 3)]
    sessions = [(r.randrange(12), when(40), s % 4) for s in range(30)]
    links = [(r.randrange(12), r.randrange(12), when(40)) for _ in range(10)]
    pairs_ = [(h, tb, t, a, b) for h, tb, t, ps in hands for a in ps for b in ps if a < b]
    p = ranges.createDataFrame([*pairs_, pairs_[0], (None, 1, T0, 1, 2), (99, 1, None, 1, 2)], "hand_id long, table_id long, played_at timestamp, player_a long, player_b long").withColumn("common", F.lit("clash"))
    c = ranges.createDataFrame(contexts, "user_id long, effective_at timestamp, context_version int, device_id long, network_id long")
    s = ranges.createDataFrame(sessions, "user_id long, started_at timestamp, session_id long")
    k = ranges.createDataFrame([*links, (None, 1, T0)], "user_id long, other_user_id long, linked_at timestamp")
    names = ["log_hands", "log_minutes", "jaccard", "same_device", "same_network", "same_session", "log_tables", "direct_link", "log_shared"]
    want = plain_graph(hands, contexts, sessions, links)
    got = {(x.hand_id, x.player_a, x.player_b): tuple(x[n] for n in names) for x in temporal_graph.pair_features(p, c, s, k, dense).collect()}
    assert got.keys() == want.keys()
    for key, v in want.items():
        assert got[key] == pytest.approx(v, abs=1e-9), key


def test_graph_of_nothing(spark):
    p = spark.createDataFrame([], "hand_id long, table_id long, played_at timestamp, player_a long, player_b long")
    c = spark.createDataFrame([(1, T0, 1, 1, 1)], "user_id long, effective_at timestamp, context_version int, device_id long, network_id long")
    s, k = spark.createDataFrame([], "user_id long, started_at timestamp, session_id long"), spark.createDataFrame([], "user_id long, other_user_id long, linked_at timestamp")
    assert temporal_graph.pair_features(p, c, s, k).count() == 0


def delivery(n, hand, revision, hours, ab=True, ba=False, event=None, pair="a:b"):
    return {"scope": "s", "pair_key": pair, "hand_id": hand, "snapshot_revision": revision, "played_at": at(3600 * hours), "a_fold_b_win": ab, "b_fold_a_win": ba, "event_id": event or f"{hand}-{revision}", "arrived": n}


DELIVERY = "scope string, pair_key string, hand_id long, snapshot_revision int, played_at timestamp, a_fold_b_win boolean, b_fold_a_win boolean, event_id string, arrived long"


def test_fold_rule_statuses(spark):
    """Worked by hand: each line is one delivery, with the watermark in hours and what is to come of it."""
    steps = [
        (1, 1, 0, None, "accepted", 1), (1, 1, 0, None, "duplicate", 1), (2, 1, 1, None, "accepted", 2), (1, 2, 0, None, "corrected", 1), (1, 1, 0, None, "stale", 0),
        (3, 1, -72, 0, "too_late", 0), (3, 1, -72, 0, "too_late", 0),  # what is too late is not known the second time either
        (4, 1, 40, None, "accepted", 1), (4, 2, 40, 89, "corrected", 1),  # the horizon runs from the pair's newest hand, whatever the watermark is
        (4, 3, -20, 89, "too_late_correction", 0), (5, 1, 60, None, "accepted", 2), (1, 3, 0, None, "accepted", 0),  # a forgotten hand is new, and forgotten again
    ]
    rows = [delivery(i, h, rev, t) | {"watermark": None if w is None else at(3600 * w)} for i, (h, rev, t, w, *_) in enumerate(steps)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], DELIVERY.replace("played_at timestamp", "played_at string") + ", watermark string")
    got = [(r.status, r.window_hands) for r in fold_rule.fold_replay(df).orderBy("arrived").collect()]
    assert got == [tuple(s[4:]) for s in steps]


def test_fold_rule_fires_and_a_correction_takes_it_back(spark):
    rows = [delivery(i, i, 1, i, ab=i != 2) for i in range(5)] + [delivery(5, 4, 2, 4, ab=False, ba=True), delivery(6, 1, 2, 1, ab=False), delivery(7, 4, 3, 4, ab=False, ba=True)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], DELIVERY.replace("played_at timestamp", "played_at string")).withColumn("watermark", F.lit(None).cast("timestamp"))
    got = [(r.status, r.window_hands, r.direction, r.fold_count, r.fold_rate, r.fired) for r in fold_rule.fold_replay(df).orderBy("arrived").collect()]
    assert got[4] == ("accepted", 5, "a", 4, 0.8, True) and got[5] == ("corrected", 5, "a", 3, 0.6, True) and got[7] == ("corrected", 5, "a", 2, 0.4, False)


def test_equal_revisions_with_other_content(spark):
    rows = [delivery(0, 1, 1, 0), delivery(1, 1, 1, 0, event="other"), delivery(2, 1, 1, 0, ab=False)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], DELIVERY.replace("played_at timestamp", "played_at string")).withColumn("watermark", F.lit(None).cast("timestamp"))
    assert [r.status for r in fold_rule.fold_replay(df, fold_rule.FoldRule(strict=False)).orderBy("arrived").collect()] == ["accepted", "conflict", "conflict"]
    with pytest.raises(Exception, match="two contents"):
        fold_rule.fold_replay(df).collect()


def test_fold_stream_equals_the_replay(spark, tmp_path):
    r = random.Random(9)
    batches, n = [], 0
    for b in range(4):
        rows = []
        for _ in range(25):
            hand, revision = r.randrange(18), r.choice([1, 1, 2, 3])
            hours = hand * 4
            rows.append(delivery(n, hand, revision, hours, ab=(hand + revision) % 3 > 0, ba=hand % 4 == 0, pair=r.choice(["a:b", "a:c"])))
            n += 1
        batches.append([x for x in rows if x["hand_id"] // 6 <= b])
        write(tmp_path / "in", batches[-1], b)
    got = stream(fold_rule.fold_stream(jobs.json_stream(spark, str(tmp_path / "in"), DELIVERY)), spark, "folds", tmp_path)
    newest, rows = None, []
    for b in batches:  # the watermark of a batch is the newest time of those before it
        rows += [x | {"watermark": newest} for x in b]
        newest = max([x["played_at"] for x in b] + ([newest] if newest else []))
    df = spark.createDataFrame([tuple(x.values()) for x in rows], DELIVERY.replace("played_at timestamp", "played_at string") + ", watermark string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fold_rule.fold_replay(df).collect())) and {x.status for x in got.collect()} == {"accepted", "duplicate", "stale", "corrected", "too_late"}


def test_recent_items_of_a_hot_key(ranges):
    """The last distinct items at strictly earlier times, over several ranges of one key."""
    r = random.Random(4)
    events = [(r.choice([1, 1, 1, 2]), T0 + timedelta(minutes=r.randrange(200)), r.randrange(12), r.randrange(100)) for _ in range(400)]
    last = {}
    for u, t, v, x in events:
        last[u, t, v] = x
    events = [(*k, x) for k, x in last.items()]
    moments = [(u, T0 + timedelta(minutes=m)) for u in (1, 2, 3) for m in range(0, 220, 3)]
    df = ranges.createDataFrame(events, "u long, t timestamp, v long, x long").repartition(3)
    got = temporal_graph.recent(ranges.createDataFrame([*moments, (None, T0), (1, None)], "u long, t timestamp"), df, 4)
    want = {}
    for u, t in moments:
        seen = {}
        for _, t2, v, x in sorted((e for e in events if e[0] == u and e[1] < t), key=lambda e: e[1]):
            seen[v] = (t2, v, x)
        want[u, t] = sorted(seen.values(), reverse=True, key=lambda s: s[:2])[:4]
    assert {(m.u, m.t): [tuple(x) for x in m.tops] for m in got.collect()} == want


def test_bootstrap_of_rankings_against_a_plain_form(ranges):
    """Ties over several ranges, an empty replicate's worth of weights and a budget that ends within a tie."""
    import numpy as np

    from tideglass.operators import resampling

    r = random.Random(8)
    rows = [(f"h{r.randrange(9)}", i, r.randrange(2), r.choice([0.9, 0.5, 0.5, 0.5, 0.1, round(r.random(), 2)]), r.random() < 0.3) for i in range(300)]
    df = ranges.createDataFrame([*rows, ("h1", 999, None, 0.5, True), (None, 998, 1, 0.5, True)], "hand_id string, row_id int, label int, score double, fired boolean").repartition(4)
    got = {x.replicate: x for x in resampling.replicate_metrics(df, 10, 3, max_alert_rate=0.2).collect()}
    hands = sorted({x[0] for x in rows})
    draws = dict(zip(hands, resampling.weights_of(hands, 10, 3), strict=True))
    for k in range(10):
        ordered = sorted(rows, key=lambda x: (-x[3], x[1]))
        w, y, s = np.array([draws[x[0]][k] for x in ordered], float), np.array([x[2] for x in ordered], float), np.array([x[3] for x in ordered])
        f = np.array([x[4] for x in ordered], float)
        pr = sum(w[s == v] @ y[s == v] * (w[s >= v] @ y[s >= v]) / w[s >= v].sum() for v in set(s) if w[s >= v].sum()) / (w @ y)
        roc = sum(w[s == v] @ y[s == v] * (w[s < v] @ (1 - y[s < v]) + 0.5 * w[s == v] @ (1 - y[s == v])) for v in set(s)) / ((w @ y) * (w @ (1 - y)))
        chosen = np.clip(max(1, int(w.sum() * 0.2)) - (np.cumsum(w) - w), 0, w)
        want = {"pr_auc": pr, "roc_auc": roc, "brier_score": w @ (s - y) ** 2 / w.sum(), "precision": w @ (y * f) / (w @ f), "recall": w @ (y * f) / (w @ y), "recall_at_alert_budget": chosen @ y / (w @ y), "precision_at_alert_budget": chosen @ y / chosen.sum(), "false_positives_per_1000_hands": w @ (f * (1 - y)) * 1000 / len(hands)}
        for name, v in want.items():
            assert got[k][name] == pytest.approx(v), name
    assert resampling.replicate_metrics(df.limit(0), 10).count() == 0


def test_quantiles_against_numpy(ranges):
    import numpy as np

    from tideglass.operators import quantiles

    r = random.Random(6)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.choice([1.0, 1.0, round(r.gauss(0, 3), 2), None])) for _ in range(500)] + [("none", None), ("one", 4.0)]
    df = ranges.createDataFrame(rows, "k string, v double").repartition(4)
    at_ = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {x.k: x.q for x in quantiles.quantiles(df, F.col("v"), at_, ["k"]).collect()}
    groups = {k: [v for g, v in rows if g == k and v is not None] for k in {k for k, _ in rows}}
    assert got.keys() == {k for k, v in groups.items() if v}
    assert all(got[k] == pytest.approx(np.quantile(v, at_).tolist()) for k, v in groups.items() if v)
    assert quantiles.quantiles(df, F.col("v"), [0.5]).first().q == pytest.approx([np.median([v for _, v in rows if v is not None])])
    assert quantiles.of_columns(df.limit(0), {"a": F.col("v")}, [0.5]) == {"a": [None]} and quantiles.quantiles(df.limit(0), F.col("v"), [0.5]).count() == 0


def test_common_neighbours_both_ways(ranges):
    from tideglass.operators import graph

    r = random.Random(5)
    edges = sorted({tuple(sorted(r.sample(range(150), 2))) for _ in range(900)} | {(0, k) for k in range(1, 150)})
    df = ranges.createDataFrame([*edges, edges[0]], "player_a long, player_b long")
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {(a, b): (len(near[a] & near[b]), round(len(near[a] & near[b]) / max(1, len((near[a] | near[b]) - {a, b})), 9)) for a, b in edges}
    for dense in (False, True, None):
        assert {(x.player_a, x.player_b): (x.shared, round(x.jaccard, 9)) for x in graph.coplayer_jaccard(df, dense).collect()} == want


@pytest.mark.parametrize("most", [100, 100_000])
def test_few_hot_keys_among_others(ranges, monkeypatch, most):
    """Keys of hot buckets go by ranges, the others by one exchange; both give the same."""
    monkeypatch.setattr(slices, "HOT", most)
    r = random.Random(4)
    rows = [(r.choice([None, "hot", "hot", "hot", *"abcdefgh"]), i % 40, i, r.choice([None, r.randrange(9)])) for i in range(700)]
    df = ranges.createDataFrame(rows, "k string, g int, t int, v long").repartition(5)
    hot = slices.hot_buckets(df, ["k"])
    assert len(hot) == (most == 100)
    out = slices.before(df, ["k"], [F.col("t")], sums={"n": F.lit(1)}, lasts={"last": F.col("v")}, hot=hot)
    seen, want = collections.defaultdict(lambda: [None, None]), {}
    for k, _, t, v in rows:
        want[t] = tuple(seen[k])
        seen[k] = [(seen[k][0] or 0) + 1, v if v is not None else seen[k][1]]
    assert {x.t: (x.n, x["last"]) for x in out.collect()} == want


def test_histories_take_one_exchange_of_the_pairs(ranges, monkeypatch):
    from tideglass.operators import history

    r = random.Random(5)
    rows = [(i, 1 + i % 3, 5 + i % 2, r.randrange(3), T0 + timedelta(days=r.randrange(40)), float(r.randrange(4)), float(r.randrange(4)), *(r.random() < 0.5 for _ in range(3))) for i in range(200)]
    df = ranges.createDataFrame(rows, "hand_id long, player_a long, player_b long, table_id long, played_at timestamp, won_amount_a double, won_amount_b double, a_fold_b_win boolean, b_fold_a_win boolean, both_saw_flop boolean")
    out = history.pair_history(df, ("player_a", "player_b"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
    got = {x.hand_id: (x.pair_hands, x.same_table_rate, x.a_fold_b_win_rate) for x in out.collect()}
    monkeypatch.setattr(slices, "HOT", 10)
    assert got == {x.hand_id: (x.pair_hands, x.same_table_rate, x.a_fold_b_win_rate) for x in history.pair_history(df, ("player_a", "player_b")).collect()}
    for h, a, b, t, at, *_ in rows:
        before = [x for x in rows if x[1:3] == (a, b) and (x[4], x[0]) < (at, h)]
        assert got[h][:2] == (len(before), round(sum(x[3] == t for x in before) / max(1, len(before)), 9))


@pytest.mark.parametrize("peers", ["order", "all"])
def test_fold_windows_of_hot_and_other_pairs(ranges, monkeypatch, peers):
    from tideglass.operators import history

    r = random.Random(6)
    rows = [(i, r.choice(["hot", "hot", "b", "c"]), T0 + timedelta(hours=r.randrange(90)), r.random() < 0.6, r.random() < 0.3) for i in range(120)]
    df = ranges.createDataFrame(rows, "hand_id long, pair_key string, played_at timestamp, a_fold_b_win boolean, b_fold_a_win boolean")
    out = history.fold_rule(df, hours=24, peers=peers)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
    of = lambda d: {x.hand_id: (x.window_n, x.window_a, x.window_b) for x in d.collect()}
    got = of(out)
    for h, k, at, *_ in rows:
        inside = [x for x in rows if x[1] == k and at - timedelta(hours=24) <= x[2] <= at and (peers == "all" or (x[2], x[0]) <= (at, h))]
        assert got[h] == (len(inside), sum(x[3] for x in inside), sum(x[4] for x in inside))
    monkeypatch.setattr(slices, "HOT", 40)
    assert of(history.fold_rule(df, hours=24, peers=peers)) == got
