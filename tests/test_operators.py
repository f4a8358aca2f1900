"""Operators on small inputs with values worked out by hand."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideglass.operators import datasets, features, graph, history, metrics, order, pairs, patterns, rules, splits
from tideglass.sources import cdc, files, loads

T0 = datetime(2026, 7, 21)


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_hole_cards(spark):
    df = spark.createDataFrame([("As Kd",), ("7h 7c",), (None,), ("Ah",)], "c string")
    f = features.hole_features(F.col("c"))
    got = rows(df.select(*[v.alias(k) for k, v in f.items()]), "rank1", "gap", "is_pair", "is_suited", F.round("hand_strength", 6))
    assert got == [(12.0, 1.0, 0.0, 0.0, 0.988333), (5.0, 0.0, 1.0, 0.0, round(10 / 24 + 0.28, 6)), (0.0,) * 5, (0.0,) * 5]


def test_pair_memory(spark):
    players = spark.createDataFrame([(1, 1, -10.0), (1, 2, 10.0), (2, 2, 15.0), (2, 1, -15.0)], "hand_id long, player_id long, won_amount double")
    m = pairs.pair_memory(players).orderBy("hand_id").collect()
    assert [(r.pair_key, r.n, r.soft_play) for r in m] == [("1|2", 1, 1.0), ("1|2", 2, 1.0)] and m[1].memory_score > 0.5
    assert rows(pairs.most_recent_pairs(pairs.pair_memory(players), 1), "pair_key") == [("1|2",)]


def test_action_patterns(spark):
    acts = [("p1", "preflop", "raise", 6.0), ("p2", "preflop", "call", 6.0), ("p3", "preflop", "raise", 18.0), ("p2", "preflop", "fold", 0.0), ("p1", "flop", "check", 0.0), ("p3", "flop", "check", 0.0)]
    df = spark.createDataFrame([("h", p, i + 1, s, k, a) for i, (p, s, k, a) in enumerate(acts)], "hand_id string, player_id string, sequence_no long, street string, action_type string, amount double")
    assert {r.pattern for r in patterns.action_patterns(df).collect()} == {"preflop_squeeze", "raise_fold_benefit", "call_down_transfer", "soft_play_passive_chain"}


def test_rules_only_score(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.4, 0.25, 0.75)], "one_folded_other_won int, same_device int, same_network int, outcome_asymmetry double, a_fold_b_win_rate double, b_fold_a_win_rate double")
    assert rows(df, F.round(rules.rules_only_score(), 9)) == [(0.8475,)]
    got = rows(rules.rule_evidence(df.withColumn("k", F.lit(1)), ["k"]), "raw_score")
    assert sorted(x for (x,) in got) == [25.0, 40.0, 75.0, 100.0, 100.0, 100.0]
    bad = df.withColumn("outcome_asymmetry", F.lit(1.5))
    with pytest.raises(Exception, match=r"must be in \[0, 1\]"):
        rules.rule_evidence(bad.withColumn("k", F.lit(1)), ["k"]).collect()


def test_fold_rule(spark):
    hands = [(f"h{i}", "a:b", T0 + timedelta(hours=i), x, False) for i, x in enumerate((True, True, True, False, False, True))]
    df = spark.createDataFrame(hands, "hand_id string, pair_key string, played_at timestamp, a_fold_b_win boolean, b_fold_a_win boolean")
    got = rows(history.fold_rule(df).orderBy("hand_id"), "window_n", "fold_count", "fold_rate", "fired")
    assert [g[3] for g in got] == [False, False, False, False, True, True]
    assert got[2] == (3, 3, 1.0, False) and got[4] == (5, 3, 0.6, True) and got[5] == (6, 4, 0.666666667, True)


def test_evidence_ids(spark):
    at_ = datetime(2026, 7, 21, 1, 2, 3, 45)
    df = spark.createDataFrame([("a:b", "h1", "pair.same-device", 1, at_), ("a:b", "h1", "pair.same-device", 2, at_), ("a:b", None, "pair.same-device", 1, at_)], "entity_key string, hand_id string, rule_id string, rule_version int, effective_at timestamp")
    fixed = {"tenant_id": "t", "product_id": "p", "dataset_id": "d", "dataset_split": "test", "entity_type": "pair", "feature_definition_version": "v1"}
    got = rows(rules.identified(df, {k: F.lit(v) for k, v in fixed.items()} | {k: F.col(k) for k in ("entity_key", "hand_id", "effective_at")}), "rule_event_id")
    name = lambda version: str(uuid.uuid5(uuid.NAMESPACE_URL, "\x1f".join(("t", "p", "d", "test", "pair.same-device", version, "pair", "a:b", "h1", "1", "2026-07-21T01:02:03.000045Z", "v1"))))
    assert [x for (x,) in got] == [name("1"), name("2"), None]


@pytest.mark.parametrize("n, want", [(3, "tve"), (4, "ttve"), (6, "ttttve"), (7, "ttttvee"), (20, "t" * 14 + "vvv" + "eee")])
def test_small_splits_have_all_parts(spark, n, want):
    df = spark.createDataFrame([(i, T0 + timedelta(hours=i)) for i in range(n)], "hand_id int, played_at timestamp")
    part = {"train": "t", "validation": "v", "test": "e"}
    assert "".join(part[s] for _, s in sorted(rows(splits.temporal_split(df), "index", "split"))) == want


def test_a_split_takes_three_hands(spark):
    df = spark.createDataFrame([(i, T0) for i in range(2)], "hand_id int, played_at timestamp")
    for split in (splits.temporal_split, splits.boundary_split):
        with pytest.raises(Exception, match="three hands"):
            split(df).collect()
        assert split(df.limit(0)).count() == 0
    four = spark.createDataFrame([(i, T0) for i in range(4)], df.schema)
    assert [s for _, s in sorted(rows(splits.boundary_split(four), "index", "split"))] == ["train", "train", "validation", "test"]


def test_as_of_takes_the_latest_version(spark):
    versions = spark.createDataFrame([("u", 1, T0 - timedelta(hours=2), "e1"), ("u", 3, T0 - timedelta(hours=1), "e3"), ("u", 2, T0 + timedelta(hours=1), "e2")], "user_id string, context_version int, effective_at timestamp, event_id string")
    hands = spark.createDataFrame([("h", "u", T0), ("i", "u", T0 - timedelta(hours=1)), ("j", "v", T0), ("k", None, T0)], "hand_id string, user_id string, at timestamp")
    take = lambda strict: dict(rows(history.as_of(hands, versions, "user_id", "at", "effective_at", ("context_version", "event_id"), strict), "hand_id", "ctx_context_version"))
    assert take(False) == {"h": 3, "i": 3, "j": None, "k": None}
    assert take(True) == {"h": 3, "i": 1, "j": None, "k": None}


def test_equal_times_do_not_see_each_other(spark):
    df = spark.createDataFrame([("u", T0, 1), ("u", T0, 2), ("u", T0 + timedelta(seconds=1), 3)], "k string, t timestamp, id long")
    assert dict(rows(history.last_n(df, "k", "t", "id", 2), "id", "history")) == {1: [], 2: [], 3: [1, 2]}
    seen = history.prior(df, ["k"], "t", "id", {"n": F.count(F.lit(1))}, ties="isolated")
    assert dict(rows(seen, "id", "n")) == {1: 0, 2: 0, 3: 2}


def test_rule_counts_and_bootstrap(spark):
    df = spark.createDataFrame([(h, y, f) for h in range(20) for y, f in ((1, True), (0, True), (0, False))], "hand_id long, label int, fired boolean")
    r = metrics.rule_counts(df).first()
    assert (r.precision, r.recall, r.hands) == (0.5, 1.0, 20)
    b = metrics.bootstrap(df, 50).first()
    assert b.precision_low == b.precision_high == 0.5 and b.recall_mid == 1.0
    none = metrics.rule_counts(df.withColumns({"label": F.lit(0), "fired": F.lit(False)})).first()
    assert none.precision == 0.0 and none.recall is None


def test_drift(spark):
    a = spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit("a").alias("c"))
    assert metrics.psi(a, a, "x", 5).first()[0] == pytest.approx(0, abs=1e-12)
    b = a.select((F.col("x") + 1000).alias("x"), F.lit("b").alias("c"))
    assert metrics.psi(a, b, "x", 5).first()[0] > 0.25 and metrics.tvd(a, b, "c").first()[0] == 1.0


def test_ranking_metrics_without_positives(spark):
    r = metrics.ranking_metrics(spark.createDataFrame([(0, 0.5)], "label int, score double")).first()
    assert r.pr_auc is None and r.roc_auc is None and r.brier == 0.25


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert dict(rows(splits.components(e), "node", "component")) == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_splits_keep_rows_without_a_time(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else T0 + timedelta(hours=9 * i)) for i in range(20)], "hand_id int, played_at timestamp")
    got = dict(rows(splits.temporal_split(df), "hand_id", "index"))
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [*[i for i in range(20) if i % 4], *range(0, 20, 4)] and sorted(got.values()) == list(range(20))


def test_review(spark):
    s = spark.createDataFrame([(1, False), (2, True), (3, False)], "k int, above boolean")
    e = spark.createDataFrame([(1, "soft"), (3, "hard")], "k int, rule_id string")
    p = spark.createDataFrame([("soft", "soft"), ("hard", "hard")], "rule_id string, category string")
    got = {r.k: (r.outcome, r.reasons) for r in rules.review(s, e, p, ["k"]).collect()}
    assert got == {1: ("no_review", ""), 2: ("review_recommended", "model-threshold"), 3: ("mandatory_review", "hard-rule.hard.v1")}
    with pytest.raises(Exception, match="ungoverned"):
        rules.review(s, spark.createDataFrame([(1, "x")], "k int, rule_id string"), p, ["k"]).collect()


def test_loads(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    up = loads.upsert(old, new, ["k"])
    assert sorted(rows(up, "k", "v")) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(rows(loads.upsert(up, new, ["k"]), "k", "v")) == sorted(rows(up, "k", "v"))
    assert sorted(rows(loads.insert_if_absent(old, new, ["k"]), "k", "v")) == [(1, "a"), (2, "b"), (3, "d")]
    assert dict(rows(loads.insert_status(old, spark.createDataFrame([(1, "a"), (2, "x"), (3, "y")], "k int, v string"), "k", "v"), "k", "status")) == {1: "duplicate", 2: "collision", 3: "inserted"}
    links = spark.createDataFrame([(1, "r1"), (1, "r2"), (2, "r3")], "s int, r string")
    lists = spark.createDataFrame([(1, ["r2", "r4"])], "s int, r array<string>")
    assert sorted(rows(loads.replace_references(links, lists, "s", "r"), "s", "r")) == [(1, "r2"), (1, "r4"), (2, "r3")]
    with pytest.raises(Exception, match="repeated key"):
        loads.compare(old.unionAll(old), new, "k").collect()


def test_change_records(spark):
    df = spark.createDataFrame([(None,), ('{"op": "d"}',), ('{"op": "c", "after": {"id": "1"}, "source": {"txId": 1, "table": "other"}}',), ('{"op": "c", "source": {"txId": 1, "table": "other"}}',)], "value string")
    assert [r for (r,) in rows(cdc.adapt(df, ("json-v1",), "ml_outbox"), "reject")] == ["tombstone", "operation", "source", "after_image"]


def change(after, op="c", **source):
    import base64
    import hashlib
    import json

    raw = json.dumps(after.pop("hand")).encode()
    row = {"id": "1", "tenant_id": "t", "game_type": "g", "aggregate_id": "h", "codec_version": "json-v1", "payload": base64.b64encode(raw).decode(), "payload_sha256": hashlib.sha256(raw).hexdigest(), "dataset_split": "train", "occurred_at": "2026-07-21T00:00:00Z"} | after
    return json.dumps({"op": op, "after": row, "source": {"db": "d", "schema": "public", "table": "ml_outbox", "txId": 5} | source})


def test_change_records_agree_with_their_hands(spark):
    hand = {"hand_id": "h", "dataset_split": "train", "played_at": "2026-07-21T00:00:00Z"}
    cases = {
        change({"hand": hand}): None, f'{{"schema": {{}}, "payload": {change({"hand": hand})}}}': None, '{"schema": {}, "payload": null}': "tombstone", change({"hand": hand}, op="u"): "operation",
        change({"hand": hand}, op="r"): "snapshot", change({"hand": hand}, op="r", snapshot="last"): None, change({"hand": hand}, txId=None): "missing_tx", change({"hand": hand}, db="e"): "source",
        change({"hand": hand, "tenant_id": "x"}): "tenant", change({"hand": hand, "game_type": "x"}): "game_type", change({"hand": hand, "payload": "%%%"}): "base64", change({"hand": hand, "payload_sha256": "0"}): "checksum",
        change({"hand": hand, "codec_version": "v9"}): "codec", change({"hand": hand | {"hand_id": "i"}}): "aggregate", change({"hand": hand | {"dataset_split": "test"}}): "split", change({"hand": hand | {"played_at": "2026-07-21T00:00:01Z"}}): "event_time",
    }
    df = spark.createDataFrame([(k,) for k in cases], "value string")
    got = cdc.adapt(df.coalesce(1), ("json-v1",), "ml_outbox", schema="public", database="d", tenants=("t",), games=("g",), split="train", identity=True)
    assert [r for (r,) in rows(got, "reject")] == list(cases.values())


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert sorted(rows(loads.merged_one_to_one(a, b, ["k"], ["v"]), "k", "v")) == [(1, "x"), (2, "y")]
    for left, right, why in ((a.unionAll(a), b, "repeated"), (a, b.unionAll(b), "repeated"), (a, b.where("k <> 2"), "incomplete"), (a, b.withColumn("v", F.when(F.col("k") == 1, "x")), "incomplete")):
        with pytest.raises(Exception, match=why):
            loads.merged_one_to_one(left, right, ["k"], ["v"]).collect()


def test_payload_differences(spark):
    one = spark.createDataFrame([(1, '{"a": {"x": 1, "y": null}, "l": [1, {"z": 2}, 3]}'), (2, '{"a": 1}'), (3, None), (4, "no json")], "k int, payload string")
    two = spark.createDataFrame([(1, '{"l": [1, {"z": 5}], "a": {"x": 1, "w": "t"}}'), (2, '{"a": 1}'), (3, '{"b": 1}'), (4, "no json")], "k int, payload string")
    got = sorted(rows(loads.payload_differences(one, two, "k"), "k", "path", "expected", "actual"), key=str)
    assert got == sorted([(1, "payload.a.w", None, '"t"'), (1, "payload.a.y", "null", None), (1, "payload.l.length", "3", "2"), (1, "payload.l[1].z", "2", "5"), (3, "payload.b", None, "1")], key=str)


def test_persisted_content_must_not_change(spark):
    old = spark.createDataFrame([(1, "a")], "k int, c string")
    assert rows(loads.checked_insert(old, spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string"), "k", "c"), "k") == [(2,)]
    with pytest.raises(Exception, match="other content of key 1"):
        loads.checked_insert(old, spark.createDataFrame([(1, "z")], "k int, c string"), "k", "c").collect()


def test_written_files_have_their_digests(spark, tmp_path):
    import hashlib

    got = loads.write_digested(spark.range(1000).repartition(3), f"file://{tmp_path}/out").collect()
    assert len(got) == 3
    for r in got:
        data = (tmp_path / "out" / r.file).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha256)


def test_gates_and_scopes(spark):
    df = spark.createDataFrame([("a", "train", True), ("a", "test", False), ("b", "train", False), ("b", "test", True), ("c", "validation", True)], "pair_key string, split string, positive boolean")
    assert rows(datasets.protected_pairs(df), "subject") == [("b",)]
    assert rows(datasets.disjoint_members(df, "pair_key").orderBy("subject"), "subject") == [("a",), ("b",)]
    assert rows(datasets.private_columns(df.withColumn("Target", F.lit(1))), "subject") == [("Target",)]
    assert datasets.one_scope(df.where("split = 'validation'"), ["split"]) == {"split": "validation"}
    for bad in (df, df.limit(0)):
        with pytest.raises(ValueError, match="scope"):
            datasets.one_scope(bad, ["split"])
    with pytest.raises(ValueError, match="asked for"):
        files.in_list(df, "split", [], strict=True)


def test_places_and_running_sums(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "k int, v int").repartition(5)
    want = sorted((i % 7, i) for i in range(500))
    assert rows(order.indexed(df, [F.asc("k"), F.asc("v")]).orderBy("index"), "k", "v", "index") == [(k, v, i) for i, (k, v) in enumerate(want)]
    sums = rows(order.running(df, [F.asc("k"), F.asc("v")], {"s": F.col("v"), "n": F.lit(1)}).orderBy("n"), "s", "n")
    total = 0
    for i, ((_, v), (s, n)) in enumerate(zip(want, sums, strict=True)):
        total += v
        assert (s, n) == (total, i + 1)
    assert order.indexed(df.limit(0), [F.asc("k")]).count() == 0


def test_scores_of_any_range(spark):
    df = spark.createDataFrame([(i % 3 == 0, float((i * 37) % 11 - 400)) for i in range(200)], "label boolean, score double").withColumn("label", F.col("label").cast("int")).withColumns({"row_id": F.monotonically_increasing_id(), "hand_id": F.lit(1)})
    data = sorted(((r.score, -r.row_id, r.label) for r in df.collect()), reverse=True)
    for k in (1, 20, 150, 200, 999):
        got = metrics.precision_at(df, [k]).first()
        assert (got.alerts, got.tp) == (min(k, 200), sum(y for *_, y in data[:k]))
    pos, neg = [s for s, _, y in data if y], [s for s, _, y in data if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert metrics.ranking_metrics(df).first().roc_auc == pytest.approx(auc)


def test_common_neighbours_of_hubs(spark):
    import random

    r = random.Random(1)
    edges = {tuple(sorted(r.sample(range(40), 2))) for _ in range(150)} | {(0, i) for i in range(1, 40)}
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(40)}
    got = {(x.player_a, x.player_b): (x.shared, round(x.jaccard, 9)) for x in graph.coplayer_jaccard(spark.createDataFrame(sorted(edges), "player_a int, player_b int")).collect()}
    for a, b in edges:
        both, either = (near[a] & near[b]) - {a, b}, (near[a] | near[b]) - {a, b}
        assert got[a, b] == (len(both), round(len(both) / len(either), 9) if either else 0.0)
    assert set(got) == edges


@pytest.mark.parametrize("chunk", [3, 20_000])
def test_nearest_vectors(spark, chunk):
    import numpy as np

    r = np.random.default_rng(1)
    v = r.normal(size=(60, 8)).tolist()
    table = [(i, x) for i, x in enumerate(v)] + [(100, [0.0] * 8), (101, None), (102, []), (103, v[5]), (None, v[1])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = graph.cosine_top_k(df, df.where("vec_id % 9 = 0 or vec_id > 99"), 4, chunk=chunk).orderBy("query_id", "place").collect()
    known = {i: np.array(x) / np.linalg.norm(x) for i, x in table if i is not None and x and any(x)}
    want = [(q, f) for q in sorted(k for k in known if k % 9 == 0 or k > 99) for _, f in sorted((-round(float(known[q] @ known[f]), 6), f) for f in known if f != q)[:4]]
    assert [(x.query_id, x.found_id) for x in got] == want


def test_last_ids_over_days(spark):
    import random

    r = random.Random(2)
    data = [(r.choice("ab"), T0 + timedelta(hours=r.randrange(200)), i) for i in range(150)] + [("a", None, 900), (None, T0, 901)]
    df = spark.createDataFrame(data, "k string, t timestamp, id long")
    got = {x.id: (x.history, x.history_mask) for x in history.last_n(df, "k", "t", "id", 5).collect()}
    for k, t, i in data:
        seen = [j for _, j in sorted((u, j) for q, u, j in data if q == k is not None and u is not None and t is not None and u < t)][-5:]
        assert got[i] == (seen, [0] * (5 - len(seen)) + [1] * len(seen))


def test_conflicting_versions(spark):
    v = spark.createDataFrame([("u", 1, "e1"), ("u", 1, "e1"), ("u", 2, "e2")], "user_id string, context_version int, event_id string")
    assert history.checked_versions(v).count() == 2 and history.conflicting_versions(v).isEmpty()
    bad = v.unionAll(spark.createDataFrame([("u", 2, "e3")], v.schema))
    assert rows(history.conflicting_versions(bad), "context_version", "events") == [(2, 2)]
    with pytest.raises(Exception, match="conflicting version 2 of u"):
        history.checked_versions(bad).collect()


def monitored(spark, **labels):
    base = spark.createDataFrame([(r, 1, 0.2, 0.5, 100.0, "e", "sha") for r in ("ok", "low", "bad", "few", "off", "gone")], "rule_id string, rule_version int, base_rate double, base_precision double, base_volume double, evaluation_id string, baseline_sha256 string")
    seen = [("ok", True, 20, 10), ("low", True, 5, 3), ("bad", True, 90, 5), ("few", True, 1, 1), ("off", False, 90, 5)]
    w = spark.createDataFrame([(r, 1, on, 100, 200, 30, n, tp) for r, on, n, tp in seen], "rule_id string, rule_version int, enabled boolean, pair_rows long, labelled_hands long, positives long, firings long, true_positives long")
    marks = {"tenant_id": "t", "product_id": "p", "window_id": "w", "rollout_id": "r", "model_name": "m", "model_run_id": "run"}
    w = w.withColumns({k: F.lit(v) for k, v in marks.items()} | {f"{k}_labels": F.lit(labels.get(k, 0)) for k in ("circular", "unknown")})
    return metrics.rule_monitoring(w, base, min_hands=50, min_positives=5, min_firings=2, max_bad_labels=1)


def test_monitoring(spark):
    m = monitored(spark, circular=1)
    got = {r.rule_id: (r.status, r.reasons, r.lacks, r.alert_id) for r in m.collect()}
    assert {k: v[0] for k, v in got.items()} == {"ok": "ok", "low": "warning", "bad": "critical", "few": "insufficient_data", "off": "disabled", "gone": "insufficient_data"}
    why = "alert_volume_above_baseline_ratio,firing_rate_above_baseline_band,precision_below_baseline_ratio"
    assert got["bad"][1] == why and got["low"][1] == "firing_rate_below_baseline_band" and got["few"][1:3] == ("", "rule_firings_below_minimum:1<2")
    assert got["gone"][2] == "labeled_hands_below_minimum:0<50,positive_labels_below_minimum:0<5,rule_firings_below_minimum:0<2"
    name = f"t|p|w|bad|1|e|sha|r|m|run|{why}"
    assert {k for k, v in got.items() if v[3]} == {"low", "bad"} and got["bad"][3] == str(uuid.uuid5(uuid.UUID("95c9b135-90b4-5e47-a27f-45d3cce9c277"), name))
    s = metrics.overall_status(m).first()
    assert (s.status, s.rules, s.critical_rules, s.alerts) == ("critical", 6, 1, 2) and metrics.overall_status(m.where("rule_id = 'ok'")).first().status == "ok"


def test_bad_labels_make_every_enabled_rule_critical(spark):
    got = {r.rule_id: (r.status, r.reasons, r.lacks) for r in monitored(spark, circular=2, unknown=5).collect()}
    both = "circular_label_rows_above_maximum,unknown_label_rows_above_maximum"
    assert all(got[k][:2] == ("critical", both) for k in ("ok", "low", "bad", "few")) and got["off"] == ("disabled", both, "") and got["few"][2] == "rule_firings_below_minimum:1<2"
    assert got["gone"][0] == "insufficient_data"


def test_cohorts(spark):
    hands = spark.createDataFrame([(h, T0 + timedelta(hours=h)) for h in range(60)], "hand_id int, played_at timestamp")
    pairs_ = [(h, f"p{h % 8}", h % 8 < 6 and h < 8) for h in range(48)] + [(48, "p0", False), (48, "p1", False)]
    s = splits.new_relationship(hands, spark.createDataFrame(pairs_, "hand_id int, pair_key string, positive boolean"))
    got = dict(rows(s, "hand_id", "split"))
    # p0 and p1 meet in hand 48, so there are five components: p0 with p1, p2, p3 train, p4 validation, p5 test
    side = {"p0": "train", "p1": "train", "p2": "train", "p3": "train", "p4": "validation", "p5": "test"}
    assert all(got[h] == side[p] for h, p, _ in pairs_ if p in side) and len(got) == 60
    free = [got[h] for h in range(60) if h > 48 or (h < 48 and h % 8 > 5)]
    assert free == (["train"] * 14 + ["validation"] * 3 + ["test"] * 3)[: len(free)] + ["train"] * max(0, len(free) - 20)
    members = spark.createDataFrame([(h, m) for h in range(60) for m in (h % 9, h % 7)], "hand_id int, player_id int")
    cold = splits.cold_start(hands, members)
    assert cold.count() == 60 and datasets.disjoint_members(cold.join(members, "hand_id")).isEmpty()
    with pytest.raises(ValueError, match="no positive pair"):
        splits.new_relationship(hands, spark.createDataFrame([(1, "p", False)], "hand_id int, pair_key string, positive boolean"))


def test_hands_without_all_pairs(spark):
    p = spark.createDataFrame([("h", 3, 1, 2, 0.5), ("h", 3, 1, 3, 0.9), ("h", 3, 2, 3, 0.1), ("i", 3, 1, 2, 0.7)], "hand_id string, num_players int, player_a int, player_b int, probability double")
    assert rows(rules.score_hands(p, 0.8), "hand_id", "hand_score", "alert") == [("h", 0.9, True)]
    with pytest.raises(Exception, match="pairs are missing in hand i"):
        rules.score_hands(p, 0.8, strict=True).collect()


def test_files(spark, tmp_path):
    import uuid

    df = spark.createDataFrame([("example",)], "n string")
    assert rows(df, files.uuid5(uuid.NAMESPACE_URL.hex, F.col("n"))) == [(str(uuid.uuid5(uuid.NAMESPACE_URL, "example")),)]
    nested = spark.createDataFrame([], "a struct<label: int, b: array<struct<is_collusive: boolean>>>, ok int")
    assert files.forbidden_fields(nested.schema) == ["a.label", "a.b[].is_collusive"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(rows(files.json_lines(spark, str(tmp_path), df.select(F.lit(1).alias("a")).schema), "a")) == [(1,), (2,)]
    assert rows(files.in_list(df, "n", []), "n") == [] and rows(files.in_list(df, "n", ["example"]), "n") == [("example",)]


def test_scalars(spark):
    from tideglass.functions import scalars as S

    def field(number, value):
        if isinstance(value, int):
            out = bytes([number << 3])
            while value >= 128:
                out += bytes([value & 127 | 128])
                value >>= 7
            return out + bytes([value])
        return bytes([number << 3 | 2, len(value)]) + value

    action = field(1, 7) + field(2, b"p1") + field(3, b"flop") + field(4, b"bet") + field(5, 2_500_000)
    player = field(1, b"p1") + field(2, b"Ann") + field(3, b"BTN") + field(4, 100_000_000) + field(5, b"As") + field(5, b"Kd") + field(6, (1 << 64) - 3_000_000)
    good = field(1, b"h1") + field(2, b"holdem") + field(3, b"t") + field(4, 1_784_592_000_000) + field(5, b"train") + field(9, 2) + field(10, 1_500_000) + field(11, b"2c") + field(11, b"3d") + field(12, action) + field(13, player) + field(15, b"later")
    df = spark.createDataFrame([(bytearray(good),), (bytearray(good[:-1]),), (None,)], "m binary")
    got = [r[0] for r in df.select(S.decode_hand("m")).collect()]
    assert (got[0].hand_id, got[0].game_type, got[0].played_at_ms, got[0].pot_size, got[0].board, got[0].num_players, got[0].big_blind, got[0].error) == ("h1", "holdem", 1_784_592_000_000, 1.5, ["2c", "3d"], 2, 0.0, None)
    assert tuple(got[0].actions[0]) == (7, "p1", "flop", "bet", 2.5) and tuple(got[0].players[0]) == ("p1", "Ann", "BTN", 100.0, "As Kd", -3.0)
    assert got[1].error and got[1].players is None and got[2].error == "no hand"
    one = spark.createDataFrame([("High", None, 'a"b')], "x string, y string, z string")
    assert rows(one, S.ordinal(F.col("x"), S.BANKROLL), S.ordinal(F.col("y"), S.BANKROLL), S.hash_fraction(F.col("y")), S.metric_line("m", {"l": F.col("z")}, F.lit(1))) == [(2, 0, 0.0, 'm{l="a\\"b"} 1')]
    assert rows(one, S.scenario_family(F.lit("pair-0004"), ["a", "b", "c"]), S.scenario_family(F.lit("none"), ["a"])) == [("b", None)]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "v double")
    assert rows(odd, S.filled(F.col("v"), 7.0)) == [(7.0,), (7.0,), (7.0,), (2.0,)]


def test_review_of_rows_with_their_rules(spark):
    s = spark.createDataFrame([(1, False, ["soft"]), (2, True, []), (3, False, ["hard", "soft"])], "k int, above boolean, rules array<string>")
    p = spark.createDataFrame([("soft", "soft"), ("hard", "hard")], "rule_id string, category string")
    out = rules.review_rows(s, p)
    assert {r.k: (r.outcome, r.reasons) for r in out.collect()} == {1: ("no_review", ""), 2: ("review_recommended", "model-threshold"), 3: ("mandatory_review", "hard-rule.hard.v1")}
    with pytest.raises(Exception, match="ungoverned"):
        rules.review_rows(spark.createDataFrame([(1, True, ["x"])], "k int, above boolean, rules array<string>"), p).collect()


def test_pairs_of_hands(spark):
    h = spark.createDataFrame([(1, [(3, 1.0), (1, 2.0), (2, 3.0)]), (2, [(5, 1.0)]), (3, [])], "hand_id int, seats array<struct<player_id: long, won_amount: double>>")
    got = pairs.pairs_of_hands(h, ("won_amount",))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 2.0, 3.0), (1, 1, 3, 2.0, 1.0), (1, 2, 3, 3.0, 1.0)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_components_of_a_long_path_in_few_rounds(spark):
    import random

    ids = list(range(600))
    random.Random(3).shuffle(ids)
    e = spark.createDataFrame([*zip(ids, ids[1:]), (700, 700), (701, 700), (800, 800), (None, 5)], "a long, b long")
    assert dict(rows(splits.components(e, most_rounds=12), "node", "component")) == {**{i: 0 for i in range(600)}, 700: 700, 701: 700, 800: 800}


def test_nearest_vectors_hold_blocks_only(spark):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    v = np.round(r.normal(size=(3000, 4)), 1)
    v[2000:] = v[:1000]  # many ties
    asked = [(i, v[i].tolist()) for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"i": list(range(3000)), "v": v.tolist()})
    tracemalloc.start()
    (found,) = graph._nearest(asked, 3, block=256)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 3000 queries times 3000 rows would be 72 MB a matrix
    known = v / np.linalg.norm(v, axis=1)[:, None]
    got = {}
    for q, f, c in zip(*(found.column(n).to_pylist() for n in ("query_id", "found_id", "cosine")), strict=True):
        got.setdefault(q, []).append((-c, f))
    for q in range(0, 3000, 97):
        c = np.round(known @ known[q], 6)
        assert [f for _, f in sorted(got[q])] == [f for f in np.lexsort((np.arange(3000), -c)) if f != q][:3]


def test_replaced_values_that_many_rows_share(spark):
    old = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "P").otherwise("F").alias("s"), "id")
    kept, gone = loads.delete_then_append(old, old.where("id % 3 = 0").withColumn("s", F.lit("P")), "s")
    assert gone == 10_000 and kept.count() == 10_000 + 6667 and kept.where("s = 'F'").count() == 10_000
    assert "aggregate" in kept._jdf.queryExecution().optimizedPlan().toString().lower()  # distinct values are joined
