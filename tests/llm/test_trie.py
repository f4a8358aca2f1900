"""The prefix trie and running sums within keys, against plain forms."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.llm import scans, trie


def plain_trie(convs):
    """The nodes of {conv_id: [(role, text)]}."""
    members = collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    out = {}
    for path, of in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = [c for c in of if len(convs[c]) == len(path)]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        out[of[0], len(path)] = (
            min(members[path[:-1]]) if path else None, len(of), sum(len(p) == len(path) + 1 for p in below), len(leaves),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def plain_rebuilt(rows, hundred=100, most=6):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % most, own.get(c - int(np.fmod(c, hundred)), [])
        out[c] = base[:h] + own[c][h:]
    return out


def nodes(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def random_turns(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(12), 100, 101, 150, 307, 312, -3, 7_000_000_001, 7_000_000_050]:
        rows += [(c, t, r.choice(["user", "assistant", None]), r.choice(["", None, "a", "ÄÖ b", "c" * 5])) for t in range(r.randrange(9))]
    rows += [(5, t, "user", "again") for t in range(40)] + [(5, 3, "user", "again")] * 2  # a long one, with repeated rows
    return rows + [(None, 1, "user", "x"), (9, None, "user", "first"), (9, None, None, None), (11, 2**40, "user", "last")]


@pytest.mark.parametrize("modulus", [2, trie.PRIME])
def test_trie_against_a_plain_form(spark, modulus):
    rows = random_turns(1)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).withColumns({c: F.lit("clash") for c in ("depth", "f", "n", "digest", "conv")})
    got = trie.prefix_trie(*trie.shared_starts(trie.turns_of(turns)), modulus=modulus, chunk_ids=2)
    want = plain_trie(plain_rebuilt(rows))
    assert nodes(got) == want and got.count() == len(want)


def test_copies_deep_paths_and_collisions(spark):
    """Many equal conversations, a chain of branches off branches, and fingerprints that hardly tell turns apart."""
    convs = {i: [("user", "hello")] * 2 for i in range(40)} | {50 + i: [("user", str(k)) for k in range(i)] + [("user", "else")] for i in range(12)}
    rows = [(c, d + 1, f"{r}{t}", r, t) for c, v in convs.items() for d, (r, t) in enumerate(v)]
    turns = spark.createDataFrame([(c, d, bytearray(hashlib.sha256(x.encode()).digest()), len(t)) for c, d, x, _, t in rows], "conv_id long, depth long, digest binary, chars long")
    ids = spark.createDataFrame([(c,) for c in [*convs, 99]], "conv_id long")
    assert nodes(trie.prefix_trie(turns, ids, modulus=3, chunk_ids=7)) == plain_trie(convs | {99: []})


def test_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(*trie.shared_starts(trie.turns_of(none))).count() == 0


def test_running_sums_of_a_long_key(spark):
    r = random.Random(2)
    rows = [(7 if r.random() < 0.7 else r.randrange(20), i, r.randrange(-5, 6)) for i in range(4000)]
    found = scans.running(spark.createDataFrame(rows, "k long, o long, v long").repartition(7), "k", ["o"], {"s": F.col("v"), "s2": F.abs("v")}, place="p").collect()
    so_far = collections.defaultdict(lambda: [0, 0, 0])
    want = {}
    for k, o, v in rows:
        so_far[k] = [so_far[k][0] + v, so_far[k][1] + abs(v), so_far[k][2] + 1]
        want[o] = (*so_far[k],)
    assert {x.o: (x.s, x.s2, x.p) for x in found} == want


def test_powers():
    n = np.array([0, 1, 2, 17, 10**9])
    assert scans.powers(911_382_323, n, trie.PRIME).tolist() == [pow(911_382_323, int(i), trie.PRIME) for i in n]
