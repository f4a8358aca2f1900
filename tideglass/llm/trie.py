"""A prefix trie of conversations: what they share from their first turn on.

1. A scan turns each turn into a SHA-256 of role and text and a number of code points; texts are shuffled nowhere. Turns get their places by a running count.
2. Numpy scans yield the polynomial rolling fingerprint of every prefix: two polynomials modulo a prime, as prefix sums of t_k / B^k times B^d.
3. Prefixes of one depth and fingerprint are a candidate group, whose representative is its smallest conversation. A conversation equals the representative if
   their turns agree at every depth: a fingerprint and a last turn determine the fingerprint before, so agreement of the last turns in all groups along the way is
   agreement turn by turn. A group whose least and greatest digests agree has nothing to split. In any other, the rows that differ from the
   representative are gathered for each conversation, and (depth, fingerprint, differences so far) tells its prefixes apart exactly.
4. A conversation that is the smallest of a node is the smallest of all nodes below on its own path. So nodes fall into paths, one a conversation
   at most, each hung to a node of another path. Totals of paths meet by pointer doubling, whose rounds are the logarithm of the height, and
   sums over subtrees are running sums along the paths, from their ends.

Every grouping is a partial aggregation; long conversations and nodes that a third of all conversations share are sorted by ranges or summed, never gathered.
The list of a node's ends is hashed as a stream of chunks in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.common import discard, written
from tideglass.llm.scans import powers, running
from tideglass.operators.order import indexed

PRIME, BASES, CHUNK_IDS = 2**31 - 1, (911_382_323, 972_663_749), 8192
#: Of the query: conversations in hundreds share up to MOST_SHARED - 1 first turns.
HUNDRED, MOST_SHARED = 100, 6
WORDS = ("w0", "w1", "w2", "w3")
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth (from 1), digest and chars of each turn, in the order of turns.

    A null turn comes first; rows of one turn follow in the order of role and digest, and rows that repeat are turns of their own. Null roles and texts are empty.
    Rows without a conversation's id belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col(f"`{conv_col}`").isNotNull())
    rows = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    return running(written(rows, "turns"), "conv_id", ["turn", "role", "digest"], place="depth").select("conv_id", "depth", "digest", "chars")


def _terms(batches: Iterator[pa.RecordBatch], modulus: int) -> Iterator[pa.RecordBatch]:
    """The words of the digests, and a term of each polynomial: t_k / B^k."""
    for batch in batches:
        words = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">i8").reshape(-1, 4).astype(np.int64)
        depth = batch.column("depth").to_numpy()
        terms = [words[:, i].astype(np.uint64) % np.uint64(modulus) * powers(pow(b, -1, modulus), depth, modulus) % np.uint64(modulus) for i, b in enumerate(BASES)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), batch.column("chars"), *map(pa.array, words.T.copy()), *(pa.array(t.astype(np.int64)) for t in terms)], ["conv_id", "depth", "chars", *WORDS, "s0", "s1"])


def _fingerprints(batches: Iterator[pa.RecordBatch], modulus: int) -> Iterator[pa.RecordBatch]:
    """From the sums of terms, the fingerprint of each prefix and of the one before it."""
    p = np.uint64(modulus)
    for batch in batches:
        depth, now, before = batch.column("depth").to_numpy(), 0, 0
        for i, b in enumerate(BASES):
            one = batch.column(f"s{i}").to_numpy().astype(np.uint64) * powers(b, depth, modulus) % p
            last = batch.column(WORDS[i]).to_numpy().astype(np.uint64) % p
            now, before = now * modulus + one.astype(np.int64), before * modulus + ((one + p - last) % p * np.uint64(pow(b, -1, modulus)) % p).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "depth", "chars", *WORDS)), pa.array(now), pa.array(before)], ["conv_id", "depth", "chars", *WORDS, "f", "prev"])


def _longs(*names: str) -> str:
    return ", ".join(f"{x} long" for x in names)


def fingerprints(turns: DataFrame, modulus: int = PRIME) -> DataFrame:
    """conv_id, depth, chars, the words of the digest, f and prev for each turn: the prefix that ends with it and the one before."""
    terms = turns.mapInArrow(lambda batches: _terms(batches, modulus), _longs("conv_id", "depth", "chars", *WORDS, "s0", "s1"))
    sums = running(terms, "conv_id", ["depth"], {"s0": F.col("s0"), "s1": F.col("s1")}, modulus=modulus)
    return sums.mapInArrow(lambda batches: _fingerprints(batches, modulus), _longs("conv_id", "depth", "chars", *WORDS, "f", "prev"))


def _groups(rows: DataFrame) -> DataFrame:
    """Candidate groups: their representative, number of members, and whether all of these have its last turn (`same`)."""
    same = [F.min(w) == F.max(w) for w in WORDS]
    out = rows.groupBy("depth", "f").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"), F.min("prev").alias("prev"), (same[0] & same[1] & same[2] & same[3]).alias("same"))
    return written(out, "prefixes")


def _split(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows with fingerprints of their own, negative ones, for prefixes that collide with another one. mixed: the groups that are not all alike."""
    turn = F.struct(*WORDS)
    inside = rows.join(mixed.select("depth", "f"), ["depth", "f"], "left_semi")
    of = inside.groupBy("depth", "f").agg(F.min_by(turn, "conv_id").alias("of"))
    other = inside.join(of, ["depth", "f"]).where(turn != F.col("of"))
    other = written(other.groupBy("conv_id").agg(F.collect_list(F.struct("depth", *WORDS)).alias("all")).select(F.col("conv_id").alias("__c"), F.array_sort("all").alias("all")), "collided")
    key = lambda so_far: F.when(F.size(so_far) > 0, F.sha2(F.to_json(so_far), 256))
    touched = rows.join(other, F.col("conv_id") == F.col("__c")).withColumns({
        "k": key(F.filter("all", lambda x: x["depth"] <= F.col("depth"))), "k_before": key(F.filter("all", lambda x: x["depth"] < F.col("depth"))),
    }).drop("__c", "all")
    touched = written(touched, "touched")
    ids = indexed(touched.where("k is not null").select(F.col("depth").alias("d"), F.col("f").alias("was"), F.col("k").alias("kk")).distinct(), [F.col("d"), F.col("was"), F.col("kk")], "i")
    ids = written(ids.withColumn("i", -1 - F.col("i")), "split-ids")
    out = touched.join(ids, (F.col("depth") == F.col("d")) & (F.col("f") == F.col("was")) & (F.col("k") == F.col("kk")), "left").withColumn("f", F.coalesce("i", "f")).drop("d", "was", "kk", "i")
    out = out.join(ids, (F.col("depth") - 1 == F.col("d")) & (F.col("prev") == F.col("was")) & (F.col("k_before") == F.col("kk")), "left").withColumn("prev", F.coalesce("i", "prev")).drop("d", "was", "kk", "i")
    return rows.join(other, F.col("conv_id") == F.col("__c"), "left_anti").unionByName(out.drop("k", "k_before"))


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, depth, conv_id) as chunks of at most `most` ids of one node, joined by commas."""
    node, ids, out = None, [], []

    def flush() -> None:
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 3, pa.string()), strict=True)], ["conv", "depth", "first", "chunk"])
        out.clear()
        return made

    for batch in batches:
        for conv, depth, one in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "conv_id")), strict=True):
            if node != (conv, depth) or len(ids) == most:
                flush()
                node = (conv, depth)
            ids.append(one)
        if out:
            yield batch_of()
    flush()
    if out:
        yield batch_of()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's chunks in their order; the memory it takes is a batch of chunks."""
    node, sha = None, None
    for batch in batches:
        out = []
        for conv, depth, chunk in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "chunk")), strict=True):
            if node == (conv, depth):
                sha.update(b"," + chunk.encode())
            else:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (conv, depth), hashlib.sha256(chunk.encode())
        if out:
            yield _named(out)
    if node:
        yield _named([(*node, sha.hexdigest())])


def _named(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    conv, depth, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha)], ["conv", "depth", "sha"])


def ends_hashed(ends: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """sha of the ids, ascending and joined by commas, that end at each node (conv, depth)."""
    chunks = ends.orderBy("conv", "depth", "conv_id").mapInArrow(lambda batches: _chunks(batches, chunk_ids), "conv long, depth long, first long, chunk string")
    sorted_chunks = written(chunks, "ends").repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first")
    return sorted_chunks.mapInArrow(_hashes, "conv long, depth long, sha string")


def _totals(paths: DataFrame, root: Column, most_rounds: int = 60) -> DataFrame:
    """Of each path, the sums over it and all paths that hang from it, directly or not. paths: conv, up (null: the root's path), leaves, saved.

    Pointer doubling: after i rounds a sum holds all paths up to 2^i - 1 steps below. The root's path, to which most paths may hang, is no key of a join.
    """
    now = written(paths.withColumn("up", F.when(F.col("up") != root, F.col("up"))), "paths")  # sums of the root's path are needed by no one
    for _ in range(most_rounds):
        below = now.where("up is not null")
        if below.isEmpty():
            return now
        more = below.groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnRenamed("up", "to")
        above = now.where("up is not null").select(F.col("conv").alias("at"), F.col("up").alias("next"))
        new = now.join(more, F.col("conv") == F.col("to"), "left").join(above, F.col("up") == F.col("at"), "left")
        new = written(new.select("conv", F.col("next").alias("up"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]), "paths")
        discard(now)
        now = new
    raise RuntimeError(f"totals of paths did not settle in {most_rounds} rounds")


def prefix_trie(turns: DataFrame, convs: DataFrame, *, modulus: int = PRIME, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """The nodes of the trie: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (from 1, gapless), digest (32 bytes that tell turns apart) and chars. convs: the conversations' distinct conv_id, those without turns among them, which are
    members of the root alone. n_leaves counts the childless nodes of the subtree, the node itself included; saved_tokens sums (members - 1) times chars over
    it; ends_sha256 is of the members that end at the node. Without conversations there are no nodes.
    """
    convs = written(convs.select("conv_id"), "convs")
    least, many = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    rows = fingerprints(turns, modulus)
    found = _groups(rows)
    mixed = found.where("not same")
    if not mixed.isEmpty():
        rows = written(_split(rows, mixed), "split")
        found = _groups(rows)
    nodes = found.drop("same")
    root, long = F.lit(least).cast("long"), lambda x: F.lit(x).cast("long")
    top = convs.sparkSession.range(1 if many else 0).select(root.alias("conv"), long(0).alias("depth"), long(many).alias("n"), long(0).alias("chars"))

    # paths: the nodes of one smallest member. The root's path begins at the root.
    own = nodes.groupBy("conv").agg(F.min("depth").alias("first"), F.max("depth").alias("last"), F.min_by("prev", "depth").alias("prev"))
    parents = nodes.select(F.col("depth").alias("d"), F.col("f").alias("pf"), F.col("conv").alias("up"))
    hung = own.where(F.col("conv") != root).join(parents, (F.col("first") - 1 == F.col("d")) & (F.col("prev") == F.col("pf")), "left")
    paths = written(hung.select("conv", "first", "last", F.coalesce("up", root).alias("up")), "hung")
    last = paths.select("conv", "last").unionByName(top.join(own.where(F.col("conv") == root).select(F.col("conv").alias("c"), F.col("last").alias("l")), F.col("conv") == F.col("c"), "left").select("conv", F.coalesce("l", long(0)).alias("last")))

    # one grouping brings to each node what is known of it
    none = F.lit(None).cast("long")
    about = lambda df, depth, **known: df.select(F.col("conv"), depth.alias("depth"), *[known.get(c, none).alias(c) for c in ("n", "chars", "ends_path", "hanging", "parent")])
    known = about(nodes, F.col("depth"), n=F.col("n"), chars=F.col("chars")).unionByName(about(top, F.col("depth"), n=F.col("n"), chars=F.col("chars")))
    known = known.unionByName(about(last, F.col("last"), ends_path=long(1))).unionByName(about(paths, F.col("first"), parent=F.col("up")))
    known = known.unionByName(about(paths.select(F.col("up").alias("conv"), "first"), F.col("first") - 1, hanging=long(1)))
    tree = known.groupBy("conv", "depth").agg(F.max("n").alias("n"), F.max("chars").alias("chars"), F.max("ends_path").alias("ends_path"), F.coalesce(F.sum("hanging"), long(0)).alias("hanging"), F.max("parent").alias("parent"))
    tree = tree.select("conv", "depth", "n", F.coalesce("parent", F.when(F.col("depth") > 0, F.col("conv"))).alias("parent"), (F.col("hanging") + F.when(F.col("ends_path") == 1, 0).otherwise(1)).cast("long").alias("children"), ((F.col("n") - 1) * F.col("chars")).alias("saved"))
    tree = written(tree.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(0).cast("long")), "tree")

    sums = tree.groupBy("conv").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).withColumnRenamed("conv", "c")
    totals = _totals(paths.join(sums, F.col("conv") == F.col("c")).select("conv", "up", "leaves", "saved"), root)
    totals = totals.select(F.col("conv").alias("c"), "leaves", "saved").join(paths, F.col("c") == F.col("conv")).select(F.col("up").alias("conv"), (F.col("first") - 1).alias("depth"), "leaves", "saved")
    below = tree.select("conv", "depth", "leaves", "saved").unionByName(totals).groupBy("conv", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = running(below, "conv", [F.col("depth").desc()], {"leaves": F.col("leaves"), "saved": F.col("saved")})

    lengths = turns.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    at = rows.select("conv_id", "depth", "f").join(lengths, ["conv_id", "depth"]).join(nodes.select("depth", "f", "conv"), ["depth", "f"]).select("conv", "depth", "conv_id")
    without_turns = convs.join(lengths, "conv_id", "left_anti").select(root.alias("conv"), long(0).alias("depth"), "conv_id")
    ends = ends_hashed(at.unionByName(without_turns), chunk_ids)

    out = tree.drop("leaves", "saved").join(below, ["conv", "depth"]).join(ends, ["conv", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
    )


def shared_starts(turns: DataFrame, hundred: int = HUNDRED, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt, and their ids: the first h turns of the first conversation of the hundred, then what follows the own first h turns.

    h is the crc32 of the decimal id modulo `most`. If that conversation has fewer turns or does not exist, all it has is taken. A hundred has
    199 conversations at most, the negative ones counted in, and most - 1 turns of its first one, so no key of the joins is larger than its conversations' own turns.
    """
    conv, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string")) % most
    base = conv - conv % hundred
    convs = written(turns.groupBy("conv_id").agg(F.max("depth").alias("turns")), "lengths")
    starts = turns.where(F.col("depth") < most).select(F.col("conv_id").alias("b"), "depth", "digest", "chars")
    taken = convs.select("conv_id", base.alias("base"), h.alias("h")).join(starts, (F.col("base") == F.col("b")) & (F.col("depth") <= F.col("h"))).select("conv_id", "depth", "digest", "chars")
    there = convs.where(conv % hundred == 0).select(F.col("conv_id").alias("b"), "turns")
    left = turns.where(F.col("depth") > h).withColumns({"base": base, "h": h}).join(there, F.col("base") == F.col("b"), "left")
    left = left.select("conv_id", (F.col("depth") - F.col("h") + F.least("h", F.coalesce("turns", F.lit(0)))).cast("long").alias("depth"), "digest", "chars")
    return written(taken.unionByName(left), "rebuilt"), convs.select("conv_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*shared_starts(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, length(text) AS chars,
    length(role) || ':' || role || length(text) || ':' || text AS e
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, conv_id - conv_id % {HUNDRED} AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295::BIGINT) % {MOST_SHARED} AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (
  SELECT c.conv_id, t.p AS d, t.e, t.chars FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL
  SELECT c.conv_id, t.p - c.h + least(c.h, (SELECT count(*) FROM t AS b WHERE b.conv_id = c.base)), t.e, t.chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h),
m AS (
  SELECT conv_id, d, chars, string_agg(e, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM r
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY d, path),
k AS (
  SELECT n.*, (SELECT count(*) FROM n AS x WHERE x.d = n.d + 1 AND starts_with(x.path, n.path)) AS children,
    (SELECT max(x.conv_id) FROM n AS x WHERE x.d = n.d - 1 AND starts_with(n.path, x.path)) AS up
  FROM n)
SELECT a.conv_id, a.d::BIGINT AS depth, a.up AS parent_conv_id, a.n AS n_convs, a.children AS n_children,
  count(*) FILTER (WHERE b.children = 0) AS n_leaves, sum((b.n - 1) * b.chars)::BIGINT AS saved_tokens, a.ends_sha256
FROM k AS a JOIN k AS b ON b.d >= a.d AND starts_with(b.path, a.path)
GROUP BY ALL
"""
