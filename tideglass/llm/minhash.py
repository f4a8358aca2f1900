"""Near-duplicate documents by MinHash.

1. One pass over the texts: the set of five-word shingles as 64-bit hashes, 256 universal hash minima, 32 bands of 8 minima.
   Documents with the same words are one node, named by the md5 of the words.
2. Nodes that share a band with others are joined to the smallest node of that bucket, a star for each bucket, never all pairs; the
   components of those stars (alternating large-star and small-star) are blobs: no link leaves its blob.
3. Inside a blob, signatures are compared, and pairs whose agreement is within five standard deviations of the limit are confirmed
   on their full sets. A blob up to BLOB_DOCS documents and BLOB_SHINGLES shingles is one task's work.
4. Larger blobs are taken apart without loss. Documents with too few shingles that occur elsewhere in the blob cannot be linked
   with anything. Anchors, the documents with the least of their own, link what is close to them, in linear time. What is left is
   compared in blocks of bounded size; blocks of documents that one anchor has linked already need no comparison, nor do blocks whose sizes rule a link out.
5. The components of all confirmed links are the result.

A pair at the limit shares a band with probability 1 - (1 - 0.85^8)^32 = 0.99996; documents in between add to that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.bloom import Bloom
from tideglass.llm.common import WORD, discard, documents, give_back, written
from tideglass.llm.components import connected_components
from tideglass.llm.tokens import slices

WORDS, PERCENT, BANDS, ROWS = 5, 85, 32, 8
BLOB_DOCS, BLOB_SHINGLES, BLOCK_DOCS, BLOCK_SHINGLES, ANCHORS, MATRIX_ROWS = 512, 1_000_000, 256, 700_000, 4, 32


def _numbers(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_words(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z in lower case: bytes.split() and bytes.lower() know ASCII only, as the word rule does."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Shingler:
    def __init__(self, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> None:
        self.words, self.bands, self.rows, self.memo = words, bands, rows, {}
        k = bands * rows
        self.a = (_numbers(k, 11) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
        self.b = (_numbers(k, 12) >> np.uint64(31)).astype(np.uint32)
        self.at, self.in_band, self.of_band = _numbers(words, 13) | np.uint64(1), _numbers(rows, 14) | np.uint64(1), _numbers(bands, 15)

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        memo = self.memo
        if len(memo) > 200_000:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def set_of(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct shingles; with fewer words than a shingle has, the whole sequence as one; without words none."""
        if not words:
            return np.empty(0, np.uint64)
        h, n = self.word_hashes(words), max(1, len(words) - self.words + 1)
        total = np.full(n, min(len(words), self.words), np.uint64)
        for i in range(min(len(words), self.words)):
            total += _mix(h[i : i + n]) * self.at[i]
        return np.unique(_mix(total))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(self.a), 2**32 - 1, np.uint32)
        for i in range(0, len(x), 1024):
            h = self.a[:, None] * x[None, i : i + 1024]
            h += self.b[:, None]
            np.minimum(least, h.min(axis=1), out=least)
        return least

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        rows = signature.reshape(self.bands, self.rows).astype(np.uint64)
        return _mix((_mix(rows) * self.in_band).sum(axis=1, dtype=np.uint64) + self.of_band).view(np.int64)


_shinglers: dict[tuple, Shingler] = {}


def shingler(*key: int) -> Shingler:
    if key not in _shinglers:
        _shinglers[key] = Shingler(*key)
    return _shinglers[key]


def node_of(words: list[bytes]) -> bytes | None:
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest() if words else None


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """id, h, node, n_shingles and band keys of each row of (id, h, text). Without words: null node, no bands."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shingler(words, bands, rows)
        for batch in batches:
            for part in slices(batch, "text"):
                nodes, sizes, keys = [], [], []
                for text in part.column("text").to_pylist():
                    w = text_words(text)
                    shingles = s.set_of(w)
                    nodes.append(node_of(w))
                    sizes.append(len(shingles))
                    keys.append(s.band_keys(s.signature(shingles)) if len(shingles) else np.empty(0, np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))], ["id", "h", "node", "n_shingles", "bands"])
        s.memo.clear()
        give_back()

    return docs.mapInArrow(sign, "id long, h long, node binary, n_shingles long, bands array<long>")


def _sets(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """node, n, signature and shingles of each row of (text)."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shingler(words, bands, rows)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [(w, s.set_of(w)) for w in map(text_words, part.column("text").to_pylist())]
                offsets = np.concatenate([[0], np.cumsum([len(x) for _, x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([node_of(w) for w, _ in found], pa.binary()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([s.signature(x).tobytes() for _, x in found], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x for _, x in found]).view(np.int64)))], ["node", "n", "signature", "shingles"])
        s.memo.clear()
        give_back()

    return docs.mapInArrow(sets, "node binary, n long, signature binary, shingles array<long>")


def _intersections(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many elements each two of the sets share, by products of 0/1 matrices over the elements that occur twice."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = count[place] > 1
    number = np.cumsum(count > 1) - 1
    owner, place = owner[twice], number[place[twice]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        i, j = np.searchsorted(place, [c, c + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[i:j], place[i:j] - c] = 1
        total += m @ m.T
    return total


def _agreements(signatures: np.ndarray) -> np.ndarray:
    k, width = signatures.shape
    if k <= 16:
        return (signatures[:, None, :] == signatures[None, :, :]).sum(axis=2)
    agree = np.zeros((k, k), np.uint16)
    for p in range(width):
        agree += signatures[:, p, None] == signatures[None, :, p]
    return agree


def confirmed(signatures: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the documents, as many as hold together what is linked: by signature first, then on the full sets."""
    k, width, limit = len(sets), signatures.shape[1], percent / 100
    near = _agreements(signatures) >= width * limit - 5 * (width * limit * (1 - limit)) ** 0.5
    near = np.triu(near, 1)
    alive = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
    if not len(alive):
        return []
    near, some = near[np.ix_(alive, alive)], [sets[i] for i in alive]
    both, sizes = _intersections(some), np.array([len(x) for x in some], np.float64)
    linked = near & (100 * both.astype(np.float64) >= percent * (sizes[:, None] + sizes[None, :] - both))
    label = np.arange(len(some))
    out = []

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = root(i), root(j)
        if a != b:
            label[max(a, b)] = min(a, b)
            out.append((int(alive[i]), int(alive[j])))
    return out


def _links(grouped: DataFrame, percent: int) -> DataFrame:
    """Confirmed links a - b within each group of (group, node, signature, shingles); groups are of bounded size."""
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, signatures, sets = None, [], [], []

        def done() -> pa.RecordBatch | None:
            if len(nodes) < 2:
                return None
            pairs = confirmed(np.stack(signatures), sets, percent)
            return pa.RecordBatch.from_pydict({"a": pa.array([nodes[i] for i, _ in pairs], pa.binary()), "b": pa.array([nodes[j] for _, j in pairs], pa.binary())}) if pairs else None

        for batch in batches:
            groups, values = batch.column("group").to_pylist(), batch.column("shingles")
            flat, offsets = values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(values).to_numpy(zero_copy_only=False))])
            for r, g in enumerate(groups):
                if g != now:
                    if (out := done()) is not None:
                        yield out
                    now, nodes, signatures, sets = g, [], [], []
                nodes.append(batch.column("node")[r].as_py())
                signatures.append(np.frombuffer(batch.column("signature")[r].as_py(), np.uint32))
                sets.append(flat[offsets[r] : offsets[r + 1]].copy())
        if (out := done()) is not None:
            yield out
        del nodes, signatures, sets
        give_back()

    return grouped.select("group", "node", "signature", "shingles").repartition("group").sortWithinPartitions("group").mapInArrow(link, "a binary, b binary")


def _hot_links(hot: DataFrame, percent: int) -> DataFrame:
    """Links within blobs of any size, as blocks. hot: group (the blob), node, n, signature, shingles."""
    hot = written(hot, "hot")
    nodes, links = hot.select("group", "node", "n"), []
    for _ in range(2):  # what has too little in common with the rest has no link; without it, the rest may have less in common
        nodes = written(nodes, "alive")
        tokens = hot.join(nodes.select("node"), "node", "left_semi").select("group", "node", F.explode("shingles").alias("t"))
        own = tokens.groupBy("group", "t").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
        least = nodes.groupBy("group").agg(F.min("n").alias("least"))
        shared = nodes.join(own, "node", "left").join(least, "group").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0)))
        partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
        shared = shared.where((100 + percent) * F.col("shared") >= percent * (F.col("n") + partner))
        nodes = shared.select("group", "node", "n", "shared")
        nodes, ranked = nodes.drop("shared"), nodes
    left = written(ranked, "ranked")
    labels = None
    for _ in range(ANCHORS):
        anchors = written(left.groupBy("group").agg(F.max_by("node", F.struct(F.col("shared") / F.col("n"), "n", "node")).alias("anchor")), "anchors")
        theirs = hot.join(anchors, (hot["group"] == anchors["group"]) & (hot["node"] == anchors["anchor"]), "left_semi").select("group", F.col("node").alias("anchor"), F.col("n").alias("m"), F.explode("shingles").alias("t"))
        tokens = hot.join(left.select("node"), "node", "left_semi").select("group", "node", "n", F.explode("shingles").alias("t"))
        both = tokens.join(written(theirs, "theirs"), ["group", "t"]).groupBy("group", "node", "n", "anchor", "m").agg(F.count(F.lit(1)).alias("c"))
        near = written(both.where(100 * F.col("c") >= percent * (F.col("n") + F.col("m") - F.col("c"))).select("group", "node", "n", F.col("anchor").alias("label")), "near")
        links.append(near.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = near if labels is None else labels.unionAll(near)
        left = written(left.join(near.select("node"), "node", "left_anti"), "left")
        if left.isEmpty():
            break
    every = labels.unionAll(left.select("group", "node", "n", F.lit(None).cast("binary").alias("label")))
    every = every.withColumn("band", F.floor(F.log("n") / F.lit(0.08)).cast("int"))
    cells = every.groupBy("group", "label", "band").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
    cells = cells.withColumn("parts", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("total") / BLOCK_SHINGLES)).cast("long"))
    blocks = cells.select("group", "label", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    blocks = written(blocks.withColumn("block", F.xxhash64("group", "label", "band", "part")), "blocks")
    # the rows of a group's matrix of blocks are dealt out over its parts, so that no task makes the whole matrix
    deal = blocks.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / MATRIX_ROWS).alias("deals"))
    dealt = blocks.join(deal, "group")
    x = dealt.withColumn("deal", F.pmod("block", "deals")).alias("x")
    y = dealt.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).alias("y")
    # a band is half of what a link can bridge: log(1 / 0.85) = 0.1625 takes up to three bands
    reach = int(np.ceil(np.log(100 / percent) / 0.08))
    needed = x.join(y, (F.col("x.group") == F.col("y.group")) & (F.col("x.deal") == F.col("y.deal")) & (F.col("x.block") <= F.col("y.block")) & (F.abs(F.col("x.band") - F.col("y.band")) <= reach)).where("x.label is null or y.label is null or x.label <> y.label")
    needed = written(needed.select(F.col("x.block").alias("p"), F.col("y.block").alias("q")), "needed")
    pair = F.concat_ws(":", "p", "q")
    sides = needed.select(pair.alias("pair"), F.col("p").alias("block")).unionAll(needed.where("p <> q").select(pair.alias("pair"), F.col("q").alias("block")))
    of = cells.select(F.col("group").alias("g"), F.col("label").alias("l"), F.col("band").alias("w"), "parts")
    held = every.join(of, (F.col("group") == F.col("g")) & F.col("label").eqNullSafe(F.col("l")) & (F.col("band") == F.col("w")))
    held = held.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    held = held.withColumn("block", F.xxhash64("group", "label", "band", "part")).select("node", "block").join(sides, "block").select("node", "pair")
    links.append(_links(hot.join(held, "node").select(F.col("pair").alias("group"), "node", "signature", "shingles"), percent))
    out = links[0]
    for x in links[1:]:
        out = out.unionAll(x)
    return out


def _named(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """id, h (a hash of the text; both together tell rows apart), n_shingles and component, null without words, of each row."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    signed = written(_signed(source, words, bands, rows), "signed")
    has = signed.where("node is not null")
    per_node = has.groupBy("node").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    per_node = written(per_node, "nodes")
    keys = per_node.select("node", F.explode("bands").alias("key"))
    buckets = written(keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low"), "buckets")
    shared = Bloom(buckets, F.col("key"))  # most keys are of one node and need no shuffle to find that out
    stars = shared.beside(keys).where(shared.may_hold(F.col("key"))).drop(shared.field).join(buckets, "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    blobs = written(connected_components(stars), "blobs")
    sizes = written(blobs.join(per_node.select("node", "n"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")), "blob-sizes")
    # joins by component are sort-merge joins of plain tables: AQE splits the largest component
    hot = ((F.col("docs") > BLOB_DOCS) | (F.col("total") > BLOB_SHINGLES)).alias("hot")
    blobs = written(blobs.join(sizes.hint("merge"), "component").select("node", F.col("component").alias("group"), hot), "blob-nodes")
    # Sets are made in the scan of what a Bloom filter of one id for each node in a blob lets through: texts are never shuffled.
    wanted = written(per_node.join(blobs, "node", "left_semi").select("id"), "wanted")
    filter_ = Bloom(wanted, F.xxhash64("id"))
    texts = filter_.beside(source).where(filter_.may_hold(F.xxhash64("id"))).select("text")
    sets = written(_sets(texts, words, bands, rows).join(blobs, "node").dropDuplicates(["node"]), "sets")
    links = _links(sets.where("not hot"), percent)
    if not blobs.where("hot").isEmpty():
        links = links.unionAll(_hot_links(sets.where("hot").drop("hot"), percent))
    found = written(connected_components(links), "components")
    named = signed.select("id", "h", "node", "n_shingles").join(found, "node", "left").select("id", "h", "n_shingles", F.coalesce("component", "node").alias("component"))
    named = written(named, "named")
    discard(signed, per_node, buckets, sizes, blobs, wanted, filter_.bits, shared.bits, sets, found)
    return named


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: the id, n_shingles, component_id (the smallest id of the component) and kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of shingles. A null text, an empty one and one of
    blanks have no shingles and are linked with nothing, not even with each other. Rows that repeat have one component. Rows
    with a null id are grouped as all others; component_id is null only where no id of the component is not null, and kept is
    false for a null id. An empty table gives an empty result.
    """
    named = _named(docs, id_col, text_col, words, percent, bands, rows)
    least = written(named.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id")), "least")
    out = named.join(least.hint("merge"), "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs, whole, that stay: one of each component, the one with the smallest id (then hash of the text); nulls come last.

    Rows that repeat id and text are copies of each other, and one stays. Rows without words all stay. What a Bloom filter of the
    rows that go rules out passes on from the scan; what may go and what may stay are told apart exactly, by a join.
    """
    named = _named(docs, id_col, text_col, words, percent, bands, rows).where("component is not null")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h"))
    groups = written(named.groupBy("component").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    several = groups.where("n > 1").select("component", F.col("first.id").alias("f_id"), F.col("first.h").alias("f_h"))
    members = written(named.join(several.hint("merge"), "component").select("id", "h", (F.col("id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h"))).alias("stays")), "members")
    stay = members.where("stays").groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"))
    go = written(members.where("not stays").select("id", "h").distinct(), "go")
    unclear = Bloom(go.unionAll(stay.where("n > 1").select("id", "h")), F.xxhash64("id", "h"), "__unclear")
    staying = Bloom(written(groups.select("first.id", "first.h"), "stay"), F.xxhash64("id", "h"), "__staying")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = unclear.beside(docs.withColumns({"__id": F.col(id_col).cast("long"), "__h": F.xxhash64(F.col(text_col).cast("string"))}))
    key = F.xxhash64("__id", "__h")
    look = unclear.may_hold(key) & text.rlike(WORD)
    maybe = staying.beside(source.where(look)).where(staying.may_hold(key)).drop("__unclear", "__staying")
    exact = maybe.join(go, F.col("__id").eqNullSafe(go["id"]) & (F.col("__h") == go["h"]), "left_anti").dropDuplicates(["__id", "__h"])
    return source.where(~look).select(*docs.columns).unionByName(exact.select(*docs.columns))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir).select("doc_id", "text"))
