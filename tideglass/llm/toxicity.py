"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

Inputs of a word are an embedding of the word and one of its characters, the sum of embeddings of its n-grams of 3 to 5 characters and
of its first 6 to 8 over the root of their number; both are hashed. Both start with one column of smoothed log-odds from the training texts, so that training needs few steps.
A window of WINDOW words runs through a GRU in each direction; attention pools the states; a logistic unit gives the window's
score. Windows overlap by half, all are scored, and a text has the score of its highest window.

Training is on the driver, on TRAIN toxic documents and twice as many clean ones at most, those with the smallest hashes of their ids. A toxic document
teaches by its highest window, a clean one by its two highest, chosen anew in each round. There are ROUNDS rounds, or more
where a small sample would give fewer than STEPS steps.

Scoring is one pass of Arrow batches without a shuffle. What the gates take from a word does not depend on its neighbours, so it is
computed once for each word in a worker's memo of bounded size; the recurrent part runs over thousands of windows at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tideglass.llm.common import documents, give_back, thinned, without, written
from tideglass.llm.language import fold
from tideglass.llm.tokens import slices

WINDOW, STRIDE, HIDDEN, SIDE, WORD_BUCKETS, GRAM_BUCKETS = 32, 16, 8, 8, 1 << 14, 1 << 17
TRAIN, ROUNDS, BATCH, RATE, LIMIT, FOLDS, HELD, MEMO, CHUNK, STEPS, LEAST, TRAIN_BYTES = 1_500, 8, 128, 0.01, 0.7, 3, 1, 200_000, 20_000, 400, 3, 1 << 16
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
f32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; buckets of its character n-grams, all words in a row; where each word's begin. A word has one n-gram at least."""
    import xxhash

    cores = [_EDGE.sub("", w) for w in words]
    own = np.array([xxhash.xxh32_intdigest(c.encode("utf-8", "surrogatepass")) for c in cores], np.uint32) % np.uint32(WORD_BUCKETS)
    marked = [f"<{c}>" for c in cores]
    code = np.frombuffer("".join(f"{m}    " for m in marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(m) for m in marked])
    begin = np.concatenate([[0], np.cumsum(sizes + 4)])[:-1]
    which, key = [], []
    for n in (3, 4, 5, 6, 7, 8):
        k = np.maximum(sizes - n + 1, 1 if n == 3 else 0)
        if n > 5:
            k = np.minimum(k, 1)  # of these, the word's beginning only
        w = np.repeat(np.arange(len(words)), k)
        i = begin[w] + np.arange(len(w)) - np.repeat(np.cumsum(k) - k, k)
        h = np.full(len(i), n, np.uint64)
        for j in range(n):
            h = (h ^ code[np.minimum(i + j, len(code) - 1)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        which.append(w.astype(np.int32))
        key.append((h % np.uint64(GRAM_BUCKETS)).astype(np.int32))
    which_, key_ = np.concatenate(which), np.concatenate(key)
    order = np.argsort(which_, kind="stable")
    return own.astype(np.int64), key_[order], np.searchsorted(which_[order], np.arange(len(words)))


class Network:
    """Weights and both passes. x: projected inputs of shape (windows, steps, 2, 3 HIDDEN)."""

    def __init__(self, seed: int = 7) -> None:
        r, h, d = np.random.default_rng(seed), HIDDEN, 2 * SIDE
        normal = lambda *shape, by=1.0: (r.normal(size=shape) * by).astype(f32)
        self.p = {
            "word": normal(WORD_BUCKETS, SIDE, by=0.05), "gram": normal(GRAM_BUCKETS, SIDE, by=0.05),
            "w": normal(2, d, 3 * h, by=d**-0.5), "b": np.zeros((2, 3 * h), f32), "u": normal(2, h, 3 * h, by=h**-0.5),
            "aw": normal(2 * h, h, by=(2 * h) ** -0.5), "ab": np.zeros(h, f32), "av": normal(h, by=1.0), "o": normal(2 * h, by=0.3), "ob": np.full(1, -1.0, f32),
        }

    def inputs(self, own: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The vector of each word: its own embedding beside that of its characters."""
        n = np.diff(np.append(begin, len(grams)))
        chars = np.add.reduceat(self.p["gram"][grams], begin, axis=0) / np.sqrt(n)[:, None].astype(f32)
        return np.concatenate([self.p["word"][own], chars], axis=1).astype(f32)

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        return np.einsum("nd,kdg->nkg", vectors, self.p["w"], optimize=True) + self.p["b"]

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
        """Logits of windows; with keep, also what the backward pass needs. mask: (windows, steps) of 0 and 1."""
        n, t, _, _ = x.shape
        h_ = HIDDEN
        states, kept = np.empty((t, n, 2 * h_), f32), []
        full = bool(mask.all())
        for k in (0, 1):
            u, h = self.p["u"][k], np.zeros((n, h_), f32)
            for i in range(t) if k == 0 else range(t - 1, -1, -1):
                g = h @ u
                zr = x[:, i, k, : 2 * h_] + g[:, : 2 * h_]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                c = zr[:, h_:] * g[:, 2 * h_ :]
                c += x[:, i, k, 2 * h_ :]
                np.tanh(c, out=c)
                new = h - c
                new *= zr[:, :h_]
                new += c
                if not full:
                    new *= mask[:, i, None]
                if keep:
                    kept.append((h, zr, c, g[:, 2 * h_ :]))
                h = new
                states[i, :, k * h_ : (k + 1) * h_] = h
        a = np.tanh(states @ self.p["aw"] + self.p["ab"])
        e = a @ self.p["av"]
        if not full:
            e = np.where(mask.T > 0, e, f32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", e, states)
        logit = pooled @ self.p["o"] + self.p["ob"][0]
        return (logit, states, kept, a, e, pooled) if keep else (logit,)

    def backward(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean log loss: of the weights, and of x."""
        logit, states, kept, a, e, pooled = self.forward(x, mask, keep=True)
        n, t, _, _ = x.shape
        h_, p, d = HIDDEN, sigmoid(logit), {}
        loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        dl = ((p - y) / n).astype(f32)
        d["o"], d["ob"] = pooled.T @ dl, np.array([dl.sum()], f32)
        dp = dl[:, None] * self.p["o"]
        ds = e[:, :, None] * dp
        de = np.einsum("tnd,nd->tn", states, dp)
        de = e * (de - (e * de).sum(axis=0))
        d["av"] = np.einsum("tn,tnh->h", de, a)
        da = de[:, :, None] * self.p["av"] * (1 - a * a)
        d["aw"], d["ab"] = np.einsum("tnd,tnh->dh", states, da), da.sum(axis=(0, 1))
        ds += da @ self.p["aw"].T
        d["u"], dx = np.zeros_like(self.p["u"]), np.zeros_like(x)
        for k in (1, 0):
            u, dh = self.p["u"][k], np.zeros((n, h_), f32)
            for i in range(t) if k == 1 else range(t - 1, -1, -1):
                h, zr, c, gn = kept.pop()
                z, r = zr[:, :h_], zr[:, h_:]
                dh = (dh + ds[i, :, k * h_ : (k + 1) * h_]) * mask[:, i, None]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * gn * r * (1 - r)
                g = np.concatenate([dz, dr, dc * r], axis=1)
                d["u"][k] += h.T @ g
                dx[:, i, k] = np.concatenate([dz, dr, dc], axis=1)
                dh = dh * z + g @ u.T
        return d, dx, loss


def windows(n: int, width: int = WINDOW, stride: int = STRIDE) -> int:
    return 1 + max(0, -(-(n - width) // stride))


class Scorer:
    """Scores texts: a memo from words to rows of projected inputs, and the network over windows of rows."""

    def __init__(self, net: Network, memo: int = MEMO) -> None:
        self.net, self.memo, self.size = net, {}, 1
        self.table = np.zeros((1 + memo, 2, 3 * HIDDEN), f32)
        self.table[0] = net.p["b"]

    def _learn(self, new: list[str]) -> None:
        for i in range(0, len(new), CHUNK):
            some = new[i : i + CHUNK]
            if self.size + len(some) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table[: max(len(some), 100_000)])])
            self.table[self.size : self.size + len(some)] = self.net.projected(self.net.inputs(*word_features(some)))
            self.memo.update(zip(some, range(self.size, self.size + len(some)), strict=True))
            self.size += len(some)

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [(t or "").lower().split() for t in texts]
        if self.size > MEMO:
            self.__init__(self.net)
        self._learn(sorted(set().union(*parts).difference(self.memo)) if parts else [])
        return [np.fromiter(map(self.memo.__getitem__, p), np.int32, len(p)) for p in parts]

    def layout(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of words by window, 0 where there is none, and the text of each window."""
        count = np.array([windows(len(r)) for r in rows])
        room = (count - 1) * STRIDE + WINDOW
        flat = np.zeros(int(room.sum()), np.int32)
        begin = np.cumsum(room) - room
        for b, r in zip(begin.tolist(), rows, strict=True):
            flat[b : b + len(r)] = r
        of = np.repeat(np.arange(len(rows)), count)
        first = begin[of] + STRIDE * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
        return flat[first[:, None] + np.arange(WINDOW)], of

    def logits(self, at: np.ndarray, step: int = 2048) -> np.ndarray:
        if not len(at):
            return np.empty(0, f32)
        return np.concatenate([self.net.forward(self.table[at[i : i + step]], (at[i : i + step] > 0).astype(f32))[0] for i in range(0, len(at), step)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows = self.rows(texts)
        at, of = self.layout(rows)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, of, self.logits(at))
        return np.where([len(r) > 0 for r in rows], sigmoid(best), 0.0).astype(np.float64)


def _log_odds(buckets: Iterable[np.ndarray], y: np.ndarray, size: int, strength: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of a label of 1 where a bucket occurs in a text, drawn to 0 as by so many texts of the common mix; and which buckets
    occur in LEAST texts or more. Rare buckets tell nothing about other texts and could only be learned by heart."""
    seen = np.zeros((2, size))
    for b, label in zip(buckets, y, strict=True):
        seen[int(label), np.unique(b)] += 1
    share = np.array([(y == 0).mean(), (y == 1).mean()])[:, None]
    ratio = (seen + strength * share) / ((seen.sum(axis=0) + strength) * share)
    return np.clip(np.log(ratio[1] / ratio[0]), -4, 4), seen.sum(axis=0) >= LEAST


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = 7) -> Network:
    """A network for these texts. Without both labels it scores every word alike."""
    net, y, r = Network(seed), np.array(labels, f32), np.random.default_rng(seed)
    if len(set(labels)) < 2:
        return net
    scorer = Scorer(net, 0)
    number: dict[str, int] = {}
    rows = [np.fromiter((number.setdefault(w, len(number)) for w in t.lower().split()), np.int32) for t in texts]
    vocabulary = list(number)
    del number
    parts = [word_features(vocabulary[i : i + CHUNK]) for i in range(0, len(vocabulary), CHUNK)]
    before = np.cumsum([0, *(len(g) for _, g, _ in parts)])
    own, grams = np.concatenate([o for o, _, _ in parts]), np.concatenate([g for _, g, _ in parts])
    begin = np.concatenate([x + n for (_, _, x), n in zip(parts, before[:-1].tolist(), strict=True)])
    del parts, vocabulary
    end = np.append(begin[1:], len(grams))
    several = lambda w: np.repeat(begin[w] - np.cumsum(end[w] - begin[w]) + (end[w] - begin[w]), end[w] - begin[w]) + np.arange(int((end[w] - begin[w]).sum()))
    known = {}
    for name, found in (("word", (own[x] for x in rows)), ("gram", (grams[several(np.unique(x))] for x in rows))):
        odds, known[name] = _log_odds(found, y, len(net.p[name]))
        net.p[name][:, 0] = odds
        net.p[name][~known[name]] = 0
    table = np.zeros((1 + len(own), 2, 3 * HIDDEN), f32)
    at, of = scorer.layout([x + 1 for x in rows])
    first, second = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    steps = 0
    pairs = max(1, int((y > 0).sum() + 2 * (y == 0).sum()))
    for _ in range(max(rounds, min(10 * rounds, -(-STEPS * BATCH // pairs)))):
        table[0] = net.p["b"]
        for i in range(0, len(own), CHUNK):
            w = np.arange(i, min(len(own), i + CHUNK))
            table[1 + w] = net.projected(net.inputs(own[w], grams[begin[i] : end[w[-1]]], begin[w] - begin[i]))
        scorer.table = table
        order = np.lexsort((-scorer.logits(at), of))
        place = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        chosen = order[place < np.where(y[of[order]] > 0, 1, 2)]
        r.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            w = at[chosen[i : i + BATCH]]
            mask = (w > 0).astype(f32)
            kinds, back = np.unique(w, return_inverse=True)
            back = back.reshape(w.shape)
            k = kinds[kinds > 0] - 1
            spread = several(k)
            begins = np.cumsum(end[k] - begin[k]) - (end[k] - begin[k])
            vectors = net.inputs(own[k], grams[spread], begins)
            if kinds[0] == 0:
                vectors = np.concatenate([np.zeros((1, 2 * SIDE), f32), vectors])
            x = net.projected(vectors)[back]
            d, dx, _ = net.backward(x, mask, y[of[chosen[i : i + BATCH]]])
            dx = dx * mask[:, :, None, None]
            per = np.zeros((len(kinds), 2, 3 * HIDDEN), f32)
            np.add.at(per, back.ravel(), dx.reshape(-1, 2, 3 * HIDDEN))
            d["w"], d["b"] = np.einsum("nd,nkg->kdg", vectors, per), per.sum(axis=0)
            dv = np.einsum("nkg,kdg->nd", per, net.p["w"])[-len(k) :]
            d["word"], d["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(d["word"], own[k], dv[:, :SIDE])
            n = end[k] - begin[k]
            np.add.at(d["gram"], grams[spread], np.repeat(dv[:, SIDE:] / np.sqrt(n)[:, None].astype(f32), n, axis=0))
            for name, few in known.items():
                d[name][~few] = 0
            steps += 1
            for name, g in d.items():  # Adam
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                net.p[name] -= (RATE * (first[name] / (1 - 0.9**steps)) / (np.sqrt(second[name] / (1 - 0.999**steps)) + 1e-8)).astype(f32)
    return net


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = TRAIN, most_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Train on the sample: `sample` toxic documents and twice as many clean ones at most, those with the smallest hashes of their ids.

    Null labels and texts teach nothing, nor do texts over most_bytes, which bounds what reaches the driver. An id with both labels
    is toxic; of rows that repeat an id one is taken. Without both labels all texts are scored alike.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null").groupBy("i").agg(F.max("y").alias("y"))
    known = written(known.withColumn("h", F.xxhash64("i")), "labels")
    n = dict(known.groupBy("y").count().collect())  # two rows
    first = lambda y, most: thinned(known.where(F.col("y") == y), "h", most, F.lit(max(1, n.get(y, 0)))).orderBy("h", "i").limit(most)  # noqa: E731  the bound of the sample
    some = F.broadcast(written(first(1, sample).unionAll(first(0, 2 * sample)), "sample"))
    texts = docs.select(F.col(id_col).alias("own"), F.col(text_col).cast("string").alias("t")).where("t is not null").where(F.octet_length("t") <= most_bytes)
    rows = sorted(texts.join(some, F.col("own") == F.col("i")).select("i", "t", "y").groupBy("i", "y").agg(F.min("t").alias("t")).select("i", "t", "y").collect(), key=lambda x: x[0])
    net = train([x[1] for x in rows], [x[2] for x in rows])
    del rows
    give_back()
    return net


def score(docs: DataFrame, net: Network, *, text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """All rows of docs with score (0 to 1) and predicted (1 if score >= limit). A null text or one without words has the score 0.

    Texts are scored whole. Rows that repeat get equal scores. Input columns named as a result are replaced.
    """
    rows = without(docs, [x for x in ("score", "predicted") if x != text_col])
    order = list(rows.columns)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            for part in slices(batch, text_col, 2_000_000):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer.scores(part.column(text_col).to_pylist()))], [*order, "score"])
        del scorer
        give_back()

    out = rows.mapInArrow(scored, StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), FOLDS) != HELD)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return score(docs.select("doc_id", "text"), learn(docs, labels)).select("doc_id", held.alias("held_out"), "score", "predicted")
