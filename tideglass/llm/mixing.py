"""Mixing sources to target weights by entropy balancing.

Document i of source s gets the rate r_i = min(cap, exp(lambda_s + mu z_i)): of all rates that meet the constraints, those whose
token-weighted relative entropy to a rate of one is least. The constraints are the tokens of each source, met exactly, and one moment
that is kept: the token-weighted mean of log(1 + size), z being its standardised deviation, so that a mixture does not shift towards
short or long documents because of the sources that it prefers. The dual is convex; a Newton step needs, for each source, five sums
over the documents, which one distributed aggregation gives. The Hessian is diagonal but for one row and column.

The multipliers depend on the documents through (source, size) alone, so the sums run over the table of these with their
counts. Sums are of decimals: their order, and so a lost executor, changes nothing, and reruns agree.

Rates become copies by systematic sampling: in each source, documents in the order of their sizes, then of a seeded hash, an extra copy is
taken wherever the running sum of the fractions, in units of 2^-20, passes a whole number. The running sum is built from
buckets (band of sizes, part by hash), so no task holds a source. What a source then misses, less than its longest document, is made
up for by a copy more or less of a few short documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.llm.common import WORD, documents, without, written

CAP, TOTAL, WEIGHTS, SEED, UNIT = 2, 1.5, (5, 2, 1), "tideglass", 2**20
RIDGE, TOLERANCE, ROUNDS, CORRECTIONS, LEAST_PER_PART = 0.01, 1e-7, 40, 4, 200
RESULT = ("source_size", "target", "rate", "copies")
Targets = Callable[[dict[str | None, int]], dict[str | None, float]]


def repeating_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> dict[str | None, float]:
    """Shares of total times all tokens by weights that repeat over the sources in code point order, null last.

    A target stops at cap times its source's tokens; the excess goes to the others by weight until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = total * sum(sizes.values()), list(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > cap * sizes[s]]
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def _sums(table: DataFrame, cap: float) -> dict:
    """For each source: sums of w, w z where w = size * rate, and of w, w z, w z z of documents below the cap. table: s, size, n, z, eta."""
    exact = lambda c: F.sum(c.cast("decimal(38,9)"))
    low = F.col("eta") < math.log(cap)
    w = F.col("n") * F.col("size") * F.when(low, F.exp("eta")).otherwise(F.lit(float(cap)))
    free = F.when(low, w).otherwise(0.0)
    rows = table.groupBy("s").agg(exact(w).alias("w"), exact(w * F.col("z")).alias("wz"), exact(free).alias("f"), exact(free * F.col("z")).alias("fz"), exact(free * F.col("z") * F.col("z")).alias("fzz")).collect()
    return {r["s"]: np.array([float(r[k]) for k in ("w", "wz", "f", "fz", "fzz")]) for r in rows}


def solve(table: DataFrame, sizes: dict, target: dict, cap: float = CAP) -> tuple[dict[str | None, float], float, list[float]]:
    """lambda of each source that is neither empty nor full, mu, and the largest relative error of a target after each Newton step.

    table: s, size, n, z. What reaches the driver is a few numbers a source.
    """
    spark = table.sparkSession
    free = [s for s in sizes if 0 < target[s] < cap * sizes[s]]
    lam, mu, errors = {s: math.log(target[s] / sizes[s]) for s in free}, 0.0, []
    if not free:
        return lam, mu, errors
    whole = sum(target[s] for s in free)

    def at(lam: dict, mu: float) -> tuple[np.ndarray, np.ndarray, float]:
        steps = F.broadcast(spark.createDataFrame([(s, lam[s]) for s in free], "k string, lam double"))  # one row a source
        found = _sums(table.join(steps, F.col("s").eqNullSafe(F.col("k"))).withColumn("eta", F.col("lam") + mu * F.col("z")), cap)
        m = np.stack([found[s] for s in free])
        g = np.array([target[s] for s in free]) - m[:, 0]
        # the moment: z has mean 0 over all tokens, and so should the mixture, but for the ridge
        return m, g, -float(m[:, 1].sum()) - RIDGE * whole * mu

    worst = lambda g, gz: max(max(abs(x) / target[s] for x, s in zip(g, free, strict=True)), abs(gz) / whole)
    m, g, gz = at(lam, mu)
    for _ in range(ROUNDS):
        errors.append(worst(g, gz))
        if errors[-1] < TOLERANCE:
            break
        h = m[:, 2] + 1e-9 * np.array([target[s] for s in free])
        d_mu = (gz - float((m[:, 3] * g / h).sum())) / (float(m[:, 4].sum()) + RIDGE * whole - float((m[:, 3] ** 2 / h).sum()))
        d = (g - m[:, 3] * d_mu) / h
        step = min(1.0, 1.0 / max(1e-9, float(np.abs(d).max()), abs(d_mu)))
        while True:
            new = {s: lam[s] + step * x for s, x in zip(free, d.tolist(), strict=True)}
            m, g, gz = at(new, mu + step * d_mu)
            if worst(g, gz) < errors[-1] or step < 1e-3:
                lam, mu = new, mu + step * d_mu
                break
            step /= 2
    return lam, mu, errors


def _corrected(taken: DataFrame, cap: float) -> DataFrame:
    """One copy more or less of at most 16 documents a source, of a size from 1/32 to a half of what it misses, so that it misses less."""
    misses = taken.groupBy("s").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss")).where("abs(miss) >= 1")
    misses = F.broadcast(misses.select(F.col("s").alias("ms"), "miss"))  # one row a source
    fits = (F.col("size") > F.abs("miss") / 32) & (F.col("size") <= F.greatest(F.abs("miss") / 2, F.lit(1.0)))
    can = F.when(F.col("miss") > 0, (F.col("copies") < int(cap)) & (F.col("rate") > 0)).otherwise(F.col("copies") > 0)
    some = taken.join(misses, F.col("s").eqNullSafe(F.col("ms"))).where(fits & can)
    order = Window.partitionBy("s").orderBy("mixed", "i", "row")
    some = some.withColumn("nth", F.row_number().over(order)).where("nth <= 16").withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("sum <= abs(miss)")
    moves = some.groupBy("i", "row").agg(F.first(F.signum("miss")).cast("int").alias("move"))
    moves = F.broadcast(moves.select(F.col("i").alias("mi"), F.col("row").alias("mr"), "move"))  # 16 rows a source at most
    moved = taken.join(moves, F.col("i").eqNullSafe(F.col("mi")) & (F.col("row") == F.col("mr")), "left")
    return moved.withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("mi", "mr", "move")


def mix(docs: DataFrame, *, targets: Targets = repeating_targets, cap: float = CAP, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All rows of docs with size (words), source_size, target (both of the row's source), rate and copies (whole, cap at most).

    A null source is one of its own. A null or empty text has size 0 and is taken once if its source's rate is 1 or more, else not at
    all. Rows that repeat in all columns share the copies of all of them, evenly but for one. An empty table gives an
    empty one. targets maps the sizes of sources to target sizes, from 0 to cap times a source's size each.
    """
    rows = without(docs, (*RESULT, "size"))
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = rows.withColumns({"__row": F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), "__source": F.col(source_col).cast("string")})
    narrow = written(rows.select(F.col(id_col).alias("i"), F.col("__row").alias("row"), F.col("__source").alias("s"), size.alias("size")), "sizes")
    counts = written(narrow.groupBy("s", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    sizes = {r["s"]: int(r["t"]) for r in counts.groupBy("s").agg(F.sum(F.col("n") * F.col("size")).alias("t")).collect()}
    target = targets(sizes)
    log = F.log1p(F.col("size").cast("double"))
    token = (F.col("n") * F.col("size")).cast("double")
    exact = lambda c: F.sum(c.cast("decimal(38,9)"))
    a, b, c = (float(x or 0) for x in counts.agg(exact(token), exact(token * log), exact(token * log * log)).first())
    mean = b / a if a else 0.0
    spread = math.sqrt(max(c / a - mean * mean, 0.0)) if a else 0.0
    z = (log - mean) / spread if spread > 1e-9 else F.lit(0.0)
    lam, mu, _ = solve(written(counts.withColumn("z", z), "size-table"), sizes, target, cap)
    spark = docs.sparkSession
    of = spark.createDataFrame([(s, sizes[s], float(target[s]), lam.get(s), 0.0 if target[s] <= 0 else float(cap)) for s in sizes], "k string, source_size long, target double, lam double, fixed double")
    eta = F.col("lam") + mu * z
    rate = F.when(F.col("lam").isNull(), F.col("fixed")).otherwise(F.least(F.lit(float(cap)), F.exp(eta)))
    # the hundredth part of a source's tokens has a band or so; parts of a band hold the square root of the rows
    per_part = max(LEAST_PER_PART, math.isqrt(int(counts.agg(F.sum("n")).first()[0] or 0)))
    band = -F.floor(8 * F.log2(F.col("size") + 1)).cast("long")
    bands = counts.withColumn("band", band).groupBy("s", "band").agg(F.sum("n").alias("rows"))
    bands = bands.select(F.col("s").alias("bs"), F.col("band").alias("bb"), F.ceil(F.col("rows") / per_part).alias("parts"))
    rated = narrow.join(F.broadcast(of), F.col("s").eqNullSafe(F.col("k"))).drop("k").withColumns({"rate": rate, "band": band, "mixed": F.xxhash64(F.lit(seed), "i", "row")})
    rated = rated.withColumns({"units": F.floor(F.col("rate") * UNIT).cast("long")}).join(bands, F.col("s").eqNullSafe(F.col("bs")) & (F.col("band") == F.col("bb"))).drop("bs", "bb")
    rated = rated.withColumns({"whole": F.expr(f"units div {UNIT}"), "part": F.pmod("mixed", "parts"), "units": F.expr(f"units % {UNIT}")})
    totals = rated.groupBy("s", "band", "part").agg(F.sum("units").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("s").orderBy("band", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("s").alias("ts"), F.col("band").alias("tb"), F.col("part").alias("tp"), before.alias("before"))
    inside = F.sum("units").over(Window.partitionBy("s", "band", "part").orderBy(F.desc("size"), "mixed", "i").rowsBetween(Window.unboundedPreceding, 0))
    rated = rated.withColumn("inside", inside).join(totals, F.col("s").eqNullSafe(F.col("ts")) & (F.col("band") == F.col("tb")) & (F.col("part") == F.col("tp")))
    extra = F.expr(f"(before + inside + {UNIT // 2}) div {UNIT} - (before + inside - units + {UNIT // 2}) div {UNIT}")
    taken = written(rated.select("i", "row", "s", "size", "source_size", "target", "rate", "mixed", (F.col("whole") + extra).cast("int").alias("copies")), "copies")
    for _ in range(CORRECTIONS):
        taken = written(_corrected(taken, cap), "copies")
    per_row = taken.groupBy("i", "row").agg(*[F.first(c).alias(c) for c in ("size", "source_size", "target", "rate")], F.sum("copies").alias("all"), F.count(F.lit(1)).alias("n"))
    # rows that repeat share their copies: the remainder goes to as many of them as it should, by a seeded number of the scan
    share = (F.expr("all div n") + F.when(F.col("__u") < F.expr("(all % n) / n"), 1).otherwise(0)).cast("int")
    rows = rows.withColumn("__u", F.rand(int(zlib.crc32(seed.encode()))))
    out = rows.join(per_row, rows[id_col].eqNullSafe(per_row["i"]) & (rows["__row"] == per_row["row"]))
    return out.withColumn("copies", share).drop("i", "row", "all", "n", "__row", "__source", "__u")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row as often as copies says."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy", "size", *RESULT)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
