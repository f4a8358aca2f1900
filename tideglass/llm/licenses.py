"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed by comparison with templates.

A paragraph is a line with a word, or a stretch of neighbouring lines: a notice may be wrapped at any width. Its features are the
distinct runs of two and of three words that the model knows. Multinomial logistic regression gives each licence family and "unknown" a
probability. Unknown is learned from paragraphs of the corpus and from the templates' sentences with names of other licences in them, so that
a known way to grant with an unknown name is unknown. A temperature and a limit for families are calibrated on what FOLDS models say about
whole sentences, names and paragraphs that each of them did not see. A prediction counts when three-word runs of the paragraph cover enough
of one sentence of the family's templates.

Lines are joined within blocks, which lines without a word separate. For each sentence of the templates, the stretch of at most
REACH words in the block that covers most of it is one more paragraph, if it covers enough.

Training runs on the driver over the templates' sentences and NEGATIVES paragraphs of the corpus at most, one a document, of the documents
with the smallest hashes, which a threshold picks out in the scan. Scanning is DataFrame operations only. The model knows all runs of the
templates' words, however common they are in the corpus. One membership test a word leaves few paragraphs to explode: it looks for words without which neither the weights can add up to the limit nor
a sentence can be covered, so it loses no paragraph. The sample's counts of words only choose among such sets of words. Weights and
templates are small tables of bounded size that are broadcast. Counts are combined before the one shuffle by paragraph.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.llm.common import documents, thinned, without, written

# Sentences by which published licences are granted or named.
TEMPLATES = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "EPL": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License.",
    ),
    "Boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Licensed under the Boost Software License.",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "MPL": (
        "This work is licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-ND": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "Public domain": (
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "Proprietary": (
        "Copyright, all rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without prior written permission of the copyright holder.",
    ),
}
# How the templates name the licences, and names of licences of no family here.
NAMES = ("Apache License", "MIT License", "BSD 3-Clause License", "GNU General Public License", "GNU Affero General Public License", "GNU Lesser General Public License", "Mozilla Public License", "Eclipse Public License", "ISC License", "Boost Software License", "CC BY", "Creative Commons Attribution")
OTHERS = ("Artistic License", "GNU Free Documentation License", "European Union Public Licence", "Academic Free License", "Microsoft Public License", "Open Software License", "Python Software Foundation License", "Common Development and Distribution License", "Q Public License", "Acme Software License")
UNKNOWN, NEGATIVES, COVER, FALSE_RATE, FOLDS, GRAMS, NEGATIVE_CHARS = "unknown", 4_000, 0.6, 0.001, 4, (2, 3), 2_000
SPLIT, BETWEEN = r"[^\p{L}\p{N}]+", r"\n(?:[^\p{L}\p{N}\n]*+\n)+"


def words_of(paragraph: Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.filter(F.split(F.lower(paragraph), SPLIT), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """Runs of n words, joined by blanks."""
    each = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(each, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, place and text of each block of lines between lines without a word."""
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BETWEEN)).alias("block", "text"))
    return parts.where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def _words(text: str) -> list[str]:
    return ["".join(x) for x in "".join(c if c.isalnum() else " " for c in text.lower()).split()]


def _grams(words: list[str], n: int) -> set[str]:
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def _features(words: list[str]) -> set[str]:
    return set().union(*(_grams(words, n) for n in GRAMS))


#: Words that a stretch of joined lines spans at most: twice the longest sentence.
REACH = 2 * max(len(_words(s)) for t in TEMPLATES.values() for s in t)


def anchors(cover: float, seen: dict[str, int]) -> set[str]:
    """Words of which each text has one that covers this share of a sentence: fewer runs are without them. Rare words come first, then long ones."""
    out: set[str] = set()
    for sentence in (s for t in TEMPLATES.values() for s in t):
        runs = _grams(words := _words(sentence), 3)
        left = {r for r in runs if not out & set(r.split(" "))}
        for w in sorted(set(words), key=lambda w: (seen.get(w, 0), -len(w), w)):
            if not left or len(left) < cover * len(runs):
                break
            out.add(w)
            left = {r for r in left if w not in r.split(" ")}
    return out


class Model:
    """weights: n-gram -> one weight a class; classes[0] is unknown. seen: how many paragraphs of the sample hold a word."""

    def __init__(self, classes: list[str], weights: dict[str, list[float]], bias: list[float], temperature: float, limit: float, seen: dict[str, int]) -> None:
        self.classes, self.weights, self.bias, self.temperature, self.limit, self.seen = classes, weights, bias, temperature, limit, seen

    def needed(self) -> set[str]:
        """Words of which each paragraph has one whose probability is above the limit.

        Above it, some family's sum over unknown's is above `room`. Words are left out, common ones first, as long as all n-grams of
        words that are left out cannot add up to any family's room together; the others are needed.
        """
        w, b = np.array(list(self.weights.values())), np.array(self.bias)
        gain = dict(zip(self.weights, np.maximum(0.0, w[:, 1:] - w[:, :1]), strict=True))
        room = self.temperature * (np.log(self.limit / (1 - self.limit)) - np.log(len(b) - 1)) - (b[1:] - b[0]) - 1e-6
        words = {x for g in self.weights for x in g.split(" ")}
        out: set[str] = set()
        for x in sorted(words, key=lambda x: (-self.seen.get(x, 0), x)):
            more = sum(v for g, v in gain.items() if x in (of := g.split(" ")) and out.issuperset({*of} - {x}))
            if (more <= room).all():
                out.add(x)
                room = room - more
        return words - out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, one: np.ndarray, weight: np.ndarray, rounds: int, rate: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias that minimise the weighted log loss, by gradient steps with momentum."""
    w, b = np.zeros((x.shape[1], one.shape[1]), np.float32), np.zeros(one.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = (_softmax(x @ w + b) - one) * weight
        vw, vb = 0.9 * vw - rate * (x.T @ g + ridge * w), 0.9 * vb - rate * g.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b


def _stretches(words: list[str]) -> list[list[str]]:
    """The sentence and parts of it of half its words or more."""
    least = max(3, (len(words) + 1) // 2)
    return [words] + [words[i:j] for i in range(0, len(words) - least + 1, 2) for j in range(i + least, len(words) + 1, 3)]


def train(negatives: list[str], rounds: int = 120, rate: float = 0.15, ridge: float = 1e-4) -> Model:
    """Fit on the templates, whole and in stretches, on those with other names, and on paragraphs that share no three-word run with them."""
    classes = [UNKNOWN, *sorted(TEMPLATES)]
    runs = set().union(*(_grams(_words(s), 3) for t in TEMPLATES.values() for s in t))
    plain = [w for p in negatives if (w := _words(p)) and not _grams(w, 3) & runs]
    seen: dict[str, int] = {}
    for w in plain:
        for x in set(w):
            seen[x] = seen.get(x, 0) + 1
    # (words, class, fold): what belongs together, a sentence with its stretches or another licence's name, has one fold
    rows = [(w, 0, n % FOLDS) for n, w in enumerate(plain)]
    for k, family in enumerate(classes[1:], 1):
        for n, sentence in enumerate(TEMPLATES[family]):
            rows += [(w, k, n % FOLDS) for w in _stretches(_words(sentence))]
            for name in NAMES:
                if name in sentence:
                    rows += [(_words(sentence.replace(name, other)), 0, m % FOLDS) for m, other in enumerate(OTHERS)]
    known = sorted({g for w, k, _ in rows if k for g in _features(w)})
    number = {g: i for i, g in enumerate(known)}
    found = [([number[g] for g in _features(w) if g in number], k, f) for w, k, f in rows]
    # paragraphs without a feature are all alike: one row, weighted
    empty = sum(not g for g, k, _ in found if k == 0)
    some = [(g, k, f, 1.0) for g, k, f in found if g] + [([], 0, -1, float(max(1, empty)))]
    x, y, fold, weight = np.zeros((len(some), len(known)), np.float32), np.array([k for _, k, _, _ in some]), np.array([f for _, _, f, _ in some]), np.array([w for *_, w in some])
    for i, (g, *_) in enumerate(some):
        x[i, g] = 1
    one = np.eye(len(classes), dtype=np.float32)[y]
    balance = lambda at: (weight / np.maximum(np.bincount(y[at], weight[at], len(classes))[y], 1e-9))[at][:, None].astype(np.float32)  # noqa: E731  classes count alike
    z = np.zeros((len(some), len(classes)), np.float32)
    for f in range(FOLDS):
        fit = fold != f
        w, b = _fit(x[fit], one[fit], balance(fit), rounds, rate, ridge)
        z[fold == f] = x[fold == f] @ w + b
    out = fold >= 0
    loss = lambda t: -np.log(_softmax(z[out] / t)[np.arange(out.sum()), y[out]] + 1e-12).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    wrong = np.sort(1 - _softmax(z[out & (y == 0)] / temperature)[:, 0]) if (out & (y == 0)).any() else np.zeros(1)
    limit = float(max(0.5, wrong[min(len(wrong) - 1, int(np.ceil(len(wrong) * (1 - FALSE_RATE))))]))
    w, b = _fit(x, one, balance(np.ones(len(some), bool)), rounds, rate, ridge)
    w, b = w.astype(np.float64), b.astype(np.float64)
    # a whole sentence of the templates passes, whatever the paragraphs that calibrate the limit are about
    whole = np.array([[float(g in grams) for g in known] for t in TEMPLATES.values() for s in t for grams in [_features(_words(s))]])
    limit = min(limit, 0.999 * float(1 - _softmax((whole @ w + b) / temperature)[:, 0].max()))
    words = {x for g in known for x in g.split(" ")}
    return Model(classes, {g: w[i].tolist() for g, i in number.items()}, b.tolist(), float(temperature), limit, {x: n for x, n in seen.items() if x in words})


def learn(docs: DataFrame, *, negatives: int = NEGATIVES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train with this many paragraphs of docs at most, one of each document: the line with a word whose place has the smallest hash, its first NEGATIVE_CHARS characters."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of = F.lit(max(1, docs.count()))
    few = thinned(docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(id_col, text_col).alias("h")), "h", negatives, of)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.xxhash64("h", i).alias("of"), F.substring(x, 1, NEGATIVE_CHARS).alias("line"))), lambda x: x["line"].rlike(r"[\p{L}\p{N}]"))
    some = few.select("h", F.array_min(lines)["line"].alias("paragraph")).where("paragraph is not null").orderBy("h", "paragraph").limit(negatives)
    return train([r["paragraph"] for r in some.collect()])


def _hits(words: Column, runs: list[str]) -> Column:
    """Places of these runs, each with the REACH words from there on."""
    each = F.filter(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, 3), " ").isin(runs))
    return F.transform(each, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i, 3), " ").alias("run"), F.slice(words, i, REACH).alias("words")))


def _joined(some: DataFrame, runs: DataFrame, cover: float) -> DataFrame:
    """Of each block and sentence, the stretch of REACH words at most that covers most of it, if that is enough; line is -1 - the sentence's number."""
    at = some.select("row", F.inline("hits")).join(runs.select("number", "run", "runs"), "run")
    ahead = Window.partitionBy("row", "number").orderBy("at").rangeBetween(0, REACH - 3)
    at = at.select("row", "number", "at", "words", (F.size(F.collect_set("run").over(ahead)) / F.col("runs")).alias("c"), F.max("at").over(ahead).alias("end")).where(F.col("c") >= cover)
    best = at.groupBy("row", "number").agg(F.max(F.struct("c", F.col("at") - F.col("end"), "at", "end", "words")).alias("b"))
    return best.select("row", (-1 - F.col("number")).alias("line"), F.slice("b.words", 1, F.col("b.end") - F.col("b.at") + 3).alias("words"))


def found(docs: DataFrame, model: Model, *, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each paragraph that is predicted to grant a licence: id, block, line in it, family, probability, coverage and confirmed.

    Of joined lines, whose line is below 0, a block has one row for a family at most: only where they confirm what no line of the
    block does by itself. Lines of the family that are not confirmed are parts of it then and have no rows of their own.
    """
    spark = docs.sparkSession
    needed = sorted(model.needed())
    weights = F.broadcast(spark.createDataFrame([(g, w) for g, w in model.weights.items()], "gram string, w array<double>"))
    sentences = [(f, s) for f, t in TEMPLATES.items() for s in t]
    of_sentences = [(f, i, r, len(g)) for i, (f, s) in enumerate(sentences) if (g := _grams(_words(s), 3)) for r in g]
    runs = F.broadcast(spark.createDataFrame(of_sentences, "family string, number int, run string, runs int"))
    covering = sorted(anchors(cover, model.seen))
    key = ["row", "line"]
    # whole documents first, by a test that is compiled: what has none of the words that any paragraph is looked for by has no such paragraph
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    docs = docs.where(F.arrays_overlap(F.split(text, SPLIT), F.array(*map(F.lit, sorted({*needed, *covering})))))
    some = blocks(docs, id_col, text_col).select("id", "block", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), F.transform(F.split("text", "\n"), words_of).alias("each"))
    lines = F.filter(F.transform("each", lambda w, i: F.struct(i.alias("line"), w.alias("words"))), lambda x: F.exists(x["words"], lambda w: w.isin(needed)))
    words = F.flatten("each")
    wrapped = (F.size("each") > 1) & (F.size(words) > 2) & F.exists("each", lambda x: F.exists(x, lambda w: w.isin(covering)))
    some = some.select("id", "block", "h", "row", lines.alias("lines"), F.when(wrapped, _hits(words, sorted({r for _, _, r, _ in of_sentences}))).alias("hits"))
    some = written(some.where((F.size("lines") > 0) | (F.size("hits") > 0)), "licence-blocks")
    names = some.select(F.col("row").alias("n_row"), "id", "block", "h")
    some = written(some.select("row", F.inline("lines")).unionByName(_joined(some, runs, cover)), "licence-paragraphs")
    grams = some.select(*key, F.explode(F.array_distinct(F.concat(*[_runs(F.col("words"), n) for n in GRAMS]))).alias("gram"))
    sums = [F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(model.classes))]
    scored = grams.join(weights, "gram").groupBy(*key).agg(*sums)
    z = [(F.col(f"z{i}") + b) / model.temperature for i, b in enumerate(model.bias)]
    most = F.greatest(*z)
    total = sum((F.exp(x - most) for x in z), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(F.exp(x - most).alias("p"), F.lit(c).alias("family")) for x, c in zip(z[1:], model.classes[1:], strict=True)]))
    scored = scored.select(*key, best["family"].alias("family"), (1 - F.exp(z[0] - most) / total).alias("probability")).where(F.col("probability") > model.limit)
    threes = some.select(*key, F.explode(F.array_distinct(_runs(F.col("words"), 3))).alias("run")).join(runs, "run")
    covered = threes.groupBy(*key, "family", "number").agg((F.count(F.lit(1)) / F.first("runs")).alias("c")).groupBy(*key, "family").agg(F.max("c").alias("coverage"))
    out = scored.join(covered, [*key, "family"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    # rows that repeat are one
    out = out.join(names, F.col("row") == F.col("n_row")).drop("row", "n_row").dropDuplicates(["id", "block", "h", "line"])
    out = out.withColumn("confirmed", F.col("coverage") >= cover)
    each = Window.partitionBy("id", "block", "h", "family")
    single, one = F.col("line") >= 0, F.row_number().over(each.orderBy((F.col("line") >= 0).cast("int"), F.desc("confirmed"), F.desc("probability"), "line"))
    out = out.withColumns({"__single": F.max(F.col("confirmed") & single).over(each), "__joined": F.max(F.col("confirmed") & ~single).over(each), "__one": one})
    alone = single & (F.col("confirmed") | F.col("__single") | ~F.col("__joined"))
    return out.where(alone | (~single & F.col("confirmed") & ~F.col("__single") & (F.col("__one") == 1))).drop("h", "__single", "__joined", "__one")


def scan(docs: DataFrame, model: Model, *, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs with license (the family, of several the most probable confirmed one, or null), probability, n_confirmed and n_unconfirmed paragraphs.

    A null or empty text has none. Rows that repeat get equal results; rows that share an id but not the text get the results of
    both texts, as they are one document; null ids are one document too. Input columns named as a result are replaced.
    """
    names = ("license", "probability", "n_confirmed", "n_unconfirmed")
    rows = without(docs, [x for x in names if x not in (id_col, text_col)])
    each = found(docs, model, cover=cover, id_col=id_col, text_col=text_col)
    best = F.max(F.when(F.col("confirmed"), F.struct("probability", "family")))
    per = each.groupBy("id").agg(best.alias("best"), F.count_if("confirmed").alias("n_confirmed"), F.count_if(~F.col("confirmed")).alias("n_unconfirmed"))
    per = per.select(F.col("id").alias("__id"), F.col("best.family").alias("license"), F.col("best.probability").alias("probability"), "n_confirmed", "n_unconfirmed")
    zero = F.lit(0).cast("long")
    out = rows.join(per, F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id")
    return out.withColumns({"n_confirmed": F.coalesce("n_confirmed", zero), "n_unconfirmed": F.coalesce("n_unconfirmed", zero)})


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return scan(docs, learn(docs)).select("doc_id", "license", F.round("probability", 6).alias("probability"), "n_confirmed", "n_unconfirmed")
