"""Line dedup against a plain form, on small tables with odd rows."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tideglass.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows, least_chars, least_docs):
    """n_lines, n_dropped and the text that stays, for each row (doc_id, text)."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANKS))
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(-(10**9) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        at = -(10**9) if i is None else i
        stay = [x for x in lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or at == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def result(docs, **options):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.clean_text) for r in line_dedup.line_dedup(docs, **options).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_against_a_plain_form(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice(["Foo", "bär", "İx", "q\x85", "LINE"]) for _ in range(r.randrange(1, 6))) for _ in range(25)] + ["", " ", "\t"]
    dress = lambda x: r.choice(["", " ", "\t\x0b"]) + (x.upper() if r.random() < 0.2 else x) + r.choice(["", "\r", "  "])
    rows = [(i, "\n".join(dress(r.choice(pool)) for _ in range(r.randrange(12)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for least_chars, least_docs in ((8, 3), (0, 1), (1, 2)):
        assert result(docs, least_chars=least_chars, least_docs=least_docs) == plain(rows, least_chars, least_docs)


def test_the_largest_document_keeps_all_its_lines(spark):
    line = "a line of twenty chars"
    rows = [(1, line), (2, f"x\n{line.upper()} \ny"), (3, f"{line}\n{line}\n"), (4, line[:19]), (5, line[:19]), (6, line[:19])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == [(1, 1, 1, ""), (2, 3, 1, "x\ny"), (3, 3, 0, f"{line}\n{line}\n"), *[(i, 1, 0, line[:19]) for i in (4, 5, 6)]]
    assert result(docs.where("doc_id <> 1")) == plain(rows[1:], 20, 3)  # two documents only


def test_odd_rows(spark):
    long = "\n".join(f"a very long text, line {i // 2}" for i in range(20_000))
    line = "the same long line in all"
    rows = [(1, None), (2, ""), (None, line), (None, line), (3, line), (3, line), (3, f"{line}\nelse"), (4, line), (5, long), (6, long), (7, long), (8, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "own", "k", "place", "N_LINES", "clean_text", "line", "keep")})
    assert result(docs) == plain(rows, 20, 3)
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(docs).collect()}[6] == 20_000
    out = line_dedup.line_dedup(docs)
    assert out.where("id = 'clash' and place = 'clash'").count() == len(rows) and [c.lower() for c in out.columns].count("n_lines") == 1
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
