"""Lexical search against plain Python over all documents, and its defined cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, score string, item int, rank string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, k=20):
    held = [(doc_id, Counter(terms(text))) for doc_id, text in rows]
    held = [h for h in held if h[1]]
    count, total = len(held), sum(h[1].total() for h in held)
    df = Counter(t for _, h in held for t in h)
    found = []
    for item_id, text in items:
        scores = []
        for doc_id, h in held:
            m, score = 75 + 25 * h.total() * count // total, 0
            for t in terms(text):
                if h[t]:
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * h[t] // (1000 * h[t] + 12 * m))
            if score:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        found += [(item_id, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(found, key=str)


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "abcdé" for b in "xyz漢" for c in range(12)]
    made = [(i, " ".join(rng.choices(vocabulary, weights=range(1, 241), k=rng.choice([3, 20, 60, 300]))).title()) for i in range(400)]
    made += [(None, "ax0 ax0 bz3"), (None, "ax1 cy7"), (900, ""), (901, None), (902, " ,;\n\t"), (903, "ax0 " * 70_000 + "dz11"), (904, "bx1-BX1.bx1\x00cx2")]
    return made + [(905, "ax0 ax1 bz3 cy7")] * 130 + [(3, "dz11 dz11 cz5")]


@pytest.fixture(scope="module")
def items():
    return [(1, "ax0, ax1! bz3 cy7 ax0"), (2, "nowhere"), (3, ""), (4, None), (None, "é漢3 DZ11 dz11"), (1, "cz5 dz11 x"), (7, "ax0 " * 40 + "bx1"), (1, "cz5 dz11 x")]


def ranked(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1 << 18, 600])
def test_search_equals_plain_python(spark, rows, items, block, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS_BYTES", block)
    asked = spark.createDataFrame([(*i, 2, "c") for i in items], "item_id int, text string, number int, block string")
    found = lexical.search(documents(spark, rows).repartition(5), asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and ranked(found) == plain(rows, items)


def test_bounds_are_never_below_the_score(spark, rows, items):
    signatures = lexical.sign(documents(spark, rows))
    held = [(d, Counter(terms(t))) for d, t in rows if terms(t)]
    count, total = len(held), sum(h.total() for _, h in held)
    assert signatures.agg(F.sum(F.size("ids"))).first()[0] == count
    asked = lexical._items(documents(spark, rows), [type("R", (), {"number": n, "text": t}) for n, (_, t) in enumerate(items)], count, total)
    by_id = {d: h for d, h in held if d is not None and d != 3}
    close = 0
    for block in signatures.collect():
        found = lexical.bounds(asked, asked.hashes(), asked.matrix(), block.bits, block.levels, np.array(block.sizes), bytes(block.slices))
        for column, doc_id in enumerate(block.ids):
            if doc_id in by_id:
                tf = np.array([by_id[doc_id][w.decode()] for w in asked.words])
                parts = lexical._part(tf, asked.measure(np.int64(by_id[doc_id].total()))) * asked.weights
                exact = [int((parts[asked.word] * asked.times)[asked.at == i].sum()) for i in range(len(items))]
                assert (found[:, column] >= exact).all()
                close += (found[:, column] <= 1.5 * np.array(exact) + 1).mean()
    assert close >= 0.8 * len(by_id)


def test_few_documents_are_scored_exactly(spark, rows):
    asked, scored = spark.createDataFrame([(1, "ax9 bz3 cy7")], "item_id int, text string"), []
    whole = lexical._scored

    def watched(docs, wanted, items):
        scored.append(wanted.count())
        return whole(docs, wanted, items)

    lexical._scored = watched
    try:
        lexical.search(documents(spark, rows[:400]), asked, k=3).collect()
    finally:
        lexical._scored = whole
    assert scored[-1] <= 60


def test_empty_tables(spark, rows, items):
    nothing = spark.createDataFrame([], "item_id int, text string")
    assert lexical.search(documents(spark, rows), nothing).collect() == []
    assert lexical.search(documents(spark, []), spark.createDataFrame(items, "item_id int, text string")).collect() == []
