"""Spelling variants against plain Python, and the defined cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import spelling
from tallyspark.llm.queries import QUERIES

MID = "/root/testdata/sf0.01"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows, shortest=6, least=5, noise=199):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= shortest
    return {w: n for w, n in found.items() if n >= least}


def plain_variants(words, ratio=5):
    holes = defaultdict(set)  # every pair that is near shares a word with one letter left out or blotted out
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
            holes[w[:i] + w[i + 1 :]].add(w)
        holes[w].add(w)
    nears = {}
    for w in words:
        others = set().union(holes[w], *(holes[w[:i] + "\0" + w[i + 1 :]] for i in range(len(w))), *(holes.get(w[:i] + w[i + 1 :], set()) & {w[:i] + w[i + 1 :]} for i in range(len(w))))
        nears[w] = {o for o in others if o != w and spelling.near(w, o)}
    form = {}
    for w, others in nears.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), n, len(nears[w]), words.get(form.get(w))) for w, n in words.items()}


def by_word(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_query_equals_plain_python(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text").collect()
    want = plain_variants(plain_words(docs))
    assert by_word(QUERIES["op12_spelling"](spark, MID)) == want
    assert sum(v[0] is not None for v in want.values()) > 100 and sum(v[0] != v[1] and v[0] is not None for v in want.values()) > 0


@pytest.mark.parametrize("leaf, inner", [(4096, 8192), (3, 1 << 20), (5, 2)])
def test_leaves_and_blocks_of_any_size(spark, leaf, inner, monkeypatch):
    monkeypatch.setattr(spelling, "STATES", 50)
    rng = random.Random(leaf)
    words = {"".join(rng.choices("abcé", k=rng.choice([6, 7, 8]))): rng.choice([5, 9, 50, 400, 4000]) for _ in range(1500)}
    words |= {"".join(rng.sample("abcdefgh", 8)): 5 + i % 50 for i in range(300)}  # one vector, many words
    words |= {"x" * 63: 7, "x" * 64: 40, "x" * 65: 300, "x" * 66: 9000, "x" * 30 + "y" + "x" * 34: 50, "x" * 500: 5, "x" * 499 + "z": 25, "z" + "x" * 500: 7}
    words |= {"qwüvßÿ": 5, "qwüvßÿk": 5, "qkwüvßÿ": 5}
    frame = spark.createDataFrame([(w, n, "c") for w, n in words.items()], "word string, n long, form string").repartition(7)
    assert by_word(spelling.variants(frame, leaf=leaf, inner=inner)) == plain_variants(words)


def test_one_different_character():
    rng = random.Random(3)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 7))) for _ in range(300)]
    order = np.zeros(256, np.int64)
    order[98] = 1
    given = spelling.Words(pa.array(words), order)
    i, j = (a.ravel() for a in np.meshgrid(np.arange(300), np.arange(300)))
    def distance(a, b):
        row = list(range(len(b) + 1))
        for x, ca in enumerate(a, 1):
            row, last = [x], row
            for y, cb in enumerate(b, 1):
                row.append(min(last[y] + 1, row[-1] + 1, last[y - 1] + (ca != cb)))
        return row[-1]
    want = [distance(words[a], words[b]) == 1 for a, b in zip(i.tolist(), j.tolist())]
    assert spelling.same_but_one(given, i, given, j).tolist() == want
    assert [spelling.near(words[a], words[b]) for a, b in zip(i.tolist(), j.tolist())] == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Straße straße STRASSE " * 9), (4, "ÀÉÎÕÜß àéîõüß " * 8), (5, "naïveté x naïvete " * 300), (5, "naïveté x naïvete " * 300), (6, "a" * 9000 + " " + "b1c_d")] * 3
    docs = spark.createDataFrame([(*r, 1, "f", "w") for r in rows], "doc_id long, text string, n int, form string, word string")
    found = by_word(spelling.variants(spelling.count_words(docs, noise=199)))
    assert found == plain_variants(plain_words(rows)) and "ÀÉÎÕÜß" in found and "straße" in found
    assert by_word(spelling.variants(spelling.count_words(docs.limit(0)))) == {}


def test_many_words_of_one_form(spark):
    words = {"standard": 10_000} | {"standard"[:i] + c + "standard"[i + 1 :]: 6 for i in range(8) for c in "bcefghijkl" if c != "standard"[i]} | {"standards": 1500, "standardss": 200}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = by_word(spelling.variants(frame))
    assert found == plain_variants(words) and found["standardss"][:2] == ("standards", "standard")
