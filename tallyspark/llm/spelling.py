"""Grouping spelling variants: a trie of letter counts, searched with a budget of one surplus and one deficit.

Letters are put into ``GROUPS`` groups, the most frequent ones each into a group of its own. A word stands in the trie under its
counts of the first group, the second, and so on. One inserted, deleted or replaced letter leaves one count one higher, one
count one lower, or both; so a search from the top follows the equal count, or spends its surplus on the next higher or its
deficit on the next lower one. The words of the leaves it reaches are verified letter by letter.

The upper part of the trie is counted by Spark level by level: a node with more than ``LEAF`` words goes on, but there are at most
``INNER`` such nodes on a level (beyond, leaves are larger in proportion). It tells where in the cluster each branch is kept. Every word searches
the upper part, is sent to the branches it reaches with what is left of its budget, and goes on there in tries of the
same kind. Words of one vector beyond ``LEAF`` are kept in blocks of that size, and searched in each.

Defined cases: a null text has no words; a null ``doc_id`` stands as an empty text before the colon; repeated rows count each; words longer than
``WIDE`` are verified one by one; words of equal n are ordered by code point; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import textops
from tallyspark.llm.ordered import spread_join
from tallyspark.llm.shared import settled

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUPS = 20
LEAF = 4096
INNER = 1 << 13
#: Words of a leaf inside a branch.
FEW = 16
#: States of a search that are followed at once; the others wait on a stack.
STATES = 1 << 17
WIDE = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "node long, depth int, budget int, word string, n long"


def count_words(documents: DataFrame, shortest: int = 6, least: int = 5, noise: int | None = None) -> DataFrame:
    """``word`` and ``n`` of the letter runs of all texts with at least ``shortest`` letters and ``least`` occurrences.

    With ``noise``, a run whose crc32 of ``doc_id:run`` this divides loses the letter at crc32 modulo its length, which makes
    misspellings to be found again.
    """
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), 0)).alias("word"))
    runs = runs.where(F.length("word") >= shortest)
    if noise:
        code = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("code") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select("word", code.alias("code")).select(F.when(F.col("code") % noise == 0, cut).otherwise(F.col("word")).alias("word"))
        runs = runs.where(F.length("word") >= shortest)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


class Words:
    """A list of words as numbers: counts of letter groups, letter bits, lengths, and the first letters as a table."""

    def __init__(self, words: pa.Array, order: np.ndarray):
        """``order`` gives each code point its place by frequency, from 0."""
        self.words = words
        count = len(words)
        if not count:
            self.vectors, self.lengths, self.bits, self.letters = np.zeros((0, GROUPS), np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 1), np.uint8)
            return
        (chunk,) = textops.chunks(words, 1 << 62)
        place = order[chunk.points]
        self.lengths = np.diff(chunk.bounds)
        row = np.repeat(np.arange(count), self.lengths)
        group = np.where(place < GROUPS - 4, place, GROUPS - 4 + place % 4)
        self.vectors = np.bincount(row * GROUPS + group, minlength=count * GROUPS).reshape(count, GROUPS)
        self.bits = np.bitwise_or.reduceat(np.uint64(1) << (place % 64).astype(np.uint64), chunk.bounds[:-1])
        at = np.arange(len(row)) - chunk.bounds[row]
        self.letters = np.zeros((count, min(int(self.lengths.max()), WIDE) + 1), np.uint8)
        short = at < self.letters.shape[1] - 1
        self.letters[row[short], at[short]] = place[short] + 1


def same_but_one(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (``a[i]``, ``b[j]``) differ by exactly one character."""
    ok = np.zeros(len(i), bool)
    gap = b.lengths[j] - a.lengths[i]
    likely = np.flatnonzero((np.abs(gap) <= 1) & (np.bitwise_count(a.bits[i] ^ b.bits[j]) <= 2))
    long = likely[np.maximum(a.lengths[i[likely]], b.lengths[j[likely]]) > WIDE]
    for k in long.tolist():
        ok[k] = near(a.words[int(i[k])].as_py(), b.words[int(j[k])].as_py())
    likely = likely[np.maximum(a.lengths[i[likely]], b.lengths[j[likely]]) <= WIDE]
    width = min(a.letters.shape[1], b.letters.shape[1])  # both tables end in a column of zeros
    even = likely[gap[likely] == 0]
    ok[even] = (a.letters[i[even], :width] != b.letters[j[even], :width]).sum(axis=1) == 1
    for sign, short, s, long_, t in ((1, a, i, b, j), (-1, b, j, a, i)):
        odd = likely[gap[likely] == sign]
        if not len(odd):
            continue
        x, y = short.letters[s[odd]], long_.letters[t[odd]]
        w = min(x.shape[1], y.shape[1] - 1)  # the shorter word ends within
        inside = np.arange(w) < short.lengths[s[odd]][:, None]
        differs, shifted = (x[:, :w] != y[:, :w]) & inside, (x[:, :w] != y[:, 1 : w + 1]) & inside
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), w)
        last = np.where(shifted.any(axis=1), w - 1 - shifted[:, ::-1].argmax(axis=1), -1)
        ok[odd] = last < first
    return ok


def _child(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return textops.mix(keys + (counts.astype(np.uint64) + np.uint64(1)) * _STEP)


@dataclass
class Trie:
    """``nodes[d]`` are the sorted keys of the nodes at depth d whose parents go on, ``inner[d]`` whether they go on themselves."""

    nodes: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1, np.uint64)])
    inner: list[np.ndarray] = field(default_factory=lambda: [np.ones(1, bool)])
    start: int = 0

    def goes_on(self, depth: int, keys: np.ndarray) -> np.ndarray:
        place = textops.find(self.nodes[depth - self.start], keys)
        return (place >= 0) & np.append(self.inner[depth - self.start], False)[place]

    def paths(self, vectors: np.ndarray, depth: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words that stand under ``keys`` at ``start``: which reach ``depth`` through inner nodes, and their keys there."""
        rows = np.arange(len(vectors))
        for d in range(self.start, depth):
            on = self.goes_on(d, keys)
            rows, keys = rows[on], keys[on]
            keys = _child(keys, vectors[rows, d])
        return rows, keys

    def walk(self, vectors: np.ndarray, keys: np.ndarray, budgets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Depth-first from ``keys`` with ``budgets`` (2: a surplus is left, 1: a deficit): for nodes that do not go on, their depth, and
        arrays of rows, keys and budgets left."""
        every = np.arange(len(vectors))
        stack = [(self.start, every[s : s + STATES], keys[s : s + STATES], budgets[s : s + STATES]) for s in range(0, len(vectors), STATES)]
        while stack:
            depth, rows, at, left = stack.pop()
            counts = vectors[rows, depth]
            more, less = np.flatnonzero(left & 2), np.flatnonzero((left & 1) & (counts > 0))
            rows = np.concatenate([rows, rows[more], rows[less]])
            at = np.concatenate([_child(at, counts), _child(at[more], counts[more] + 1), _child(at[less], counts[less] - 1)])
            left = np.concatenate([left, left[more] - 2, left[less] - 1])
            depth += 1
            place = textops.find(self.nodes[depth - self.start], at)
            there = place >= 0
            rows, at, left, place = rows[there], at[there], left[there], place[there]
            on = self.inner[depth - self.start][place] if len(place) else np.zeros(0, bool)
            if not on.all():
                yield depth, rows[~on], at[~on], left[~on]
            rows, at, left = rows[on], at[on], left[on]
            stack += [(depth, rows[s : s + STATES], at[s : s + STATES], left[s : s + STATES]) for s in range(0, len(rows), STATES)]


class Branch:
    """The words under one node, in a trie of their own from that node on."""

    def __init__(self, words: Words, depth: int):
        self.words = words
        keys = np.zeros(len(words.vectors), np.uint64)
        self.trie = Trie(start=depth)
        self.trie.inner[0][:] = depth < GROUPS and len(keys) > FEW
        going, d = np.flatnonzero(np.full(len(keys), bool(self.trie.inner[0][0]))), depth
        while len(going):
            keys[going] = _child(keys[going], words.vectors[going, d])
            d += 1
            found, size = np.unique(keys[going], return_counts=True)
            self.trie.nodes.append(found)
            self.trie.inner.append((size > FEW) & (d < GROUPS))
            going = going[self.trie.inner[-1][textops.find(found, keys[going])]]
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def search(self, queries: Words, budgets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, word) that differ by one character."""
        keys = np.zeros(len(budgets), np.uint64)
        if self.trie.inner[0][0]:
            leaves = ((rows, at) for _, rows, at, _ in self.trie.walk(queries.vectors, keys, budgets))
        else:
            leaves = iter([(np.arange(len(keys)), keys)])
        for rows, at in leaves:
            low, high = np.searchsorted(self.keys, at), np.searchsorted(self.keys, at, side="right")
            for cut in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(high - low) // STATES)) + 1):
                many = high[cut] - low[cut]
                i, j = np.repeat(rows[cut], many), self.order[textops.ranges(low[cut], many)]
                ok = same_but_one(queries, i, self.words, j)
                yield i[ok], j[ok]


def _letters(words: DataFrame) -> np.ndarray:
    """The place of each code point by how often it occurs in the words; they are below 256, so there are few."""
    letter = F.explode(F.split("word", "")).alias("letter")
    found = words.select(letter).where(F.length("letter") == 1).groupBy("letter").agg(F.count("*").alias("n"))
    order = np.zeros(256, np.int64)
    for place, r in enumerate(found.orderBy(F.desc("n"), "letter").collect()):
        if ord(r.letter) > 255:
            raise ValueError(f"a letter beyond ÿ: {r.letter}")
        order[ord(r.letter)] = place
    return order


def upper_trie(words: DataFrame, order: np.ndarray, leaf: int, inner: int) -> tuple[Trie, dict[int, int]]:
    """The upper part of the trie over all words, and the blocks of each vector with more words than a leaf takes."""
    total = words.count()
    leaf = max(leaf, total // inner)
    trie, blocks = Trie(), {}
    trie.inner[0][:] = total > 0
    for depth in range(1, GROUPS + 1):
        if not trie.inner[-1].any():
            break

        def count(batches: Iterator[pa.RecordBatch], trie: Trie = trie, depth: int = depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                given = Words(batch.column(0), order)
                _, keys = trie.paths(given.vectors, depth, np.zeros(len(given.vectors), np.uint64))
                found, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["node", "n"])

        # under each inner node there are as many nodes as its words have different counts of one group
        rows = words.select("word").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
        keys = np.array([r.node for r in rows], np.int64).view(np.uint64)
        sizes = np.array([r.n for r in rows], np.int64)
        by_key = np.argsort(keys)
        trie.nodes.append(keys[by_key])
        trie.inner.append((sizes[by_key] > leaf) & (depth < GROUPS))
        if depth == GROUPS:
            blocks = {int(k): -(-int(n) // leaf) for k, n in zip(keys, sizes) if n > leaf}
    return trie, blocks


def near_words(words: DataFrame, leaf: int = LEAF, inner: int = INNER) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (``less``: minus n, ``form``) of all words of ``words`` (``word``, ``n``) with near words."""
    order = _letters(words)
    trie, blocks = upper_trie(words, order, leaf, inner)
    crowded = np.sort(np.array(list(blocks), np.uint64))
    counts = np.array([blocks[int(k)] for k in crowded], np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = Words(batch.column(0), order)
            size = len(given.vectors)
            for depth, rows, keys, left in trie.walk(given.vectors, np.zeros(size, np.uint64), np.full(size, 3, np.int64)):
                if depth == GROUPS and len(crowded):
                    place = textops.find(crowded, keys)
                    many = np.where(place >= 0, counts[np.maximum(place, 0)], 1)
                    home = np.array([hash_ % m for hash_, m in zip(_spread(batch.column(0), rows).tolist(), many.tolist())], np.int64)
                    block = textops.ranges(np.zeros(len(many)), many)
                    rows, keys, left, home = (np.repeat(v, many) for v in (rows, keys, left, home))
                    split = np.repeat(many, many) > 1
                    keys = np.where(split, textops.mix(keys, 3) + block.astype(np.uint64), keys)
                    left = np.where((left == 3) & (block != home), 4, left)  # asks this block, but is not kept in it
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.full(len(rows), depth, np.int32)), pa.array(left.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)],
                    ["node", "depth", "budget", "word", "n"],
                )

    routed = words.select("word", "n").mapInArrow(route, _SCHEMA)
    dealt = routed.repartition("node", "depth").sortWithinPartitions("node", "depth", (F.col("budget") == 3).desc())
    found = dealt.mapInArrow(_search(order), "word string, n_near long, less long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))


def _spread(words: pa.Array, rows: np.ndarray) -> np.ndarray:
    """A hash of each word of ``rows``."""
    (chunk,) = textops.chunks(words, 1 << 62)
    return textops.Hashes(chunk.points).of(chunk.bounds[:-1][rows], chunk.bounds[1:][rows], 17) >> np.uint64(1)


def _search(order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        kept: list[pa.RecordBatch] = []
        branch: Branch | None = None
        held: pa.Table | None = None

        def ask(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            queries = Words(part.column("word"), order)
            budgets = np.minimum(np.asarray(part.column("budget")), 3).astype(np.int64)
            names, n = held.column("word").combine_chunks(), np.asarray(held.column("n"))
            pairs = list(branch.search(queries, budgets))
            i, j = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
            if not len(i):
                return
            by_name = np.empty(len(names), np.int64)
            by_name[np.asarray(pc.sort_indices(names))] = np.arange(len(names))
            best = np.lexsort((by_name[j], -n[j], i))
            i, j = i[best], j[best]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            near_count = np.diff(np.append(first, len(i)))
            yield pa.RecordBatch.from_arrays(
                [part.column("word").take(pa.array(i[first])), pa.array(near_count), pa.array(-n[j[first]]), names.take(pa.array(j[first]))],
                ["word", "n_near", "less", "form"],
            )

        def settle() -> None:
            nonlocal branch, held
            if branch is None and kept:
                held = pa.Table.from_batches(kept)
                branch = Branch(Words(held.column("word").combine_chunks(), order), at[1])

        def finish() -> Iterator[pa.RecordBatch]:
            settle()
            for part in kept:  # the words kept here have not asked yet
                yield from ask(part)

        for batch in batches:
            if not batch.num_rows:
                continue
            node, depth, own = (np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)) == 3)
            change = np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1]) | (own[1:] != own[:-1])) + 1
            for begin, end in zip([0, *change.tolist()], [*change.tolist(), len(node)]):
                if at != (int(node[begin]), int(depth[begin])):
                    yield from finish()
                    at, kept, branch, held = (int(node[begin]), int(depth[begin])), [], None, None
                part = batch.slice(begin, end - begin)
                if own[begin]:
                    kept.append(part)
                elif kept:
                    settle()
                    yield from ask(part)
        yield from finish()

    return run


def follow(links: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last that is reached from each word of ``links`` (``word``, ``form``), which has no circles."""
    points = settled(links.select("word", F.col("form").alias("root")))
    while True:
        onward = points.select(F.col("word").alias("root"), F.col("root").alias("next"))
        onward = onward.join(points.select("root").distinct(), "root", "left_semi")
        moved = settled(spread_join(points, onward, "root", F.xxhash64("word"), "left"))
        if moved.where(F.col("next").isNotNull()).isEmpty():
            return points
        points = moved.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, ratio: int = 5, leaf: int = LEAF, inner: int = INNER) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form`` and ``form_n`` (its most frequent near word, if at least ``ratio`` times as frequent) and ``root`` (the last
    of the forms, or the word itself) of every word of ``words`` (distinct ``word``, ``n``)."""
    words = settled(words.select("word", "n"))
    joined = words.join(near_words(words, leaf, inner), "word", "left")
    far = -F.col("best.less") >= ratio * F.col("n")
    found = settled(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")
        )
    )
    roots = follow(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
