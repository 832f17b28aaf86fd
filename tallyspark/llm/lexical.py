"""Ranked lexical search over bit-sliced Bloom signatures.

Terms are the longest stretches of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased. Each
document gets a Bloom signature of its terms: a term that occurs tf times is entered for 1, 2, 4, ... up to tf. Documents of
alike size stand together in blocks, and a block is kept by slices: for each place of the signature one bitmap with a bit for
each document. The bitmap of a term is the conjunction of its slices; it holds all documents with the term, and a few more.

For a set of items, the bitmaps times the weights of the terms sum up to a bound of each document's score, since the
levels of a term also bound its tf. The documents with the highest bounds are scored exactly; the k-th best of these scores
excludes all documents whose bound is below it. Every document not excluded is scored from its whole text.

Items are taken in blocks of at most ``ITEMS_BYTES`` (an item counts 512 besides its text; a longer item is a block of its
own); a block's terms and thresholds are sent to every task. Documents are never sorted or moved to build the signatures.

Defined cases: a null text has no terms; documents and items without terms are in no result; repeated document rows count
and rank each by itself, as do repeated item rows; a null ``doc_id`` comes last among equal scores; very long texts have
long signatures in blocks of eight documents; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import textops
from tallyspark.llm.ordered import running
from tallyspark.llm.shared import settled
from tallyspark.session import work_dir

#: Bits of a signature for each entry, and bits set by an entry: about one in 150 absent terms seems present.
BITS, PROBES = 12, 4
#: A block holds at most so many documents, and fewer if its slices would be larger than this.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 18
#: Entries that wait in a task for their block to fill.
WAITING = 4_000_000
ITEMS_BYTES = 1 << 18
#: Documents with the highest bounds that are scored first, for each one wanted.
FIRST = 3
_SEED = 13
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or "").encode().translate(_TERM_BYTES).split(b" ") if text else []


def counted(text: str | None) -> Counter:
    found = Counter(terms(text))
    found.pop(b"", None)
    return found


def _hashed(texts: pa.Array) -> Iterator[tuple[textops.Chunk, np.ndarray, np.ndarray]]:
    """For each chunk of texts: the row and the hash of every term."""
    for chunk in textops.chunks(texts):
        p = chunk.points
        upper = (p >= 65) & (p <= 90)
        starts, ends = chunk.runs(upper | (p >= 128) | ((p >= 97) & (p <= 122)) | ((p >= 48) & (p <= 57)))
        yield chunk, chunk.row_of(starts), textops.Hashes(np.where(upper, p + 32, p)).of(starts, ends, _SEED)


def _places(hashes: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """The signature's places of entries, one row for each entry."""
    keys = textops.mix(hashes + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), _SEED)
    first, step = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def _levels(counts: np.ndarray) -> np.ndarray:
    """How many of 1, 2, 4, ... a count reaches."""
    return np.frexp(counts.astype(float))[1]


def _block(waiting: list[tuple], bits: int) -> dict:
    rows = len(waiting)
    slices = np.zeros((bits, -(-rows // 8) * 8), bool)
    levels = 0
    for row, (_, _, hashes, counts) in enumerate(waiting):
        reached = _levels(counts)
        levels = max(levels, int(reached.max()))
        slices[_places(np.repeat(hashes, reached), textops.ranges(np.zeros(len(reached)), reached), bits), row] = True
    packed = np.packbits(slices, axis=1).tobytes()
    return {"bits": bits, "levels": levels, "ids": [w[0] for w in waiting], "sizes": [w[1] for w in waiting], "slices": packed}


def _sign(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        entries = 0
        out = lambda rows: pa.RecordBatch.from_pylist(rows, schema)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk, rows, hashes in _hashed(batch.column(1)):
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
                first = np.flatnonzero(new)
                counts = np.diff(np.append(first, len(rows)))
                rows, hashes = rows[first], hashes[first]
                cuts = np.searchsorted(rows, np.arange(chunk.rows + 1))
                for row, (begin, end) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    if begin == end:
                        continue
                    own = counts[begin:end]
                    size = int(_levels(own).sum())
                    kind = math.ceil(2 * math.log2(max(size, 16)))
                    bits = math.ceil(2 ** (kind / 2)) * BITS
                    group = waiting.setdefault(bits, [])
                    group.append((ids[chunk.first + row], int(own.sum()), hashes[begin:end].copy(), own.copy()))
                    entries += end - begin
                    if len(group) >= min(BLOCK_ROWS, max(8, BLOCK_BYTES * 8 // bits // 8 * 8)):
                        entries -= sum(len(w[2]) for w in group)
                        yield out([_block(waiting.pop(bits), bits)])
                if entries > WAITING:
                    for bits in list(waiting):
                        yield out([_block(waiting.pop(bits), bits)])
                    entries = 0
        for bits in list(waiting):
            yield out([_block(waiting.pop(bits), bits)])

    return sign


def sign(documents: DataFrame) -> DataFrame:
    """The signatures of all documents, a row for each block, written to the shared folder and read again: ``bits`` of a
    signature, highest ``levels``, ``ids`` and ``sizes`` (terms with repeats) of the documents, ``slices``."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType
    fields = [("bits", T.IntegerType()), ("levels", T.IntegerType()), ("ids", T.ArrayType(kind)), ("sizes", T.ArrayType(T.LongType())), ("slices", T.BinaryType())]
    schema = T.StructType([T.StructField(name, t) for name, t in fields])
    path = work_dir(spark, "signatures")
    from pyspark.sql.pandas.types import to_arrow_schema

    made = documents.select("doc_id", "text").mapInArrow(_sign(to_arrow_schema(schema)), schema)
    made.write.option("parquet.block.size", 16 << 20).parquet(path)  # small row groups bound what a task reads at once
    return spark.read.parquet(path)


@dataclass
class Items:
    """A block of items: their numbers, and for each distinct term its weight and in which items it stands how often."""

    numbers: list[int]
    words: list[bytes]
    weights: np.ndarray
    at: np.ndarray
    word: np.ndarray
    times: np.ndarray
    documents: int
    total: int

    def measure(self, sizes: np.ndarray) -> np.ndarray:
        """What the length of each document weighs against tf."""
        return 75 + (25 * sizes * self.documents) // max(self.total, 1)

    def hashes(self) -> np.ndarray:
        found = [h for _, _, h in _hashed(pa.array([w.decode() for w in self.words], pa.string()))]
        return np.concatenate([np.zeros(0, np.uint64), *found])

    def matrix(self) -> np.ndarray:
        """Weight times occurrences, for each item and term."""
        whole = np.zeros((len(self.numbers), len(self.words)))
        whole[self.at, self.word] = self.times * self.weights[self.word]
        return whole


def _part(tf: np.ndarray, measure: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * measure)


def bounds(items: Items, hashes: np.ndarray, matrix: np.ndarray, bits: int, levels: int, sizes: np.ndarray, slices: bytes) -> np.ndarray:
    """The bound of each item (row) and document (column) of a block."""
    width = -(-len(sizes) // 8)
    packed = np.frombuffer(slices, np.uint8).reshape(bits, width)
    measure = items.measure(sizes)
    total = np.zeros((len(items.numbers), len(sizes)), np.int64)
    left, holds, below = np.arange(len(hashes)), None, np.zeros(len(sizes), np.int64)
    for level in range(levels):
        found = np.bitwise_and.reduce(packed[_places(hashes[left], level, bits)], axis=1)
        holds = found if holds is None else holds & found
        some = holds.any(axis=1)
        left, holds = left[some], holds[some]
        if not len(left):
            break
        present = np.unpackbits(holds, axis=1, count=len(sizes)).astype(float)
        here = _part(np.minimum((2 << level) - 1, sizes), measure)  # the most a term of this level and not the next can add
        total += (matrix[:, left] @ present).astype(np.int64) * (here - below)
        below = here
    return total


_BOUND = "item int, doc_id {kind}, bound long"


def _bounded(signatures: DataFrame, items: Items, keeper: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """``item``, ``doc_id``, ``bound`` of the documents that ``keeper()``, made anew in each task, marks in the bounds of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, matrix, numbers, keep = items.hashes(), items.matrix(), np.asarray(items.numbers, np.int32), keeper()
        for batch in batches:
            for row in range(batch.num_rows):
                bits, levels, ids, sizes, slices = (batch.column(c)[row] for c in range(5))
                found = bounds(items, hashes, matrix, bits.as_py(), levels.as_py(), np.asarray(sizes.values), slices.as_py())
                at, place = np.nonzero(keep(found) & (found > 0))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers[at]), ids.values.take(pa.array(place)), pa.array(found[at, place])], ["item", "doc_id", "bound"]
                    )

    kind = signatures.schema["ids"].dataType.elementType.simpleString()
    return signatures.select("bits", "levels", "ids", "sizes", "slices").mapInArrow(run, _BOUND.format(kind=kind))


def _best(found: DataFrame, k: int, value: str) -> DataFrame:
    """The k highest of each item, equal ones by ascending ``doc_id``, with their ``rank``; cut in parts first, so that no task gets all
    rows of an item."""
    order = [F.col(value).desc(), F.col("doc_id").asc_nulls_last()]
    parts = found.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    parts = parts.withColumn("_place", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order))).where(F.col("_place") <= k)
    ranked = parts.drop("_part", "_place").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def _scored(documents: DataFrame, wanted: DataFrame, items: Items) -> DataFrame:
    """``item``, ``doc_id`` and exact ``score`` of all documents with a ``doc_id`` of ``wanted`` (``item``, ``doc_id``)."""
    spark = documents.sparkSession
    path = work_dir(spark, "wanted")
    wanted.groupBy("doc_id").agg(F.collect_set("item").alias("items")).write.parquet(path)
    asked = spark.read.parquet(path).withColumnRenamed("doc_id", "_wanted")  # its size is known: Spark sends it to all tasks if small
    texts = documents.select("doc_id", "text").join(asked, F.col("doc_id").eqNullSafe(F.col("_wanted"))).select("doc_id", "items", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(items.at, kind="stable")
        cuts = np.searchsorted(items.at[order], np.arange(len(items.numbers) + 1))
        word, factor = items.word[order], (items.times * items.weights[items.word])[order]
        place = {n: i for i, n in enumerate(items.numbers)}
        known = {w: i for i, w in enumerate(items.words)}
        for batch in batches:
            item, row, score = [], [], []
            for at, (asked_for, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                held = counted(text.as_py())
                tf = np.zeros(len(known), np.int64)
                for w in held.keys() & known.keys():
                    tf[known[w]] = held[w]
                parts = _part(tf, items.measure(np.int64(held.total())))
                for number in asked_for:
                    own = slice(*cuts[place[number] : place[number] + 2])
                    item.append(number), row.append(at), score.append(int((factor[own] * parts[word[own]]).sum()))
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"item int, doc_id {kind}, score long").where("score > 0")


def _frequencies(documents: DataFrame, words: list[bytes]) -> dict[int, int]:
    """In how many documents each word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(words)}
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for text in batch.column(0):
                for w in known.keys() & set(terms(text.as_py())):
                    total[known[w]] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["word", "df"])

    counted_ = documents.select("text").mapInArrow(run, "word int, df long").groupBy("word").agg(F.sum("df").alias("df"))
    return {r.word: r.df for r in counted_.collect()}


def _items(documents: DataFrame, rows: list, count: int, total: int) -> Items:
    """The rows of a block with the weights of their terms; terms that no document holds add nothing."""
    held = [counted(r.text) for r in rows]
    words = sorted(set().union(*held))
    df = _frequencies(documents, words)
    words = [words[i] for i in sorted(df)]
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * df[i] + 1))) for i in sorted(df)], np.int64)
    known = {w: i for i, w in enumerate(words)}
    cells = [(at, known[w], n) for at, terms_ in enumerate(held) for w, n in terms_.items() if w in known]
    at, word, times = (np.array(c, np.int64) for c in zip(*cells)) if cells else (np.zeros(0, np.int64),) * 3
    return Items([r.number for r in rows], words, weights, at, word, times, count, total)


def search(documents: DataFrame, items: DataFrame, k: int = 20, signatures: DataFrame | None = None) -> DataFrame:
    """For each row of ``items`` (``item_id``, ``text``) the k highest-scoring documents with a score above 0: ``item_id``,
    ``rank``, ``doc_id``, ``score``; equal scores by ascending ``doc_id``."""
    signatures = sign(documents) if signatures is None else signatures
    sums = F.aggregate("sizes", F.lit(0).cast("long"), lambda x, n: x + n)
    count, total = (int(v or 0) for v in signatures.agg(F.sum(F.size("sizes")), F.sum(sums)).first())
    ordered = [F.col("item_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + 512
    placed = running(items.select("item_id", "text"), ordered, {"number": F.lit(1), "bytes": weight})
    placed = settled(placed.select(F.col("number").cast("int").alias("number"), "item_id", "text", F.floor((F.col("bytes") - weight) / ITEMS_BYTES).alias("block")))
    parts = []
    for row in placed.select("block").distinct().orderBy("block").toLocalIterator():
        block = placed.where(F.col("block") == row.block)
        asked = _items(documents, block.select("number", "text").orderBy("number").collect(), count, total)
        parts.append(_ranked(documents, signatures, asked, k))
    if not parts:
        kind = documents.schema["doc_id"].dataType
        return placed.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    named = found.join(placed.select(F.col("number").alias("item"), "item_id"), "item")
    return named.select("item_id", "rank", "doc_id", "score")


def _ranked(documents: DataFrame, signatures: DataFrame, items: Items, k: int) -> DataFrame:
    first = FIRST * k

    def highest() -> Callable[[np.ndarray], np.ndarray]:
        best = np.zeros((len(items.numbers), first), np.int64)  # of the blocks seen by the task

        def keep(found: np.ndarray) -> np.ndarray:
            best[:] = np.partition(np.concatenate([best, found], axis=1), -first, axis=1)[:, -first:]
            return found >= best.min(axis=1)[:, None]

        return keep

    likely = _best(_bounded(signatures, items, highest), first, "bound")
    scores = _best(_scored(documents, likely.select("item", "doc_id"), items), k, "score")
    worst = {r.item: r.score for r in scores.where(F.col("rank") == k).select("item", "score").collect()}
    floor = np.array([worst.get(n, 1) for n in items.numbers], np.int64)
    left = _bounded(signatures, items, lambda: lambda found: found >= floor[:, None])
    return _best(_scored(documents, left.select("item", "doc_id"), items), k, "score")
