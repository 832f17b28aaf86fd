"""An inverted index of the letters of texts: which three letters stand where, to find parts of words without reading texts.

Every place of a text gives one posting, the three characters that begin there (fewer before the end of a text). A phrase occurs where
trigrams that cover it stand next to each other, so the index answers exactly by itself; one or two characters are the beginning of a
trigram. A task numbers the characters of its texts, its segment of the index, and sorts them some millions at a time; a row holds the
ascending places of a trigram there, which Parquet keeps as differences. No posting is moved between tasks, and none is ever a row of
its own. Rows of the empty trigram tell where the texts of a segment begin and whose they are. Rows are written in the order of the
trigram and in small pages, so that a search reads the few it names, and where texts begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: How postings are written: places as differences, and pages small enough to be passed over.
WRITTEN = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.page.row.count.limit": "1000",
}
_ROWS = "trigram string, segment int, places array<long>, name string"
_CHUNK = 1 << 23  # characters sorted together
_PLACES = 1 << 16  # places in a row
_BATCH = 1 << 20  # places in a batch of rows
_END = "\ud800"  # no character of a text; stands behind each


def postings(texts: DataFrame, chunk: int = _CHUNK) -> DataFrame:
    """(trigram, segment, places, name) of the texts (name, text); ``name`` only in the rows of the empty trigram."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId()
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        done = size = 0
        for batch in batches:
            if batch.num_rows:
                names.append(batch.column("name"))
                held.append(_points(batch.column("text")))
                size += len(held[-1])
            if size >= chunk:
                yield from _rows(segment, done, np.concatenate(held), pa.chunked_array(names), chunk)
                done, size, names, held = done + size, 0, [], []
        if size:
            yield from _rows(segment, done, np.concatenate(held), pa.chunked_array(names), chunk)

    return texts.filter(F.length("text") > 0).select("name", "text").mapInArrow(index, _ROWS)


def _points(texts: pa.Array) -> np.ndarray:
    """Code points of the texts, each raised by one, and 0 behind every text."""
    joined = _END.join([*texts.to_pylist(), ""]).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(joined, np.dtype("<u4"))
    return np.where(points == ord(_END), 0, points + 1)


def _rows(segment: int, before: int, points: np.ndarray, names: pa.ChunkedArray, chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole texts, ``before`` characters into the segment."""
    ends = np.flatnonzero(points == 0)
    starts = np.concatenate([[0], ends[:-1] + 1]) + before
    for first in range(0, len(starts), 1 << 16):
        some = starts[first : first + (1 << 16)]
        yield _batch([""] * len(some), segment, some, np.arange(len(some) + 1), names.slice(first, len(some)).combine_chunks())
    for first in range(0, len(points), chunk):
        yield from _postings(segment, before + first, points[first : first + chunk + 2], chunk)


def _postings(segment: int, before: int, points: np.ndarray, chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows of the first ``chunk`` places of ``points``; characters beyond only end the trigrams that begin before."""
    n = min(chunk, len(points))
    used = np.zeros(int(points.max()) + 2, bool)
    used[points] = used[0] = True
    letters = np.flatnonzero(used)
    code = (np.cumsum(used) - 1).astype(np.uint64)[np.concatenate([points, [0, 0]])]
    k, bits = len(letters), np.uint64(n.bit_length())
    two = code[1 : n + 1]
    gram = code[:n] * np.uint64(k)
    gram += two
    gram *= np.uint64(k)
    gram += np.where(two == 0, 0, code[2 : n + 2])
    del code, two
    if k**3 << n.bit_length() < 1 << 64:
        gram <<= bits
        gram |= np.arange(n, dtype=np.uint64)
        gram.sort()
        place = (gram & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
        gram >>= bits
    else:
        place = np.argsort(gram, kind="stable")
        gram = gram[place]
    skipped = int(np.searchsorted(gram, np.uint64(k * k)))  # where a text ends, none begins
    gram, place = gram[skipped:], place[skipped:] + before
    if not len(gram):
        return
    heads = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    pieces = -(-np.diff(np.append(heads, len(gram))) // _PLACES)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    bounds = np.append(np.repeat(heads, pieces) + nth * _PLACES, len(gram))
    row = 0
    while row < len(bounds) - 1:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + _BATCH, side="right")) - 1)
        last = min(last, len(bounds) - 1)
        cuts = bounds[row : last + 1]
        yield _batch(_texts(gram[cuts[:-1]], letters), segment, place[cuts[0] : cuts[-1]], cuts - cuts[0], pa.nulls(len(cuts) - 1, pa.string()))
        row = last


def _texts(grams: np.ndarray, letters: np.ndarray) -> list[str]:
    k = np.uint64(len(letters))
    points = letters[np.stack([grams // (k * k), grams // k % k, grams % k], axis=1).astype(np.int64)]
    lengths = (points > 0).sum(axis=1).tolist()
    text = np.maximum(points - 1, 0).astype("<u4").tobytes().decode("utf-32-le")
    return [text[3 * i : 3 * i + length] for i, length in enumerate(lengths)]


def _batch(trigrams: list[str], segment: int, places: np.ndarray, cuts: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(places, pa.int64()))
    columns = [pa.array(trigrams, pa.string()), pa.array(np.full(len(trigrams), segment, np.int32)), lists, names.cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["trigram", "segment", "places", "name"])


def _trigrams(phrase: str) -> list[tuple[str, int]]:
    """Trigrams that cover a phrase, and where they stand in it."""
    last = max(len(phrase) - 3, 0)
    return [(phrase[i : i + 3], i) for i in [*range(0, last, 3), last]]


def containing(index: DataFrame, phrases: list[str]) -> DataFrame:
    """(name, phrase) for every name with a text that contains a phrase (a number into ``phrases``, which are not empty); one scan."""
    wanted: dict[str, list[tuple[int, int]]] = {"": [(0, 0)]}  # phrases count from 1 here; 0 is where a text begins
    for number, phrase in enumerate(phrases, 1):
        for trigram, offset in _trigrams(phrase):
            wanted.setdefault(trigram, []).append((number, offset))

    def is_wanted(trigram: str) -> Column:
        return F.col("trigram").startswith(trigram) if 0 < len(trigram) < 3 else F.col("trigram") == trigram

    whole = [t for t in wanted if len(t) == 3]
    test = is_wanted("") | F.col("trigram").isin(whole) if whole else is_wanted("")
    for short in (t for t in wanted if 0 < len(t) < 3):
        test = test | is_wanted(short)
    asked = F.concat(
        *(
            F.when(is_wanted(t), F.array(*(F.struct(F.lit(n).alias("phrase"), F.lit(o).alias("offset")) for n, o in at))).otherwise(
                F.array().cast("array<struct<phrase: int, offset: int>>")
            )
            for t, at in wanted.items()
        )
    )
    hits = index.filter(test).select("segment", "name", "places", F.inline(asked))
    hits = hits.select("segment", "name", "phrase", "offset", F.explode("places").alias("place"))
    # a segment is looked up in one task: it has the places of one task that wrote
    starts = hits.select("segment", "name", "phrase", (F.col("place") - F.col("offset")).alias("start")).repartition("segment")
    counts = starts.groupBy("segment", "start", "phrase", "name").agg(F.count(F.lit(1)).alias("n"))
    need = F.get(F.array(F.lit(1), *(F.lit(len(_trigrams(p))) for p in phrases)), F.col("phrase"))
    text = F.last(F.when(F.col("phrase") == 0, F.struct("name")), ignorenulls=True)
    so_far = W.partitionBy("segment").orderBy("start", "phrase").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = counts.filter(F.col("n") == need).select("phrase", text.over(so_far).alias("text")).filter(F.col("phrase") > 0)
    return found.select("text.name", (F.col("phrase") - 1).alias("phrase")).distinct()
