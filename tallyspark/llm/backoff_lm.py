"""Stupid-backoff language-model scores of documents, against counts over the whole corpus.

The distinct n-grams of a block of documents go, with how often they occur there, to the slice of hashes they belong to. A slice sums
them to its part of the count table and joins that to them; for each n-gram of a block that several documents hold, a row of block,
place among the block's sorted hashes and count comes back. N-grams that one document alone holds are left out: for that document they
are unseen. The block gives the scores of its words, which are summed for each document. Blocks are neighbouring documents; their
number changes nothing else.

Between tasks n-grams travel together: those of a block in one of ``_SLICES`` slices as ascending differences, with the counts above one
beside them, and answers as differences of places and counts. Spark deals and sorts slices and blocks; only the sums over a slice are
numpy. A block sends as many messages as there are slices, however many blocks there are.

A word that follows others scores count(n-gram) / count(history) for the longest n-gram that other documents hold, times
``backoff`` for each word of history given up; one that no other document holds scores as if seen half a time. The
document's own counts are left out, so that a text is scored by the rest of the corpus.

Words are the longest stretches without space or control from tab to carriage return, A-Z lowered. Defined cases: a text
that is null or without words has no n-grams, 0 as sum, and null as mean. Repeated rows are documents of their own and
count for each other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.runs import whole_runs
from tallyspark.llm.shared import give_back
from tallyspark.llm.textops import Hashes, chunks, mix

#: Bits of a hash: a long that is not negative.
_BITS = 63
#: Slices of the hashes, a power of two; the rows of one are sorted together.
_SLICES = 4096
_SLICE_BITS = np.uint64(_BITS - _SLICES.bit_length() + 1)
#: Parts of the hashes, a power of two, that a block sorts one after the other; a part has whole slices.
_PARTS = 8
_PART_BITS = np.uint64(_BITS - _PARTS.bit_length() + 1)
#: N-grams or words that a task works on together, about, and rows and bytes of texts: what it holds beside the block or the slice at hand.
_TOGETHER = 1 << 18
_ROWS = 500
_BYTES = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``order`` of the longest n-gram, ``block_bytes`` of text in a block, about."""

    order: int = 3
    backoff: float = 0.4
    block_bytes: int = 8 << 20


@dataclass
class Grams:
    """Hashes of the n-grams of a block: for each order the document and the hash at every word, in word order. ``fits``
    tells where the words before belong to the same document."""

    rows: np.ndarray
    fits: list[np.ndarray]
    hashes: list[np.ndarray]


def grams(texts: pa.Array | pa.ChunkedArray, order: int) -> Grams:
    rows, words = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    for chunk in chunks(texts, _BYTES):
        starts, ends = chunk.runs(chunk.not_space())
        p = chunk.points
        words.append(Hashes(np.where((p >= 65) & (p <= 90), p + 32, p)).of(starts, ends))
        rows.append((chunk.first + chunk.row_of(starts)).astype(np.int32))
    row, word = np.concatenate(rows), np.concatenate(words)
    del rows, words
    fits, hashes = [], []
    for n in range(1, order + 1):
        fit = np.zeros(len(row), bool)
        fit[n - 1 :] = row[n - 1 :] == row[: max(len(row) - n + 1, 0)]
        value = np.zeros(len(row), np.uint64)
        for a in range(n - 1, len(row), _TOGETHER):
            b = min(a + _TOGETHER, len(row))
            part = np.zeros(b - a, np.uint64)
            for k in range(n):
                part = mix(part + word[a - n + 1 + k : b - n + 1 + k], k + 1)
            value[a:b] = mix(part, 40 + n) >> np.uint64(64 - _BITS)
        fits.append(fit)
        hashes.append(value)
    return Grams(row, fits, hashes)


def _parts(found: Grams) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The n-grams of a block by parts of the hashes, ascending: for each order the words at which they are, and the hashes of all orders."""
    parts = [np.where(fit, h >> _PART_BITS, _PARTS).astype(np.uint8) for fit, h in zip(found.fits, found.hashes)]
    for k in range(_PARTS):
        some = [np.flatnonzero(part == k) for part in parts]
        yield some, np.concatenate([h[s] for h, s in zip(found.hashes, some)])


def _distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, how often they occur, and whether in several documents."""
    order = np.argsort(values)
    values, rows = values[order], rows[order]
    del order
    firsts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    several = np.minimum.reduceat(rows, firsts) != np.maximum.reduceat(rows, firsts)
    return values[firsts], np.diff(np.append(firsts, len(values))), several


def _places(found: Grams) -> tuple[int, list[np.ndarray]]:
    """Number of distinct hashes, and for each order the place of the n-gram at every word among them sorted, from 1; 0 stands for none."""
    size, places = 0, [np.zeros(len(fit), np.int32) for fit in found.fits]
    for some, values in _parts(found):
        keys, inverse = np.unique(values, return_inverse=True)
        at = 0
        for place, words in zip(places, some):
            place[words] = inverse[at : at + len(words)] + (size + 1)
            at += len(words)
        size += len(keys)
    return size, places


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in seven bits a byte, the lowest first, and where each begins; the last is the end."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >= np.uint64(1 << bits)
    starts = np.append(0, np.cumsum(sizes))
    out = np.zeros(int(starts[-1]), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = sizes > k
        part = (values[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[starts[:-1][some] + k] = part + np.uint64(128) * (sizes[some] > k + 1)
    return out, starts


def _from_varints(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    starts = np.append(0, last[:-1] + 1)[: len(last)]
    values, sizes = np.zeros(len(last), np.uint64), last - starts + 1
    for k in range(int(sizes.max(initial=0))):
        some = sizes > k
        values[some] |= (data[starts[some] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return values.astype(np.int64)


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The stretches between the bounds as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


_BLOCKS = "block long, texts binary"
_MESSAGES = "slice int, block long, first int, width int, low binary, top binary, more binary"
_COUNTED = "block long, place int, times long"
_ANSWERS = "block long, answers binary"
_SCORES = "doc_id long, n_words long, log_score double, mean_log_score double"


def _block(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as stream:
        stream.write_table(pa.Table.from_batches(held).combine_chunks())
    texts = sink.getvalue().to_pybytes()
    # named by what it holds, too: if a lost block came back with other rows, answers would find no block of their name
    name = hashlib.blake2b(texts, digest_size=8, salt=f"{TaskContext.get().partitionId()}:{number}".encode())
    return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(name.digest(), "big", signed=True)], pa.int64()), pa.array([texts], pa.binary())], ["block", "texts"])


def _texts(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _messages(block: int, keys: np.ndarray, counts: np.ndarray, several: np.ndarray, before: int = 0) -> pa.RecordBatch:
    """The distinct n-grams of a block, or of its slices from one to another after ``before`` others, a row for each slice that has some."""
    slices = keys >> _SLICE_BITS
    firsts = np.flatnonzero(np.concatenate([[True], slices[1:] != slices[:-1]]))
    gaps = np.diff(keys, prepend=keys[:1])
    gaps[firsts] = keys[firsts] - (slices[firsts] << _SLICE_BITS)
    more = counts > 1
    values = gaps << np.uint64(1) | more
    width = max(2, -(-int(values.max()).bit_length() // 8))
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    bounds = np.append(firsts, len(keys))
    tops = np.ascontiguousarray(planes[:, width - 1])
    packed = [pa.compress(tops[a:b], "zstd", asbytes=True) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    others, starts = _varints(2 * counts[more] + several[more])
    n = len(firsts)
    columns = [
        pa.array(slices[firsts].astype(np.int32)), pa.array(np.full(n, block, np.int64)), pa.array((firsts + before).astype(np.int32)), pa.array(np.full(n, width, np.int32)),
        _binary(np.ascontiguousarray(planes[:, : width - 1]), bounds * (width - 1)), pa.array(packed, pa.binary()), _binary(others, starts[np.append(0, np.cumsum(more))[bounds]]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["slice", "block", "first", "width", "low", "top", "more"])


def _sent(block: int, found: Grams) -> Iterator[pa.RecordBatch]:
    """The messages of a block, those of a part of the hashes together."""
    before = 0
    for some, values in _parts(found):
        if len(values):
            keys, counts, several = _distinct(values, np.concatenate([found.rows[s] for s in some]))
            yield _messages(block, keys, counts, several, before)
            before += len(keys)


def _unpacked(slices: pa.Array, blocks: pa.Array, firsts: pa.Array, widths: pa.Array, lows: pa.Array, tops: pa.Array, more: pa.Array) -> tuple[np.ndarray, ...]:
    """The n-grams of messages: hash, block, place there, how often and in how many documents there (2 stands for more)."""
    wide = np.asarray(widths).astype(np.int64)
    sizes = np.asarray(pc.binary_length(lows)).astype(np.int64) // np.maximum(wide - 1, 1)
    bounds = np.append(0, np.cumsum(sizes))
    planes = np.zeros((int(bounds[-1]), 8), np.uint8)
    for a, size, width, low, top in zip(bounds.tolist(), sizes.tolist(), wide.tolist(), lows, tops):
        planes[a : a + size, : width - 1] = np.frombuffer(low.as_buffer(), np.uint8).reshape(size, width - 1)
        planes[a : a + size, width - 1] = np.frombuffer(pa.decompress(top.as_buffer(), size, "zstd"), np.uint8)
    values = planes.view("<u8").ravel()
    several = (values & np.uint64(1)).astype(bool)
    values >>= np.uint64(1)
    heads = bounds[:-1]
    gaps = values[heads]
    grams = np.cumsum(values, out=values)
    grams += np.repeat((np.asarray(slices).astype(np.uint64) << _SLICE_BITS) - grams[heads] + gaps, sizes)
    others = _from_varints(np.frombuffer(b"".join(more.to_pylist()), np.uint8))
    times, documents = np.ones(len(grams), np.int32), np.ones(len(grams), np.int32)
    times[several], documents[several] = others >> 1, 1 + (others & 1)
    places = np.arange(len(grams), dtype=np.int32)
    places -= np.repeat((heads - np.asarray(firsts)).astype(np.int32), sizes)
    return grams, np.repeat(np.asarray(blocks), sizes), places, times, documents


def _portions(table: pa.Table) -> Iterator[pa.Table]:
    """Messages, sorted by slice, cut between slices to about ``_TOGETHER`` n-grams."""
    slices, widths = np.asarray(table.column("slice")), np.asarray(table.column("width")).astype(np.int64)
    ends = np.append(0, np.cumsum(np.asarray(pc.binary_length(table.column("low"))).astype(np.int64) // np.maximum(widths - 1, 1)))
    firsts = np.flatnonzero(np.concatenate([[True], slices[1:] != slices[:-1]]))
    starts = firsts[np.diff(ends[firsts] // _TOGETHER, prepend=-1) > 0].tolist()
    for start, end in zip(starts, [*starts[1:], table.num_rows]):
        yield table.slice(start, end - start)


def _summed(messages: pa.Table) -> pa.RecordBatch:
    gram, block, place, times, documents = _unpacked(*(c.combine_chunks() for c in messages.columns))
    order = np.argsort(gram)
    gram = gram[order]
    firsts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    known = np.add.reduceat(documents[order], firsts) > 1
    sizes = np.diff(np.append(firsts, len(gram)))
    some = order[np.repeat(known, sizes)]
    everywhere = np.repeat(np.add.reduceat(times[order].astype(np.int64), firsts)[known], sizes[known])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (block[some], place[some], everywhere)], ["block", "place", "times"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages, sorted by slice, as (block, place, times in all blocks) of the n-grams that several documents hold."""
    for table in whole_runs(batches, "slice"):
        for messages in _portions(table):
            yield _summed(messages)
        del table, messages
        give_back()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and bytes of the texts of a task."""
    words = size = 0
    space = np.isin(np.arange(256), [32, *range(9, 14)])
    for batch in batches:
        for first in range(0, batch.num_rows, _ROWS):
            texts = pc.fill_null(batch.column("text").slice(first, _ROWS), "").cast(pa.large_string())
            _, offsets, data = texts.buffers()
            bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            inside = ~space[np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            starts = bounds[:-1][bounds[:-1] < bounds[-1]] - bounds[0]
            begins[starts] = inside[starts]
            words += int(begins.sum())
            size += len(inside)
    give_back()
    yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([size], pa.int64())], ["words", "bytes"])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, times), sorted, as a row for each block of a batch: differences of places and counts in turn."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, place, times = (np.asarray(batch.column(k)).astype(np.int64) for k in range(3))
        firsts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        gaps = np.diff(place, prepend=0)
        gaps[firsts] = place[firsts]
        data, starts = _varints(np.stack([gaps, times], axis=1).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(block[firsts]), _binary(data, starts[2 * np.append(firsts, len(block))])], ["block", "answers"])


def score(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_words``, ``log_score`` (sum of natural logarithms) and ``mean_log_score`` of every document."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = number = 0
        for batch in batches:
            ends = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)))
            start = 0
            while start < batch.num_rows:
                stop = int(np.searchsorted(ends, ends[start] + settings.block_bytes - size))
                stop = min(max(stop, start + 1), batch.num_rows)
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop] - ends[start])
                start = stop
                if size >= settings.block_bytes:
                    yield _block(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield _block(held, number)
        give_back()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column("block").to_pylist(), batch.column("texts")):
                yield from _sent(block, grams(_texts(texts.as_buffer()).column("text"), settings.order))
                give_back()

    def add_up(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        if block.num_rows != 1:
            raise ValueError("a block of documents was read again with other rows")
        texts = _texts(block.column("texts")[0].as_buffer())
        found = grams(texts.column("text"), settings.order)
        n_keys, places = _places(found)
        counts = np.zeros(n_keys + 1)
        counts[0] = words
        for answer in answers.column("answers"):
            gaps, times = _from_varints(np.frombuffer(answer.as_buffer(), np.uint8)).reshape(-1, 2).T
            counts[np.cumsum(gaps) + 1] = times
        found.hashes.clear()
        n = np.bincount(found.rows, minlength=texts.num_rows)
        sums = _sums(found, places, counts, n, settings)
        mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
        del found, places, counts
        give_back()
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(n, pa.int64()), "log_score": pa.array(sums), "mean_log_score": mean})

    sizes = documents.select("text").mapInArrow(_sizes, "words long, bytes long").agg(F.sum("words"), F.sum("bytes")).first()
    words, blocks = sizes[0] or 0, max(1, -(-(sizes[1] or 0) // settings.block_bytes))
    # both reads of the texts are of this one exchange
    dealt = documents.select("doc_id", "text").mapInArrow(deal, _BLOCKS).repartition("block")
    # a partition has about as many n-grams as a block; all that are equal are in one slice
    sent = dealt.mapInArrow(explode, _MESSAGES).repartition(min(blocks, _SLICES), "slice")
    counted = sent.sortWithinPartitions("slice").mapInArrow(_counted, _COUNTED)
    answers = counted.sortWithinPartitions("block", "place").mapInArrow(_answers, _ANSWERS)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, _SCORES)


def _sums(found: Grams, places: list[np.ndarray], counts: np.ndarray, n_words: np.ndarray, settings: Settings) -> np.ndarray:
    """The sums of the logarithms of every document, for some neighbouring documents at a time."""
    sums, bounds = np.zeros(len(n_words)), np.append(0, np.cumsum(n_words))
    start = 0
    while start < len(n_words):
        stop = max(int(np.searchsorted(bounds, bounds[start] + _TOGETHER, side="right")) - 1, start + 1)
        part = slice(bounds[start], bounds[stop])
        some = Grams(found.rows[part].astype(np.int64) - start, [fit[part] for fit in found.fits], [])
        sums[start:stop] = np.bincount(some.rows, _logs(some, [place[part] for place in places], counts, settings), stop - start)
        start = stop
    return sums


def _logs(found: Grams, places: list[np.ndarray], counts: np.ndarray, settings: Settings) -> np.ndarray:
    """The logarithm of the score of every word; ``counts`` of all words stand at 0, those of n-grams at their places."""
    rest, fits = [], []
    for fit, place in zip(found.fits, places):
        own = np.zeros(len(place))
        _, inverse, times = np.unique(found.rows[fit] * len(counts) + place[fit], return_inverse=True, return_counts=True)
        own[fit] = times[inverse]
        rest.append(counts[place] - own)
        fits.append(fit)
    words = counts[0] - np.bincount(found.rows, minlength=int(found.rows[-1]) + 1 if len(found.rows) else 0)[found.rows]
    words = np.maximum(words, 1.0)
    out = np.log(np.where(rest[0] > 0, rest[0], 0.5) / words)
    for n in range(1, settings.order):
        # a word without enough history starts at the longest n-gram it has: nothing was given up for the missing words
        out = np.where(fits[n], out + np.log(settings.backoff), out)
        history = np.zeros(len(out))
        history[1:] = rest[n - 1][:-1]
        known = fits[n] & (rest[n] > 0)
        out[known] = np.log(rest[n][known] / history[known])
    return out
