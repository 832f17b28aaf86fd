"""Packing tokenised documents into sequences of one length, balanced by their attention cost.

A document costs its tokens plus the square of them. In each window of some thousand documents the sequences that the
tokens need are opened, documents are taken in descending order, and each goes to the sequence of lowest cost that still
has room; what fits nowhere is cut to fill the room that is left. The rest of a window that does not fill a sequence
becomes sequences of a power of two, which need no padding. Windows are packed where their documents are read: there
is no shuffle, and a task holds one window.

Token ids equal those of the tokenizer file (a BPE over words without white space between them). Only pieces of text
that a task has not seen lately reach the tokenizer; the text is cut into them by whole arrays. Texts with letters
beyond the Latin blocks or with strings of special tokens go to the tokenizer as they are.

Defined cases: a null or empty text is the end token alone. Rows are packed one by one, so repeated rows and repeated
or null ids give pieces of their own. Other columns are not read.
"""

from __future__ import annotations

import codecs
import heapq
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyspark.llm.shared import lean
from tallyspark.llm.textops import Chunk, Hashes, chunks, find, lower, ranges

END = 1


@dataclass(frozen=True)
class Settings:
    """``length`` of a sequence, a power of two; ``window`` is the tokens packed together; ``quadratic`` weighs the
    square of a document's tokens against them; ``held`` bounds the pieces of text a task remembers."""

    length: int = 2048
    window: int = 1 << 21
    quadratic: float = 1 / 2048
    held: int = 1 << 19


@cache
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, 4 not handled here."""
    table = np.full(0x110000, 4, np.uint8)
    for c in range(0x250):
        kind = unicodedata.category(chr(c))[0]
        space = c in (0x20, 0x85, 0xA0) or 9 <= c <= 13
        table[c] = 0 if space else 1 if kind == "L" else 2 if kind == "N" else 3
    table[0x130] = 4  # its lower case is two characters
    return table


@cache
def _byte_letters() -> str:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(spare)) for b in range(256))


class Encoder:
    """Token ids of whole batches of texts."""

    def __init__(self, tokenizer: str, held: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.held = held
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size, self.pool = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        self.count = self.filled = 0

    def _pieces(self, chunk: Chunk, kind: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of runs of letters, single numbers, and runs of other characters; an apostrophe that begins
        a run of others takes its contraction along."""
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new[chunk.bounds[:-1][chunk.bounds[:-1] < len(kind)]] = True
        last = np.full(len(kind), -1, np.int64)
        last[chunk.bounds[1:][chunk.bounds[1:] > 0] - 1] = 0
        quotes = np.flatnonzero(new & (points == 39) & (last < 0))
        quotes = quotes[kind[quotes + 1] == 1]
        if len(quotes):
            one = points[quotes + 1]
            two = np.where(last[quotes + 1] < 0, points[np.minimum(quotes + 2, len(points) - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for taken, extra in ((quotes[short], 1), (quotes[long], 2)):
                new[taken + 1] = False
                new[taken + extra] = False
                after = taken + extra + 1
                new[after[after < len(new)]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(kind))
        solid = kind[starts] != 0
        return starts[solid], ends[solid]

    def _learn(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, points: np.ndarray) -> None:
        letters, model = _byte_letters(), self.tokenizer.model
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        found = [
            [t.id for t in model.tokenize(codecs.charmap_decode(text[a:b].encode(), "strict", letters)[0])]
            for a, b in zip(starts.tolist(), ends.tolist())
        ]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.begin.append(self.filled + np.cumsum(sizes) - sizes)
        self.size.append(sizes)
        self.pool.append(np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())))
        self.filled += int(sizes.sum())
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        self.place = np.concatenate([self.place, self.count + np.arange(len(keys))])[order]
        self.keys = merged[order]
        self.count += len(keys)
        for held in (self.begin, self.size, self.pool):
            held[:] = [np.concatenate(held)]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each chunk: the number of ids of every text, and the ids one after the other."""
        for chunk in chunks(texts):
            points = lower()[chunk.points] if len(chunk.points) else chunk.points
            kind = _classes()[chunk.points]
            odd = np.add.reduceat(np.append((kind == 4) | self._special(chunk), False), chunk.bounds[:-1]) > 0
            odd &= np.diff(chunk.bounds) > 0
            starts, ends = self._pieces(chunk, kind, points) if len(kind) else (np.zeros(0, np.int64),) * 2
            rows = chunk.row_of(starts)
            if odd.any():
                plain = ~odd[rows]
                starts, ends, rows = starts[plain], ends[plain], rows[plain]
            keys, first, inverse = np.unique(Hashes(points).of(starts, ends), return_index=True, return_inverse=True)
            at = find(self.keys, keys)
            if (at < 0).any():
                if self.count > self.held:
                    self._forget()
                    at = np.full(len(keys), -1)
                new = first[at < 0]
                self._learn(keys[at < 0], starts[new], ends[new], points)
                at = find(self.keys, keys)
            item = self.place[at][inverse]
            sizes = self.size[0][item]
            ids = self.pool[0][ranges(self.begin[0][item], sizes)]
            counts = np.bincount(rows, sizes, chunk.rows).astype(np.int64)
            if odd.any():
                counts, ids = self._whole(chunk, odd, counts, ids)
            yield counts, ids

    @staticmethod
    def _special(chunk: Chunk) -> np.ndarray:
        p = chunk.points
        out = np.zeros(len(p), bool)
        out[:-1] = (p[:-1] == ord("<")) & (p[1:] == ord("|"))
        return out

    def _whole(self, chunk: Chunk, odd: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for row in np.flatnonzero(odd).tolist():
            text = chunk.points[chunk.bounds[row] : chunk.bounds[row + 1]].astype("<u4").tobytes().decode("utf-32-le")
            parts[row] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array([len(x) for x in parts], np.int64), np.concatenate(parts)


@lru_cache(maxsize=1)
def _encoder(tokenizer: str, held: int) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(tokenizer, held)


def fill(lengths: np.ndarray, settings: Settings) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every token once."""
    size, out, sequence = settings.length, [], 0
    rest: list[tuple[int, int, int]] = []
    for k, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= size:
            out.append((k, start, size, sequence, 0))
            sequence, start = sequence + 1, start + size
        if start < n:
            rest.append((n - start, k, start))
    rest.sort(key=lambda x: (-x[0], x[1]))
    whole = sum(x[0] for x in rest) // size
    room = [size] * whole
    # sequences by cost; those without room for the document at hand wait, as later documents are shorter
    order = [(0.0, s) for s in range(whole)]
    waiting: list[tuple[int, float, int]] = []
    unplaced = []
    for n, k, start in rest:
        while waiting and -waiting[0][0] >= n:
            free, cost, s = heapq.heappop(waiting)
            heapq.heappush(order, (cost, s))
        placed = False
        while order:
            cost, s = heapq.heappop(order)
            if room[s] >= n:
                out.append((k, start, n, sequence + s, size - room[s]))
                room[s] -= n
                if room[s]:
                    heapq.heappush(order, (cost + n + settings.quadratic * n * n, s))
                placed = True
                break
            heapq.heappush(waiting, (-room[s], cost, s))
        if not placed:
            unplaced.append((n, k, start))
    open_sequences = iter([(sequence + s, size - room[s], room[s]) for s in range(whole) if room[s]])
    left = sum(n for n, _, _ in unplaced) - sum(room)
    tails = [(sequence + whole + k, 0, 1 << b) for k, b in enumerate(b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1)]
    places = iter([*open_sequences, *tails])
    target, offset, free = next(places, (0, 0, 0))
    for n, k, start in unplaced:
        while n:
            if not free:
                target, offset, free = next(places)
            take = min(n, free)
            out.append((k, start, take, target, offset))
            n, start, offset, free = n - take, start + take, offset + take, free - take
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [field.split()[0] for field in SCHEMA.split(", ")]


def pack(documents: DataFrame, tokenizer_path: str, settings: Settings = Settings()) -> DataFrame:
    """One row for each piece of a document. ``sequence_id`` is the partition in the high bits and a count."""
    with open(tokenizer_path, encoding="utf-8") as file:
        held = documents.sparkSession.sparkContext.broadcast(file.read())  # the vocabulary, of fixed size

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, high = _encoder(held.value, settings.held), TaskContext.get().partitionId() << 33
        ids: list[np.ndarray] = []
        owners: list[int | None] = []
        total = used = 0

        def flush() -> pa.RecordBatch:
            nonlocal total, used
            lengths = np.array([len(x) for x in ids], np.int64)
            pieces = fill(lengths, settings)
            rows = [
                (owners[k], start, n, zlib.crc32(ids[k][start : start + n].astype("<u4").tobytes()), len(ids[k]), high + used + s, offset)
                for k, start, n, s, offset in pieces
            ]
            used += 1 + max(s for *_, s, _ in pieces)
            ids.clear()
            owners.clear()
            total = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], _NAMES)

        for batch in batches:
            row = 0
            names = batch.column("doc_id").to_pylist()
            for counts, values in encoder.encode(batch.column("text")):
                for part in np.split(values, np.cumsum(counts)[:-1]):
                    ids.append(np.append(part, np.uint32(END)))
                    owners.append(names[row])
                    row, total = row + 1, total + len(ids[-1])
                if total >= settings.window:
                    yield flush()
        if ids:
            yield flush()

    return documents.select("doc_id", "text").mapInArrow(lean(packed), SCHEMA)
