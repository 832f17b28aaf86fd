"""SentencePiece encoding and decoding of whole batches, for models of the BPE kind with byte fallback.

Encoding is a Viterbi search over the pieces of the model: words of equal length advance together, position by
position; hashes of the substrings that end there probe the sorted piece keys, and of the pieces that fit the best is
stored as the way back. In a BPE model a path is the encoding exactly if no two neighbours on it would have been merged
across their border, so a piece may follow another only if merging their joined text gives the two again. That is
decided once for every pair of pieces that occurs, from the merge trees of both; one piece then remains at every
position, and the ids are those of the library.

A text is cut where two characters stand that no piece holds side by side; no piece crosses such a place. Only distinct
cuttings are searched, and a long text without spaces is cut as well.

Defined cases: a null or empty text has no ids and decodes to an empty text. A character the model does not know becomes
its UTF-8 bytes. The model's own mark for a space in a text decodes to a space. Repeated rows are encoded alike, other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm.textops import _STEP, Chunk, Hashes, _power, _weights, chunks, find, mix, ranges

SPACE = 0x2581
_CHUNK = 4 << 20
_HELD = 1 << 19
_TABLE = 24  # bits of the table of neighbouring characters
_BITS = 22  # of the table of decided pairs and of the table of key bits
_MASK = np.uint64((1 << _BITS) - 1)
_NEVER = np.int64(1) << 40
_UNKNOWN = np.int64(1) << 32


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _raw(text: str) -> int:
    points = _codes(text)
    return int((_weights()[points] * _power(_STEP, len(points))).sum(dtype=np.uint64)) if len(points) else 0


def _beside(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Place of two neighbouring characters in the table."""
    both = first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
    return (mix(both) >> np.uint64(64 - _TABLE)).astype(np.int64)


@dataclass
class Model:
    """Pieces sorted by the hash of their text, and the ends of their merge trees."""

    ids: np.ndarray
    keys: np.ndarray
    longest: int
    rank: np.ndarray
    #: raw hash, power of its length, birth and death of each part at the left (right) end of each piece
    left: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    right: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    depths: tuple[np.ndarray, np.ndarray]
    neighbours: np.ndarray
    present: np.ndarray
    byte_ids: np.ndarray
    texts: list[bytes]
    #: lately decided pairs by hash: code and answer; a later pair may take a place over
    pairs: np.ndarray | None = None
    allowed: np.ndarray | None = None
    held: Held | None = None

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are those of pieces, and the places of these. Most are not: a table of key bits rules them out
        before the search."""
        some = np.flatnonzero(self.present[(keys & _MASK).astype(np.int64)])
        at = find(self.keys, keys[some])
        fit = at >= 0
        return some[fit], at[fit]

    def follows(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before."""
        if self.pairs is None:
            self.pairs, self.allowed = np.full(1 << _BITS, -1, np.int64), np.zeros(1 << _BITS, bool)
        code = before * np.int64(len(self.ids)) + after
        slot = (mix(code.view(np.uint64)) & _MASK).astype(np.int64)
        out = self.allowed[slot]
        unknown = np.flatnonzero(self.pairs[slot] != code)
        if len(unknown):
            new, first, inverse = np.unique(code[unknown], return_index=True, return_inverse=True)
            apart = self._apart(new // len(self.ids), new % len(self.ids))
            out[unknown] = apart[inverse]
            place = slot[unknown[first]]
            self.pairs[place], self.allowed[place] = new, apart
            # of pairs that share a place the last one written is the one kept
            self.allowed[place] = apart[find(new, self.pairs[place])]
        return out

    def _apart(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether no part at the end of one piece and part at the start of the next were merged while both stood alone."""
        right, left = self.depths[1][before], self.depths[0][after]
        pair = np.repeat(np.arange(len(before)), right * left)
        k = ranges(np.zeros(len(before), np.int64), right * left)
        b, x, a, y = before[pair], k // left[pair], after[pair], k % left[pair]
        some, at = self.find(mix(self.right[0][b, x] + self.left[0][a, y] * self.right[1][b, x]))
        b, x, a, y = b[some], x[some], a[some], y[some]
        time = np.maximum(self.rank[at], np.maximum(self.right[2][b, x], self.left[2][a, y]))
        # of equal merges the leftmost is first
        merged = (time < self.right[3][b, x]) & (time <= self.left[3][a, y])
        apart = np.ones(len(before), bool)
        apart[pair[some[merged]]] = False
        return apart


def _trees(ranks: dict[str, int]) -> dict[str, tuple[str, str] | None]:
    """The two parts each piece is merged from last; None for a single character. Pieces that merging never makes are left
    out."""
    trees: dict[str, tuple[str, str] | None] = {}
    for piece in sorted(ranks, key=len):
        parts, last = list(piece), None
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            last = (parts[best], parts[best + 1])
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 1:
            trees[piece] = last
    return trees


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialized message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


def _model_type(data: bytes) -> int:
    """1 unigram, 2 BPE, 3 words, 4 characters; a file that does not say is unigram."""
    found = 1
    for number, trainer in _fields(data):
        if number == 2:
            found = dict(_fields(trainer)).get(3, found)
    return found


def load(path: str) -> Model:
    """Read a model file of the BPE kind; the vocabulary is of fixed size, so the model can be broadcast.

    Other kinds are refused: their scores are no merge ranks, and ids found by merging would be wrong.
    """
    import sentencepiece

    with open(path, "rb") as file:
        content = file.read()
    if _model_type(content) != 2:
        raise ValueError(f"{path} is not a BPE model")
    reader = sentencepiece.SentencePieceProcessor(model_proto=content)
    size = reader.get_piece_size()
    names = [reader.id_to_piece(i) for i in range(size)]
    odd = [reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i) for i in range(size)]
    scores = [reader.get_score(i) for i in range(size)]
    order = {s: k for k, s in enumerate(sorted({-s for s, o in zip(scores, odd) if not o}))}
    ranks = {names[i]: order[-scores[i]] for i in range(size) if not odd[i]}
    trees = _trees(ranks)
    number = {names[i]: i for i in range(size) if not odd[i]}
    keys = {p: int(mix(np.array([_raw(p)], np.uint64))[0]) for p in ranks}
    pieces = sorted(ranks, key=keys.__getitem__)

    raws = {p: _raw(p) for p in {*ranks, *"".join(ranks)}}
    depths = []

    def ends(side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        spines = []
        for piece in pieces:
            spine, part, death = [], piece, int(_NEVER)
            while part is not None:
                tree = trees.get(part)
                birth = ranks[part] if tree else -1
                spine.append((raws[part], pow(_STEP, len(part), 1 << 64), birth, death))
                death, part = birth, tree[side] if tree else None
            spines.append(spine)
        depths.append(np.array([len(x) for x in spines]))
        columns = [np.zeros((len(pieces), depths[-1].max()), t) for t in (np.uint64, np.uint64, np.int64, np.int64)]
        for k, spine in enumerate(spines):
            for x, values in enumerate(spine):
                for column, value in zip(columns, values):
                    column[k, x] = value
        return tuple(columns)

    neighbours = np.zeros(1 << _TABLE, bool)
    for piece in pieces:
        points = _codes(piece)
        neighbours[_beside(points[:-1], points[1:])] = True
    byte_ids = np.full(256, reader.unk_id(), np.int64)
    texts = [b""] * size
    for i in range(size):
        if reader.is_byte(i):
            byte_ids[int(names[i][3:5], 16)] = i
            texts[i] = bytes([int(names[i][3:5], 16)])
        elif not odd[i]:
            texts[i] = names[i].replace(chr(SPACE), " ").encode()
    present = np.zeros(1 << _BITS, bool)
    all_keys = np.array([keys[p] for p in pieces], np.uint64)
    present[(all_keys & _MASK).astype(np.int64)] = True
    made = np.array([p in trees for p in pieces])
    ids = np.where(made, np.array([number[p] for p in pieces]), -1)
    return Model(ids, all_keys, max(map(len, pieces)), np.array([ranks[p] for p in pieces]), ends(0), ends(1),
                 (depths[0], depths[1]), neighbours, present, byte_ids, texts)


def _search(model: Model, points: np.ndarray, starts: np.ndarray, length: int, hashes: Hashes) -> np.ndarray:
    """Places of the pieces of words of one length, as a matrix with the pieces at the position where each ends and -1
    elsewhere. A character without a piece is marked _UNKNOWN plus its code point."""
    words = len(starts)
    last = np.full((words, length + 1), -1, np.int64)  # the piece that ends here
    back = np.zeros((words, length + 1), np.int32)
    for end in range(1, length + 1):
        for start in range(max(0, end - model.longest), end):
            row, at = model.find(hashes.of(starts + start, starts + end))
            fits = (model.ids[at] >= 0) & (last[row, end] < 0)
            row, at = row[fits], at[fits]
            if start:
                before = last[row, start]
                known = before < _UNKNOWN
                fits = ~known
                fits[known] = model.follows(before[known], at[known])
                row, at = row[fits], at[fits]
            last[row, end] = at
            back[row, end] = start
        none = last[:, end] < 0
        last[none, end] = _UNKNOWN + points[starts[none] + end - 1]
        back[none, end] = end - 1
    out = np.full((words, length), -1, np.int64)
    at, row = np.full(words, length), np.arange(words)
    while len(row):
        out[row, at - 1] = last[row, at]
        at = back[row, at]
        row, at = row[at > 0], at[at > 0]
    return out


def _searched(model: Model, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Number of pieces of each word, and all their places one after the other."""
    counts, where, parts, filled = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), [np.zeros(0, np.int64)], 0
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        found = _search(model, points, starts[own], length, hashes)
        counts[own] = (found >= 0).sum(axis=1)
        where[own] = filled + np.cumsum(counts[own]) - counts[own]
        parts.append(found[found >= 0])
        filled += len(parts[-1])
    return counts, np.concatenate(parts)[ranges(where, counts)]


@dataclass
class Held:
    """The latest words and their pieces, by the hash of the word; bounded by forgetting all."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pool: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def with_new(self, keys: np.ndarray, counts: np.ndarray, pool: np.ndarray) -> Held:
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        place = np.concatenate([self.place, len(self.keys) + np.arange(len(keys))])[order]
        begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(counts) - counts])
        return Held(merged[order], place, np.concatenate([self.counts, counts]), begin, np.concatenate([self.pool, pool]))


def _marked(chunk: Chunk) -> Chunk:
    """Spaces as the model writes them, and one before every text that is not empty."""
    some = chunk.bounds[:-1][np.diff(chunk.bounds) > 0]
    points = np.insert(np.where(chunk.points == 32, SPACE, chunk.points), some, SPACE)
    return Chunk(chunk.first, points, chunk.bounds + np.searchsorted(some, chunk.bounds))


def encode(model: Model, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk: first row, the number of ids of every text, and the ids one after the other."""
    for plain in chunks(texts, _CHUNK):
        chunk = _marked(plain)
        if not len(chunk.points):
            yield chunk.first, np.zeros(chunk.rows, np.int64), np.zeros(0, np.int64)
            continue
        new = np.ones(len(chunk.points), bool)
        new[1:] = ~model.neighbours[_beside(chunk.points[:-1], chunk.points[1:])]
        new[chunk.bounds[:-1][chunk.bounds[:-1] < len(new)]] = True
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(new)))
        hashes = Hashes(chunk.points)
        keys, first, inverse = np.unique(hashes.of(starts, starts + lengths), return_index=True, return_inverse=True)
        held = model.held if model.held is not None and len(model.held.keys) <= _HELD else Held()
        new = find(held.keys, keys) < 0
        model.held = held = held.with_new(keys[new], *_searched(model, chunk.points, starts[first[new]], lengths[first[new]], hashes))
        at = held.place[find(held.keys, keys)]
        counts, where, pool = held.counts[at], held.begin[at], held.pool
        sizes = counts[inverse]
        codes = pool[ranges(where[inverse], sizes)]
        rows = np.repeat(chunk.row_of(starts), sizes)
        unknown = codes >= _UNKNOWN
        if unknown.any():
            encoded = [chr(c).encode() for c in (codes[unknown] - _UNKNOWN).tolist()]
            width = np.ones(len(codes), np.int64)
            width[unknown] = [len(x) for x in encoded]
            ids = np.repeat(np.where(unknown, 0, model.ids[np.where(unknown, 0, codes)]), width)
            ids[np.repeat(unknown, width)] = model.byte_ids[np.frombuffer(b"".join(encoded), np.uint8)]
            rows = np.repeat(rows, width)
        else:
            ids = model.ids[codes]
        yield chunk.first, np.bincount(rows, minlength=chunk.rows), ids


def decode(model: Model, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The texts of the given ids, without the space the encoding puts before each."""
    sizes = np.array([len(x) for x in model.texts], np.int64)
    begin, pool = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(model.texts), np.uint8)
    out = pool[ranges(begin[ids], sizes[ids])].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [out[a + (out[a : a + 1] == b" ") : b] for a, b in zip(ends[:-1], ends[1:])]


def digest(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_pieces``, ``ids_crc32`` (of little-endian 32-bit ids) and ``round_trip`` (whether decoding gives the
    text again) of every document."""
    held = documents.sparkSession.sparkContext.broadcast(load(path))  # of the size of the vocabulary

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for first, counts, ids in encode(held.value, texts):
                back = decode(held.value, counts, ids)
                parts = np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])
                same = [(t or "").encode() == b for t, b in zip(texts.slice(first, len(counts)).to_pylist(), back)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(counts)), pa.array(counts, pa.int64()),
                     pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()), pa.array(same)],
                    ["doc_id", "n_pieces", "ids_crc32", "round_trip"],
                )

    return documents.select("doc_id", "text").mapInArrow(digested, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
