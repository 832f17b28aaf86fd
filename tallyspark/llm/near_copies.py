"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its distinct shingles (words in a row, A-Z lowered), each as a 64-bit hash; documents with
equal sets are one node. Its sketch is the k smallest hashes. Inverted lists of the smallest retained values bring
nodes together; where two sketches meet, the union sketch estimates their similarity, and nodes that may be similar
enough form candidate groups. The full sets of a group are then compared exactly, in blocks; only exact links count.

At the threshold two documents share none of the ``listed`` smallest values with probability (1 - threshold) **
listed, 3e-6 for the defaults, and the estimate rejects a true pair at five standard deviations.

Skew: members of lists and groups above a block first meet one block and a few anchors; then blocks of those that this
left apart meet in pairs, so no task holds more than two blocks of members. A task emits at most one link for each
member, never all pairs.

Defined cases: a text that is null or without words has an empty set and is linked with nothing; one with fewer words
than a shingle has one element, the whole sequence. Rows with equal ids are separate documents. Null ids count as the
largest: the component of a document is the smallest id that is not null, or null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.meetings import connect
from tallyspark.llm.runs import runs, stars
from tallyspark.llm.shared import lean, settled
from tallyspark.llm.textops import Hashes, chunks, mix, ranges


@dataclass(frozen=True)
class Settings:
    """``words`` of a shingle and the ``percent`` of shared shingles that links. ``retained`` values make a sketch,
    ``listed`` of them go into inverted lists; lists and groups are compared in blocks of the given sizes."""

    words: int = 5
    percent: int = 80
    retained: int = 64
    listed: int = 8
    list_block: int = 2048
    group_block: int = 384


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk: the first row, the bounds of the sets of its rows, and their elements in ascending order."""
    for chunk in chunks(texts):
        starts, ends = chunk.runs(chunk.not_space())
        p = chunk.points
        hashes = Hashes(np.where((p >= 65) & (p <= 90), p + 32, p)).of(starts, ends)
        rows = chunk.row_of(starts)
        counts = np.bincount(rows, minlength=chunk.rows)
        begin = np.cumsum(counts) - counts
        size = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
        first, row = ranges(begin, size), np.repeat(np.arange(chunk.rows), size)
        value = np.zeros(len(first), np.uint64)
        for k in range(words):
            inside = first + k < (begin + counts)[row]
            value[inside] = mix(value[inside] + hashes[(first + k)[inside]], k + 1)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
        yield chunk.first, np.searchsorted(row, np.arange(chunk.rows + 1)), value


def _sketches(settings: Settings):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bounds, values in shingle_sets(batch.column("text"), settings.words):
                size = np.diff(bounds)
                some = size > 0
                node = np.zeros(len(size), np.uint64)
                node[some] = mix(np.add.reduceat(mix(values, 21), bounds[:-1][some]) + size[some].astype(np.uint64), 22) if some.any() else 0
                kept = np.minimum(size, settings.retained)
                low = values[ranges(bounds[:-1], kept)].astype("<u8").tobytes()
                at = np.concatenate([[0], np.cumsum(kept * 8)]).astype(np.int32)
                part = batch.slice(first, len(size))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(size, pa.int64()), pa.array(node.view(np.int64)),
                     pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(low)])],
                    ["doc_id", "text_key", "n_shingles", "node", "sketch"],
                )

    return sketch


def _bounds(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a column of packed numbers."""
    values = column.to_pylist()
    return np.cumsum([0, *(len(v) // 8 for v in values)]), np.frombuffer(b"".join(values), "<u8")


def _sums(flags: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many flags hold in each of the given stretches; none of them is empty."""
    sizes = (bounds[1:] - bounds[:-1])[rows]
    return np.add.reduceat(flags[ranges(bounds[rows], sizes)].astype(np.int32), np.cumsum(sizes) - sizes)


def _likely(table: pa.Table, settings: Settings) -> list[tuple[int, int]]:
    """Links among the members of an inverted list whose estimated similarity may reach the threshold."""
    bounds, values = _bounds(table.column("sketch"))
    _, codes = np.unique(values, return_inverse=True)
    largest, sizes = codes[bounds[1:] - 1], table.column("n_shingles").to_numpy()
    share, mark = settings.percent / 100, np.zeros(codes.max() + 1, bool)

    def linked(x: int, others: np.ndarray) -> np.ndarray:
        own = codes[bounds[x] : bounds[x + 1]]
        mark[own] = True
        both = _sums(mark[codes], bounds, others)
        mark[own] = False
        # below the smaller of the two largest values both sketches are complete
        mine = np.searchsorted(own, np.minimum(largest[others], largest[x]), side="right")
        theirs = _sums(codes <= largest[x], bounds, others)
        union = np.maximum(mine + theirs - both, 1)
        exact = (sizes[others] <= settings.retained) & (sizes[x] <= settings.retained)
        slack = np.where(exact, 1e-9, 5 * np.sqrt(share * (1 - share) / union))
        return both / union >= share - slack

    return stars(sizes, share, linked)


def _exact(bounds: np.ndarray, values: np.ndarray, percent: int) -> list[tuple[int, int]]:
    _, codes = np.unique(values, return_inverse=True)
    mark, sizes = np.zeros(codes.max() + 1, bool), np.diff(bounds)

    def linked(x: int, others: np.ndarray) -> np.ndarray:
        own = codes[bounds[x] : bounds[x + 1]]
        mark[own] = True
        both = _sums(mark[codes], bounds, others)
        mark[own] = False
        return 100 * both >= percent * (sizes[others] + sizes[x] - both)

    return stars(sizes, percent / 100, linked)


def _links(nodes: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(nodes[at[:, 0]]), pa.array(nodes[at[:, 1]])], ["a", "b"])


def _candidates(nodes: DataFrame, settings: Settings) -> DataFrame:
    """``node`` and ``grp`` of the nodes that may have a link."""
    listed = nodes.select("node", F.explode(F.slice(_values(F.col("sketch"), settings.listed), 1, settings.listed)).alias("value"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["value", "i", "j"]):
            yield _links(table.column("node").to_numpy(), _likely(table, settings))

    def compare(lists: DataFrame, few: bool) -> DataFrame:
        members = (F.broadcast(lists) if few else lists).join(nodes.select("node", "n_shingles", "sketch"), "node")
        return members.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j").mapInArrow(lean(likely), "a long, b long")

    return connect(listed, "value", settings.list_block, compare).select("node", F.col("component").alias("grp"))


def _values(sketch: Column, count: int) -> Column:
    """The first packed numbers of a sketch, as longs."""
    return F.transform(
        F.sequence(F.lit(0), F.least(F.lit(count), (F.octet_length(sketch) / 8).cast("int")) - 1),
        lambda k: F.xxhash64(F.substring(sketch, k * 8 + 1, F.lit(8))),
    )


def find(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_shingles``, ``node`` and ``component_id`` of every row."""
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = settled(keyed.mapInArrow(lean(_sketches(settings)), "doc_id long, text_key long, n_shingles long, node long, sketch binary"))
    nodes = settled(
        rows.where("n_shingles > 0").groupBy("node", "n_shingles", "sketch")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    )
    groups = _candidates(nodes, settings)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["grp", "i", "j"]):
            parts = list(shingle_sets(table.column("text").combine_chunks(), settings.words))
            values = np.concatenate([v for _, _, v in parts])
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b, _ in parts]))])
            yield _links(table.column("node").to_numpy(), _exact(bounds, values, settings.percent))

    def verify(members: DataFrame, few: bool) -> DataFrame:
        wanted = members.join(nodes.select("node", "first.doc_id", "first.text_key"), "node")
        wanted = F.broadcast(wanted) if few else wanted  # one row for each of the members
        same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.text_key") == F.col("w.text_key"))
        texts = keyed.alias("t").join(wanted.alias("w"), same).select("node", "grp", "i", "j", "text")
        return texts.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(lean(exact), "a long, b long")

    linked = connect(groups, "grp", settings.group_block, verify)
    placed = rows.select("doc_id", "text_key", "n_shingles", "node").join(linked, "node", "left")
    placed = settled(placed.withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node"))))
    ids = placed.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    return placed.join(ids, "component", "left").select(
        "doc_id", "text_key", "n_shingles", "node", F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"), "component"
    )


def keep_one(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each group: the row with the smallest id, then text hash. Documents without words all stay."""
    found = find(documents.select("doc_id", "text"), settings)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    kept = found.where("n_shingles > 0").groupBy("component").agg(best.alias("f")).select("f.doc_id", "f.text_key")
    name = "__text_key"
    while name in documents.columns:
        name += "_"
    rows = documents.withColumn(name, F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{name}") == F.col("k.text_key"))
    single = rows.join(kept.alias("k"), same, "left_semi")
    # rows that repeat both id and text are copies as well
    single = single.dropDuplicates(["doc_id", name])
    wordless = rows.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return single.unionByName(wordless).select(*[F.col(f"`{c}`") for c in documents.columns])
