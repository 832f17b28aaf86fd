"""Near-duplicate embeddings through a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), in order of nearness. Inverted lists hold the
vectors under each pair of their pivots, so two vectors meet in a list exactly if they share two pivots or more.
Where they meet, cosines are taken in double precision; a pair counts in the first list it shares and nowhere else.

Vectors with equal components and label are one node with a weight, so that copies are not compared with each other.
Lists above a block are dealt as pairs of blocks. A task emits one row for each member: its number of links and a link
that connects it, never all pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
those with a null label; vectors of different length never link. Rows with equal ids are separate vectors. Null ids
count as the largest: a component is the smallest id that is not null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.components import components
from tallyspark.llm.meetings import in_blocks
from tallyspark.llm.runs import runs
from tallyspark.llm.shared import settled


@dataclass(frozen=True)
class Settings:
    """``pivots`` reference points, chosen from at most ``sample_rows`` vectors so that none lies closer to another than
    the cosine ``apart``; each vector is described by its ``nearest`` pivots."""

    threshold: float = 0.93
    pivots: int = 192
    nearest: int = 6
    sample_rows: int = 8192
    apart: float = 0.5
    block: int = 1024
    seed: int = 5


def _unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest  # no overflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, settings: Settings) -> np.ndarray:
    """Sampled vectors in given order that lie apart from all chosen before; filled up with random directions."""
    chosen = np.zeros((0, sample.shape[1]))
    for vector in _unit(sample) if len(sample) else sample:
        if len(chosen) == settings.pivots:
            break
        if not len(chosen) or (chosen @ vector).max() < settings.apart:
            chosen = np.vstack([chosen, vector])
    spare = np.random.default_rng(settings.seed).normal(size=(settings.pivots - len(chosen), sample.shape[1]))
    return np.vstack([chosen, _unit(spare)]) if len(spare) else chosen


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """The places of the nearest pivots of each vector, nearest first; ties go to the first pivot."""
    return np.argsort(-(_unit(vectors) @ pivots.T), axis=1, kind="stable")[:, :count].astype(np.int32)


def _compare(table: pa.Table, settings: Settings) -> pa.RecordBatch:
    """Links and a connecting link of each member of a list, from the pairs that meet here first."""
    node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy().astype(float)
    own, home = table.column("own").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
    near = _matrix(table.column("near"), settings.nearest).astype(int)
    vectors = _unit(_matrix(table.column("v"), len(table.column("v")[0])))
    low, high = table.column("pair")[0].as_py()
    hit = vectors @ vectors.T >= settings.threshold
    # a shared pivot below the pair's second, other than its first, means that they met in an earlier list
    earlier = np.zeros((len(node), settings.pivots), np.float32)
    np.put_along_axis(earlier, near, 1.0, axis=1)
    earlier = np.delete(earlier[:, :high], low, axis=1)
    hit &= earlier @ earlier.T == 0
    hit &= (own[:, None] != own[None, :]) | (home[:, None] & home[None, :])
    np.fill_diagonal(hit, False)
    links = (hit * weight[None, :]).sum(axis=1).astype(np.int64)
    centre = np.arange(len(node))
    left = links > 0
    for first in range(len(node)):
        if left[first]:
            left[first] = False
            queue = [first]
            while queue:
                reached = np.flatnonzero(hit[queue.pop()] & left)
                left[reached] = False
                centre[reached] = first
                queue.extend(reached.tolist())
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[centre[some]])], ["node", "links", "centre"])


def find(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    spark = embeddings.sparkSession
    vector = F.col("embedding")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & whole, F.lit(False))
    # 0.0 and -0.0 are equal components
    plain = F.when(usable, F.transform(vector, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double"))))
    rows = embeddings.select("vec_id", "label", plain.alias("v"))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    nodes = settled(rows.where("v IS NOT NULL").groupBy("label", "v", "node").agg(F.count("*").alias("weight")).withColumn("dim", F.size("v")))
    sampled = nodes.select("dim", "v").orderBy(F.xxhash64("v")).limit(settings.sample_rows).toArrow()  # bounded
    pivots: dict[int, np.ndarray] = {}
    for dim in np.unique(sampled.column("dim").to_numpy()):
        own = sampled.filter(pc.equal(sampled.column("dim"), pa.scalar(dim, pa.int32())))
        pivots[int(dim)] = choose_pivots(_matrix(own.column("v"), int(dim)), settings)
    held = spark.sparkContext.broadcast(pivots)  # pivots * dimensions numbers for each length that occurs in the sample

    @F.arrow_udf("array<int>")
    def describe(vectors: pa.Array) -> pa.Array:
        sizes = np.asarray(vectors.value_lengths())
        out = np.zeros((len(vectors), settings.nearest), np.int32)
        for dim in np.unique(sizes):
            own = np.flatnonzero(sizes == dim)
            known = held.value.get(int(dim))
            if known is None:
                known = choose_pivots(np.zeros((0, int(dim))), settings)
            out[own] = nearest_pivots(_matrix(vectors.take(pa.array(own)), int(dim)), known, settings.nearest)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * settings.nearest), pa.array(out.ravel()))

    indexed = nodes.withColumn("near", F.array_sort(describe(F.col("v"))))
    pairs = F.array(*[F.array(F.col("near")[a], F.col("near")[b]) for a, b in combinations(range(settings.nearest), 2)])
    listed = indexed.select("node", "near", "label", "dim", F.explode(pairs).alias("pair"))
    listed = listed.select("node", "near", "pair", F.xxhash64("label", "dim", "pair").alias("list"))
    members = in_blocks(listed, "list", settings.block).join(nodes.select("node", "weight", "v"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["list", "i", "j"]):
            yield _compare(table, settings)

    keys = ["list", "i", "j"]
    found = settled(
        members.repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(compare, "node long, links long, centre long")
    )
    linked = components(found.select(F.col("centre").alias("a"), F.col("node").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = nodes.select("node", "weight").join(counts, "node", "left").join(linked, "node", "left")
    placed = rows.select("vec_id", "node").join(per_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = settled(placed)
    ids = placed.where("node IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("smallest"))
    links = F.when(F.col("node").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("weight") - 1)
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    return placed.join(ids, "component", "left").select(
        "vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
