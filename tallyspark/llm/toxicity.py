"""Toxicity by a factorization machine over hashed terms.

Each text is the set of its lower-case letter runs and of their beginnings (inflected forms share these), hashed into
bins. The machine adds to the linear weight of every
bin the inner products of the factor vectors of all pairs, so that an insult next to a group mention can weigh more
than both alone; their sum is divided by the number of bins, or the many pairs of a long text would outweigh all else. It
is fitted in one task, on a bounded sample of labelled rows; scoring is one pass without a shuffle.

No bin is left out for what it tells alone. Against learning rare words by heart, a linear weight stays at zero until the
errors it is to mend add up to more than chance, and the toll for that ends after the first epochs; factors start small
and move slowly at first, so that only pairs whose errors point one way grow.

Defined cases: a null or empty text has no terms and gets the score of the bias alone. Labels that are null or whose
id is null teach nothing; of several labels of one id the highest counts. With no usable label the score is 0
everywhere. Repeated rows are scored alike, other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.ordered import running
from tallyspark.llm.shared import give_back, lean, settled
from tallyspark.llm.textops import Hashes, chunks, letters, lower, ranges


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that are fitted, taken by the hash of the id, and ``sample_pairs`` the pairs of
    row and bin they have together (rows after that are left out), so that the fit holds a bounded number of bytes. A bin is used if at
    least ``min_documents`` texts of the sample hold it; ``min_deviation`` over 0 would also leave out bins whose share of
    toxic texts lies fewer standard deviations from the share of all. ``toll`` is what the errors of a bin must exceed in
    each of the first ``toll_epochs`` to move its linear weight, in standard deviations. ``rate`` and ``factor_rate`` are
    the steps of weights and factors, ``decay`` draws factors to zero. A step holds at most ``batch`` rows, and about
    ``batch_pairs`` pairs of row and bin. The model has at most 2**bits * (factors + 1) numbers."""

    bits: int = 20
    factors: int = 8
    sample_rows: int = 20_000
    sample_pairs: int = 1 << 24
    beginnings: tuple[int, ...] = (4, 5)
    min_documents: int = 4
    min_deviation: float = 0.0
    epochs: int = 20
    batch: int = 256
    batch_pairs: int = 1 << 18
    rate: float = 0.8
    factor_rate: float = 0.15
    toll: float = 5.0
    toll_epochs: int = 6
    decay: float = 2e-4
    seed: int = 11


def terms(texts: pa.Array, bits: int, beginnings: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each chunk: first row, number of rows, and the distinct (row, bin) pairs in row order."""
    for chunk in chunks(texts):
        starts, ends = chunk.runs(letters()[chunk.points])
        hashes, rows = Hashes(lower()[chunk.points]), chunk.row_of(starts).astype(np.uint64) << np.uint64(bits)
        found = [rows | hashes.of(starts, ends) >> np.uint64(64 - bits)]
        for n in beginnings:
            longer = ends - starts > n
            found.append(rows[longer] | hashes.of(starts[longer], starts[longer] + n, n) >> np.uint64(64 - bits))
        pairs = np.unique(np.concatenate(found))
        yield chunk.first, chunk.rows, (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Machine:
    """Bias, linear weights and factor vectors of the bins in use."""

    def __init__(self, settings: Settings, bins: np.ndarray):
        self.bits, self.beginnings, self.bias, self.bins = settings.bits, settings.beginnings, -35.0, bins
        self.linear = np.zeros(len(bins), np.float32)
        start = np.random.default_rng(settings.seed).normal(0, 0.02, (len(bins), settings.factors))
        self.factors = start.astype(np.float32)

    def parts(self, row: np.ndarray, at: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores, the sum of factor vectors of each row, and the factor vectors of each (row, bin) pair."""
        vectors = self.factors[at].astype(np.float64)
        sums = np.stack([np.bincount(row, vectors[:, f], rows) for f in range(vectors.shape[1])], axis=1)
        squares = np.bincount(row, (vectors**2).sum(axis=1), rows)
        pairs = 0.5 * ((sums**2).sum(axis=1) - squares) / np.maximum(np.bincount(row, minlength=rows), 1)
        raw = self.bias + np.bincount(row, self.linear[at], rows) + pairs
        return raw, sums, vectors

    def score(self, texts: pa.Array) -> np.ndarray:
        slots = np.full(1 << self.bits, -1, np.int32)
        slots[self.bins] = np.arange(len(self.bins), dtype=np.int32)
        out = np.zeros(len(texts))
        for first, rows, row, bins in terms(texts, self.bits, self.beginnings):
            at = slots[bins]
            known = at >= 0
            out[first : first + rows] = _sigmoid(self.parts(row[known], at[known], rows)[0])
        return out


def _batches(order: np.ndarray, sizes: np.ndarray, settings: Settings) -> Iterator[np.ndarray]:
    """Cut the rows into steps of ``batch`` rows, and these where they hold more than ``batch_pairs`` pairs."""
    for rows in np.array_split(order, max(1, len(order) // settings.batch)):
        full = np.cumsum(sizes[rows]) // settings.batch_pairs
        yield from np.split(rows, np.flatnonzero(np.diff(full)) + 1)


def _counts(bins: np.ndarray, size: int) -> np.ndarray:
    """How often each bin occurs; in slices, as counting widens what it counts."""
    counts = np.zeros(size, np.int64)
    for start in range(0, len(bins), 1 << 20):
        counts += np.bincount(bins[start : start + (1 << 20)], minlength=size)
    return counts


def _fit(lengths: np.ndarray, bins: np.ndarray, labels: np.ndarray, settings: Settings) -> Machine:
    rate = labels.mean() if len(labels) else 0.0
    # counts by bin, not by sorting: the pairs are the largest array of the task
    counts = _counts(bins, 1 << settings.bits)
    toxic = _counts(bins[np.repeat(labels > 0, lengths)], 1 << settings.bits)
    deviation = np.abs(toxic - counts * rate) / np.sqrt(np.maximum(counts * rate * (1 - rate), 1e-12))
    used = np.flatnonzero((counts >= settings.min_documents) & (deviation >= settings.min_deviation)).astype(np.int32)
    machine = Machine(settings, used)
    if not 0.0 < rate < 1.0:
        machine.bias = -35.0 if rate == 0.0 else 35.0
        return machine
    machine.bias = float(np.log(rate / (1 - rate)))
    slots = np.full(1 << settings.bits, -1, np.int32)
    slots[used] = np.arange(len(used), dtype=np.int32)
    known = slots[bins] >= 0
    sizes = np.diff(np.concatenate([[0], np.cumsum(known, dtype=np.int32)])[np.concatenate([[0], np.cumsum(lengths)])])
    at = slots[bins[known]]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    used_counts, steps = counts[used], max(1, len(lengths) // settings.batch)
    # the standard deviation of the errors of a bin in an epoch, dealt to the steps that will meet it
    share = np.sqrt(used_counts * rate * (1 - rate)) / (steps * -np.expm1(used_counts * np.log1p(-1 / steps)) if steps > 1 else 1.0)
    errors, paid, seen_linear, seen_bias = np.zeros(len(used)), np.zeros(len(used)), np.full(len(used), 1e-3), 1e-3
    seen_factors = np.full(machine.factors.shape, 10.0, np.float32)
    rng = np.random.default_rng(settings.seed)
    for epoch in range(settings.epochs):
        for batch in _batches(rng.permutation(len(lengths)), sizes, settings):
            size = sizes[batch]
            own = np.repeat(np.arange(len(batch)), size)
            places = at[ranges(begin[batch], size)]
            raw, sums, vectors = machine.parts(own, places, len(batch))
            error = _sigmoid(raw) - labels[batch]
            seen_bias += error.sum() ** 2
            machine.bias -= settings.rate * error.sum() / np.sqrt(seen_bias)
            if not len(places):
                continue
            order = np.argsort(places, kind="stable")
            ordered, own = places[order], own[order]
            starts = np.flatnonzero(np.diff(ordered, prepend=-1))
            touched = ordered[starts]
            pull = np.add.reduceat(error[own], starts)
            seen_linear[touched] += pull**2
            errors[touched] += pull
            if epoch < settings.toll_epochs:
                paid[touched] += settings.toll * share[touched]
            beyond = np.sign(errors[touched]) * np.maximum(np.abs(errors[touched]) - paid[touched], 0)
            machine.linear[touched] = -settings.rate * beyond / np.sqrt(seen_linear[touched])
            pull = np.add.reduceat((error / np.maximum(size, 1))[own, None] * (sums[own] - vectors[order]), starts)
            pull += settings.decay * len(batch) * machine.factors[touched]
            seen_factors[touched] += pull**2
            machine.factors[touched] -= settings.factor_rate * pull / np.sqrt(seen_factors[touched])
    return machine


def train(documents: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> Machine:
    """Fit on the labelled documents for whose ``doc_id`` the condition ``learn`` holds.

    The hashed terms of the sample go to one task, which fits the machine; the driver gets the machine alone.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(*order).limit(settings.sample_rows)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, row, bins in terms(batch.column("text"), settings.bits, settings.beginnings):
                ends = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bins))
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), lists], ["doc_id", "label", "bins"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, bins, labels_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for batch in batches:
            lengths.append(np.asarray(batch.column(1).value_lengths().fill_null(0), np.int64))
            bins.append(np.array(batch.column(1).flatten(), np.int32))
            labels_.append(np.asarray(batch.column(0), np.float64))
        whole = np.concatenate(bins)
        bins.clear()
        machine = _fit(np.concatenate(lengths), whole, np.concatenate(labels_), settings)
        yield pa.RecordBatch.from_pylist(
            [{"bias": machine.bias, "bins": machine.bins.tobytes(), "linear": machine.linear.tobytes(), "factors": machine.factors.tobytes()}]
        )

    found = (
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids
        .mapInArrow(lean(features), "doc_id long, label int, bins array<int>")
    )
    found = settled(found.select("*", F.coalesce(F.size("bins"), F.lit(0)).alias("size"), F.xxhash64("bins").alias("digest")))
    # the places of the rows in the order, their bins left aside; documents may repeat an id
    keyed = running(found.select("doc_id", "size", "digest"), [*order, F.col("digest")], {"row": F.lit(1), "pairs": F.col("size")})
    fits = keyed.where((F.col("row") <= settings.sample_rows) & (F.col("pairs") <= settings.sample_pairs)).agg(F.max("row")).first()[0] or 0
    # no more rows than were counted to fit
    taken = found.orderBy(*order, "digest").limit(fits).select("label", "bins")
    row = taken.coalesce(1).mapInArrow(lean(fit), "bias double, bins binary, linear binary, factors binary").first()
    machine = Machine(settings, np.frombuffer(row.bins, np.int32) if row else np.zeros(0, np.int32))
    if row:
        machine.bias, machine.linear = row.bias, np.frombuffer(row.linear, np.float32)
        machine.factors = np.frombuffer(row.factors, np.float32).reshape(-1, settings.factors)
    return machine


def score(text: Column, machine: Machine, documents: DataFrame) -> Column:
    """The probability that a text is toxic, between 0 and 1."""
    held = documents.sparkSession.sparkContext.broadcast(machine)  # at most 2**bits * (factors + 1) numbers

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        scores = pa.array(held.value.score(texts))
        give_back()
        return scores

    return toxicity(text)


def learnable(column: str = "doc_id") -> Column:
    """Rows whose label may be used: a fifth of the ids is held out."""
    return F.crc32(F.col(column).cast("string")) % 5 != 0
