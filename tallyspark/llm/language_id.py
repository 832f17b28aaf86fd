"""Language identification by words first, backing off to shorter and shorter character n-grams.

A known word counts with its log frequency in each language. An unknown word is read character by character: at each
place the longest known n-gram, from four letters down to one, counts instead, with a penalty for every step down.

Defined cases: a null text or one without a letter is ``und`` with score 0. Rows with a null language teach nothing;
if nothing was learned every text is ``und``. Ties go to the language that comes first in order. Repeated rows are
judged alike, other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.textops import Chunk, Hashes, chunks, find, letters, lower

WORD, LONGEST = 0, 4


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the rows that are learned from, taken by the hash of the id; ``max_terms`` bounds the
    words and n-grams of the model. Every language has an equal share of it for words and for n-grams of each length, the most
    frequent of its own first, so that a language with few rows keeps as many as one with most. Terms seen less than
    ``min_count`` times are left out."""

    sample_rows: int = 20_000
    max_terms: int = 1 << 19
    min_count: int = 3
    step_down: float = 0.4


def _words(chunk: Chunk) -> tuple[Hashes, np.ndarray, np.ndarray]:
    starts, ends = chunk.runs(letters()[chunk.points])
    return Hashes(lower()[chunk.points]), starts, ends


def _grams(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every place of n letters inside the words, and the word each belongs to."""
    sizes = np.maximum(ends - starts - n + 1, 0)
    owner = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(sizes.sum()) - (np.cumsum(sizes) - sizes)[owner] + starts[owner], owner


@dataclass
class Model:
    """Sorted hashes of words and n-grams with their log frequency in each language."""

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    floor: np.ndarray
    step_down: float

    def _of_words(self, hashes: Hashes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), len(self.languages)))
        at = find(self.keys[WORD], hashes.of(starts, ends))
        out[at >= 0] = self.logs[WORD][at[at >= 0]]
        new = np.flatnonzero(at < 0)
        if not len(new):
            return out
        begin, end = starts[new], ends[new]
        place, owner = _grams(begin, end, 1)
        sums = np.zeros((len(new), len(self.languages)))
        down = 0.0
        for n in range(LONGEST, 0, -1):
            fits = np.flatnonzero(place + n <= end[owner])
            at = find(self.keys[n], hashes.of(place[fits], place[fits] + n, n))
            hit = fits[at >= 0]
            values = self.logs[n][at[at >= 0]] + down
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(owner[hit], values[:, k], len(new))
            rest = np.ones(len(place), bool)
            rest[hit] = False
            place, owner = place[rest], owner[rest]
            down += np.log(self.step_down)
        sums += np.bincount(owner, minlength=len(new))[:, None] * (self.floor + down)
        # the n-grams of a word overlap: their mean stands for the word
        out[new] = sums / np.maximum(end - begin, 1)[:, None]
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place of the language (-1 for none) and the posterior probability of it."""
        best, sure = np.full(len(texts), -1), np.zeros(len(texts))
        if not self.languages:
            return best, sure
        for chunk in chunks(texts):
            hashes, starts, ends = _words(chunk)
            if not len(starts):
                continue
            _, first, inverse = np.unique(hashes.of(starts, ends), return_index=True, return_inverse=True)
            of_words, rows = self._of_words(hashes, starts[first], ends[first]), chunk.row_of(starts)
            sums = np.stack([np.bincount(rows, of_words[inverse, k], chunk.rows) for k in range(len(self.languages))], axis=1)
            some = np.bincount(rows, minlength=chunk.rows) > 0
            top = sums.argmax(axis=1)
            odds = np.exp(np.clip(sums - sums.max(axis=1, keepdims=True), -700, 0))
            at = slice(chunk.first, chunk.first + chunk.rows)
            best[at] = np.where(some, top, -1)
            sure[at] = np.where(some, 1 / odds.sum(axis=1), 0.0)
        return best, sure


def train(documents: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:
    """Learn from rows with a language for which ``learn`` holds. Words and n-grams are counted on the executors; the
    driver gets at most ``max_terms`` words and n-grams together."""
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    order = F.xxhash64("doc_id")
    cut = usable.select(order.alias("h")).orderBy("h").limit(settings.sample_rows).agg(F.max("h")).first()[0]
    if cut is None:
        return Model([], [], [], np.zeros(0), settings.step_down)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            of_row = np.asarray(langs.indices)
            for chunk in chunks(batch.column("text")):
                hashes, starts, ends = _words(chunk)
                code, keys = of_row[chunk.first + chunk.row_of(starts)], hashes.of(starts, ends)
                for lang in np.unique(code):
                    own = np.flatnonzero(code == lang)
                    words, first, seen = np.unique(keys[own], return_index=True, return_counts=True)
                    begin, end = starts[own[first]], ends[own[first]]
                    parts = [(WORD, words, seen)]
                    for n in range(1, LONGEST + 1):
                        place, owner = _grams(begin, end, n)
                        grams, inverse = np.unique(hashes.of(place, place + n, n), return_inverse=True)
                        parts.append((n, grams, np.bincount(inverse, seen[owner], len(grams))))
                    for n, found, times in parts:
                        size = len(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([langs.dictionary[int(lang)].as_py()] * size, pa.string()), pa.array(np.full(size, n, np.int32)),
                             pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))],
                            ["lang", "n", "key", "times"],
                        )

    sample = usable.where(order <= cut)
    share = max(1, settings.max_terms // ((LONGEST + 1) * sample.select("lang").distinct().count()))
    of_language = Window.partitionBy("lang", "n").orderBy(F.desc("times"), "key")  # terms of the sample
    table = (
        sample.select("lang", "text")
        .mapInArrow(count, "lang string, n int, key long, times long")
        .groupBy("lang", "n", "key").agg(F.sum("times").alias("times"))
        .withColumn("place", F.row_number().over(of_language))
        .groupBy("n", "key").agg(
            F.sum("times").alias("all"), F.min("place").alias("place"), F.collect_list("lang").alias("l"), F.collect_list("times").alias("t")
        )  # one entry for each language
        .where((F.col("all") >= settings.min_count) & (F.col("place") <= share))
        .orderBy("n", "key")
    ).toArrow()
    ns, hashes = table.column("n").to_numpy(), table.column("key").to_numpy().view(np.uint64)
    langs, times = table.column("l").combine_chunks(), np.asarray(table.column("t").combine_chunks().flatten(), float)
    row = np.repeat(np.arange(len(ns)), np.asarray(langs.value_lengths(), np.int64))
    named = langs.flatten().dictionary_encode()
    known = named.dictionary.to_pylist()
    languages = sorted(known)
    column = np.array([languages.index(x) for x in known], np.int64)[np.asarray(named.indices)] if len(row) else row
    values = np.full((len(ns), len(languages)), 0.1)
    values[row, column] = times
    keys, logs = [], []
    total = np.ones((LONGEST + 1, len(languages)))
    for n in range(LONGEST + 1):
        own = np.flatnonzero(ns == n)
        own = own[np.argsort(hashes[own])]
        total[n] = np.maximum(values[own].sum(axis=0), 1)
        keys.append(hashes[own])
        logs.append(np.log(values[own] / total[n]))
    floor = -np.log(10 * total[1])
    return Model(languages, keys, logs, floor, settings.step_down)


def predict(text: Column, model: Model, documents: DataFrame) -> Column:
    """A struct of ``lang_pred`` and ``score``."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # at most max_terms rows of numbers

    @F.arrow_udf("lang_pred string, score double")
    def language(texts: pa.Array) -> pa.Array:
        best, sure = held.value.predict(texts)
        names = np.array([*held.value.languages, "und"], object)[best]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sure)], ["lang_pred", "score"])

    return language(text)


def held_out(column: str = "doc_id") -> Column:
    """A third of the ids is never learned from; a null id neither."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(True))
