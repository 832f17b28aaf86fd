"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are the longest stretches without space, tab, line feed, vertical tab, form feed and carriage return. A null
text has no words; texts without words fail the base rules. Every row is judged by its own text alone: repeated rows
are judged alike, other columns are not looked at, an empty table gives an empty result. A text is never
rejected for being long; a very long one is held whole by its task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: Frequent words of the four languages; fixed values.
STOP_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on", "with", "be", "this", "are", "or", "by", "as", "an", "at", "from",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "est", "pour", "pas", "sur", "par", "au", "avec",
    "der", "die", "das", "und", "ein", "eine", "ist", "von", "zu", "mit", "den", "nicht", "im", "für", "auf", "des", "dem", "sich", "auch",
    "el", "los", "las", "y", "una", "por", "con", "para", "del", "se", "al", "lo", "su", "como", "más", "o",
]


@dataclass(frozen=True)
class Rule:
    """Keep a text if ``top / bottom`` lies within the bounds; ``bottom`` 0 counts as 1."""

    name: str
    top: str
    bottom: str | None = None
    low: float | None = None
    high: float | None = None

    def holds(self, count: Callable[[str], Column]) -> Column:
        value = count(self.top).cast("double")
        if self.bottom:
            value = value / F.greatest(count(self.bottom), F.lit(1))
        checks = F.lit(True)
        if self.low is not None:
            checks = checks & (value >= self.low)
        if self.high is not None:
            checks = checks & (value <= self.high)
        return checks


RULES = [
    Rule("words", "n_words", low=50),
    Rule("word_length", "word_chars", "n_words", low=2.0, high=14.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.04),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("marked_words", "n_marked_words", "n_words", high=0.3),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, so that the optimizer does not repeat its computation at each use."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))


def _covered(places: Column) -> Column:
    """Words under three-word windows that start at the given ascending places."""
    steps = F.transform(
        places,
        lambda p, k: F.when(k == F.size(places) - 1, F.lit(3)).otherwise(F.least(F.lit(3), F.get(places, k + 1) - p)),
    )
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _repeated(hashes: Column) -> Column:
    """Words in windows that occur twice or more: equal hashes are neighbours once sorted."""

    def places(ordered: Column) -> Column:
        same = lambda k, x: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        hit = F.filter(ordered, lambda x, k: same(k - 1, x) | same(k + 1, x))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        let(let(ordered, places), _covered)
    )


def repeated_words(words: Column) -> Column:
    """Number of words in three-word windows found twice or more in the text, the first included."""
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(_windows(words), _repeated))


def _measures(text: Column) -> Column:
    stops = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    of_lines = lambda lines: F.struct(
        F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines")
    )
    of_words = lambda words: F.struct(
        F.size(words).alias("n_words"),
        let(
            F.array_join(words, ""),
            lambda joined: F.struct(
                F.length(joined).alias("chars"),
                F.length(F.regexp_replace(joined, r"[^#*$%&|<>]+", "")).alias("symbols"),
            ),
        ).alias("joined"),
        F.size(F.filter(words, lambda w: w.isin(*stops))).alias("n_stop_words"),
        F.size(F.filter(words, lambda w: w.endswith("!!"))).alias("n_marked_words"),
        repeated_words(words).alias("n_repeat_words"),
    )
    return F.struct(
        let(F.array_remove(F.split(text, SPACES), ""), of_words).alias("w"),
        let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines).alias("l"),
    )


def measures(text: Column) -> Column:
    """All counts of a text as one struct."""
    return let(F.coalesce(text, F.lit("")), _measures)


#: Where each count stands in the struct of ``measures``.
COUNTS = {
    "n_words": "w.n_words", "word_chars": "w.joined.chars", "n_symbols": "w.joined.symbols", "n_dup_lines": "l.n_dup_lines",
    "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_stop_words": "w.n_stop_words",
    "n_marked_words": "w.n_marked_words",
}


def _count_in(m: Column) -> Callable[[str], Column]:
    def count(name: str) -> Column:
        value = m
        for part in COUNTS[name].split("."):
            value = value[part]
        return value.cast("long")

    return count


def base_failed(count: Callable[[str], Column]) -> Column:
    return (count("n_words") < 50) | (100 * count("n_repeat_words") > 50 * count("n_words"))


def passed(count: Callable[[str], Column], rules: list[Rule]) -> Column:
    verdict = ~base_failed(count)
    for rule in rules:
        verdict = verdict & rule.holds(count)
    return verdict


def judge(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every document, in one projection."""
    found = documents.select("doc_id", measures(F.col("text")).alias("m"))
    count = _count_in(F.col("m"))
    return found.select(
        "doc_id", *(count(c).alias(c) for c in COUNTS), base_failed(count).alias("base_failed"), passed(count, rules).alias("kept")
    )


def keep(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The documents that pass, with their own columns."""
    return documents.where(let(measures(F.col("text")), lambda m: passed(_count_in(m), rules)))
