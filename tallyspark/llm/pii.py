"""Personal data: four base kinds by pattern, and more by contexts that the base finds teach.

Bootstrapping: the finds of the base kinds are seeds. The words around every identifier-like word (one with a digit; words
without are no candidates, as any word of a text would be one) are a lexical pattern. Patterns and instances form a graph: a pattern is trusted by the share of its instances that
are trusted for its kind, an instance by the trust of its patterns; Spark repeats both steps. Patterns that stay above
the threshold with enough different instances name the kind of identifiers the base patterns do not match.

Defined cases: a null text is empty and has no spans. Every row is read whole; repeated rows have equal spans. The
base finds stay whatever the method adds, and an added span never overlaps one of them. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import lean, settled

KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_IDENTIFIER = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+")
_EDGES = "\"'()[]{}<>,;:.!?"
_SPACES = frozenset("\x20\t\n\v\f\r")


@dataclass(frozen=True)
class Settings:
    """``rounds`` of scoring; a pattern needs ``min_instances`` different trusted instances and the trust ``accept``."""

    rounds: int = 3
    min_instances: int = 5
    accept: float = 0.8


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Finds of the base kinds, by kind as listed, then by start. Each is found in time linear in the text: an address is
    sought from its ``@``, a dotted number only where a run of digits begins."""
    found, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append(("email", start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def _word(text: str, place: int, step: int) -> str:
    """The next word from ``place`` on in the direction of ``step``, however far and long; only this stretch is looked at."""
    ends = len(text) if step > 0 else -1
    first = place
    while first != ends and text[first] in _SPACES:
        first += step
    last = first
    while last != ends and text[last] not in _SPACES:
        last += step
    return (text[first:last] if step > 0 else text[last + 1 : first + 1]).lower()


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    """The word before and the word after, lower-case."""
    return _word(text, start - 1, -1), _word(text, end, 1)


def _candidates(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, str, str, int, int]]:
    """Kind ('' if unknown), pattern, instance, start and end of every identifier in its context. A pattern is the word
    before it, the word after it, or both."""
    items = [*spans]
    taken = sorted((s, e) for _, s, e in spans)
    k = 0
    for m in _IDENTIFIER.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            word = m[0]
            left = len(word) - len(word.lstrip(_EDGES))
            right = len(word.rstrip(_EDGES))
            items.append(("", m.start() + left, m.start() + max(right, left)))
    for kind, start, end in items:
        if end > start:
            before, after = _context(text, start, end)
            if before:
                yield kind, f"{before} *", text[start:end], start, end
            if after:
                yield kind, f"* {after}", text[start:end], start, end
            if before and after:
                yield kind, f"{before} * {after}", text[start:end], start, end


_RESULT = (
    "doc_id long, text_key long, base array<struct<kind:string,start:int,end:int>>, "
    "near array<struct<kind:string,pattern:long,instance:long,start:int,end:int>>"
)


def _key(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    near_type = pa.list_(pa.struct([("kind", pa.string()), ("pattern", pa.int64()), ("instance", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            bases, nears = [], []
            for text in part.column("text").to_pylist():
                spans = base_spans(text or "")
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                nears.append([
                    {"kind": k, "pattern": _key(p), "instance": _key(i), "start": s, "end": e}
                    for k, p, i, s, e in _candidates(text or "", spans)
                ])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(bases, base_type), pa.array(nears, near_type)],
                ["doc_id", "text_key", "base", "near"],
            )


def _patterns(scanned: DataFrame, settings: Settings) -> DataFrame:
    """``pattern``, ``kind`` and trust of the accepted patterns, from the graph of all patterns and instances."""
    graph = settled(
        scanned.select(F.explode("near").alias("n")).select("n.kind", "n.pattern", "n.instance")
        .groupBy("pattern", "instance").agg(F.max("kind").alias("seed"))
    )
    trust = graph.where("seed != ''").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("trust")).distinct()
    kept = None
    for _ in range(settings.rounds):
        sizes = graph.groupBy("pattern").agg(F.count("*").alias("instances"))
        kept = (
            graph.join(trust, "instance").groupBy("pattern", "kind")
            .agg(F.sum("trust").alias("mass"), F.count("*").alias("trusted"))
            .join(sizes, "pattern").withColumn("trust", F.col("mass") / F.col("instances"))
            .where((F.col("trusted") >= settings.min_instances) & (F.col("trust") >= settings.accept))
        )
        kept = settled(kept.select("pattern", "kind", F.col("trust").alias("pattern_trust")))
        if kept.isEmpty():
            break
        found = graph.join(kept, "pattern").groupBy("instance", "kind").agg(F.max("pattern_trust").alias("trust"))
        trust = trust.union(found).groupBy("instance", "kind").agg(F.max("trust").alias("trust"))
    # one kind for a pattern: the most trusted, then the first by name
    return kept.groupBy("pattern").agg(F.max_by("kind", F.struct("pattern_trust", "kind")).alias("kind"), F.max("pattern_trust").alias("trust"))


def scan(documents: DataFrame) -> DataFrame:
    """Base finds and candidates of every row, without the texts; settled, as all later steps read it."""
    return settled(documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(lean(_scan), _RESULT))


def find(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text), ``base`` and ``spans`` of every row; spans hold the base finds and
    those the accepted patterns add, by kind as listed and then by start."""
    scanned = scan(documents)
    accepted = _patterns(scanned, settings)
    added = (
        scanned.select("doc_id", "text_key", F.explode("near").alias("n")).where("n.kind = ''")
        .select("doc_id", "text_key", "n.pattern", "n.start", "n.end")
        .join(accepted, "pattern")
        .groupBy("doc_id", "text_key", "start", "end").agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind"))
        .groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    )
    place = F.create_map(*[x for k, v in enumerate(KINDS) for x in (F.lit(v), F.lit(k))])
    both = F.concat("s.base", F.coalesce("a.added", F.array()))
    ordered = F.sort_array(F.transform(both, lambda s: F.struct(place[s["kind"]], s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    same = F.col("s.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("s.text_key") == F.col("a.text_key"))
    return scanned.alias("s").join(added.alias("a"), same, "left").select(
        "s.doc_id", "s.text_key", "s.base", F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans")
    )


def redact(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; all rows and columns stay. Where spans overlap,
    the one that starts first is replaced and reaches to the end of the last."""
    found = find(documents.select("doc_id", "text"), settings).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    key = "__text_key"
    while key in documents.columns:
        key += "_"
    left, right = documents.withColumn(key, F.xxhash64("text")).alias("d"), found.alias("f")
    joined = left.join(right, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col(f"d.{key}") == F.col("f.text_key")), "left")

    @F.arrow_udf("string")
    def masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([mask(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    text = F.when(F.col("f.spans").isNull(), F.col("d.text")).otherwise(masked(F.col("d.text"), F.col("f.spans")))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in documents.columns])


def mask(text: str | None, spans: list[dict] | None) -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]
