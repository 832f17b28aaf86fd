"""Exact interpolated percentiles of many columns, without gathering a column in one task.

A mergeable rank sketch brackets each percentile. One global aggregate counts the values below and inside every bracket, and
only the values inside (well below one percent of a large column) are counted by value and ordered. A second sketch, of what is inside a
bracket, cuts it into slices of about equal numbers of rows, so that no slice holds much more than its share however the
values lie. A bracket that does not hold its ranks is seen by its counts, and the column is counted anew with a wider one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.safe import sql_double, sql_text

SKETCH_ACCURACY = 10_000
# Half-widths of a bracket in probability, each tried when the one before missed. The first must leave two rows and the
# error of the sketch, 1/accuracy, on both sides; beyond the last everything is inside.
WIDTHS = (4.0 / SKETCH_ACCURACY, 4e-3, 4e-2)
# Rows of a slice, and slices of a bracket at most.
SLICE_ROWS = 50_000
SLICES = 256
# Values handled by one aggregate. Small blocks keep the generated code small enough to be compiled to
# machine code; each block scans only its own columns, so no more bytes are read.
BLOCK = 3

INF = float("inf")
LARGEST = 1.7976931348623157e308


class _Value:
    """What is known of one value: its edges by probability and width, its brackets and their counts."""

    def __init__(self, n: int, edges: list[float], probs: Sequence[float]):
        self.n = n
        self.ranks = [(math.floor(float(p) * (n - 1)), math.ceil(float(p) * (n - 1))) for p in probs]
        # Infinity may stand for NaN, so it never counts as a bracket of one value.
        pairs = [(min(low, LARGEST), high) for low, high in zip(edges[::2], edges[1::2])]
        per = len(WIDTHS)
        self.choices = [[*pairs[j * per : (j + 1) * per], (-INF, INF)] for j in range(len(probs))] if n else []
        fits = sum(2 / n + 1 / SKETCH_ACCURACY > width for width in WIDTHS) if n else 0
        self.step = [fits] * len(self.choices)
        self.counts = None

    @property
    def brackets(self) -> list[tuple[float, float]]:
        return [choices[step] for choices, step in zip(self.choices, self.step)]

    def settle(self, counts) -> bool:
        """Take the counts of the brackets; False if one has missed, which is then widened."""
        self.counts, fine = counts, True
        for j, (low, high) in enumerate(self.ranks if self.n else []):
            if not counts["below"][j] <= low <= high < counts["below"][j] + counts["inside"][j]:
                self.step[j] += 1
                fine = False
        return fine

    def cuts(self, j: int) -> list[float]:
        """Upper bounds of all slices of a bracket but the last."""
        splits, wanted = self.counts["splits"][j] or [], -(-self.counts["inside"][j] // SLICE_ROWS)
        keep = min(wanted, SLICES)
        return sorted({splits[k * SLICES // keep - 1] for k in range(1, keep)}) if splits else []


def exact_percentiles(
    df: DataFrame, values: dict[str, Column], probs: Sequence[float], measures: dict[str, str] | None = None
) -> DataFrame:
    """One row per named value: ``column_name, n, p0, p1, ...`` and the extra measures asked for.

    ``values`` are double expressions over ``df``; NULL is left out and NaN sorts above every
    number. ``measures`` are SQL aggregates of ``{v}``. Sketch and counts are evaluated at once (one
    row per value each), the selection inside the brackets is lazy.
    """
    names = list(values)
    base = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values.values())])
    # v is the value, o the form in which it is ordered: NaN counts as infinity.
    base = base.selectExpr("*", *[f"nanvl(v{i}, double('inf')) AS o{i}" for i in range(len(names))])
    found = _sketched(base, len(names), probs)
    measures = measures or {}
    left = list(range(len(names)))
    while left:
        rows = _union([_counts(base, b, found, measures) for b in _blocks(left)]).collect()
        left = [r["pos"] for r in rows if not found[r["pos"]].settle(r)]

    spark = df.sparkSession
    facts = [
        [str(i), sql_text(name), f"{v.n}L", *[_known(v.brackets, j) for j in range(len(probs))], *[_literal(v.counts[label]) for label in measures]]
        for i, (name, v) in enumerate(zip(names, found))
    ]
    known = [f"known{j}" for j in range(len(probs))]
    rows = _values(spark, facts, ["pos", "column_name", "n", *known, *measures])
    ranks = [
        [str(i), str(j), f"'{side}'", f"{rank - v.counts['below'][j]}L"]
        for i, v in enumerate(found)
        for j, (low, high) in enumerate(v.brackets)
        for side, rank in zip(("lo", "hi"), v.ranks[j])
        if low != high
    ]
    if ranks:
        kept = [part for part in (_inside(base, block, found) for block in _blocks(range(len(names)))) if part is not None]
        frequencies = _union(kept).groupBy("pos", "j", "slice", "v").count()
        picked = _pick(frequencies, _values(spark, ranks, ["pos", "j", "side", "rank"]), len(probs))
        rows = rows.join(picked.hint("broadcast"), "pos", "left")  # one row per value
    else:
        rows = rows.selectExpr("*", *[f"double(NULL) AS {s}{j}" for j in range(len(probs)) for s in ("lo", "hi")])
    return rows.selectExpr("column_name", "n", *[_interpolate(j, float(p)) for j, p in enumerate(probs)], *measures)


def _blocks(places: Sequence[int]) -> list[Sequence[int]]:
    return [places[at : at + BLOCK] for at in range(0, len(places), BLOCK)]


def _literal(value) -> str:
    if value is None:
        return "double(NULL)"
    return f"{value}L" if isinstance(value, int) else sql_double(value)


def _known(brackets: list[tuple[float, float]], j: int) -> str:
    """A bracket of one value is that value."""
    return _literal(brackets[j][0] if brackets and brackets[j][0] == brackets[j][1] else None)


def _values(spark: SparkSession, rows: list[list[str]], columns: list[str]) -> DataFrame:
    """A small constant table."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)} AS t({', '.join(columns)})")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _sketched(base: DataFrame, width: int, probs: Sequence[float]) -> list[_Value]:
    """Per value its number of rows and the edges of its possible brackets; a block of values is sketched in one scan."""
    edges = ", ".join(sql_double(min(1.0, max(0.0, p + s))) for p in probs for w in WIDTHS for s in (-w, w))
    parts = []
    for block in _blocks(range(width)):
        aggs = [
            x for i in block for x in (f"count(o{i}) AS n{i}", f"percentile_approx(o{i}, array({edges}), {SKETCH_ACCURACY}) AS e{i}")
        ]
        rows = ", ".join(f"named_struct('pos', {i}, 'n', n{i}, 'edges', e{i})" for i in block)
        parts.append(base.selectExpr(*aggs).selectExpr(f"inline(array({rows}))"))
    found = {r["pos"]: _Value(r["n"], r["edges"] or [], probs) for r in _union(parts).collect()}  # one row per value
    return [found[i] for i in range(width)]


def _counts(base: DataFrame, block: Sequence[int], found: list[_Value], measures: dict[str, str]) -> DataFrame:
    """Rows below and inside each bracket, what cuts its inside into equal slices, and the extra measures of a block, in one scan."""
    shares = ", ".join(sql_double(k / SLICES) for k in range(1, SLICES))
    aggs, rows = [], []
    for i in block:
        below, inside, splits = [], [], []
        for j, (low, high) in enumerate(found[i].brackets):
            within = f"o{i} BETWEEN {sql_double(low)} AND {sql_double(high)}"
            aggs += [f"count_if(o{i} < {sql_double(low)}) AS b{i}_{j}", f"count_if({within}) AS c{i}_{j}"]
            below.append(f"b{i}_{j}")
            inside.append(f"c{i}_{j}")
            # few rows need no slices, and of equal ones there is one
            many = low != high and found[i].n * min(1.0, 2 * [*WIDTHS, 1.0][found[i].step[j]]) > SLICE_ROWS
            if many:
                aggs.append(f"percentile_approx(CASE WHEN {within} THEN o{i} END, array({shares}), {16 * SLICES}) AS s{i}_{j}")
            splits.append(f"s{i}_{j}" if many else "CAST(NULL AS array<double>)")
        aggs += [f"{agg.format(v=f'v{i}')} AS m{i}_{label}" for label, agg in measures.items()]
        aggs.append(f"count(v{i}) AS n{i}")
        extra = "".join(f", '{label}', m{i}_{label}" for label in measures)
        lists = (f"cast(array({', '.join(x)}) AS array<{kind}>)" for x, kind in ((below, "bigint"), (inside, "bigint"), (splits, "array<double>")))
        rows.append("named_struct('pos', {}, 'n', n{}, 'below', {}, 'inside', {}, 'splits', {}{})".format(i, i, *lists, extra))
    return base.selectExpr(*aggs).selectExpr(f"inline(array({', '.join(rows)}))")


def _inside(base: DataFrame, block: Sequence[int], found: list[_Value]) -> DataFrame | None:
    """(pos, j, slice, v) for every value of a block inside one of its brackets of more than one value."""
    entries, tests = [], []
    for i in block:
        for j, (low, high) in enumerate(found[i].brackets):
            if low == high:
                continue
            within = f"o{i} BETWEEN {sql_double(low)} AND {sql_double(high)}"
            cuts = ",".join(repr(c) for c in found[i].cuts(j))
            part = f"size(filter(CAST(split('{cuts}', ',') AS array<double>), x -> x < o{i}))" if cuts else "0"
            entry = f"named_struct('pos', {i}, 'j', {j}, 'slice', {part}, 'v', v{i})"
            entries.append(f"CASE WHEN {within} THEN {entry} END")
            tests.append(f"({within})")
    if not entries:
        return None
    return base.filter(" OR ".join(tests)).selectExpr(f"inline(array_compact(array({', '.join(entries)})))")


def _pick(kept: DataFrame, ranks: DataFrame, brackets: int) -> DataFrame:
    """(pos, lo0, hi0, lo1, ...): the wanted ranks within each bracket, from (pos, j, slice, v, count)."""
    # SLICES x brackets rows per value at most, so this running sum is small.
    slices = kept.groupBy("pos", "j", "slice").agg(F.sum("count").alias("size"))
    slices = slices.selectExpr("*", "sum(size) OVER (PARTITION BY pos, j ORDER BY slice) - size AS before")
    wanted = (
        slices.join(ranks.hint("broadcast"), ["pos", "j"])  # two ranks per bracket
        .filter("rank >= before AND rank < before + size")
        .select("pos", "j", "slice", "side", "rank", "before")
    )
    found = (
        kept.join(wanted.hint("broadcast"), ["pos", "j", "slice"])
        .selectExpr("*", "before + sum(count) OVER (PARTITION BY pos, j, side ORDER BY v) AS upto")
        .filter("rank < upto AND rank >= upto - count")
    )
    sides = [f"max(CASE WHEN j = {j} AND side = '{s}' THEN v END) AS {s}{j}" for j in range(brackets) for s in ("lo", "hi")]
    return found.groupBy("pos").agg(*[F.expr(side) for side in sides])


def _interpolate(j: int, p: float) -> str:
    low, high = f"coalesce(known{j}, lo{j})", f"coalesce(known{j}, hi{j})"
    share = f"({sql_double(p)} * (n - 1) - floor({sql_double(p)} * (n - 1)))"
    return f"CASE WHEN {low} = {high} OR {share} = 0 THEN {low} ELSE {low} + ({high} - {low}) * {share} END AS p{j}"
