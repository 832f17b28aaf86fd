from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import safe
from tallyspark.operators import quantiles
from tallyspark.operators.preview import TablePreview
from tallyspark.operators.profile import TableProfile, fallback_profile
from tallyspark.functions.safe import column
from tests.conftest import rows

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


def _percentiles(spark, values, probs=PROBS):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = quantiles.exact_percentiles(df, {"x": column("x")}, probs, {"high": "max({v})"}).first()
    return row["n"], [row[f"p{i}"] for i in range(len(probs))]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 19, 100, 101])
def test_percentiles_of_few_rows(spark, n):
    rng = random.Random(n)
    values = [rng.uniform(-10, 10) for _ in range(n)]
    found = _percentiles(spark, [*values, None])
    assert found[0] == n and np.allclose(found[1], np.quantile(values, PROBS), rtol=0, atol=1e-12)


@pytest.mark.parametrize(
    "values",
    [
        list(np.random.default_rng(1).normal(size=60_000)),
        list(np.random.default_rng(2).pareto(0.3, size=60_000)),
        [1.0] * 20_000 + list(range(40_000)),  # a third of the rows share one value
        [float(i % 7) for i in range(60_000)],
        [5.0] * 50_000,
        [1e300, -1e300] + [0.001 * i for i in range(50_000)],
    ],
    ids=["normal", "heavy tail", "hot value", "discrete", "constant", "outliers"],
)
@pytest.mark.parametrize("slice_rows", [quantiles.SLICE_ROWS, 3])
def test_percentiles_of_many_rows(spark, values, slice_rows, monkeypatch):
    monkeypatch.setattr(quantiles, "SLICE_ROWS", slice_rows)
    values = [float(v) for v in values]
    found = _percentiles(spark, values)
    assert np.allclose(found[1], np.quantile(values, PROBS), rtol=1e-13, atol=1e-12)


def test_slices_hold_equal_shares_of_a_long_tail(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SLICE_ROWS", 20)
    monkeypatch.setattr(quantiles, "WIDTHS", (0.04,))
    values = [float(v) for v in np.random.default_rng(2).pareto(0.2, size=30_000)]
    seen, pick = [], quantiles._pick
    monkeypatch.setattr(quantiles, "_pick", lambda kept, *rest: seen.append(kept) or pick(kept, *rest))
    found = _percentiles(spark, values, [0.5, 0.99])
    assert np.allclose(found[1], np.quantile(values, [0.5, 0.99]), rtol=1e-13)
    sizes = seen[0].groupBy("pos", "j", "slice").agg(F.sum("count").alias("n")).collect()
    for j, most in ((0, 2400), (1, 1500)):
        own = [r["n"] for r in sizes if r["j"] == j]
        assert sum(own) <= most + 20 and len(own) >= 60 and max(own) <= 4 * sum(own) / len(own)


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """Edges off by far more than the sketch may be: every bracket misses, up to the last, which holds all."""
    seen, values = [], [float(v) for v in np.random.default_rng(4).normal(size=30_000)]
    sketched, counts = quantiles._sketched, quantiles._counts

    def wrong(*args):
        found = sketched(*args)
        for value in found:
            value.choices = [[*[(low + 9.0, high + 9.0) for low, high in c[:-1]], c[-1]] for c in value.choices]
        return found

    monkeypatch.setattr(quantiles, "_sketched", wrong)
    monkeypatch.setattr(quantiles, "_counts", lambda *args: seen.append(1) or counts(*args))
    found = _percentiles(spark, values)
    assert len(seen) == len(quantiles.WIDTHS) + 1 and np.allclose(found[1], np.quantile(values, PROBS), rtol=1e-13, atol=1e-12)


def test_one_scan_of_a_block_for_its_sketches(spark, small):
    seen, union = [], quantiles._union
    quantiles._union = lambda frames: seen.append(frames) or union(frames)
    try:
        lines = spark.read.parquet(f"{small}/lineitem.parquet")
        names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_partkey"]
        quantiles.exact_percentiles(lines, {n: column(n).cast("double") for n in names}, [0.5]).collect()
    finally:
        quantiles._union = union
    assert [len(frames) for frames in seen] == [2, 2, 2]
    assert seen[0][0]._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_percentiles_with_nan_and_infinity(spark):
    n, found = _percentiles(spark, [1.0, 2.0, float("inf"), float("nan")], [0.0, 1 / 3, 2 / 3, 1.0])
    assert n == 4 and found[:3] == [1.0, 2.0, float("inf")] and np.isnan(found[3])


def test_percentiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    found = rows(quantiles.exact_percentiles(df, {"x": column("x"), "y": column("y")}, [0.5]))
    assert found == [("x", 0, None), ("y", 1, 1.0)]


@pytest.fixture(scope="module")
def edge(spark):
    """Constant, unique, half-missing, empty, zero and mixed columns over 120 rows."""
    data = [
        (7, i, None if i % 10 < 6 else i, None, 0.0, i % 2 == 0, f"id {i}", "x" if i else "42", f"2020-01-{i % 28 + 1:02d}")
        for i in range(120)
    ]
    return TableProfile(
        spark.createDataFrame(
            data,
            "constant int, id long, gaps int, empty string, zeros double, flag boolean, label string, odd string, day string",
        ),
        "edge",
    )


def test_types_by_any_readable_value(edge):
    found = {r["column_name"]: (r["inferred_best_dtype"], r["parse_rate"]) for r in edge.types().collect()}
    assert found["odd"] == ("numeric", 0.0083) and found["flag"] == ("numeric", 1.0)
    assert found["day"] == ("datetime", 1.0)
    assert found["empty"] == ("categorical", None) and found["label"] == ("categorical", None)


def test_quality_and_flags(edge):
    found = {r["column_name"]: r for r in edge.quality().collect()}
    assert found["gaps"]["missing_count"] == 72 and found["gaps"]["missing_percentage"] == 60.0
    assert (found["empty"]["unique_count"], found["empty"]["cardinality_ratio"]) == (0, 0.0)
    flags = rows(edge.flags())
    assert ("constant", "constant_value") in flags and ("zeros", "constant_value") in flags
    assert ("gaps", "high_missing_rate") in flags and ("empty", "high_missing_rate") in flags
    assert ("id", "unique_identifier") in flags and ("id", "near_unique") in flags
    assert ("odd", "unique_identifier") not in flags


def test_numeric_stats_keep_zero(edge):
    found = {r["column_name"]: r for r in edge.numeric_stats().collect()}
    assert set(found) == {"constant", "id", "gaps", "zeros", "flag", "odd"}
    assert found["zeros"]["median"] == 0.0 and found["zeros"]["coefficient_of_variation"] is None
    assert found["id"]["std_dev"] == round(statistics.stdev(range(120)), 3)
    assert found["odd"]["std_dev"] is None and found["odd"]["min"] == 42.0


def test_histogram_counts_everything(edge):
    total = {}
    for name, bucket, n in rows(edge.histogram()):
        total.setdefault(name, {})[bucket] = n
    assert sum(total["id"].values()) == 120 and total["id"][11] == 1
    assert total["constant"] == {1: 120} and "gaps" not in total  # 48 values are too few
    assert total["odd"] == {1: 1}


def test_dates(edge):
    assert edge.datetime_stats().first()["date_range_days"] == 27
    assert rows(edge.yearly()) == [("day", 2020, 120)]


def test_thresholds(spark):
    def make(n, distinct):
        return TableProfile(spark.createDataFrame([(f"v{i % distinct}", f"2020-01-0{i % 9 + 1}") for i in range(n)], "t string, d string"))

    assert make(200, 100).top_values().count() == 50 and make(202, 101).top_values().count() == 0
    notes = make(202, 101).categorical_notes().first()
    assert notes["is_high_cardinality"] and notes["note"] == "High cardinality (101 unique values) - analysis skipped"
    assert make(10, 2).yearly().count() == 0 and make(11, 2).yearly().count() == 1
    short = TableProfile(spark.createDataFrame([(float(i),) for i in range(100)], "x double"))
    assert short.histogram().count() == 0
    longer = TableProfile(spark.createDataFrame([(float(i),) for i in range(101)], "x double"))
    assert longer.histogram().count() == 11


def test_top_values_break_ties_by_value(spark):
    profile = TableProfile(spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "t string"))
    assert rows(profile.top_values(), "rank") == [("t", "c", 2, 50.0, 1), ("t", "a", 1, 25.0, 2), ("t", "b", 1, 25.0, 3)]
    assert profile.top_values_json().first()["top_values_json"] == '{"c":2,"a":1,"b":1}'


def test_correlations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    y = x + rng.normal(size=500)
    data = [
        (float(a), float(b), float(-a), 0.1, None if i % 3 else float(b), str(float(a)))
        for i, (a, b) in enumerate(zip(x, y))
    ]
    df = spark.createDataFrame(data, "x double, y double, minus double, same double, gaps double, txt string")
    found = {(r["column1"], r["column2"]): (r["correlation"], r["strength"]) for r in TableProfile(df).correlations().collect()}
    assert found["x", "minus"] == (-1.0, "strong") and found["x", "txt"] == (1.0, "strong")
    assert found["x", "y"][0] == round(float(np.corrcoef(x, y)[0, 1]), 3)
    assert found["x", "gaps"][0] == round(float(np.corrcoef(x[::3], y[::3])[0, 1]), 3)
    assert not any("same" in pair for pair in found)


def test_empty_and_single_row_tables(spark):
    empty = TableProfile(spark.createDataFrame([], "a int, t string"), "none")
    assert rows(empty.summary().drop("analysis_timestamp")) == [("none", 0, 0, "empty_file")]
    assert {r["unique_count"] for r in empty.quality().collect()} == {0}
    for part in ("numeric_stats", "histogram", "top_values", "correlations", "flags", "yearly", "datetime_stats"):
        assert getattr(empty, part)().count() == 0, part
    assert empty.overall().first()["overall_completeness"] == 0.0
    single = TableProfile(spark.createDataFrame([(5, "x")], "a int, t string"))
    stats = single.numeric_stats().first()
    assert (stats["median"], stats["std_dev"]) == (5.0, None)


def test_types_that_are_not_scalar(spark):
    df = spark.sql("SELECT array(1, 2) AS a, named_struct('x', 1) AS s, CAST('ab' AS BINARY) AS b, 1.50 AS d, X'00' AS z")
    profile = TableProfile(df)
    assert {r["column_name"]: r["inferred_best_dtype"] for r in profile.types().collect()} == {
        "a": "categorical",
        "s": "categorical",
        "b": "categorical",
        "d": "numeric",
        "z": "categorical",
    }
    assert all(part.count() >= 0 for part in profile.report().values())


def test_approximate_distinct(spark):
    df = spark.range(50_000)
    exact = TableProfile(df).cardinalities().first()["unique_count"]
    near = TableProfile(df, approximate_distinct=True).cardinalities().first()["unique_count"]
    assert exact == 50_000 and abs(near - exact) < 0.1 * exact


def test_hot_value_counts(spark):
    """A third of the rows hold one value."""
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('v', id) END AS t")
    assert TableProfile(df).cardinalities().first()["unique_count"] == 20_001


def test_fallback(spark):
    df = spark.createDataFrame([("1", "a", "2020-01-01"), ("2", None, "2020-01-02")], "n string, t string, d string")
    found = {r["column_name"]: r for r in fallback_profile(df).collect()}
    assert found["n"]["inferred_best_dtype"] == "numeric" and found["n"]["mean"] == 1.5
    assert found["t"]["missing_count"] == 1 and found["t"]["min"] is None
    assert found["d"]["inferred_best_dtype"] == "datetime"


def test_preview_needs_every_value(spark):
    data = [(str(i), "2020-01-01", "1" if i else "x", i % 2 == 0, None, f"unique {i}") for i in range(20)]
    preview = TablePreview(
        spark.createDataFrame(data, "n string, d string, mixed string, flag boolean, none string, u string")
    )
    found = {r["column_name"]: r["inferred_best_dtype"] for r in preview.types().collect()}
    assert found["n"].startswith("numeric") and found["d"].startswith("datetime")
    assert found["mixed"].startswith("categorical") and found["flag"] == "boolean"
    assert rows(preview.boolean()) == [("flag", False, 10), ("flag", True, 10)]
    assert {r["column_name"] for r in preview.notes().collect()} == {"none", "u"}
    assert rows(preview.top_values(), "rank") == [("mixed", "1", 19, 1, False), ("mixed", "x", 1, 2, False)]
    assert preview.numeric().first()["median"] == 9.5


def test_preview_without_numbers(spark):
    preview = TablePreview(spark.createDataFrame([("x",)], "t string"))
    assert preview.numeric().count() == 0 and preview.datetime().count() == 0 and preview.boolean().count() == 0


def test_types_are_decided_over_all_values(spark):
    """One odd value among 20,000 decides."""
    df = spark.range(20_000).selectExpr("if(id = 13000, 'x', string(id)) AS t", "string(id) AS n")
    found = {r["column_name"]: r["inferred_best_dtype"] for r in TablePreview(df).types().collect()}
    assert found["t"].startswith("categorical") and found["n"].startswith("numeric")


def test_only_listed_texts_are_moved(spark):
    df = spark.range(100).selectExpr("repeat(string(id), 500) AS long_text", "string('k' || id % 3) AS short")
    found = TablePreview(df, top=2).top_values()
    assert [(r["column_name"], r["rank"]) for r in found.orderBy("rank").collect()] == [("short", 1), ("short", 2)]
    assert "long_text" not in found._jdf.queryExecution().executedPlan().toString()


def test_histogram_counts_what_is_not_finite(spark):
    values = [*(float(i) for i in range(200)), float("nan"), float("inf"), float("-inf")]
    found = rows(TableProfile(spark.createDataFrame([(v,) for v in values], "v double")).histogram())
    by_bucket = {b: n for _, b, n in found}
    assert sum(by_bucket.values()) == len(values)
    assert (by_bucket[0], by_bucket[12], by_bucket[13], by_bucket[1], by_bucket[11]) == (1, 1, 1, 20, 1)


def test_limits_of_top_values_are_arguments(spark):
    df = spark.range(300).selectExpr("concat('v', id % 30) AS few", "concat('w', id % 150) AS many")
    usual = {r["column_name"]: tuple(r)[1:] for r in TableProfile(df).categorical_notes().collect()}
    assert usual["few"] == (30, False, None) and usual["many"][:2] == (150, True) and usual["many"][2]
    other = TableProfile(df, top=3, list_up_to=200, high_cardinality=20)
    notes = {r["column_name"]: tuple(r)[1:] for r in other.categorical_notes().collect()}
    assert notes == {"few": (30, True, None), "many": (150, True, None)}
    assert sorted(r["column_name"] for r in other.top_values().collect()) == ["few"] * 3 + ["many"] * 3
