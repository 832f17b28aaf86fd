from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.dates import parse_date, DATE_FORMATS, parse_timestamp, period_calendar, resolve_date_references
from tallyspark.operators import date_formats
from tallyspark.operators.profile import TableProfile

SAMPLES = [
    "2023-01-15",
    "01/15/2023",
    "15/01/2023",
    "2023/01/15",
    "01-15-2023",
    "15-01-2023",
    "2023.01.15",
    "01.15.2023",
    "15.01.2023",
    "20230115",
    "01/15/23",
    "15/01/23",
    "23-01-15",
    "January 15, 2023",
    "15 January 2023",
    "Jan 15, 2023",
    "15 Jan 2023",
    "2023-01-15 14:30:00",
    "01/15/2023 14:30:00",
    "2023-01-15T14:30:00",
    "2023-01-15T14:30:00Z",
    "1/5/2023",
    "JAN 5, 2023",
    "may 5, 2023",
    "5  May   2023",
    "12/31/85",
    "12/31/68",
    "12/31/69",
    "03/04/2023",
    "202311",
    "2023115",
    "2023-02-29",
    "2024-02-29",
    "2023-1-5",
    "13/13/2023",
    " 2023-01-15 ",
    "",
    "not a date",
    "02023-01-15",
    "2023-01-15 24:00:00",
    "2023-01-15 1:2:3",
]


def _strptime(text: str, fmt: str) -> dt.datetime | None:
    try:
        return dt.datetime.strptime(text.strip(), fmt)
    except ValueError:
        return None


def test_formats_read_what_strptime_reads(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "v string")
    found = df.select("v", *[parse_timestamp(F.col("v"), f).cast("timestamp_ntz").alias(f) for f, _ in DATE_FORMATS])
    for row in found.collect():
        for fmt, _ in DATE_FORMATS:
            assert row[fmt] == _strptime(row["v"], fmt), (row["v"], fmt)


@pytest.mark.parametrize("fmt, expected", [(f, f) for f, _ in DATE_FORMATS])
def test_detects_each_format(spark, fmt, expected):
    days = [dt.datetime(2023, m, d, 14, 30) for m in (1, 3, 5, 8, 11) for d in (13, 17, 25, 28)]
    # A name such as "May" reads the same in long and short form, so the earlier long form wins a tie.
    df = spark.createDataFrame([(day.strftime(fmt),) for day in days], "v string")
    found = date_formats.detect_formats(df, ["v"]).first()
    assert (found["date_format"], found["success_rate"]) == (expected, 1.0)


def test_ambiguous_days_are_month_first(spark):
    df = spark.createDataFrame([("03/04/2023",), ("05/06/2023",)], "v string")
    assert date_formats.detect_formats(df, ["v"]).first()["date_format"] == "%m/%d/%Y"


def test_report_covers_all_rows_and_undecided_columns(spark):
    good = [(f"2023-01-{d:02d}", "junk") for d in range(1, 21)] * 3
    df = spark.createDataFrame([*good, ("", "junk"), (None, None)], "good string, bad string")
    found = {r["column_name"]: r for r in date_formats.format_report(df, ["good", "bad"]).collect()}
    assert found["good"]["successful_parse_count"] == 60 and found["good"]["total_count"] == 61
    assert (found["good"]["min_date"], found["good"]["max_date"]) == (dt.date(2023, 1, 1), dt.date(2023, 1, 20))
    assert len(found["good"]["sample_parsed_dates"]) == 5 and found["good"]["error"] is None
    assert found["bad"]["date_format"] is None and found["bad"]["error"] == "No suitable date format found"


def test_strict_fallback_needs_every_row(spark):
    df = spark.createDataFrame([("1.2.2023", "1.2.2023"), ("3.4.2023", "x")], "all string, some string")
    assert [r["column_name"] for r in date_formats.detect_formats_strict(df, ["all", "some"]).collect()] == ["all"]


def test_formats_are_decided_over_all_rows(spark):
    """Most days are at most 12; the few others tell day-first from month-first."""
    df = spark.range(3000).selectExpr("date_format(date_add(date'2023-01-01', int(if(id % 100 = 7, 24, id % 12))), 'dd/MM/yyyy') AS v")
    assert date_formats.detect_formats(df, ["v"]).first()["date_format"] == "%d/%m/%Y"
    assert df.select(date_formats.date_cast(df, "v").alias("d")).filter("d IS NULL").count() == 0


@pytest.mark.parametrize("fmt", [f for f, _ in DATE_FORMATS])
def test_days_and_clocks_read_like_whole_texts(spark, fmt):
    """Cut into day and clock time, every text is read by the same formats as in one piece."""
    odd = ["2023-01-05 10:00:00Z", "2023-01-05T10:00:00", "2023-01-05T10:00:00Z", "\t2023-01-05  24:00:00", "2023-1-5 23:59:60", " 2023-01-05 ", "Sep\u00a05, 2023",
           "2023-01/05", "1/2/2023 1:2:3", "T:", ":", "5 Tue 2023", "30 September 2023", " September  30,\n2023 ", "x" * 500, "2023-01-05T1:2", "20230105 10:00:00", "2023-02-30", ""]
    df = spark.createDataFrame([(s,) for s in [*SAMPLES, *odd]], "v string")
    whole = df.select(parse_date(F.col("v"), fmt).alias("d")).filter("d IS NOT NULL").groupBy("d").count()
    parts = date_formats.day_counts(df, ["v"]).select(date_formats.read_day(fmt).alias("d"), "n").filter("d IS NOT NULL").groupBy("d").agg(F.sum("n"))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    assert date_formats.day_counts(df, ["v"]).agg(F.sum("n")).first()[0] == df.filter("v IS NOT NULL").count()


def test_equal_days_are_parsed_once_and_texts_stay(spark):
    df = spark.range(20_000).selectExpr("date_format(date_add(date'2023-01-01', int(id % 40)), 'dd/MM/yyyy') AS v", "concat('some long text ', id) AS t")
    counts = date_formats.day_counts(df, ["v", "t"]).collect()
    assert len(counts) == 41 and sum(r["n"] for r in counts) == 40_000


def test_date_cast(spark):
    df = spark.createDataFrame([("15.01.2023", "x"), ("16.01.2023", "2023-01-05")], "d string, j string")
    casted = df.select(date_formats.date_cast(df, "d"), date_formats.date_cast(df, "j")).collect()
    assert [tuple(r) for r in casted] == [(dt.date(2023, 1, 15), None), (dt.date(2023, 1, 16), dt.date(2023, 1, 5))]


def test_profile_formats_only_datetime_columns(spark):
    df = spark.createDataFrame([("2023-01-05", "5 Jan 2023", 1)], "iso string, name string, n int")
    found = date_formats.profile_date_formats(TableProfile(df)).collect()
    assert [(r["column_name"], r["recommended_cast"]) for r in found] == [("iso", "to_timestamp(`iso`, 'yyyy-M-d')")]


D = dt.date


@pytest.mark.parametrize(
    "ref, start, end, kind",
    [
        ("Jan 2023", D(2023, 1, 1), D(2023, 1, 31), "full_month_period"),
        (" february  2024 ", D(2024, 2, 1), D(2024, 2, 29), "full_month_period"),
        ("MAY 2023", D(2023, 5, 1), D(2023, 5, 31), "full_month_period"),
        ("Q1 2023", D(2023, 1, 1), D(2023, 3, 31), "full_quarter_period"),
        ("q4 2024", D(2024, 10, 1), D(2024, 12, 31), "full_quarter_period"),
        ("Q5 2024", None, None, "unparsed"),
        ("2023", D(2023, 1, 1), D(2023, 12, 31), "full_year_period"),
        ("as of Jan 2023", D(2023, 1, 31), D(2023, 1, 31), "point_in_time_end"),
        ("End of Q3 2024", D(2024, 9, 30), D(2024, 9, 30), "point_in_time_end"),
        ("as of end of 2024", D(2024, 12, 31), D(2024, 12, 31), "point_in_time_end"),
        ("beginning of Jan 2023", D(2023, 1, 1), D(2023, 1, 1), "point_in_time_start"),
        ("as of beginning of Jan 2023", D(2023, 1, 1), D(2023, 1, 1), "point_in_time_end"),
        ("beginning of end of Jan 2023", D(2023, 1, 31), D(2023, 1, 31), "point_in_time_start"),
        ("April 7th 2025", D(2025, 4, 7), D(2025, 4, 7), "single_day"),
        ("Feb 30 2025", None, None, "unparsed"),
        ("April 7th", None, None, "unparsed"),
        ("last week", None, None, "unparsed"),
        ("as of last week", None, None, "unparsed"),
        ("", None, None, "unparsed"),
    ],
)
def test_date_references(spark, ref, start, end, kind):
    df = spark.createDataFrame([(ref,)], "ref string")
    found = resolve_date_references(df, "ref").first()
    assert (found["start_date"], found["end_date"], found["interpretation_type"]) == (start, end, kind)
    assert (found["warning"] is not None) == (kind == "unparsed")


@pytest.mark.parametrize(
    "granularity, expected",
    [
        ("month", [(D(2023, 11, 1), D(2023, 11, 30)), (D(2023, 12, 1), D(2023, 12, 31)), (D(2024, 1, 1), D(2024, 1, 31))]),
        ("quarter", [(D(2023, 10, 1), D(2023, 12, 31)), (D(2024, 1, 1), D(2024, 3, 31))]),
        ("year", [(D(2023, 1, 1), D(2023, 12, 31)), (D(2024, 1, 1), D(2024, 12, 31))]),
    ],
)
def test_calendar(spark, granularity, expected):
    bounds = spark.createDataFrame([(D(2023, 11, 15), D(2024, 1, 2))], "a date, b date")
    found = period_calendar(bounds, "a", "b", granularity).orderBy("period_start").collect()
    assert [tuple(r) for r in found] == expected
