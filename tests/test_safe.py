from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import safe

MIXED = ["x1", "7", "1d", "1_000", "NaN", "inf", "", None, " -2.5e3 ", "+.5", "5.", "N", "i"]


def test_text_as_number(spark):
    df = spark.createDataFrame([(v,) for v in MIXED], "v string")
    found = [r[0] for r in df.select(safe.as_number(F.col("v"), T.StringType())).collect()]
    expected = [None, 7.0, None, None, math.nan, math.inf, None, None, -2500.0, 0.5, 5.0, None, None]
    assert [str(x) for x in found] == [str(x) for x in expected]


@pytest.mark.parametrize(
    "text, day",
    [
        ("2020-01-31", dt.date(2020, 1, 31)),
        ("2020/1/5", dt.date(2020, 1, 5)),
        ("2020 01 05", dt.date(2020, 1, 5)),
        (" 2020-01-05 10:30:00", dt.date(2020, 1, 5)),
        ("2020", None),
        ("2020-01", None),
        ("2020-01/05", None),
        ("2020-13-05", None),
        ("2020-01-05x", None),
        ("", None),
    ],
)
def test_text_as_date(spark, text, day):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(safe.as_date(F.col("v"), T.StringType())).first()[0] == day


def test_types_choose_the_cast(spark):
    df = spark.sql("SELECT true AS b, 3 AS i, DATE'2020-01-02' AS d, array(1) AS a")
    numbers = [safe.as_number(F.col(f.name), f.dataType) for f in df.schema.fields]
    days = [safe.as_date(F.col(f.name), f.dataType) for f in df.schema.fields]
    assert tuple(df.select(*numbers).first()) == (1.0, 3.0, None, None)
    assert tuple(df.select(*days).first()) == (None, None, dt.date(2020, 1, 2), None)


def test_division_and_rounding(spark):
    df = spark.sql("SELECT 1 AS one, 0 AS zero, CAST(NULL AS INT) AS nothing")
    one, zero, nothing = F.col("one"), F.col("zero"), F.col("nothing")
    found = df.select(
        safe.ratio(one, zero), safe.ratio_or_zero(one, zero), safe.ratio(nothing, one), safe.ratio(one, one)
    ).first()
    assert tuple(found) == (None, 0.0, None, 1.0)
    values = spark.createDataFrame([(1.005,), (2.345,), (0.125,), (-0.125,)], "v double")
    assert [r[0] for r in values.select(safe.money("v")).collect()] == [1.0, 2.35, 0.13, -0.13]


def test_guarded_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", None), ("c", 3.0)], "k string, v double")
    found = df.groupBy("k").agg(safe.guarded_sum(F.col("v")), safe.guarded_mean(F.col("v"))).orderBy("k").collect()
    assert [tuple(r) for r in found] == [("a", 3.0, 1.5), ("b", None, None), ("c", None, None)]
    arrays = spark.sql("SELECT array(1.0D, 2.0D) AS v UNION ALL SELECT array(4.0D)")
    found = arrays.select(safe.guarded_array_sum(F.col("v")), safe.guarded_array_mean(F.col("v"))).collect()
    assert [tuple(r) for r in found] == [(3.0, 1.5), (None, None)]


def test_differences(spark):
    df = spark.createDataFrame([(1.0, 4.0), (4.0, 1.0), (2.0, 2.0)], "a double, b double")
    found = df.select(
        safe.signed_difference(F.col("a"), F.col("b")), safe.absolute_difference(F.col("a"), F.col("b"))
    ).collect()
    assert [tuple(r) for r in found] == [(3.0, 3.0), (-3.0, 3.0), (None, 0.0)]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2)], ["a.b", "c`d e"])
    assert tuple(df.select(safe.column("a.b"), safe.column("c`d e")).first()) == (1, 2)
