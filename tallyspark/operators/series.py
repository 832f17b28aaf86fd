"""Period series: revenue per period, growth, trailing windows, differences.

A series has one row per calendar period, so a monthly series of any table is small. Lags and
trailing windows are read from the series held as one calendar map: the transactions behind it are
scanned and shuffled once, and gaps in the calendar are filled on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import period_start
from tallyspark.functions.safe import absolute_difference, ratio, signed_difference
from tallyspark.operators.roles import Ledger


def revenue_series(ledger: Ledger, granularity: str) -> DataFrame:
    """(period_start, revenue, n) per month, quarter or year with transactions."""
    return ledger.df.groupBy(period_start(F.col(ledger.date), granularity).alias("period_start")).agg(
        F.sum(ledger.amount).alias("revenue"), F.count(F.lit(1)).alias("n")
    )


def _calendar(series: DataFrame, value: str) -> DataFrame:
    """Every month from the first to the last of a monthly series, each with the whole series as a map.

    The map has twelve entries per year whatever the size of the table behind the series. Rows without a period
    (a NULL date) are in no month and left out.
    """
    dated = F.when(F.col("period_start").isNotNull(), F.struct("period_start", value))
    bounds = series.agg(
        F.map_from_entries(F.collect_list(dated)).alias("_series"),
        F.min("period_start").alias("_first"),
        F.max("period_start").alias("_last"),
    )
    months = F.sequence("_first", "_last", F.expr("INTERVAL 1 MONTH"))
    return bounds.filter(F.col("_first").isNotNull()).select(
        F.explode(months).alias("period_start"), "_series", "_first"
    )


def _earlier(months: int) -> Column:
    """The value some months before the row's period; a gap counts as zero."""
    return F.coalesce(F.try_element_at("_series", F.add_months("period_start", -months)), F.lit(0.0))


def with_lag(series: DataFrame, value: str, months: int) -> DataFrame:
    """(period_start, value, previous) over a gap-filled monthly calendar; gaps count as zero."""
    in_range = F.add_months("period_start", -months) >= F.col("_first")
    return _calendar(series, value).select(
        "period_start", _earlier(0).alias(value), F.when(in_range, _earlier(months)).alias("previous")
    )


def growth(series: DataFrame, value: str, months: int) -> DataFrame:
    """Relative change against the period ``months`` earlier; NULL where that is missing or zero."""
    change = ratio(F.col(value) - F.col("previous"), F.col("previous"))
    return with_lag(series, value, months).select("period_start", value, change.alias("growth"))


def trailing_sum(series: DataFrame, value: str, months: int) -> DataFrame:
    """(period_start, value, trailing): each month with the sum over it and the months before."""
    trailing = sum((_earlier(m) for m in range(1, months)), _earlier(0))
    return _calendar(series, value).select("period_start", _earlier(0).alias(value), trailing.alias("trailing"))


def period_difference(series: DataFrame, value: str, months: int = 1) -> DataFrame:
    """Signed and absolute difference to the previous period; equal values have no signed one."""
    lagged = with_lag(series, value, months).filter(F.col("previous").isNotNull())
    return lagged.select(
        "period_start",
        signed_difference(F.col("previous"), F.col(value)).alias("signed"),
        absolute_difference(F.col("previous"), F.col(value)).alias("absolute"),
    )


def seasonality(ledger: Ledger) -> DataFrame:
    """Revenue per month of the year and its share of all revenue."""
    months = ledger.df.groupBy(F.month(ledger.date).cast("long").alias("month_of_year")).agg(
        F.sum(ledger.amount).alias("revenue")
    )
    total = months.agg(F.sum("revenue")).scalar()
    return months.select("month_of_year", "revenue", ratio(F.col("revenue"), total).alias("share"))


def crosscheck(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Compare one total computed by two routes (each a one-row, one-column frame)."""
    a, b = F.col("route_a"), F.col("route_b")
    both = left.toDF("route_a").withColumn("route_b", right.scalar())
    relative = ratio(F.abs(a - b), F.abs(a))
    return both.withColumn("abs_diff", F.abs(a - b)).withColumn("ok", F.coalesce(relative <= tolerance, a == b))


def within_range(value: Column, low: float, high: float) -> Column:
    """Sanity flag for a rate: is it inside the expected range."""
    return F.coalesce(value.between(low, high), F.lit(False))
