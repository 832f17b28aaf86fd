"""Metrics over the periods of a calendar: every month, quarter or year of a span has a row, also when nothing happened in it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.dates import period_end
from tallyspark.operators.customers import active_by_period
from tallyspark.operators.roles import Ledger, Period, Statuses

# Months in a period.
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def ordinal(day: Column, granularity: str) -> Column:
    """Number of the period that holds a day, counted from year 0."""
    return F.floor((F.year(day) * 12 + F.month(day) - 1) / MONTHS[granularity]).cast("int")


def spine(spark: SparkSession, span: Period, granularity: str) -> DataFrame:
    """(period, period_start, period_end) of every period that the span touches; ``period`` is its ordinal."""
    months = MONTHS[granularity]
    first, last = ((d.year * 12 + d.month - 1) // months for d in map(date.fromisoformat, (span.start, span.end)))
    month = F.col("period") * months
    start = F.make_date(F.floor(month / 12).cast("int"), month % 12 + 1, F.lit(1))
    periods = spark.range(first, last + 1).select(F.col("id").cast("int").alias("period"))
    return periods.withColumn("period_start", start).withColumn("period_end", period_end(F.col("period_start"), granularity))


def period_metrics(statuses: Statuses, ledger: Ledger, span: Period, granularity: str) -> DataFrame:
    """Per period of the calendar: revenue, transactions, and customers active at its end and during it.

    Days become ordinals, so facts meet the calendar by equality, after they shrank to one row per period in every task.
    Transactions outside the span do not count; periods at its edges may be cut by it.
    """
    totals = ledger.within(span).groupBy(ordinal(F.col(ledger.date), granularity).alias("period")).agg(
        F.sum(ledger.amount).alias("revenue"), F.count(F.lit(1)).alias("transactions")
    )
    active = active_by_period(statuses, span, granularity).withColumn("period", ordinal(F.col("period_start"), granularity))
    whole = spine(ledger.df.sparkSession, span, granularity).join(totals, "period", "left").join(active.drop("period_start"), "period", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("revenue", "transactions", "active_end", "active_during")]
    return whole.select("period_start", "period_end", *zero)
