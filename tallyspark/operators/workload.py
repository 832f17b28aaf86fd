"""Worked hours from sessions that may overlap, against the hours of a calendar."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.safe import ratio
from tallyspark.operators.roles import Period

# Working hours from Monday to Sunday.
WORKING_HOURS = (8, 8, 8, 8, 8, 0, 0)
_HOUR, _DAY = 3600, 86_400


def _second(moment: Column) -> Column:
    """Whole seconds since 1970 on the clock of the column, whatever its time zone."""
    days = F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * _DAY + F.hour(moment) * _HOUR + F.minute(moment) * 60 + F.second(moment)


def worked_seconds(sessions: DataFrame, worker: str, start: str, end: str) -> DataFrame:
    """(worker, day, seconds) that the sessions of a worker cover; what several cover counts once.

    Sessions are cut at full hours, and of those of a worker that begin in the same second the longest stays. So at most
    3,600 rows of a worker and an hour are ordered together, whoever has most of the rows. Sessions that end before they begin are left out.
    """
    cut = sessions.select(F.col(worker).alias("worker"), _second(F.col(start)).alias("a"), _second(F.col(end)).alias("b")).filter("b > a")
    hours = F.sequence(F.floor(F.col("a") / _HOUR), F.floor((F.col("b") - 1) / _HOUR))
    pieces = cut.select("worker", "a", "b", F.explode(hours).alias("hour")).select(
        "worker", "hour", F.greatest("a", F.col("hour") * _HOUR).alias("a"), F.least("b", (F.col("hour") + 1) * _HOUR).alias("b")
    )
    longest = pieces.groupBy("worker", "hour", "a").agg(F.max("b").alias("b"))
    before = W.partitionBy("worker", "hour").orderBy("a").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(before), F.lit(0).cast("long"))), F.lit(0))
    covered = longest.select("worker", "hour", fresh.alias("seconds"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("hour") / 24).cast("int"))
    return covered.groupBy("worker", day.alias("day")).agg(F.sum("seconds").alias("seconds"))


def capacity_hours(period: Period, hours: tuple[float, ...] = WORKING_HOURS) -> float:
    """Working hours of a period, by weekday."""
    first, last = date.fromisoformat(period.start), date.fromisoformat(period.end)
    weeks, rest = divmod((last - first).days + 1, 7)
    return weeks * sum(hours) + sum(hours[(first + timedelta(days=d)).weekday()] for d in range(rest))


def utilization_hours(
    sessions: DataFrame, worker: str, start: str, end: str, period: Period, billable: Column, hours: tuple[float, ...] = WORKING_HOURS
) -> DataFrame:
    """Per worker with sessions in the period: worked and billable hours, capacity, utilization (billable over capacity)
    and realization (billable over worked)."""
    capacity = F.lit(float(capacity_hours(period, hours)))
    kept = sessions.withColumn("_billable", F.coalesce(billable, F.lit(False)))
    # a worker's billable sessions are merged by themselves: one that is not may cover the same time
    both = kept.select(F.struct(F.col(worker).alias("worker"), F.lit(False).alias("billable")).alias("of"), start, end).unionByName(
        kept.filter("_billable").select(F.struct(F.col(worker).alias("worker"), F.lit(True).alias("billable")).alias("of"), start, end)
    )
    days = worked_seconds(both, "of", start, end).filter(period.holds(F.col("day")))
    sums = days.groupBy(F.col("worker.worker").alias("worker")).agg(
        (F.sum(F.when(~F.col("worker.billable"), F.col("seconds"))) / _HOUR).alias("worked_hours"),
        (F.coalesce(F.sum(F.when(F.col("worker.billable"), F.col("seconds"))), F.lit(0)) / _HOUR).alias("billable_hours"),
    )
    return sums.select(
        "worker", "worked_hours", "billable_hours", capacity.alias("capacity_hours"),
        ratio(F.col("billable_hours"), capacity).alias("utilization"), ratio(F.col("billable_hours"), F.col("worked_hours")).alias("realization"),
    )
