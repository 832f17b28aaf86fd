"""Cohorts by acquisition month: base table, payback, roll-ups and retention curves.

Activity is summed to one row per customer and month before anything else. From there on a
customer has at most one row per calendar month, so per-customer windows are small whatever the
share of the raw rows a customer holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.functions.dates import period_start
from tallyspark.functions.safe import ratio
from tallyspark.operators.roles import Ledger


def first_months(ledger: Ledger) -> DataFrame:
    """(customer, cohort_month): month of each customer's first transaction."""
    first = period_start(F.min(ledger.date), "month")
    return ledger.df.groupBy(F.col(ledger.customer).alias("customer")).agg(first.alias("cohort_month"))


def retention_curve(ledger: Ledger) -> DataFrame:
    """Revenue of each cohort by months since acquisition, relative to its first month."""
    monthly = ledger.df.groupBy(
        F.col(ledger.customer).alias("customer"), period_start(F.col(ledger.date), "month").alias("month")
    ).agg(F.sum(ledger.amount).alias("revenue"))
    cohort = monthly.withColumn("cohort_month", F.min("month").over(W.partitionBy("customer")))
    offset = F.months_between("month", "cohort_month").cast("long").alias("month_offset")
    curve = cohort.groupBy("cohort_month", offset).agg(F.sum("revenue").alias("revenue"))
    opening = F.first("revenue").over(W.partitionBy("cohort_month").orderBy("month_offset"))
    return curve.withColumn("retention", ratio(F.col("revenue"), opening))


def cohort_base(
    activity: DataFrame,
    customer: str,
    date: str,
    revenue: str,
    cost: str,
    acquired: DataFrame | None = None,
    initial_type: str | None = None,
) -> DataFrame:
    """Per cohort and month: customers, revenue, cost, gross profit and its running total.

    The cohort is the month of the first activity, or ``acquired(customer, cohort_month)`` when that
    is known from elsewhere. With ``initial_type`` cohorts are split further by the value of that
    column at the customer's first activity.
    """
    aggs = [F.sum(revenue).alias("revenue"), F.sum(cost).alias("cost")]
    if initial_type:
        aggs.append(F.min(F.struct(F.col(date).alias("d"), F.col(initial_type).alias("t"))).alias("_first"))
    monthly = activity.groupBy(
        F.col(customer).alias("customer"), period_start(F.col(date), "month").alias("month")
    ).agg(*aggs)
    per_customer = W.partitionBy("customer")
    keys = ["cohort_month"]
    if initial_type:
        monthly = monthly.withColumn("initial_type", F.min("_first").over(per_customer)["t"])
        keys.append("initial_type")
    if acquired is None:
        monthly = monthly.withColumn("cohort_month", F.min("month").over(per_customer))
    else:
        monthly = monthly.join(acquired, "customer")
    base = monthly.groupBy(*keys, "month").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost")
    )
    base = base.withColumn("gross_profit", F.col("revenue") - F.col("cost"))
    running = W.partitionBy(*keys).orderBy("month").rowsBetween(W.unboundedPreceding, W.currentRow)
    return base.withColumn("cumulative_gross_profit", F.sum("gross_profit").over(running))


def cohort_payback(base: DataFrame, spend: DataFrame) -> DataFrame:
    """Mark each cohort month as paid back once cumulative gross profit reaches ``spend``."""
    status = F.when(F.col("cumulative_gross_profit") < F.col("spend"), "Not Paid Back").otherwise("Paid Back")
    return base.join(spend, "cohort_month").withColumn("payback_status", status)


def cohort_annual(base: DataFrame) -> DataFrame:
    """Base table by calendar year, with the running gross profit reached at year end."""
    return base.groupBy("cohort_month", F.year("month").cast("long").alias("year")).agg(
        F.sum("revenue").alias("revenue"),
        F.sum("cost").alias("cost"),
        F.sum("gross_profit").alias("gross_profit"),
        F.max_by("cumulative_gross_profit", "month").alias("cumulative_gross_profit"),
    )


def cohort_summary(payback: DataFrame) -> DataFrame:
    """One row per cohort: totals, first month paid back and months it took."""
    paid = F.min(F.when(F.col("payback_status") == "Paid Back", F.col("month")))
    return (
        payback.groupBy("cohort_month")
        .agg(
            F.sum("revenue").alias("revenue"),
            F.sum("gross_profit").alias("gross_profit"),
            F.max("spend").alias("spend"),
            paid.alias("first_paid_month"),
        )
        .withColumn("months_to_payback", F.months_between("first_paid_month", "cohort_month").cast("long"))
    )
