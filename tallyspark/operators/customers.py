"""Active customers, revenue per customer, recurring revenue and churn."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.safe import ratio
from tallyspark.operators.roles import Ledger, Period, Statuses

_BITS = 62  # periods per word of the activity bitmap


def active_as_of(statuses: Statuses, day: str, *keep: str) -> DataFrame:
    """Distinct customers active on a day; a customer whose record ends that day is not."""
    on_day = statuses.active_as_of(F.lit(day).cast("date"))
    return statuses.df.filter(on_day).select(F.col(statuses.customer).alias("customer"), *keep).distinct()


def active_during(statuses: Statuses, period: Period, *keep: str) -> DataFrame:
    """Distinct customers whose record overlaps the period."""
    overlaps = statuses.active_during(period)
    return statuses.df.filter(overlaps).select(F.col(statuses.customer).alias("customer"), *keep).distinct()


def _period_index(day: Column, granularity: str) -> Column:
    months = F.year(day) * 12 + F.month(day) - 1
    return F.floor(months / {"month": 1, "quarter": 3, "year": 12}[granularity]).cast("int")


def _bits(low: Column, high: Column, word: int) -> Column:
    """Bits low..high of a bitmap, as far as they fall into the given word."""
    low = F.greatest(low - word * _BITS, F.lit(0))
    high = F.least(high - word * _BITS, F.lit(_BITS - 1))
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), high - low + 1) - 1
    return F.when(low <= high, F.call_function("shiftleft", ones, low)).otherwise(F.lit(0).cast("long"))


def active_by_period(statuses: Statuses, span: Period, granularity: str = "month") -> DataFrame:
    """Customers active at the end of, and during, each period that a span touches.

    Overlapping records of a customer are merged as an activity bitmap with one bit per period:
    the shuffle carries one small row per customer and task however many records or periods there
    are, and the per-period count needs no second wide shuffle.
    """
    months = {"month": 1, "quarter": 3, "year": 12}[granularity]
    first, last = date.fromisoformat(span.start), date.fromisoformat(span.end)
    base = (first.year * 12 + first.month - 1) // months
    count = (last.year * 12 + last.month - 1) // months - base + 1
    words = range((count + _BITS - 1) // _BITS)

    start, end = F.col(statuses.start), F.col(statuses.end)
    begin = F.greatest(_period_index(start, granularity) - base, F.lit(0))
    until = F.coalesce(_period_index(end, granularity) - base, F.lit(count))
    # A record is no longer active at the end of the period its end date falls in.
    upto = F.when(end.isNull(), F.lit(count - 1)).otherwise(F.least(until - 1, F.lit(count - 1)))
    touched = F.least(until, F.lit(count - 1))
    opening = F.lit(f"{base * months // 12:04d}-{base * months % 12 + 1:02d}-01").cast("date")
    closing = F.last_day(F.add_months(opening, count * months - 1))
    relevant = (start <= closing) & (end.isNull() | (end >= opening))
    bitmaps = (
        statuses.df.filter(relevant)
        .select(
            F.col(statuses.customer).alias("customer"),
            *[_bits(begin, touched, w).alias(f"_during{w}") for w in words],
            *[_bits(begin, upto, w).alias(f"_end{w}") for w in words],
        )
        .groupBy("customer")
        .agg(*[F.bit_or(f"_{m}{w}").alias(f"_{m}{w}") for m in ("during", "end") for w in words])
    )

    def bit(name: str) -> Column:
        word = F.get(F.array(*[F.col(f"_{name}{w}") for w in words]), F.floor(F.col("i") / _BITS).cast("int"))
        return F.call_function("shiftright", word, F.col("i") % _BITS).bitwiseAND(F.lit(1).cast("long"))

    exploded = bitmaps.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    counts = exploded.groupBy("i").agg(
        F.sum(bit("end")).alias("active_end"), F.sum(bit("during")).alias("active_during")
    )
    starts = F.add_months(opening, F.col("i") * months)
    return counts.select(starts.alias("period_start"), "active_end", "active_during")


def arpu_active(statuses: Statuses, ledger: Ledger, period: Period, segments: DataFrame) -> DataFrame:
    """Average revenue per customer active during a period, by segment (``customer``, ``segment``: one row a customer).

    Customers without revenue count in the denominator, those without a segment are left out. All inputs shrink to one
    row per customer before they meet, so a customer holding a large share of all records does not skew a join.
    """
    active = active_during(statuses, period).join(segments.select("customer", "segment"), "customer")
    revenue = ledger.revenue_by_customer(period)
    joined = active.join(revenue, "customer", "left")
    total = F.coalesce(F.sum("revenue"), F.lit(0))
    return joined.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        total.alias("revenue"),
        ratio(total, F.count(F.lit(1))).alias("arpu"),
    )


def recurring_revenue(statuses: Statuses, ledger: Ledger, period: Period) -> DataFrame:
    """Active customers at the end of the period, their ARPU in it, and the product of both.

    With a month this is MRR, with a year ARR: the annual figure uses the year's own revenue.
    """
    active = active_as_of(statuses, period.end)
    revenue = ledger.revenue_by_customer(period)
    customers = F.count(F.lit(1))
    total = F.coalesce(F.sum("revenue"), F.lit(0))
    return (
        active.join(revenue, "customer", "left")
        .agg(customers.alias("active_customers"), ratio(total, customers).alias("arpu"))
        .withColumn("recurring_revenue", F.col("active_customers") * F.col("arpu"))
    )


def active_without_revenue(statuses: Statuses, ledger: Ledger, period: Period) -> DataFrame:
    """Customers active during a period without a transaction in it."""
    paying = ledger.within(period).select(F.col(ledger.customer).alias("customer")).distinct()
    return active_during(statuses, period).join(paying, "customer", "left_anti")


def churn_simple(statuses: Statuses, period: Period, *by: str, segments: DataFrame | None = None) -> DataFrame:
    """Customers of the opening cohort with any record ending in the period, over that cohort.

    A customer who was not active at the period start never counts. One row of flags per customer; these are joined with
    ``segments`` (``customer``, ``segment``), if given, and counted by segment.
    """
    end = F.col(statuses.end)
    opening = statuses.active_as_of(period.first)
    # Without groups only these records matter; with groups one without a cohort keeps its row.
    records = statuses.df if by or segments is not None else statuses.df.filter(opening | period.holds(end))
    flags = records.groupBy(F.col(statuses.customer).alias("customer"), *by).agg(
        F.bool_or(opening).alias("opening"), F.bool_or(period.holds(end)).alias("ended")
    )
    if segments is not None:
        flags, by = flags.join(segments.select("customer", "segment"), "customer"), (*by, "segment")
    cohort = F.count_if(F.col("opening"))
    churned = F.count_if(F.col("opening") & F.col("ended"))
    return flags.groupBy(*by).agg(
        cohort.alias("start_customers"),
        churned.alias("churned_customers"),
        ratio(churned, cohort).alias("churn_rate"),
    )


def churn_latest(statuses: Statuses, period: Period, matching: Column) -> DataFrame:
    """Churn judged by the latest record of each customer.

    The cohort holds customers with a matching record active at the period start. The latest record
    is the one with the last start over all records of the customer; ties count once per record.
    A cohort customer has churned when that record ended before the period end.

    Records first collapse to one row per customer and start day, then to one per customer, so no
    customer's history is gathered in one place. ``record_level_rate`` counts records instead of
    customers and is there only for comparison.
    """
    end = F.col(statuses.end)
    opening = matching & statuses.active_as_of(period.first)
    over = end.isNotNull() & (end < period.last)
    days = statuses.df.groupBy(
        F.col(statuses.customer).alias("customer"), F.col(statuses.start).alias("_start")
    ).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(over).alias("_over"),
        F.count_if(opening).alias("_open_records"),
        F.count_if(opening & over).alias("_open_over"),
    )
    customers = days.groupBy("customer").agg(
        F.max(F.struct("_start", "_rows", "_over")).alias("_latest"),
        F.sum("_open_records").alias("_open_records"),
        F.sum("_open_over").alias("_open_over"),
    )
    cohort = customers.filter(F.col("_open_records") > 0)
    rows, churned = F.sum("_latest._rows"), F.sum("_latest._over")
    return cohort.agg(
        F.coalesce(rows, F.lit(0).cast("long")).alias("cohort_rows"),
        F.count(F.lit(1)).alias("cohort_customers"),
        F.coalesce(churned, F.lit(0).cast("long")).alias("churned"),
        ratio(churned, rows).alias("churn_rate"),
        ratio(F.sum("_open_over"), F.sum("_open_records")).alias("record_level_rate"),
    )


def revenue_retention(
    statuses: Statuses, ledger: Ledger, cohort: Column, baseline: Period, future: Period
) -> DataFrame:
    """Future over baseline revenue of customers whose matching record starts in the baseline period."""
    joined_in = cohort & baseline.holds(F.col(statuses.start))
    members = statuses.df.filter(joined_in).select(F.col(statuses.customer).alias("customer")).distinct()
    day, amount = F.col(ledger.date), F.col(ledger.amount)
    either = baseline.holds(day) | future.holds(day)
    spent = (
        ledger.df.filter(either)
        .groupBy(F.col(ledger.customer).alias("customer"))
        .agg(
            F.sum(F.when(baseline.holds(day), amount)).alias("_before"),
            F.sum(F.when(future.holds(day), amount)).alias("_after"),
        )
    )
    before, after = F.sum("_before"), F.sum("_after")
    return spent.join(members, "customer", "left_semi").agg(
        before.alias("initial_revenue"), after.alias("future_revenue"), ratio(after, before).alias("revenue_retention")
    )


def acquisition_cost(
    spend: DataFrame, spend_date: str, spend_amount: str, firsts: DataFrame, customer: str, first_date: str, period: Period
) -> DataFrame:
    """Spend in a period over customers whose first event falls in it."""
    spent = spend.filter(period.holds(F.col(spend_date))).agg(F.sum(spend_amount).alias("spend"))
    # A customer with an event before the period cannot be new in it; later events do not matter.
    seen = firsts.filter(F.col(first_date) <= period.last).groupBy(customer).agg(F.min(first_date).alias("_first"))
    new = seen.agg(F.count_if(F.col("_first") >= period.first))
    return spent.withColumn("new_customers", new.scalar()).withColumn(
        "cac", ratio(F.col("spend"), F.col("new_customers"))
    )


def predicted_lifetime_value(statuses: Statuses, ledger: Ledger, period: Period, segments: DataFrame) -> DataFrame:
    """ARPU of customers active in the period over their churn rate in it, by segment (``customer``, ``segment``)."""
    arpu = arpu_active(statuses, ledger, period, segments).select("segment", "arpu")
    churn = churn_simple(statuses, period, segments=segments).select("segment", "churn_rate")
    return arpu.join(churn, "segment").withColumn("ltv", ratio(F.col("arpu"), F.col("churn_rate")))
