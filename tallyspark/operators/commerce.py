"""Transaction, marketplace, pipeline, contract and service metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import horizon_periods, period_start
from tallyspark.functions.safe import ratio
from tallyspark.operators.roles import Ledger, Period
from tallyspark.operators.series import revenue_series


def period_revenue(ledger: Ledger, period: Period) -> DataFrame:
    """Revenue and number of transactions of a period, both ends included."""
    return ledger.within(period).agg(
        F.concat_ws("..", F.lit(period.start), F.lit(period.end)).alias("period"),
        F.coalesce(F.sum(ledger.amount), F.lit(0.0)).alias("revenue"),
        F.count(F.lit(1)).alias("n"),
    )


def headline_facts(ledger: Ledger) -> DataFrame:
    """Total revenue, distinct customers and average amount."""
    return ledger.df.agg(
        F.sum(ledger.amount).alias("total_revenue"),
        F.count_distinct(ledger.customer).alias("customer_count"),
        F.avg(ledger.amount).alias("avg_amount"),
    )


def status_flag(value: Column) -> Column:
    """Active when there is anything positive to show."""
    return F.when(value > 0, "Active").otherwise("Inactive")


def average_order_value(ledger: Ledger, customers: DataFrame, customer: str, segment: str) -> DataFrame:
    """Orders, revenue and revenue per order by customer segment."""
    per_customer = ledger.df.groupBy(F.col(ledger.customer).alias(customer)).agg(
        F.sum(ledger.amount).alias("_r"), F.count(F.lit(1)).alias("_n")
    )
    joined = per_customer.join(customers.select(customer, segment), customer)
    return joined.groupBy(F.col(segment).alias("segment")).agg(
        F.sum("_n").alias("orders"), F.sum("_r").alias("revenue"), ratio(F.sum("_r"), F.sum("_n")).alias("aov")
    )


def repeat_purchase_rate(ledger: Ledger) -> DataFrame:
    """Share of customers with more than one transaction."""
    orders = ledger.df.groupBy(ledger.customer).agg(F.count(F.lit(1)).alias("_n"))
    customers, repeaters = F.count(F.lit(1)), F.count_if(F.col("_n") > 1)
    return orders.agg(
        customers.alias("customers"), repeaters.alias("repeaters"), ratio(repeaters, customers).alias("repeat_rate")
    )


def purchase_gap(ledger: Ledger) -> DataFrame:
    """Orders and average days between consecutive orders of customers with at least two.

    The gaps of a customer add up to last minus first day, so no per-customer ordering is needed.
    """
    span = ledger.df.groupBy(F.col(ledger.customer).alias("customer")).agg(
        F.count(F.lit(1)).alias("orders"), F.datediff(F.max(ledger.date), F.min(ledger.date)).alias("_days")
    )
    return span.filter(F.col("orders") > 1).select(
        "customer", "orders", ratio(F.col("_days"), F.col("orders") - 1).alias("avg_gap_days")
    )


def horizon_value(ledger: Ledger, years: int) -> DataFrame:
    """Average revenue per period carried over a horizon, at each granularity.

    The multiplier always matches the granularity of the base value: years, quarters or months. Money is added as
    decimals, so the result does not depend on the order of the rows; it is divided once.
    """
    month = period_start(F.col(ledger.date), "month").alias("period_start")
    monthly = ledger.df.groupBy(month).agg(F.sum(F.col(ledger.amount).cast("decimal(28,6)")).alias("revenue"))
    spread = [
        F.struct(F.lit(g).alias("granularity"), period_start(F.col("period_start"), g).alias("period"))
        for g in ("year", "quarter", "month")
    ]
    sums = monthly.select("revenue", F.inline(F.array(*spread))).groupBy("granularity", "period")
    base = sums.agg(F.sum("revenue").alias("revenue")).groupBy("granularity").agg(
        (F.sum("revenue").cast("double") / F.count("revenue")).alias("base_value")
    )
    periods = horizon_periods(F.col("granularity"), years).cast("long")
    return base.withColumn("periods", periods).withColumn("value", F.col("base_value") * F.col("periods"))


def marketplace_metrics(sales: DataFrame, party: str, order: str, gmv: Column, commission: Column) -> DataFrame:
    """GMV, commission and distinct orders of each seller or buyer."""
    return sales.groupBy(party).agg(
        F.sum(gmv).alias("gmv"), F.sum(commission).alias("commission"), F.count_distinct(order).alias("orders")
    )


def commission_rate(sales: DataFrame, gmv: Column, commission: Column) -> DataFrame:
    """Commission over GMV of the whole marketplace."""
    total, fee = F.sum(gmv), F.sum(commission)
    return sales.agg(total.alias("gmv"), fee.alias("commission"), ratio(fee, total).alias("rate"))


def pipeline_by_stage(deals: DataFrame, stage: str, value: str) -> DataFrame:
    """Deals and their value per stage."""
    return deals.groupBy(F.col(stage).alias("stage")).agg(F.count(F.lit(1)).alias("deals"), F.sum(value).alias("value"))


def sales_cycle(
    deals: DataFrame, deal: str, opened: str, stage: str, deliveries: DataFrame, delivery_deal: str, delivered: str
) -> DataFrame:
    """Average days from opening a deal to its first delivery on or after that day, per stage.

    A deal's delivery days form a set no larger than the calendar, so deliveries collapse to one
    row per deal before the join.
    """
    days = deliveries.groupBy(F.col(delivery_deal).alias(deal)).agg(F.collect_set(delivered).alias("_days"))
    later = F.array_min(F.filter("_days", lambda d: d >= F.col(opened)))
    timed = deals.select(deal, opened, stage).join(days, deal).withColumn("_cycle", F.datediff(later, F.col(opened)))
    return (
        timed.filter(F.col("_cycle").isNotNull())
        .groupBy(F.col(stage).alias("stage"))
        .agg(F.count(F.lit(1)).alias("deals"), F.avg("_cycle").alias("avg_days"))
    )


def revenue_recognition(contracts: DataFrame, value: str, start: str, end: str) -> DataFrame:
    """Contract value recognised per month by the share of contract days falling in it.

    Both ends count. The monthly rows of a contract are summed inside the task that made them.
    """
    first, last = F.col(start), F.col(end)
    closed = contracts.filter(last.isNotNull() & (last >= first))
    months = F.sequence(period_start(first, "month"), period_start(last, "month"), F.expr("INTERVAL 1 MONTH"))
    rows = closed.select(value, start, end, F.explode(months).alias("month"))
    overlap = F.datediff(F.least(last, F.last_day("month")), F.greatest(first, F.col("month"))) + 1
    share = F.col(value) * overlap / (F.datediff(last, first) + 1)
    return rows.groupBy("month").agg(F.sum(share).alias("recognized"))


def profitability(work: DataFrame, by: str, revenue: Column, cost: Column) -> DataFrame:
    """Revenue, cost, profit and margin per project, product or brand."""
    totals = work.groupBy(by).agg(F.sum(revenue).alias("revenue"), F.sum(cost).alias("cost"))
    profit = F.col("revenue") - F.col("cost")
    return totals.withColumn("profit", profit).withColumn("margin", ratio(profit, F.col("revenue")))


def utilization(activity: DataFrame, worker: str, date: str) -> DataFrame:
    """Days with activity over the days the whole table spans, per worker."""
    span = activity.agg((F.datediff(F.max(date), F.min(date)) + 1).cast("long"))
    active = activity.groupBy(worker).agg(F.count_distinct(date).alias("active_days"))
    return active.withColumn("calendar_days", span.scalar()).withColumn(
        "utilization", ratio(F.col("active_days"), F.col("calendar_days"))
    )
