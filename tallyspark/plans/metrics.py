"""Customer, revenue, cohort and commerce metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.safe import money, rounded
from tallyspark.operators import calendar, cohorts, commerce, customers, series, workload
from tallyspark.operators.roles import Ledger, Period
from tallyspark.plans import roles
from tallyspark.plans.registry import query
from tallyspark.plans.roles import (
    CONTRACTS,
    JANUARY_1998,
    SEGMENTED,
    TRANSACTIONS,
    YEAR_1997,
    YEAR_1998,
    ledger,
    order_sales,
    segments,
    statuses,
    table,
)


def _as_of(day: str) -> str:
    return f"start_date <= DATE '{day}' AND (end_date > DATE '{day}' OR end_date IS NULL)"


def _during(start: str, end: str) -> str:
    return f"start_date <= DATE '{end}' AND (end_date >= DATE '{start}' OR end_date IS NULL)"


def _in(date: str, period: Period) -> str:
    return f"{date} BETWEEN DATE '{period.start}' AND DATE '{period.end}'"


# -- active customers --------------------------------------------------------------------------


@query(f"WITH {CONTRACTS} SELECT DISTINCT customer_id FROM contracts WHERE {_as_of('1998-01-01')}")
def active_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return customers.active_as_of(statuses(spark, folder), "1998-01-01").withColumnRenamed("customer", "customer_id")


@query(f"WITH {CONTRACTS} SELECT DISTINCT customer_id FROM contracts WHERE {_during('1998-01-01', '1998-01-31')}")
def active_during(spark: SparkSession, folder: str) -> DataFrame:
    return customers.active_during(statuses(spark, folder), JANUARY_1998).withColumnRenamed("customer", "customer_id")


@query(
    f"""WITH {CONTRACTS}, calendar AS (
          SELECT CAST(m AS DATE) AS month_start, CAST(m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS month_end
          FROM (SELECT UNNEST(GENERATE_SERIES(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS m))
        SELECT month_start,
               COUNT(DISTINCT CASE WHEN end_date > month_end OR end_date IS NULL THEN customer_id END)
                 AS active_end_of_month,
               COUNT(DISTINCT CASE WHEN end_date >= month_start OR end_date IS NULL THEN customer_id END)
                 AS active_during_month
        FROM calendar JOIN contracts ON start_date <= month_end GROUP BY month_start"""
)
def active_by_month(spark: SparkSession, folder: str) -> DataFrame:
    counts = customers.active_by_period(statuses(spark, folder), Period("1995-01-01", "2001-12-31"), "month")
    return counts.select(
        F.col("period_start").alias("month_start"),
        F.col("active_end").alias("active_end_of_month"),
        F.col("active_during").alias("active_during_month"),
    )


# -- revenue per customer ----------------------------------------------------------------------


@query(
    f"""WITH {TRANSACTIONS} SELECT '1998-01-01..1998-01-31' AS period, ROUND(SUM(amount), 2) AS revenue, COUNT(*) AS n
        FROM transactions WHERE {_in('txn_date', JANUARY_1998)}"""
)
def revenue_for_period(spark: SparkSession, folder: str) -> DataFrame:
    found = commerce.period_revenue(ledger(spark, folder), JANUARY_1998)
    return found.withColumn("revenue", money("revenue"))


_ARPU = f"""
  active AS (SELECT DISTINCT customer_id, segment FROM contracts WHERE {_during('1998-01-01', '1998-01-31')}),
  paid AS (SELECT customer_id, SUM(amount) AS revenue FROM transactions
           WHERE {_in('txn_date', JANUARY_1998)} GROUP BY customer_id),
  arpu AS (SELECT segment, COUNT(*) AS customer_count, SUM(revenue) AS revenue, SUM(revenue) / COUNT(*) AS arpu
           FROM active LEFT JOIN paid ON active.customer_id = paid.customer_id GROUP BY segment)"""


@query(
    f"""WITH {SEGMENTED}, {TRANSACTIONS}, {_ARPU}
        SELECT segment, customer_count, ROUND(revenue, 2) AS revenue, ROUND(arpu, 2) AS arpu FROM arpu"""
)
def arpu_active_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    found = customers.arpu_active(statuses(spark, folder), ledger(spark, folder), JANUARY_1998, segments(spark, folder))
    return found.withColumn("revenue", money("revenue")).withColumn("arpu", money("arpu"))


def _recurring_sql(name: str, period: Period) -> str:
    return f"""WITH {CONTRACTS}, {TRANSACTIONS},
        active AS (SELECT DISTINCT customer_id FROM contracts WHERE {_as_of(period.end)}),
        paid AS (SELECT SUM(amount) AS revenue FROM transactions
                 WHERE {_in('txn_date', period)} AND customer_id IN (SELECT customer_id FROM active)),
        base AS (SELECT (SELECT COUNT(*) FROM active) AS active_customers, (SELECT revenue FROM paid) AS revenue)
        SELECT '{period.start}..{period.end}' AS period, active_customers,
               ROUND(revenue / active_customers, 4) AS arpu,
               ROUND(active_customers * (revenue / active_customers), 2) AS {name} FROM base"""


def _recurring(spark: SparkSession, folder: str, name: str, period: Period) -> DataFrame:
    found = customers.recurring_revenue(statuses(spark, folder), ledger(spark, folder), period)
    return found.select(
        F.lit(f"{period.start}..{period.end}").alias("period"),
        "active_customers",
        rounded("arpu", 4).alias("arpu"),
        money("recurring_revenue").alias(name),
    )


@query(_recurring_sql("mrr", JANUARY_1998))
def mrr(spark: SparkSession, folder: str) -> DataFrame:
    return _recurring(spark, folder, "mrr", JANUARY_1998)


@query(_recurring_sql("arr", YEAR_1998))
def arr(spark: SparkSession, folder: str) -> DataFrame:
    return _recurring(spark, folder, "arr", YEAR_1998)


@query(
    f"""WITH {CONTRACTS}, {TRANSACTIONS}
        SELECT DISTINCT customer_id FROM contracts WHERE {_during('1998-01-01', '1998-01-31')}
        EXCEPT SELECT customer_id FROM transactions WHERE {_in('txn_date', JANUARY_1998)}"""
)
def active_without_revenue(spark: SparkSession, folder: str) -> DataFrame:
    found = customers.active_without_revenue(statuses(spark, folder), ledger(spark, folder), JANUARY_1998)
    return found.withColumnRenamed("customer", "customer_id")


# -- churn and retention -----------------------------------------------------------------------


@query(
    f"""WITH {CONTRACTS},
        opening AS (SELECT DISTINCT customer_id FROM contracts WHERE {_as_of('1998-01-01')}),
        ended AS (SELECT DISTINCT customer_id FROM contracts
                  WHERE {_in('end_date', JANUARY_1998)} AND customer_id IN (SELECT customer_id FROM opening))
        SELECT (SELECT COUNT(*) FROM opening) AS start_customers, (SELECT COUNT(*) FROM ended) AS churned_customers,
               ROUND((SELECT COUNT(*) FROM ended) * 1.0 / (SELECT COUNT(*) FROM opening), 6) AS churn_rate"""
)
def churn_rate_simple(spark: SparkSession, folder: str) -> DataFrame:
    return customers.churn_simple(statuses(spark, folder), JANUARY_1998).withColumn(
        "churn_rate", rounded("churn_rate", 6)
    )


_CHURN_PERIOD = Period("1998-01-01", "2001-06-30")
_LATEST = f"""
  initial AS (SELECT DISTINCT customer_id FROM contracts WHERE plan = '1-URGENT' AND {_as_of('1998-01-01')}),
  latest AS (SELECT s.customer_id, s.end_date FROM contracts s JOIN initial i ON s.customer_id = i.customer_id
             WHERE s.start_date = (SELECT MAX(start_date) FROM contracts s2 WHERE s2.customer_id = s.customer_id)),
  judged AS (SELECT COUNT(*) AS cohort_rows, COUNT(DISTINCT customer_id) AS cohort_customers,
                    COUNT(CASE WHEN end_date IS NOT NULL AND end_date < DATE '2001-06-30' THEN 1 END) AS churned
             FROM latest)"""


def _churn_latest(spark: SparkSession, folder: str) -> DataFrame:
    found = customers.churn_latest(statuses(spark, folder), _CHURN_PERIOD, F.col("plan") == "1-URGENT")
    return found.withColumn("churn_rate", rounded("churn_rate", 6)).withColumn(
        "record_level_rate", rounded("record_level_rate", 6)
    )


@query(
    f"""WITH {CONTRACTS}, {_LATEST}
        SELECT cohort_rows, cohort_customers, churned, ROUND(churned * 1.0 / cohort_rows, 6) AS churn_rate FROM judged"""
)
def churn_rate_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _churn_latest(spark, folder).drop("record_level_rate")


@query(
    f"""WITH {CONTRACTS}, {_LATEST},
        records AS (SELECT COUNT(*) AS n, COUNT(CASE WHEN end_date < DATE '2001-06-30' THEN 1 END) AS ended
                    FROM contracts WHERE plan = '1-URGENT' AND {_as_of('1998-01-01')})
        SELECT cohort_rows, cohort_customers, churned, ROUND(churned * 1.0 / cohort_rows, 6) AS churn_rate,
               ROUND(ended * 1.0 / n, 6) AS record_level_rate FROM judged, records"""
)
def churn_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return _churn_latest(spark, folder)


@query(
    f"""WITH {CONTRACTS}, {TRANSACTIONS},
        cohort AS (SELECT DISTINCT customer_id FROM contracts
                   WHERE plan = '1-URGENT' AND {_in('start_date', YEAR_1997)}),
        before AS (SELECT SUM(amount) AS v FROM transactions t JOIN cohort c ON t.customer_id = c.customer_id
                   WHERE {_in('txn_date', YEAR_1997)}),
        after AS (SELECT SUM(amount) AS v FROM transactions t JOIN cohort c ON t.customer_id = c.customer_id
                  WHERE {_in('txn_date', YEAR_1998)})
        SELECT ROUND(before.v, 2) AS initial_revenue, ROUND(after.v, 2) AS future_revenue,
               ROUND(after.v / before.v, 6) AS revenue_retention FROM before, after"""
)
def revenue_retention(spark: SparkSession, folder: str) -> DataFrame:
    found = customers.revenue_retention(
        statuses(spark, folder), ledger(spark, folder), F.col("plan") == "1-URGENT", YEAR_1997, YEAR_1998
    )
    return found.select(
        money("initial_revenue").alias("initial_revenue"),
        money("future_revenue").alias("future_revenue"),
        rounded("revenue_retention", 6).alias("revenue_retention"),
    )


@query(
    f"""WITH {TRANSACTIONS}, firsts AS (
          SELECT customer_id, DATE_TRUNC('month', MIN(txn_date)) AS cohort FROM transactions GROUP BY customer_id),
        curve AS (SELECT CAST(cohort AS DATE) AS cohort_month,
                         DATEDIFF('month', cohort, DATE_TRUNC('month', txn_date)) AS month_offset, SUM(amount) AS revenue
                  FROM transactions JOIN firsts USING (customer_id) GROUP BY 1, 2)
        SELECT c.cohort_month, c.month_offset, ROUND(c.revenue, 2) AS revenue,
               ROUND(c.revenue / o.revenue, 6) AS retention
        FROM curve c JOIN curve o ON c.cohort_month = o.cohort_month AND o.month_offset = 0"""
)
def retention_curve(spark: SparkSession, folder: str) -> DataFrame:
    curve = cohorts.retention_curve(ledger(spark, folder))
    return curve.withColumn("revenue", money("revenue")).withColumn("retention", rounded("retention", 6))


# -- acquisition and lifetime value ------------------------------------------------------------

_CAC_PERIOD = Period("2024-01-01", "2024-01-02")


@query(
    f"""WITH spend AS (SELECT SUM(value) AS v FROM events
                       WHERE event_type = 'click' AND {_in('CAST(ts AS DATE)', _CAC_PERIOD)}),
        firsts AS (SELECT user_id, MIN(CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'signup' GROUP BY user_id),
        fresh AS (SELECT COUNT(*) AS n FROM firsts WHERE {_in('d', _CAC_PERIOD)})
        SELECT '2024-01-01..2024-01-02' AS period, ROUND(v, 2) AS spend, n AS new_customers, ROUND(v / n, 4) AS cac
        FROM spend, fresh"""
)
def cac(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("day", F.col("ts").cast("date"))
    clicks = events.filter(F.col("event_type") == "click")
    signups = events.filter(F.col("event_type") == "signup")
    found = customers.acquisition_cost(clicks, "day", "value", signups, "user_id", "day", _CAC_PERIOD)
    return found.select(
        F.lit("2024-01-01..2024-01-02").alias("period"),
        money("spend").alias("spend"),
        "new_customers",
        rounded("cac", 4).alias("cac"),
    )


@query(f"WITH {TRANSACTIONS} SELECT customer_id, ROUND(SUM(amount), 2) AS ltv FROM transactions GROUP BY customer_id")
def ltv_historical(spark: SparkSession, folder: str) -> DataFrame:
    return ledger(spark, folder).revenue_by_customer().select(
        F.col("customer").alias("customer_id"), money("revenue").alias("ltv")
    )


@query(f"WITH {CONTRACTS} SELECT customer_id, ROUND(SUM(contract_value), 2) AS ltv FROM contracts GROUP BY customer_id")
def ltv_subscription(spark: SparkSession, folder: str) -> DataFrame:
    """Lifetime value from what the contracts are worth rather than from what was paid."""
    signed = Ledger(roles.contracts(spark, folder), date="start_date", amount="contract_value")
    return signed.revenue_by_customer().select(F.col("customer").alias("customer_id"), money("revenue").alias("ltv"))


@query(
    f"""WITH {SEGMENTED}, {TRANSACTIONS}, {_ARPU},
        opening AS (SELECT DISTINCT segment, customer_id FROM contracts WHERE {_as_of('1998-01-01')}),
        ended AS (SELECT DISTINCT segment, customer_id FROM contracts WHERE {_in('end_date', JANUARY_1998)}),
        churn AS (SELECT o.segment, COUNT(e.customer_id) * 1.0 / COUNT(*) AS churn_rate
                  FROM opening o LEFT JOIN ended e ON o.segment = e.segment AND o.customer_id = e.customer_id
                  GROUP BY o.segment)
        SELECT a.segment, ROUND(arpu, 4) AS arpu, ROUND(churn_rate, 6) AS churn_rate,
               ROUND(arpu / NULLIF(churn_rate, 0), 2) AS ltv
        FROM arpu a JOIN churn c ON a.segment = c.segment"""
)
def ltv_predicted(spark: SparkSession, folder: str) -> DataFrame:
    found = customers.predicted_lifetime_value(
        statuses(spark, folder), ledger(spark, folder), JANUARY_1998, segments(spark, folder)
    )
    return found.select(
        "segment",
        rounded("arpu", 4).alias("arpu"),
        rounded("churn_rate", 6).alias("churn_rate"),
        money("ltv").alias("ltv"),
    )


@query(
    f"WITH {TRANSACTIONS} "
    + " UNION ALL ".join(
        f"""SELECT '{unit}' AS granularity, ROUND(CAST(SUM(r) AS DOUBLE) / COUNT(r), 5) AS base_value, {periods} AS periods,
            ROUND(CAST(SUM(r) AS DOUBLE) / COUNT(r) * {periods}, 3) AS value
            FROM (SELECT SUM(CAST(amount AS DECIMAL(28, 6))) AS r FROM transactions GROUP BY DATE_TRUNC('{unit}', txn_date))"""
        for unit, periods in [("year", 5), ("quarter", 20), ("month", 60)]
    )
)
def horizon_value(spark: SparkSession, folder: str) -> DataFrame:
    found = commerce.horizon_value(ledger(spark, folder), 5)
    return found.withColumn("base_value", rounded("base_value", 5)).withColumn("value", rounded("value", 3))


# -- cohorts -----------------------------------------------------------------------------------

_COHORTS = """
  firsts AS (SELECT o_custkey AS customer, DATE_TRUNC('month', MIN(o_orderdate)) AS cohort FROM orders GROUP BY 1),
  spend AS (SELECT cohort, COUNT(*) * 60000.0 AS spend FROM firsts GROUP BY cohort),
  base AS (SELECT cohort, DATE_TRUNC('month', o_orderdate) AS month, COUNT(DISTINCT o_custkey) AS customers,
                  SUM(l_extendedprice * (1 - l_discount)) AS revenue, SUM(l_extendedprice * 0.7) AS cost
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN firsts ON o_custkey = customer GROUP BY 1, 2),
  running AS (SELECT *, revenue - cost AS gross_profit,
                     SUM(revenue - cost) OVER (PARTITION BY cohort ORDER BY month) AS cumulative_gross_profit FROM base),
  payback AS (SELECT r.*, s.spend, CASE WHEN cumulative_gross_profit < s.spend THEN 'Not Paid Back' ELSE 'Paid Back' END
                AS payback_status FROM running r JOIN spend s ON r.cohort = s.cohort)"""


def _cohort_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Monthly cohort base table and the marketing spend of each cohort."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    acquired = cohorts.first_months(Ledger(orders, "o_custkey", "day", "o_orderkey"))
    activity = order_sales(spark, folder).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    base = cohorts.cohort_base(activity, "o_custkey", "day", "revenue", "cost", acquired=acquired)
    spend = acquired.groupBy("cohort_month").agg((F.count(F.lit(1)) * 60000.0).alias("spend"))
    return base, spend


@query(
    f"""WITH {_COHORTS} SELECT CAST(cohort AS DATE) AS cohort_month, CAST(month AS DATE) AS month, customers,
        ROUND(revenue, 4) AS revenue, ROUND(cost, 4) AS cost, ROUND(gross_profit, 4) AS gross_profit,
        ROUND(cumulative_gross_profit, 4) AS cumulative_gross_profit FROM running"""
)
def cohort_base(spark: SparkSession, folder: str) -> DataFrame:
    base, _ = _cohort_inputs(spark, folder)
    sums = ["revenue", "cost", "gross_profit", "cumulative_gross_profit"]
    return base.select("cohort_month", "month", "customers", *[rounded(c, 4).alias(c) for c in sums])


@query(
    f"""WITH {_COHORTS} SELECT CAST(cohort AS DATE) AS cohort_month, CAST(month AS DATE) AS month,
        ROUND(cumulative_gross_profit, 4) AS cumulative_gross_profit, spend, payback_status FROM payback"""
)
def cohort_payback(spark: SparkSession, folder: str) -> DataFrame:
    paid = cohorts.cohort_payback(*_cohort_inputs(spark, folder))
    total = rounded("cumulative_gross_profit", 4).alias("cumulative_gross_profit")
    return paid.select("cohort_month", "month", total, "spend", "payback_status")


@query(
    f"""WITH {_COHORTS} SELECT CAST(cohort AS DATE) AS cohort_month, YEAR(month) AS year, ROUND(SUM(revenue), 4) AS revenue,
        ROUND(SUM(cost), 4) AS cost, ROUND(SUM(gross_profit), 4) AS gross_profit,
        ROUND(ARG_MAX(cumulative_gross_profit, month), 4) AS cumulative_gross_profit FROM running GROUP BY 1, 2"""
)
def cohort_annual(spark: SparkSession, folder: str) -> DataFrame:
    base, _ = _cohort_inputs(spark, folder)
    sums = ["revenue", "cost", "gross_profit", "cumulative_gross_profit"]
    return cohorts.cohort_annual(base).select("cohort_month", "year", *[rounded(c, 4).alias(c) for c in sums])


@query(
    f"""WITH {_COHORTS}, paid AS (
          SELECT cohort, ROUND(SUM(revenue), 4) AS revenue, ROUND(SUM(gross_profit), 4) AS gross_profit,
                 MAX(spend) AS spend, MIN(CASE WHEN payback_status = 'Paid Back' THEN month END) AS first_paid
          FROM payback GROUP BY cohort)
        SELECT CAST(cohort AS DATE) AS cohort_month, revenue, gross_profit, spend,
               CAST(first_paid AS DATE) AS first_paid_month, DATEDIFF('month', cohort, first_paid) AS months_to_payback
        FROM paid"""
)
def cohort_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = cohorts.cohort_summary(cohorts.cohort_payback(*_cohort_inputs(spark, folder)))
    return summary.withColumn("revenue", rounded("revenue", 4)).withColumn("gross_profit", rounded("gross_profit", 4))


# -- commerce ----------------------------------------------------------------------------------


@query(
    """SELECT c_mktsegment AS segment, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS revenue,
       ROUND(SUM(o_totalprice) / COUNT(*), 6) AS aov
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""
)
def aov(spark: SparkSession, folder: str) -> DataFrame:
    buyers = table(spark, folder, "customer")
    found = commerce.average_order_value(ledger(spark, folder), buyers, "c_custkey", "c_mktsegment")
    return found.withColumn("revenue", money("revenue")).withColumn("aov", rounded("aov", 6))


@query(
    f"""WITH {TRANSACTIONS}, counts AS (SELECT COUNT(*) AS n FROM transactions GROUP BY customer_id)
        SELECT COUNT(*) AS customers, COUNT(CASE WHEN n > 1 THEN 1 END) AS repeaters,
               ROUND(COUNT(CASE WHEN n > 1 THEN 1 END) * 1.0 / COUNT(*), 6) AS repeat_rate FROM counts"""
)
def repeat_purchase_rate(spark: SparkSession, folder: str) -> DataFrame:
    return commerce.repeat_purchase_rate(ledger(spark, folder)).withColumn("repeat_rate", rounded("repeat_rate", 6))


@query(
    f"""WITH {TRANSACTIONS}, gaps AS (
          SELECT customer_id, DATEDIFF('day', LAG(txn_date) OVER (PARTITION BY customer_id ORDER BY txn_date), txn_date) AS gap
          FROM transactions)
        SELECT customer_id, COUNT(*) AS orders, ROUND(AVG(gap), 6) AS avg_gap_days
        FROM gaps GROUP BY customer_id HAVING COUNT(*) > 1"""
)
def purchase_gap(spark: SparkSession, folder: str) -> DataFrame:
    return commerce.purchase_gap(ledger(spark, folder)).select(
        F.col("customer").alias("customer_id"), "orders", rounded("avg_gap_days", 6).alias("avg_gap_days")
    )


@query(
    f"""WITH {TRANSACTIONS}
        SELECT MONTH(txn_date) AS month_of_year, ROUND(SUM(amount), 2) AS revenue,
               ROUND(SUM(amount) / (SELECT SUM(amount) FROM transactions), 6) AS share FROM transactions GROUP BY 1"""
)
def seasonality(spark: SparkSession, folder: str) -> DataFrame:
    found = series.seasonality(ledger(spark, folder))
    return found.withColumn("revenue", money("revenue")).withColumn("share", rounded("share", 6))


@query(
    """SELECT l_suppkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS gmv,
       ROUND(SUM(l_extendedprice * (1 - l_discount) * l_tax), 6) AS commission, COUNT(DISTINCT l_orderkey) AS orders
       FROM lineitem GROUP BY l_suppkey"""
)
def seller_metrics(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    found = commerce.marketplace_metrics(lines, "l_suppkey", "l_orderkey", roles.gmv(), roles.commission())
    return found.withColumn("gmv", rounded("gmv", 4)).withColumn("commission", rounded("commission", 6))


@query(
    """SELECT o_custkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS gmv,
       ROUND(SUM(l_extendedprice * (1 - l_discount) * l_tax), 6) AS commission, COUNT(DISTINCT o_orderkey) AS orders
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey"""
)
def buyer_metrics(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    sales = order_sales(spark, folder).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # Sales are one row per order here, so counting rows counts orders.
    found = sales.groupBy("o_custkey").agg(
        rounded(F.sum("revenue"), 4).alias("gmv"),
        rounded(F.sum("commission"), 6).alias("commission"),
        F.count(F.lit(1)).alias("orders"),
    )
    return found


@query(
    """SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS gmv,
       ROUND(SUM(l_extendedprice * (1 - l_discount) * l_tax), 2) AS commission,
       ROUND(SUM(l_extendedprice * (1 - l_discount) * l_tax) / SUM(l_extendedprice * (1 - l_discount)), 6) AS rate
       FROM lineitem"""
)
def commission_rate(spark: SparkSession, folder: str) -> DataFrame:
    found = commerce.commission_rate(table(spark, folder, "lineitem"), roles.gmv(), roles.commission())
    return found.select(
        money("gmv").alias("gmv"), money("commission").alias("commission"), rounded("rate", 6).alias("rate")
    )


@query(
    """SELECT o_orderstatus AS stage, COUNT(*) AS deals, ROUND(SUM(o_totalprice), 2) AS value
       FROM orders GROUP BY o_orderstatus"""
)
def pipeline_by_stage(spark: SparkSession, folder: str) -> DataFrame:
    found = commerce.pipeline_by_stage(table(spark, folder, "orders"), "o_orderstatus", "o_totalprice")
    return found.withColumn("value", money("value"))


@query(
    """WITH cycles AS (
         SELECT o_orderkey, o_orderstatus, MIN(DATEDIFF('day', o_orderdate, l_shipdate)) AS days
         FROM orders JOIN lineitem ON l_orderkey = o_orderkey
         WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) GROUP BY 1, 2)
       SELECT o_orderstatus AS stage, COUNT(*) AS deals, ROUND(AVG(days), 6) AS avg_days FROM cycles GROUP BY 1"""
)
def sales_cycle(spark: SparkSession, folder: str) -> DataFrame:
    deals = table(spark, folder, "orders").withColumn("opened", F.col("o_orderdate").cast("date"))
    shipped = table(spark, folder, "lineitem").withColumn("shipped", F.col("l_shipdate").cast("date"))
    found = commerce.sales_cycle(deals, "o_orderkey", "opened", "o_orderstatus", shipped, "l_orderkey", "shipped")
    return found.withColumn("avg_days", rounded("avg_days", 6))


@query(
    f"""WITH {CONTRACTS}, months AS (
          SELECT contract_value, start_date, end_date,
                 UNNEST(GENERATE_SERIES(DATE_TRUNC('month', start_date), DATE_TRUNC('month', end_date), INTERVAL 1 MONTH)) AS m
          FROM contracts WHERE end_date IS NOT NULL)
        SELECT CAST(m AS DATE) AS month,
               ROUND(SUM(contract_value * (DATEDIFF('day', GREATEST(start_date, CAST(m AS DATE)),
                                                    LEAST(end_date, LAST_DAY(m))) + 1)
                         / (DATEDIFF('day', start_date, end_date) + 1)), 2) AS recognized
        FROM months GROUP BY 1"""
)
def revenue_recognition(spark: SparkSession, folder: str) -> DataFrame:
    found = commerce.revenue_recognition(roles.contracts(spark, folder), "contract_value", "start_date", "end_date")
    return found.withColumn("recognized", money("recognized"))


@query(
    """SELECT p_brand, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue,
       ROUND(SUM(l_extendedprice * 0.7), 4) AS cost,
       ROUND((SUM(l_extendedprice * (1 - l_discount)) - SUM(l_extendedprice * 0.7))
             / SUM(l_extendedprice * (1 - l_discount)), 6) AS margin
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"""
)
def profitability_by_part(spark: SparkSession, folder: str) -> DataFrame:
    per_part = (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum(roles.gmv()).alias("revenue"), F.sum(roles.cost()).alias("cost"))
    )
    branded = per_part.join(
        table(spark, folder, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    found = commerce.profitability(branded, "p_brand", F.col("revenue"), F.col("cost"))
    return found.select(
        "p_brand",
        rounded("revenue", 4).alias("revenue"),
        rounded("cost", 4).alias("cost"),
        rounded("margin", 6).alias("margin"),
    )


@query(
    """WITH span AS (SELECT DATEDIFF('day', MIN(CAST(ts AS DATE)), MAX(CAST(ts AS DATE))) + 1 AS calendar_days FROM events)
       SELECT user_id, COUNT(DISTINCT CAST(ts AS DATE)) AS active_days, calendar_days,
              ROUND(COUNT(DISTINCT CAST(ts AS DATE)) * 1.0 / calendar_days, 6) AS utilization
       FROM events, span GROUP BY user_id, calendar_days"""
)
def utilization(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", F.col("ts").cast("date").alias("day"))
    return commerce.utilization(events, "user_id", "day").withColumn("utilization", rounded("utilization", 6))


_STARTS = {"month": "1 MONTH", "quarter": "3 MONTH", "year": "12 MONTH"}
CALENDAR = Period("1996-11-15", "1999-02-10")


def _calendar_sql(unit: str) -> str:
    start, end = f"DATE '{CALENDAR.start}'", f"DATE '{CALENDAR.end}'"
    return f"""WITH {CONTRACTS}, {TRANSACTIONS},
        spine AS (SELECT CAST(s AS DATE) AS period_start, CAST(s + INTERVAL {_STARTS[unit]} - INTERVAL 1 DAY AS DATE) AS period_end
                  FROM GENERATE_SERIES(DATE_TRUNC('{unit}', {start}), DATE_TRUNC('{unit}', {end}), INTERVAL {_STARTS[unit]}) AS g(s)),
        paid AS (SELECT CAST(DATE_TRUNC('{unit}', txn_date) AS DATE) AS p, SUM(amount) AS revenue, COUNT(*) AS transactions
                 FROM transactions WHERE txn_date BETWEEN {start} AND {end} GROUP BY 1),
        active AS (SELECT period_start AS p,
                     COUNT(DISTINCT CASE WHEN start_date <= period_end AND (end_date IS NULL OR end_date > period_end) THEN customer_id END) AS active_end,
                     COUNT(DISTINCT CASE WHEN start_date <= period_end AND (end_date IS NULL OR end_date >= period_start) THEN customer_id END) AS active_during
                   FROM spine, contracts GROUP BY period_start)
        SELECT period_start, period_end, ROUND(COALESCE(revenue, 0), 2) AS revenue, COALESCE(transactions, 0) AS transactions,
               COALESCE(active_end, 0) AS active_end, COALESCE(active_during, 0) AS active_during
        FROM spine LEFT JOIN paid ON paid.p = period_start LEFT JOIN active ON active.p = period_start"""


def _calendar(spark: SparkSession, folder: str, unit: str) -> DataFrame:
    found = calendar.period_metrics(statuses(spark, folder), ledger(spark, folder), CALENDAR, unit)
    return found.withColumn("revenue", money("revenue"))


@query(_calendar_sql("month"))
def calendar_months(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue and active customers of each month of a calendar, months without orders included."""
    return _calendar(spark, folder, "month")


@query(_calendar_sql("quarter"))
def calendar_quarters(spark: SparkSession, folder: str) -> DataFrame:
    return _calendar(spark, folder, "quarter")


@query(_calendar_sql("year"))
def calendar_years(spark: SparkSession, folder: str) -> DataFrame:
    return _calendar(spark, folder, "year")


JANUARY_2024 = Period("2024-01-01", "2024-01-31")


@query(
    """WITH sessions AS (SELECT user_id, event_type, EPOCH(DATE_TRUNC('second', ts))::BIGINT AS a,
                                EPOCH(DATE_TRUNC('second', ts))::BIGINT + CAST(ROUND(value * 360) AS BIGINT) AS b FROM events),
       both_ AS (SELECT user_id, FALSE AS billable, a, b FROM sessions WHERE b > a
                 UNION ALL SELECT user_id, TRUE, a, b FROM sessions WHERE b > a AND event_type <> 'view'),
       marked AS (SELECT *, CASE WHEN a <= MAX(b) OVER (PARTITION BY user_id, billable ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                                 THEN 0 ELSE 1 END AS opens FROM both_),
       islands AS (SELECT user_id, billable, SUM(opens) OVER (PARTITION BY user_id, billable ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island, a, b FROM marked),
       merged AS (SELECT user_id, billable, MIN(a) AS a, MAX(b) AS b FROM islands GROUP BY user_id, billable, island),
       month_ AS (SELECT EPOCH(TIMESTAMP '2024-01-01')::BIGINT AS lo, EPOCH(TIMESTAMP '2024-02-01')::BIGINT AS hi),
       hours AS (SELECT user_id, SUM(LEAST(b, hi) - GREATEST(a, lo)) FILTER (NOT billable) / 3600 AS worked_hours,
                        COALESCE(SUM(LEAST(b, hi) - GREATEST(a, lo)) FILTER (billable), 0) / 3600 AS billable_hours
                 FROM merged, month_ WHERE a < hi AND b > lo GROUP BY user_id),
       capacity AS (SELECT 8.0 * COUNT(*) AS h FROM GENERATE_SERIES(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) AS g(d) WHERE ISODOW(d) <= 5)
       SELECT user_id, ROUND(worked_hours, 4) AS worked_hours, ROUND(billable_hours, 4) AS billable_hours, h::DOUBLE AS capacity_hours,
              ROUND(billable_hours / h, 6) AS utilization, ROUND(billable_hours / worked_hours, 6) AS realization
       FROM hours, capacity"""
)
def utilization_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Hours of sessions that overlap, merged for each user, against the working hours of January; views are not billable."""
    start = F.col("ts")
    end = F.col("ts") + F.make_dt_interval(secs=F.round(F.col("value") * 360))
    sessions = table(spark, folder, "events").select("user_id", "event_type", start.alias("a"), end.alias("b"))
    found = workload.utilization_hours(sessions, "user_id", "a", "b", JANUARY_2024, F.col("event_type") != "view")
    return found.select(
        F.col("worker").alias("user_id"), rounded("worked_hours", 4).alias("worked_hours"), rounded("billable_hours", 4).alias("billable_hours"),
        "capacity_hours", rounded("utilization", 6).alias("utilization"), rounded("realization", 6).alias("realization"),
    )
