from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import cohorts, commerce, customers, records, series
from tallyspark.operators.roles import Ledger, Period, Statuses
from tests.conftest import rows

D = dt.date
MARCH = Period("2023-03-01", "2023-03-31")


@pytest.fixture(scope="module")
def bounds(spark):
    data = [
        (1, D(2023, 1, 1), D(2023, 3, 1)),  # ends on the first day
        (2, D(2023, 3, 1), None),  # starts on the first day, open
        (3, D(2023, 3, 31), None),  # starts on the last day
        (4, D(2023, 4, 1), None),  # starts after
        (5, D(2023, 1, 1), D(2023, 2, 28)),  # ends before
        (6, D(2023, 1, 1), D(2023, 3, 31)),  # ends on the last day
        (6, D(2023, 2, 1), D(2023, 3, 15)),  # overlapping second record
        (7, D(2023, 1, 1), D(2023, 4, 5)),  # ends after
    ]
    return Statuses(spark.createDataFrame(data, "customer_id int, start_date date, end_date date"))


def test_active_boundaries(bounds):
    assert rows(customers.active_as_of(bounds, "2023-03-01")) == [(2,), (6,), (7,)]
    assert rows(customers.active_as_of(bounds, "2023-03-31")) == [(2,), (3,), (7,)]
    assert rows(customers.active_during(bounds, MARCH)) == [(1,), (2,), (3,), (6,), (7,)]


@pytest.mark.parametrize("granularity", ["month", "quarter", "year"])
def test_active_by_period_equals_one_period_at_a_time(spark, granularity):
    rng = random.Random(5)
    data = []
    for _ in range(400):
        start = D(2015, 1, 1) + dt.timedelta(days=rng.randrange(4000))
        end = None if rng.random() < 0.2 else start + dt.timedelta(days=rng.randrange(0, 900))
        customer = 0 if rng.random() < 0.34 else rng.randrange(1, 60)  # one customer has a third of the records
        data.append((customer, start, end))
    statuses = Statuses(spark.createDataFrame(data, "customer_id int, start_date date, end_date date"))
    found = customers.active_by_period(statuses, Period("2016-02-10", "2024-11-20"), granularity).orderBy("period_start")
    months = {"month": 1, "quarter": 3, "year": 12}[granularity]
    seen = 0
    for start, at_end, during in [tuple(r) for r in found.collect()]:
        following = start.year * 12 + start.month - 1 + months
        last = D(following // 12, following % 12 + 1, 1) - dt.timedelta(days=1)
        assert at_end == len({c for c, s, e in data if s <= last and (e is None or e > last)}), start
        assert during == len({c for c, s, e in data if s <= last and (e is None or e >= start)}), start
        seen += 1
    assert seen == {"month": 106, "quarter": 36, "year": 9}[granularity]


@pytest.fixture(scope="module")
def ledger(spark):
    data = [
        (1, D(2023, 3, 1), 10.0),
        (1, D(2023, 3, 31), 20.0),
        (2, D(2023, 3, 15), 5.0),
        (2, D(2023, 4, 1), 100.0),
        (9, D(2023, 3, 2), 1000.0),  # no status record
    ]
    return Ledger(spark.createDataFrame(data, "customer_id int, txn_date date, amount double"))


def test_recurring_revenue_is_revenue_of_the_active(bounds, ledger):
    found = customers.recurring_revenue(bounds, ledger, MARCH).first()
    assert tuple(found) == (3, pytest.approx(5.0 / 3), pytest.approx(5.0))


def test_arpu_counts_customers_without_revenue(spark, bounds, ledger):
    segment = F.when(F.col("customer_id") < 3, "a").otherwise("b").alias("segment")
    segments = bounds.df.select(F.col("customer_id").alias("customer"), segment).distinct()
    assert rows(customers.arpu_active(bounds, ledger, MARCH, segments)) == [("a", 2, 35.0, 17.5), ("b", 3, 0.0, 0.0)]
    known = segments.filter("customer <> 2")
    assert rows(customers.arpu_active(bounds, ledger, MARCH, known)) == [("a", 1, 30.0, 30.0), ("b", 3, 0.0, 0.0)]
    churn = {r["segment"]: tuple(r)[1:3] for r in customers.churn_simple(bounds, MARCH, segments=segments).collect()}
    assert churn == {"a": (1, 0), "b": (2, 1)}


def test_active_without_revenue(bounds, ledger):
    assert rows(customers.active_without_revenue(bounds, ledger, MARCH)) == [(3,), (6,), (7,)]


def test_churn_simple_stays_within_the_cohort(bounds):
    # Customers 2, 6 and 7 open the period; 6 has a record ending in it. 1 ended before opening.
    assert tuple(customers.churn_simple(bounds, MARCH).first()) == (3, 1, pytest.approx(1 / 3))


def test_churn_of_an_empty_cohort(bounds):
    assert tuple(customers.churn_simple(bounds, Period("2000-01-01", "2000-01-31")).first()) == (0, 0, None)


def test_churn_latest(spark):
    data = [
        ("a", D(2022, 1, 1), D(2023, 1, 10), "gold"),  # old record ended, latest still runs
        ("a", D(2023, 1, 5), None, "gold"),
        ("b", D(2022, 1, 1), D(2023, 3, 30), "gold"),  # ended the day before the period end
        ("c", D(2022, 1, 1), D(2023, 3, 31), "gold"),  # ended on the period end: not churned
        ("d", D(2022, 1, 1), D(2023, 2, 1), "gold"),  # two latest records tie, one ended
        ("d", D(2022, 1, 1), None, "gold"),
        ("e", D(2022, 1, 1), D(2023, 2, 1), "blue"),  # other plan
        ("f", D(2022, 1, 1), None, "gold"),  # latest record has another plan
        ("f", D(2023, 2, 1), D(2023, 2, 2), "blue"),
    ]
    statuses = Statuses(
        spark.createDataFrame(data, "k string, s date, e date, plan string"), customer="k", start="s", end="e"
    )
    found = customers.churn_latest(statuses, Period("2023-01-01", "2023-03-31"), F.col("plan") == "gold").first()
    assert (found["cohort_rows"], found["cohort_customers"], found["churned"]) == (6, 5, 3)
    assert found["churn_rate"] == 0.5 and found["record_level_rate"] == pytest.approx(3 / 6)


def test_retention_of_the_baseline_on_itself_is_one(spark, ledger):
    statuses = Statuses(spark.createDataFrame([(1, D(2023, 3, 1), None), (2, D(2023, 3, 31), None), (3, D(2023, 4, 1), None)],
                                              "customer_id int, start_date date, end_date date"))
    same = customers.revenue_retention(statuses, ledger, F.lit(True), MARCH, MARCH).first()
    assert tuple(same) == (35.0, 35.0, 1.0)
    later = customers.revenue_retention(statuses, ledger, F.lit(True), MARCH, Period("2023-04-01", "2023-04-30")).first()
    assert later["revenue_retention"] == pytest.approx(100 / 35)


def test_acquisition_cost_counts_first_events_only(spark):
    spend = spark.createDataFrame([(D(2023, 3, 1), 60.0), (D(2023, 4, 1), 999.0)], "d date, v double")
    events = spark.createDataFrame(
        [(1, D(2023, 2, 1)), (1, D(2023, 3, 5)), (2, D(2023, 3, 31)), (3, D(2023, 4, 1)), (4, D(2023, 3, 1))], "u int, d date"
    )
    assert tuple(customers.acquisition_cost(spend, "d", "v", events, "u", "d", MARCH).first()) == (60.0, 2, 30.0)


@pytest.fixture(scope="module")
def monthly(spark):
    data = [(D(2023, 1, 1), 10.0), (D(2023, 2, 1), 10.0), (D(2023, 4, 1), 30.0), (D(2024, 1, 1), 5.0)]
    return spark.createDataFrame(data, "period_start date, revenue double")


def test_growth_over_a_gap(monthly):
    found = {p: (r, g) for p, r, g in rows(series.growth(monthly, "revenue", 1))}
    assert len(found) == 13
    assert found[D(2023, 1, 1)] == (10.0, None) and found[D(2023, 2, 1)] == (10.0, 0.0)
    assert found[D(2023, 3, 1)] == (0.0, -1.0) and found[D(2023, 4, 1)] == (30.0, None)
    yearly = {p: g for p, _, g in rows(series.growth(monthly, "revenue", 12))}
    assert yearly[D(2024, 1, 1)] == -0.5 and yearly[D(2023, 12, 1)] is None


def test_trailing_and_differences(monthly):
    found = {p: t for p, _, t in rows(series.trailing_sum(monthly, "revenue", 3))}
    assert (found[D(2023, 1, 1)], found[D(2023, 3, 1)], found[D(2023, 6, 1)], found[D(2023, 7, 1)]) == (10.0, 20.0, 30.0, 0.0)
    found = {p: (s, a) for p, s, a in rows(series.period_difference(monthly, "revenue"))}
    assert found[D(2023, 2, 1)] == (None, 0.0) and found[D(2023, 3, 1)] == (-10.0, 10.0) and D(2023, 1, 1) not in found


def test_crosscheck(spark):
    one = spark.sql("SELECT 100.0D AS x")
    assert series.crosscheck(one, spark.sql("SELECT 100.5D AS y"), 0.01).first()["ok"]
    assert not series.crosscheck(one, spark.sql("SELECT 102.0D AS y"), 0.01).first()["ok"]
    assert series.crosscheck(spark.sql("SELECT 0.0D AS x"), spark.sql("SELECT 0.0D AS y"), 0.01).first()["ok"]


def test_cohorts(spark):
    data = [
        (1, D(2023, 1, 5), 100.0, 60.0, "web"),
        (1, D(2023, 1, 9), 10.0, 5.0, "shop"),
        (1, D(2023, 3, 1), 50.0, 20.0, "shop"),
        (2, D(2023, 1, 31), 40.0, 30.0, "shop"),
        (3, D(2023, 2, 1), 7.0, 1.0, "web"),
    ]
    df = spark.createDataFrame(data, "c int, d date, r double, k double, t string")
    base = cohorts.cohort_base(df, "c", "d", "r", "k")
    jan, feb, mar = D(2023, 1, 1), D(2023, 2, 1), D(2023, 3, 1)
    assert rows(base) == [
        (jan, jan, 2, 150.0, 95.0, 55.0, 55.0),
        (jan, mar, 1, 50.0, 20.0, 30.0, 85.0),
        (feb, feb, 1, 7.0, 1.0, 6.0, 6.0),
    ]
    spend = spark.createDataFrame([(jan, 85.0), (feb, 6.1)], "cohort_month date, spend double")
    paid = cohorts.cohort_payback(base, spend)
    assert [r["payback_status"] for r in paid.orderBy("cohort_month", "month").collect()] == [
        "Not Paid Back",
        "Paid Back",
        "Not Paid Back",
    ]
    assert rows(cohorts.cohort_summary(paid)) == [(jan, 200.0, 85.0, 85.0, mar, 2), (feb, 7.0, 6.0, 6.1, None, None)]
    assert rows(cohorts.cohort_annual(base)) == [(jan, 2023, 200.0, 115.0, 85.0, 85.0), (feb, 2023, 7.0, 1.0, 6.0, 6.0)]
    split = cohorts.cohort_base(df, "c", "d", "r", "k", initial_type="t")
    assert {(r["cohort_month"], r["initial_type"], r["month"]): r["revenue"] for r in split.collect()} == {
        (jan, "web", jan): 110.0,
        (jan, "web", mar): 50.0,
        (jan, "shop", jan): 40.0,
        (feb, "web", feb): 7.0,
    }
    curve = cohorts.retention_curve(Ledger(df, "c", "d", "r"))
    assert rows(curve) == [(jan, 0, 150.0, 1.0), (jan, 2, 50.0, pytest.approx(1 / 3)), (feb, 0, 7.0, 1.0)]


def test_purchase_gap_equals_mean_of_single_gaps(spark):
    rng = random.Random(9)
    data = [(rng.choice([1, 1, 2, 3, 4]), D(2023, 1, 1) + dt.timedelta(days=rng.randrange(300))) for _ in range(60)]
    data.append((99, D(2023, 1, 1)))
    found = {c: g for c, _, g in rows(commerce.purchase_gap(Ledger(spark.createDataFrame([(c, d, 1.0) for c, d in data], "customer_id int, txn_date date, amount double"))))}
    days = defaultdict(list)
    for c, d in data:
        days[c].append(d)
    expected = {}
    for c, ds in days.items():
        ds.sort()
        if len(ds) > 1:
            expected[c] = sum((b - a).days for a, b in zip(ds, ds[1:])) / (len(ds) - 1)
    assert found == pytest.approx(expected)


def test_revenue_recognition_adds_up(spark):
    data = [(365.0, D(2023, 1, 15), D(2024, 1, 14)), (10.0, D(2023, 2, 3), D(2023, 2, 3)), (99.0, D(2023, 1, 1), None)]
    df = spark.createDataFrame(data, "v double, s date, e date")
    found = dict(rows(commerce.revenue_recognition(df, "v", "s", "e")))
    assert found[D(2023, 1, 1)] == pytest.approx(17.0) and found[D(2023, 2, 1)] == pytest.approx(38.0)
    assert sum(found.values()) == pytest.approx(375.0)


def test_sales_cycle_ignores_earlier_deliveries(spark):
    deals = spark.createDataFrame([(1, D(2023, 1, 10), "F"), (2, D(2023, 1, 1), "F"), (3, D(2023, 1, 1), "O")], "k int, d date, s string")
    shipped = spark.createDataFrame([(1, D(2023, 1, 5)), (1, D(2023, 1, 20)), (1, D(2023, 1, 30)), (2, D(2023, 1, 1)), (3, D(2022, 12, 1))], "k2 int, d2 date")
    assert rows(commerce.sales_cycle(deals, "k", "d", "s", shipped, "k2", "d2")) == [("F", 2, 5.0)]


def test_latest_records_and_lookup(spark):
    df = spark.createDataFrame([(1, D(2023, 1, 1), 5), (1, D(2023, 2, 1), 6), (1, D(2023, 2, 1), 7), (2, None, 8)], "k int, d date, id int")
    assert [r["id"] for r in records.latest_records(df, "k", "d").orderBy("id").collect()] == [6, 7, 8]
    assert [r["id"] for r in records.latest_records(df, "k", "d", tie_break="id").orderBy("id").collect()] == [7, 8]
    right = spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    found = records.lookup(df.select(F.col("k").alias("l"), "id"), F.col("l"), right, "k", "v")
    assert rows(found, "id") == [(1, 5, "a"), (1, 6, "a"), (1, 7, "a"), (2, 8, None)]


def test_source_paths(spark):
    texts = [
        ("select * from read_csv('a.csv') join READ_CSV( ['b.csv', 'c d.CSV'] ) using (x)",),
        ("select 'read_csv(nothing)'",),
        ("select * from read_csv('a.csv')",),
    ]
    df = spark.createDataFrame(texts, "q string")
    assert [r[0] for r in df.select(records.source_paths(F.col("q"))).collect()] == [["a.csv", "b.csv", "c d.CSV"], [], ["a.csv"]]
    assert rows(records.source_lineage(df, "q")) == [("a.csv", 2), ("b.csv", 1), ("c d.CSV", 1)]


def test_horizon_matches_granularity(spark):
    data = [(1, D(2022, m, 1), 1.0) for m in range(1, 13)] + [(1, D(2023, m, 1), 3.0) for m in range(1, 13)]
    found = {g: (b, p, v) for g, b, p, v in rows(commerce.horizon_value(Ledger(spark.createDataFrame(data, "customer_id int, txn_date date, amount double")), 5))}
    assert found == {"year": (24.0, 5, 120.0), "quarter": (6.0, 20, 120.0), "month": (2.0, 60, 120.0)}
