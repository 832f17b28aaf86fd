"""Calendars with empty periods, and worked hours of overlapping sessions."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import calendar, workload
from tallyspark.operators.roles import Ledger, Period, Statuses

D = dt.date


@pytest.mark.parametrize(
    "unit, periods, paid",
    [
        ("month", 14, {D(2022, 12, 1): (5.0, 1, 1, 1), D(2023, 6, 1): (30.0, 2, 2, 2)}),
        ("quarter", 6, {D(2022, 10, 1): (5.0, 1, 1, 1), D(2023, 4, 1): (30.0, 2, 2, 2)}),
        ("year", 3, {D(2022, 1, 1): (5.0, 1, 1, 1), D(2023, 1, 1): (30.0, 2, 0, 2)}),
    ],
)
def test_every_period_has_a_row(spark, unit, periods, paid):
    statuses = Statuses(spark.createDataFrame([(1, D(2022, 12, 5), D(2023, 8, 1)), (2, D(2023, 5, 2), D(2023, 11, 30))], "customer_id int, start_date date, end_date date"))
    ledger = Ledger(spark.createDataFrame([(1, D(2022, 12, 31), 5.0), (1, D(2023, 6, 1), 10.0), (2, D(2023, 6, 30), 20.0), (2, D(2024, 2, 1), 9.0)], "customer_id int, txn_date date, amount double"))
    found = calendar.period_metrics(statuses, ledger, Period("2022-12-10", "2024-01-20"), unit).collect()
    assert len(found) == periods and len({r["period_start"] for r in found}) == periods
    got = {r["period_start"]: tuple(r)[2:] for r in found}
    assert {start: got[start] for start in paid} == paid
    assert all(r["revenue"] == 0 and r["transactions"] == 0 for r in found if r["period_start"] not in paid)
    assert all(r["period_end"] >= r["period_start"] for r in found)


def test_overlapping_sessions_count_once(spark):
    """A third of all sessions belong to one worker; some last for days, some end before they begin."""
    rng, rows = random.Random(6), []
    for _ in range(1500):
        start = dt.datetime(2023, 1, 1) + dt.timedelta(seconds=rng.randrange(20 * 86_400))
        rows.append((0 if rng.random() < 0.34 else rng.randrange(1, 20), start, start + dt.timedelta(seconds=rng.choice([-5, 0, 1, 900, 7200, 200_000]))))
    rows += [(5, None, dt.datetime(2023, 1, 1)), (None, dt.datetime(2023, 1, 2, 23, 59), dt.datetime(2023, 1, 3, 0, 1))]
    want: dict = defaultdict(set)
    for worker, start, end in rows:
        if start and end > start:
            low, high = int((start - dt.datetime(2023, 1, 1)).total_seconds()), int((end - dt.datetime(2023, 1, 1)).total_seconds())
            want[worker].update(range(low, high))
    df = spark.createDataFrame(rows, "who int, a timestamp_ntz, b timestamp_ntz")
    found = defaultdict(int)
    for r in workload.worked_seconds(df, "who", "a", "b").collect():
        assert (r["worker"], r["day"]) not in found and 0 < r["seconds"] <= 86_400
        found[(r["worker"], r["day"])] = r["seconds"]
    days = defaultdict(int)
    for worker, seconds in want.items():
        for s in seconds:
            days[(worker, D(2023, 1, 1) + dt.timedelta(days=s // 86_400))] += 1
    assert dict(found) == dict(days)


def test_capacity_and_utilization(spark):
    assert workload.capacity_hours(Period("2023-01-01", "2023-01-31")) == 22 * 8
    assert workload.capacity_hours(Period("2023-01-07", "2023-01-08")) == 0
    at = lambda h, m=0: dt.datetime(2023, 1, 2, h, m)
    rows = [("x", at(9), at(12), True), ("x", at(11), at(13), False), ("y", at(9), at(10), False)]
    df = spark.createDataFrame(rows, "who string, a timestamp_ntz, b timestamp_ntz, paid boolean")
    found = {r["worker"]: tuple(r)[1:] for r in workload.utilization_hours(df, "who", "a", "b", Period("2023-01-02", "2023-01-02"), F.col("paid")).collect()}
    assert found == {"x": (4.0, 3.0, 8.0, 0.375, 0.75), "y": (1.0, 0.0, 8.0, 0.0, 0.0)}
