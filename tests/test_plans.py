"""Properties of the plans that matter when the tables are large."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import customers, records
from tallyspark.operators.date_formats import detect_formats
from tallyspark.operators.roles import Period, Statuses
from tallyspark.plans.catalog import QUERIES

PACKAGE = Path(__file__).resolve().parents[1] / "tallyspark"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_python_in_the_data_path_and_no_products(spark, small, no_auto_broadcast):
    """With size-based broadcasts off, whatever is still broadcast was asked for: rows per column or one row."""
    skip = {"landing_ingest", "scan_csv_roundtrip", "scan_multi_file", "kg_roundtrip", "run_and_save"}
    for name, build in QUERIES.items():
        if name in skip:
            continue
        text = plan(build(spark, small))
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
            assert word not in text, (name, word)
        if not name.startswith(("profile", "preview", "catalog")):
            assert "BroadcastExchange" not in text, name


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(QUERIES["revenue_for_period"](spark, small))
    assert re.search(r"ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>", text)
    text = plan(QUERIES["kg_overwrite_observations"](spark, small))
    assert "l_extendedprice" not in text


def test_latest_records_are_cut_before_the_shuffle(spark, small):
    text = plan(QUERIES["latest_status_records"](spark, small))
    final, exchange, partial = (text.index(w) for w in (", Final", "Exchange hashpartitioning", ", Partial"))
    assert final < exchange < partial


def test_formats_are_decided_by_counts(spark, small):
    """One partial aggregate per task, keyed by the column alone."""
    text = plan(detect_formats(spark.read.parquet(f"{small}/documents.parquet"), ["lang", "source"]))
    assert "partial_count" in text and "keys=[column_name" in text and "keys=[column_name#" in text
    assert not re.search(r"keys=\[column_name#\d+, value", text)


def test_activity_moves_one_row_per_customer(spark, small):
    text = plan(QUERIES["active_by_month"](spark, small))
    assert text.count("FileScan") == 1 and "partial_bit_or" in text


def test_one_scan_per_series(spark, small):
    for name in ("revenue_growth_yoy", "trailing_window_revenue", "horizon_value", "retention_curve", "churn_rate_latest"):
        assert plan(QUERIES[name](spark, small)).count("FileScan") == 1, name


def test_skewed_join_keeps_all_rows(spark):
    """A third of the records belong to one customer and one relation end."""
    df = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS customer_id",
        "date_add(DATE'2020-01-01', int(id % 900)) AS start_date",
        "date_add(DATE'2020-01-01', int(id % 900 + id % 17)) AS end_date",
    )
    found = customers.active_by_period(Statuses(df), Period("2020-01-01", "2022-12-31")).agg(F.sum("active_during")).first()[0]
    months = df.selectExpr(
        "customer_id", "explode(sequence(trunc(start_date, 'MM'), trunc(end_date, 'MM'), INTERVAL 1 MONTH)) AS m"
    )
    assert found == months.distinct().count()
    assert records.latest_records(df, "customer_id", "start_date").select("customer_id").distinct().count() == 20_001


def test_library_fetches_only_what_is_small():
    """Rows reach the driver in a few known places, each bounded by columns or checked first."""
    allowed = {
        "operators/quantiles.py": 2,  # one row per column
        "operators/profile.py": 3,  # one row per column
        "operators/preview.py": 2,  # one row per column
        "operators/date_formats.py": 1,  # one row per column
        "sources/summaries.py": 1,  # one row per file
        "sources/results.py": 1,  # after the size check
    }
    for path in PACKAGE.rglob("*.py"):
        if path.parent.name == "llm":
            continue
        text, key = path.read_text(), str(path.relative_to(PACKAGE))
        assert len(re.findall(r"\.collect\(\)", text)) == allowed.get(key, 0), key
        for word in ("toPandas", "localCheckpoint", ".rdd", "foreach(", "crossJoin", "@udf", "pandas_udf", ".toLocalIterator"):
            assert word not in text, (key, word)
