"""Summaries of files: merged they equal the whole, and a grown folder reads its new files alone."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import summaries


def statistics(held):
    return {(r["table_name"], r["column_name"]): r for r in summaries.statistics(held).collect()}


@pytest.fixture()
def folder(spark, tmp_path):
    df = spark.range(1000).selectExpr(
        "id", "if(id % 4 = 0, NULL, 1e9 + id / 7) AS amount", "concat('name ', id % 50) AS name", "date_add(date'2020-01-01', int(id % 90)) AS day",
        "array(id, id + 1) AS pair",
    )
    df.repartition(5).write.parquet(str(tmp_path / "data" / "sales.parquet"))
    spark.range(10).selectExpr("id AS k", "cast(NULL AS string) AS `it's empty`").coalesce(1).write.parquet(str(tmp_path / "data" / "small.parquet"))
    return tmp_path, df


def test_merged_summaries_equal_the_whole(spark, folder):
    path, df = folder
    held = summaries.refresh(spark, str(path / "data"), str(path / "store"))
    assert held.filter("table_name = 'sales'").select("file").distinct().count() == 5
    found = statistics(held)
    amount = found[("sales", "amount")]
    want = df.agg(F.avg("amount"), F.stddev_samp("amount"), F.min("amount"), F.max("amount"), F.count("amount")).first()
    assert tuple(amount[c] for c in ("low", "high", "numbers")) == (want[2], want[3], want[4])
    assert amount["mean"] == pytest.approx(want[0], rel=1e-12) and amount["std_dev"] == pytest.approx(want[1], rel=1e-6)
    assert (amount["files"], amount["rows"], amount["missing"]) == (5, 1000, 250)
    name, day, pair = found[("sales", "name")], found[("sales", "day")], found[("sales", "pair")]
    assert name["unique_values"] == 50 and name["longest"] == 7 and name["numbers"] == 0 and name["mean"] is None
    assert (day["first_day"], day["last_day"]) == (dt.date(2020, 1, 1), dt.date(2020, 3, 30)) and pair["missing"] == 0
    empty = found[("small", "it's empty")]
    assert (empty["missing"], empty["unique_values"], empty["rows"]) == (10, 0, 10)


def test_a_grown_folder_reads_new_files_alone(spark, folder, monkeypatch):
    path, df = folder
    args = (spark, str(path / "data"), str(path / "store"))
    read, summarize = [], summaries.summarize
    monkeypatch.setattr(summaries, "summarize", lambda d: read.extend(d.inputFiles()) or summarize(d))
    before = statistics(summaries.refresh(*args))
    assert len(read) == 6
    read.clear()
    assert statistics(summaries.refresh(*args)) == before and not read
    df.withColumn("id", F.col("id") + 5000).coalesce(1).write.mode("append").parquet(str(path / "data" / "sales.parquet"))
    after = statistics(summaries.refresh(*args))
    assert len(read) == 1 and "sales.parquet" in read[0]
    grown = after[("sales", "id")]
    assert (grown["rows"], grown["high"], grown["files"]) == (2000, 5999, 6) and after[("small", "k")] == before[("small", "k")]
    gone = next(p for p in (path / "data" / "small.parquet").iterdir() if p.name.startswith("part"))
    gone.unlink()
    assert ("small", "k") not in statistics(summaries.refresh(*args))


def test_csv_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text("a,b\n1,2023-01-05\n2.5,\nx,2023-02-01\n")
    found = statistics(summaries.refresh(spark, str(tmp_path / "in"), str(tmp_path / "store"), ".csv"))
    assert (found[("t", "a")]["numbers"], found[("t", "a")]["mean"], found[("t", "b")]["missing"]) == (2, 1.75, 1)
    assert found[("t", "b")]["last_day"] == dt.date(2023, 2, 1)
