"""Joins with a key that holds a third of all rows, with adaptive execution off."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import hot_keys
from tallyspark.operators.entity_store import EntityStore

N = 6000


@pytest.fixture()
def plain(spark):
    """No adaptive execution and no broadcast of small sides: what is dealt out is what the plan says."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    for key, value in held.items():
        spark.conf.set(key, value)


@pytest.fixture()
def relations(plain):
    hub = "CASE WHEN id % 3 = 0 THEN 'hub' WHEN id % 3 = 1 THEN concat('n', id % 50) ELSE NULL END"
    return plain.range(N).selectExpr(f"{hub} AS src", "concat('n', id) AS dst", "concat('t', id % 7) AS relation_type")


def largest_share(df) -> float:
    """Share of the rows in the largest partition that the last join leaves."""
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_names_the_hot_keys_alone(relations):
    assert hot_keys.hot_keys(relations, "src").first()["keys"] == ["hub"]
    assert hot_keys.hot_keys(relations, "dst").first()["keys"] == []
    assert hot_keys.hot_keys(relations.limit(0), "src").first()["keys"] == []


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_hot_rows_are_dealt_and_none_is_lost(plain, relations, how):
    names = plain.createDataFrame([("hub",), ("n1",), ("n4",), (None,), ("nobody",)], "name string")
    found = hot_keys.keep_known(relations, "src", names, how)
    assert found.columns == relations.columns
    want = relations.join(names, relations["src"] == names["name"], how)
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    assert largest_share(want) > 0.45 and largest_share(found) < 0.25


def test_store_reads_and_deletes_with_a_hub(plain, relations):
    entities = relations.select(F.col("dst").alias("name")).union(plain.createDataFrame([("hub",)], "name string"))
    store = EntityStore(
        entities.withColumn("entity_type", F.lit("kind")),
        plain.range(N).selectExpr("if(id % 3 = 0, 'hub', concat('n', id)) AS entity", "concat('seen ', id) AS observation"),
        relations.filter("src IS NOT NULL"),
    )
    some = plain.createDataFrame([("hub",), ("n3",), ("n6",), ("n7",), ("n1",)], "name string")
    opened = store.open_nodes(some)
    assert sorted(map(tuple, opened.relations.select("src", "dst").collect())) == [("hub", "n3"), ("hub", "n6"), ("n1", "n1"), ("n7", "n7")]
    assert opened.observations.count() == N // 3 + 2 and opened.entities.count() == 5
    left = store.delete_entities(plain.createDataFrame([("hub",)], "name string"))
    assert left.relations.count() == N // 3 and left.observations.count() == N - N // 3
    assert largest_share(store.open_nodes(entities.distinct()).relations) < 0.25
    dangling = store.dangling_relations(plain.range(N).selectExpr("'gone' AS src", "concat('n', id) AS dst", "'t' AS relation_type"))
    assert dangling.count() == N and largest_share(dangling) < 0.25
