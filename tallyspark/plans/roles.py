"""The given tables seen in the roles the operators work on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.entity_store import EntityStore
from tallyspark.operators.hot_keys import spread
from tallyspark.operators.roles import Ledger, Period, Statuses


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


# -- contracts and transactions ----------------------------------------------------------------

CONTRACTS = """contracts AS (
  SELECT o_orderkey AS contract_id, o_custkey AS customer_id, o_orderpriority AS plan,
         CAST(o_orderdate AS DATE) AS start_date, o_totalprice AS contract_value,
         CASE WHEN o_orderstatus = 'O' THEN NULL
              ELSE CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 365 AS INT) END AS end_date
  FROM orders)"""
SEGMENTED = """contracts AS (
  SELECT o_orderkey AS contract_id, o_custkey AS customer_id, o_orderpriority AS plan, c_mktsegment AS segment,
         CAST(o_orderdate AS DATE) AS start_date, o_totalprice AS contract_value,
         CASE WHEN o_orderstatus = 'O' THEN NULL
              ELSE CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 365 AS INT) END AS end_date
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
TRANSACTIONS = """transactions AS (
  SELECT o_orderkey AS txn_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS txn_date, o_totalprice AS amount
  FROM orders)"""


def contracts(spark: SparkSession, folder: str) -> DataFrame:
    """One validity interval per order; orders of status O are still running."""
    start = F.col("o_orderdate").cast("date")
    days = (F.lit(30) + F.col("o_orderkey") % 365).cast("int")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("contract_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("plan"),
        start.alias("start_date"),
        F.col("o_totalprice").alias("contract_value"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(start, days)).alias("end_date"),
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """The market segment of each customer."""
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"))


def segmented_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts with the market segment of their customer; the rows of a customer with very many are dealt apart."""
    found, one = spread(contracts(spark, folder), "customer_id", segments(spark, folder), "customer")
    same = (found["customer_id"] == one["customer"]) & (found["_hot_salt"] == one["_hot_salt"])
    return found.join(one, same).select(*contracts(spark, folder).columns, "segment")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        F.col("o_totalprice").alias("amount"),
    )


def statuses(spark: SparkSession, folder: str) -> Statuses:
    return Statuses(contracts(spark, folder))


def ledger(spark: SparkSession, folder: str) -> Ledger:
    return Ledger(transactions(spark, folder))


JANUARY_1998 = Period("1998-01-01", "1998-01-31")
YEAR_1997 = Period("1997-01-01", "1997-12-31")
YEAR_1998 = Period("1998-01-01", "1998-12-31")

# -- line items as sales -----------------------------------------------------------------------


def gmv() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def commission() -> Column:
    return gmv() * F.col("l_tax")


def cost() -> Column:
    return F.col("l_extendedprice") * 0.7


def order_sales(spark: SparkSession, folder: str) -> DataFrame:
    """(l_orderkey, revenue, cost, commission) per order."""
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum(gmv()).alias("revenue"), F.sum(cost()).alias("cost"), F.sum(commission()).alias("commission"))
    )


# -- the entity store --------------------------------------------------------------------------

GRAPH = """entities AS (
  SELECT r_name AS name, 'region' AS entity_type FROM region
  UNION ALL SELECT n_name, 'nation' FROM nation
  UNION ALL SELECT s_name, 'supplier' FROM supplier
  UNION ALL SELECT c_name, 'customer' FROM customer),
relations AS (
  SELECT n_name AS src, r_name AS dst, 'in_region' AS relation_type
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, n_name, 'located_in' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_name, n_name, 'located_in' FROM customer JOIN nation ON c_nationkey = n_nationkey),
observations AS (
  SELECT DISTINCT s_name AS entity, p_type AS observation
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def graph(spark: SparkSession, folder: str) -> EntityStore:
    """Places, suppliers and customers as entities; bulk part types of a supplier as observations."""

    def named(name: str, column: str, kind: str) -> DataFrame:
        return table(spark, folder, name).select(F.col(column).alias("name"), F.lit(kind).alias("entity_type"))

    entities = (
        named("region", "r_name", "region")
        .unionByName(named("nation", "n_name", "nation"))
        .unionByName(named("supplier", "s_name", "supplier"))
        .unionByName(named("customer", "c_name", "customer"))
    )
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")

    def located(name: str, column: str, key: str) -> DataFrame:
        return (
            table(spark, folder, name)
            .join(nation, F.col(key) == F.col("n_nationkey"))
            .select(F.col(column).alias("src"), F.col("n_name").alias("dst"), F.lit("located_in").alias("relation_type"))
        )

    relations = (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.lit("in_region").alias("relation_type"))
        .unionByName(located("supplier", "s_name", "s_nationkey"))
        .unionByName(located("customer", "c_name", "c_nationkey"))
    )
    # Pairs first: repeated sales of a part by a supplier collapse before the two lookups.
    pairs = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    observations = (
        pairs.join(table(spark, folder, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .select("l_suppkey", "p_type")
        .distinct()
        .join(table(spark, folder, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("s_name").alias("entity"), F.col("p_type").alias("observation"))
        .distinct()
    )
    return EntityStore(entities, observations, relations)


def documents_store(spark: SparkSession, folder: str) -> EntityStore:
    """The graph with every document as an entity as well; the lines of its text are observations."""
    base = graph(spark, folder)
    documents = table(spark, folder, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("entity_type"), "text"
    )
    lines = documents.select(F.col("name").alias("entity"), F.explode(F.split("text", "\n")).alias("observation"))
    return EntityStore(
        base.entities.unionByName(documents.select("name", "entity_type")),
        base.observations.unionByName(lines),
        base.relations,
    )
