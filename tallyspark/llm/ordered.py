"""Running sums over a whole table in a given order, and joins whose keys may be hot, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared import settled

#: Parts into which the rows of one key are dealt for a join.
SALTS = 32


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over a row and all rows before it.

    The rows are dealt by ranges of ``order``, summed within each range, and shifted by the totals of the ranges before;
    there is one total for each partition. ``order`` must tell all rows apart that differ.
    """
    ranged = settled(df.select("*", *(c.alias(f"_{name}") for name, c in sums.items())).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*(F.sum(f"_{name}").alias(f"_{name}") for name in sums))
    shifts = totals.select("_range", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}_before") for name in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select(*df.columns, "_range", *(F.sum(f"_{name}").over(inside).alias(f"_{name}") for name in sums))
    moved = summed.join(F.broadcast(shifts), "_range")
    return moved.select(*df.columns, *((F.col(f"_{name}") + F.col(f"_{name}_before")).alias(name) for name in sums))


def spread_join(rows: DataFrame, few: DataFrame, key: str, salt: Column, how: str = "inner") -> DataFrame:
    """Join each of ``rows`` with the one row of ``few`` with the same ``key`` (null equals null). The rows of a key are
    dealt by ``salt`` into parts, and the row of ``few`` is repeated for each part."""
    left = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    right = few.withColumnRenamed(key, "_key").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = left.join(right, (F.col("_salt") == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")), how)
    return joined.drop("_salt", "_part", "_key")


def div(a: Column, b: Column) -> Column:
    """The whole quotient of two longs that are not negative."""
    return ((a - a % b) / b).cast("long")
