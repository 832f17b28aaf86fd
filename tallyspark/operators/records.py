"""Latest records, lookups, reshaping and lineage of query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_records(df: DataFrame, key: str, start: str, *, tie_break: str | None = None) -> DataFrame:
    """Records with the latest ``start`` per key.

    Ties are all kept unless ``tie_break`` names a column whose highest value decides. Each task
    drops everything but its own latest records before the shuffle, so long histories do not move.
    """
    latest_first = [F.col(start).desc_nulls_last()]
    if tie_break:
        latest_first.append(F.col(tie_break).desc_nulls_last())
    position = F.row_number() if tie_break else F.rank()
    ranked = df.withColumn("_rank", position.over(W.partitionBy(key).orderBy(*latest_first)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def lookup(left: DataFrame, key: Column, right: DataFrame, right_key: str, value: str) -> DataFrame:
    """Left rows with the first matching value of the right table, NULL without a match.

    "First" is the smallest value when a key occurs more than once. Whether the lookup side is
    broadcast is left to the size check of the optimizer.
    """
    first = right.groupBy(F.col(right_key).alias("_key")).agg(F.min(value).alias(value))
    return left.join(first, key == F.col("_key"), "left").drop("_key")


def pivot_sum(df: DataFrame, row: str, column: str, values: list, amount: str, prefix: str = "") -> DataFrame:
    """Sums of ``amount`` with one output column per listed value."""
    wide = df.groupBy(row).pivot(column, values).agg(F.sum(amount))
    return wide.select(row, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def unpivot(df: DataFrame, ids: list[str], measures: list[str], name: str, value: str) -> DataFrame:
    """One row per measure column."""
    return df.unpivot(ids, measures, name, value)


def source_paths(sql: Column) -> Column:
    """The CSV paths a query text reads, single or listed, in order of appearance."""
    arguments = F.regexp_extract_all(
        sql, F.lit(r"(?i)read_csv\(\s*('[^']*\.csv'|\[[^\]]*\])\s*\)"), F.lit(1)
    )
    each = F.transform(arguments, lambda a: F.regexp_extract_all(a, F.lit(r"(?i)'([^']*\.csv)'"), F.lit(1)))
    return F.flatten(each)


def source_lineage(queries: DataFrame, sql: str) -> DataFrame:
    """How many queries read each path."""
    paths = queries.select(F.explode(F.array_distinct(source_paths(F.col(sql)))).alias("path"))
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("n_queries"))
