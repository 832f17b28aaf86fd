"""One row per column value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.safe import column

Fields = list[T.StructField]
Read = Callable[[Column, T.DataType], Column]


def long_format(df: DataFrame, fields: Fields, read: Read, value: str) -> DataFrame:
    """(column_name, value) for every non-null value ``read(column, dtype)`` of the given columns."""
    if not fields:
        nothing = read(F.lit(None).cast("string"), T.StringType())
        return df.limit(0).select(F.lit("").alias("column_name"), nothing.alias(value))
    wide = df.select(*[read(column(f.name), f.dataType).alias(f.name) for f in fields])
    names = [column(f.name) for f in fields]
    return wide.unpivot([], names, "column_name", value).filter(F.col(value).isNotNull())
