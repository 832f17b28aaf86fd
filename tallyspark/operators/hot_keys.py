"""Joins on keys of which a few may hold a large share of all rows.

A bounded counter sketch names the keys that hold more than one in ``KEYS`` rows; there are fewer than ``KEYS`` of them. Their rows are dealt by a salt
against copies of the one row of the other side that has the key; all other rows are joined plainly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.safe import column

#: A key is hot if more than one in so many rows has it.
KEYS = 64
#: Counters of the sketch: it misses no key above one in so many rows.
COUNTERS = 1024
#: Parts into which the rows of a hot key are dealt.
SALTS = 32
_SALT = "_hot_salt"


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """One row with one array, ``keys``: the keys that more than one in ``KEYS`` rows has, NULL left out."""
    found = rows.agg(F.expr(f"approx_top_k(`{key}`, {KEYS}, {COUNTERS})").alias("top"), F.count(F.lit(1)).alias("n"))
    hot = F.filter("top", lambda t: (t["count"] * KEYS > F.col("n")) & t["item"].isNotNull())
    return found.select(F.transform(hot, lambda t: t["item"]).alias("keys"))


def spread(rows: DataFrame, key: str, few: DataFrame, few_key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column more, ``_hot_salt``, to be joined on the keys and this column: it deals the rows of a hot key, and
    the rows without a key, into parts, and repeats the rows of ``few`` that have a hot key for each part."""
    keys = hot_keys(rows, key).scalar()
    plain = [column(f.name) for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    part = F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int")
    hot = column(key).isNull() | F.array_contains(keys, column(key))
    every = F.when(F.array_contains(keys, column(few_key)), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn(_SALT, F.when(hot, part).otherwise(0)), few.withColumn(_SALT, F.explode(every))


def keep_known(rows: DataFrame, key: str, names: DataFrame, how: str = "left_semi", name: str = "name") -> DataFrame:
    """Rows whose ``key`` is among ``names`` (distinct), or with ``left_anti`` those whose is not."""
    left, right = spread(rows, key, names.select(column(name).alias("_known")), "_known")
    same = [left[_SALT] == right[_SALT], left[key] == right["_known"]]
    return left.join(right, reduce(Column.__and__, same), how).drop(_SALT)
