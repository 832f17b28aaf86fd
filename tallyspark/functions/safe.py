"""Casts that never raise, division that never raises, and guarded aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as number text: decimal or scientific notation, NaN and infinities. Type suffixes
# such as "1d" and digit separators such as "1_000" stay text.
NUMBER_TEXT = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"
# What counts as ISO date text: year, month, day with one kind of separator, optional time part.
DATE_TEXT = r"^\s*(\d{4})([-/ ])(\d{1,2})\2(\d{1,2})(?:[T ]\d{1,2}:\d{2}.*|\s*)$"

NUMERIC_TYPES = (T.NumericType, T.BooleanType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def column(name: str) -> Column:
    """Reference a top-level column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def sql_text(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(number: float) -> str:
    """A SQL double literal, infinities included."""
    return f"double('{float(number)!r}')"


def as_number(value: Column, dtype: T.DataType) -> Column:
    """The value as a double, NULL when it is not a number."""
    if isinstance(dtype, T.BooleanType):
        return value.cast("int").cast("double")
    if isinstance(dtype, T.NumericType):
        return value.cast("double")
    if isinstance(dtype, T.StringType):
        # The first character rules most texts out before a long one is looked at.
        first = F.ascii(value)
        likely = (first <= ord("9")) | first.isin(*[ord(c) for c in "INin"])
        return F.when(likely & value.rlike(NUMBER_TEXT), F.trim(value).try_cast("double"))
    return F.lit(None).cast("double")


def as_date(value: Column, dtype: T.DataType) -> Column:
    """The value as a date, NULL when it is not a date."""
    if isinstance(dtype, T.DateType):
        return value
    if isinstance(dtype, DATE_TYPES):
        return value.cast("date")
    if isinstance(dtype, T.StringType):
        likely = F.ascii(value) <= ord("9")
        iso = F.regexp_replace(value, DATE_TEXT, "$1-$3-$4")
        return F.when(likely & value.rlike(DATE_TEXT), iso.try_cast("date"))
    return F.lit(None).cast("date")


def as_text(value: Column, dtype: T.DataType) -> Column:
    """The value as text such that two values are equal exactly when their texts are."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (value + F.lit(0.0).cast(dtype)).cast("string")  # -0.0 and 0.0 are one value
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as a double; NULL when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Like :func:`ratio`, but a zero denominator gives 0 (used by quality percentages)."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(ratio(numerator, denominator))


def rounded(value: Column | str, digits: int) -> Column:
    """Round the scaled binary value half away from zero, as SQL engines on doubles commonly do.

    Spark's own ``round`` goes through the shortest decimal text instead and so moves values such as
    1.005, which lie just below a half, up.
    """
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.round(value.cast("double") * scale) / scale


def money(value: Column | str) -> Column:
    """Round to currency precision."""
    return rounded(value, 2)


def guarded_sum(value: Column) -> Column:
    """Sum of a group, NULL for fewer than two values."""
    return F.when(F.count(value) >= 2, F.sum(value))


def guarded_mean(value: Column) -> Column:
    """Mean of a group, NULL for fewer than two values."""
    return F.when(F.count(value) >= 2, F.avg(value))


def guarded_array_sum(values: Column) -> Column:
    """Sum of an array column, NULL for fewer than two non-null values."""
    present = F.filter(values, lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return F.when(F.size(present) >= 2, total)


def guarded_array_mean(values: Column) -> Column:
    """Mean of an array column, NULL for fewer than two non-null values."""
    return ratio(guarded_array_sum(values), F.size(F.filter(values, lambda v: v.isNotNull())))


def signed_difference(first: Column, second: Column) -> Column:
    """second - first; equal numbers give NULL because there is no difference to report."""
    return F.when(first != second, second - first)


def absolute_difference(first: Column, second: Column) -> Column:
    return F.abs(first - second)
