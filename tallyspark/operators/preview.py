"""Light table preview: stricter type inference than the full profile, fewer statistics.

All values of a text column must read as numbers, or all as dates of one format, before the column is called numeric or
datetime; one aggregate over all rows tells, and no text is moved.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyspark.functions.dates import DATE_FORMATS
from tallyspark.functions.safe import DATE_TYPES, as_date, as_number, as_text, column, ratio, rounded
from tallyspark.operators.date_formats import day_counts, read_day
from tallyspark.operators.long_format import long_format
from tallyspark.operators.profile import COUNTS, MOMENTS, TableProfile
from tallyspark.operators.quantiles import exact_percentiles

# Result texts.
MOSTLY_UNIQUE = "High cardinality or mostly unique string values. Not showing top N."
ALL_EMPTY = "Column is entirely empty (all NaN)."
# Preview limits.
TOP_VALUES = 5
MAX_UNIQUE_SHARE = 0.8
HIGH_CARDINALITY, HIGH_CARDINALITY_SHARE = 50, 0.1


@dataclass(frozen=True)
class TablePreview:
    """Preview of any DataFrame, with the ``top`` most frequent values. Every method returns a DataFrame."""

    df: DataFrame
    top: int = TOP_VALUES

    @property
    def _profile(self) -> TableProfile:
        return TableProfile(self.df)

    @property
    def _text_fields(self) -> list[T.StructField]:
        return [f for f in self.df.schema.fields if isinstance(f.dataType, T.StringType)]

    def shape(self) -> DataFrame:
        rows, width = F.count(F.lit(1)), F.lit(len(self.df.columns)).cast("long")
        return self.df.agg(
            rows.alias("total_rows"),
            F.when(rows > 0, width).otherwise(F.lit(0).cast("long")).alias("total_columns"),
            F.when(rows == 0, "DataFrame is empty.").alias("notes"),
        )

    def missing(self) -> DataFrame:
        """Missing values and distinct non-null values per column."""
        return self._profile.quality().select(
            "column_name",
            F.col("missing_count").alias("missing_values_count"),
            F.col("missing_percentage").alias("missing_values_percentage"),
            F.col("unique_count").alias("unique_values_count"),
        )

    def types(self) -> DataFrame:
        """(column_name, original_dtype, inferred_best_dtype)."""
        declared = self._declared()
        if not self._text_fields:
            return declared
        value = F.col("value")
        names = [f.name for f in self._text_fields]
        counts = day_counts(
            self.df, names, as_text, numbers=as_number(value, T.StringType()), iso_days=as_date(value, T.StringType())
        )
        n = F.sum("n")
        dates = [F.sum(F.when(read_day(f).isNotNull(), F.col("n")).otherwise(0)) == n for f, _ in DATE_FORMATS]
        one_format = F.sum("iso_days") == n
        for date in dates:
            one_format = one_format | date
        verdict = (
            F.when(F.sum("numbers") == n, "numeric (inferred from object)")
            .when(one_format, "datetime (inferred from object)")
            .otherwise("categorical/string (inferred from object)")
        )
        decided = counts.groupBy("column_name").agg(verdict.alias("verdict"))  # one row per column
        return declared.join(F.broadcast(decided), "column_name", "left").select(
            "column_name", "original_dtype", F.coalesce("verdict", "inferred_best_dtype").alias("inferred_best_dtype")
        )

    def _declared(self) -> DataFrame:
        """Schema facts as rows, one per column, over a one-row aggregate of the table."""

        def label(dtype: T.DataType) -> str:
            if isinstance(dtype, T.BooleanType):
                return "boolean"
            if isinstance(dtype, T.NumericType):
                return "numeric"
            return "datetime" if isinstance(dtype, DATE_TYPES) else dtype.simpleString()

        rows = F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("original_dtype"),
                    F.lit(label(f.dataType)).alias("inferred_best_dtype"),
                )
                for f in self.df.schema.fields
            ]
        )
        return self.df.agg(F.count(F.lit(1)).alias("_rows")).select(F.inline(rows))

    @cached_property
    def _kinds(self) -> dict[str, str]:
        """Column to its inferred type; found once for all methods."""
        return {r["column_name"]: r["inferred_best_dtype"] for r in self.types().collect()}

    def _fields_of_kind(self, kind: str) -> list[T.StructField]:
        return [f for f in self.df.schema.fields if self._kinds[f.name].startswith(kind)]

    def numeric(self) -> DataFrame:
        """Mean, deviation, extremes and quartiles of numeric columns; unreadable values are left out."""
        fields = self._fields_of_kind("numeric")
        if not fields:
            return self.df.sparkSession.createDataFrame(
                [],
                "column_name string, mean double, std_dev double, min double, percentile_25 double, median double, "
                "percentile_75 double, max double",
            )
        values = {f.name: as_number(column(f.name), f.dataType) for f in fields}
        stats = exact_percentiles(self.df, values, [0.25, 0.5, 0.75], MOMENTS).filter(F.col("n") > 0)
        return stats.select(
            "column_name",
            rounded("avg", 3).alias("mean"),
            rounded(F.sqrt("var"), 3).alias("std_dev"),
            rounded("low", 3).alias("min"),
            rounded("p0", 3).alias("percentile_25"),
            rounded("p1", 3).alias("median"),
            rounded("p2", 3).alias("percentile_75"),
            rounded("high", 3).alias("max"),
        )

    def datetime(self) -> DataFrame:
        """First and last day of datetime columns (ISO texts and date types)."""
        days = long_format(self.df, self._fields_of_kind("datetime"), as_date, "day")
        return days.groupBy("column_name").agg(F.min("day").alias("min_date"), F.max("day").alias("max_date"))

    def boolean(self) -> DataFrame:
        """Counts of true and false per boolean column."""
        fields = [f for f in self.df.schema.fields if isinstance(f.dataType, T.BooleanType)]
        long = long_format(self.df, fields, lambda v, _: v.cast("boolean"), "value")
        return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))

    def _cardinality(self) -> DataFrame:
        """Row and distinct counts per categorical column; long texts are counted by their digests."""
        total = self.df.agg(F.count(F.lit(1))).scalar()
        fields = self._fields_of_kind("categorical")
        if not fields:
            nothing = self.df.sparkSession.createDataFrame([], "column_name string, unique_count long")
            return nothing.withColumn("total_rows", total)
        uniques = self._profile.cardinalities(fields).select("column_name", "unique_count")
        return uniques.withColumn("total_rows", total)

    def top_values(self) -> DataFrame:
        """Most frequent values of categorical columns that are not mostly unique; only their texts are moved."""
        shown = self._cardinality().filter(F.col("unique_count") <= F.col("total_rows") * MAX_UNIQUE_SHARE)
        found = {r["column_name"]: r for r in shown.collect()}
        fields = [f for f in self._text_fields if f.name in found]
        frequencies = self._profile.value_frequencies(fields)
        shown = self.df.sparkSession.createDataFrame(list(found.values()), shown.schema)
        order = W.partitionBy("column_name").orderBy(F.desc("n"), "value")
        ranked = frequencies.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.top)
        return ranked.join(F.broadcast(shown), "column_name").select(
            "column_name",
            "value",
            F.col("n").alias("count"),
            F.col("rank").cast("long").alias("rank"),
            self._highly_cardinal().alias("is_highly_cardinal"),
        )

    @staticmethod
    def _highly_cardinal() -> Column:
        unique, rows = F.col("unique_count"), F.col("total_rows")
        return (unique > HIGH_CARDINALITY) & (ratio(unique, rows) > HIGH_CARDINALITY_SHARE)

    def notes(self) -> DataFrame:
        """Columns without a top list: mostly unique texts, and columns that are entirely empty."""
        counts = self._cardinality()
        unique_texts = counts.filter(F.col("unique_count") > F.col("total_rows") * MAX_UNIQUE_SHARE).select(
            "column_name",
            F.lit(MOSTLY_UNIQUE).alias("note"),
        )
        empty = (
            self._profile.per_column(COUNTS)
            .filter("non_null_count = 0 AND total_count > 0")
            .select("column_name", F.lit(ALL_EMPTY).alias("note"))
        )
        return unique_texts.unionByName(empty)
