"""Full table profile: quality, types, statistics, distributions, top values, correlations.

Statistics come from column-pruned global aggregates, which shuffle one row per task. Only what
depends on distinct values shuffles values, pre-aggregated so that a value holding a third of all
rows costs one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.safe import (
    DATE_TYPES,
    NUMERIC_TYPES,
    as_date,
    as_number,
    as_text,
    column,
    ratio,
    ratio_or_zero,
    rounded,
    sql_double,
    sql_text,
)
from tallyspark.operators.long_format import Fields, Read, long_format
from tallyspark.operators.quantiles import exact_percentiles

# Result text around the number of distinct values.
TOO_MANY_VALUES = ("High cardinality (", " unique values) - analysis skipped")
# Thresholds of the profile.
TOP_VALUES = 50
TOP_VALUES_MAX_UNIQUE = 100
HIGH_CARDINALITY = 50
HISTOGRAM_BUCKETS = 10
HISTOGRAM_MIN_ROWS = 100
YEARLY_MIN_ROWS = 10
CORRELATION_MIN, CORRELATION_MODERATE, CORRELATION_STRONG = 0.1, 0.3, 0.7

# Columns handled by one aggregate. Small blocks keep the generated code small enough to be compiled to
# machine code; each block scans only its own columns, so no more bytes are read.
COLUMNS_PER_AGGREGATE = 4
CORRELATION_TILE = 8
SHORT_TEXT = 64

# SQL aggregates of one column: {raw} is the column itself, {num}, {day} and {text} its readings.
COUNTS = {"total_count": "count(1)", "non_null_count": "count({raw})"}
READABLE = COUNTS | {"numbers": "count({num})", "dates": "count({day})"}
MOMENTS = {"low": "min({v})", "high": "max({v})", "avg": "avg({v})", "var": "var_samp({v})"}
READINGS: dict[str, Read] = {
    "raw": lambda value, _: value,
    "num": as_number,
    "day": as_date,
    "text": as_text,
}
LOGICAL_TYPE = "CASE WHEN numbers > 0 THEN 'numeric' WHEN dates > 0 THEN 'datetime' ELSE 'categorical' END"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _blocks(fields: Fields) -> list[Fields]:
    return [fields[i : i + COLUMNS_PER_AGGREGATE] for i in range(0, len(fields), COLUMNS_PER_AGGREGATE)]


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def _as_rows(one_row: DataFrame, structs: list[str]) -> DataFrame:
    """A one-row aggregate spread over several rows."""
    return one_row.selectExpr(f"inline(array({', '.join(structs)}))")


def _family(dtype: T.DataType) -> str:
    """The type in which distinct values of a column are counted."""
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, (T.BooleanType, T.DecimalType, *DATE_TYPES)):
        return dtype.simpleString()
    return "string"


def _short(text: Column) -> Column:
    """A text of bounded size that identifies a text of any size."""
    digest = F.concat_ws(":", F.length(text).cast("string"), F.sha2(text.cast("binary"), 256))
    return F.when(F.length(text) > SHORT_TEXT, digest).otherwise(F.concat(F.lit("="), text))


@dataclass(eq=False)
class TableProfile:
    """Profile of any DataFrame; every method returns a DataFrame.

    Which text columns hold numbers, and the range of each numeric column, are looked up once and
    kept (one row per column), so that later passes read only the columns they concern.
    """

    df: DataFrame
    name: str = "table"
    approximate_distinct: bool = False
    #: How many values the top list shows, up to how many distinct ones it is made, and beyond how many a column is highly cardinal.
    top: int = TOP_VALUES
    list_up_to: int = TOP_VALUES_MAX_UNIQUE
    high_cardinality: int = HIGH_CARDINALITY

    # -- columns ---------------------------------------------------------------------------

    @property
    def fields(self) -> Fields:
        return list(self.df.schema.fields)

    @property
    def text_fields(self) -> Fields:
        return [f for f in self.fields if isinstance(f.dataType, T.StringType)]

    @property
    def untyped_fields(self) -> Fields:
        """Columns that are neither numbers nor dates by declaration."""
        return [f for f in self.fields if not isinstance(f.dataType, (*NUMERIC_TYPES, *DATE_TYPES))]

    @cached_property
    def _text_types(self) -> dict[str, str]:
        """Logical type of every text column."""
        if not self.text_fields:
            return {}
        rows = self.per_column(READABLE, self.text_fields).selectExpr("column_name", f"{LOGICAL_TYPE} AS kind")
        return {r["column_name"]: r["kind"] for r in rows.collect()}

    def fields_of(self, kind: str) -> Fields:
        """Columns of a logical type. Only text columns have to be looked at."""

        def logical(field: T.StructField) -> str:
            if isinstance(field.dataType, NUMERIC_TYPES):
                return "numeric"
            if isinstance(field.dataType, DATE_TYPES):
                return "datetime"
            return self._text_types.get(field.name, "categorical")

        return [f for f in self.fields if logical(f) == kind]

    @cached_property
    def _ranges(self) -> dict[str, Row]:
        """Counts, minimum, maximum and mean of every numeric column with a value."""
        fields = self.fields_of("numeric")
        if not fields:
            return {}
        finite = "CASE WHEN abs({num}) < double('Infinity') THEN {num} END"  # not so for NaN, which is above all numbers
        measures = COUNTS | {
            "n": "count({num})", "low": "min({num})", "high": "max({num})", "mean": "avg({num})",
            "finite_low": f"min({finite})", "finite_high": f"max({finite})",
        }
        return {r["column_name"]: r for r in self.per_column(measures, fields).collect() if r["n"] > 0}

    # -- shared aggregates -----------------------------------------------------------------

    def per_column(self, measures: dict[str, str], fields: Fields | None = None) -> DataFrame:
        """Global aggregates turned into one row per column.

        ``measures`` maps labels to SQL aggregates of {raw}, {num}, {day} or {text}. Wide tables are
        handled in blocks of columns: each block scans only its own columns.
        """
        used = [r for r in READINGS if any("{" + r + "}" in m for m in measures.values())]
        frames = []
        for block in _blocks(self.fields if fields is None else fields):
            readings = [
                READINGS[r](column(f.name), f.dataType).alias(f"{r}{i}") for i, f in enumerate(block) for r in used
            ]
            aggs, rows = [], []
            for i, field in enumerate(block):
                names = {r: f"{r}{i}" for r in READINGS}
                aggs += [f"{agg.format(**names)} AS {label}_{i}" for label, agg in measures.items()]
                rows.append(_struct(column_name=sql_text(field.name), **{label: f"{label}_{i}" for label in measures}))
            frames.append(_as_rows(self.df.select(*readings).selectExpr(*aggs), rows))
        return _union(frames)

    def value_frequencies(self, fields: Fields | None = None) -> DataFrame:
        """(column_name, value, n) for every distinct non-null value of every column, as text."""
        long = long_format(self.df, self.fields if fields is None else fields, as_text, "value")
        return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))

    def cardinalities(self, fields: Fields | None = None) -> DataFrame:
        """(column_name, non_null_count, unique_count): exact, or within sketch error when asked for.

        Columns of one type are counted together in that type, which keeps the rows that move small;
        long texts stand in by length and SHA-256 digest. Both counts come from the same pass.
        """
        fields = self.fields if fields is None else fields
        if self.approximate_distinct:
            measures = {"non_null_count": "count({raw})", "unique_count": "approx_count_distinct({text})"}
            return self.per_column(measures, fields)
        families: dict[str, Fields] = {}
        for field in fields:
            families.setdefault(_family(field.dataType), []).append(field)
        counts = []
        for family, members in families.items():

            def read(value: Column, dtype: T.DataType, family: str = family) -> Column:
                return _short(as_text(value, dtype)) if family == "string" else value.cast(family)

            values = long_format(self.df, members, read, "value").groupBy("column_name", "value").count()
            counts.append(values.groupBy("column_name").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("u")))
        # Columns without any value have no counts; the list of names brings them back.
        names = self.df.sparkSession.sql(f"SELECT inline(array({', '.join(_struct(column_name=sql_text(f.name)) for f in fields)}))")
        return names.join(F.broadcast(_union(counts)), "column_name", "left").selectExpr(
            "column_name", "coalesce(n, 0L) AS non_null_count", "coalesce(u, 0L) AS unique_count"
        )

    def _nothing(self, schema: str) -> DataFrame:
        return self.df.sparkSession.createDataFrame([], schema)

    # -- table level -----------------------------------------------------------------------

    def summary(self) -> DataFrame:
        """Rows, columns and whether there was anything to analyse."""
        return self.df.selectExpr(
            f"{sql_text(self.name)} AS table_name",
            "count(1) AS total_rows",
            f"CASE WHEN count(1) > 0 THEN {len(self.fields)}L ELSE 0L END AS total_columns",
            "CASE WHEN count(1) > 0 THEN 'analyzed' ELSE 'empty_file' END AS status",
            "current_timestamp() AS analysis_timestamp",
        )

    def overall(self) -> DataFrame:
        """Cell completeness and how many columns there are of each logical type."""
        per_column = self.per_column(READABLE).selectExpr("*", f"{LOGICAL_TYPE} AS kind")
        total, present = F.sum("total_count"), F.sum("non_null_count")
        kinds = [
            F.count_if(F.col("kind") == kind).alias(f"{kind}_columns") for kind in ("numeric", "categorical", "datetime")
        ]
        return per_column.agg(
            total.alias("total_cells"),
            (total - present).alias("missing_cells"),
            rounded(ratio_or_zero(present * 100, total), 2).alias("overall_completeness"),
            *kinds,
        )

    # -- column level ----------------------------------------------------------------------

    def quality(self) -> DataFrame:
        """Missing and distinct counts of each column with their percentages."""
        rows = self.cardinalities().withColumn("total_count", self.df.agg(F.count(F.lit(1))).scalar())
        total, present, unique = F.col("total_count"), F.col("non_null_count"), F.col("unique_count")
        return rows.select(
            "column_name",
            total,
            present,
            (total - present).alias("missing_count"),
            rounded(ratio_or_zero((total - present) * 100, total), 2).alias("missing_percentage"),
            rounded(ratio_or_zero(present * 100, total), 2).alias("completeness_percentage"),
            unique,
            rounded(ratio_or_zero(unique * 100, present), 2).alias("uniqueness_percentage"),
            rounded(ratio_or_zero(unique, present), 4).alias("cardinality_ratio"),
        )

    def types(self) -> DataFrame:
        """Logical type of each column, with the share of values that read as a number or date.

        One readable value makes the column numeric (or datetime); the parse rate says how much
        of the column really is.
        """
        declared = F.create_map(*[F.lit(x) for f in self.fields for x in (f.name, f.dataType.simpleString())])
        readable = F.when(F.col("numbers") > 0, F.col("numbers")).when(F.col("dates") > 0, F.col("dates"))
        return self.per_column(READABLE).select(
            F.lit(self.name).alias("table_name"),
            "column_name",
            F.element_at(declared, F.col("column_name")).alias("original_dtype"),
            F.expr(LOGICAL_TYPE).alias("inferred_best_dtype"),
            "non_null_count",
            rounded(ratio(readable, F.col("non_null_count")), 4).alias("parse_rate"),
        )

    def string_stats(self) -> DataFrame:
        """Shortest, longest and average text length of categorical columns."""
        lengths = {"low": "min(length({text}))", "high": "max(length({text}))", "mean": "avg(length({text}))"}
        if not self.untyped_fields:
            return self._nothing("column_name string, min_length long, max_length long, avg_length double")
        rows = self.per_column(READABLE | lengths, self.untyped_fields)
        return rows.filter("numbers = 0 AND dates = 0 AND low IS NOT NULL").select(
            "column_name",
            F.col("low").cast("long").alias("min_length"),
            F.col("high").cast("long").alias("max_length"),
            rounded("mean", 1).alias("avg_length"),
        )

    def numeric_stats(self) -> DataFrame:
        """Moments and exact percentiles of every column with at least one number."""
        stats = {
            "min": "low",
            "max": "high",
            "mean": "avg",
            "median": "p2",
            "std_dev": "sqrt(var)",
            "variance": "var",
            "range": "high - low",
            "p5": "p0",
            "q1": "p1",
            "q3": "p3",
            "p95": "p4",
            "iqr": "p3 - p1",
            "coefficient_of_variation": "try_divide(sqrt(var), avg)",
        }
        fields = self.fields_of("numeric")
        if not fields:
            return self._nothing("column_name string, " + ", ".join(f"{label} double" for label in stats))
        values = {f.name: as_number(column(f.name), f.dataType) for f in fields}
        found = exact_percentiles(self.df, values, [0.05, 0.25, 0.5, 0.75, 0.95], MOMENTS).filter("n > 0")
        return found.select("column_name", *[rounded(F.expr(value), 3).alias(label) for label, value in stats.items()])

    def histogram(self) -> DataFrame:
        """Ten equal-width buckets per numeric column over its finite values; their maximum sits in bucket eleven.

        The ranges are known, so each bucket is one conditional count and nothing is shuffled but the
        counts. A column with a single finite value has one bucket. Negative infinity is bucket 0, infinity 12, NaN 13.
        """
        known = self._ranges
        fields = [f for f in self.fields_of("numeric") if f.name in known]
        fields = [f for f in fields if known[f.name]["non_null_count"] > HISTOGRAM_MIN_ROWS]
        frames = []
        for block in _blocks(fields):
            placed = self.df.select(*[as_number(column(f.name), f.dataType).alias(f"v{i}") for i, f in enumerate(block)])
            buckets = [self._bucket(f"v{i}", f.name) + f" AS b{i}" for i, f in enumerate(block)]
            cells = [(i, f, k) for i, f in enumerate(block) for k in range(HISTOGRAM_BUCKETS + 4)]
            counts = placed.selectExpr(*buckets).selectExpr(*[f"count_if(b{i} = {k}) AS n{i}_{k}" for i, _, k in cells])
            rows = [_struct(column_name=sql_text(f.name), bucket=f"{k}L", frequency=f"n{i}_{k}") for i, f, k in cells]
            frames.append(_as_rows(counts, rows).filter("frequency > 0"))
        if not frames:
            return self._nothing("column_name string, bucket long, frequency long")
        return _union(frames)

    def _bucket(self, value: str, name: str) -> str:
        low, high = self._ranges[name]["finite_low"], self._ranges[name]["finite_high"]
        spread = low is not None and low < high
        finite = f"width_bucket({value}, {sql_double(low)}, {sql_double(high)}, {HISTOGRAM_BUCKETS})" if spread else "1L"
        return (
            f"CASE WHEN isnan({value}) THEN {HISTOGRAM_BUCKETS + 3}L WHEN {value} = double('Infinity') THEN {HISTOGRAM_BUCKETS + 2}L "
            f"WHEN {value} = -double('Infinity') THEN 0L WHEN {value} IS NOT NULL THEN {finite} END"
        )

    def datetime_stats(self) -> DataFrame:
        """First and last day of each datetime column and the days between them."""
        fields = self.fields_of("datetime")
        if not fields:
            return self._nothing("column_name string, min_date date, max_date date, date_range_days long")
        rows = self.per_column({"min_date": "min({day})", "max_date": "max({day})"}, fields)
        return rows.selectExpr("*", "bigint(datediff(max_date, min_date)) AS date_range_days")

    def yearly(self) -> DataFrame:
        """Rows per year of each datetime column with more than ten values."""
        fields = self.fields_of("datetime")
        if not fields:
            return self._nothing("column_name string, year long, count long")
        years = long_format(self.df, fields, lambda v, t: F.year(as_date(v, t)).cast("long"), "year")
        per_year = years.groupBy("column_name", "year").count()
        enough = self.per_column(COUNTS, fields).filter(F.col("non_null_count") > YEARLY_MIN_ROWS)
        return per_year.join(F.broadcast(enough.select("column_name")), "column_name", "left_semi")

    def _categorical_counts(self) -> DataFrame:
        """(column_name, non_null_count, unique_count) per categorical column."""
        fields = self.fields_of("categorical")
        if not fields:
            return self._nothing("column_name string, non_null_count long, unique_count long")
        return self.cardinalities(fields)

    @cached_property
    def _few_valued(self) -> dict[str, int]:
        """Non-null counts of the categorical columns with few enough distinct values to list."""
        few = self._categorical_counts().filter(F.col("unique_count").between(1, self.list_up_to))
        return {r["column_name"]: r["non_null_count"] for r in few.collect()}

    def top_values(self) -> DataFrame:
        """The ``top`` most frequent values of categorical columns with at most ``list_up_to`` distinct ones.

        Only those columns are grouped by value, so at most ``list_up_to`` rows per column and task move.
        """
        few = self._few_valued
        if not few:
            return self._nothing("column_name string, value string, count long, percentage double, rank long")
        frequencies = self.value_frequencies([f for f in self.fields if f.name in few])
        present = F.element_at(F.create_map(*[F.lit(x) for pair in few.items() for x in pair]), F.col("column_name"))
        ranked = frequencies.selectExpr(
            "*", "bigint(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value)) AS rank"
        )
        return ranked.filter(F.col("rank") <= self.top).select(
            "column_name",
            "value",
            F.col("n").alias("count"),
            rounded(ratio(F.col("n") * 100, present), 2).alias("percentage"),
            "rank",
        )

    def top_values_json(self) -> DataFrame:
        """The top values of each column as one JSON object, most frequent first."""
        entries = F.sort_array(F.collect_list(F.struct("rank", "value", "count")))  # at most ``top`` entries
        pairs = F.transform(entries, lambda e: F.struct(e["value"], e["count"]))
        return (
            self.top_values()
            .groupBy("column_name")
            .agg(F.to_json(F.map_from_entries(pairs)).alias("top_values_json"))
        )

    def categorical_notes(self) -> DataFrame:
        """Cardinality verdict per categorical column."""
        counts = self._categorical_counts()
        unique = F.col("unique_count")
        skipped = (unique > self.list_up_to) | (unique == 0)
        note = F.concat(F.lit(TOO_MANY_VALUES[0]), unique.cast("string"), F.lit(TOO_MANY_VALUES[1]))
        return counts.select(
            "column_name",
            unique.alias("unique_values"),
            (skipped | (unique > self.high_cardinality)).alias("is_high_cardinality"),
            F.when(skipped, note).alias("note"),
        )

    def flags(self) -> DataFrame:
        """One row per raised quality flag."""
        total, present, missing = F.col("total_count"), F.col("non_null_count"), F.col("missing_count")
        unique = F.col("unique_count")
        raised = F.array_compact(
            F.array(
                F.when(ratio(missing, total) > 0.5, "high_missing_rate"),
                F.when((unique == 1) & (missing == 0), "constant_value"),
                F.when((unique == total) & (missing == 0) & (total > 0), "unique_identifier"),
                F.when((ratio(unique, present) > 0.95) & (present > 10), "near_unique"),
            )
        )
        return self.quality().select("column_name", F.explode(raised).alias("flag"))

    def correlations(self) -> DataFrame:
        """Pearson correlation of numeric column pairs above the reporting threshold.

        Pairs are computed in tiles of columns, so one aggregate reads at most two tiles of
        columns whatever the width of the table. Constant columns correlate with nothing.
        """
        known = self._ranges
        fields = [f for f in self.fields_of("numeric") if f.name in known and known[f.name]["low"] != known[f.name]["high"]]
        tiles = [fields[i : i + CORRELATION_TILE] for i in range(0, len(fields), CORRELATION_TILE)]
        order = {f.name: i for i, f in enumerate(fields)}
        frames = []
        for a, left in enumerate(tiles):
            for right in tiles[a:]:
                pairs = [(x, y) for x in left for y in right if order[x.name] < order[y.name]]
                if pairs:
                    frames.append(self._tile_correlations(pairs))
        if not frames:
            return self._nothing("column1 string, column2 string, correlation double, strength string")
        r = F.abs("r")
        strength = F.when(r > CORRELATION_STRONG, "strong").when(r > CORRELATION_MODERATE, "moderate").otherwise("weak")
        shown = _union(frames).filter((r > CORRELATION_MIN) & ~F.isnan("r"))
        return shown.select("column1", "column2", rounded("r", 3).alias("correlation"), strength.alias("strength"))

    def _tile_correlations(self, pairs: list[tuple[T.StructField, T.StructField]]) -> DataFrame:
        """r of each pair in one aggregate.

        Two columns without missing numbers need only the products of their deviations from the known
        means. A pair with missing numbers is reduced to the rows that have both.
        """
        members = {f.name: f for pair in pairs for f in pair}
        place = {name: i for i, name in enumerate(members)}
        full = {name for name in members if self._ranges[name]["n"] == self._ranges[name]["total_count"]}
        deviations = [
            (as_number(column(n), f.dataType) - F.lit(self._ranges[n]["mean"])).alias(f"d{i}")
            for i, (n, f) in enumerate(members.items())
        ]
        aggs = [f"sum(d{i} * d{i}) AS q{i}" for i in place.values()]
        rows = []
        for k, (x, y) in enumerate(pairs):
            a, b = place[x.name], place[y.name]
            if x.name in full and y.name in full:
                aggs.append(f"sum(d{a} * d{b}) AS c{k}")
                r = f"try_divide(c{k}, sqrt(q{a}) * sqrt(q{b}))"
            else:
                da, db = f"CASE WHEN d{b} IS NOT NULL THEN d{a} END", f"CASE WHEN d{a} IS NOT NULL THEN d{b} END"
                aggs += [f"covar_pop({da}, {db}) AS c{k}", f"stddev_pop({da}) AS x{k}", f"stddev_pop({db}) AS y{k}"]
                r = f"try_divide(c{k}, x{k} * y{k})"
            rows.append(_struct(column1=sql_text(x.name), column2=sql_text(y.name), r=r))
        return _as_rows(self.df.select(*deviations).selectExpr(*aggs), rows)

    # -- whole profile ---------------------------------------------------------------------

    def report(self) -> dict[str, DataFrame]:
        """Every part of the profile by name."""
        return {
            "summary": self.summary(),
            "quality": self.quality(),
            "types": self.types(),
            "numeric_stats": self.numeric_stats(),
            "histogram": self.histogram(),
            "datetime_stats": self.datetime_stats(),
            "yearly": self.yearly(),
            "string_stats": self.string_stats(),
            "top_values": self.top_values(),
            "top_values_json": self.top_values_json(),
            "categorical_notes": self.categorical_notes(),
            "flags": self.flags(),
            "correlations": self.correlations(),
            "overall": self.overall(),
        }


def fallback_profile(text_table: DataFrame, name: str = "table") -> DataFrame:
    """Reduced profile for a table read without type inference.

    Basic type and moments need every value of a column to read as a number.
    """
    profile = TableProfile(text_table, name)
    stats = {"low": "min({num})", "high": "max({num})", "avg": "avg({num})", "sd": "stddev_samp({num})"}
    # One row per column on either side.
    uniques = profile.cardinalities().select("column_name", "unique_count")
    rows = profile.per_column(READABLE | stats).join(F.broadcast(uniques), "column_name")
    present = F.col("non_null_count")
    numeric = (present > 0) & (F.col("numbers") == present)
    dated = (present > 0) & (F.col("dates") == present)
    return rows.select(
        "column_name",
        "total_count",
        present,
        (F.col("total_count") - present).alias("missing_count"),
        "unique_count",
        F.when(numeric, "numeric").when(dated, "datetime").otherwise("categorical").alias("inferred_best_dtype"),
        *[
            F.when(numeric, rounded(value, 3)).alias(label)
            for value, label in (("low", "min"), ("high", "max"), ("avg", "mean"), ("sd", "std_dev"))
        ],
    )
