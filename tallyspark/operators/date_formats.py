"""Which date format a text column is written in, and casts built from the answer.

Formats are decided over all rows, in one scan. A text that has the shape of a date is cut into its day and its kind of clock
time, whose digits the shape has checked; all other texts are only counted. Equal days are counted in every task, so the formats are tried once
for each day that occurs in a column, and neither a text nor a row for each value is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyspark.functions.dates import DATE_FORMATS, STRICT_FORMATS, day_and_clock, parse_date, parse_tidy, split_format, tidy
from tallyspark.functions.safe import as_date, column, rounded
from tallyspark.operators.long_format import Read, long_format
from tallyspark.operators.profile import TableProfile

# How many dates a report shows, and the share of a column that must parse.
SHOWN = 5
MIN_SUCCESS = 0.8
# Shown dates are the earliest of this many hash classes of texts.
CLASSES = 16


def _text_fields(columns: list[str]) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in columns]


def _as_it_is(value: Column, dtype: T.DataType) -> Column:
    return value.cast("string")


def day_counts(df: DataFrame, columns: list[str], read: Read = _as_it_is, **more: Column) -> DataFrame:
    """(column_name, day, clock, blank, n) over all non-null texts: how many have that day and kind of clock time.

    Texts without the shape of a date have a NULL day; ``blank`` tells which of them hold nothing. ``more`` counts the rows
    where an expression over ``value`` is not NULL, under the given names.
    """
    long = long_format(df, _text_fields(columns), read, "value")
    day, clock = day_and_clock(F.col("tidy"))
    parts = long.withColumn("tidy", tidy(F.col("value"))).select(
        "column_name", day.alias("day"), clock.alias("clock"), (F.col("tidy") == "").alias("blank"),
        *(c.alias(name) for name, c in more.items()),
    )
    counts = [F.count(F.lit(1)).alias("n"), *(F.count(name).alias(name) for name in more)]
    return parts.groupBy("column_name", "day", "clock", "blank").agg(*counts)


def read_day(fmt: str) -> Column:
    """The day and clock of :func:`day_counts` read by a format."""
    of_day, of_clock = split_format(fmt)
    return F.when(F.col("clock") == of_clock, parse_tidy(F.col("day"), of_day)).cast("date")


def _facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, total, tested, position, date_format, parsed, min_date, max_date, shown) for every format that reads
    any row; ``tested`` leaves blank texts out. A column that none reads has one row without a format."""
    formats = [f for f, _ in DATE_FORMATS]
    tried = [F.struct(F.lit(i).alias("position"), read_day(f).alias("date")) for i, f in enumerate(formats)]
    every = F.struct(F.lit(-1).alias("position"), F.lit(None).cast("date").alias("date"))
    read = F.filter(F.array(*tried), lambda t: t["date"].isNotNull())
    rows = day_counts(df, columns).select("column_name", "day", "blank", "n", F.inline(F.concat(F.array(every), read)))
    of_class = [F.min(F.when(F.pmod(F.xxhash64("day"), F.lit(CLASSES)) == k, F.col("date"))) for k in range(CLASSES)]
    sums = rows.groupBy("column_name", "position").agg(
        F.sum("n").alias("parsed"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n"))).alias("filled"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.slice(F.array_sort(F.array_compact(F.array(*of_class))), 1, SHOWN).alias("shown"),
    )
    # at most one row per known format, and one with the totals, reaches this window
    whole = W.partitionBy("column_name")
    total, tested = (F.max(F.when(F.col("position") == -1, F.col(c))).over(whole) for c in ("parsed", "filled"))
    found = sums.select("*", total.alias("total"), tested.alias("tested"), F.count(F.lit(1)).over(whole).alias("_rows"))
    names = F.array(*[F.lit(f) for f in formats])
    return found.where((F.col("position") >= 0) | (F.col("_rows") == 1)).select(
        "column_name", "total", "tested", "position", F.get(names, F.col("position")).alias("date_format"),
        F.when(F.col("position") >= 0, F.col("parsed")).otherwise(0).alias("parsed"), "min_date", "max_date", "shown",
    )


def _most() -> Column:
    """The format reads most of the texts that are not blank."""
    return (F.col("tested") > 0) & (F.col("parsed") >= MIN_SUCCESS * F.col("tested"))


def _every() -> Column:
    """The format is one of the fallback and reads every text."""
    return F.col("date_format").isin(*STRICT_FORMATS) & (F.col("parsed") == F.col("total"))


def _best(facts: DataFrame, enough: Column, tested: str) -> DataFrame:
    """The passing format with the highest rate; the earlier format wins a tie."""
    order = W.partitionBy("column_name").orderBy(F.desc("parsed"), "position")
    best = facts.where(F.col("date_format").isNotNull() & enough).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.select("column_name", "date_format", (F.col("parsed") / F.col(tested)).alias("success_rate"))


def detect_formats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, date_format, success_rate) over all rows that hold more than blanks.

    Columns whose best format reads less than 80 % of these rows get no row.
    """
    return _best(_facts(df, columns), _most(), "tested")


def detect_formats_strict(df: DataFrame, columns: list[str]) -> DataFrame:
    """The first fallback format that reads every non-null row of a column."""
    return _best(_facts(df, columns), _every(), "total")


def _chosen(facts: DataFrame) -> DataFrame:
    """One row of each column: that of its format by detection, else by the strict pass, else one without a format."""
    order = W.partitionBy("column_name").orderBy(F.when(_most(), 0).when(_every(), 1).otherwise(2), F.desc("parsed"), "position")
    first = facts.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    fits = F.coalesce(_most(), F.lit(False)) | F.coalesce(_every(), F.lit(False))
    rate = F.when(_most(), F.col("parsed") / F.col("tested")).otherwise(F.col("parsed") / F.col("total"))
    return first.select("*", fits.alias("fits"), rate.alias("success_rate"))


def chosen_formats(df: DataFrame, columns: list[str]) -> dict[str, Row]:
    """Column to its format (one row each): detection, then the strict pass where that is undecided; one scan for both."""
    found = _chosen(_facts(df, columns)).where("fits").select("column_name", "date_format", "success_rate")
    return {r["column_name"]: r for r in found.collect()}


def format_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Detected format per column with what it reads over all rows.

    ``sample_parsed_dates`` shows up to five of the dates. Undecided columns carry an error text.
    """
    found = _chosen(_facts(df, columns))
    fits = F.col("fits")
    parsed = F.when(fits, F.col("parsed")).otherwise(F.lit(0).cast("long"))
    return found.select(
        "column_name",
        F.when(fits, F.col("date_format")).alias("date_format"),
        rounded(F.try_divide(parsed, F.col("total")), 6).alias("success_rate"),
        parsed.alias("successful_parse_count"),
        F.col("total").alias("total_count"),
        F.when(fits, F.col("min_date")).alias("min_date"),
        F.when(fits, F.col("max_date")).alias("max_date"),
        F.when(fits, F.col("shown")).otherwise(F.array().cast("array<date>")).cast("array<string>").alias("sample_parsed_dates"),
        F.when(~fits, "No suitable date format found").alias("error"),
    )


def date_cast(df: DataFrame, name: str) -> Column:
    """A column expression reading ``name`` as a date by its detected format.

    Runs the detection (its answer is a single row); an undecided column is cast leniently.
    """
    dtype = df.schema[name].dataType
    if not isinstance(dtype, T.StringType):
        return as_date(column(name), dtype)
    found = chosen_formats(df.select(column(name)), [name]).get(name)
    return parse_date(column(name), found["date_format"]) if found else as_date(column(name), dtype)


def profile_date_formats(profile: TableProfile) -> DataFrame:
    """Detected format for every text column the profile calls datetime, with a suggested cast."""
    names = [f.name for f in profile.fields_of("datetime") if isinstance(f.dataType, T.StringType)]
    chosen = chosen_formats(profile.df, names) if names else {}
    patterns = dict(DATE_FORMATS)
    rows = [
        (c, r["date_format"], r["success_rate"], f"to_timestamp(`{c}`, '{patterns[r['date_format']]}')")
        for c, r in ((c, chosen.get(c)) for c in names)
        if r
    ] + [(c, None, None, None) for c in names if c not in chosen]
    found = profile.df.sparkSession.createDataFrame(
        rows, "column_name string, date_format string, success_rate double, recommended_cast string"
    )
    return found.withColumn("success_rate", rounded("success_rate", 6))
