"""Date parsing by format, date-reference resolution and period arithmetic, all as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.safe import column

# The formats tried, in order of preference (earlier wins a tie, so month-first
# beats day-first), each with the Spark pattern that reads the same texts.
DATE_FORMATS: list[tuple[str, str]] = [
    ("%Y-%m-%d", "yyyy-M-d"),
    ("%m/%d/%Y", "M/d/yyyy"),
    ("%d/%m/%Y", "d/M/yyyy"),
    ("%Y/%m/%d", "yyyy/M/d"),
    ("%m-%d-%Y", "M-d-yyyy"),
    ("%d-%m-%Y", "d-M-yyyy"),
    ("%Y.%m.%d", "yyyy.M.d"),
    ("%m.%d.%Y", "M.d.yyyy"),
    ("%d.%m.%Y", "d.M.yyyy"),
    ("%Y%m%d", "yyyyMMdd"),
    ("%m/%d/%y", "M/d/yy"),
    ("%d/%m/%y", "d/M/yy"),
    ("%y-%m-%d", "yy-M-d"),
    ("%B %d, %Y", "MMMM d, yyyy"),
    ("%d %B %Y", "d MMMM yyyy"),
    ("%b %d, %Y", "MMM d, yyyy"),
    ("%d %b %Y", "d MMM yyyy"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s"),
    ("%m/%d/%Y %H:%M:%S", "M/d/yyyy H:m:s"),
    ("%Y-%m-%dT%H:%M:%S", "yyyy-M-d'T'H:m:s"),
    ("%Y-%m-%dT%H:%M:%SZ", "yyyy-M-d'T'H:m:s'Z'"),
]
# The formats of the strict fallback, which must read every row of a column.
STRICT_FORMATS: list[str] = [
    "%Y-%m-%d",
    "%m/%d/%Y",
    "%d/%m/%Y",
    "%Y/%m/%d",
    "%m-%d-%Y",
    "%d-%m-%Y",
    "%Y.%m.%d",
    "%m.%d.%Y",
    "%d.%m.%Y",
    "%Y%m%d",
    "%B %d, %Y",
    "%d %B %Y",
    "%b %d, %Y",
    "%d %b %Y",
]
# Month names, full or three letters.
MONTH_NAMES = (
    "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|January|February|March|April|June|July|"
    "August|September|October|November|December"
)
MONTH_NUMBERS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}

_SPARK_PATTERN = dict(DATE_FORMATS)
# Compact dates may drop leading zeros: 2023115 is 2023-11-5.
_COMPACT = r"^(\d{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12]\d|0[1-9]|[1-9])$"


# What each part of a format may look like; numbers need no leading zero.
_PART_SHAPES = {"Y": r"\d{4}", "y": r"\d{2}", "B": r"[A-Za-z]+", "b": r"[A-Za-z]+"}


def _shape(fmt: str) -> str:
    """Pattern of the texts a format can read."""
    if fmt == "%Y%m%d":
        return _COMPACT
    return "^" + re.sub(r"%(.)|(\W)", _part, fmt) + "$"


def _part(match: re.Match) -> str:
    if match[1]:
        return _PART_SHAPES.get(match[1], r"\d{1,2}")
    return re.escape(match[2])


def strip(text: Column) -> Column:
    """Trim all leading and trailing whitespace, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tidy(text: Column) -> Column:
    """Text as the formats expect it: trimmed, with single blanks inside."""
    loose = text.startswith(" ") | text.endswith(" ") | text.contains("  ")
    for white in "\t\n\v\f\r":
        loose = loose | text.contains(white)  # most texts are as they should be, which a search tells sooner than a pattern
    return F.when(loose, F.regexp_replace(strip(text), r"\s+", " ")).otherwise(text)


def parse_tidy(text: Column, fmt: str) -> Column:
    """Read tidy text with one of the known formats; NULL when it does not match."""
    pattern = _SPARK_PATTERN[fmt]
    shaped = text.rlike(_shape(fmt))  # a failing parse is far dearer than a failing match
    if fmt == "%Y%m%d":
        text, pattern = F.regexp_replace(text, _COMPACT, "$1-$2-$3"), "yyyy-M-d"
    parsed = F.when(shaped, F.try_to_timestamp(text, F.lit(pattern)))
    if "%y" in fmt:
        # Two-digit years 69-99 belong to the last century.
        return F.when(F.year(parsed) > 2068, parsed - F.expr("INTERVAL 100 YEARS")).otherwise(parsed)
    return parsed


# Dates as they may stand alone, and numbers before a clock time: wider shapes than those of the formats, cheap to match.
_NUMBERS = r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"
_DAY = rf"^(?:{_NUMBERS}|\d{{6,8}}|[A-Za-z]{{3,9}} \d{{1,2}}, \d{{4}}|\d{{1,2}} [A-Za-z]{{3,9}} \d{{4}})$"
_TIMED = rf"^{_NUMBERS}[ T](?:[01]?\d|2[0-3]):[0-5]?\d:[0-5]?\dZ?$"
_LONGEST = 20


def day_and_clock(text: Column) -> tuple[Column, Column]:
    """The day in a tidy text with the shape of a date, NULL in all others, and what stands around its clock time: nothing
    when it has none, else a blank or ``T``, with ``Z`` if that ends it."""
    short, timed, by_t = F.length(text) <= _LONGEST, text.contains(":"), text.contains("T")
    before = F.when(by_t, F.substring_index(text, "T", 1)).otherwise(F.substring_index(text, " ", 1))
    day = F.when(timed, F.when(short & text.rlike(_TIMED), before)).otherwise(F.when(short & text.rlike(_DAY), text))
    around = F.concat(F.when(by_t, "T").otherwise(" "), F.when(text.endswith("Z"), "Z").otherwise(""))
    return day, F.when(timed & day.isNotNull(), around).otherwise("")


def split_format(fmt: str) -> tuple[str, str]:
    """A format's part for the day, and what stands around its clock time, as :func:`day_and_clock` tells it."""
    day, clock, rest = fmt.partition("%H:%M:%S")
    return (day[:-1], day[-1] + rest) if clock else (day, "")


def parse_timestamp(text: Column, fmt: str) -> Column:
    """Read text with one of the known formats; NULL when it does not match."""
    return parse_tidy(tidy(text), fmt)


def parse_date(text: Column, fmt: str) -> Column:
    return parse_timestamp(text, fmt).cast("date")


def parse_by_format_column(text: Column, fmt: Column, formats: list[str]) -> Column:
    """Read each row's tidy text with the format named in another column of that row."""
    return reduce(
        lambda rest, name: F.when(fmt == name, parse_tidy(text, name)).otherwise(rest),
        reversed(formats),
        F.lit(None).cast("timestamp"),
    )


def period_start(date: Column, granularity: str) -> Column:
    """First day of the month, quarter or year holding a date."""
    unit = {"month": "MM", "quarter": "QUARTER", "year": "YEAR"}[granularity]
    return F.trunc(date, unit)


def period_end(date: Column, granularity: str) -> Column:
    """Last day of the month, quarter or year holding a date."""
    months = {"month": 0, "quarter": 2, "year": 11}[granularity]
    return F.last_day(F.add_months(period_start(date, granularity), months))


def period_calendar(bounds: DataFrame, first: str, last: str, granularity: str) -> DataFrame:
    """One row per period between two date columns of a one-row frame, with inclusive bounds."""
    months = {"month": 1, "quarter": 3, "year": 12}[granularity]
    starts = F.sequence(
        period_start(F.col(first), granularity),
        period_start(F.col(last), granularity),
        F.expr(f"INTERVAL {months} MONTHS"),
    )
    rows = bounds.filter(F.col(first).isNotNull()).select(F.explode(starts).alias("period_start"))
    return rows.select(
        "period_start", period_end(F.col("period_start"), granularity).alias("period_end")
    )


def resolve_date_references(df: DataFrame, reference: str) -> DataFrame:
    """Add start_date, end_date, interpretation_type and warning for texts such as ``Q1 2023``.

    Months, quarters and years mean the whole period. ``as of``/``end of`` mean its last day,
    ``beginning of`` its first day; such prefixes may be stacked twice. A month, day and year is
    that day. Everything else is ``unparsed`` with NULL dates and a warning.
    """
    ref = strip(column(reference))

    def prefix(text: Column) -> Column:
        low = F.lower(text)
        return F.when(low.startswith("as of ") | low.startswith("end of "), F.lit("end")).when(
            low.startswith("beginning of "), F.lit("start")
        )

    def inner(text: Column, kind: Column) -> Column:
        return F.when(kind.isNotNull(), F.regexp_replace(F.lower(text), r"^(?:as of|end of|beginning of)\s+", "")).otherwise(text)

    month_re = rf"(?i)^({MONTH_NAMES})\s+(\d{{4}})$"
    quarter_re = r"(?i)^Q([1-4])\s+(\d{4})$"
    year_re = r"^(\d{4})$"
    day_re = rf"(?i)^({MONTH_NAMES})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})$"

    def month_start(text: Column, pattern: str, year_group: int) -> Column:
        initials = F.lower(F.substring(F.regexp_extract(text, pattern, 1), 1, 3))
        numbers = F.create_map(*[F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair])
        number = F.try_element_at(numbers, initials)
        return F.make_date(F.regexp_extract(text, pattern, year_group).try_cast("int"), number, F.lit(1))

    out = df.withColumn("_outer", prefix(ref)).withColumn("_text1", inner(ref, F.col("_outer")))
    out = out.withColumn("_inner", F.when(F.col("_outer").isNotNull(), prefix(F.col("_text1"))))
    out = out.withColumn("_core", inner(F.col("_text1"), F.col("_inner")))

    core = F.col("_core")
    quarter_month = (F.regexp_extract(core, quarter_re, 1).try_cast("int") - 1) * 3 + 1
    out = out.withColumn(
        "_kind",
        F.when(core.rlike(month_re), "full_month_period")
        .when(core.rlike(quarter_re), "full_quarter_period")
        .when(core.rlike(year_re), "full_year_period")
        .when(core.rlike(day_re), "single_day"),
    ).withColumn(
        "_first",
        F.when(F.col("_kind") == "full_month_period", month_start(core, month_re, 2))
        .when(
            F.col("_kind") == "full_quarter_period",
            F.make_date(F.regexp_extract(core, quarter_re, 2).try_cast("int"), quarter_month, F.lit(1)),
        )
        .when(F.col("_kind") == "full_year_period", F.make_date(core.try_cast("int"), F.lit(1), F.lit(1)))
        .when(F.col("_kind") == "single_day", month_start(core, day_re, 3)),
    )
    day = F.regexp_extract(core, day_re, 2).try_cast("int")
    first = F.col("_first")
    single = F.when((day >= 1) & (day <= F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))
    out = out.withColumn(
        "_last",
        F.when(F.col("_kind") == "full_month_period", F.last_day(first))
        .when(F.col("_kind") == "full_quarter_period", F.last_day(F.add_months(first, 2)))
        .when(F.col("_kind") == "full_year_period", F.last_day(F.add_months(first, 11)))
        .when(F.col("_kind") == "single_day", single),
    ).withColumn("_first", F.when(F.col("_kind") == "single_day", single).otherwise(first))

    # Apply the prefixes from the inside out; each collapses the period to one of its ends.
    for kind in ("_inner", "_outer"):
        point = F.when(F.col(kind) == "end", F.col("_last")).when(F.col(kind) == "start", F.col("_first"))
        out = out.withColumn("_point", point)
        for side in ("_first", "_last"):
            out = out.withColumn(
                side, F.when(F.col(kind).isNotNull(), F.col("_point")).otherwise(F.col(side))
            )

    parsed = F.col("_first").isNotNull()
    warning = F.concat(
        F.lit("Could not resolve date reference: "), ref, F.lit(". Use e.g. 'Jan 2023', 'Q1 2023', '2023'.")
    )
    return out.select(
        *[column(c) for c in df.columns],
        F.col("_first").alias("start_date"),
        F.col("_last").alias("end_date"),
        F.when(~parsed, "unparsed")
        .when(F.col("_outer") == "end", "point_in_time_end")
        .when(F.col("_outer") == "start", "point_in_time_start")
        .otherwise(F.col("_kind"))
        .alias("interpretation_type"),
        F.when(~parsed, warning).alias("warning"),
    )


def horizon_periods(granularity: Column, years: int) -> Column:
    """How many periods of a granularity a horizon of whole years spans (5 years = 5, 20, 60)."""
    per_year = (
        F.when(granularity == "year", 1).when(granularity == "quarter", 4).when(granularity == "month", 12)
    )
    return per_year * years
