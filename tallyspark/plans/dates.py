"""Date format detection and date-reference queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.dates import DATE_FORMATS, STRICT_FORMATS, resolve_date_references
from tallyspark.operators import date_formats
from tallyspark.operators.profile import TableProfile
from tallyspark.functions.safe import rounded
from tallyspark.plans.registry import query
from tallyspark.plans.roles import table

# One text column per style of writing the order date: name, SQL format, Spark pattern.
STYLES = [
    ("iso", "%Y-%m-%d", "yyyy-MM-dd"),
    ("us_slash", "%m/%d/%Y", "MM/dd/yyyy"),
    ("eu_slash", "%d/%m/%Y", "dd/MM/yyyy"),
    ("ymd_slash", "%Y/%m/%d", "yyyy/MM/dd"),
    ("eu_dot", "%d.%m.%Y", "dd.MM.yyyy"),
    ("compact", "%Y%m%d", "yyyyMMdd"),
    ("us_short", "%m/%d/%y", "MM/dd/yy"),
    ("long_us", "%B %d, %Y", "MMMM dd, yyyy"),
    ("short_eu", "%d %b %Y", "dd MMM yyyy"),
    ("iso_time", "%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"),
]
STYLE_NAMES = [s[0] for s in STYLES]


def order_date_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates written in every style, and a column where one order status spoils the format."""
    orders = table(spark, folder, "orders")
    texts = [F.date_format("o_orderdate", pattern).alias(name) for name, _, pattern in STYLES]
    spoiled = F.when(F.col("o_orderstatus") == "P", F.lit("unknown")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return orders.select("o_orderkey", *texts, spoiled.alias("spoiled"))


_TEXTS = (
    "texts AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS column_name, STRFTIME(o_orderdate, '{f}') AS v FROM orders" for n, f, _ in STYLES)
    + """ UNION ALL SELECT 'spoiled', CASE WHEN o_orderstatus = 'P' THEN 'unknown'
          ELSE STRFTIME(o_orderdate, '%Y-%m-%d') END FROM orders),
vals AS (SELECT column_name, v, COUNT(*) AS n FROM texts WHERE v IS NOT NULL GROUP BY ALL),
filled AS (SELECT * FROM vals WHERE TRIM(v) <> '')"""
)


def _read(fmt: str) -> str:
    """SQL reading a text; a four-digit year in the format needs one in the text."""
    parsed = f"TRY_STRPTIME(TRIM(v), '{fmt}')"
    return f"CASE WHEN REGEXP_MATCHES(v, '[0-9]{{4}}') THEN {parsed} END" if "%Y" in fmt else parsed


def _scores(name: str, source: str, formats: list[str], weight: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT column_name, {i} AS position, '{f}' AS date_format, SUM({weight}) AS tested, "
        f"SUM(CASE WHEN {_read(f)} IS NOT NULL THEN {weight} ELSE 0 END) AS parsed "
        f"FROM {source} GROUP BY column_name"
        for i, f in enumerate(formats)
    )
    return f"{name} AS ({rows})"


def _best(scores: str, enough: str) -> str:
    return f"""SELECT column_name, date_format, parsed / tested AS success_rate FROM {scores} WHERE {enough}
        QUALIFY ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY parsed DESC, position) = 1"""


_SCORED = _scores("scores", "filled", [f for f, _ in DATE_FORMATS], "n")
_STRICT = _scores("strict_scores", "vals", STRICT_FORMATS, "n")


@query(
    f"""WITH {_TEXTS}, {_SCORED}
        SELECT column_name, date_format, ROUND(success_rate, 6) AS success_rate
        FROM ({_best("scores", "parsed >= 0.8 * tested")})"""
)
def date_format_detect(spark: SparkSession, folder: str) -> DataFrame:
    found = date_formats.detect_formats(order_date_texts(spark, folder), [*STYLE_NAMES, "spoiled"])
    return found.withColumn("success_rate", rounded("success_rate", 6))


@query(
    f"""WITH {_TEXTS}, {_STRICT}
        SELECT column_name, date_format, ROUND(success_rate, 6) AS success_rate
        FROM ({_best("strict_scores", "parsed = tested")})"""
)
def date_format_detect_strict(spark: SparkSession, folder: str) -> DataFrame:
    found = date_formats.detect_formats_strict(order_date_texts(spark, folder), [*STYLE_NAMES, "spoiled"])
    return found.withColumn("success_rate", rounded("success_rate", 6))


_PARSED = " UNION ALL ".join(
    f"SELECT v.*, c.date_format, {_read(f)} AS t FROM vals v JOIN chosen c "
    f"ON v.column_name = c.column_name AND c.date_format = '{f}'"
    for f, _ in DATE_FORMATS
)


@query(
    f"""WITH {_TEXTS}, {_SCORED}, chosen AS ({_best("scores", "parsed >= 0.8 * tested")}), parsed_values AS ({_PARSED})
        SELECT column_name, date_format, ROUND(SUM(CASE WHEN t IS NOT NULL THEN n ELSE 0 END) / SUM(n), 6) AS success_rate,
               CAST(SUM(CASE WHEN t IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS successful_parse_count,
               CAST(SUM(n) AS BIGINT) AS total_count, CAST(MIN(t) AS DATE) AS min_date, CAST(MAX(t) AS DATE) AS max_date
        FROM parsed_values GROUP BY column_name, date_format
        UNION ALL SELECT column_name, NULL, 0.0, 0, CAST(SUM(n) AS BIGINT), NULL, NULL FROM vals
        WHERE column_name NOT IN (SELECT column_name FROM chosen) GROUP BY column_name"""
)
def date_format_report(spark: SparkSession, folder: str) -> DataFrame:
    report = date_formats.format_report(order_date_texts(spark, folder), [*STYLE_NAMES, "spoiled"])
    return report.drop("sample_parsed_dates", "error")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed_date FROM orders""")
def date_parse_with_format(spark: SparkSession, folder: str) -> DataFrame:
    texts = order_date_texts(spark, folder)
    return texts.select("o_orderkey", date_formats.date_cast(texts, "eu_dot").alias("parsed_date"))


@query(
    f"""WITH {_TEXTS}, {_SCORED}, found AS ({_best("scores", "parsed >= 0.8 * tested")}),
        dated AS (SELECT column_name FROM vals GROUP BY column_name
                  HAVING COUNT(TRY_CAST(v AS DOUBLE)) = 0 AND COUNT(CASE WHEN REGEXP_MATCHES(v, '^[0-9]{{4}}') THEN TRY_CAST(v AS DATE) END) > 0)
        SELECT d.column_name, date_format, ROUND(success_rate, 6) AS success_rate
        FROM dated d LEFT JOIN found f ON d.column_name = f.column_name WHERE d.column_name <> 'spoiled'"""
)
def profile_date_formats(spark: SparkSession, folder: str) -> DataFrame:
    texts = order_date_texts(spark, folder).select(*STYLE_NAMES)
    found = date_formats.profile_date_formats(TableProfile(texts, "orders"))
    return found.select("column_name", "date_format", "success_rate")


_MONTH_RANGE = ("DATE_TRUNC('month', d)", "LAST_DAY(d)")
_QUARTER_RANGE = ("DATE_TRUNC('quarter', d)", "DATE_TRUNC('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY")
_YEAR_RANGE = ("DATE_TRUNC('year', d)", "DATE_TRUNC('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY")
# Reference text in SQL, its first and last day, and how it is understood.
_REFERENCES = [
    ("STRFTIME(d, '%b %Y')", *_MONTH_RANGE, "full_month_period"),
    ("LOWER(STRFTIME(d, '%B %Y'))", *_MONTH_RANGE, "full_month_period"),
    ("'Q' || QUARTER(d) || STRFTIME(d, ' %Y')", *_QUARTER_RANGE, "full_quarter_period"),
    ("STRFTIME(d, '%Y')", *_YEAR_RANGE, "full_year_period"),
    ("'as of ' || STRFTIME(d, '%b %Y')", _MONTH_RANGE[1], _MONTH_RANGE[1], "point_in_time_end"),
    ("'End of Q' || QUARTER(d) || STRFTIME(d, ' %Y')", _QUARTER_RANGE[1], _QUARTER_RANGE[1], "point_in_time_end"),
    ("'beginning of ' || STRFTIME(d, '%Y')", _YEAR_RANGE[0], _YEAR_RANGE[0], "point_in_time_start"),
    ("'as of beginning of ' || STRFTIME(d, '%b %Y')", _MONTH_RANGE[0], _MONTH_RANGE[0], "point_in_time_end"),
    ("STRFTIME(d, '%B %-d, %Y')", "d", "d", "single_day"),
    ("'week ' || STRFTIME(d, '%m of %Y')", "NULL", "NULL", "unparsed"),
]
_REFERENCES_SQL = " UNION ALL ".join(
    f"SELECT {ref} AS ref, CAST({first} AS DATE) AS start_date, CAST({last} AS DATE) AS end_date, "
    f"'{kind}' AS interpretation_type FROM days"
    for ref, first, last, kind in _REFERENCES
)


@query(
    f"""WITH days AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)
        SELECT ref, start_date, end_date, interpretation_type,
               CASE WHEN interpretation_type = 'unparsed' THEN 'Could not resolve date reference: ' || ref
                 || '. Use e.g. ''Jan 2023'', ''Q1 2023'', ''2023''.' END AS warning, COUNT(*) AS n
        FROM ({_REFERENCES_SQL}) GROUP BY ALL"""
)
def date_reference_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Every order's date in ten ways of referring to a period, counted and resolved."""
    d = F.col("o_orderdate")

    def written(pattern: str):
        return F.date_format(d, pattern)

    quarter = F.concat(F.lit("Q"), F.quarter(d).cast("string"), written(" yyyy"))
    refs = F.array(
        written("MMM yyyy"),
        F.lower(written("MMMM yyyy")),
        quarter,
        written("yyyy"),
        F.concat(F.lit("as of "), written("MMM yyyy")),
        F.concat(F.lit("End of "), quarter),
        F.concat(F.lit("beginning of "), written("yyyy")),
        F.concat(F.lit("as of beginning of "), written("MMM yyyy")),
        written("MMMM d, yyyy"),
        F.concat(F.lit("week "), written("MM 'of' yyyy")),
    )
    texts = table(spark, folder, "orders").select(F.explode(refs).alias("ref"))
    return resolve_date_references(texts.groupBy("ref").agg(F.count(F.lit(1)).alias("n")), "ref")
