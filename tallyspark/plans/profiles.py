"""Profile and preview queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.preview import TablePreview
from tallyspark.operators.profile import TableProfile
from tallyspark.plans.registry import query
from tallyspark.plans.roles import table

LINEITEM_NUMBERS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]
LINEITEM = [*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def profile(spark: SparkSession, folder: str, name: str) -> TableProfile:
    return TableProfile(table(spark, folder, name), name)


def _each(columns: list[str], template: str) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


# -- full profile ------------------------------------------------------------------------------


@query(
    """SELECT 'lineitem' AS table_name, COUNT(*) AS total_rows, 11 AS total_columns, 'analyzed' AS status FROM lineitem"""
)
def profile_table(spark: SparkSession, folder: str) -> DataFrame:
    return profile(spark, folder, "lineitem").summary().drop("analysis_timestamp")


@query(
    _each(
        LINEITEM,
        """SELECT '{c}' AS column_name, COUNT(*) AS total_count, COUNT({c}) AS non_null_count,
           COUNT(*) - COUNT({c}) AS missing_count,
           ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS missing_percentage,
           ROUND(COUNT({c}) * 100.0 / COUNT(*), 2) AS completeness_percentage,
           COUNT(DISTINCT {c}) AS unique_count,
           ROUND(COUNT(DISTINCT {c}) * 100.0 / COUNT({c}), 2) AS uniqueness_percentage,
           ROUND(COUNT(DISTINCT {c}) * 1.0 / COUNT({c}), 4) AS cardinality_ratio FROM lineitem""",
    )
)
def profile_quality(spark: SparkSession, folder: str) -> DataFrame:
    return profile(spark, folder, "lineitem").quality()


def _types_sql(name: str, columns: list[str]) -> str:
    return _each(
        columns,
        f"""SELECT '{name}' AS table_name, '{{c}}' AS column_name,
            CASE WHEN COUNT(TRY_CAST({{c}} AS DOUBLE)) > 0 THEN 'numeric'
                 WHEN COUNT(TRY_CAST({{c}} AS DATE)) > 0 THEN 'datetime' ELSE 'categorical' END AS inferred_best_dtype
            FROM {name}""",
    )


@query(
    " UNION ALL ".join(
        _types_sql(n, c) for n, c in [("lineitem", LINEITEM), ("customer", CUSTOMER), ("documents", DOCUMENTS)]
    )
)
def profile_types(spark: SparkSession, folder: str) -> DataFrame:
    parts = [profile(spark, folder, n).types() for n in ("lineitem", "customer", "documents")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("table_name", "column_name", "inferred_best_dtype")


@query(
    _each(
        ["c_name", "c_mktsegment"],
        """SELECT '{c}' AS column_name, MIN(LENGTH({c})) AS min_length, MAX(LENGTH({c})) AS max_length,
           ROUND(AVG(LENGTH({c})), 1) AS avg_length FROM customer""",
    )
)
def profile_string_stats(spark: SparkSession, folder: str) -> DataFrame:
    return profile(spark, folder, "customer").string_stats()


@query(
    _each(
        LINEITEM_NUMBERS,
        """SELECT '{c}' AS column_name, CAST(ROUND(MIN(x), 3) AS DOUBLE) AS "min", CAST(ROUND(MAX(x), 3) AS DOUBLE) AS "max",
           ROUND(AVG(x), 3) AS mean, ROUND(QUANTILE_CONT(x, 0.5), 3) AS median, ROUND(STDDEV_SAMP(x), 3) AS std_dev,
           ROUND(VAR_SAMP(x), 3) AS variance, ROUND(MAX(x) - MIN(x), 3) AS "range",
           ROUND(QUANTILE_CONT(x, 0.05), 3) AS p5, ROUND(QUANTILE_CONT(x, 0.25), 3) AS q1,
           ROUND(QUANTILE_CONT(x, 0.75), 3) AS q3, ROUND(QUANTILE_CONT(x, 0.95), 3) AS p95,
           ROUND(QUANTILE_CONT(x, 0.75) - QUANTILE_CONT(x, 0.25), 3) AS iqr,
           ROUND(STDDEV_SAMP(x) / AVG(x), 3) AS coefficient_of_variation
           FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem)""",
    )
)
def profile_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return profile(spark, folder, "lineitem").numeric_stats()


@query(
    _each(
        LINEITEM_NUMBERS,
        """SELECT '{c}' AS column_name, bucket, COUNT(*) AS frequency FROM (
             SELECT CASE WHEN x >= hi THEN 11 ELSE CAST(FLOOR(10 * (x - lo) / (hi - lo)) AS BIGINT) + 1 END AS bucket
             FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem),
                  (SELECT CAST(MIN({c}) AS DOUBLE) AS lo, CAST(MAX({c}) AS DOUBLE) AS hi FROM lineitem))
           GROUP BY bucket""",
    )
)
def profile_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return profile(spark, folder, "lineitem").histogram()


_DATES = [("o_orderdate", "orders"), ("l_shipdate", "lineitem")]


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(MIN({c}) AS DATE) AS min_date, CAST(MAX({c}) AS DATE) AS max_date,
            DATEDIFF('day', MIN({c}), MAX({c})) AS date_range_days FROM {t}"""
        for c, t in _DATES
    )
)
def profile_datetime(spark: SparkSession, folder: str) -> DataFrame:
    stats = [profile(spark, folder, t).datetime_stats() for _, t in _DATES]
    return stats[0].unionByName(stats[1])


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, YEAR({c}) AS year, COUNT(*) AS count FROM {t} GROUP BY YEAR({c})"
        for c, t in _DATES
    )
)
def profile_yearly(spark: SparkSession, folder: str) -> DataFrame:
    years = [profile(spark, folder, t).yearly() for _, t in _DATES]
    return years[0].unionByName(years[1])


_TOP = [("c_mktsegment", "customer"), ("l_returnflag", "lineitem"), ("l_linestatus", "lineitem")]
_TOP_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {c} AS value, COUNT(*) AS count,
        ROUND(COUNT(*) * 100.0 / (SELECT COUNT({c}) FROM {t}), 2) AS percentage,
        ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) AS rank FROM {t} GROUP BY {c}"""
    for c, t in _TOP
)


@query(_TOP_SQL)
def profile_top_values(spark: SparkSession, folder: str) -> DataFrame:
    lines = profile(spark, folder, "lineitem").top_values()
    return profile(spark, folder, "customer").top_values().unionByName(lines)


@query(
    f"""SELECT column_name, '{{' || STRING_AGG('"' || value || '":' || CAST(count AS VARCHAR), ',' ORDER BY rank) || '}}'
        AS top_values_json FROM ({_TOP_SQL}) GROUP BY column_name"""
)
def profile_top_values_json(spark: SparkSession, folder: str) -> DataFrame:
    lines = profile(spark, folder, "lineitem").top_values_json()
    return profile(spark, folder, "customer").top_values_json().unionByName(lines)


@query(
    _each(
        ["c_name", "c_mktsegment"],
        """SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS unique_values,
           COUNT(DISTINCT {c}) > 50 OR COUNT(DISTINCT {c}) = 0 AS is_high_cardinality,
           CASE WHEN COUNT(DISTINCT {c}) > 100 OR COUNT(DISTINCT {c}) = 0 THEN
             'High cardinality (' || CAST(COUNT(DISTINCT {c}) AS VARCHAR) || ' unique values) - analysis skipped' END AS note
           FROM customer""",
    )
)
def profile_categorical_notes(spark: SparkSession, folder: str) -> DataFrame:
    return profile(spark, folder, "customer").categorical_notes()


def _flags_sql(name: str, columns: list[str]) -> str:
    counts = _each(
        columns,
        f"""SELECT '{{c}}' AS column_name, COUNT(*) AS t, COUNT({{c}}) AS p, COUNT(DISTINCT {{c}}) AS u FROM {name}""",
    )
    rules = [
        ("high_missing_rate", "(t - p) * 1.0 / t > 0.5"),
        ("constant_value", "u = 1 AND p = t"),
        ("unique_identifier", "u = t AND p = t"),
        ("near_unique", "p > 10 AND u * 1.0 / p > 0.95"),
    ]
    return " UNION ALL ".join(f"SELECT column_name, '{f}' AS flag FROM ({counts}) WHERE {r}" for f, r in rules)


@query(_flags_sql("customer", CUSTOMER) + " UNION ALL " + _flags_sql("orders", ORDERS))
def profile_flags(spark: SparkSession, folder: str) -> DataFrame:
    return profile(spark, folder, "customer").flags().unionByName(profile(spark, folder, "orders").flags())


_CORRELATED = [*LINEITEM_NUMBERS, "net_price"]
_CORRELATIONS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS column1, '{b}' AS column2, CORR({a}, {b}) AS r FROM lines"
    for i, a in enumerate(_CORRELATED)
    for b in _CORRELATED[i + 1 :]
)


@query(
    f"""WITH lines AS (SELECT *, l_extendedprice * (1 - l_discount) AS net_price FROM lineitem)
        SELECT column1, column2, ROUND(r, 3) AS correlation,
               CASE WHEN ABS(r) > 0.7 THEN 'strong' WHEN ABS(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength
        FROM ({_CORRELATIONS_SQL}) WHERE ABS(r) > 0.1"""
)
def profile_correlations(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumn(
        "net_price", F.col("l_extendedprice") * (1 - F.col("l_discount"))
    )
    return TableProfile(lines, "lineitem").correlations()


@query(
    f"""SELECT COUNT(*) * 11 AS total_cells, COUNT(*) * 11 - ({" + ".join(f"COUNT({c})" for c in LINEITEM)}) AS missing_cells,
        ROUND(({" + ".join(f"COUNT({c})" for c in LINEITEM)}) * 100.0 / (COUNT(*) * 11), 2) AS overall_completeness,
        8 AS numeric_columns, 2 AS categorical_columns, 1 AS datetime_columns FROM lineitem"""
)
def profile_overall(spark: SparkSession, folder: str) -> DataFrame:
    return profile(spark, folder, "lineitem").overall()


# -- light preview -----------------------------------------------------------------------------


@query("""SELECT COUNT(*) AS total_rows, 5 AS total_columns, CAST(NULL AS VARCHAR) AS notes FROM customer""")
def preview_shape(spark: SparkSession, folder: str) -> DataFrame:
    return TablePreview(table(spark, folder, "customer")).shape()


@query(
    _each(
        ORDERS,
        """SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing_values_count,
           ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS missing_values_percentage,
           COUNT(DISTINCT {c}) AS unique_values_count FROM orders""",
    )
)
def preview_missing(spark: SparkSession, folder: str) -> DataFrame:
    return TablePreview(table(spark, folder, "orders")).missing()


# Orders with text columns that hold numbers, dates, mixed content, a flag and nothing at all.
_MIXED = """mixed AS (
  SELECT o_totalprice, CAST(o_custkey AS VARCHAR) AS number_text, STRFTIME(o_orderdate, '%Y-%m-%d') AS date_text,
         CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS mixed_text,
         o_orderpriority, 'order ' || CAST(o_orderkey AS VARCHAR) AS label, o_orderstatus = 'O' AS is_open,
         CAST(NULL AS VARCHAR) AS empty_text, CAST(o_orderdate AS DATE) AS day
  FROM orders)"""


def mixed_orders(spark: SparkSession, folder: str) -> DataFrame:
    customer = F.col("o_custkey").cast("string")
    return table(spark, folder, "orders").select(
        "o_totalprice",
        customer.alias("number_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(customer).alias("mixed_text"),
        "o_orderpriority",
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("label"),
        (F.col("o_orderstatus") == "O").alias("is_open"),
        F.lit(None).cast("string").alias("empty_text"),
        F.col("o_orderdate").cast("date").alias("day"),
    )


_MIXED_TEXTS = ["number_text", "date_text", "mixed_text", "o_orderpriority", "label"]


@query(
    f"WITH {_MIXED} "
    + _each(
        _MIXED_TEXTS,
        """SELECT '{c}' AS column_name, CASE WHEN COUNT(TRY_CAST({c} AS DOUBLE)) = COUNT(*) THEN 'numeric (inferred from object)'
           WHEN COUNT(TRY_CAST({c} AS DATE)) = COUNT(*) THEN 'datetime (inferred from object)'
           ELSE 'categorical/string (inferred from object)' END AS inferred_best_dtype
           FROM mixed WHERE {c} IS NOT NULL""",
    )
    + """ UNION ALL SELECT 'o_totalprice', 'numeric' UNION ALL SELECT 'is_open', 'boolean'
          UNION ALL SELECT 'empty_text', 'string' UNION ALL SELECT 'day', 'datetime'"""
)
def preview_types(spark: SparkSession, folder: str) -> DataFrame:
    return TablePreview(mixed_orders(spark, folder)).types().select("column_name", "inferred_best_dtype")


@query(
    f"WITH {_MIXED} "
    + _each(
        ["o_totalprice", "number_text"],
        """SELECT '{c}' AS column_name, ROUND(AVG(x), 3) AS mean, ROUND(STDDEV_SAMP(x), 3) AS std_dev, ROUND(MIN(x), 3) AS "min",
           ROUND(QUANTILE_CONT(x, 0.25), 3) AS percentile_25, ROUND(QUANTILE_CONT(x, 0.5), 3) AS median,
           ROUND(QUANTILE_CONT(x, 0.75), 3) AS percentile_75, ROUND(MAX(x), 3) AS "max"
           FROM (SELECT TRY_CAST({c} AS DOUBLE) AS x FROM mixed)""",
    )
)
def preview_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return TablePreview(mixed_orders(spark, folder)).numeric()


@query(
    f"WITH {_MIXED} "
    + _each(
        ["date_text", "day"],
        """SELECT '{c}' AS column_name, MIN(TRY_CAST({c} AS DATE)) AS min_date, MAX(TRY_CAST({c} AS DATE)) AS max_date
           FROM mixed""",
    )
)
def preview_datetime(spark: SparkSession, folder: str) -> DataFrame:
    return TablePreview(mixed_orders(spark, folder)).datetime()


@query(
    f"""WITH {_MIXED} SELECT 'is_open' AS column_name, is_open AS value, COUNT(*) AS count FROM mixed GROUP BY is_open"""
)
def preview_boolean(spark: SparkSession, folder: str) -> DataFrame:
    return TablePreview(mixed_orders(spark, folder)).boolean()


@query(
    f"WITH {_MIXED} "
    + " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, COUNT(*) AS count,
            ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) AS rank,
            (SELECT COUNT(DISTINCT {c}) > 50 AND COUNT(DISTINCT {c}) > 0.1 * COUNT(*) FROM mixed) AS is_highly_cardinal
            FROM mixed WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5"""
        for c in ("mixed_text", "o_orderpriority")
    )
)
def preview_top_values(spark: SparkSession, folder: str) -> DataFrame:
    return TablePreview(mixed_orders(spark, folder)).top_values()


@query(
    f"WITH {_MIXED} "
    + _each(
        ["mixed_text", "o_orderpriority", "label"],
        """SELECT '{c}' AS column_name, 'High cardinality or mostly unique string values. Not showing top N.' AS note
           FROM mixed HAVING COUNT(DISTINCT {c}) > 0.8 * COUNT(*)""",
    )
    + """ UNION ALL SELECT 'empty_text', 'Column is entirely empty (all NaN).' FROM mixed HAVING COUNT(empty_text) = 0"""
)
def preview_notes(spark: SparkSession, folder: str) -> DataFrame:
    return TablePreview(mixed_orders(spark, folder)).notes()
