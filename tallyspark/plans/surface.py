"""Sources, sinks and the relational surface: scans, saved results, joins, windows, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.safe import guarded_mean, guarded_sum, money, rounded
from tallyspark.operators import commerce, records, series
from tallyspark.operators.profile import fallback_profile
from tallyspark.plans import roles
from tallyspark.plans.registry import query
from tallyspark.plans.roles import CONTRACTS, SEGMENTED, TRANSACTIONS, ledger, table, transactions
from tallyspark.session import work_dir
from tallyspark.sources import files, quarantine, results, summaries, tables
from tallyspark.streaming.landing import ingest_landing

# -- sources and sinks -------------------------------------------------------------------------


@query("""SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def scan_csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = work_dir(spark, "csv") + "/customer.csv"
    tables.write_csv(table(spark, folder, "customer"), path)
    return tables.read_csv(spark, path).select(
        F.col("c_custkey").cast("long").alias("c_custkey"),
        "c_name",
        F.col("c_nationkey").cast("long").alias("c_nationkey"),
        "c_acctbal",
        "c_mktsegment",
    )


@query("""SELECT doc_id, text FROM documents UNION ALL SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations""")
def scan_csv_quoted(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes and line breaks, written as CSV and read back."""
    path = work_dir(spark, "csv")
    documents = table(spark, folder, "documents").select("doc_id", "text")
    turns = table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    for name, texts in (("documents", documents), ("turns", turns)):
        tables.write_csv(texts, f"{path}/{name}")
    return tables.read_csv(spark, [f"{path}/documents", f"{path}/turns"], documents.schema, empty_texts=True)


@query(
    """SELECT COUNT(*) AS total_rows, COUNT(CASE WHEN o_orderstatus <> 'O' THEN 1 END) AS malformed_rows FROM orders"""
)
def scan_csv_malformed(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with a field too many or too few are kept and counted."""
    path = work_dir(spark, "csv")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    line = F.when(status == "F", F.concat_ws(",", key, status, F.lit("extra"))).when(status == "P", key.cast("string"))
    lines = table(spark, folder, "orders").select(F.coalesce(line, F.concat_ws(",", key, status)).alias("line"))
    lines.write.text(f"{path}/lines")
    return tables.malformed_lines(tables.read_csv_as_text(spark, f"{path}/lines", columns=["key", "status"]))


@query(
    """SELECT 'good' AS kind, o_orderstatus AS detail, COUNT(*) AS n, SUM(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL
       UNION ALL SELECT 'bad', CASE o_orderstatus WHEN 'F' THEN 'a field too many' ELSE 'a field too few' END, COUNT(*), SUM(o_orderkey)::BIGINT
       FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL
       UNION ALL SELECT 'counted', 'bad lines', COUNT(*) FILTER (o_orderstatus <> 'O'), NULL FROM orders
       UNION ALL SELECT 'counted', 'good rows', COUNT(*) FILTER (o_orderstatus = 'O'), NULL FROM orders"""
)
def scan_csv_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Good rows with their types and bad lines beside them, from one pass over the files."""
    path = work_dir(spark, "csv")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    line = F.when(status == "F", F.concat_ws(",", key, status, F.lit("extra"))).when(status == "P", key.cast("string"))
    lines = table(spark, folder, "orders").select(F.coalesce(line, F.concat_ws(",", key, status)).alias("line"))
    # the text writer has no header: each of its files begins with the row that sorts first
    headed = spark.createDataFrame([(n, 0, "key,status") for n in range(4)], "file int, place int, line string")
    rows = lines.select(F.pmod(F.hash("line"), F.lit(4)).alias("file"), F.lit(1).alias("place"), "line")
    dealt = headed.unionByName(rows).repartition(4, "file").sortWithinPartitions("file", "place")
    dealt.select("file", "line").write.partitionBy("file").text(f"{path}/files")
    loaded = quarantine.load_csv(spark, f"{path}/files", f"{path}/loaded")
    good = loaded.rows.groupBy(F.lit("good").alias("kind"), F.col("status").alias("detail"))
    fields = F.split("line", ",")
    bad = loaded.bad.groupBy(F.lit("bad").alias("kind"), F.when(F.size(fields) > 2, "a field too many").otherwise("a field too few").alias("detail"))
    counted = spark.createDataFrame(
        [("counted", "bad lines", loaded.n_bad, None), ("counted", "good rows", loaded.n_rows, None)], "kind string, detail string, n long, keys long"
    )
    count = F.count(F.lit(1)).alias("n")
    return good.agg(count, F.sum("key").cast("long").alias("keys")).unionByName(bad.agg(count, F.sum(fields[0].cast("long")).alias("keys"))).unionByName(counted)


@query(
    """SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus"""
)
def scan_multi_file(spark: SparkSession, folder: str) -> DataFrame:
    path = work_dir(spark, "csv")
    orders = table(spark, folder, "orders")
    orders.withColumn("status", F.col("o_orderstatus")).write.partitionBy("status").option("header", True).csv(path)
    parts = [f"{path}/{n}" for n in files.list_names(spark, path) if n.startswith("status=")]
    together = tables.read_csv(spark, parts, schema=orders.schema)
    return together.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), money(F.sum("o_totalprice")).alias("total")
    )


_GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM {t}) AS n_rows, "
        f"(SELECT COUNT(*) FROM (DESCRIBE {t})) AS n_columns"
        for t in _GIVEN
    )
)
def catalog_overview(spark: SparkSession, folder: str) -> DataFrame:
    found = tables.list_tables(spark, folder, ".parquet")
    frames = {name: table(spark, folder, name) for name in found}
    return tables.catalogue(frames).select(
        "table_name", F.col("total_rows").alias("n_rows"), F.col("total_columns").alias("n_columns")
    )


_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
    "l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


@query(
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing_count,
            COUNT(DISTINCT {c}) AS unique_count,
            CASE WHEN COUNT(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) > 0 THEN 'numeric'
                 WHEN COUNT(TRY_CAST(CAST({c} AS VARCHAR) AS DATE)) > 0 THEN 'datetime' ELSE 'categorical'
            END AS inferred_best_dtype FROM {t}"""
        for t, columns in _COLUMNS.items()
        for c in columns.split()
    )
)
def catalog_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of every column of every table in the folder."""
    found = tables.list_tables(spark, folder, ".parquet")
    catalogue = tables.column_catalogue({name: table(spark, folder, name) for name in found})
    return catalogue.select("table_name", "column_name", "missing_count", "unique_count", "inferred_best_dtype")


_LINEITEM_TYPES = {
    "l_orderkey": "numeric",
    "l_partkey": "numeric",
    "l_suppkey": "numeric",
    "l_linenumber": "numeric",
    "l_quantity": "numeric",
    "l_extendedprice": "numeric",
    "l_discount": "numeric",
    "l_tax": "numeric",
    "l_returnflag": "categorical",
    "l_linestatus": "categorical",
    "l_shipdate": "datetime",
}


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS logical_type, COUNT({c}) AS non_null_count FROM lineitem"
        for c, t in _LINEITEM_TYPES.items()
    )
)
def describe_table(spark: SparkSession, folder: str) -> DataFrame:
    return tables.describe(table(spark, folder, "lineitem"), "lineitem").select(
        "column_name", F.col("inferred_best_dtype").alias("logical_type"), "non_null_count"
    )


_ARPU_SQL = """
SELECT a.segment, COUNT(*) AS customer_count, ROUND(COALESCE(SUM(r.revenue), 0), 2) AS revenue,
       ROUND(COALESCE(SUM(r.revenue), 0) / COUNT(*), 4) AS arpu
FROM (SELECT DISTINCT customer_id, segment FROM contracts
      WHERE start_date <= DATE '1998-01-31' AND (end_date IS NULL OR end_date >= DATE '1998-01-01')) a
LEFT JOIN (SELECT customer_id, SUM(amount) AS revenue FROM transactions
           WHERE txn_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31' GROUP BY customer_id) r
  ON a.customer_id = r.customer_id
GROUP BY a.segment"""


@query(f"WITH {SEGMENTED}, {TRANSACTIONS} {_ARPU_SQL}")
def run_and_save(spark: SparkSession, folder: str) -> DataFrame:
    roles.segmented_contracts(spark, folder).createOrReplaceTempView("contracts")
    transactions(spark, folder).createOrReplaceTempView("transactions")
    saved = results.run_and_save(
        spark, _ARPU_SQL, work_dir(spark, "results"), "arpu_by_segment.csv", purpose="ARPU by segment, January 1998"
    )
    return saved.read()


@query(
    """SELECT 'status' AS sheet, o_orderstatus AS key, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total
       FROM orders GROUP BY o_orderstatus
       UNION ALL SELECT 'priority', o_orderpriority, COUNT(*), ROUND(SUM(o_totalprice), 2)
       FROM orders GROUP BY o_orderpriority"""
)
def result_book_replace(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")

    def totals(df: DataFrame, key: str, amount: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), money(F.sum(amount)).alias("total"))

    book = results.ResultBook(spark, work_dir(spark, "books"), "review")
    book.write_sheet(totals(table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice"), "status")
    book.write_sheet(totals(orders, "o_orderpriority", "o_totalprice"), "priority")
    book.write_sheet(totals(orders, "o_orderstatus", "o_totalprice"), "status")  # replaces the first
    sheets = [book.read_sheet(s).select(F.lit(s).alias("sheet"), "key", "n", "total") for s in book.sheets()]
    return sheets[0].unionByName(sheets[1])


def _json_length(table_name: str, columns: dict[str, str]) -> str:
    """SQL for the JSON characters of a table: names, quotes and separators are the same in each row."""
    fixed = sum(len(c) + 4 for c in columns) + 2 * (len(columns) - 1) + 2
    lengths = {
        "number": "LENGTH(CAST({c} AS VARCHAR))",
        "text": "LENGTH({c}) + 2",
        "timestamp": "25",  # 2020-01-01T00:00:00.000 in quotes
    }
    row = " + ".join(lengths[kind].format(c=c) for c, kind in columns.items())
    chars = f"CAST(SUM({row} + {fixed} + 2) AS BIGINT)"
    return (
        f"SELECT '{table_name}' AS table_name, {chars} AS json_chars, {chars} / 4.0 AS approx_tokens, "
        f"{chars} / 4.0 <= 20000 AS loadable FROM {table_name}"
    )


@query(
    _json_length("region", {"r_regionkey": "number", "r_name": "text"})
    + " UNION ALL "
    + _json_length(
        "lineitem",
        {c: "number" for c in list(_LINEITEM_TYPES)[:8]}
        | {"l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "timestamp"},
    )
)
def bounded_load_size(spark: SparkSession, folder: str) -> DataFrame:
    small = results.load_size(table(spark, folder, "region"), "region")
    return small.unionByName(results.load_size(table(spark, folder, "lineitem"), "lineitem"))


@query(
    """SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY event_type"""
)
def landing_ingest(spark: SparkSession, folder: str) -> DataFrame:
    base = work_dir(spark, "landing")
    events = table(spark, folder, "events")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    arrived = None
    for drop, rows in (("first", events.filter(F.col("ts") < half)), ("second", events.filter(F.col("ts") >= half))):
        tables.write_csv(rows, f"{base}/in/{drop}")
        arrived = ingest_landing(spark, f"{base}/in", f"{base}/table", f"{base}/checkpoint", events.schema)
    return arrived.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), money(F.sum("value")).alias("total"))


def _fallback_sql(name: str, numeric: bool) -> str:
    stats = (
        f'CAST(ROUND(MIN({name}), 3) AS DOUBLE) AS "min", CAST(ROUND(MAX({name}), 3) AS DOUBLE) AS "max", '
        f"ROUND(AVG({name}), 3) AS mean, ROUND(STDDEV_SAMP({name}), 3) AS std_dev"
        if numeric
        else 'NULL AS "min", NULL AS "max", NULL AS mean, NULL AS std_dev'
    )
    return (
        f"SELECT '{name}' AS column_name, COUNT(*) AS total_count, COUNT({name}) AS non_null_count, "
        f"COUNT(*) - COUNT({name}) AS missing_count, COUNT(DISTINCT {name}) AS unique_count, "
        f"'{'numeric' if numeric else 'categorical'}' AS inferred_best_dtype, {stats} FROM customer"
    )


@query(
    " UNION ALL ".join(
        _fallback_sql(c, n)
        for c, n in [
            ("c_custkey", True),
            ("c_name", False),
            ("c_nationkey", True),
            ("c_acctbal", True),
            ("c_mktsegment", False),
        ]
    )
)
def profile_fallback(spark: SparkSession, folder: str) -> DataFrame:
    path = work_dir(spark, "csv") + "/customer.csv"
    tables.write_csv(table(spark, folder, "customer"), path)
    return fallback_profile(tables.read_csv_as_text(spark, path).drop(tables.CORRUPT), "customer")


@query(
    """SELECT path, COUNT(*) AS n_queries FROM (
         SELECT 'data/' || event_type || '.csv' AS path FROM events
         UNION ALL
         SELECT 'data/user_' || CAST(user_id AS VARCHAR) || '.csv' FROM events WHERE event_type = 'purchase')
       GROUP BY path"""
)
def query_source_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as a logged query text: purchases read two files, everything else one."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    listed = F.concat(
        F.lit("SELECT * FROM READ_CSV(['data/"), kind, F.lit(".csv', 'data/user_"), user, F.lit(".csv'])")
    )
    single = F.concat(F.lit("SELECT COUNT(*) FROM read_csv( 'data/"), kind, F.lit(".csv' ) t"))
    log = table(spark, folder, "events").select(F.when(kind == "purchase", listed).otherwise(single).alias("sql"))
    return records.source_lineage(log, "sql")


# -- relational surface ------------------------------------------------------------------------


@query(
    f"""WITH {TRANSACTIONS}, sums AS (
          SELECT c_custkey AS customer_id, ROUND(COALESCE(SUM(amount), 0), 2) AS total_revenue
          FROM customer LEFT JOIN transactions ON customer_id = c_custkey GROUP BY c_custkey)
        SELECT customer_id, total_revenue, CASE WHEN total_revenue > 0 THEN 'Active' ELSE 'Inactive' END AS status
        FROM sums"""
)
def status_active_flag(spark: SparkSession, folder: str) -> DataFrame:
    revenue = ledger(spark, folder).revenue_by_customer()
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("customer"))
    total = money(F.coalesce("revenue", F.lit(0.0)))
    return customers.join(revenue, "customer", "left").select(
        F.col("customer").alias("customer_id"), total.alias("total_revenue"), commerce.status_flag(total).alias("status")
    )


@query(f"WITH {TRANSACTIONS} SELECT customer_id, ROUND(SUM(amount), 2) AS total_revenue FROM transactions GROUP BY customer_id")
def revenue_by_customer(spark: SparkSession, folder: str) -> DataFrame:
    return ledger(spark, folder).revenue_by_customer().select(
        F.col("customer").alias("customer_id"), money("revenue").alias("total_revenue")
    )


@query(
    f"""WITH {CONTRACTS} SELECT customer_id, contract_id, start_date, end_date FROM contracts c
        WHERE start_date = (SELECT MAX(start_date) FROM contracts l WHERE l.customer_id = c.customer_id)"""
)
def latest_status_records(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["customer_id", "contract_id", "start_date", "end_date"]
    return records.latest_records(roles.contracts(spark, folder).select(*columns), "customer_id", "start_date")


@query(
    f"""WITH {TRANSACTIONS} SELECT customer_id, txn_id, txn_date FROM transactions
        QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY txn_date DESC, txn_id DESC) = 1"""
)
def qualify_latest_order(spark: SparkSession, folder: str) -> DataFrame:
    orders = transactions(spark, folder).select("customer_id", "txn_id", "txn_date")
    return records.latest_records(orders, "customer_id", "txn_date", tie_break="txn_id")


@query("""SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def lookup_join(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    found = records.lookup(
        orders, F.col("o_custkey"), table(spark, folder, "customer"), "c_custkey", "c_mktsegment"
    )
    return found.select("o_orderkey", "c_mktsegment")


def _guarded(measure: str, value: str, digits: int) -> str:
    return f"""WITH {TRANSACTIONS}
        SELECT customer_id, CAST(DATE_TRUNC('month', txn_date) AS DATE) AS month,
               CASE WHEN COUNT(amount) >= 2 THEN ROUND({measure}(amount), {digits}) END AS {value}
        FROM transactions GROUP BY 1, 2"""


@query(_guarded("SUM", "total", 2), name="guarded_sum")
def guarded_sum_by_month(spark: SparkSession, folder: str) -> DataFrame:
    monthly = transactions(spark, folder).groupBy("customer_id", F.trunc("txn_date", "MM").alias("month"))
    return monthly.agg(money(guarded_sum(F.col("amount"))).alias("total"))


@query(_guarded("AVG", "mean", 4), name="guarded_mean")
def guarded_mean_by_month(spark: SparkSession, folder: str) -> DataFrame:
    monthly = transactions(spark, folder).groupBy("customer_id", F.trunc("txn_date", "MM").alias("month"))
    return monthly.agg(rounded(guarded_mean(F.col("amount")), 4).alias("mean"))


_MONTHLY = f"""{TRANSACTIONS}, monthly AS (
  SELECT CAST(DATE_TRUNC('month', txn_date) AS DATE) AS month, SUM(amount) AS revenue FROM transactions GROUP BY 1),
calendar AS (
  SELECT CAST(UNNEST(GENERATE_SERIES((SELECT MIN(month) FROM monthly), (SELECT MAX(month) FROM monthly),
                                     INTERVAL 1 MONTH)) AS DATE) AS month),
filled AS (
  SELECT c.month, COALESCE(m.revenue, 0) AS revenue FROM calendar c LEFT JOIN monthly m ON c.month = m.month)"""


@query(
    f"""WITH {_MONTHLY}, lagged AS (SELECT month, revenue, LAG(revenue) OVER (ORDER BY month) AS previous FROM filled)
        SELECT month, CASE WHEN revenue <> previous THEN ROUND(revenue - previous, 2) END AS signed,
               ROUND(ABS(revenue - previous), 2) AS absolute
        FROM lagged WHERE previous IS NOT NULL"""
)
def pair_difference(spark: SparkSession, folder: str) -> DataFrame:
    monthly = series.revenue_series(ledger(spark, folder), "month")
    return series.period_difference(monthly, "revenue").select(
        F.col("period_start").alias("month"), money("signed").alias("signed"), money("absolute").alias("absolute")
    )


_YEARS = list(range(1995, 2002))


@query(
    "SELECT c_mktsegment AS segment, "
    + ", ".join(
        f"ROUND(SUM(CASE WHEN YEAR(o_orderdate) = {y} THEN o_totalprice END), 2) AS y{y}" for y in _YEARS
    )
    + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"
)
def pivot_revenue_segment_year(spark: SparkSession, folder: str) -> DataFrame:
    per_customer = transactions(spark, folder).groupBy("customer_id", F.year("txn_date").alias("year")).agg(
        F.sum("amount").alias("amount")
    )
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment")
    )
    wide = records.pivot_sum(per_customer.join(customers, "customer_id"), "segment", "year", _YEARS, "amount", "y")
    return wide.select("segment", *[money(F.col(f"y{y}")).alias(f"y{y}") for y in _YEARS])


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, '{m}' AS measure, {m} AS value FROM lineitem"
        for m in _MEASURES
    )
)
def unpivot_lineitem_measures(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return records.unpivot(lines, ["l_orderkey", "l_linenumber"], _MEASURES, "measure", "value")


def _series_sql(unit: str) -> str:
    return f"""WITH {TRANSACTIONS}
        SELECT CAST(DATE_TRUNC('{unit}', txn_date) AS DATE) AS period_start, ROUND(SUM(amount), 2) AS revenue,
               COUNT(*) AS n
        FROM transactions GROUP BY 1"""


def _revenue_series(spark: SparkSession, folder: str, unit: str) -> DataFrame:
    return series.revenue_series(ledger(spark, folder), unit).withColumn("revenue", money("revenue"))


@query(_series_sql("month"))
def revenue_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return _revenue_series(spark, folder, "month")


@query(_series_sql("quarter"))
def revenue_by_quarter(spark: SparkSession, folder: str) -> DataFrame:
    return _revenue_series(spark, folder, "quarter")


@query(
    f"""WITH {_MONTHLY}
        SELECT month, ROUND(revenue, 2) AS revenue,
               ROUND(SUM(revenue) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS trailing_3m
        FROM filled"""
)
def trailing_window_revenue(spark: SparkSession, folder: str) -> DataFrame:
    monthly = series.revenue_series(ledger(spark, folder), "month")
    return series.trailing_sum(monthly, "revenue", 3).select(
        F.col("period_start").alias("month"),
        money("revenue").alias("revenue"),
        money("trailing").alias("trailing_3m"),
    )


def _growth_sql(lag: int) -> str:
    return f"""WITH {_MONTHLY}, lagged AS (
          SELECT month, revenue, LAG(revenue, {lag}) OVER (ORDER BY month) AS previous FROM filled)
        SELECT month, ROUND(revenue, 2) AS revenue, ROUND((revenue - previous) / NULLIF(previous, 0), 6) AS growth
        FROM lagged"""


def _growth(spark: SparkSession, folder: str, lag: int) -> DataFrame:
    monthly = series.revenue_series(ledger(spark, folder), "month")
    return series.growth(monthly, "revenue", lag).select(
        F.col("period_start").alias("month"),
        money("revenue").alias("revenue"),
        rounded("growth", 6).alias("growth"),
    )


@query(_growth_sql(1))
def revenue_growth_mom(spark: SparkSession, folder: str) -> DataFrame:
    return _growth(spark, folder, 1)


@query(_growth_sql(12))
def revenue_growth_yoy(spark: SparkSession, folder: str) -> DataFrame:
    return _growth(spark, folder, 12)


@query(
    f"""WITH {TRANSACTIONS} SELECT ROUND(SUM(amount), 2) AS total_revenue,
        COUNT(DISTINCT customer_id) AS customer_count, ROUND(AVG(amount), 6) AS avg_amount FROM transactions"""
)
def headline_facts(spark: SparkSession, folder: str) -> DataFrame:
    return commerce.headline_facts(ledger(spark, folder)).select(
        money("total_revenue").alias("total_revenue"),
        "customer_count",
        rounded("avg_amount", 6).alias("avg_amount"),
    )


@query(
    f"""WITH {TRANSACTIONS}, per_customer AS (
          SELECT customer_id, SUM(amount) AS s FROM transactions GROUP BY customer_id)
        SELECT a.route_a, b.route_b, ROUND(ABS(a.route_a - b.route_b), 2) AS abs_diff,
               ABS(a.route_a - b.route_b) <= 0.000001 * ABS(a.route_a) AS ok,
               b.mean_share BETWEEN 0 AND 1 AS share_in_range
        FROM (SELECT ROUND(SUM(amount), 2) AS route_a FROM transactions) a,
             (SELECT ROUND(SUM(s), 2) AS route_b, AVG(s) / SUM(s) AS mean_share FROM per_customer) b"""
)
def crosscheck_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Total revenue straight from the ledger and by way of customer totals."""
    book = ledger(spark, folder)
    direct = book.df.agg(money(F.sum("amount")))
    by_customer = book.revenue_by_customer()
    checked = series.crosscheck(direct, by_customer.agg(money(F.sum("revenue"))), 1e-6)
    share = by_customer.agg(F.avg("revenue") / F.sum("revenue")).scalar()
    return checked.select(
        "route_a",
        "route_b",
        money("abs_diff").alias("abs_diff"),
        "ok",
        series.within_range(share, 0.0, 1.0).alias("share_in_range"),
    )


# The numeric columns of the given tables.
_NUMBERS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"], "events": ["event_id", "user_id", "value"], "orders": ["o_orderkey", "o_custkey"],
    "documents": ["doc_id", "n_chars"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"],
    "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn"],
}


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, 1::BIGINT AS files, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS missing, COUNT({c}) AS numbers, "
        f"ROUND(MIN({c})::DOUBLE, 3) AS low, ROUND(MAX({c})::DOUBLE, 3) AS high, ROUND(AVG({c}), 3) AS mean, ROUND(STDDEV_SAMP({c}), 3) AS std_dev FROM {t}"
        for t, columns in _NUMBERS.items()
        for c in columns
    )
)
def catalogue_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the columns of a folder's tables, merged from summaries of each file."""
    found = summaries.catalogue_statistics(summaries.refresh(spark, folder, work_dir(spark, "summaries")))
    named = F.concat_ws(".", "table_name", "column_name").isin([f"{t}.{c}" for t, columns in _NUMBERS.items() for c in columns])
    return found.filter(named).select("table_name", "column_name", "files", "rows", "missing", "numbers", "low", "high", "mean", "std_dev")
