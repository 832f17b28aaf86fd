"""Statistics of every file of a folder, kept beside it: a folder that grows reads only its new files.

A file's summary is one row per column of counts, moments, extremes and a distinct sketch, all of which merge. They are kept by path, size and
time of change; a refresh scans the files it has not seen so, all together, and drops those that are gone. A table's statistics are merged
from the summaries of its files, without reading one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.safe import as_date, as_number, as_text, column, rounded
from tallyspark.sources import files, tables
from tallyspark.sources.versioned import VersionedDataset

PART = "summaries"
#: Columns of a file summarized by one aggregate, so that its generated code stays small.
BLOCK = 6
FILES = "table_name string, file string, size long, modified long"
_KEY = ["file", "size", "modified"]
_STATS = (
    "column_name string, dtype string, rows long, present long, numbers long, mean double, m2 double, low double, high double, "
    "first_day date, last_day date, longest int, uniques binary"
)


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[tuple[str, str, int, int]]:
    """(table, path, size, time of change) of every data file under the tables of a folder; a table is a file or a directory."""
    found = []
    for name, path in tables.list_tables(spark, folder, suffix).items():
        found += [(name, *facts) for facts in files.data_files(spark, path)]
    return found


def _measures(field: T.StructField) -> list[tuple[str, str]]:
    """Aggregates of one column as (name, SQL over _r raw, _n number, _d day, _t text)."""
    return [
        ("column_name", f"first('{field.name.replace(chr(39), chr(92) + chr(39))}')"), ("dtype", f"first('{field.dataType.simpleString()}')"),
        ("rows", "count(1)"), ("present", "count({r})"), ("numbers", "count({n})"), ("mean", "avg({n})"), ("m2", "var_pop({n}) * count({n})"),
        ("low", "min({n})"), ("high", "max({n})"), ("first_day", "min({d})"), ("last_day", "max({d})"), ("longest", "max(length({t}))"),
        ("uniques", "hll_sketch_agg({t})"),
    ]


def summarize(df: DataFrame) -> DataFrame:
    """One row for each file that a DataFrame reads and each of its columns; one scan for each block of columns."""
    parts = []
    fields = df.schema.fields
    for at in range(0, len(fields), BLOCK):
        readings, structs = [F.col("_metadata.file_path").alias("_file")], []
        for i, field in enumerate(fields[at : at + BLOCK]):
            value = column(field.name)
            readings += [
                value.isNotNull().alias(f"_p{i}"), as_number(value, field.dataType).alias(f"_n{i}"),
                as_date(value, field.dataType).alias(f"_d{i}"), as_text(value, field.dataType).alias(f"_t{i}"),
            ]
            names = {"r": f"CASE WHEN _p{i} THEN 1 END", "n": f"_n{i}", "d": f"_d{i}", "t": f"_t{i}"}
            structs.append(F.struct(*(F.expr(sql.format(**names)).alias(name) for name, sql in _measures(field))))
        grouped = df.select(*readings).groupBy("_file").agg(F.array(*structs).alias("stats"))
        parts.append(grouped.select(F.col("_file").alias("file"), F.inline("stats")))
    return tables.union(parts)


def refresh(spark: SparkSession, folder: str, store: str, suffix: str = ".parquet") -> DataFrame:
    """Bring the summaries under ``store`` up to date and return them: one row for each file and column."""
    listed = list_files(spark, folder, suffix)
    dataset = VersionedDataset(spark, store)
    version = dataset.latest()
    held = dataset.read(version, PART) if version else spark.createDataFrame([], f"{FILES}, {_STATS}")
    known = {tuple(r) for r in held.select("table_name", *_KEY).distinct().collect()}  # one row per file
    if version and known == set(listed):
        return held
    fresh: dict[str, list[tuple]] = {}
    for entry in set(listed) - known:
        fresh.setdefault(entry[0], []).append(entry)
    parts = [held.join(spark.createDataFrame(listed, FILES), ["table_name", *_KEY], "left_semi")]
    for entries in fresh.values():
        paths = [path for _, path, _, _ in entries]
        df = tables.read_csv_as_text(spark, paths).drop(tables.CORRUPT) if suffix == ".csv" else spark.read.parquet(*paths)
        # Spark writes the scheme of a local path in another way than the listing
        named = spark.createDataFrame(entries, FILES).withColumn("_bare", _bare("file"))
        found = summarize(df).withColumn("_bare", _bare("file")).drop("file")
        parts.append(found.join(named, "_bare"))
    order = [f.name for f in held.schema.fields]
    return dataset.read(dataset.write({PART: tables.union([part.select(*order) for part in parts])}), PART)


def _bare(name: str):
    return F.regexp_replace(name, "^file:/*", "/")


def statistics(summaries: DataFrame) -> DataFrame:
    """Per table and column, merged over the files: rows, missing and distinct values, numbers with mean, deviation and extremes, days, longest text.

    ``unique_values`` comes from the merged sketches and is an estimate.
    """
    n = F.sum("numbers")
    mean = F.sum(F.col("mean") * F.col("numbers")) / n
    # deviations of the files from the mean of all: sum n (m - M)^2 = sum n m^2 - n M^2, taken about the first mean against cancellation
    whole = summaries.join(
        summaries.groupBy("table_name", "column_name").agg(F.when(n > 0, mean).alias("all_mean")), ["table_name", "column_name"]
    )
    spread = F.sum(F.col("m2") + F.col("numbers") * (F.col("mean") - F.col("all_mean")) ** 2)
    return whole.groupBy("table_name", "column_name").agg(
        F.count_distinct("file").alias("files"), F.sum("rows").alias("rows"), (F.sum("rows") - F.sum("present")).alias("missing"),
        n.alias("numbers"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("all_mean").alias("mean"),
        F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std_dev"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
        F.max("longest").alias("longest"), F.hll_sketch_estimate(F.hll_union_agg("uniques")).alias("unique_values"),
    )


def catalogue_statistics(summaries: DataFrame) -> DataFrame:
    """The statistics with rounded numbers, as a catalogue shows them."""
    return statistics(summaries).select(
        "table_name", "column_name", "files", "rows", "missing", "numbers", rounded("low", 3).alias("low"), rounded("high", 3).alias("high"),
        rounded("mean", 3).alias("mean"), rounded("std_dev", 3).alias("std_dev"), "first_day", "last_day", "longest", "unique_values",
    )
