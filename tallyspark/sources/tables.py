"""Reading tables: CSV with headers, several files as one table, catalogues of a folder."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.profile import TableProfile
from tallyspark.sources import files


def check_sources(spark: SparkSession, paths: list[str]) -> None:
    """Fail before any plan is built when a named source is missing."""
    missing = [p for p in paths if not files.exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"source not found: {', '.join(missing)}")


#: The common dialect, for reading and writing: quotes are doubled inside quoted fields, blanks are kept.
DIALECT = {
    "header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
CORRUPT = "_corrupt_record"
#: Stands for a field without content where an empty text is a value; no text file holds it.
NO_TEXT = "\u0000"
#: Header lines are read by this many threads, as a folder may hold very many files.
HEADER_READERS = 32


def reader_options(line_breaks: bool, mode: str) -> dict[str, str]:
    """Options of a scan. All columns of a line are looked at, so that no ill-fitting line passes for want of a column."""
    more = {"multiLine": str(line_breaks).lower(), "mode": mode, "columnPruning": "false", "columnNameOfCorruptRecord": CORRUPT}
    return DIALECT | more


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType | None = None,
    *,
    line_breaks: bool = True,
    empty_texts: bool = False,
) -> DataFrame:
    """CSV files with a header row as one table.

    Types are inferred unless a schema is given (inference costs one more pass over the data). Files are matched by column
    name: files sharing a header are scanned together, also within a directory, and columns missing from a file are NULL.
    Where files with different headers disagree on a type, numbers become doubles and anything else text.

    A line that does not fit fails the query; ``quarantine.load_csv`` goes on with the others and keeps such lines apart. Quoted fields may hold line
    breaks, for which each file is read by one task; ``line_breaks=False`` lets large files be split. An empty field is
    NULL; with ``empty_texts`` only one without quotes is, and ``""`` an empty text.
    """
    options = reader_options(line_breaks, "FAILFAST") | ({"nullValue": NO_TEXT} if empty_texts else {})
    paths = [paths] if isinstance(paths, str) else list(paths)
    check_sources(spark, paths)
    groups = by_header(spark, paths)
    schemas = [schema] * len(groups) if schema is not None else inferred_schemas(spark, groups, line_breaks, options)
    return union([_scan(spark, group, s, options) for group, s in zip(groups, schemas)])


def inferred_schemas(spark: SparkSession, groups: list[list[str]], line_breaks: bool, options: dict[str, str] | None = None) -> list[T.StructType]:
    """A schema for each group of files, in which columns of one name have one type."""
    # a line that does not fit is met when the rows are read, not while types are inferred
    options = (options or reader_options(line_breaks, "FAILFAST")) | {"mode": "PERMISSIVE"}
    inferred = [spark.read.options(**options).option("inferSchema", True).csv(group).schema for group in groups]
    common = _common_types(inferred)
    return [T.StructType([T.StructField(f.name, common[f.name]) for f in found]) for found in inferred]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _common_types(schemas: list[T.StructType]) -> dict[str, T.DataType]:
    kinds: dict[str, list[T.DataType]] = {}
    for field in (f for schema in schemas for f in schema):
        kinds.setdefault(field.name, []).append(field.dataType)

    def common(types: list[T.DataType]) -> T.DataType:
        if len(set(types)) == 1:
            return types[0]
        if all(isinstance(t, T.IntegralType) for t in types):
            return T.LongType()
        return T.DoubleType() if all(isinstance(t, T.NumericType) for t in types) else T.StringType()

    return {name: common(types) for name, types in kinds.items()}


def by_header(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Paths grouped by header line; a directory is taken apart only if its files differ. Empty files have no rows."""

    def members(path: str) -> list[str]:
        if not files.is_dir(spark, path):
            return [path]
        names = [n for n in files.list_names(spark, path) if not n.startswith(("_", "."))]
        return [m for n in names for m in members(f"{path.rstrip('/')}/{n}")]

    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        for path in paths:
            parts = members(path)
            headers = list(pool.map(lambda part: files.first_line(spark, part), parts))
            # left whole, a directory may hold partition columns in its path
            if len(set(headers)) <= 1:
                groups.setdefault(headers[0] if headers else "", []).append(path)
                continue
            for header, part in zip(headers, parts):
                if header:
                    groups.setdefault(header, []).append(part)
    return list(groups.values())


def _scan(spark: SparkSession, paths: list[str], schema: T.StructType, options: dict[str, str]) -> DataFrame:
    return spark.read.options(**options).option("enforceSchema", False).schema(schema).csv(paths)


def write_csv(df: DataFrame, path: str) -> None:
    """Write in the dialect ``read_csv`` reads."""
    df.write.options(**DIALECT).csv(path)


def read_csv_as_text(
    spark: SparkSession, paths: str | list[str], *, columns: list[str] | None = None, line_breaks: bool = True
) -> DataFrame:
    """Every column as text, the way in when lines do not fit: ``_corrupt_record`` holds the whole of each such line.

    ``columns`` names the columns of files that have no header.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    check_sources(spark, paths)

    def scan(group: list[str]) -> DataFrame:
        reader = spark.read.options(**reader_options(line_breaks, "PERMISSIVE")).option("header", columns is None)
        names = [*(columns or reader.csv(group).columns), CORRUPT]
        return reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(group)

    return union([scan(group) for group in (by_header(spark, paths) if columns is None else [paths])])


def malformed_lines(text_table: DataFrame) -> DataFrame:
    """(total_rows, malformed_rows) of a table read as text."""
    first = F.col(f"`{text_table.columns[0]}`")  # Spark reads the corrupt lines only beside another column
    return text_table.agg((F.count(first) + F.count_if(first.isNull())).alias("total_rows"), F.count(CORRUPT).alias("malformed_rows"))


def list_tables(spark: SparkSession, folder: str, suffix: str = ".csv") -> dict[str, str]:
    """Table name to path for every file or directory of the folder with the suffix."""
    return {
        name[: -len(suffix)]: f"{folder.rstrip('/')}/{name}"
        for name in files.list_names(spark, folder)
        if name.endswith(suffix)
    }


def register_tables(spark: SparkSession, folder: str, suffix: str = ".csv") -> dict[str, DataFrame]:
    """Read every table of a folder and make it queryable by name."""
    tables = {}
    for name, path in list_tables(spark, folder, suffix).items():
        df = read_csv(spark, path) if suffix == ".csv" else spark.read.parquet(path)
        df.createOrReplaceTempView(name)
        tables[name] = df
    return tables


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """One summary row per table."""
    return reduce(DataFrame.unionByName, [TableProfile(df, name).summary() for name, df in tables.items()])


def column_catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table and column: type, missing and distinct values."""
    frames = []
    for name, df in tables.items():
        profile = TableProfile(df, name)
        # One row per column on either side.
        types = profile.types().select("table_name", "column_name", "original_dtype", "inferred_best_dtype")
        frames.append(types.join(profile.quality().hint("broadcast"), "column_name"))
    return reduce(DataFrame.unionByName, frames)


def describe(df: DataFrame, name: str = "table") -> DataFrame:
    """Column names with declared and logical types."""
    return TableProfile(df, name).types()
