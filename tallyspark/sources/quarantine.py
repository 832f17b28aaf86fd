"""CSV files in which some lines do not fit: the good rows go on with their types, the bad lines are kept apart, with their files.

Everything is written in one pass, which also counts both kinds, so that whoever reads the good rows can tell how many lines are missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.safe import column
from tallyspark.operators.profile import TableProfile
from tallyspark.sources import files, tables

_FILE, _FITS = "_source_file", "_fits"
BAD_LINES = "file string, line string"


@dataclass(frozen=True)
class Loaded:
    """``rows`` with their types, ``bad`` lines (file, line), and how many of each there are."""

    rows: DataFrame
    bad: DataFrame
    n_rows: int
    n_bad: int

    def profile(self, name: str = "table") -> DataFrame:
        """Summary of the good rows, with the bad lines beside it."""
        return TableProfile(self.rows, name).summary().withColumn("malformed_rows", F.lit(self.n_bad).cast("long"))


def load_csv(
    spark: SparkSession, paths: str | list[str], folder: str, schema: T.StructType | None = None, *, line_breaks: bool = True
) -> Loaded:
    """Read CSV files as :func:`tallyspark.sources.tables.read_csv` does, but lines with a field too many or too few, or with a
    value that the given schema cannot hold, go to a dataset of their own under ``folder`` instead of failing the query.

    The rows are written too, and read from there: the files are parsed once, whoever uses the rows how often.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    tables.check_sources(spark, paths)
    groups = tables.by_header(spark, paths)
    schemas = [schema] * len(groups) if schema is not None else tables.inferred_schemas(spark, groups, line_breaks)
    parts = []
    for group, known in zip(groups, schemas):
        kept = T.StructType([*known.fields, T.StructField(tables.CORRUPT, T.StringType())])
        reader = spark.read.options(**tables.reader_options(line_breaks, "PERMISSIVE")).option("enforceSchema", False)
        parts.append(reader.schema(kept).csv(group).select("*", F.col("_metadata.file_path").alias(_FILE)))
    read = tables.union(parts)
    fits, names = F.col(tables.CORRUPT).isNull(), [n for n in read.columns if n not in (tables.CORRUPT, _FILE)]
    # a bad line keeps its text alone, a good row its fields alone
    values = [F.when(fits, column(n)).alias(n) for n in names]
    sorted_out = read.select(*values, F.when(~fits, F.col(_FILE)).alias(_FILE), tables.CORRUPT, fits.alias(_FITS))
    seen = Observation()
    counted = sorted_out.observe(seen, F.count_if(_FITS).alias("rows"), F.count_if(~F.col(_FITS)).alias("bad"))
    counted.write.partitionBy(_FITS).parquet(folder)
    counts = seen.get
    whole = T.StructType([f for f in sorted_out.schema.fields if f.name != _FITS])

    def part(of: str) -> DataFrame:
        path = f"{folder}/{_FITS}={of}"
        return spark.read.schema(whole).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], whole)

    bad = part("false").select(F.col(_FILE).alias("file"), F.col(tables.CORRUPT).alias("line"))
    return Loaded(part("true").drop(_FILE, tables.CORRUPT), bad, counts["rows"], counts["bad"])
