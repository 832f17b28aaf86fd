"""Landing ingest: new CSV files in a folder become rows of a parquet table, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyspark.sources.tables import CORRUPT, reader_options


def ingest_landing(
    spark: SparkSession, landing: str, table: str, checkpoint: str, schema: T.StructType, files_per_batch: int = 1000
) -> DataFrame:
    """Append every CSV file not seen before to ``table`` and return the table.

    Runs as an available-now stream: the checkpoint remembers which files are in, so the call can be
    repeated on a schedule, and a lost executor or a restart neither drops nor doubles a file. A line that does not fit
    fails the run, or is kept whole in the column ``_corrupt_record`` where the schema has one.
    """
    mode = "PERMISSIVE" if CORRUPT in schema.names else "FAILFAST"
    stream = (
        spark.readStream.schema(schema)
        .options(**reader_options(line_breaks=True, mode=mode))
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(landing)
    )
    query = (
        stream.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(table)
