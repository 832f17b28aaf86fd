"""Persisting query results: saved results with their SQL, bounded loads, result books."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime
from pathlib import PurePosixPath
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.profile import TableProfile
from tallyspark.sources import files, tables
from tallyspark.sources.versioned import VersionedDataset

# A full load may hold 20,000 tokens of four JSON characters each.
MAX_LOAD_TOKENS = 20_000
CHARACTERS_PER_TOKEN = 4
DEFAULT_SHEET = "Sheet1"


@dataclass(frozen=True)
class SavedResult:
    """Where a result and its SQL were written, and the profile of what was written."""

    purpose: str
    sql_path: str
    result_path: str
    profile: TableProfile
    is_task_result: bool = False

    def read(self) -> DataFrame:
        return self.profile.df


def run_and_save(
    spark: SparkSession,
    query: str,
    folder: str,
    file_name: str | None = None,
    *,
    purpose: str = "",
    is_task_result: bool = False,
    file_format: str = "parquet",
) -> SavedResult:
    """Run SQL, write its result and its text side by side, and profile what was written.

    Only the base name of ``file_name`` counts and its suffix is replaced; a name already taken gets
    a unique ending. The result goes from the executors to storage, never through the driver.
    """
    stem = PurePosixPath(file_name).stem if file_name else datetime.now().strftime("result_%Y%m%d_%H%M%S")
    if files.exists(spark, f"{folder}/{stem}.{file_format}"):
        stem = f"{stem}_{uuid.uuid4()}"
    path = f"{folder}/{stem}.{file_format}"
    result = spark.sql(query)
    if file_format == "csv":
        tables.write_csv(result, path)
        stored = tables.read_csv(spark, path, schema=result.schema, empty_texts=True)
    else:
        result.write.mode("errorifexists").format(file_format).save(path)
        stored = spark.read.format(file_format).load(path)
    files.write_text(spark, f"{folder}/{stem}.sql", query.strip())
    return SavedResult(purpose, f"{folder}/{stem}.sql", path, TableProfile(stored, stem), is_task_result)


def load_size(df: DataFrame, name: str = "table") -> DataFrame:
    """Characters the table takes as a JSON list of records, tokens, and whether a load is allowed."""
    width = len(df.columns)
    record = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    # Records are written with a blank after each colon and comma, and joined by ", ".
    spaced = record + (2 * width - 1) + 2
    characters = F.coalesce(F.sum(spaced), F.lit(2)).cast("long")
    return df.agg(characters.alias("json_chars")).select(
        F.lit(name).alias("table_name"),
        "json_chars",
        (F.col("json_chars") / CHARACTERS_PER_TOKEN).alias("approx_tokens"),
        (F.col("json_chars") / CHARACTERS_PER_TOKEN <= MAX_LOAD_TOKENS).alias("loadable"),
    )


class ResultTooLarge(ValueError):
    """Raised instead of loading; carries the profile so the caller can narrow the query."""

    def __init__(self, name: str, tokens: float, profile: TableProfile):
        super().__init__(f"{name} has about {tokens:.0f} tokens; at most {MAX_LOAD_TOKENS} can be loaded")
        self.profile = profile


def load_bounded(df: DataFrame, name: str = "table") -> list[Row]:
    """All rows of a small result. The size is measured on the executors before anything is fetched."""
    size = load_size(df, name).head()
    if not size["loadable"]:
        raise ResultTooLarge(name, size["approx_tokens"], TableProfile(df, name))
    return df.collect()


def sheet_key(sheet_name: str) -> str:
    """The folder of a sheet: its full name, with what a path cannot hold escaped; a default for a blank one."""
    return quote(sheet_name or DEFAULT_SHEET, safe="")


@dataclass(frozen=True)
class ResultBook:
    """Named result sheets under one folder; each sheet keeps its own schema.

    Writing a sheet replaces that sheet only. The old content stays in force until the new one is
    complete and verified.
    """

    spark: SparkSession
    folder: str
    name: str

    def _sheet(self, sheet_name: str) -> VersionedDataset:
        return VersionedDataset(self.spark, f"{self.folder}/book={self.name}/sheet={sheet_key(sheet_name)}")

    def sheets(self) -> list[str]:
        names = files.list_names(self.spark, f"{self.folder}/book={self.name}")
        return [unquote(n.removeprefix("sheet=")) for n in names if n.startswith("sheet=")]

    def write_sheet(self, df: DataFrame, sheet_name: str) -> str:
        """Add or replace a sheet, then read it back and compare its columns and row count.

        The rows are counted while they are written, so the check costs no second run of the query.
        """
        dataset, written = self._sheet(sheet_name), Observation()

        def check(version: str) -> None:
            stored = dataset.read(version, "rows")
            if stored.columns != df.columns or stored.count() != written.get["rows"]:
                raise IOError(f"sheet {sheet_name!r} did not come back as it was written")

        return dataset.write({"rows": df.observe(written, F.count(F.lit(1)).alias("rows"))}, check)

    def read_sheet(self, sheet_name: str) -> DataFrame:
        dataset = self._sheet(sheet_name)
        version = dataset.latest()
        if version is None:
            raise FileNotFoundError(f"book {self.name!r} has no sheet {sheet_key(sheet_name)!r}")
        return dataset.read(version, "rows")
