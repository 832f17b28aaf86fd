"""Datasets that are replaced as a whole: each write is a new version, readers see the last complete one.

Nothing is overwritten in place, so a write may read the version it replaces, and a job that dies
half way leaves the previous version in force.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyspark.sources import files

COMPLETE = "_COMPLETE"


@dataclass(frozen=True)
class VersionedDataset:
    spark: SparkSession
    path: str

    def versions(self) -> list[str]:
        return [n for n in files.list_names(self.spark, self.path) if n.startswith("v")]

    def latest(self) -> str | None:
        """The newest version whose parts were all written."""
        for version in reversed(self.versions()):
            if files.exists(self.spark, f"{self.path}/{version}/{COMPLETE}"):
                return version
        return None

    def write(
        self,
        parts: dict[str, DataFrame | Callable[[str], DataFrame]],
        check: Callable[[str], None] | None = None,
        options: dict[str, dict[str, str]] | None = None,
    ) -> str:
        """Write all parts as the next version. Two writers racing for one version: the second fails.

        A part may be a function of the version, which reads parts written before it; ``options`` are those of the
        writer, by part. ``check`` looks at the version before it comes into force; if it raises, the old version stays.
        """
        taken = self.versions()
        version = f"v{(int(taken[-1][1:]) if taken else 0) + 1:08d}"
        for part, made in parts.items():
            df = made(version) if callable(made) else made
            writer = df.write.mode("errorifexists").options(**(options or {}).get(part, {}))
            writer.parquet(f"{self.path}/{version}/{part}")
        if check is not None:
            check(version)
        files.write_text(self.spark, f"{self.path}/{version}/{COMPLETE}", "")
        return version

    def read(self, version: str, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{version}/{part}")
