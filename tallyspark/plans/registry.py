"""Registration of named queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Build], Build]:
    """Register a query under its function name; ``oracle`` is equivalent ANSI SQL."""

    def register(build: Build) -> Build:
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = build
        if oracle is not None:
            ORACLES[key] = oracle
        return build

    return register
