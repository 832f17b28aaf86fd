from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from tallyspark.session import local_session


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return local_session(8)


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"


def rows(df, *order: str) -> list[tuple]:
    """Rows as plain tuples, in a fixed order."""
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
