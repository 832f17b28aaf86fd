"""Every named query against its SQL, exactly."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry
from tallyspark.plans import catalog
from tests.oracle import connect, difference, spark_rows

def queries():
    """The library's own queries; those of the training-data operators are tested beside them."""
    return dict(catalog.QUERIES)


def oracle_sql():
    return dict(catalog.ORACLES)


FOLDER = f"/root/testdata/sf{os.environ.get('TEST_SF', '0.001')}"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_its_sql(spark, duck, name):
    assert difference(duck, queries()[name](spark, FOLDER), oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_flagship(spark):
    names, found = spark_rows(entry(spark))
    assert names == ["arpu", "customer_count", "revenue", "segment"] and len(found) == 5


@pytest.mark.parametrize(
    "name, column, value",
    [
        ("mrr", "active_customers", 1316),
        ("mrr", "mrr", 48899405.48),
        ("churn_rate_simple", "churned_customers", 115),
        ("churn_rate_latest", "cohort_rows", 544),
        ("churn_rate_latest", "churned", 151),
        ("revenue_retention", "revenue_retention", 0.595812),
        ("cac", "new_customers", 86),
        ("cac", "cac", 93.4133),
        ("commission_rate", "rate", 0.039934),
        ("repeat_purchase_rate", "repeaters", 1498),
        ("kg_stats", "entities", 1630),
        ("kg_stats", "observations", 600),
        ("kg_stats", "relations", 1625),
    ],
)
def test_known_values(spark, name, column, value):
    """Numbers established for the 0.01 tables before anything was built."""
    assert queries()[name](spark, "/root/testdata/sf0.01").first()[column] == value


@pytest.mark.parametrize(
    "name, n", [("active_as_of", 1309), ("active_during", 1330), ("active_without_revenue", 1155)]
)
def test_known_counts(spark, name, n):
    assert queries()[name](spark, "/root/testdata/sf0.01").count() == n
