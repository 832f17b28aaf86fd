"""Which columns of a table play which part in a metric."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    """A period with both ends included, as ISO dates."""

    start: str
    end: str

    @property
    def first(self) -> Column:
        return F.lit(self.start).cast("date")

    @property
    def last(self) -> Column:
        return F.lit(self.end).cast("date")

    def holds(self, date: Column) -> Column:
        return date.between(self.first, self.last)


@dataclass(frozen=True)
class Statuses:
    """Subscription, contract or plan records: who was a customer from when to when.

    A NULL end means still running. A record is active *as of* a day before its end date, and
    active *during* a period that its interval touches.
    """

    df: DataFrame
    customer: str = "customer_id"
    start: str = "start_date"
    end: str = "end_date"

    def active_as_of(self, day: Column) -> Column:
        end = F.col(self.end)
        return (F.col(self.start) <= day) & (end.isNull() | (end > day))

    def active_during(self, period: Period) -> Column:
        end = F.col(self.end)
        return (F.col(self.start) <= period.last) & (end.isNull() | (end >= period.first))


@dataclass(frozen=True)
class Ledger:
    """Transactions, orders or payments: who paid how much when."""

    df: DataFrame
    customer: str = "customer_id"
    date: str = "txn_date"
    amount: str = "amount"

    def within(self, period: Period) -> DataFrame:
        return self.df.filter(period.holds(F.col(self.date)))

    def revenue_by_customer(self, period: Period | None = None) -> DataFrame:
        """(customer, revenue): one row per customer, summed before anything is joined to it."""
        rows = self.df if period is None else self.within(period)
        return rows.groupBy(F.col(self.customer).alias("customer")).agg(F.sum(self.amount).alias("revenue"))
