"""Window expressions over grouped tables, or over tables of a row for each group. Whole tables are ranked by order.add_ranks."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import col


def rank_min(c: str | Column, by: list[str] = ()) -> Column:
    """Largest first, ties share the smallest rank, nulls stay null."""
    return F.when(col(c).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(col(c).desc_nulls_last())))


def pct_rank_average(c: str | Column, by: list[str] = ()) -> Column:
    """Average rank over the number of rows, in (0, 1]."""
    x = col(c)
    return (F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2) / F.count("*").over(Window.partitionBy(*by))


def running_sum(c: str | Column, order: list, by: list[str] = ()) -> Column:
    return F.sum(col(c)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def change(c: str | Column, order: list, by: list[str] = ()) -> Column:
    return col(c) - F.lag(col(c)).over(Window.partitionBy(*by).orderBy(*order))


def pct_change(c: str | Column, order: list, by: list[str] = ()) -> Column:
    """Null after a zero or an unknown value."""
    return F.try_divide(col(c), F.lag(col(c)).over(Window.partitionBy(*by).orderBy(*order))) - 1


def share_of(c: str | Column, by: list[str] = ()) -> Column:
    return F.try_divide(col(c), F.sum(col(c)).over(Window.partitionBy(*by)))


def group_total(c: str | Column, by: list[str]) -> Column:
    return F.sum(col(c)).over(Window.partitionBy(*by))


def is_repeated(by: list[str]) -> Column:
    return F.count("*").over(Window.partitionBy(*by)) > 1


def is_rising(c: str | Column, order: list, by: list[str]) -> Column:
    """Aggregates with bool_and to: every value is above the one before."""
    before = F.lag(col(c)).over(Window.partitionBy(*by).orderBy(*order))
    return before.isNull() | (col(c) > before)
