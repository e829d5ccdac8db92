"""Star schema: dimensions with dense keys, a date dimension, a fact table, and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import col
from tabloom.operators.order import number_rows


def star_tables(df: DataFrame, dimensions: dict[str, list[str]], date: str, order_key: str | None = None, order_by: list[str] = ()) -> dict[str, DataFrame]:
    """dim_<name> (key, attributes) sorted, dim_date by day, and fact with keys; repeated order keys keep their first row."""
    out, fact = {}, df
    if order_key:
        fact = fact.withColumn("_n", F.row_number().over(Window.partitionBy(order_key).orderBy(*(order_by or df.columns)))).where("_n = 1").drop("_n")
    for name, columns in dimensions.items():
        # one row for each member, numbered by ranges
        dim = number_rows(fact.select(*columns).distinct(), [col(c).asc_nulls_last() for c in columns], "_at").withColumn(f"{name}_key", (F.col("_at") + 1).cast("int")).drop("_at")
        test = [fact[c].eqNullSafe(dim[c]) for c in columns]
        fact = fact.join(dim, test, "left").drop(*[dim[c] for c in columns]).drop(*columns)
        out[f"dim_{name}"] = dim.select(f"{name}_key", *columns)
    ends = df.agg(F.min(col(date)).cast("date").alias("a"), F.max(col(date)).cast("date").alias("b"))
    days = ends.where("a is not null").select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("date"))
    out["dim_date"] = days.select("date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"), F.weekday("date").alias("weekday"))
    out["fact"] = fact.withColumn("date_key", col(date).cast("date"))
    return out


def measures(fact: DataFrame, date: str, sales: str, cost: str, order: str, units: str) -> DataFrame:
    """By month: totals, margin, orders, value of an order, year to date, last year and growth."""
    m = fact.groupBy(F.date_trunc("month", col(date)).cast("date").alias("month")).agg(F.sum(sales).alias("sales"), F.sum(cost).alias("cost"), F.count_distinct(order).alias("orders"), F.sum(units).alias("units"))
    m = m.withColumn("profit", F.col("sales") - F.col("cost")).withColumn("margin", F.try_divide(F.col("profit"), F.col("sales"))).withColumn("order_value", F.try_divide(F.col("sales"), F.col("orders")))
    m = m.withColumn("sales_ytd", F.sum("sales").over(Window.partitionBy(F.year("month")).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))
    last = m.select(F.add_months("month", 12).alias("month"), F.col("sales").alias("sales_last_year"))
    return m.join(last, "month", "left").withColumn("growth", F.try_divide(F.col("sales") - F.col("sales_last_year"), F.col("sales_last_year")))
