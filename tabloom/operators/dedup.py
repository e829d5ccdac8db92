"""Deduplication. A survivor is always chosen by a total order, never by chance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import col, is_missing

from .relational import OperatorError, require_columns


def drop_duplicates(df: DataFrame, keys: list[str] | None = None, keep: str = "first", order_by: list[str] = ()) -> DataFrame:
    """keep: first or last row by order_by (all columns complete the order), or none of a repeated key."""
    keys = keys or df.columns
    require_columns(df, *keys)
    if keep == "none":
        return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")
    order = [*order_by, *[c for c in df.columns if c not in order_by]]
    order = [col(c).asc() if keep == "first" else col(c).desc() for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def guarded_dedup(df: DataFrame, keys: list[str], allow_conflicts: bool = False, order_by: list[str] = ()) -> dict[str, DataFrame]:
    """primary: one row for each key; rejected: the others. A missing key, or differing rows of one key, is an error."""
    require_columns(df, *keys)
    if not df.where(reduce(lambda a, b: a | b, map(is_missing, keys))).isEmpty():
        raise OperatorError("a key is missing")
    if not allow_conflicts and not df.distinct().groupBy(*keys).count().where("count > 1").isEmpty():
        raise OperatorError("rows of one key differ")
    order = [*order_by, *[c for c in df.columns if c not in order_by]]
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return {"primary": ranked.where("_n = 1").drop("_n"), "rejected": ranked.where("_n > 1").drop("_n")}


def deduplicate_events(df: DataFrame, keys: list[str], ignore: list[str] = ()) -> DataFrame:
    """Exact repeats of a business key go; differing contents are an error; rows with a missing key stay."""
    content = [c for c in df.columns if c not in ignore]
    missing = reduce(lambda a, b: a | b, map(is_missing, keys))
    keyed = df.where(~missing)
    if not keyed.select(*content).distinct().groupBy(*keys).count().where("count > 1").isEmpty():
        raise OperatorError("an event has differing contents")
    one = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*df.columns))).where("_n = 1").drop("_n")
    return one.unionByName(df.where(missing))


def unique_master(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows whose key must be unique and not missing."""
    out = df.distinct()
    if not out.where(reduce(lambda a, b: a | b, map(is_missing, keys))).isEmpty() or not out.groupBy(*keys).count().where("count > 1").isEmpty():
        raise OperatorError("master keys repeat or are missing")
    return out


def exact_unique(df: DataFrame, provenance: list[str], order_by: list[str]) -> DataFrame:
    """One row for each content; of its provenance the first by order_by."""
    content = [c for c in df.columns if c not in provenance]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*content).orderBy(*order_by))).where("_n = 1").drop("_n")


def version_select(df: DataFrame, keys: list[str], version: str, critical: list[str], order_by: list[str] = ()) -> DataFrame:
    """Adds status: current (one row of the largest version), superseded, duplicate, quarantined (a bad version, or differing critical values within one, in the key)."""
    v = col(version).cast("string").try_cast("decimal(18,4)")
    w = Window.partitionBy(*keys)
    df = df.withColumn("_v", v).withColumn("_c", F.to_json(F.struct(*critical)))
    at = Window.partitionBy(*keys, "_v")
    df = df.withColumn("_bad", F.max(F.col("_v").isNull().cast("int")).over(w)).withColumn("_lo", F.min("_c").over(at)).withColumn("_hi", F.max("_c").over(at))
    df = df.withColumn("_conflict", F.max((F.col("_lo") != F.col("_hi")).cast("int")).over(w)).withColumn("_top", F.max("_v").over(w))
    df = df.withColumn("_n", F.row_number().over(at.orderBy(*order_by, *[c for c in df.columns if not c.startswith("_")])))
    status = F.when((F.col("_bad") == 1) | (F.col("_conflict") == 1), "quarantined").when(F.col("_n") > 1, "duplicate").when(F.col("_v") < F.col("_top"), "superseded").otherwise("current")
    return df.withColumn("status", status).drop("_v", "_c", "_bad", "_lo", "_hi", "_conflict", "_top", "_n")


def most_complete(df: DataFrame, key: str, columns: list[str], order_by: list[str]) -> DataFrame:
    """Of each key (case ignored) the row with most columns filled, ties by order_by."""
    filled = reduce(lambda a, b: a + b, [F.when(is_missing(c), 0).otherwise(1) for c in columns])
    w = Window.partitionBy(F.lower(F.trim(col(key).cast("string")))).orderBy(F.desc("_filled"), *order_by)
    return df.withColumn("_filled", filled).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_filled", "_n")


def duplicate_count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: rows, distinct rows, rows beyond the first of each content, rows in repeated contents."""
    g = df.groupBy(*(keys or df.columns)).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("*").alias("distinct_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_rows"))
