"""Attributes from approved masters, names that map to one master only, suggestions for names that are not there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import col

from .matching import _met, _two_best
from .order import number_rows
from .relational import OperatorError, require_columns


def attribute_join(fact: DataFrame, dimension: DataFrame, left_key: str, right_key: str, fields: list[str]) -> DataFrame:
    """Attributes (texts, dates, flags) of a dimension on every fact row.

    Keys are compared trimmed. The dimension's must be unique; no key may be missing; each fact row must find its own; numbers are
    refused as attributes, as sums over copies of them mean nothing.
    """
    require_columns(fact, left_key)
    require_columns(dimension, right_key, *fields)
    kinds = dict(dimension.dtypes)
    if bad := [f for f in fields if f in fact.columns or f == right_key or kinds[f] in ("int", "bigint", "smallint", "tinyint", "float", "double") or kinds[f].startswith("decimal")]:
        raise OperatorError(f"no attributes: {', '.join(bad)}")
    d = dimension.select(F.trim(col(right_key).cast("string")).alias("_k"), *map(col, fields))
    f = fact.withColumn("_k", F.trim(col(left_key).cast("string")))
    missing = lambda x: F.count_if(F.coalesce(x, F.lit("")) == "")
    if d.agg(missing(F.col("_k")).alias("n")).first().n or f.agg(missing(F.col("_k")).alias("n")).first().n:
        raise OperatorError("a key is missing")
    if not d.groupBy("_k").count().where("count > 1").isEmpty():
        raise OperatorError("the dimension's keys repeat")
    if not f.join(d, "_k", "left_anti").isEmpty():
        raise OperatorError("some facts have no dimension row")
    return f.join(d, "_k", "left").drop("_k")


def unique_map(values: DataFrame, column: str, key) -> DataFrame:
    """(key, value, choices): each normalised key with its one value, null where several values share the key."""
    v = values.select(F.trim(col(column).cast("string")).alias("value")).where("value <> ''").distinct()
    g = v.groupBy(key(F.col("value")).alias("key")).agg(F.count("*").alias("choices"), F.min("value").alias("_one"))
    return g.select("key", F.when(F.col("choices") == 1, F.col("_one")).alias("value"), "choices")


def map_names(df: DataFrame, column: str, values: DataFrame, value_column: str, key, output: str) -> DataFrame:
    """Adds the value that a name means: one that is written so, else the only one with its normalised key, else null."""
    exact = values.select(F.trim(col(value_column).cast("string")).alias("_exact")).where("_exact <> ''").distinct()
    near = unique_map(values, value_column, key).select(F.col("key").alias("_key"), F.col("value").alias("_near"))
    out = df.withColumn("_name", F.trim(col(column).cast("string")))
    out = out.join(exact, F.col("_name") == F.col("_exact"), "left").join(near, key(F.col("_name")) == F.col("_key"), "left")
    return out.withColumn(output, F.coalesce("_exact", "_near")).drop("_name", "_exact", "_key", "_near")


def alias_suggestions(left: DataFrame, right: DataFrame, left_column: str, right_column: str, least: float = 0.6) -> DataFrame:
    """(value, suggestion, score): the likest right value of each left value that is not there itself, from `least` on.

    Lower-case texts without blanks are compared in blocks, all with all; where one holds the other the score is at least the ratio of
    their lengths; ties go to the later text.
    """
    tidy = lambda c: F.lower(F.regexp_replace(c, r"[\s_\-/]+", ""))
    side = lambda df, c: df.select(F.trim(col(c).cast("string")).alias("value")).where("value <> ''").distinct()
    r = side(right, right_column)
    missing = side(left, left_column).join(r, "value", "left_anti").withColumn("_n", tidy(F.col("value")))
    names = r.withColumn("_n", tidy(F.col("value"))).where("_n <> ''").groupBy("_n").agg(F.max("value").alias("suggestion")).withColumn("_down", F.col("suggestion"))
    k = number_rows(names, ["_down"], "_up").withColumn("_pos", -F.col("_up")).select("_pos", "_n", "suggestion")
    found = _two_best(_met(missing.where("_n <> ''").select("_n").distinct(), k), holds=True)
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "pos"))).where(f"_r = 1 and score >= {least}")
    named = best.join(k.select(F.col("_pos").alias("pos"), "suggestion"), "pos").select(F.col("text").alias("_n"), "suggestion", "score")
    return missing.join(named, "_n").select("value", "suggestion", F.round("score", 6).alias("score"))
