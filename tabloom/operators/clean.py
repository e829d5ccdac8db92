"""Cleaning and type inference of text tables."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import blank_to_null, col

from .dedup import drop_duplicates

#: Words read as booleans.
TRUE_WORDS = ("true", "yes", "y", "是", "真", "对")
FALSE_WORDS = ("false", "no", "n", "否", "假", "错")
#: Names of columns that are identifiers and keep their text.
IDENTIFIER = re.compile(r"(^|[_\s])(id|uuid|code)($|[_\s])|编号|编码|代码|单号|证件|身份证|手机号|电话|邮编", re.I)
DATE_NAME = re.compile(r"date|time|day|日期|时间", re.I)


def infer_types(df: DataFrame, threshold: float = 1.0) -> dict[str, str]:
    """Types that text columns may take: boolean, bigint, double, timestamp or string. One aggregate over all columns.

    Values with leading zeros or more than 15 digits keep a column text; so does an identifier's name.
    """
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return {}
    aggs = []
    for i, c in enumerate(texts):
        v = blank_to_null(c)
        aggs += [
            F.count(v).alias(f"n{i}"), F.count_if(F.lower(v).isin(*TRUE_WORDS, *FALSE_WORDS)).alias(f"b{i}"),
            F.count_if(v.rlike(r"^[+-]?(0|[1-9]\d{0,14})$")).alias(f"i{i}"), F.count_if(v.rlike(r"^[+-]?(0|[1-9]\d{0,14})?(\.\d+)?([eE][+-]?\d{1,2})?$") & v.rlike(r"\d")).alias(f"d{i}"),
            F.count_if(F.try_to_timestamp(v).isNotNull()).alias(f"t{i}"), F.count_if(v.rlike(r"^[+-]?\d{16,}(\.0*)?$") | v.rlike(r"^[+-]?0\d+$")).alias(f"x{i}"),
        ]
    r = df.agg(*aggs).first().asDict()
    out = {}
    for i, c in enumerate(texts):
        n = r[f"n{i}"]
        enough = lambda k: n > 0 and r[f"{k}{i}"] / n >= threshold  # noqa: B023, E731
        if IDENTIFIER.search(c) or r[f"x{i}"] or not n:
            out[c] = "string"
        else:
            out[c] = "boolean" if enough("b") else "bigint" if enough("i") else "double" if enough("d") else "timestamp" if enough("t") and DATE_NAME.search(c) else "string"
    return out


def cast_to(df: DataFrame, types: dict[str, str]) -> DataFrame:
    made = {}
    for c, t in types.items():
        v = blank_to_null(c)
        if t == "boolean":
            made[c] = F.when(F.lower(v).isin(*TRUE_WORDS), True).when(F.lower(v).isin(*FALSE_WORDS), False)
        elif t == "timestamp":
            made[c] = F.try_to_timestamp(v)
        elif t != "string":
            made[c] = v.try_cast(t)
    return df.withColumns(made) if made else df


def smart_clean(df: DataFrame, trim: bool = True, blanks_to_null: bool = True, drop_empty_rows: bool = True, drop_empty_columns: bool = True, infer: bool = True, missing: str = "keep", fill=None, subset: list[str] | None = None, dedupe: str | None = None, keys: list[str] | None = None, order_by: list[str] = ()) -> DataFrame:
    """In this order: trim, blanks to null, empty rows and columns go, types, missing (keep, drop_any, drop_all, fill), duplicates."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if trim and texts:
        df = df.withColumns({c: F.trim(col(c)) for c in texts})
    if blanks_to_null and texts:
        df = df.withColumns({c: F.when(F.trim(col(c)) != "", col(c)) for c in texts})
    if drop_empty_rows:
        df = df.dropna("all")
    if drop_empty_columns:
        n = df.agg(*[F.count(col(c)).alias(c) for c in df.columns]).first().asDict()
        df = df.select(*[c for c in df.columns if n[c] or not any(n.values())])
    if infer:
        df = cast_to(df, infer_types(df))
    if missing in ("drop_any", "drop_all"):
        df = df.dropna("any" if missing == "drop_any" else "all", subset=subset)
    elif missing == "fill":
        values = fill if isinstance(fill, dict) else {c: fill for c in df.columns}
        df = df.withColumns({c: F.coalesce(col(c), F.lit(v).try_cast(df.schema[c].dataType)) for c, v in values.items() if c in df.columns and v is not None})
    return drop_duplicates(df, keys, dedupe, order_by) if dedupe else df


def normalize_fields(df: DataFrame, columns: list[str], form: str = "NFKC", case: str | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """Unicode form, strip, case, exact mapping. Plain ASCII never leaves the JVM."""
    @F.pandas_udf("string")
    def unicode_form(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    for c in columns:
        if dict(df.dtypes)[c] != "string":
            raise ValueError(f"{c} is not text")
        # rows that are ASCII pass null to Python and keep their own text
        v = F.when(col(c).rlike(r"^[\x00-\x7F]*$"), col(c)).otherwise(unicode_form(F.when(~col(c).rlike(r"^[\x00-\x7F]*$"), col(c)))) if form != "none" else col(c)
        v = F.trim(v)
        v = F.upper(v) if case == "upper" else F.lower(v) if case == "lower" else v
        if mapping:
            v = F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[v], v)
        df = df.withColumn(c, v)
    return df


def long_text_details(df: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, column, value) of texts longer than limit."""
    texts = [c for c, t in df.dtypes if t == "string" and c != key]
    return df.unpivot([key], texts, "column_name", "value").where(F.length("value") > limit)


def blank_details(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, column) of missing cells."""
    columns = columns or [c for c in df.columns if c != key]
    cells = F.array(*[F.when(reduce(lambda a, b: a | b, [col(c).isNull(), F.trim(col(c).cast("string")) == ""]), F.lit(c)) for c in columns])
    return df.select(col(key), F.explode(F.array_compact(cells)).alias("column_name"))
