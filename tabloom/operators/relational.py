"""Projection, sorting, filters, replacements, derived columns, routing, splitting and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import col, mask

from .order import number_rows


class OperatorError(ValueError):
    """An operator's inputs break its contract."""


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise OperatorError(f"unknown columns: {', '.join(missing)}")


def select_rename_sort(df: DataFrame, columns: list[str] | None = None, rename: dict[str, str] | None = None, sort_by: list[tuple[str, bool]] | None = None, nulls_last: bool = True, tie: list[str] = ()) -> DataFrame:
    """Keep columns in order, rename, sort by (column, ascending) pairs; tie columns make the order total."""
    out = df
    if columns:
        require_columns(df, *columns)
        out = out.select(*columns)
    if rename:
        out = out.withColumnsRenamed(rename)
        if len(set(out.columns)) < len(out.columns):
            raise OperatorError("renaming makes names repeat")
    if sort_by:
        require_columns(out, *[c for c, _ in sort_by])
        keys = [getattr(col(c), f"{'asc' if up else 'desc'}_nulls_{'last' if nulls_last else 'first'}")() for c, up in sort_by]
        out = out.orderBy(*keys, *tie)
    return out


def condition(rule: dict) -> Column:
    """{column, op, value}; null never matches, also for ne and not_in; text operators are literal and case-sensitive."""
    c, op, v = col(rule["column"]), rule["op"], rule.get("value")
    text = c.cast("string")
    tests = {
        "eq": lambda: c == v, "ne": lambda: c != v, "gt": lambda: c > v, "gte": lambda: c >= v, "lt": lambda: c < v, "lte": lambda: c <= v,
        "in": lambda: c.isin(*v), "not_in": lambda: ~c.isin(*v), "between": lambda: c.between(*v),
        "contains": lambda: text.contains(v), "starts_with": lambda: text.startswith(v), "ends_with": lambda: text.endswith(v),
        "is_null": lambda: c.isNull(), "not_null": lambda: c.isNotNull(),
    }
    if op not in tests:
        raise OperatorError(f"unknown operator: {op}")
    return F.coalesce(tests[op](), F.lit(False))


def filter_rows(df: DataFrame, rules: list[dict], how: str = "and") -> DataFrame:
    require_columns(df, *[r["column"] for r in rules])
    if not rules:
        return df
    return df.where(reduce((lambda a, b: a & b) if how == "and" else (lambda a, b: a | b), map(condition, rules)))


def replace_values(df: DataFrame, rules: list[dict]) -> DataFrame:
    """{column, old, new}: exact, one after the other; old null matches nulls."""
    for r in rules:
        require_columns(df, r["column"])
        c = col(r["column"])
        hit = c.isNull() if r["old"] is None else c == F.lit(r["old"])
        df = df.withColumn(r["column"], F.when(hit, F.lit(r["new"])).otherwise(c))
    return df


def find_replace(df: DataFrame, column: str, find: str, new: str, whole: bool = True, ignore_case: bool = False) -> DataFrame:
    """Text equal to find, or every occurrence of it, is replaced."""
    require_columns(df, column)
    c = col(column)
    if whole:
        hit = F.lower(c) == find.lower() if ignore_case else c == find
        return df.withColumn(column, F.when(hit, F.lit(new)).otherwise(c))
    quoted = "\\Q" + find.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return df.withColumn(column, F.regexp_replace(c, ("(?i)" if ignore_case else "") + quoted, new.replace("\\", "\\\\").replace("$", "\\$")))


def fill_missing(df: DataFrame, values: dict | None = None, default=None, columns: list[str] | None = None) -> DataFrame:
    """Nulls (not blanks) get their column's value, else the default in the target columns."""
    values = values or {}
    require_columns(df, *values, *(columns or []))
    for c in df.columns:
        v = values.get(c, default if columns is None or c in columns else None)
        if v is not None:
            df = df.withColumn(c, F.coalesce(col(c), F.lit(v).cast(df.schema[c].dataType)))
    return df


def derive_columns(df: DataFrame, formulas: list[dict], errors: str = "raise") -> dict[str, DataFrame]:
    """{name, op: add|subtract|multiply|divide, left, right, round?}; sides are columns or numbers; later ones may use earlier ones.

    primary: rows with the new columns, null where a side is missing or a divisor zero; review: the rows with such a null.
    With errors="raise" a row in review is an error.
    """
    bad = F.lit(False)
    for f in formulas:
        if f["name"] in df.columns:
            raise OperatorError(f"column exists: {f['name']}")
        a, b = (col(x).try_cast("double") if isinstance(x, str) else F.lit(float(x)) for x in (f["left"], f["right"]))
        value = {"add": a + b, "subtract": a - b, "multiply": a * b, "divide": F.try_divide(a, b)}[f["op"]]
        if f.get("round") is not None:
            value = F.round(value, f["round"])
        df = df.withColumn(f["name"], value)
        bad = bad | col(f["name"]).isNull()
    review = df.where(bad)
    if errors == "raise" and not review.isEmpty():
        raise OperatorError("a derived value is missing or divides by zero")
    return {"primary": df, "review": review}


def partition_rows(df: DataFrame, rules: list[dict], reason: str = "reason", joint: str = "; ") -> dict[str, DataFrame]:
    """Rows that match a rule {column, op, value, reason} are rejected with all matching reasons."""
    why = F.concat_ws(joint, *[F.when(condition(r), F.lit(r["reason"])) for r in rules])
    marked = df.withColumn(reason, why)
    return {"primary": marked.where(col(reason) == "").drop(reason), "rejected": marked.where(col(reason) != "")}


def mask_columns(df: DataFrame, rules: dict[str, str], salt: str = "", char: str = "*", keep_start: int = 1, keep_end: int = 1) -> DataFrame:
    require_columns(df, *rules)
    return df.withColumns({c: mask(c, m, salt, char, keep_start, keep_end) for c, m in rules.items()})


def apply_mapping(df: DataFrame, column: str, mapping: dict[str, str], output: str | None = None) -> DataFrame:
    """Approved exact value mapping; unmapped values stay."""
    require_columns(df, column)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(output or column, F.coalesce(F.create_map(*pairs)[col(column)], col(column)) if pairs else col(column))


def top_k(df: DataFrame, by: list[tuple[str, bool]], k: int, tie: list[str] = (), within: list[str] = ()) -> DataFrame:
    """The first k rows in order, of the table or of each group."""
    order = [col(c).asc_nulls_last() if up else col(c).desc_nulls_last() for c, up in by] + [col(t) for t in tie]
    if not within:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def split_rows(df: DataFrame, rows_per_table: int, order_by: list[str]) -> DataFrame:
    """Adds table_no: chunks of rows_per_table rows in order."""
    return number_rows(df, order_by, "_pos").withColumn("table_no", F.floor(F.col("_pos") / rows_per_table).cast("long")).drop("_pos")


def split_values(df: DataFrame, by: str, limit: int = 1000) -> dict[str, DataFrame]:
    """One frame for each value (guarded: at most `limit` values)."""
    values = [r[0] for r in df.select(by).distinct().orderBy(by).limit(limit + 1).collect()]
    if len(values) > limit:
        raise OperatorError(f"more than {limit} values to split by")
    return {("(blank)" if v is None else str(v)): df.where(col(by).eqNullSafe(F.lit(v))) for v in values} or {"(empty)": df}


# set operations


def union_tables(frames: dict[str, DataFrame], how: str = "outer", source: str | None = None) -> DataFrame:
    """By name: outer keeps all columns (nulls where absent), inner the common ones; source adds the table's name first."""
    if not frames:
        raise OperatorError("nothing to unite")
    parts = list(frames.items())
    common = [c for c in parts[0][1].columns if all(c in f.columns for _, f in parts)]
    made = []
    for name, f in parts:
        f = f if how == "outer" else f.select(*common)
        made.append(f.select(F.lit(name).alias(source), "*") if source else f)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def keys_except(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def keys_intersect(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_semi")


def period_spine(*columns: tuple[DataFrame, str]) -> DataFrame:
    """Distinct periods of several facts."""
    return reduce(lambda a, b: a.union(b), [f.select(col(c).alias("period")) for f, c in columns]).where("period is not null").distinct()
