"""Column profiles with meanings and samples, and a quality report with score, grade and issues."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import col, is_missing

from .order import Outputs
from .quantiles import quantiles

#: Fixed value: names of columns that identify things.
IDENTIFIER_NAME = r"(^|[_\s])(id|uuid|code)($|[_\s])|编号|编码|代码|单号|证件|身份证|手机号|电话|邮编"
#: What each share of trouble costs of 100 points, and the grades.
WEIGHTS = {"missing": 35, "duplicates": 20, "empty": 15, "constant": 5, "mixed": 10, "keys": 15, "names": 10}
GRADES = ((90, "excellent"), (75, "good"), (60, "fair"))
SEVERITY = {"high": 0, "medium": 1, "low": 2, "info": 3}
#: Relative error of the distinct counts that are sketched.
ERROR = 0.01


def _text(c: str, kind: str) -> Column:
    return F.to_json(F.struct(col(c).alias("v"))) if kind.split("<")[0] in ("array", "map", "struct") else col(c).cast("string")


def profile_columns(df: DataFrame, samples: int = 3, exact: bool = False) -> DataFrame:
    """A row for each column: position, column_name, data_type, semantic_type, total_rows, missing, missing_percent, distinct_values, is_exact, sample_values.

    One pass over the table makes counts, a sketch of distinct values and, by the smallest of seeded hashes, a few values as samples; all of them
    merge, none grows with the column. The sketch is within a few percent (ERROR is its standard error). Where that cannot tell a meaning (is a text unique, or a category of at most
    20 values or a tenth of its rows?), and for all columns with exact, values are counted one by one in a second pass over those
    columns alone. Meanings: empty, boolean, datetime, integer, number, identifier (by name, or unique texts of six characters as a rule), category, text.
    """
    seeds = 4 * samples
    kinds = df.dtypes
    aggs = [F.count("*").alias("rows")]
    for i, (c, kind) in enumerate(kinds):
        text = F.when(~is_missing(c) if kind == "string" else col(c).isNotNull(), _text(c, kind))
        aggs += [F.count(text).alias(f"n{i}"), F.approx_count_distinct(text, ERROR).alias(f"d{i}"), *[F.min(F.when(text.isNotNull(), F.struct(F.xxhash64(F.lit(s), text).alias("h"), text.alias("v")))).alias(f"s{i}_{s}") for s in range(seeds)]]
    r = df.agg(*aggs).first()  # one row
    sketched = {i: min(r[f"d{i}"], r[f"n{i}"]) for i in range(len(kinds))}
    limit = {i: max(20, int(r[f"n{i}"] * 0.1)) for i in sketched}

    def unclear(i: int) -> bool:
        near = lambda x: abs(sketched[i] - x) <= 6 * ERROR * max(x, 1) + 2
        return r[f"n{i}"] > 0 and (exact or kinds[i][1] == "string" and (near(limit[i]) or near(r[f"n{i}"])))

    again = [i for i in sketched if unclear(i)]
    counted = dict(sketched)
    lengths = {}
    if again:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.when(~is_missing(kinds[i][0]) if kinds[i][1] == "string" else col(kinds[i][0]).isNotNull(), _text(*kinds[i])).alias("v")) for i in again])).alias("p")).select("p.*").where("v is not null")
        counted |= {x.i: x.n for x in long.distinct().groupBy("i").agg(F.count("*").alias("n")).collect()}  # a row for each column
        whole = [i for i in again if kinds[i][1] == "string" and counted[i] == r[f"n{i}"]]
        if whole:
            sizes = df.select(*[F.when(~is_missing(kinds[i][0]), F.length(col(kinds[i][0]))).alias(f"l{i}") for i in whole])
            lengths = {int(x.column_name[1:]): x.q[0] for x in quantiles(sizes, sizes.columns, (0.5,)).collect()}

    def meaning(i: int) -> str:
        name, kind = kinds[i]
        if not r[f"n{i}"]:
            return "empty"
        for type_, label in (("boolean", "boolean"), ("date", "datetime"), ("timestamp", "datetime"), ("tinyint", "integer"), ("smallint", "integer"), ("int", "integer"), ("bigint", "integer"), ("float", "number"), ("double", "number"), ("decimal", "number")):
            if kind.startswith(type_):
                return label
        if re.search(IDENTIFIER_NAME, name, re.I) or lengths.get(i, 0) >= 6:
            return "identifier"
        return "category" if counted[i] <= limit[i] else "text"

    rows = []
    for i, (c, kind) in enumerate(kinds):
        found = sorted({(x.h, x.v) for x in (r[f"s{i}_{s}"] for s in range(seeds)) if x is not None})
        missing = r.rows - r[f"n{i}"]
        rows.append((i, c, kind, meaning(i), r.rows, missing, round(100 * missing / r.rows, 2) if r.rows else 0.0, counted[i], i in again or counted[i] == 0, [v for _, v in found][:samples]))
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string, semantic_type string, total_rows long, missing long, missing_percent double, distinct_values long, is_exact boolean, sample_values array<string>")


def quality_report(df: DataFrame, keys: list[str] | None = None) -> Outputs:
    """issues (code, severity, column_name, rows, ratio) and score (one row: score, grade, total_rows, the shares it is made of).

    Codes: EMPTY_DATASET, DUPLICATE_COLUMN_NAMES, MISSING_VALUES, EMPTY_COLUMN, CONSTANT_COLUMN, MIXED_TYPES (texts of which only some read as numbers),
    UNHASHABLE_VALUES (a column of maps, so that whole rows cannot be compared), DUPLICATE_ROWS, MISSING_KEYS, DUPLICATE_KEYS. A constant column is found by its smallest
    and largest value, so no distinct values are counted. Blank texts are missing.
    """
    names = [c.lower() for c in df.columns]
    twice = sorted({c for c in df.columns if names.count(c.lower()) > 1})
    if twice:
        if keys and {k.lower() for k in keys} & {c.lower() for c in twice}:
            raise ValueError("a key names several columns")
        df = df.toDF(*[c if names.count(c.lower()) == 1 else f"{c}#{i}" for i, c in enumerate(df.columns)])
    columns, kinds = df.columns, dict(df.dtypes)
    gone = {c: is_missing(c) if kinds[c] == "string" else col(c).isNull() for c in columns}
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        text = F.when(~gone[c], _text(c, kinds[c]))
        aggs += [F.count_if(gone[c]).alias(f"m{i}"), (F.min(text) == F.max(text)).alias(f"c{i}"), F.count_if(F.trim(text).rlike(r"^[+-]?\d+(\.\d+)?$")).alias(f"k{i}")]
    maps = [c for c in columns if "map<" in kinds[c] or kinds[c] == "variant"]
    blank = df.select(*[F.when(~gone[c], col(c)).alias(f"_{i}") for i, c in enumerate(columns)])

    def repeated(frame: DataFrame) -> DataFrame:
        return frame.groupBy(*frame.columns).agg(F.count("*").alias("x")).agg(F.coalesce(F.sum(F.when(F.col("x") > 1, F.col("x"))), F.lit(0)).alias("x"))

    wide = df.agg(*aggs)
    zero = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("x"))
    dup = zero if maps or not columns else repeated(blank)
    if keys:
        some = reduce(lambda a, b: a | b, [gone[k] for k in keys])
        lost = df.agg(F.count_if(some).alias("x"))
        same = repeated(df.where(~some).select(*[col(k).alias(f"_{i}") for i, k in enumerate(keys)]))
    else:
        lost = same = zero
    one = wide
    for name, frame in (("dup", dup), ("lost", lost), ("same", same)):
        one = one.crossJoin(F.broadcast(frame.select(F.col("x").alias(name))))  # one row each
    n = F.col("n")
    share = lambda x: F.try_divide(x.cast("double"), n)
    some = n > 0
    text = [c for c in columns if kinds[c] == "string"]

    def issues() -> DataFrame:
        row = lambda when, code, severity, column, rows, ratio=None: F.when(when, F.struct(F.lit(code).alias("code"), severity.alias("severity"), F.lit(column).cast("string").alias("column_name"), rows.cast("long").alias("rows"), (share(rows) if ratio is None else ratio).cast("double").alias("ratio")))
        flat = lambda s: F.lit(s)
        made = [row(~some if columns else F.lit(True), "EMPTY_DATASET", flat("high"), None, F.lit(0), F.lit(1.0))]
        if twice:
            made.append(row(some, "DUPLICATE_COLUMN_NAMES", flat("high"), None, F.lit(len(twice)), F.lit(len(twice) / len(columns))))
        if maps:
            made.append(row(some, "UNHASHABLE_VALUES", flat("info"), None, F.lit(0), F.lit(0.0)))
        for i, c in enumerate(columns):
            m = F.col(f"m{i}")
            made.append(row(some & (m > 0), "MISSING_VALUES", F.when(share(m) >= 0.5, "high").when(share(m) >= 0.1, "medium").otherwise("low"), c, m))
            made.append(row(some & (m == n), "EMPTY_COLUMN", flat("high"), c, n))
            made.append(row(some & F.coalesce(F.col(f"c{i}"), F.lit(False)), "CONSTANT_COLUMN", flat("info"), c, n - m))
            if c in text:
                made.append(row((F.col(f"k{i}") > 0) & (F.col(f"k{i}") < n - m), "MIXED_TYPES", flat("medium"), c, n - m))
        made += [row(F.col("dup") > 0, "DUPLICATE_ROWS", flat("medium"), None, F.col("dup")), row(F.col("lost") > 0, "MISSING_KEYS", flat("high"), None, F.col("lost")), row(F.col("same") > 0, "DUPLICATE_KEYS", flat("high"), None, F.col("same"))]
        return one.select(F.explode(F.array_compact(F.array(*made))).alias("i")).select("i.*")

    def score() -> DataFrame:
        total = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0))
        cells = F.try_divide(total([F.col(f"m{i}") for i in range(len(columns))]).cast("double"), n * max(1, len(columns)))
        of = lambda test: total([F.when(test(i, c), 1).otherwise(0) for i, c in enumerate(columns)]).cast("double") / max(1, len(columns))
        shares = {
            "missing": cells, "duplicates": share(F.col("dup")), "empty": of(lambda i, c: F.col(f"m{i}") == n), "constant": of(lambda i, c: F.coalesce(F.col(f"c{i}"), F.lit(False))),
            "mixed": of(lambda i, c: (F.col(f"k{i}") > 0) & (F.col(f"k{i}") < n - F.col(f"m{i}")) if c in text else F.lit(False)), "keys": share(F.col("lost") + F.col("same")), "names": F.lit(1.0 if twice else 0.0),
        }
        cost = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) * WEIGHTS[k] for k, v in shares.items()])
        points = F.when(some if columns else F.lit(False), F.round(F.greatest(F.lit(0.0), F.lit(100.0) - cost), 1)).otherwise(0.0)
        out = one.select(points.alias("score"), n.alias("total_rows"), *[F.round(F.coalesce(v, F.lit(0.0)), 4).alias(f"{k}_share") for k, v in shares.items() if k != "names"])
        grade = F.lit("poor")
        for least, name in reversed(GRADES):
            grade = F.when(F.col("score") >= least, name).otherwise(grade)
        return out.withColumn("grade", grade)

    return Outputs({"primary": issues, "issues": issues, "score": score})
