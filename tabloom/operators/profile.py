"""Profiles, quality scores, fingerprints: one wide aggregate over all columns, rules on its one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import col, is_missing

from .dedup import duplicate_count
from .order import number_rows
from .quality import quality_report


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """A row for each column: name, type, rows, missing, distinct, minimum and maximum as text."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        text = col(c).cast("string")
        aggs += [F.count_if(is_missing(c)).alias(f"m{i}"), distinct(F.when(~is_missing(c), text)).alias(f"d{i}"), F.min(col(c)).cast("string").alias(f"lo{i}"), F.max(col(c)).cast("string").alias(f"hi{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col("rows").alias("total_rows"), F.col(f"m{i}").alias("missing"), F.col(f"d{i}").alias("distinct_values"), F.col(f"lo{i}").alias("minimum"), F.col(f"hi{i}").alias("maximum")) for i, (c, t) in enumerate(df.dtypes)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def quality(df: DataFrame, keys: list[str] | None = None) -> dict:
    """The quality report as plain data: score, grade and issues (code, column, rows), a row for each finding."""
    made = quality_report(df, keys)
    s = made["score"].first()
    return {"rows": s.total_rows, "columns": len(df.columns), "score": s.score, "grade": s.grade, "issues": [(r.code, r.column_name, r.rows) for r in made["issues"].collect()]}


def quality_metrics(df: DataFrame) -> DataFrame:
    """One row: rows, cells, missing cells and their share, duplicate rows."""
    missing = sum((F.count_if(is_missing(c)) for c in df.columns), F.lit(0))
    base = df.agg(F.count("*").alias("total_rows"), missing.cast("long").alias("missing_cells"))
    dup = duplicate_count(df).select("extra_rows", "repeated_rows")
    return base.crossJoin(F.broadcast(dup)).withColumn("missing_share", F.round(F.coalesce(F.try_divide(F.col("missing_cells"), F.col("total_rows") * len(df.columns)), F.lit(0.0)), 6))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes with content or schema, not with the order of rows: a sum and an exclusive or of row hashes."""
    h = F.xxhash64(*[F.coalesce(col(c).cast("string"), F.lit("\x00")) for c in df.columns])
    schema = F.sha2(F.lit(";".join(f"{c}:{t}" for c, t in df.dtypes)).cast("binary"), 256)
    return df.agg(F.count("*").alias("total_rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor")).withColumn("schema_hash", schema)


def metadata(df: DataFrame, limit: int = 30) -> DataFrame:
    """One row: rows, missing cells and exact totals of the first numeric columns."""
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint") or t.startswith("decimal")][:limit]
    missing = sum((F.count_if(is_missing(c)) for c in df.columns), F.lit(0))
    return df.agg(F.count("*").alias("total_rows"), missing.cast("long").alias("missing_cells"), *[F.sum(col(c).cast("decimal(38,4)")).alias(f"total_{c}") for c in numeric])


def _typed(c: str, kind: str) -> Column:
    """A cell with its type and length, so that neither a null and an empty text nor 1 and "1" are alike, and cells cannot run together."""
    text = F.hex(col(c)) if kind == "binary" else F.to_json(F.struct(col(c).alias("v"))) if kind.split("<")[0] in ("array", "map", "struct") else col(c).cast("string")
    return F.coalesce(F.concat(F.lit(f"{kind}:"), F.length(text).cast("string"), F.lit(":"), text), F.lit(f"{kind}:null"))


def ordered_fingerprint(df: DataFrame, order_by: list[str], columns: list[str] | None = None, block: int = 1024) -> DataFrame:
    """One row (total_rows, total_columns, schema_hash, digest) that changes with schema, content, types and the order of rows; of some columns only, if given.

    Rows get their positions, and each its digest of typed cells. Every `block` digests in order become one, and these, in order, the last: what
    meets in one place is 64 letters for each block of rows. The digest of no rows is that of an empty text.
    """
    kinds = dict(df.dtypes)
    kinds = {c: kinds[c] for c in columns or df.columns}
    cells = F.concat(*[_typed(c, t) for c, t in kinds.items()])
    rows = number_rows(df.withColumn("_h", F.sha2(cells.cast("binary"), 256)), order_by, "_at").select(F.col("_at").alias("at"), F.col("_h").alias("h"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "").cast("binary"), 256).alias("h")
    blocks = rows.groupBy(F.floor(F.col("at") / block).alias("up")).agg(F.count("*").alias("n"), joined).withColumnRenamed("up", "at")
    last = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), joined)
    schema = F.sha2(F.lit(";".join(f"{c}:{t}" for c, t in kinds.items())).cast("binary"), 256)
    return last.select(F.col("n").alias("total_rows"), F.lit(len(kinds)).alias("total_columns"), schema.alias("schema_hash"), F.col("h").alias("digest"))
