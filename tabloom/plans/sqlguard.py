"""Read-only SQL over named tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tabloom.operators.relational import OperatorError

MAX_CHARS = 100_000
FORBIDDEN = re.compile(r"\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|call|set|reset|use|load|copy|attach|install|pragma|cache|uncache|refresh|add|export|import|msck|analyze)\b", re.I)


def _bare(sql: str) -> str:
    """The text without comments, quoted strings and quoted names."""
    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", " ", sql, flags=re.S)


def check_read_only(sql: str) -> str:
    """The statement, if it is a single SELECT or WITH."""
    if len(sql) > MAX_CHARS:
        raise OperatorError("the statement is too long")
    bare = _bare(sql).strip()
    body = bare.rstrip("; \n\t")
    if ";" in body:
        raise OperatorError("one statement at a time")
    if not re.match(r"(select|with|\()\b|\(", body, re.I):
        raise OperatorError("only SELECT or WITH")
    if m := FORBIDDEN.search(body):
        raise OperatorError(f"not allowed: {m[1]}")
    return sql.strip().rstrip("; \n\t")


_WRITES = re.compile(r"(?m)^\W*(\w*(?:Command|InsertInto|CreateTable|CreateView|ReplaceTable|DropTable|DropView|DeleteFrom|UpdateTable|MergeInto|Truncate|AlterTable|LoadData|CacheTable)\w*)")


def check_parsed(spark: SparkSession, sql: str, other_dialect: bool = False) -> str:
    """The statement, if no node of what Spark's parser makes of it writes or sets anything; nothing is looked up or run.

    A text that the parser cannot read is an error, but for other_dialect: then the words alone decide.
    """
    text = check_read_only(sql)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        if other_dialect:
            return text
        raise OperatorError(f"not a query: {str(e).strip()[:200]}") from e
    if m := _WRITES.search(plan.toString()):
        raise OperatorError(f"not a query: {m[1]}")
    return text


def query_tables(spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: int | None = None) -> DataFrame:
    """Runs read-only SQL over tables by name (input_1, input_2, ... for unnamed ones); max_rows is checked, never cut."""
    if not 1 <= len(tables) <= 50:
        raise OperatorError("between 1 and 50 tables")
    text = check_parsed(spark, sql)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(text)
    if max_rows is not None and out.limit(max_rows + 1).count() > max_rows:
        raise OperatorError(f"more than {max_rows} rows")
    return out


def query_files(spark: SparkSession, paths: list[str], sql: str, max_rows: int | None = None) -> DataFrame:
    """The same over CSV and Parquet files, as input_1, input_2, ..."""
    from tabloom.sources.files import read_table

    return query_tables(spark, sql, {f"input_{i + 1}": read_table(spark, p) for i, p in enumerate(paths)}, max_rows)
