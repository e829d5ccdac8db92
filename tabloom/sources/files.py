"""CSV, TSV, Parquet and JDBC tables; CSV with its operation log; checks of what was written."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.expressions import col, escape_formula
from tabloom.operators.profile import fingerprint
from tabloom.operators.relational import OperatorError


#: Encodings that are tried where none is named.
ENCODINGS = ("UTF-8", "GB18030")


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, sep: str = ",", header: bool = True, multi_line: bool = True) -> DataFrame:
    """All text: leading zeros and words like NA stay as written, an empty cell is an empty text. A UTF-8 mark is dropped.

    Without an encoding, files that do not read as UTF-8 are read as GB18030; finding out reads them once. multi_line allows line
    breaks in quoted cells, at the price of one task for each file; large files without such cells should go without.
    """
    if encoding is None:
        encoding = ENCODINGS[0] if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty() else ENCODINGS[1]
    bytewise = encoding.upper() in ("GB18030", "GBK", "GB2312")  # Spark's reader knows none of them; their separators are ASCII bytes
    reader = spark.read.option("header", header).option("inferSchema", False).option("encoding", "ISO-8859-1" if bytewise else encoding).option("sep", sep).option("escape", '"')
    df = reader.option("multiLine", multi_line).csv(path)
    if bytewise:

        @F.pandas_udf("string")
        def decoded(s: pd.Series) -> pd.Series:
            return s.map(lambda x: x.encode("latin-1").decode("gb18030"), na_action="ignore")

        df = df.select(*[decoded(col(c)).alias(c.encode("latin-1").decode("gb18030")) for c in df.columns])
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})
    return df.withColumns({c: F.coalesce(col(c), F.lit("")) for c in df.columns})


def read_tables(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """The tables of a file: every sheet of a workbook, else one, under the file's name."""
    if path.lower().endswith((".xlsx", ".xlsm")):
        from .xlsx import read_workbook

        return read_workbook(spark, path)
    return {path.rstrip("/").rsplit("/", 1)[-1]: read_table(spark, path, **options)}


def read_table(spark: SparkSession, path: str, sheet: str | None = None, **options) -> DataFrame:
    """By the name's ending; a folder without one is Parquet. Of a workbook with several sheets one has to be named."""
    low = path.lower().rstrip("/")
    if low.endswith((".csv", ".csv.gz", ".txt")):
        return read_csv(spark, path, **options)
    if low.endswith((".tsv", ".tab")):
        return read_csv(spark, path, sep="\t", **options)
    if low.endswith((".xlsx", ".xlsm")):
        from .xlsx import read_workbook

        found = read_workbook(spark, path)
        if sheet is None and len(found) != 1 or sheet is not None and sheet not in found:
            raise OperatorError(f"name one of the sheets: {', '.join(found)}")
        return found[sheet] if sheet else next(iter(found.values()))
    if low.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if low.endswith(".orc"):
        return spark.read.orc(path)
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, sql: str, driver: str | None = None, **options) -> DataFrame:
    """A read-only query on a database whose driver is on the class path."""
    from tabloom.plans.sqlguard import check_parsed

    reader = spark.read.format("jdbc").option("url", url).option("query", check_parsed(spark, sql, other_dialect=True))
    if driver:
        reader = reader.option("driver", driver)
    return reader.options(**options).load()


def read_since(df: DataFrame, column: str, bookmark: str | None) -> DataFrame:
    """Rows beyond a saved bookmark (all, without one)."""
    return df if bookmark is None else df.where(col(column) > F.lit(bookmark).cast(df.schema[column].dataType))


def promote_header(df: DataFrame, groups: list[set[str]], order_by: str, within: int = 12, least: int = 4) -> DataFrame:
    """The first of the top rows whose cells name at least `least` groups becomes the header; rows up to it go, and blank columns."""
    rows = df.orderBy(order_by).limit(within).collect()
    names = [c for c in df.columns if c != order_by]
    for r in rows:
        cells = [str(r[c] or "").strip().lower() for c in names]
        if sum(any(x in g for x in cells) for g in groups) >= least:
            keep = [(c, str(r[c]).strip()) for c in names if str(r[c] or "").strip()]
            return df.where(col(order_by) > r[order_by]).select(col(order_by), *[col(a).alias(b) for a, b in keep]).where(" or ".join(f"trim(coalesce(`{b}`, '')) <> ''" for _, b in keep))
    return df


def escape_texts(df: DataFrame) -> DataFrame:
    """Formula-like texts and headers are defused; numbers are untouched."""
    made = df.withColumns({c: escape_formula(c) for c, t in df.dtypes if t == "string"})
    return made.withColumnsRenamed({c: "'" + c for c in df.columns if c.lstrip()[:1] in "=+-@" and c.strip()})


def write_csv(df: DataFrame, path: str, escape: bool = True, log: list[dict] | None = None) -> None:
    """A folder of CSV parts with headers and, beside it, the operation log."""
    (escape_texts(df) if escape else df).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    if log:
        df.sparkSession.createDataFrame([{k: str(v) for k, v in x.items()} for x in log]).coalesce(1).write.option("header", True).csv(path.rstrip("/") + "-log")


def write_csv_zip(path: str, tables: dict[str, DataFrame], log: list[dict] | None = None, max_rows: int = 300_000) -> None:
    """Bounded results as CSV files of one new archive, with the operation log; more rows than max_rows are refused, not cut."""
    import csv
    import io
    import zipfile

    texts = {}
    for name, df in tables.items():
        made = escape_texts(df)
        rows = made.limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise OperatorError(f"{name} has more than {max_rows} rows")
        out = io.StringIO()
        csv.writer(out).writerows([made.columns, *rows])
        texts[f"{name}.csv"] = out.getvalue()
    if log:
        names = sorted({k for x in log for k in x})
        out = io.StringIO()
        csv.writer(out).writerows([names, *[[x.get(k, "") for k in names] for x in log]])
        texts["operations.csv"] = out.getvalue()
    with zipfile.ZipFile(path, "x", zipfile.ZIP_DEFLATED) as z:
        for name, text in texts.items():
            z.writestr(name, "\ufeff" + text)


def schema_only(df: DataFrame) -> DataFrame:
    """The columns without the rows."""
    return df.limit(0)


def browse(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table_name, column_name, data_type) of the tables and views that the session's catalog knows."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(f"{database}.{t.name}" if database and not t.isTemporary else t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def verify_delivery(written: DataFrame, expected: DataFrame) -> dict:
    """Rows, columns, nulls and content of what was read back against what was meant."""
    a, b = fingerprint(written).first(), fingerprint(expected).first()
    out = {"columns": written.columns == expected.columns, "rows": a.total_rows == b.total_rows, "content": (a.hash_sum, a.hash_xor) == (b.hash_sum, b.hash_xor)}
    nulls = lambda df: df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    out["nulls"] = tuple(nulls(written)) == tuple(nulls(expected)) if out["columns"] else False
    return out | {"ok": all(out.values())}


def export_verified(df: DataFrame, path: str) -> dict:
    """Writes Parquet, reads it again and refuses a difference."""
    df.write.parquet(path)
    report = verify_delivery(df.sparkSession.read.parquet(path), df)
    if not report["ok"]:
        raise OperatorError(f"what was written differs: {report}")
    return report
