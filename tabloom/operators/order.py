"""Positions, running totals and ranks over a whole table without one task for all rows.

Rows are dealt to ranges, each range is counted or summed by itself, and the ranges' totals, a row for each, shift the rest.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import col


_DRY: ContextVar[bool] = ContextVar("dry", default=False)


@contextmanager
def nothing_written():
    """Within, tables are not written: for shapes of results over empty tables."""
    token = _DRY.set(True)
    try:
        yield
    finally:
        _DRY.reset(token)


def dry() -> bool:
    """Whether nothing is to be written or counted."""
    return _DRY.get()


def _fresh(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/written-{uuid.uuid4().hex}"


def written_once(df: DataFrame) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir, so that what is sampled or numbered in it is the same at each reading."""
    if _DRY.get():
        return df
    spark = df.sparkSession
    path = _fresh(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task of a shuffle gets at most on average within spread(), and bytes that small ones are merged to.
ROWS, MERGED = 1_000_000, "4m"


@contextmanager
def spread(spark: SparkSession, rows: int):
    """Within, shuffles have a task for each ROWS rows if the session asks for fewer, so that a task holds no more as tables grow.

    It holds for what is written within, and for dealt() and ranges() within, whenever their rows are read.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    wanted = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.advisoryPartitionSizeInBytes": MERGED}
    old = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dealt(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Wide rows dealt by key once for all that follows by it, to more and smaller tasks than other shuffles."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Like written_once, as a table in buckets of the keys, as many as dealt() makes: a join by just these keys with what is dealt by them needs no shuffle of it."""
    if _DRY.get():
        return rows
    spark, n = rows.sparkSession, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = f"tabloom_written_{uuid.uuid4().hex}"
    dealt(rows, *keys).write.format("parquet").option("compression", "zstd").bucketBy(n, *keys).option("path", _fresh(spark)).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its files stay, and found reads them by their buckets
    return found


class Outputs(Mapping):
    """Named results, each built when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self.makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def ranges(df: DataFrame, order_by: list) -> DataFrame:
    """Rows dealt to sorted ranges, written once: _p numbers the ranges, _id the rows of one from _p * 2 ** 33 on."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by).withColumn("_id", F.monotonically_increasing_id())
    return written_once(dealt).withColumn("_p", F.shiftright("_id", 33))


def number_rows(df: DataFrame, order_by: list[str], name: str = "row_pos") -> DataFrame:
    """Zero-based positions in a total order."""
    dealt = ranges(df, order_by)
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each range
    starts = counts.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return dealt.join(F.broadcast(starts), "_p").withColumn(name, F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_s")).drop("_id", "_p", "_s")


def running_total(df: DataFrame, order_by: list[str], value: str | Column, name: str = "running") -> DataFrame:
    """The sum of value over a row and all rows before it, in a total order."""
    dealt = ranges(df.withColumn("_v", col(value)), order_by)
    sums = dealt.groupBy("_p").agg(F.sum("_v").alias("_t"))  # a row for each range
    starts = sums.select("_p", F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_s"))
    own = F.sum("_v").over(Window.partitionBy("_p").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_p").withColumn(name, F.coalesce(F.col("_s") + F.col("_own"), F.col("_own"), F.col("_s"))).drop("_id", "_p", "_s", "_own", "_v")


def running_totals(df: DataFrame, by: list[str], order_by: list, sums: dict[str, Column]) -> DataFrame:
    """Adds, under each name, the sum of a column over a row and the rows before it among those that agree in by; order_by is total within them.

    Rows are dealt to ranges of (by, order_by), so a group of any size is spread over as many ranges as it fills. A group that goes on in
    a range takes what earlier ranges hold of it from a table with a row for each range at most.
    """
    dealt = ranges(df.withColumns({f"_in_{n}": v for n, v in sums.items()}), [*by, *order_by])
    parts = dealt.groupBy("_p", *by).agg(*[F.sum(f"_in_{n}").alias(f"_of_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # the ranges of one group
    parts = parts.withColumn("_more", F.count("*").over(before) > 0)
    parts = parts.withColumns({f"_to_{n}": F.sum(f"_of_{n}").over(before) for n in sums}).where("_more")
    parts = parts.select(F.col("_p").alias("_q"), *[col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[f"_to_{n}" for n in sums])
    own = Window.partitionBy("_p", *by).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumns({n: F.sum(f"_in_{n}").over(own) for n in sums})
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        same = same & col(c).eqNullSafe(F.col(f"_by{i}"))
    out = dealt.join(F.broadcast(parts), same, "left")
    add = lambda n: F.coalesce(F.col(n) + F.col(f"_to_{n}"), F.col(n), F.col(f"_to_{n}"))
    return out.withColumns({n: add(n) for n in sums}).select(*df.columns, *sums)


def ranks(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """(by, column, _n, _below, _total): each known value with its rows, the rows below it and all rows of its group with a value.

    A row for each distinct value: smallest rank from the top is total - below - n + 1, average rank below + (n + 1) / 2.
    """
    counts = df.where(col(column).isNotNull()).groupBy(*by, col(column)).agg(F.count("*").alias("_n"))
    run = running_totals(counts, list(by), [col(column)], {"_upto": F.col("_n")})
    groups = run.groupBy(*by).agg(F.sum("_n").alias("_total"))
    run = run.join(groups, by) if by else run.crossJoin(F.broadcast(groups))  # one row
    return run.withColumn("_below", F.col("_upto") - F.col("_n")).drop("_upto")


def add_ranks(df: DataFrame, column: str, smallest: str | None = None, percent: str | None = None) -> DataFrame:
    """Adds the rank from the top (ties share the smallest, nulls have none) and the average rank over the rows with a value, in (0, 1]."""
    r = ranks(df, column).select(
        col(column).alias("_value"),
        *([(F.col("_total") - F.col("_below") - F.col("_n") + 1).alias(smallest)] if smallest else []),
        *([((F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_total")).alias(percent)] if percent else []),
    )
    return df.join(r, col(column) == F.col("_value"), "left").drop("_value")
