"""Distinct texts of a table: one row for each, numbered in the order of their first documents.

A text is known by two 64-bit hashes, a row by them and its key. Copies are counted in the tasks that read them, so that a
text which stands in a third of all rows is a row for each task when it meets itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Order of rows without a key: last.
LAST = 2**63 - 1
#: Parts that the copies of one text are dealt to.
SALTS = 32
#: What knows a row.
ROW = ["_t", "_u", "_d"]


def with_identity(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Adds _t and _u (the text) and _d (the key's place in the order)."""
    return docs.withColumns({"_t": F.xxhash64(F.lit(1), text), "_u": F.xxhash64(F.lit(2), text), "_d": F.coalesce(F.col(key).cast("long"), F.lit(LAST))})


def salt() -> F.Column:
    return F.pmod(F.xxhash64("_d"), F.lit(SALTS)).cast("int")


def ranked(rows: DataFrame, *by: str, name: str = "_rank") -> DataFrame:
    """Order-preserving numbers: a range sort, then row numbers that grow with the partition. They hold once they are written."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())


def running(rows: DataFrame, order_by: list, **sums) -> DataFrame:
    """Adds, under each name, the sum of a column over the rows before a row in a total order; ranges are summed by themselves first."""
    dealt = rows.withColumns({f"_in_{k}": v for k, v in sums.items()})
    dealt = materialize(ranked(dealt, *order_by, name="_at"), "ranges").withColumn("_range", F.shiftright("_at", 33))
    parts = dealt.groupBy("_range").agg(*[F.sum(f"_in_{k}").alias(f"_of_{k}") for k in sums])  # a row for each range
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_range", *[before(f"_of_{k}", Window.orderBy("_range")).alias(f"_to_{k}") for k in sums])
    own = dealt.withColumns({k: before(f"_in_{k}", Window.partitionBy("_range").orderBy("_at")) for k in sums})
    own = own.join(F.broadcast(parts), "_range").withColumns({k: F.col(k) + F.col(f"_to_{k}") for k in sums})
    return own.drop("_range", "_at", *[f"_{x}_{k}" for k in sums for x in ("in", "to")])


def distinct_texts(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """(_t, _u, _d, node, salts) of the first row of each text (nodes grow with _d, _t, _u); and whether any row repeats both key and text."""
    own = with_identity(docs, key, text).select(*ROW, F.col(text).isNull().alias("_null")).groupBy(*ROW, "_null").agg(F.count("*").alias("n"))
    firsts = own.groupBy("_t", "_u", "_null").agg(F.min("_d").alias("_d"), F.max("n").alias("most"), F.collect_set(salt()).alias("salts"))
    heads = materialize(ranked(firsts, "_d", "_t", "_u", name="node"), "texts")
    repeats = (heads.agg(F.max("most")).first()[0] or 0) > 1
    return heads.where("not _null").select(*ROW, "node", "salts"), repeats


def mark_repeats(docs: DataFrame, key: str, text: str, repeats: bool) -> DataFrame:
    """Adds the row's identity and _again: false for just one of the rows that agree in key and text.

    Only where there are such rows is the table written with row numbers, the smallest of which decide.
    """
    own = with_identity(docs, key, text)
    if not repeats:
        return own.withColumn("_again", F.lit(False))
    own = materialize(own.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    many = own.groupBy(*ROW).agg(F.min("_row").alias("_least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return own.join(many, ROW, "left").withColumn("_again", F.coalesce(F.col("_row") > F.col("_least"), F.lit(False))).drop("_row", "_least")
