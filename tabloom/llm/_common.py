"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words throughout: everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a fresh local one where unset (local sessions, as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like materialize, but as a table in as many buckets of key as a shuffle has partitions: a join by key then shuffles the other side alone."""
    spark = df.sparkSession
    table, n = f"tabloom_{name.replace('-', '_')}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").bucketBy(n, key).option("path", fresh_path(spark, name)).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its files stay, and found reads them by their buckets
    return found


def discard(df: DataFrame) -> None:
    """Delete the files of a table written by `materialize` once nothing reads it any more."""
    spark = df.sparkSession
    base = shared_dir(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if base.split(":", 1)[-1] in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def word_count(text) -> F.Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(key, n: int) -> F.Column:
    """crc32(key as text) mod n; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (splitmix64), vectorised."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names that clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = w
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shelter(df: DataFrame, *used: str):
    """df with all columns but the used ones under names that clash with nothing, and the way back.

    back(out, made) restores the names; a made column whose name the input has gets leading underscores.
    """
    names = {c: f"__extra_{i}" for i, c in enumerate(df.columns) if c not in used}

    def back(out: DataFrame, made: list[str]) -> DataFrame:
        kept = [F.col(names.get(c, c)).alias(c) for c in df.columns if names.get(c, c) in out.columns]
        return out.select(*kept, *[F.col(m).alias(f) for m, f in zip(made, free_name(df, *made))])

    return df.withColumnsRenamed(names), back


def with_first(df: DataFrame, keys: list[str], value: str, name: str, salts: int = 32) -> DataFrame:
    """Adds the smallest `value` of the rows that agree in keys (not null).

    Minima are taken by keys and salt first and joined back by keys and salt, so that no group meets in one task.
    """
    own = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int"))
    parts = own.groupBy(*keys, "_salt").agg(F.min(value).alias("_m"))
    firsts = parts.groupBy(*keys).agg(F.min("_m").alias(name), F.collect_set("_salt").alias("_salts"))
    return own.join(firsts.select(*keys, name, F.explode("_salts").alias("_salt")), [*keys, "_salt"]).drop("_salt")


def sound(vector: str) -> F.Column:
    """True for vectors that have a direction: not null, only finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def bound_batches(spark: SparkSession, rows: int = 256) -> None:
    """Rows that carry whole texts go to Python at most so many at a time, from here on in this session.

    Jobs are lazy, so this can't be undone where the operator returns. Batches of bytes, not rows, are what fills a worker.
    """
    now = int(spark.conf.get(small_batches.KEY))
    if not 0 < now <= rows:
        spark.conf.set(small_batches.KEY, str(rows))


class small_batches:
    """So many rows go to Python at a time while this is entered: few that carry packed blocks, many short ones."""

    KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession, rows: int = 8):
        self.spark, self.rows = spark, rows

    def __enter__(self):
        self.old = self.spark.conf.get(self.KEY)
        self.spark.conf.set(self.KEY, str(self.rows))

    def __exit__(self, *_):
        self.spark.conf.set(self.KEY, self.old)
