"""Several outputs that appear together or not at all, and bookmarks that move with them.

Outputs are written to a folder of their run's own, which nobody reads yet. What makes them visible is one manifest, written aside and renamed to the
next number: a single rename in the store, after all files are there. Who reads takes the newest manifest, so it sees the old outputs or all new
ones. A run that died before the rename leaves files without a manifest; run again, it starts by deleting them. A run that has been
committed is not done twice. Bookmarks (the largest value read of a source's column, say) stand in the manifest, so they move exactly when the data does.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.expressions import col
from tabloom.operators.relational import OperatorError


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _store(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file


def committed(spark: SparkSession, folder: str) -> dict:
    """The newest manifest: number, run, outputs (name -> folder), rows, bookmarks. Without one, number 0 and nothing."""
    found = _manifests(spark, folder)
    return _read(spark, f"{folder}/{found[-1]}") if found else {"number": 0, "run": None, "outputs": {}, "rows": {}, "bookmarks": {}}


def bookmark(spark: SparkSession, folder: str, name: str, default: str | None = None) -> str | None:
    return committed(spark, folder)["bookmarks"].get(name, default)


def read_committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    outputs = committed(spark, folder)["outputs"]
    if name not in outputs:
        raise OperatorError(f"nothing is committed as {name}")
    return spark.read.parquet(f"{folder}/{outputs[name]}")


def commit_outputs(outputs: dict[str, DataFrame], folder: str, run: str, bookmarks: dict[str, str] | None = None) -> dict:
    """Write all outputs and make them visible at once; returns the manifest. Outputs that are not named stay as they were, and so do bookmarks."""
    if not outputs:
        raise OperatorError("there is nothing to commit")
    spark = next(iter(outputs.values())).sparkSession
    last = committed(spark, folder)
    runs = {m["run"]: m for m in (_read(spark, f"{folder}/{n}") for n in _manifests(spark, folder)[-100:])}
    if run in runs:
        return runs[run]
    place = f"run-{run}"
    fs, staged = _store(spark, f"{folder}/{place}")
    if fs.exists(staged):  # of an attempt that died
        fs.delete(staged, True)
    for name, df in outputs.items():
        df.write.parquet(f"{folder}/{place}/{name}")
    rows = {name: spark.read.parquet(f"{folder}/{place}/{name}").count() for name in outputs}
    manifest = {"number": last["number"] + 1, "run": run, "outputs": {**last["outputs"], **{n: f"{place}/{n}" for n in outputs}}, "rows": {**last["rows"], **rows}, "bookmarks": {**last["bookmarks"], **(bookmarks or {})}}
    aside, made = (_store(spark, f"{folder}/{n}")[1] for n in (f".manifest-{run}.tmp", f"manifest-{manifest['number']:09d}.json"))
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(made) or not fs.rename(aside, made):
        raise OperatorError("another run has been committed meanwhile; run again")
    return manifest


def take_new(df: DataFrame, column: str, spark_folder: str, name: str) -> tuple[DataFrame, dict[str, str]]:
    """Rows of df beyond the committed bookmark, and the bookmarks to commit with what is made of them. Nulls have no place in the order and are left out."""
    seen = bookmark(df.sparkSession, spark_folder, name)
    new = df.where(col(column).isNotNull() if seen is None else col(column) > F.lit(seen).cast(df.schema[column].dataType))
    top = new.agg(F.max(col(column)).cast("string")).first()[0]
    return (new if top is None else new.where(col(column) <= F.lit(top).cast(df.schema[column].dataType))), ({name: top} if top is not None else {})
