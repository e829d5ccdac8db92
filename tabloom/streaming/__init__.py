"""Streaming forms of trends, validation and dedup (an extension: business tables usually arrive whole)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import col
from tabloom.operators.aggregate import aggregate


def windowed_trend(stream: DataFrame, when: str, value: str, width: str = "1 day", late: str = "1 hour", how: str = "sum", by: list[str] = (), slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows by event time; rows later than the watermark are dropped by Spark."""
    w = F.window(col(when), width, slide) if slide else F.window(col(when), width)
    return stream.withWatermark(when, late).groupBy(w, *by).agg(aggregate(how, value).alias(value)).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *by, value)


def session_counts(stream: DataFrame, when: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(when, late).groupBy(F.session_window(col(when), gap).alias("s"), *by).agg(F.count("*").alias("n")).select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def distinct_events(stream: DataFrame, when: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Exact repeats within the watermark go."""
    return stream.withWatermark(when, late).dropDuplicatesWithinWatermark(keys)


def validate_batches(stream: DataFrame, rules: list[dict], key: list[str], sink: Callable[[DataFrame, int], None]):
    """A writer that hands each batch's failures to sink; start it with a checkpoint."""
    from tabloom.operators.validation import validate

    return stream.writeStream.foreachBatch(lambda df, n: sink(validate(df, rules, key)["failures"], n))


def catch_up(stream: DataFrame, path: str, checkpoint: str):
    """Appends what is new since the last run, then ends: an incremental bookmark."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
