"""Chart data sets: small aggregated tables, bounded by their own top-n."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import col, is_missing
from tabloom.operators.aggregate import BLANK, aggregate

#: Longest span in days up to which a grain is used.
GRAINS = ((60, "day"), (240, "week"), (1095, "month"), (2555, "quarter"))


def _label(c: str):
    return F.coalesce(F.when(~is_missing(c), col(c).cast("string")), F.lit(BLANK))


def grain_for(df: DataFrame, date: str) -> str:
    """The grain that fits the span of dates."""
    days = df.agg(F.datediff(F.max(col(date)), F.min(col(date)))).first()[0] or 0
    return next((g for most, g in GRAINS if days <= most), "year")


def check_spec(spec: dict, df: DataFrame) -> list[str]:
    """What speaks against a chart {kind, label, value, series, points}: unknown kinds and columns, values that are no numbers, parts of a
    whole that are negative or too many, lines without an order."""
    kinds, found = dict(df.dtypes), []
    if spec.get("kind") not in ("bar", "column", "line", "area", "pie", "scatter", "box", "histogram", "gantt", "radar", "heatmap"):
        found.append("unknown kind")
    for part in ("label", "value", "series"):
        if spec.get(part) is not None and spec[part] not in kinds:
            found.append(f"unknown {part}")
    if found:
        return found
    value, label = spec.get("value"), spec.get("label")
    if value and not kinds[value].startswith(("int", "bigint", "smallint", "double", "float", "decimal")):
        found.append("the value is no number")
    elif value and spec["kind"] == "pie" and not df.where(col(value) < 0).isEmpty():
        found.append("parts of a whole are negative")
    if label and spec["kind"] in ("pie", "radar") and df.select(label).distinct().limit(13).count() > 12:
        found.append("more than 12 parts")
    if label and spec["kind"] in ("line", "area") and not kinds[label].startswith(("date", "timestamp", "int", "bigint")):
        found.append("a line's labels have no order")
    if spec["kind"] in ("scatter", "box", "histogram") and not value:
        found.append("a value is needed")
    return found


def single_series(df: DataFrame, label: str, value: str | None = None, how: str = "count", top: int = 20) -> DataFrame:
    """(label, value): the largest first, ties by label."""
    agg = aggregate(how, value) if value else F.count("*")
    return df.groupBy(_label(label).alias("label")).agg(agg.alias("value")).orderBy(F.desc("value"), "label").limit(top)


def time_series(df: DataFrame, date: str, value: str, how: str = "sum", grain: str | None = None, last: int = 60) -> DataFrame:
    """(period, value): the last periods in order."""
    grain = grain or grain_for(df, date)
    g = df.where(col(date).isNotNull()).groupBy(F.date_trunc(grain, col(date)).cast("date").alias("period")).agg(aggregate(how, value).alias("value"))
    return g.orderBy(F.desc("period")).limit(last).orderBy("period")


def multi_series(df: DataFrame, label: str, series: str, value: str, how: str = "sum", top: int = 20, most_series: int = 8) -> DataFrame:
    """(label, series, value) of the top labels and series by absolute total."""
    g = df.groupBy(_label(label).alias("label"), _label(series).alias("series")).agg(aggregate(how, value).alias("value"))
    pick = lambda c, n: g.groupBy(c).agg(F.sum(F.abs("value")).alias("_t")).orderBy(F.desc("_t"), c).limit(n).select(c)
    return g.join(F.broadcast(pick("label", top)), "label").join(F.broadcast(pick("series", most_series)), "series").select("label", "series", "value")


def multi_measure(df: DataFrame, label: str, values: list[str], how: str = "sum", top: int = 20) -> DataFrame:
    """(label, one column for each measure), by the first measure."""
    return df.groupBy(_label(label).alias("label")).agg(*[aggregate(how, v).alias(v) for v in values]).orderBy(F.desc(values[0]), "label").limit(top)


def scatter(df: DataFrame, x: str, y: str, key: str, points: int = 2000) -> DataFrame:
    """(x, y) of at most `points` rows, chosen by a hash of their key so that a redraw shows the same ones."""
    rows = df.where(col(x).isNotNull() & col(y).isNotNull())
    return rows.orderBy(F.xxhash64(key), key).limit(points).select(col(key).alias("key"), col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def gantt(df: DataFrame, task: str, start: str, stop: str, top: int = 50) -> DataFrame:
    """(task, start, stop, days) of tasks whose dates are in order, earliest first."""
    rows = df.where(col(start).isNotNull() & col(stop).isNotNull() & (col(start) <= col(stop)))
    g = rows.groupBy(_label(task).alias("task")).agg(F.min(col(start)).cast("date").alias("start"), F.max(col(stop)).cast("date").alias("stop"))
    return g.withColumn("days", F.datediff("stop", "start") + 1).orderBy("start", "task").limit(top)
