"""Summaries, trends, contributions, pivots, correlations, allocations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import col, is_missing, parse_date, parse_number, period

from .order import Outputs, ranks, running_totals, written_once
from .quantiles import finite, quantiles
from .relational import OperatorError, require_columns

BLANK = "(blank)"


def aggregate(name: str, c: str | Column, order: list[str] = ()) -> Column:
    """count size sum known_sum mean min max median nunique first last; over nothing sum is 0 and known_sum null; first and last go by order."""
    x = col(c)
    at = F.when(x.isNotNull(), F.struct(*order)) if order else None
    if name in ("first", "last") and at is None:
        raise OperatorError(f"{name} needs an order")
    return {
        "count": lambda: F.count(x), "size": lambda: F.count("*"), "sum": lambda: F.coalesce(F.sum(x), F.lit(0)), "known_sum": lambda: F.sum(x), "mean": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x),
        "median": lambda: F.median(x), "nunique": lambda: F.count_distinct(x), "first": lambda: F.min_by(x, at), "last": lambda: F.max_by(x, at),
    }[name]()


def group_summary(df: DataFrame, by: list[str], aggregations: dict[str, list[str]], dropna: bool = False, order: list[str] = (), sort: bool = True) -> DataFrame:
    """Columns are named column_function, or by the column alone if it has one function."""
    require_columns(df, *by, *aggregations)
    if dropna:
        df = df.dropna(subset=by)
    made = [aggregate(f, c, order).alias(c if len(fs) == 1 else f"{c}_{f}") for c, fs in aggregations.items() for f in fs]
    out = df.groupBy(*by).agg(*made)
    return out.orderBy(*by) if sort else out


def trend(df: DataFrame, date: str, values: list[str], grain: str = "month", how: str = "sum", by: list[str] = (), name: str = "period") -> DataFrame:
    """Rows need a date and at least one value."""
    some = reduce(lambda a, b: a | b, [col(v).isNotNull() for v in values])
    return df.where(col(date).isNotNull() & some).groupBy(period(date, grain).alias(name), *by).agg(*[aggregate(how, v).alias(v) for v in values])


def trend_report(df: DataFrame, date: str, values: list[str], grain: str = "month", how: str | dict[str, str] = "sum", by: list[str] = (), name: str = "period") -> Outputs:
    """primary: the trend of dates and numbers that may be texts; counts: one row with input_rows, used_rows, bad_dates and bad_<value> for each value.

    A cell that is there and cannot be read is bad; a missing one is not. Rows need a readable date and at least one readable value. how may name an
    aggregation for each value.
    """
    ways = how if isinstance(how, dict) else {v: how for v in values}
    if set(ways) != set(values):
        raise OperatorError("an aggregation for each value")
    kinds = dict(df.dtypes)
    read = {v: parse_number(v) if kinds[v] == "string" else finite(v) if kinds[v] in ("float", "double") else col(v) for v in values}
    day = parse_date(date) if kinds[date] == "string" else col(date)
    rows = df.withColumns({"_day": day, **{f"_v{i}": read[v] for i, v in enumerate(values)}})
    good = F.col("_day").isNotNull() & reduce(lambda a, b: a | b, [F.col(f"_v{i}").isNotNull() for i in range(len(values))])
    bad = lambda c, made: F.count_if(~is_missing(c) & F.col(made).isNull())
    counts = lambda: rows.agg(F.count("*").alias("input_rows"), F.count_if(good).alias("used_rows"), bad(date, "_day").alias("bad_dates"), *[bad(v, f"_v{i}").alias(f"bad_{v}") for i, v in enumerate(values)])
    primary = lambda: rows.where(good).groupBy(period("_day", grain).alias(name), *by).agg(*[aggregate(ways[v], f"_v{i}").alias(v) for i, v in enumerate(values)])
    return Outputs({"primary": primary, "counts": counts})


def contribution(df: DataFrame, category: str, value: str, how: str = "sum", core: float = 0.8, top: int | None = None) -> DataFrame:
    """value, share, running share and whether a category is core (the share before it is below `core`), largest first; the rest of a top as (other).

    Categories are summed once and written, and their running sums are made by sorted ranges, so any number of them is spread. A negative value or a
    total of 0 is refused, as shares of such sums mean nothing.
    """
    g = df.groupBy(F.coalesce(F.when(~is_missing(category), col(category).cast("string")), F.lit(BLANK)).alias("category")).agg(aggregate(how, value).alias("value"))
    g = written_once(g)
    total = g.agg(F.sum("value").alias("total"), F.min("value").alias("least"), F.count("*").alias("n")).first()
    if total.n and (total.total is None or total.total <= 0 or total.least < 0):
        raise OperatorError("shares need values that are not negative and a total above 0")
    g = g.withColumn("_total", F.lit(total.total).cast(g.agg(F.sum("value")).schema[0].dataType))
    out = running_totals(g, [], [F.desc("value"), F.asc("category")], {"_run": F.col("value"), "position": F.lit(1)})
    out = out.withColumn("position", F.col("position").cast("int")).withColumn("share", F.try_divide(F.col("value"), F.col("_total"))).withColumn("running_share", F.try_divide(F.col("_run"), F.col("_total")))
    out = out.withColumn("is_core", F.try_divide(F.col("_run") - F.col("value"), F.col("_total")) < core).drop("_total", "_run")
    if top is not None:
        rest = out.where(F.col("position") > top).agg(F.lit("(other)").alias("category"), F.sum("value").alias("value"), F.lit(top + 1).alias("position"), F.sum("share").alias("share"), F.max("running_share").alias("running_share"), F.lit(False).alias("is_core")).where("value is not null")
        out = out.where(F.col("position") <= top).unionByName(rest)
    return out


def cross_pivot(df: DataFrame, index: list[str], column: str, value: str | None = None, how: str = "count", fill=0, margins: str | None = None, limit: int = 1000) -> DataFrame:
    """Blank keys are a category; columns are named column_value; margins are recomputed from detail rows."""
    blank = lambda c: F.coalesce(F.when(~is_missing(c), col(c).cast("string")), F.lit(BLANK)).alias(c)
    keys = df.select(*[blank(c) for c in (*index, column)], *([col(value)] if value else []))
    values = [r[0] for r in keys.select(column).distinct().orderBy(column).limit(limit + 1).collect()]
    if len(values) > limit:
        raise OperatorError(f"more than {limit} columns")
    agg = aggregate(how, value) if value else F.count(F.lit(1))
    cells = keys.groupBy(*index).pivot(column, values).agg(agg)
    names = {v: f"{column}_{v}" for v in values}
    if margins:
        total = keys.groupBy(*index).agg(agg.alias(margins))
        cells = cells.join(total, index)
        bottom = keys.groupBy().pivot(column, values).agg(agg).crossJoin(keys.agg(agg.alias(margins))).select(*[F.lit(margins).alias(c) for c in index], "*")
        cells = cells.unionByName(bottom)
    out = cells.withColumnsRenamed(names)
    return out.fillna(fill, [*names.values(), *([margins] if margins else [])]) if fill is not None else out


def describe(df: DataFrame, columns: list[str], percentiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A row for each numeric column: count, missing, distinct, mean, std (0 for one value), min, max, sum and percentiles."""
    aggs = []
    for i, c in enumerate(columns):
        x = finite(c)
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), (F.count("*") - F.count(x)).alias("missing"), F.avg(x).alias("mean"), F.when(F.count(x) == 1, 0.0).otherwise(F.stddev_samp(x)).alias("std"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.sum(x).alias("total")).alias(f"c{i}"))
    plain = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    ranked = quantiles(df, columns, percentiles).select("column_name", "distinct_values", *[F.col("q")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(percentiles)])
    out = plain.join(ranked, "column_name", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0).cast("long")))
    return out.select("column_name", "n", "missing", "distinct_values", "mean", "std", "minimum", "maximum", "total", *[f"p{round(p * 100)}" for p in percentiles])


def mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, ties to the smallest, and its count."""
    return df.where(~is_missing(column)).groupBy(col(column).alias("mode")).agg(F.count("*").alias("mode_count")).orderBy(F.desc("mode_count"), "mode").limit(1)


def correlation(df: DataFrame, columns: list[str], method: str = "pearson", min_rows: int = 2) -> DataFrame:
    """(a, b, n, value) of all pairs; each pair uses the rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if method == "pearson":
        made = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.when(col(a).isNotNull() & col(b).isNotNull(), 1)).alias("n"), F.corr(col(a).cast("double"), col(b).cast("double")).alias("value")) for a, b in pairs]
        out = df.agg(F.array(*made).alias("p")).select(F.explode("p").alias("r")).select("r.*")
    else:
        long = reduce(lambda x, y: x.union(y), [df.select(F.lit(a).alias("a"), F.lit(b).alias("b"), col(a).cast("double").alias("x"), col(b).cast("double").alias("y")) for a, b in pairs]).dropna()
        if method == "spearman":
            sides = long.select("a", "b", F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in "xy"])).alias("p")).select("a", "b", "p.*")
            r = ranks(sides, "v", ["a", "b", "side"]).withColumn("rank", F.col("_below") + (F.col("_n") + 1) / 2)  # both in one pass
            ranked = long
            for c in "xy":  # ranks of distinct values, joined back
                ranked = ranked.join(r.where(F.col("side") == c).select("a", "b", F.col("v").alias(c), F.col("rank").alias(f"r{c}")), ["a", "b", c])
            out = ranked.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("value"))
        elif method == "kendall":
            out = _kendall(long)
        else:
            raise OperatorError(f"unknown correlation: {method}")
    return out.withColumn("value", F.when(F.col("n") >= min_rows, F.col("value")))


def _discordant(y, w) -> float:
    """Weight of pairs i < j with y[i] > y[j], counted while merge-sorting."""
    import numpy as np

    y, w, total, width = np.unique(y, return_inverse=True)[1], np.asarray(w, float), 0.0, 1
    while width < len(y):
        for lo in range(0, len(y) - width, 2 * width):
            left, right = slice(lo, lo + width), slice(lo + width, lo + 2 * width)
            above = np.concatenate(([0.0], np.cumsum(w[left])))
            total += float((w[right] * (above[-1] - above[np.searchsorted(y[left], y[right], "right")])).sum())
            both = slice(lo, lo + 2 * width)
            order = np.argsort(y[both], kind="stable")
            y[both], w[both] = y[both][order], w[both][order]
        width *= 2
    return total


def _kendall(long: DataFrame, buckets: int = 64) -> DataFrame:
    """tau-b of each pair of columns from the distinct points (x, y) of a, b, in three parts, none of which has all points in one task.

    Points in order of x and y lie in ranges p, and by y in buckets q. Pairs of points of one range are counted there; pairs of one
    bucket but different ranges in the bucket; what lies in different ranges and buckets is discordant by their numbers alone.
    """
    import numpy as np
    import pandas as pd

    points = long.groupBy("a", "b", "x", "y").agg(F.count("*").alias("w"))
    bounds = points.groupBy("a", "b").agg(F.percentile_approx("y", F.array(*[F.lit(k / buckets) for k in range(1, buckets)])).alias("bounds"))
    n = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = 2 * F.size(F.filter("bounds", lambda v: v < F.col("y"))) + F.array_contains("bounds", F.col("y")).cast("int")  # a frequent value has one of its own
    dealt = points.join(F.broadcast(bounds), ["a", "b"]).withColumn("q", q).drop("bounds")  # a row for each pair of columns
    dealt = written_once(dealt.repartitionByRange(n, "a", "b", "x", "y").withColumn("p", F.spark_partition_id()))

    def inside(by: str, apart: str | None):
        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["x", "y"])
            total = _discordant(pdf["y"], pdf["w"])
            if apart:
                total -= sum(_discordant(g["y"], g["w"]) for _, g in pdf.groupby(apart))
            return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "d": [total]})

        return dealt.where("q % 2 = 0" if apart else "true").groupBy("a", "b", by).applyInPandas(count, "a string, b string, d double")

    cells = dealt.groupBy("a", "b", "p", "q").agg(F.sum("w").alias("w")).toPandas()  # ranges x buckets for each pair of columns
    across = []
    for (a, b), g in cells.groupby(["a", "b"]):
        m = g.pivot_table(index="p", columns="q", values="w", fill_value=0).sort_index().sort_index(axis=1).to_numpy(float)
        later = m[::-1].cumsum(axis=0)[::-1] - m  # in later ranges
        lower = later.cumsum(axis=1) - later  # and in lower buckets
        across.append((a, b, float((m * lower).sum())))
    parts = inside("p", None).union(inside("q", "p"))
    if across:
        parts = parts.union(long.sparkSession.createDataFrame(across, "a string, b string, d double"))
    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    ties = lambda by, name: dealt.groupBy("a", "b", *by).agg(F.sum("w").alias("w")).groupBy("a", "b").agg(pairs("w").alias(name))
    out = parts.groupBy("a", "b").agg(F.sum("d").alias("d")).join(dealt.groupBy("a", "b").agg(F.sum("w").alias("n")), ["a", "b"])
    for by, name in ((["x"], "tx"), (["y"], "ty"), (["x", "y"], "tb")):
        out = out.join(ties(by, name), ["a", "b"])
    all_ = F.col("n").cast("double") * (F.col("n") - 1) / 2
    below = F.sqrt((all_ - F.col("tx")) * (all_ - F.col("ty")))
    value = F.try_divide(all_ - F.col("tx") - F.col("ty") + F.col("tb") - 2 * F.col("d"), below)
    return out.select("a", "b", "n", F.coalesce(value, F.lit(float("nan"))).alias("value"))


def weighted_ratio(df: DataFrame, by: list[str], numerator: str | Column, denominator: str | Column, name: str = "ratio") -> DataFrame:
    """Sum over sum; a zero denominator gives null."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(col(numerator)), F.sum(col(denominator))).alias(name))


def last_balance(df: DataFrame, by: list[str], value: str, when: list[str], name: str | None = None) -> DataFrame:
    """The last known value in order of `when`."""
    return df.groupBy(*by).agg(F.max_by(col(value), F.when(col(value).isNotNull(), F.struct(*when))).alias(name or value))


def balance_at_common_date(df: DataFrame, entity: str, date: str, value: str) -> DataFrame:
    """One row: the sum of balances at the latest date, null unless every entity has one there."""
    last = df.where(col(value).isNotNull()).groupBy(entity).agg(F.max(date).alias("d"), F.max_by(value, date).alias("v"))
    both = last.agg(F.count("*").alias("entities"), F.max("d").alias("as_of"), F.count_distinct("d").alias("dates"), F.sum("v").alias("v"))
    return both.select("as_of", "entities", F.when(F.col("dates") == 1, F.col("v")).alias("balance"))


def complete_sum(c: str | Column) -> Column:
    """0 over nothing, null if any value is unknown."""
    return F.when(F.count_if(col(c).isNull()) == 0, F.coalesce(F.sum(col(c)), F.lit(0)))


def ordered_distinct_text(c: str, order: str, joint: str = "; ") -> Column:
    """Distinct values of a group in order of first appearance."""
    return F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(col(order), col(c).cast("string").alias("_v")))), lambda x: x["_v"])), joint)


def allocate_largest_remainder(df: DataFrame, by: list[str], amount: str, weight: str, order_by: list[str], name: str = "allocated") -> DataFrame:
    """Shares `amount` (the same in all rows of a group) over rows by weight in whole cents; the cents left go to the largest remainders, ties in order. Weight 0 gets 0."""
    w = Window.partitionBy(*by)
    units = F.round(F.abs(col(amount)) * 100).cast("decimal(20,0)")
    wt = col(weight).cast("decimal(18,6)")
    df = df.withColumn("_u", units).withColumn("_w", F.sum(wt).over(w))
    exact = (F.col("_u") * wt).cast("decimal(38,6)")
    df = df.withColumn("_f", F.floor(F.try_divide(exact, F.col("_w"))).cast("decimal(20,0)")).withColumn("_r", exact - (F.col("_f") * F.col("_w")).cast("decimal(38,6)"))
    df = df.withColumn("_left", F.col("_u") - F.sum("_f").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.when(wt > 0, 0).otherwise(1), F.desc("_r"), *order_by)))
    cents = F.col("_f") + F.when((F.col("_n") <= F.col("_left")) & (wt > 0), 1).otherwise(0)
    return df.withColumn(name, F.coalesce((F.signum(col(amount)).cast("int") * cents / 100).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))).drop("_u", "_w", "_f", "_r", "_left", "_n")


def allocate_last_residual(df: DataFrame, by: list[str], amount: str, weight: str, order_by: list[str], name: str = "allocated") -> DataFrame:
    """Shares rounded half up to whole cents in order, clamped to what remains; the last row with a weight takes the residual.

    A share is found in whole numbers, as floor((2 u w + W) / (2 W)) of u cents, weight w and weights W in all, so it is rounded once.
    """
    w, wt = Window.partitionBy(*by), col(weight).cast("decimal(18,6)")
    sign, total = F.signum(col(amount)).cast("int"), F.abs(col(amount).cast("decimal(18,2)"))
    at = w.orderBy(*order_by)
    whole = lambda c: c.cast("decimal(38,0)")
    df = df.withColumns({"_u": whole(total * 100), "_m": whole(wt * 1_000_000), "_t": whole(F.sum(wt).over(w) * 1_000_000)})
    cents = F.expr("cast(cast((2 * _u * _m + _t) as decimal(38,0)) div nullif(2 * _t, 0) as decimal(18,2)) / 100")
    df = df.withColumn("_p", F.coalesce(cents.cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")))
    df = df.withColumn("_c", F.least(total, F.sum("_p").over(at.rowsBetween(Window.unboundedPreceding, 0)))).withColumn("_b", F.coalesce(F.lag("_c").over(at), F.lit(0).cast("decimal(18,2)")))
    df = df.withColumn("_i", F.row_number().over(at)).withColumn("_l", F.max(F.when(wt > 0, F.col("_i"))).over(w))
    part = F.when(F.col("_i") == F.col("_l"), total - F.col("_b")).when(F.col("_i") > F.col("_l"), F.lit(0)).otherwise(F.col("_c") - F.col("_b"))
    return df.withColumn(name, (sign * part).cast("decimal(18,2)")).drop("_u", "_m", "_t", "_p", "_c", "_b", "_i", "_l")


def condense_risks(df: DataFrame, by: list[str], example: str, keep: int = 4) -> DataFrame:
    """Equal findings as one row: how many objects, and the first few of them by name."""
    return df.groupBy(*by).agg(F.count_distinct(example).alias("objects"), F.array_join(F.slice(F.array_sort(F.collect_set(col(example).cast("string"))), 1, keep), "; ").alias("examples"))
