"""Outliers, customer segments, regression, box and histogram statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import col

from .order import ranks, written_once
from .quantiles import finite, quantiles


def outlier_limits(df: DataFrame, columns: list[str], method: str = "iqr", factor: float | None = None) -> DataFrame:
    """(column_name, n, center, spread, low, high): q1 - k iqr and q3 + k iqr around the median, or mean -+ k population deviations."""
    k = factor if factor is not None else (1.5 if method == "iqr" else 3.0)
    if method == "iqr":
        found = quantiles(df, columns, (0.25, 0.5, 0.75)).select("column_name", F.col("n").alias("_n"), F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("spread"), F.col("q")[0].alias("_q1"), F.col("q")[2].alias("_q3"))
        every = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string").join(found, "column_name", "left")
        return every.select("column_name", F.coalesce("_n", F.lit(0).cast("long")).alias("n"), "center", "spread", (F.col("_q1") - k * F.col("spread")).alias("low"), (F.col("_q3") + k * F.col("spread")).alias("high"))
    made = []
    for c in columns:
        x = finite(c)
        center, spread = F.avg(x), F.stddev_pop(x)
        made.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), center.alias("center"), spread.alias("spread"), (center - k * spread).alias("low"), (center + k * spread).alias("high")))
    return df.agg(F.array(*made).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def outliers(df: DataFrame, key: list[str], columns: list[str], method: str = "iqr", factor: float | None = None) -> DataFrame:
    """(key, column_name, value, side, score) of values strictly outside the limits; no spread, no score (and by deviations, no outlier)."""
    limits = outlier_limits(df, columns, method, factor)
    long = df.select(*key, *[finite(c).alias(c) for c in columns]).unpivot(key, columns, "column_name", "value").where("value is not null")
    out = long.join(F.broadcast(limits), "column_name").where("value < low or value > high")  # a row for each column
    if method != "iqr":
        out = out.where("spread > 0")
    return out.select(*key, "column_name", "value", F.when(F.col("value") < F.col("low"), "low").otherwise("high").alias("side"), F.try_divide(F.abs(F.col("value") - F.col("center")), F.col("spread")).alias("score"))


def outlier_summary(df: DataFrame, columns: list[str], method: str = "iqr", factor: float | None = None) -> DataFrame:
    found = outliers(df, [], columns, method, factor).groupBy("column_name").agg(F.count("*").alias("outliers"))
    return outlier_limits(df, columns, method, factor).join(found, "column_name", "left").withColumn("outliers", F.coalesce("outliers", F.lit(0)))


SEGMENTS = ("champion", "loyal", "potential", "at_risk", "hibernating", "regular")


def rfm(df: DataFrame, customer: str, date: str, amount: str, transaction: str | None = None, reference: str | None = None, quantiles: int = 5) -> dict[str, DataFrame]:
    """Recency (days to the reference, by default the day after the last), frequency, monetary, scores 1..quantiles, segment.

    Scores rank customers, one row each: ceil(average percentile rank * quantiles); recency the other way round.
    """
    ok = col(customer).isNotNull() & (F.trim(col(customer).cast("string")) != "") & col(date).isNotNull() & finite(amount).isNotNull()
    why = F.concat_ws("; ", F.when(col(customer).isNull() | (F.trim(col(customer).cast("string")) == ""), "customer"), F.when(col(date).isNull(), "date"), F.when(finite(amount).isNull(), "amount"))
    rows = df.where(ok)
    last = rows.agg(F.date_add(F.max(col(date)).cast("date"), 1).alias("_ref")) if reference is None else df.sparkSession.range(1).select(F.lit(reference).cast("date").alias("_ref"))
    f = F.count_distinct(col(transaction)) if transaction else F.count("*")
    per = rows.groupBy(col(customer).alias("customer")).agg(F.max(col(date)).cast("date").alias("_last"), f.alias("frequency"), F.sum(col(amount).cast("decimal(18,2)")).alias("monetary"))
    per = per.crossJoin(F.broadcast(last)).withColumn("recency", F.datediff("_ref", "_last")).drop("_last", "_ref")
    per = written_once(per)
    measures = ("recency", "frequency", "monetary")
    long = per.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_what"), F.col(c).cast("decimal(28,2)").alias("_x")) for c in measures])).alias("_p")).select("_p.*")
    ranked = ranks(long, "_x", ["_what"])  # the three measures in one pass, a row for each value
    share = (F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_total")
    score = F.when(F.col("_total") == 1, quantiles).otherwise(F.least(F.lit(quantiles), F.greatest(F.lit(1), F.ceil(F.round(share * quantiles, 9))))).cast("int")
    turned = F.when(F.col("_total") == 1, quantiles).otherwise(quantiles + 1 - score).cast("int")  # the most recent score highest
    for c, name in zip(measures, "rfm"):
        own = ranked.where(F.col("_what") == c).select(F.col("_x").alias("_y"), (turned if c == "recency" else score).alias(name))
        per = per.join(own, F.col(c).cast("decimal(28,2)") == F.col("_y"), "left").drop("_y")
    high, upper, low = max(2, -(-8 * quantiles // 10)), max(2, -(-6 * quantiles // 10)), max(1, 4 * quantiles // 10)
    r, fq, m = F.col("r"), F.col("f"), F.col("m")
    segment = (
        F.when((r >= high) & (fq >= high) & (m >= high), "champion").when((r >= upper) & (fq >= upper), "loyal").when((r >= high) & (fq <= low), "potential")
        .when((r <= low) & (fq >= upper), "at_risk").when((r <= low) & (fq <= low), "hibernating").otherwise("regular")
    )
    customers = per.withColumn("segment", segment)
    segments = customers.groupBy("segment").agg(F.count("*").alias("customers"), F.sum("monetary").alias("monetary"), F.avg("recency").alias("mean_recency"), F.avg("frequency").alias("mean_frequency"))
    return {"customers": customers, "segments": segments, "invalid": df.where(~ok).withColumn("reason", why)}


def regression(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Least squares line and its determination."""
    rows = df.where(finite(x).isNotNull() & finite(y).isNotNull())
    a, b = col(y).cast("double"), col(x).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regr_r2(a, b))).alias("r2"))


def box_stats(df: DataFrame, value: str, by: str, top: int = 15, shown: int = 30) -> DataFrame:
    """Quartiles, whiskers within 1.5 iqr, the number of outliers and the first of them by size, of the groups with most values."""
    rows = df.select(col(by).alias(by), finite(value).alias("x")).where("x is not null")
    q = quantiles(rows, ["x"], (0.25, 0.5, 0.75), [by]).orderBy(F.desc("n"), by).limit(top).select(by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    inside = F.col("x").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    met = rows.join(F.broadcast(q.withColumnRenamed(by, "_by")), col(by).eqNullSafe(F.col("_by"))).drop("_by")  # `top` rows
    # outliers are cut to `shown` by parts before a group's meet
    far = met.where(~inside).select(by, "x").withColumn("_part", F.pmod(F.xxhash64("x", F.monotonically_increasing_id()), F.lit(64)))
    for part in ([by, "_part"], [by]):
        far = far.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy("x"))).where(F.col("_r") <= shown).drop("_r")
    far = far.groupBy(col(by).alias("_by")).agg(F.array_sort(F.collect_list("x")).alias("outlier_values"))
    out = met.groupBy(by, "n", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"), F.count_if(~inside).alias("outliers"))
    return out.join(far, col(by).eqNullSafe(F.col("_by")), "left").drop("_by").withColumn("outlier_values", F.coalesce("outlier_values", F.array().cast("array<double>")))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, n): equal widths, closed on the right (the first one on both sides); empty bins are there."""
    rows = df.select(finite(value).alias("x")).where("x is not null")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col("x") - F.col("lo")) / width)))).cast("int")
    counts = rows.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    spine = ends.where("lo is not null").select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return spine.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("low"), (F.col("lo") + F.col("bin") * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
