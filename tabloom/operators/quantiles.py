"""Exact quantiles of any number of columns and groups without one buffer for all values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import col

from .order import running_totals


def finite(c: str):
    """A column as double, null where it is no finite number."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def quantiles(df: DataFrame, columns: list[str], probabilities: tuple[float, ...], by: list[str] = ()) -> DataFrame:
    """(by, column_name, n, distinct_values, q): for each group and column the known values, and an array of the quantiles, linear between neighbours.

    Values are counted where they are read, the counts summed over sorted ranges, and the values at the two ranks around each quantile
    picked out; neither a group nor a column is sorted or gathered in one task. Groups without a known value have no row.
    """
    keys = [*by, "column_name"]
    long = df.select(*[col(b) for b in by], *[finite(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    long = long.select(*[col(b) for b in by], F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_v{i}").alias("_x")) for i, c in enumerate(columns)])).alias("_p")).select(*[col(b) for b in by], "_p.*")
    counts = long.where("_x is not null").groupBy(*keys, F.when(F.col("_x") == 0, 0.0).otherwise(F.col("_x")).alias("_x")).agg(F.count("*").alias("_n"))
    run = running_totals(counts, keys, ["_x"], {"_upto": F.col("_n")})
    sizes = run.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("distinct_values"))
    ends = sizes.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", "distinct_values")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & col(k).eqNullSafe(F.col(f"_k{i}"))
    met = run.join(F.broadcast(ends) if not by else ends, same)  # without groups a row for each column
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    holds = lambda i: (F.col("_upto") - F.col("_n") <= i) & (i < F.col("_upto"))
    picks = [F.max(F.when(holds(side(at(p))), F.col("_x"))).alias(f"_{name}{j}") for j, p in enumerate(probabilities) for name, side in (("lo", F.floor), ("hi", F.ceil))]
    out = met.groupBy(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "n", "distinct_values").agg(*picks)
    part = lambda j, p: F.when(F.col(f"_lo{j}") == F.col(f"_hi{j}"), F.col(f"_lo{j}")).otherwise((F.ceil(at(p)) - at(p)) * F.col(f"_lo{j}") + (at(p) - F.floor(at(p))) * F.col(f"_hi{j}"))
    return out.select(*keys, "n", "distinct_values", F.array(*[part(j, p) for j, p in enumerate(probabilities)]).alias("q"))
