"""Reports from the schema alone: column roles by name and type, then rankings, trends and outliers of every measure."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import col
from tabloom.operators import aggregate, profile, stats

IDENTIFIER = re.compile(r"(^|_)(id|key|code|no|number)$|key$", re.I)
RATIO = re.compile(r"rate|ratio|percent|pct|share|margin|discount|tax", re.I)
BALANCE = re.compile(r"balance|stock|inventory|bal$", re.I)
SCORE = re.compile(r"score|rating|level|size", re.I)


def roles(df: DataFrame) -> dict[str, str]:
    """identifier, date, ratio, balance, score, additive or dimension for each column."""
    out = {}
    for c, t in df.dtypes:
        if t.startswith(("timestamp", "date")):
            out[c] = "date"
        elif IDENTIFIER.search(c):
            out[c] = "identifier"
        elif t in ("int", "bigint", "double", "float") or t.startswith("decimal"):
            out[c] = "ratio" if RATIO.search(c) else "balance" if BALANCE.search(c) else "score" if SCORE.search(c) else "additive"
        else:
            out[c] = "dimension"
    return out


#: Role -> how values of it may be summed up.
SUMMARY = {"additive": "known_sum", "ratio": "mean", "score": "mean", "balance": "last"}


def adaptive_report(df: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """dictionary, quality, and for each measure a ranking (its first `top` members) by every dimension, a monthly trend and its outlier limits."""
    r = roles(df)
    measures = [c for c in df.columns if r[c] in ("additive", "ratio", "score")]
    dims = [c for c in df.columns if r[c] == "dimension"]
    out = {"dictionary": profile.profile(df), "quality": profile.quality_metrics(df)}
    date = next((c for c in df.columns if r[c] == "date"), None)
    for m in measures:
        how = SUMMARY[r[m]]
        value = col(m).cast("decimal(18,4)") if how == "known_sum" else col(m)
        for d in dims:
            g = df.groupBy(d).agg(aggregate.aggregate(how, value).alias("value"), F.count("*").alias("rows"))
            out[f"{m}_by_{d}"] = g.orderBy(F.desc_nulls_last("value"), d).limit(top)
        if date:
            out[f"{m}_trend"] = df.where(col(date).isNotNull()).groupBy(F.date_trunc("month", col(date)).cast("date").alias("month")).agg(aggregate.aggregate(how, value).alias("value"))
    if measures:
        out["outliers"] = stats.outlier_summary(df, measures)
    return out
