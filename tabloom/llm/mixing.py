"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a share of all words by its weight, at most `most` times its own words; what that cuts off is
shared again by weight until no source is above. A source's target is met by taking all its documents as often as
fits wholly, and then a subset for the remaining budget: documents are counted by exact length, every length gets
its even share, longer lengths fill what rounding left, and a bounded-knapsack dynamic programme over the lengths
that are still free hits the last words as exactly as the counts allow. The documents of a length are then chosen in
seeded hash order. The dynamic programme sees counts by length, never documents.

Defined cases: null text has size 0; a null source is a source of its own, last in order; empty documents are never
taken; equal documents are told apart only by their key and may tie; repeated keys with equal texts are taken or left
in one order that reruns repeat; an empty table gives an empty result; extra columns pass through,
and where they clash the new columns get leading underscores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, shelter, word_count
from .copies import running

WEIGHTS = (1, 2, 3)
MOST = 3
#: Bits of the dynamic programme: it fits budgets below this exactly.
DP_BUDGET = 1 << 17
#: Hash parts of a length, so that a hot length is never in one task.
PARTS = 64


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to the budget as found, never above."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = (counts.astype(object) * int(budget) // max(total, 1)).astype(np.int64)
    left = int(budget) - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    if left >= dp_budget:
        for i in order:
            if left < dp_budget:
                break
            n = min(int(counts[i] - take[i]), (left - dp_budget) // int(lengths[i]) + 1, left // int(lengths[i]))
            if n > 0:
                take[i] += n
                left -= n * int(lengths[i])
    # bounded knapsack over the rest: counts in binary parts, reachable sums as the bits of one integer
    mask, reach = (1 << (left + 1)) - 1, 1
    via = np.full(left + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in order[::-1]:
        free = min(int(counts[i] - take[i]), left // int(lengths[i])) if lengths[i] <= left else 0
        part = 1
        while free > 0 and not reach >> left & 1:
            n = min(part, free)
            new = (reach << (n * int(lengths[i]))) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")[: left + 1]
                via[np.flatnonzero(bits)] = len(items)
                reach |= new
            items.append((int(i), n))
            free -= n
            part *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    while at > 0:
        i, n = items[via[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's lengths; its rows are counts, one for each distinct length."""
    pdf = pdf.sort_values("size")
    own = int((pdf["size"] * pdf["n"]).sum())
    target = float(pdf["target"].iloc[0])
    whole = min(MOST, int(target // own)) if own else 0
    take = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), max(0, round(target) - whole * own)) if whole < MOST else np.zeros(len(pdf), np.int64)
    return pd.DataFrame({"_source": pdf["_source"], "_null": pdf["_null"], "size": pdf["size"], "_whole": whole, "_extra": take})


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sources: _source, _null, source_size. Adds target, by water filling.

    A source is capped if its cap by weight is below the level that the others reach. Sources sorted by that
    ratio, the capped ones are a prefix, found from running sums over one row per source.
    """
    numbered = running(sources, ["_null", "_source"], _place=F.lit(1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("_place", F.lit(len(weights))) + 1).cast("int"))
    s = numbered.withColumn("_w", w).withColumn("_cap", most * F.col("source_size").cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    s = running(s, ["_ratio", "_null", "_source"], _before=F.col("_cap"), _wbefore=F.col("_w"))
    level = (F.lit(0.0) + F.col("_total") - F.col("_before")) / (F.col("_allw") - F.col("_wbefore"))
    s = s.crossJoin(F.broadcast(s.agg(F.sum("source_size").cast("double").alias("_total"), F.sum("_w").alias("_allw"))))  # one row
    first = s.where(F.col("_ratio") > level).agg(F.min(F.struct("_ratio", level.alias("_level")))["_level"].alias("_level"))
    s = s.crossJoin(F.broadcast(first))
    return s.select("_source", "_null", "source_size", F.least("_cap", F.coalesce(F.col("_w") * F.col("_level"), F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 9) -> DataFrame:
    """Adds size, source_size, target and taken (words that the mix takes from the document, repeats counted) to docs."""
    docs, back = shelter(docs, key, text, source)
    h = F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    own = docs.withColumns({"size": word_count(F.col(text)), "_null": F.col(source).isNull(), "_source": F.coalesce(F.col(source), F.lit("")), "_h": h}).withColumn("_part", F.pmod(F.shiftright("_h", 20), F.lit(PARTS)).cast("int"))
    parts = materialize(own.groupBy("_null", "_source", "size", "_part").agg(F.count("*").alias("n")), "mix-parts")
    counts = parts.groupBy("_null", "_source", "size").agg(F.sum("n").alias("n"))
    goal = materialize(targets(counts.groupBy("_null", "_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "mix-targets")
    fitted = counts.where("size > 0").join(goal, ["_null", "_source"]).groupBy("_null", "_source").applyInPandas(_solve, "_source string, _null boolean, size long, _whole long, _extra long")
    # how many of each part: the parts of a length are filled in their order
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_null", "_source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = parts.join(fitted, ["_null", "_source", "size"]).withColumn("_take", F.greatest(F.lit(0), F.least(F.col("n"), F.col("_extra") - before))).select("_null", "_source", "size", "_part", "_whole", "_take")
    plan = materialize(plan, "mix-plan")
    rank = F.row_number().over(Window.partitionBy("_null", "_source", "size", "_part").orderBy("_h", key))
    out = own.withColumn("_rank", rank).join(plan, ["_null", "_source", "size", "_part"], "left").join(goal, ["_null", "_source"])
    times = F.coalesce(F.col("_whole"), F.lit(0)) + F.when(F.col("_rank") <= F.col("_take"), 1).otherwise(0)
    out = out.withColumn("taken", (times * F.col("size")).cast("long"))
    return back(out, ["size", "source_size", "target", "taken"])
