"""What fits: events in order, each taking amounts from capacities, accepted only if all of them have room."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import running_totals, written_once


def accept_in_order(legs: DataFrame, capacities: DataFrame, event: str, order: str, key: str, amount: str, capacity: str) -> DataFrame:
    """(event, accepted): events are taken in `order` (total, the same on all legs of an event); one is accepted if each of its legs fits in what earlier accepted ones left of its key.

    legs: event, order, key, amount (not negative), a row for each key that an event takes from. A key without a row in capacities, or with a
    null one, has none; so has a null amount. A key whose legs all fit refuses nobody, so only events on other keys are looked at. Of
    those, rounds decide who fits even if all that is open before it is accepted, and who does not though none of it is; each round decides the
    first open event at least, and whole stretches as a rule. What an accepted event takes is taken off its keys at once: all that is open before
    it fits beside it, or it would be open too. So a round reads only what is still open. Sums run over ranges of key and order, so a key of any
    size is spread.
    """
    bad = refused_in_order(legs, event, order, key, amount, capacity, capacities).withColumn("_bad", F.lit(True))
    out = legs.select(F.col(event).alias("_e")).distinct().join(bad.withColumnRenamed(event, "_e"), "_e", "left")
    return out.select(F.col("_e").alias(event), F.col("_bad").isNull().alias("accepted"))


def refused_in_order(legs: DataFrame, event: str, order: str, key: str, amount: str, capacity: str, capacities: DataFrame | None = None) -> DataFrame:
    """(event): the events that accept_in_order does not accept. Without capacities, legs hold the capacity of their key, which no table of keys is read for."""
    given = [] if capacities is not None else [F.col(capacity).cast("decimal(24,6)").alias("_c")]
    rows = legs.select(F.col(event).alias("_e"), F.col(order).alias("_o"), F.col(key).alias("_k"), F.col(amount).cast("decimal(24,6)").alias("_x"), *given)
    # what a key is asked for is summed before it meets its room; only legs on keys that do not suffice are written
    asked = rows.groupBy("_k").agg(F.sum("_x").alias("_all"), F.bool_or(F.col("_x").isNull()).alias("_gap"), *([F.max("_c").alias("_c")] if given else []))
    if not given:
        room = capacities.select(F.col(key).alias("_key"), F.col(capacity).cast("decimal(24,6)").alias("_c"))
        asked = asked.join(room, F.col("_k") == F.col("_key"), "left")
    short = asked.where("_c is null or _gap or _all > _c").select(F.col("_k").alias("_key"), "_c", (F.col("_all") > F.col("_c")).alias("_full"))
    rows = written_once(rows.select("_e", "_o", "_k", "_x").join(short, F.col("_k").eqNullSafe(F.col("_key"))).drop("_key"))
    wrong = rows.where("_c is null or _x is null").select("_e").distinct()
    tight = written_once(rows.where("_full").drop("_full").join(wrong, "_e", "left_anti"))
    refused = []
    while not tight.isEmpty():
        run = running_totals(tight, ["_k"], ["_o", "_e"], {"_most": F.col("_x")}).repartition("_e")
        state = run.groupBy("_e").agg(F.bool_and(F.col("_most") <= F.col("_c")).alias("_fits"), F.bool_or(F.col("_x") > F.col("_c")).alias("_never"))
        run = written_once(run.join(state, "_e").select("_e", "_o", "_k", "_x", "_c", "_fits", "_never"))
        refused.append(run.where("_never").select("_e"))
        # who fits took from its keys; of the open rest, a key that suffices is looked at no more
        took = run.where("not _never").groupBy("_k").agg(F.sum(F.when(F.col("_fits"), F.col("_x"))).alias("_took"), F.sum(F.when(~F.col("_fits"), F.col("_x"))).alias("_open"), F.first("_c").alias("_c"))
        left = took.select("_k", (F.col("_c") - F.coalesce("_took", F.lit(0))).cast("decimal(24,6)").alias("_c"), "_open").where("_open > _c").drop("_open")
        tight = written_once(run.where("not _never and not _fits").select("_e", "_o", "_k", "_x").join(left, "_k"))
    return reduce(DataFrame.union, [wrong, *refused]).distinct().withColumnRenamed("_e", event)
