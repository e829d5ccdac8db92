"""Inventory, workforce, commerce and company reports, and ordered folds over one key."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tabloom.functions.expressions import col, money, safe_div
from tabloom.operators.joins import merge_on_spine
from tabloom.operators.order import add_ranks, written_once
from tabloom.operators.windows import pct_change

#: Applications that are folded in one group, if components allow.
FOLDED = 50_000


def inventory(products: DataFrame, moves: DataFrame, sku: str, days: int, multiplier: float = 2.0) -> DataFrame:
    """products: sku, opening, locked, defective, safety, lead_days, target_days, status. moves: sku, kind (received, sold, adjusted, transit), quantity, day (days before the cutoff).

    Book stock; sellable stock without locked and defective pieces; the daily rate of the last days and how many days stock lasts at it;
    reorder point (safety stock and sales of the lead time) and target (safety stock and sales of the target days) in whole
    pieces; what to order at or below the reorder point, less what is in transit; what is in excess: of a product that lasts longer than
    multiplier times its target days, or does not sell and has more than its safety stock, all above the target, and of a
    discontinued one all of it. Unknown stays unknown: where an input is missing nothing is ordered or in excess.
    """
    q = col("quantity")
    m = moves.groupBy(sku).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, q)), F.lit(0)).alias(k) for k in ("received", "sold", "adjusted", "transit")], F.coalesce(F.sum(F.when((F.col("kind") == "sold") & F.col("day").between(0, days - 1), q)), F.lit(0)).alias("recent"))
    out = products.join(m, sku, "left").fillna(0, ["received", "sold", "adjusted", "transit", "recent"])
    out = out.withColumn("book", F.col("opening") + F.col("received") - F.col("sold") + F.col("adjusted")).withColumn("sellable", F.col("book") - F.col("locked") - F.col("defective"))
    out = out.withColumn("daily_rate", F.col("recent") / F.lit(float(days))).withColumn("cover_days", F.when(F.col("daily_rate") > 0, F.col("sellable") / F.col("daily_rate")))
    whole = lambda days_of: F.ceil(F.col("safety") + F.col("daily_rate") * F.col(days_of))
    out = out.withColumn("reorder_point", whole("lead_days")).withColumn("target", whole("target_days"))
    known = F.col("sellable").isNotNull() & F.col("safety").isNotNull() & F.col("lead_days").isNotNull() & F.col("target_days").isNotNull()
    gone = F.coalesce(F.col("status") == "discontinued", F.lit(False))
    short = ~gone & (F.col("sellable") <= F.col("reorder_point"))
    idle = F.when(F.col("daily_rate") > 0, F.col("cover_days") > F.col("target_days") * multiplier).otherwise(F.col("sellable") > F.col("safety"))
    over = ~gone & idle
    above = lambda x: F.greatest(x, F.lit(0))
    order = F.when(short, F.ceil(above(F.col("target") - F.col("sellable") - F.col("transit")))).otherwise(0)
    excess = F.when(over, F.floor(above(F.col("sellable") - F.col("target")))).when(gone, F.floor(above(F.col("sellable")))).otherwise(0)
    out = out.withColumn("to_order", F.when(known, order)).withColumn("excess", F.when(known, excess))
    status = F.when(~known, "unknown").when(F.col("sellable") < 0, "negative").when(gone, F.when(F.col("sellable") > 0, "discontinued_stock").otherwise("discontinued")).when(F.col("to_order") > 0, "reorder").when(over, "overstock").otherwise("normal")
    return out.withColumn("stock_status", status)


def workforce(people: DataFrame, attendance: DataFrame, performance: DataFrame, person: str, workdays: float = 22.0, excellent: float = 85.0, attention: float = 60.0) -> DataFrame:
    """people: person, active. attendance: person, month, present, late, early, leave_days. performance: person, attainment (a share), rating (0 to 5).

    Days absent are those expected in the person's months that were neither worked nor leave. Attendance scores 100 - 5 late - 5 early - 2 leave - 10 absent,
    between 0 and 100; performance 70 for attainment and 30 for the rating, neither counting beyond its full mark; the composite is 0.3 / 0.7 of
    them. Who is active and complete is ranked. excellent: a high composite, late once at most, never absent; attention: a low composite, late
    five times, present below 85 %, attainment below 80 % or rating below 4. Who has no attendance, or a month that is not whole, is incomplete: nothing is
    judged of that person. risk: high with a composite below 60, late eight times or present below 75 %; medium with attention otherwise.
    """
    parts = ("present", "late", "early", "leave_days")
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in parts])
    a = attendance.groupBy(person).agg(F.count_distinct("month").alias("_own"), F.bool_and(whole).alias("_whole"), *[F.sum(c).alias(c) for c in parts])
    spread = attendance.agg(F.greatest(F.count_distinct("month"), F.lit(1)).alias("_all"))  # one row
    p = performance.groupBy(person).agg(F.avg("attainment").alias("attainment"), F.avg("rating").alias("rating"))
    out = people.join(a, person, "left").join(p, person, "left").crossJoin(F.broadcast(spread))
    there = F.coalesce("_whole", F.lit(False))
    out = out.withColumn("months", F.when(F.col("_own") > 0, F.col("_own")).otherwise(F.col("_all"))).withColumns({c: F.when(there, F.col(c)) for c in parts})
    expected = F.col("months") * workdays
    out = out.withColumn("absent", F.greatest(expected - F.col("present") - F.col("leave_days"), F.lit(0.0)) + F.col("present") * 0).withColumn("attendance_rate", F.least(F.try_divide(F.col("present").cast("double"), expected), F.lit(1.0)) + F.col("present") * 0)
    clip = lambda x, top: F.when(x.isNotNull(), F.least(F.lit(float(top)), F.greatest(F.lit(0.0), x.cast("double"))))
    out = out.withColumn("attendance_score", clip(100 - 5 * F.col("late") - 5 * F.col("early") - 2 * F.col("leave_days") - 10 * F.col("absent"), 100))
    out = out.withColumn("performance_score", clip(F.col("attainment"), 1) * 70 + clip(F.col("rating"), 5) / 5 * 30).withColumn("composite", F.round(0.3 * F.col("attendance_score") + 0.7 * F.col("performance_score"), 8))
    active = F.coalesce("active", F.lit(True))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    low = is_(F.col("composite") < attention) | is_(F.col("late") >= 5) | is_(F.col("attendance_rate") < 0.85) | is_(F.col("attainment") < 0.8) | is_(F.col("rating") < 4)
    best = is_(F.col("composite") >= excellent) & is_(F.col("late") <= 1) & is_(F.col("absent") == 0)
    worst = is_(F.col("composite") < 60) | is_(F.col("late") >= 8) | is_(F.col("attendance_rate") < 0.75)
    group = F.when(~active, "not_employed").when(~there, "incomplete").when(low, "attention").when(best, "excellent").otherwise("normal")
    risk = F.when(~active, "not_applicable").when(~there, "unverified").when(worst, "high").when(low, "medium").otherwise("low")
    out = out.withColumn("group", group).withColumn("risk", risk).withColumn("_ranked", F.when(active, F.col("composite"))).drop("_own", "_whole", "_all")
    return add_ranks(out, "_ranked", smallest="rank").drop("_ranked")


def monthly_company(facts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """facts: name -> (table, date, amount). Months with each fact's sum and the change of the first; facts are summed by themselves before they meet."""
    sums = {n: df.groupBy(F.date_trunc("month", col(d)).cast("date").alias("month")).agg(F.sum(money(v)).alias(n)) for n, (df, d, v) in facts.items()}
    spine = reduce(lambda a, b: a.union(b), [s.select("month") for s in sums.values()]).where("month is not null").distinct()
    first = next(iter(facts))
    out = merge_on_spine(spine, sums, ["month"])
    return out.withColumn(f"{first}_change", pct_change(F.col(first).cast("double"), ["month"]))


def channel_contribution(orders: DataFrame, refunds: DataFrame, ads: DataFrame, channel: str) -> DataFrame:
    """Paid, refunds, net, cost, ads, contribution and return on ads of each channel."""
    o = orders.groupBy(channel).agg(F.sum(money("paid")).alias("paid"), F.sum(money("cost")).alias("cost"))
    r = refunds.groupBy(channel).agg(F.sum(money("refund")).alias("refund"))
    a = ads.groupBy(channel).agg(F.sum(money("ad_cost")).alias("ad_cost"))
    spine = o.select(channel).union(r.select(channel)).union(a.select(channel)).distinct()
    out = merge_on_spine(spine, {"o": o, "r": r, "a": a}, [channel]).fillna(0)
    out = out.withColumn("net", F.col("paid") - F.col("refund"))
    return out.withColumn("contribution", F.col("net") - F.col("cost") - F.col("ad_cost")).withColumn("roas", safe_div(F.col("net").cast("double"), F.col("ad_cost").cast("double")))


def capped_returns(lines: DataFrame, returns: DataFrame, line: str, sold: str, order_by: str) -> DataFrame:
    """Returns in order; one that would take a line's returns above what was sold is rejected, later smaller ones still count. lines: a row for each line.

    Unknown quantities take nothing, and whether they are accepted is unknown, as it is for a line of which is not known what was sold. Returns without an order come
    last, smaller quantities first where orders are equal. Returns are dealt by line and sorted; a task reads line after line in batches and keeps what is left
    of one number only, so lines may be many, and one may have any number of returns.
    """
    both = returns.join(lines.select(line, F.col(sold).cast("double").alias("_sold")), line)
    own = Window.partitionBy(line).orderBy(F.col(order_by).asc_nulls_last(), F.col("quantity").asc_nulls_last())
    # rows leave the window sorted, all of a line after another in one task
    both = both.withColumn("_first", F.row_number().over(own) == 1).withColumn("_take", F.col("quantity").cast("double"))
    names = returns.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = 0.0
        for batch in batches:
            ok = []
            for first, s, q in zip(*[batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_first", "_sold", "_take")]):
                if first:
                    left = s
                good = q <= left or left != left  # no number is the largest, as in Spark
                ok.append(good)
                if good:
                    left -= q
            known = pc.and_(pc.is_valid(batch.column("_take")), pc.is_valid(batch.column("_sold")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pc.if_else(known, pa.array(ok, pa.bool_()), None)], [*names, "accepted"])

    return both.select(*names, "_sold", "_first", "_take").mapInArrow(fold, StructType([*returns.schema, StructField("accepted", BooleanType())]))


def apply_receipts(receipts: DataFrame, documents: DataFrame, applications: DataFrame) -> DataFrame:
    """applications (application, receipt, document, amount) in order of application; one that would overdraw its receipt or its document is skipped.

    Receipts and documents that share applications form components; each is folded in order, FOLDED applications or so of whole components in a group.
    """
    edges = applications.select(F.concat(F.lit("r"), F.col("receipt").cast("string")).alias("a"), F.concat(F.lit("d"), F.col("document").cast("string")).alias("b")).distinct()
    label = edges.select(F.col("a").alias("n")).union(edges.select("b")).distinct().withColumn("c", F.col("n"))
    while True:  # smallest name spreads; a shortcut through the name halves the way each round
        near = edges.join(label.withColumnRenamed("n", "a"), "a").select(F.col("b").alias("n"), "c").union(edges.join(label.withColumnRenamed("n", "b"), "b").select(F.col("a").alias("n"), "c"))
        new = label.union(near).groupBy("n").agg(F.min("c").alias("c"))
        new = written_once(new.join(new.select(F.col("n").alias("c"), F.col("c").alias("cc")), "c").select("n", F.col("cc").alias("c")))
        if new.join(label.withColumnRenamed("c", "old"), "n").where("c <> old").isEmpty():
            break
        label = new
    rows = applications.withColumn("n", F.concat(F.lit("r"), F.col("receipt").cast("string"))).join(new, "n").drop("n")
    rows = rows.join(receipts.select("receipt", F.col("amount").cast("double").alias("_r")), "receipt").join(documents.select("document", F.col("amount").cast("double").alias("_d")), "document")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("application")
        r, d, ok = dict(zip(pdf["receipt"], pdf["_r"])), dict(zip(pdf["document"], pdf["_d"])), []
        for a, b, x in zip(pdf["receipt"], pdf["document"], pdf["amount"]):
            x = float(x)
            good = x <= r[a] + 1e-9 and x <= d[b] + 1e-9
            ok.append(good)
            if good:
                r[a] -= x
                d[b] -= x
        return pd.DataFrame({"application": pdf["application"], "applied": ok})

    # components share nothing, so many of them are folded in one order at a time
    rows = written_once(rows)
    n = -(-rows.count() // FOLDED) or 1
    return rows.groupBy(F.pmod(F.xxhash64("c"), F.lit(n))).applyInPandas(fold, "application long, applied boolean")
