"""E-commerce diagnosis from independent tables: orders, refunds, settlements, advertising, stock and the product master.

Each table is summed up by itself before sums meet on a common list of channels or months, so no amount is counted twice. Counted are
orders whose status tells of success and refunds whose status tells that the money is back; the others are set apart.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import business as B
from tabloom.functions.expressions import money, safe_div
from tabloom.operators.dedup import deduplicate_events, unique_master
from tabloom.operators.joins import merge_on_spine
from tabloom.operators.order import Outputs, written_once

FEES = ("commission", "service", "logistics")

#: Shares and months from which a channel, product, customer or stock needs attention.
THIN_CHANNEL, THIN_MARGIN, PRODUCT_REFUNDS, BUYER_REFUNDS, STOCK_MONTHS = 0.03, 0.2, 0.3, (0.2, 0.4), (9, 18)


def _share(a: str, b: str) -> Column:
    return safe_div(F.col(a).cast("double"), F.col(b).cast("double"))


def _month(c: str) -> Column:
    return F.date_trunc("month", F.col(c)).cast("date")


def _grade(top: Column, middle: Column) -> Column:
    """P0, P1 or P2; what is unknown is P2."""
    return F.when(F.coalesce(top, F.lit(False)), "P0").when(F.coalesce(middle, F.lit(False)), "P1").otherwise("P2")


def _spine(column: str, *tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [t.select(column) for t in tables]).where(F.col(column).isNotNull()).distinct()


def sold(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct order lines of success with month and standard cost (unknown where the master has none)."""
    master = unique_master(products.select("sku", "unit_cost"), ["sku"])
    rows = orders.distinct().where(B.order_status("status") == "success").join(master, "sku", "left")
    return rows.withColumns({"month": _month("day"), "paid": money("paid"), "list_price": money("list_price"), "discount": F.coalesce(money("discount"), F.lit(0).cast("decimal(18,2)")), "cost": (F.col("quantity").cast("decimal(12,2)") * money("unit_cost")).cast("decimal(18,2)")})


def returned(refunds: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """confirmed refunds with the channel, customer and month of their orders, and pending ones; a refund number stands for one event."""
    owners = unique_master(lines.select("order_no", "channel", "customer", F.col("month").alias("order_month")), ["order_no"])
    rows = deduplicate_events(refunds, ["refund_no"]).join(owners, "order_no", "left").withColumns({"month": _month("day"), "amount": money("amount")})
    state = B.refund_status("status")
    return {"confirmed": rows.where(state == "confirmed"), "pending": rows.where(state != "confirmed")}


def settled(settlements: DataFrame) -> DataFrame:
    """Settlements with their fees and the gap that is left between base, fees, refunds and what was received."""
    fee = reduce(lambda a, b: a + b, [F.coalesce(money(c), F.lit(0)) for c in FEES])
    out = settlements.withColumns({"fees": fee.cast("decimal(18,2)"), "base": money("base"), "received": money("received")})
    return out.withColumn("gap", (F.col("base") - F.col("fees") - F.coalesce(money("refund_offset"), F.lit(0)) - F.col("received")).cast("decimal(18,2)"))


def diagnosis(products: DataFrame, orders: DataFrame, refunds: DataFrame, settlements: DataFrame, ads: DataFrame, inventory: DataFrame) -> Outputs:
    """totals, channels, months (each amount in its own month), order_months (refunds in their order's month), products, customers,
    inventory, settlements and pending. A channel's or month's cost is unknown if one of its lines has none.

    Each output is built when it is first asked for; the order lines of success and the sums by channel or month, which several steps read, are written once."""
    lines = cache(lambda: written_once(sold(orders, products)))
    back = cache(lambda: returned(refunds, lines()))
    done = cache(lambda: settled(settlements))
    cost = F.when(F.count_if(F.col("cost").isNull()) == 0, F.coalesce(F.sum("cost"), F.lit(0))).alias("cost")
    sales = lambda by: lines().groupBy(by).agg(F.sum("paid").alias("paid"), F.count_distinct("order_no").alias("orders"), cost)
    refund = lambda by, name=None: back()["confirmed"].groupBy(F.col(by).alias(name or by)).agg(F.sum("amount").alias("refund"))
    fees = lambda by: done().groupBy(by).agg(F.sum("fees").alias("fees"), F.sum("received").alias("received"), F.sum("base").alias("base"))
    spend = lambda by: ads.groupBy(by).agg(F.sum(money("spend")).alias("spend"), F.sum(money("attributed")).alias("attributed"))

    def met(by: str) -> DataFrame:
        facts = {n: written_once(f) for n, f in {"s": sales(by).withColumn("has", F.lit(True)), "r": refund(by), "f": fees(by), "a": spend(by)}.items()}
        out = merge_on_spine(_spine(by, *facts.values()), facts, [by])
        known = F.when(F.col("has"), F.col("cost")).otherwise(F.lit(0))  # no sale, no cost
        out = out.withColumn("cost", known.cast("decimal(18,2)")).drop("has").fillna(0, ["paid", "orders", "refund", "fees", "received", "base", "spend", "attributed"])
        return out.withColumns({"net": F.col("paid") - F.col("refund"), "roas": _share("attributed", "spend"), "contribution": F.col("received") - F.col("cost") - F.col("spend")})

    def channels() -> DataFrame:
        out = met("channel").withColumns({"refund_rate": _share("refund", "paid"), "fee_rate": _share("fees", "base"), "contribution_rate": _share("contribution", "paid")})
        every = out.agg(F.greatest(F.sum("paid"), F.lit(1)).alias("_paid"))
        return out.crossJoin(F.broadcast(every)).withColumn("priority", _grade(F.col("contribution") < 0, F.col("contribution") / F.col("_paid") < THIN_CHANNEL)).drop("_paid")  # one row

    def order_months() -> DataFrame:
        own = {"s": written_once(sales("month")), "r": written_once(refund("order_month", "month"))}
        return merge_on_spine(_spine("month", *own.values()), own, ["month"]).fillna(0, ["paid", "refund", "orders"]).withColumn("net", F.col("paid") - F.col("refund")).withColumn("gross", F.col("net") - F.col("cost"))

    def items() -> DataFrame:
        per = lines().groupBy("sku").agg(F.sum("paid").alias("paid"), F.sum("list_price").alias("list_price"), F.sum("discount").alias("discount"), F.sum("quantity").alias("quantity"), F.count_distinct("order_no").alias("orders"), cost)
        per = per.join(refund("sku"), "sku", "left").fillna(0, ["refund"]).withColumn("net", F.col("paid") - F.col("refund")).withColumn("gross", F.col("net") - F.col("cost"))
        per = per.withColumns({"margin": _share("gross", "net"), "discount_rate": _share("discount", "list_price"), "refund_rate": _share("refund", "paid")})
        return per.withColumn("priority", _grade(F.col("gross") < 0, (F.col("margin") < THIN_MARGIN) | (F.col("refund_rate") >= PRODUCT_REFUNDS)))

    def customers() -> DataFrame:
        buyers = lines().groupBy("customer").agg(F.sum("paid").alias("paid"), F.count_distinct("order_no").alias("orders")).join(refund("customer"), "customer", "left").fillna(0, ["refund"]).withColumn("refund_rate", _share("refund", "paid"))
        return buyers.withColumn("priority", _grade(F.col("refund_rate") >= BUYER_REFUNDS[1], F.col("refund_rate") >= BUYER_REFUNDS[0]))

    def totals() -> DataFrame:
        out = lines().agg(F.sum("paid").alias("paid"), F.sum("discount").alias("discount"), F.sum("list_price").alias("list_price"), F.count_distinct("order_no").alias("orders"), cost)
        one = [back()["confirmed"].agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("refund")), back()["pending"].agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("pending_refund")), done().agg(F.sum("fees").alias("fees"), F.sum("received").alias("received")), ads.agg(F.sum(money("spend")).alias("spend"), F.sum(money("attributed")).alias("attributed"))]
        for x in one:  # one row each
            out = out.crossJoin(F.broadcast(x))
        return out.withColumn("net", F.col("paid") - F.col("refund")).withColumns({"gross": F.col("net") - F.col("cost"), "discount_rate": _share("discount", "list_price"), "roas": _share("attributed", "spend"), "contribution": F.col("received") - F.col("cost") - F.col("spend")})

    return Outputs({"primary": totals, "channels": channels, "months": lambda: met("month").withColumn("gross", F.col("net") - F.col("cost")), "order_months": order_months, "products": items, "customers": customers, "inventory": lambda: coverage(inventory, lines(), products), "settlements": done, "pending": lambda: back()["pending"]})


def coverage(inventory: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """Goods (services have no stock) of the last stock month: how many months they last at the last month's sales, and what they lie above their safety stock."""
    last = inventory.agg(F.max("month").alias("_m"))
    now = inventory.crossJoin(F.broadcast(last)).where("month = _m").drop("_m")
    units = lines.groupBy("sku", "month").agg(F.sum("quantity").alias("units"))
    recent = units.crossJoin(F.broadcast(lines.agg(F.max("month").alias("_m")))).where("month = _m").select("sku", "units")
    out = now.join(products.select("sku", "kind", "safety").where("coalesce(kind, '') <> 'service'"), "sku").join(recent, "sku", "left").fillna(0, ["units"])
    out = out.withColumns({"months_left": _share("sellable", "units"), "above_safety": F.col("sellable") - F.col("safety")})
    return out.withColumn("priority", _grade(F.col("months_left") >= STOCK_MONTHS[1], F.col("months_left") >= STOCK_MONTHS[0]))
