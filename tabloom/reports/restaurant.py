"""Restaurant diagnosis: store-month results with weighted rates, purchases in base units, reviews with their refunds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import business as B
from tabloom.functions.expressions import col, money, safe_div
from tabloom.operators.order import add_ranks, dealt

COSTS = ("food", "labor", "platform", "rent", "utilities", "marketing")


def _known_sums(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Sums over known values; null over none."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])


def _rates(df: DataFrame) -> DataFrame:
    share = lambda c: safe_div(F.col(c).cast("double"), F.col("net_revenue").cast("double"))
    return df.withColumns({"margin": share("profit"), "food_rate": share("food"), "labor_rate": share("labor"), "platform_rate": share("platform")})


def store_months(df: DataFrame, store: str = "store", month: str = "month") -> DataFrame:
    """Rows with a store and a month: net_revenue (given, or revenue less refund), profit and what given results differ by.

    Costs that the table lacks count as unknown: profit is then the given source_profit; with all of them it is what is left of
    net_revenue, and unknown if one of them is.
    """
    have = set(df.columns)
    zero = F.lit(0).cast("decimal(18,2)")
    refund = F.coalesce(money("refund"), zero) if "refund" in have else zero
    rows = df.where(col(month).isNotNull() & (F.trim(F.coalesce(col(store).cast("string"), F.lit(""))) != ""))
    own = money("revenue") - refund
    rows = rows.select(
        F.trim(col(store).cast("string")).alias("store"), F.date_trunc("month", col(month)).cast("date").alias("month"), money("revenue").alias("revenue"), refund.cast("decimal(18,2)").alias("refund"),
        (money("net_revenue") if "net_revenue" in have else own).cast("decimal(18,2)").alias("net_revenue"), *[(money(c) if c in have else F.lit(None).cast("decimal(18,2)")).alias(c) for c in COSTS],
        (money("source_profit") if "source_profit" in have else F.lit(None).cast("decimal(18,2)")).alias("source_profit"),
    )
    left = (F.col("net_revenue") - reduce(lambda a, b: a + b, [F.col(c) for c in COSTS])).cast("decimal(18,2)")
    rows = rows.withColumn("profit", left if set(COSTS) <= have else F.col("source_profit"))
    return rows.withColumns({"profit_gap": F.col("source_profit") - left, "revenue_gap": F.col("net_revenue") - (F.col("revenue") - F.col("refund"))})


def diagnosis(df: DataFrame, store: str = "store", month: str = "month") -> dict[str, DataFrame]:
    """totals, stores, months, costs and risks of store-month results; rates are sums over sums, never means of rates."""
    rows = store_months(df, store, month)
    sums = ["revenue", "refund", "net_revenue", *COSTS, "profit"]
    totals = _rates(_known_sums(rows, [], sums))
    stores = _rates(_known_sums(rows, ["store"], sums))
    stores = add_ranks(add_ranks(stores, "profit", smallest="profit_rank"), "net_revenue", smallest="revenue_rank")
    first = lambda *by: F.min(F.struct(*by, "store"))["store"]
    down = lambda c: F.coalesce(-F.col(c).cast("double"), F.lit(float("inf")))
    marks = stores.agg(first(down("profit").alias("a"), down("margin").alias("b")).alias("best_store"), first(down("net_revenue").alias("a")).alias("largest_store"), first(F.coalesce("margin", F.lit(float("inf"))).alias("a")).alias("weakest_store"))
    stores = stores.crossJoin(F.broadcast(marks))  # one row
    verdict = F.when(F.col("store") == F.col("best_store"), "best").when((F.col("store") == F.col("largest_store")) & (F.col("store") == F.col("weakest_store")), "large_but_weak").otherwise("watch")
    stores = stores.withColumn("verdict", verdict).drop("best_store", "largest_store", "weakest_store")
    months = _rates(_known_sums(rows, ["month"], sums))
    at = Window.orderBy("month")  # a row for each month
    before = lambda c: F.lag(F.col(c).cast("double")).over(at)
    months = months.withColumns({"revenue_change": F.try_divide(F.col("revenue").cast("double"), before("revenue")) - 1, "profit_change": F.try_divide(F.col("profit").cast("double"), before("profit")) - 1, "margin_change": F.col("margin") - before("margin"), "net_change": F.try_divide(F.col("net_revenue").cast("double"), before("net_revenue")) - 1})
    costs = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cost"), F.col(c).alias("amount"), safe_div(F.col(c).cast("double"), F.col("net_revenue").cast("double")).alias("share")) for c in COSTS])).alias("r")).select("r.*")
    last = months.orderBy(F.desc("month")).limit(1).where("margin_change < -0.01").select(F.lit("P1").alias("priority"), F.lit("margin_fell").alias("risk"), F.date_format("month", "yyyy-MM").alias("subject"), F.col("margin_change").alias("value"))
    weak = stores.where("verdict = 'large_but_weak'").select(F.lit("P1").alias("priority"), F.lit("large_but_weak").alias("risk"), F.col("store").alias("subject"), F.col("margin").alias("value"))
    gaps = [totals.select(F.lit("P2").alias("priority"), F.lit(name).alias("risk"), F.lit(None).cast("string").alias("subject"), value.alias("value")) for name, value in (("delivery_profit_unknown", F.col("platform_rate")), ("details_missing", F.lit(None).cast("double")))]
    return {"primary": totals, "stores": stores, "months": months, "costs": costs, "risks": reduce(lambda a, b: a.union(b), [last, weak, *gaps]), "rows": rows}


def purchases(df: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Purchase rows in base units with what they deviate from the standard price.

    df: day, receipt, store, ingredient, quantity, unit, price, status. ingredients: ingredient, purchase_unit, base_unit, factor,
    standard_price. Exact repeats go; rows of one receipt, store, ingredient and unit that differ are conflicts and stay, marked;
    units that are neither the base nor the purchase unit with a factor go to review; counted are confirmed rows without conflict.
    """
    key = ["receipt", "store", "ingredient", "unit"]
    tidy = lambda c: F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))
    rows = df.select("day", *[F.trim(F.coalesce(col(c).cast("string"), F.lit(""))).alias(c) for c in key], "quantity", "price", "status").distinct()
    # a key's rows are distinct, so any two of them differ in what matters
    seen = rows.where("receipt <> ''").groupBy(*key).agg((F.count("*") > 1).alias("conflict"))
    rows = rows.join(seen, key, "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    master = ingredients.groupBy(F.trim("ingredient").alias("ingredient")).agg(*[F.min_by(c, F.struct("purchase_unit", "base_unit", "factor", "standard_price")).alias(c) for c in ("purchase_unit", "base_unit", "factor", "standard_price")])
    out = rows.withColumn("amount", F.col("quantity") * F.col("price")).join(master, "ingredient", "left")
    unit = tidy("unit")
    factor = F.when((unit != "") & (unit == tidy("base_unit")), F.lit(1.0)).when((unit != "") & (unit == tidy("purchase_unit")) & (F.col("factor") > 0), F.col("factor").cast("double"))
    out = out.withColumn("used_factor", factor).withColumn("base_quantity", F.col("quantity") * F.col("used_factor"))
    out = out.withColumn("base_price", F.when(F.col("base_quantity") > 0, F.col("amount") / F.col("base_quantity")))
    out = out.withColumn("deviation", F.when(F.col("standard_price") > 0, F.col("base_price") / F.col("standard_price") - 1))
    out = out.withColumn("unit_status", F.when(F.col("used_factor").isNull(), "review").otherwise("converted")).withColumn("receipt_status", B.receipt_status("status"))
    return out.withColumn("counted", (F.col("receipt_status") == "confirmed") & ~F.col("conflict"))


#: Fixed value: labels that tell of trouble.
TROUBLE = "投诉|差评|食品|卫生|慢"
#: The same in English.
TROUBLE_ENGLISH = "complaint|hygiene|slow"


def reviews_with_refunds(reviews: DataFrame, refunds: DataFrame) -> DataFrame:
    """Reviews (day, store, order_no, score, label, text) with their order's confirmed refunds, and refunds that no review belongs to.

    refunds: order_no, amount, kind, reason, owner, status. attention: a score below 4, or a label that tells of trouble.
    """
    back = dealt(refunds.where(B.refund_status("status") == "confirmed"), "order_no")
    texts = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.trim(c) != "", F.trim(c)))), "; ").alias(c)
    per = back.groupBy("order_no").agg(F.sum(money("amount")).alias("refund"), *[texts(c) for c in ("kind", "reason", "owner")])
    marked = dealt(reviews, "order_no").withColumns({"attention": F.coalesce((F.col("score") < 4) | F.col("label").rlike(f"{TROUBLE}|{TROUBLE_ENGLISH}"), F.lit(False)), "_seen": F.lit(True)})
    met = marked.join(per, "order_no", "full").withColumn("record", F.when(F.col("_seen"), "review").otherwise("lone_refund"))
    match = F.when(F.col("_seen").isNull(), "no_review").when(F.col("refund").isNotNull(), "matched").otherwise("no_refund")
    return met.withColumn("match", match).drop("_seen")
