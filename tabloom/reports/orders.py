"""Order lines to results: what was left out and why, allocated refunds, stores, products, days, and the checks that tie them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import business as B
from tabloom.functions.expressions import col
from tabloom.operators.aggregate import allocate_largest_remainder
from tabloom.operators.dedup import unique_master
from tabloom.operators.order import Outputs, written_once
from tabloom.operators.quantiles import quantiles

CENTS = "decimal(18,2)"
#: Reasons that a person has to look at; the others are left out by rule.
REVIEW = ("unknown_store", "unknown_product", "unknown_status", "bad_date")


def _text(c: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"\s+", " "))


def _store_names(targets: DataFrame) -> DataFrame:
    """(_key, store, target) of keys that one store has; a key of two stores names none, two targets of one store are an error."""
    per = targets.select(B.store_key("store").alias("_key"), _text("store").alias("store"), col("target").cast(CENTS).alias("target")).groupBy("_key").agg(F.count_distinct("store").alias("_n"), F.min("store").alias("store"), F.min("target").alias("target"), F.max("target").alias("_other"))
    from tabloom.operators.relational import OperatorError

    if not per.where("_n = 1 and target <> _other").isEmpty():
        raise OperatorError("a store has two targets")
    return per.where("_n = 1").drop("_n", "_other")


def order_analysis(lines: DataFrame, products: DataFrame, refunds: DataFrame | None = None, targets: DataFrame | None = None, low_margin: float = 0.2) -> Outputs:
    """lines: order_id, store, product, quantity, price, discount, status, day. products: product (unique), name, category, cost. refunds: order_id, amount, status. targets: store, target.

    lines (valid ones: sales, discount, refund, net, cost, margin), excluded (the first rule that each line breaks, in the order status, store, product, quantity, price, date;
    and repeats of whole rows), review, stores, products, days, warnings (quantities and prices beyond 1.5 iqr, which stay in), waterfall (rows from all to valid, a
    row for each reason) and checks (seven ties, all from one pass over the marked lines and one over the results).
    An order's confirmed refunds are allocated to its valid lines by what was paid, in whole cents.
    """
    from tabloom.operators.relational import OperatorError

    master = unique_master(products.withColumn("product", F.upper(_text("product"))), ["product"]).select("product", F.col("name").alias("_name"), "category", col("cost").cast("decimal(18,4)").alias("_cost"))
    rows = lines.withColumns({c: _text(c) for c in ("store", "status")}).withColumns({"order_id": F.upper(_text("order_id")), "product": F.upper(_text("product")), "quantity": col("quantity").cast("decimal(18,4)"), "price": col("price").cast("decimal(18,4)"), "discount": col("discount").cast(CENTS), "day": col("day").try_cast("date")})
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies"))
    if targets is None:
        rows = rows.withColumn("_store", F.when(F.col("store") != "", F.col("store"))).withColumn("target", F.lit(None).cast(CENTS))
    else:
        names = _store_names(targets).withColumnRenamed("store", "_store")
        rows = rows.join(names, B.store_key("store") == F.col("_key"), "left").drop("_key")
    rows = rows.join(master, "product", "left")
    kind = B.order_status("status")
    rules = [(kind == "invalid", "invalid_status"), (kind != "success", "unknown_status"), (F.col("_store").isNull(), "unknown_store"), (F.col("_name").isNull(), "unknown_product"), (F.coalesce(F.col("quantity") <= 0, F.lit(True)), "bad_quantity"), (F.coalesce(F.col("price") <= 0, F.lit(True)), "bad_price"), (F.col("day").isNull(), "bad_date")]
    rows = written_once(rows.withColumn("reason", F.coalesce(*[F.when(r, F.lit(w)) for r, w in rules])))
    valid = rows.where("reason is null")
    sales = F.round(F.col("quantity") * F.col("price"), 2).cast(CENTS)
    valid = valid.withColumn("sales", sales).withColumn("paid", (F.col("sales") - F.col("discount")).cast(CENTS)).withColumn("cost", F.round(F.col("quantity") * F.col("_cost"), 2).cast(CENTS))
    if not valid.where("discount is null or discount < 0 or paid < 0 or _cost is null").isEmpty():
        raise OperatorError("a discount is missing, negative or above the sales of its line, or a product has no cost")
    if refunds is not None:
        back = refunds.where(B.refund_status("status") == "confirmed").groupBy(F.upper(_text("order_id")).alias("order_id")).agg(F.sum(col("amount").cast(CENTS)).cast(CENTS).alias("_back"))
    else:
        back = valid.select("order_id", F.lit(0).cast(CENTS).alias("_back")).limit(0)
    order = ["product", "_store", "day", "quantity", "price", "discount", "status", "store"]
    made = valid.join(back, "order_id", "left").withColumn("_back", F.coalesce("_back", F.lit(0)).cast(CENTS))
    made = allocate_largest_remainder(made, ["order_id"], "_back", "paid", order, "refund").withColumn("net", (F.col("paid") - F.col("refund")).cast(CENTS)).withColumn("margin", (F.col("net") - F.col("cost")).cast(CENTS))
    made = written_once(made.withColumn("store", F.col("_store")).withColumnRenamed("_name", "name").drop("_store", "_cost", "reason"))
    parts = ("sales", "discount", "refund", "net", "cost", "margin")
    rate = lambda a, b: F.when(F.col(b) != 0, F.col(a).cast("double") / F.col(b).cast("double"))

    def by(*keys: str, more: dict | None = None) -> DataFrame:
        out = made.groupBy(*keys).agg(*[F.sum(c).cast(CENTS).alias(c) for c in parts], F.count_distinct("order_id").alias("orders"), *[f.alias(n) for n, f in (more or {}).items()])
        return out.withColumn("margin_rate", rate("margin", "net"))

    def stores() -> DataFrame:
        out = by("store", more={"target": F.first("target")})
        return out.withColumns({"attainment": rate("net", "target"), "order_value": rate("net", "orders"), "refund_rate": rate("refund", "sales")})

    def items() -> DataFrame:
        return by("product", "name", "category", more={"quantity": F.sum("quantity")}).withColumn("low_margin", F.coalesce(F.col("margin_rate") < low_margin, F.lit(False)))

    def warnings() -> DataFrame:
        q = quantiles(made, ["quantity", "price"], (0.25, 0.75)).where("n >= 4 and q[1] > q[0]")
        q = q.select("column_name", (F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("low"), (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("high"))
        long = made.select("order_id", "store", "product", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in ("quantity", "price")])).alias("_p")).select("order_id", "store", "product", "_p.*")
        return long.join(F.broadcast(q), "column_name").where("value < low or value > high")  # a row for each of two columns

    def excluded() -> DataFrame:
        names = ["order_id", "store", "product", "quantity", "price", "discount", "status", "day"]
        bad = rows.where("reason is not null").select(*names, "reason", F.lit(1).cast("long").alias("rows"))
        return bad.union(rows.where("_copies > 1").select(*names, F.lit("copy"), F.col("_copies") - 1))

    def waterfall() -> DataFrame:
        steps = [("all", F.col("_copies")), ("copy", F.when(F.col("_copies") > 1, F.col("_copies") - 1)), *[(w, F.when(F.col("reason") == w, 1)) for _, w in rules], ("valid", F.when(F.col("reason").isNull(), 1))]
        sums = rows.agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(n) for n, v in steps])
        return sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(n).alias("rows")) for i, (n, _) in enumerate(steps)])).alias("_s")).select("_s.*")

    def checks() -> DataFrame:
        total = rows.agg(F.sum("_copies").alias("raw"), F.count("*").alias("distinct_rows"), F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("copies"), F.count("reason").alias("bad"))
        got = made.agg(F.count("*").alias("good"), F.coalesce(F.sum("refund"), F.lit(0)).alias("refund"), F.count("name").alias("named"), F.count("store").alias("placed"), F.coalesce(F.sum("net"), F.lit(0)).alias("net"), F.coalesce(F.sum("margin"), F.lit(0)).alias("margin"))
        owed = made.groupBy("order_id").agg(F.first("_back").alias("_back"), F.sum("paid").alias("paid")).where("paid > 0").agg(F.coalesce(F.sum("_back"), F.lit(0)).alias("owed"))
        shops = by("store").agg(F.coalesce(F.sum("net"), F.lit(0)).alias("shops"))
        one = total.crossJoin(F.broadcast(got)).crossJoin(F.broadcast(owed)).crossJoin(F.broadcast(shops))  # one row each
        ties = {"refunds": F.col("refund") == F.col("owed"), "rows": F.col("raw") == F.col("distinct_rows") + F.col("copies"), "split": F.col("distinct_rows") == F.col("good") + F.col("bad"), "products": F.col("named") == F.col("good"), "stores": F.col("placed") == F.col("good"), "totals": F.col("net") == F.col("shops"), "indicators": F.col("net").isNotNull() & (F.col("net") != 0)}
        return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for n, v in ties.items()])).alias("_c")).select("_c.*")

    return Outputs({"primary": lambda: made, "excluded": excluded, "review": lambda: excluded().where(F.col("reason").isin(*REVIEW)), "stores": stores, "products": items, "days": lambda: by("day"), "warnings": warnings, "waterfall": waterfall, "checks": checks})
