"""Sales overview, rankings, rows that need attention; union of periods with differing headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import col, money, month_text, parse_date, parse_number, safe_div
from tabloom.operators.dedup import most_complete
from tabloom.operators.order import Outputs, add_ranks, number_rows
from tabloom.operators.quantiles import quantiles


def overview(df: DataFrame, sales: str, cost: str, quantity: str) -> DataFrame:
    out = df.agg(F.count("*").alias("rows"), F.sum(money(sales)).alias("sales"), F.sum(money(cost)).alias("cost"), F.sum(quantity).alias("quantity"))
    return out.withColumn("profit", F.col("sales") - F.col("cost")).withColumn("margin", safe_div(F.col("profit").cast("double"), F.col("sales").cast("double")))


def ranking(df: DataFrame, by: str, sales: str, cost: str) -> DataFrame:
    """One row for each member: sales, cost, profit, margin, share and rank."""
    g = df.groupBy(by).agg(F.sum(money(sales)).alias("sales"), F.sum(money(cost)).alias("cost"), F.count("*").alias("rows"))
    g = g.withColumn("profit", F.col("sales") - F.col("cost")).withColumn("margin", safe_div(F.col("profit").cast("double"), F.col("sales").cast("double")))
    total = g.agg(F.sum(F.col("sales").cast("double")).alias("_total"))
    g = g.crossJoin(F.broadcast(total)).withColumn("share", safe_div(F.col("sales").cast("double"), F.col("_total"))).drop("_total")
    return add_ranks(g, "sales", smallest="rank")


def attention(df: DataFrame, sales: str, cost: str, satisfaction: str | None = None, low: float = 3.0, factor: float = 1.5) -> DataFrame:
    """Rows with reasons: no or low satisfaction, a loss, sales above the upper fence."""
    x = col(sales).cast("double")
    q = quantiles(df, [sales], (0.25, 0.75))
    fence = q.agg(F.max(F.col("q")[1] + factor * (F.col("q")[1] - F.col("q")[0])).alias("_fence"))  # one row
    why = [F.when(col(sales) < col(cost), "loss"), F.when(x > F.col("_fence"), "high_sales")]
    if satisfaction:
        why = [F.when(col(satisfaction).isNull(), "no_satisfaction"), F.when(col(satisfaction) < low, "low_satisfaction"), *why]
    return df.crossJoin(F.broadcast(fence)).withColumn("attention", F.concat_ws("; ", *why)).drop("_fence").where("attention <> ''")


def sales_report(df: DataFrame, date: str, product: str, seller: str, region: str, quantity: str, sales: str, cost: str, satisfaction: str | None = None) -> Outputs:
    return Outputs({
        "primary": lambda: overview(df, sales, cost, quantity), "products": lambda: ranking(df, product, sales, cost), "sellers": lambda: ranking(df, seller, sales, cost),
        "attention": lambda: attention(df, sales, cost, satisfaction), "series": lambda: df.groupBy(month_text(date).alias("month"), region).agg(F.sum(money(sales)).alias("sales")),
    })


STANDARD = ("order_id", "date", "product", "seller", "region", "quantity", "sales", "cost", "status")


def standardise(frames: dict[str, DataFrame], aliases: dict[str, list[str]]) -> DataFrame:
    """Tables with differing headers as one: each standard column from the first alias a table has; texts are parsed."""
    from tabloom.operators.relational import union_tables

    made = {}
    for name, df in frames.items():
        pick = {s: next((c for c in df.columns if c.strip().lower() in {s, *[a.lower() for a in aliases.get(s, [])]}), None) for s in STANDARD}
        made[name] = df.select(*[(col(c).cast("string") if c else F.lit(None).cast("string")).alias(s) for s, c in pick.items()])
    out = union_tables(made, "outer", "source")
    numbers = {c: parse_number(c) for c in ("quantity", "sales", "cost")}
    return out.withColumns(numbers).withColumn("date", parse_date("date"))


def quarterly_report(frames: dict[str, DataFrame], aliases: dict[str, list[str]], dropped: tuple[str, ...] = ("cancelled", "refunded")) -> Outputs:
    """Unified, deduplicated by order (the most complete row stays), invalid rows set apart with reasons, then the sales report."""
    rows = standardise(frames, aliases)
    keyed = rows.where("trim(coalesce(order_id, '')) <> ''")
    one = most_complete(keyed, "order_id", ["date", "product", "seller", "region", "quantity", "sales", "cost"], ["source", "date", "sales"]).unionByName(rows.where("trim(coalesce(order_id, '')) = ''"))
    why = F.concat_ws("; ", F.when(F.trim(F.coalesce("order_id", F.lit(""))) == "", "no_order"), F.when(F.col("date").isNull(), "bad_date"), F.when(F.col("sales").isNull(), "bad_sales"), F.when(F.lower(F.trim("status")).isin(*dropped), "status"))
    marked = one.withColumn("reason", why)
    good = marked.where("reason = ''").drop("reason")
    own = {"regions": lambda: ranking(good, "region", "sales", "cost"), "invalid": lambda: marked.where("reason <> ''"), "clean": lambda: good}
    return Outputs({**sales_report(good, "date", "product", "seller", "region", "quantity", "sales", "cost").makers, **own})


def order_summary(orders: DataFrame, group: str, order: str, paid: str, refund: str, target: DataFrame | None = None) -> DataFrame:
    """Orders, sales, value of an order, refund rate and target attainment of each group."""
    g = orders.groupBy(group).agg(F.count_distinct(order).alias("orders"), F.sum(money(paid)).alias("sales"), F.sum(F.coalesce(money(refund), F.lit(0).cast("decimal(18,2)"))).alias("refunds"))
    g = g.withColumn("order_value", safe_div(F.col("sales").cast("double"), F.col("orders").cast("double"))).withColumn("refund_rate", safe_div(F.col("refunds").cast("double"), F.col("sales").cast("double")))
    if target is not None:
        g = g.join(target, group, "left").withColumn("attainment", safe_div(F.col("sales").cast("double"), F.col("target").cast("double")))
    return g


def order_analysis(lines: DataFrame, order: str, line: str, amount: str, discount: str, refund: str, store: str, product: str, date: str) -> dict[str, DataFrame]:
    """Order-level discount and refund (the same on all lines of an order) are allocated to lines by amount, then summed by store, product and day; checks tie the sums together."""
    from tabloom.operators.aggregate import allocate_largest_remainder

    out = allocate_largest_remainder(lines, [order], discount, amount, [line], "line_discount")
    out = allocate_largest_remainder(out, [order], refund, amount, [line], "line_refund").withColumn("net", money(amount) - F.col("line_discount") - F.col("line_refund"))
    # lines lie by order already, so what is summed by order is not shuffled, and what is left by key shrinks before it is
    got = [F.sum(money(amount)).alias("sales"), F.sum("line_discount").alias("discount"), F.sum("line_refund").alias("refund"), F.sum("net").alias("net")]

    def sums(by: Column) -> DataFrame:
        name, key = out.select(by).columns[0], by
        per = out.groupBy(F.col(order).alias("_order"), key.alias("_key")).agg(*got)
        whole = [F.sum(n).cast(f"decimal({28 if n != 'net' else 30},2)").alias(n) for n in ("sales", "discount", "refund", "net")]
        return per.groupBy(F.col("_key").alias(name)).agg(F.count("_order").alias("orders"), *whole)

    heads = out.groupBy(order).agg(F.max(money(discount)).alias("d"), F.max(money(refund)).alias("r"), F.sum(money(amount)).alias("a"), F.sum("line_discount").alias("gd"), F.sum("line_refund").alias("gr"))
    owed = lambda c: F.sum(F.when(F.col("a") > 0, F.col(c)))
    checks = heads.agg((owed("d") == F.sum("gd")).alias("discount_ties"), (owed("r") == F.sum("gr")).alias("refund_ties"))
    return {"primary": out, "stores": sums(col(store)), "products": sums(col(product)), "days": sums(col(date).cast("date").alias("day")), "checks": checks}


#: What comments give away of an entry, and the points that it costs or earns.
SEVERE = (
    ("重复/疑似重复", r"(?:与|和)\s*\d+\s*(?:组|号)?.{0,3}重复|重复稿|稿件重复|内容重复|雷同|抄袭|剽窃", 12.0),
    ("诚信或有效性风险", r"作弊|造假|无效|取消资格|不合格", 12.0),
    ("核心结果错误", r"(?:核心|主要|关键)(?:模型|结论|结果|程序).{0,6}(?:错误|有误|不可信|偏离|缺陷)|(?:结论|结果|模型|程序).{0,4}(?:错误|有误|不可信|偏离|重大缺陷)", 8.0),
    ("态度/完成质量严重风险", r"态度.{0,6}(?:问题|不端正)|完成很差|极度不端正|来搞笑", 8.0),
    ("直接判定为纯AI", r"纯\s*ai", 6.0),
)
MODERATE = (
    ("明显AI痕迹", r"ai.{0,6}(?:痕迹|嫌疑|撰写)|全文ai|怀疑全文ai", 1.5),
    ("内容或论证不足", r"内容.{0,5}(?:缺失|偏少|不足)|分析.{0,6}(?:浅|少|不足)|论证.{0,5}不足", 1.0),
    ("严重格式/可读性问题", r"格式问题很大|排版差|看不清|字号偏小", 0.75),
)
POSITIVE = (
    ("主要结果合理", r"主要结果.{0,8}合理|结果总体合理|关键结果.{0,8}合理", 2.5),
    ("完成度较高", r"完成度较高|完成情况很好|结构完整|质量较好", 1.5),
)


def selection(df: DataFrame, entry: str, scores: list[str], comments: list[str] = (), penalties=SEVERE + MODERATE, bonuses=POSITIVE, top: int = 8, source_order: str | None = None) -> DataFrame:
    """Entries ranked by 0.7 mean + 0.3 latest score of 100, less penalties (30 at most) and 5 times the share of missing rounds, plus bonuses (5 at most).

    Each column of scores is brought to 100 by its own range: up to 1.05 times 100, to 5.05 times 20, to 10.05 times 10, else as it is, and so where
    it has negative ones. penalties and bonuses: (label, pattern, points). Ties go to the latest score, the mean, the number of rounds and then
    the order of the source (source_order; the entry, if not given). Entries without any score come last and are never selected.
    """
    ends = df.agg(*[f(col(s).cast("double")).alias(f"_{n}{i}") for i, s in enumerate(scores) for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    df = df.crossJoin(F.broadcast(ends))
    made = []
    for i, s in enumerate(scores):
        fits = lambda most, i=i: (F.col(f"_lo{i}") >= 0) & (F.col(f"_hi{i}") <= most)
        made.append(col(s).cast("double") * F.when(fits(1.05), 100.0).when(fits(5.05), 20.0).when(fits(10.05), 10.0).otherwise(1.0))
    df = df.withColumn("_scores", F.array_compact(F.array(*made)))
    rounds = F.size("_scores")
    mean = F.try_divide(F.aggregate("_scores", F.lit(0.0), lambda a, x: a + x), rounds)
    first, latest = (F.when(rounds > 0, F.element_at("_scores", i)) for i in (1, -1))
    said = [F.trim(F.regexp_replace(col(c).cast("string"), r"\s+", " ")) for c in comments]
    df = df.withColumn("_text", F.concat_ws("；", *[F.when(x != "", F.substring(x, 1, 1000)) for x in said]) if comments else F.lit(""))
    hit = lambda pattern: F.col("_text").rlike(f"(?iu){pattern}")
    points = lambda rules, most: F.least(F.lit(most), sum((F.when(hit(p), F.lit(float(w))).otherwise(0.0) for _, p, w in rules), F.lit(0.0)))
    names = lambda rules: F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(hit(p), F.lit(n)) for n, p, _ in rules]))), "、") if rules else F.lit("")
    df = df.withColumns({"mean": mean, "latest": latest, "trend": latest - first, "rounds": rounds, "coverage": rounds / F.lit(float(len(scores))), "penalty": points(penalties, 30.0), "bonus": points(bonuses, 5.0), "risks": names(penalties), "merits": names(bonuses)})
    base = 0.7 * F.col("mean") + 0.3 * F.col("latest")
    df = df.withColumn("score", F.round(base - F.col("penalty") - (1 - F.col("coverage")) * 5.0 + F.col("bonus"), 8))
    df = df.withColumn("risk", F.when((F.col("penalty") >= 12) | (F.col("rounds") == 0), "high").when(F.col("penalty") >= 4, "medium").otherwise("low"))
    order = [F.col("score").desc_nulls_last(), F.col("latest").desc_nulls_last(), F.col("mean").desc_nulls_last(), F.desc("rounds"), col(source_order or entry).asc()]
    out = number_rows(df, order, "_at").withColumn("position", F.col("_at") + 1)
    return out.withColumn("selected", (F.col("position") <= top) & F.col("score").isNotNull()).drop("_scores", "_text", "_at", *ends.columns)
