"""Receivables, budgets, cash flow, ratios and journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import col, money, month_text

BUCKETS = (30, 60, 90)


def aging_bucket(days: Column, buckets: tuple[int, ...] = BUCKETS) -> Column:
    out = F.when(days.isNull(), "invalid_date").when(days <= 0, "not_due")
    low = 1
    for b in buckets:
        out = out.when(days <= b, f"{low}-{b}")
        low = b + 1
    return out.otherwise(f">{buckets[-1]}")


def bucket_names(buckets: tuple[int, ...] = BUCKETS) -> list[str]:
    lows = (1, *[b + 1 for b in buckets[:-1]])
    return ["not_due", *[f"{a}-{b}" for a, b in zip(lows, buckets)], f">{buckets[-1]}", "invalid_date"]


def ar_aging(df: DataFrame, party: str, due: str, amount: str, paid: str, as_of: str, buckets: tuple[int, ...] = BUCKETS) -> dict[str, DataFrame]:
    """detail (open items with days and bucket), buckets (all of them, in order), parties (one column for each bucket)."""
    zero = F.lit(0).cast("decimal(18,2)")
    owed = F.greatest(F.coalesce(money(amount), zero) - F.coalesce(money(paid), zero), zero)
    days = F.datediff(F.lit(as_of).cast("date"), col(due).cast("date"))
    detail = df.withColumn("outstanding", owed).withColumn("days_overdue", days).withColumn("bucket", aging_bucket(F.col("days_overdue"), buckets)).where("outstanding > 0")
    names = bucket_names(buckets)
    spine = df.sparkSession.createDataFrame(list(enumerate(names)), "position int, bucket string")
    sums = detail.groupBy("bucket").agg(F.count("*").alias("items"), F.sum("outstanding").alias("outstanding"))
    summary = F.broadcast(spine).join(sums, "bucket", "left").select("position", "bucket", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("outstanding", F.lit(0)).cast("decimal(28,2)").alias("outstanding"))
    parties = detail.groupBy(party).pivot("bucket", names).agg(F.sum("outstanding")).fillna(0)
    return {"detail": detail, "buckets": summary, "parties": parties.withColumn("total", sum((F.col(f"`{n}`") for n in names), F.lit(0)))}


def budget_variance(df: DataFrame, by: list[str], actual: str, budget: str, view: str = "cost") -> DataFrame:
    """Difference, rate over abs(budget), and whether it is favourable: below budget for costs, above for revenue."""
    g = df.groupBy(*by).agg(F.sum(money(actual)).alias("actual"), F.sum(money(budget)).alias("budget"))
    d = F.col("actual") - F.col("budget")
    good = d <= 0 if view == "cost" else d >= 0
    return g.withColumn("variance", d).withColumn("variance_rate", F.try_divide(d.cast("double"), F.abs(F.col("budget")).cast("double"))).withColumn("favourable", good)


def cash_flow(df: DataFrame, date: str, direction: str, category: str, amount: str, inflow: list[str], outflow: list[str]) -> dict[str, DataFrame]:
    """Signed net by month with its running sum, and by category; unknown directions give null and count as unknown."""
    text = F.lower(F.trim(col(direction).cast("string")))
    net = F.when(text.isin(*[x.lower() for x in inflow]), F.abs(money(amount))).when(text.isin(*[x.lower() for x in outflow]), -F.abs(money(amount)))
    rows = df.withColumn("net", net)
    parts = [F.sum(F.greatest(F.col("net"), F.lit(0).cast("decimal(18,2)"))).alias("inflow"), (-F.sum(F.least(F.col("net"), F.lit(0).cast("decimal(18,2)")))).alias("outflow"), F.sum("net").alias("net"), F.count_if(F.col("net").isNull()).alias("unknown")]
    monthly = rows.groupBy(month_text(date).alias("month")).agg(*parts)
    monthly = monthly.withColumn("cumulative", F.sum("net").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))
    return {"monthly": monthly, "categories": rows.groupBy(category).agg(*parts), "detail": rows}


#: name -> (numerator, denominator); each side is a signed list of statement lines.
RATIOS = {
    "gross_margin": ("revenue-cost", "revenue"), "net_margin": ("net_profit", "revenue"), "current_ratio": ("current_assets", "current_liabilities"),
    "quick_ratio": ("current_assets-inventory", "current_liabilities"), "debt_ratio": ("total_liabilities", "total_assets"), "return_on_assets": ("net_profit", "total_assets"),
    "return_on_equity": ("net_profit", "equity"), "asset_turnover": ("revenue", "total_assets"), "inventory_turnover": ("cost", "inventory"), "expense_ratio": ("expenses", "revenue"),
}


def financial_ratios(df: DataFrame, key: list[str]) -> dict[str, DataFrame]:
    """wide and long; a ratio whose lines are absent is left out, a zero denominator gives null."""

    def side(text: str) -> Column | None:
        plus, *minus = text.split("-")
        if any(x not in df.columns for x in (plus, *minus)):
            return None
        out = col(plus).cast("double")
        for m in minus:
            out = out - col(m).cast("double")
        return out

    made = {n: F.try_divide(side(a), side(b)) for n, (a, b) in RATIOS.items() if side(a) is not None and side(b) is not None}
    wide = df.select(*key, *[v.alias(n) for n, v in made.items()])
    return {"wide": wide, "long": wide.unpivot(key, list(made), "ratio", "value")}


def journal_audit(df: DataFrame, voucher: str, debit: str, credit: str, tolerance: float = 0.01) -> dict[str, DataFrame]:
    """vouchers with totals and balance; lines with both or neither side, or a negative one."""
    zero = F.lit(0).cast("decimal(18,2)")
    d, c = F.coalesce(money(debit), zero), F.coalesce(money(credit), zero)
    v = df.groupBy(voucher).agg(F.sum(d).alias("debit"), F.sum(c).alias("credit"), F.count("*").alias("lines")).withColumn("difference", F.col("debit") - F.col("credit"))
    issue = F.when((d != 0) & (c != 0), "both_sides").when((d == 0) & (c == 0), "no_amount").when((d < 0) | (c < 0), "negative")
    return {"vouchers": v.withColumn("balanced", F.abs(F.col("difference")) <= F.lit(tolerance).cast("decimal(18,4)")), "lines": df.withColumn("issue", issue).where("issue is not null")}
