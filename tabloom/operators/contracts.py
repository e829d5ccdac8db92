"""Metric contracts: whether a column may be summed up, how, over which rows, and what the result is; which questions contracts answer."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import col, is_missing, parse_number

from .aggregate import weighted_ratio
from .relational import OperatorError, require_columns

#: Names of ratios, and the columns that their numerator and denominator are looked for in, in this order.
RATIO_RULES = (
    ("管理利润率|经营利润率|净利润率|利润率", ("管理利润", "经营利润", "净利润", "利润"), ("净营业收入", "营业收入", "销售额", "收入")),
    ("毛利率", ("毛利", "毛利润"), ("净营业收入", "营业收入", "销售额", "收入")),
    ("退款率", ("退款金额", "退款"), ("营业额", "销售额", "收入", "实付")),
    ("平台.*费率|平台费率", ("平台费", "平台费用", "佣金"), ("净营业收入", "营业额", "销售额", "收入")),
    ("人工.*率|人工成本率", ("人工成本", "工资成本", "人工费用"), ("净营业收入", "营业额", "销售额", "收入")),
    ("食材.*率|食材成本率", ("食材成本", "原料成本", "材料成本"), ("净营业收入", "营业额", "销售额", "收入")),
    ("成本率", ("成本",), ("净营业收入", "营业额", "销售额", "收入")),
    ("回款率|到账率", ("回款金额", "实际到账", "到账金额"), ("销售额", "营业额", "结算基数", "收入")),
    ("完成率", ("完成数量", "完成额", "实际"), ("目标数量", "目标额", "目标")),
    ("转化率", ("转化数", "成交数", "订单数"), ("访问数", "流量", "线索数")),
)
#: Topics of questions and the names of metrics that speak to them.
#: What tells a question's topic from a field's name.
TOPICS = {
    "profitability": r"利润|毛利|profit|margin", "cash": r"现金|回款|到账|应收|cash|receivable", "inventory": r"库存|stock|inventory", "customer": r"满意度|评价|退款|评分|rating|refund",
    "workforce": r"绩效|工资|薪资|工时|加班|salary|hours", "procurement": r"采购|入库|purchase", "channel": r"销售|收入|费用|sales|revenue|expense",
}
AGGREGATIONS = ("sum", "mean", "last", "weighted_ratio")


def ratio_components(metric: str, columns: list[str], rules=RATIO_RULES) -> tuple[str, str] | None:
    """Numerator and denominator of a ratio by its name: a column that is called so, else the only one that holds the name."""
    others = [c for c in columns if c != metric]
    tidy = {re.sub(r"[\s_]+", "", c).lower(): c for c in others}

    def find(wanted):
        exact = next((tidy[w.lower()] for w in wanted if w.lower() in tidy), None)
        if exact:
            return exact
        held = ([c for k, c in tidy.items() if w.lower() in k] for w in wanted)
        return next((h[0] for h in held if len(h) == 1), None)

    for pattern, top, bottom in rules:
        if re.search(pattern, metric, re.I) and (a := find(top)) and (b := find(bottom)) and a != b:
            return a, b
    return None


def ratio_by_name(df: DataFrame, metric: str, by: list[str], rules=RATIO_RULES) -> DataFrame:
    """The ratio that a column's name means, as sum over sum for each group; an error where its parts are not to be found."""
    parts = ratio_components(metric, df.columns, rules)
    if parts is None:
        raise OperatorError(f"no single numerator and denominator for {metric}")
    return weighted_ratio(df, by, *parts, name=metric)


def candidate_grain(df: DataFrame, keys: list[str], most: int = 3) -> list[str]:
    """The first of the smallest sets of at most `most` columns (of the first eight) that is never missing and never repeats; [] if none is."""
    sets = [s for n in range(1, most + 1) for s in combinations(keys[:8], n)]
    if not sets:
        return []
    whole = lambda s: reduce(lambda a, b: a & b, [~is_missing(c) for c in s])
    tests = [((F.count_if(whole(s)) == F.count("*")) & (F.count_distinct(F.struct(*s)) == F.count("*"))).alias(f"s{i}") for i, s in enumerate(sets)]
    row = df.agg(*tests).first()
    return next((list(s) for s, good in zip(sets, row) if good), [])


#: Fixed value: names of unit prices and means, which no sum makes sense of.
UNIT_VALUES = r"单价|平均|周转天数|库存天数|每单|每人|unit.?price|average|per.?unit"


def metric_contract(df: DataFrame, field: str, aggregation: str, unit: str = "", date: str | None = None, currency: str | None = None, keys: list[str] = (), entity: list[str] = (), numerator: str | None = None, denominator: str | None = None) -> dict:
    """{field, aggregation, unit, date, grain, rows, valid, status, issues, ...}: status is unavailable if anything speaks against the metric.

    Issues: INCOMPLETE (missing or unreadable values are not read as 0), DUPLICATE_ROWS, PERCENT (a percent sign outside ratios),
    CURRENCIES (several, or undeclared, in the currency column), DATES (missing ones), UNIT_VALUE (unit prices and means are not
    summed), COMPONENTS (a ratio without numerator and denominator, or with incomplete ones, or a denominator of 0 or less in
    sum), NO_DATE (a balance without a date).
    """
    require_columns(df, field, *filter(None, [date, currency, numerator, denominator]), *keys, *entity)
    if aggregation not in AGGREGATIONS:
        raise OperatorError(f"unknown aggregation: {aggregation}")
    ratio = aggregation == "weighted_ratio"
    if ratio and not (numerator and denominator):
        numerator, denominator = ratio_components(field, df.columns) or (None, None)
    value = parse_number(field, percent=ratio)
    aggs = [F.count("*").alias("rows"), F.count(value).alias("valid"), F.count_if(col(field).cast("string").rlike("[%％]")).alias("percent")]
    aggs += [(F.count_if(is_missing(date)) if date else F.lit(0)).cast("long").alias("undated")]
    aggs += [(F.count_distinct(F.upper(F.trim(currency))) if currency else F.lit(1)).alias("currencies"), (F.count_if(is_missing(currency)) if currency else F.lit(0)).cast("long").alias("undeclared")]
    parts = [parse_number(c, percent=False) for c in (numerator, denominator)] if ratio and numerator else []
    aggs += [F.count(p).alias(f"p{i}") for i, p in enumerate(parts)] + ([F.sum(parts[1]).alias("bottom")] if parts else [])
    r = df.agg(*aggs).first()
    repeats = df.groupBy(*df.columns).count().where("count > 1")
    tests = {
        "INCOMPLETE": r.valid < r.rows, "DUPLICATE_ROWS": not repeats.isEmpty(), "PERCENT": not ratio and r.percent > 0, "CURRENCIES": r.currencies > 1 or r.undeclared > 0, "DATES": r.undated > 0,
        "UNIT_VALUE": aggregation == "sum" and bool(re.search(UNIT_VALUES, field, re.I)),
        "COMPONENTS": ratio and (not parts or r.p0 < r.rows or r.p1 < r.rows or not r.bottom or r.bottom <= 0), "NO_DATE": aggregation == "last" and not date,
    }
    issues = [k for k, bad in tests.items() if bad]
    return {"field": field, "aggregation": aggregation, "unit": unit, "date": date, "grain": candidate_grain(df, list(keys)), "entity": list(entity), "numerator": numerator, "denominator": denominator, "rows": r.rows, "valid": r.valid, "status": "unavailable" if issues else "confirmed" if unit else "inferred", "issues": issues}


def evaluate_metric(df: DataFrame, contract: dict) -> DataFrame:
    """One row (value, note): the metric by its contract; null with its issues if it is unavailable.

    A balance is the sum over its entities at the latest date, null unless each of them is there exactly once.
    """
    if contract["status"] == "unavailable":
        return df.sparkSession.createDataFrame([(None, "; ".join(contract["issues"]))], "value double, note string")
    how, field = contract["aggregation"], contract["field"]
    if how == "weighted_ratio":
        out = df.agg(F.try_divide(*[F.sum(parse_number(contract[c], percent=False)).cast("double") for c in ("numerator", "denominator")]).alias("value"))
    elif how in ("sum", "mean"):
        out = df.agg((F.sum if how == "sum" else F.avg)(parse_number(field, percent=False)).cast("double").alias("value"))
    else:
        who = [col(c) for c in contract["entity"]] or [F.lit(1)]
        top = df.agg(F.max(contract["date"]).alias("_top"))
        last = df.crossJoin(F.broadcast(top)).withColumn("_now", col(contract["date"]) == F.col("_top"))  # one row
        out = last.agg(F.sum(F.when(F.col("_now"), parse_number(field, percent=False))).alias("v"), F.count_if("_now").alias("n"), F.count_distinct(F.when(F.col("_now"), F.struct(*who))).alias("k"), F.count_distinct(F.struct(*who)).alias("every"))
        out = out.select(F.when((F.col("n") == F.col("k")) & (F.col("k") == F.col("every")), F.col("v").cast("double")).alias("value"))
    return out.withColumn("note", F.lit(how))


def question_evidence(topics: list[str], contracts: list[dict]) -> list[dict]:
    """For each topic the fields of contracts that speak to it: available, partial (profit and stock need what no single field tells) or unavailable."""
    usable = [c for c in contracts if c["status"] != "unavailable"]
    out = []
    for t in topics:
        fields = [c["field"] for c in usable if (c["date"] if t == "trend" else re.search(TOPICS.get(t, "."), c["field"], re.I))]
        status = "unavailable" if not fields else "partial" if t in ("profitability", "inventory") else "available"
        out.append({"topic": t, "status": status, "fields": fields})
    return out
