"""Aggregations, trends, pivots, windows, allocations."""

from pyspark.sql import functions as F

from tabloom.functions import expressions as X
from tabloom.operators import aggregate as A, windows as W
from tabloom.operators.order import add_ranks

from . import query


def _d(c, name=None):
    return F.col(c).cast("double").alias(name or c)


@query("SELECT l_returnflag, l_linestatus, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price_sum, min(l_extendedprice) AS price_min, max(l_extendedprice) AS price_max, count(l_extendedprice) AS price_count, count(DISTINCT l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2")
def summary_multi(t):
    l = t.lineitem.withColumn("price", X.money("l_extendedprice"))
    out = A.group_summary(l, ["l_returnflag", "l_linestatus"], {"price": ["sum", "min", "max", "count"], "l_suppkey": ["nunique"]}, sort=False)
    return out.withColumns({c: F.col(c).cast("double") for c in ("price_sum", "price_min", "price_max")})


@query("SELECT s, sum(p)::DOUBLE AS p_sum, median(p) AS p_median, count(*) AS p_size FROM (SELECT nullif(o_orderstatus, 'P') AS s, o_custkey AS p FROM orders) WHERE s IS NOT NULL GROUP BY 1")
def summary_dropna(t):
    o = t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("s"), _d("o_custkey", "p"))
    return A.group_summary(o, ["s"], {"p": ["sum", "median", "size"]}, dropna=True, sort=False)


@query("SELECT o_orderpriority, 0::BIGINT AS v_sum, count(*) AS v_size FROM orders GROUP BY 1")
def summary_all_null(t):
    return A.group_summary(t.orders.withColumn("v", F.lit(None).cast("bigint")), ["o_orderpriority"], {"v": ["sum", "size"]}, sort=False)


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS p_first, arg_max(o_totalprice, o_orderkey) AS p_last FROM orders GROUP BY 1")
def summary_first_last(t):
    return A.group_summary(t.orders.withColumnRenamed("o_totalprice", "p"), ["o_custkey"], {"p": ["first", "last"]}, order=["o_orderkey"], sort=False)


for _g in X.PERIODS:

    def _trend(t, g=_g):
        o = t.orders.select("o_orderdate", X.money("o_totalprice").alias("amount"))
        return A.trend(o, "o_orderdate", ["amount"], g).select("period", _d("amount"))

    query(f"SELECT date_trunc('{_g}', o_orderdate)::DATE AS period, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS amount FROM orders GROUP BY 1", name=f"trend_{_g}")(_trend)


@query("SELECT date_trunc('week', ts)::DATE AS period, event_type, count(value) AS value FROM events GROUP BY 1, 2")
def trend_grouped(t):
    return A.trend(t.events, "ts", ["value"], "week", "count", ["event_type"])


_PARETO = "WITH g AS (SELECT p_brand AS category, sum(l_extendedprice::DECIMAL(18,2)) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, category)::INT AS position, sum(value) OVER (ORDER BY value DESC, category ROWS UNBOUNDED PRECEDING) AS run, sum(value) OVER () AS total FROM g)"


def _pareto(t, top=None):
    l = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", X.money("l_extendedprice").alias("v"))
    out = A.contribution(l, "p_brand", "v", top=top)
    return out.select("category", _d("value"), F.col("position").cast("int").alias("position"), F.round(F.col("share").cast("double"), 6).alias("share"), F.round(F.col("running_share").cast("double"), 6).alias("running_share"), "is_core")


@query(_PARETO + " SELECT category, value::DOUBLE AS value, position, round(value::DOUBLE / total::DOUBLE, 6) AS share, round(run::DOUBLE / total::DOUBLE, 6) AS running_share, (run - value)::DOUBLE / total::DOUBLE < 0.8 AS is_core FROM r")
def pareto(t):
    return _pareto(t)


@query(_PARETO + " SELECT category, value::DOUBLE AS value, position, round(value::DOUBLE / total::DOUBLE, 4) AS share FROM r WHERE position <= 5 UNION ALL SELECT '(other)', sum(value)::DOUBLE, 6, round(sum(value)::DOUBLE / max(total)::DOUBLE, 4) FROM r WHERE position > 5")
def pareto_other(t):
    return _pareto(t, 5).select("category", "value", "position", F.round("share", 4).alias("share"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS o_orderstatus_F, count(*) FILTER (o_orderstatus = 'O') AS o_orderstatus_O, count(*) FILTER (o_orderstatus = 'P') AS o_orderstatus_P FROM orders GROUP BY 1")
def crosstab(t):
    return A.cross_pivot(t.orders, ["o_orderpriority"], "o_orderstatus")


_PIV = "sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = '{0}')::DOUBLE AS o_orderstatus_{0}"


@query("SELECT o_orderpriority, " + ", ".join(_PIV.format(s) for s in "FOP") + " FROM orders GROUP BY 1")
def pivot_sum(t):
    p = A.cross_pivot(t.orders.withColumn("v", X.money("o_totalprice")), ["o_orderpriority"], "o_orderstatus", "v", "sum", fill=None)
    return p.select("o_orderpriority", *[_d(f"o_orderstatus_{s}") for s in "FOP"])


@query("SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'total' ELSE o_orderpriority END AS o_orderpriority, " + ", ".join(_PIV.format(s) for s in "FOP") + ", sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY ROLLUP (o_orderpriority)")
def pivot_margins(t):
    p = A.cross_pivot(t.orders.withColumn("v", X.money("o_totalprice")), ["o_orderpriority"], "o_orderstatus", "v", "sum", fill=None, margins="total")
    return p.select("o_orderpriority", *[_d(f"o_orderstatus_{s}") for s in "FOP"], _d("total"))


@query("""SELECT 'o_totalprice' AS column_name, count(*) AS n, 0::BIGINT AS missing, count(DISTINCT o_totalprice) AS distinct_values, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS minimum, max(o_totalprice) AS maximum,
round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders""")
def describe_numeric(t):
    d = A.describe(t.orders, ["o_totalprice"])
    return d.drop("total").withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query("SELECT o_orderpriority AS mode, count(*) AS mode_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def mode_value(t):
    return A.mode(t.orders, "o_orderpriority")


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, round(corr(l_quantity, l_extendedprice), 8) AS value FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 8) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*), round(corr(l_extendedprice, l_discount), 8) FROM lineitem")
def corr_pearson(t):
    return A.correlation(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("value", F.round("value", 8))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS y FROM lineitem) SELECT 'l_quantity' AS a, 'l_discount' AS b, count(*) AS n, round(corr(x, y), 8) AS value FROM r")
def corr_spearman(t):
    return A.correlation(t.lineitem, ["l_quantity", "l_discount"], "spearman").withColumn("value", F.round("value", 8))


@query("""WITH g AS (SELECT c_nationkey AS k, count(*) AS x, sum(c_acctbal::DECIMAL(18,2)) AS y FROM customer GROUP BY 1), p AS (SELECT sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM g a JOIN g b ON a.k < b.k)
SELECT 'x' AS a, 'y' AS b, (SELECT count(*) FROM g) AS n, round(sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))), 8)::DOUBLE AS value FROM p""")
def corr_kendall(t):
    g = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("x"), F.sum(X.money("c_acctbal")).alias("y"))
    return A.correlation(g, ["x", "y"], "kendall").withColumn("value", F.round("value", 8))


@query("SELECT l_returnflag, round((sum((l_extendedprice * l_discount)::DECIMAL(18,4)) / sum(l_extendedprice::DECIMAL(18,2)))::DOUBLE, 8) AS ratio FROM lineitem GROUP BY 1")
def weighted_ratio(t):
    r = A.weighted_ratio(t.lineitem, ["l_returnflag"], (F.col("l_extendedprice") * F.col("l_discount")).cast("decimal(18,4)").cast("double"), F.col("l_extendedprice"))
    return r.withColumn("ratio", F.round("ratio", 8))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def last_balance(t):
    return A.last_balance(t.events.withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value"))), ["user_id"], "value", ["ts", "event_id"])


@query("SELECT o_orderpriority, CASE WHEN count_if(o_custkey % 500 = 0) = 0 THEN sum(o_custkey)::BIGINT END AS total FROM orders GROUP BY 1")
def complete_sum(t):
    return t.orders.withColumn("v", F.when(F.col("o_custkey") % 500 != 0, F.col("o_custkey"))).groupBy("o_orderpriority").agg(A.complete_sum("v").alias("total"))


@query("SELECT l_suppkey, coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag = 'R'), 0)::DOUBLE AS returned, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def cond_sums(t):
    p = X.money("l_extendedprice")
    return t.lineitem.groupBy("l_suppkey").agg(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", p)), F.lit(0)).cast("double").alias("returned"), F.sum(p).cast("double").alias("total"), F.count_distinct("l_orderkey").alias("orders"))


@query("SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY first) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(t):
    return t.orders.groupBy("o_custkey").agg(A.ordered_distinct_text("o_orderpriority", "o_orderkey").alias("priorities"))


_AL = "WITH l AS (SELECT o_custkey AS k, o_orderkey AS i, o_totalprice::DECIMAL(18,2) AS w, (1000.01 + o_custkey)::DECIMAL(18,2) AS amt FROM orders)"


def _lines(t):
    return t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), X.money("o_totalprice").alias("w"), (F.lit(1000.01).cast("decimal(18,2)") + F.col("o_custkey")).cast("decimal(18,2)").alias("amt"))


@query(_AL + """, f AS (SELECT *, (amt * 100)::HUGEINT AS u, (w * 100)::HUGEINT AS wi, sum((w * 100)::HUGEINT) OVER (PARTITION BY k) AS tw FROM l),
g AS (SELECT *, (u * wi) // tw AS q, (u * wi) % tw AS r FROM f), h AS (SELECT *, u - sum(q) OVER (PARTITION BY k) AS left_, row_number() OVER (PARTITION BY k ORDER BY r DESC, i) AS n FROM g)
SELECT k, i, ((q + CASE WHEN n <= left_ THEN 1 ELSE 0 END)::DOUBLE / 100) AS allocated FROM h""")
def alloc_largest_remainder(t):
    return A.allocate_largest_remainder(_lines(t), ["k"], "amt", "w", ["i"]).select("k", "i", _d("allocated"))


@query(_AL + """, f AS (SELECT *, (amt * 100)::HUGEINT AS u, (w * 100)::HUGEINT AS wi, sum((w * 100)::HUGEINT) OVER (PARTITION BY k) AS tw, row_number() OVER (PARTITION BY k ORDER BY i) AS n, count(*) OVER (PARTITION BY k) AS m FROM l),
g AS (SELECT *, (2 * u * wi + tw) // (2 * tw) AS p FROM f), h AS (SELECT *, least(u, sum(p) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING)) AS c FROM g),
j AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY k ORDER BY i), 0) AS b FROM h) SELECT k, i, (CASE WHEN n = m THEN u - b ELSE c - b END)::DOUBLE / 100 AS allocated FROM j""")
def alloc_last_residual(t):
    return A.allocate_last_residual(_lines(t), ["k"], "amt", "w", ["i"]).select("k", "i", _d("allocated"))


@query("SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS objects, (SELECT string_agg(x, '; ' ORDER BY x) FROM (SELECT DISTINCT o_custkey::VARCHAR AS x FROM orders i WHERE i.o_orderstatus = o.o_orderstatus AND i.o_orderpriority = o.o_orderpriority ORDER BY x LIMIT 4)) AS examples FROM orders o GROUP BY 1, 2")
def risk_groups(t):
    return A.condense_risks(t.orders, ["o_orderstatus", "o_orderpriority"], "o_custkey")


@query("SELECT DISTINCT (SELECT max(ts)::DATE FROM events) AS as_of, 1::BIGINT AS entities, (SELECT arg_max(value, (ts, event_id)) FROM events)::DOUBLE AS balance")
def common_date_balance(t):
    e = t.events.withColumn("d", F.col("ts").cast("date")).withColumn("who", F.lit(1))
    top = e.groupBy("who", "d").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return A.balance_at_common_date(top, "who", "d", "value")


def _texts(t):
    """Dates and amounts as texts, some of which nobody can read."""
    i = F.col("o_orderkey")
    day = F.when(i % 31 == 0, "soon").when(i % 37 == 0, " ").otherwise(F.date_format("o_orderdate", "yyyy/M/d"))
    return t.orders.select(day.alias("day"), F.when(i % 11 == 0, "n/a").when(i % 13 != 0, F.concat(F.lit("¥"), F.format_number("o_totalprice", 2))).alias("amount"), F.when(i % 11 != 0, i % 9).alias("pieces"), "o_orderstatus")


_TEXTS = "WITH r AS (SELECT CASE WHEN o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0 THEN o_orderdate::DATE END AS d, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN o_totalprice::DECIMAL(18,2) END AS a, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 9 END AS p, o_orderkey AS i, o_orderstatus FROM orders)"


@query(f"{_TEXTS} SELECT date_trunc('quarter', d)::DATE AS period, o_orderstatus, coalesce(sum(a), 0)::DOUBLE AS amount, max(p) AS pieces FROM r WHERE d IS NOT NULL AND (a IS NOT NULL OR p IS NOT NULL) GROUP BY 1, 2")
def trend_of_texts(t):
    return A.trend_report(_texts(t), "day", ["amount", "pieces"], "quarter", {"amount": "sum", "pieces": "max"}, ["o_orderstatus"])["primary"].select("period", "o_orderstatus", _d("amount"), "pieces")


@query(f"{_TEXTS} SELECT count(*) AS input_rows, count_if(d IS NOT NULL AND (a IS NOT NULL OR p IS NOT NULL))::BIGINT AS used_rows, count_if(i % 31 = 0)::BIGINT AS bad_dates, count_if(i % 11 = 0)::BIGINT AS bad_amount, 0::BIGINT AS bad_pieces FROM r")
def trend_counts(t):
    return A.trend_report(_texts(t), "day", ["amount", "pieces"])["counts"]


_BRAND = "(SELECT p_brand, sum(l_quantity)::BIGINT AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def _brand(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("l_quantity").cast("bigint").alias("q"))


@query(f"SELECT p_brand, q, rank() OVER (ORDER BY q DESC)::INT AS r FROM {_BRAND}")
def rank_min(t):
    return add_ranks(_brand(t), "q", smallest="r").withColumn("r", F.col("r").cast("int"))


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, round((rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2) / count(*) OVER (), 8) AS p FROM c")
def pct_rank_avg(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).transform(add_ranks, "n", None, "p").select("o_custkey", F.round("p", 8).alias("p"))


_M = "(SELECT date_trunc('month', o_orderdate)::DATE AS m, sum(o_totalprice::DECIMAL(18,2)) AS v FROM orders GROUP BY 1)"


def _month(t):
    return t.orders.groupBy(X.period("o_orderdate", "month").alias("m")).agg(F.sum(X.money("o_totalprice")).alias("v"))


@query(f"SELECT m, (sum(v) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING))::DOUBLE AS s FROM {_M}")
def running_sum(t):
    return _month(t).select("m", W.running_sum("v", ["m"]).cast("double").alias("s"))


@query(f"SELECT m, (v - lag(v) OVER (ORDER BY m))::DOUBLE AS d, round(v::DOUBLE / (lag(v) OVER (ORDER BY m))::DOUBLE - 1, 8) AS p FROM {_M}")
def mom_change(t):
    return _month(t).select("m", W.change("v", ["m"]).cast("double").alias("d"), F.round(W.pct_change(F.col("v").cast("double"), ["m"]), 8).alias("p"))


@query(f"SELECT p_brand, round(q / sum(q) OVER (), 8) AS share FROM {_BRAND}")
def share_of_total(t):
    return _brand(t).select("p_brand", F.round(W.share_of(F.col("q").cast("double")), 8).alias("share"))


@query("SELECT o_orderkey, (sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey))::DOUBLE AS total, count(*) OVER (PARTITION BY o_custkey) > 1 AS again FROM orders")
def group_total(t):
    return t.orders.select("o_orderkey", W.group_total(X.money("o_totalprice"), ["o_custkey"]).cast("double").alias("total"), W.is_repeated(["o_custkey"]).alias("again"))


@query("SELECT l_partkey, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS first_price, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS last_price FROM lineitem GROUP BY 1")
def first_last_price(t):
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return t.lineitem.groupBy("l_partkey").agg(F.min_by("l_extendedprice", at).alias("first_price"), F.max_by("l_extendedprice", at).alias("last_price"))


@query("SELECT o_custkey, bool_and(up) AS rising FROM (SELECT o_custkey, coalesce(o_totalprice > lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), true) AS up FROM orders) GROUP BY 1")
def rising_sequences(t):
    return t.orders.select("o_custkey", W.is_rising("o_totalprice", ["o_orderkey"], ["o_custkey"]).alias("up")).groupBy("o_custkey").agg(F.bool_and("up").alias("rising"))


@query("SELECT n_name, date_trunc('month', o_orderdate)::DATE AS month, sum((l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DECIMAL(18,4))::DOUBLE AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag <> 'R' GROUP BY 1, 2")
def revenue_by_nation(t):
    """The flagship: filter, three joins, exact revenue by month and nation."""
    l = t.lineitem.where("l_returnflag <> 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = (X.money("l_extendedprice") * (1 - X.money("l_discount"))).cast("decimal(18,4)")
    return l.groupBy("n_name", X.period("o_orderdate", "month").alias("month")).agg(F.sum(revenue).cast("double").alias("revenue"), F.count("*").alias("lines"))
