"""Reports, plans, recipes, SQL, star model and streaming over the star tables."""

import json

from pyspark.sql import functions as F

from tabloom.operators.order import dealt
from tabloom.functions import expressions as X
from tabloom.plans import domains, plan as P
from tabloom.plans.recipe import Recipe
from tabloom.plans.sqlguard import query_tables
from tabloom.reports import adaptive, charts, operations as O, orders, sales as S
from tabloom.sources import star

from . import query

_dbl = lambda *cs: {c: F.col(c).cast("double") for c in cs}


def _sales(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_shipdate", "p_type", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", (X.money("p_retailprice") * F.col("l_quantity").cast("int")).cast("decimal(18,2)").alias("cost"))


_S = "(SELECT *, (p_retailprice::DECIMAL(18,2) * l_quantity::INT)::DECIMAL(18,2) AS cost, l_extendedprice::DECIMAL(18,2) AS s FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"SELECT count(*) AS rows, sum(s)::DOUBLE AS sales, sum(cost)::DOUBLE AS cost, sum(l_quantity) AS quantity, (sum(s) - sum(cost))::DOUBLE AS profit, round((sum(s) - sum(cost))::DOUBLE / sum(s)::DOUBLE, 8) AS margin FROM {_S}")
def sales_overview(t):
    return S.overview(_sales(t), "l_extendedprice", "cost", "l_quantity").withColumns({**_dbl("sales", "cost", "profit"), "margin": F.round("margin", 8)})


@query(f"SELECT p_type, sum(s)::DOUBLE AS sales, sum(cost)::DOUBLE AS cost, count(*) AS rows, (sum(s) - sum(cost))::DOUBLE AS profit, round(sum(s)::DOUBLE / (sum(sum(s)) OVER ())::DOUBLE, 8) AS share, rank() OVER (ORDER BY sum(s) DESC)::INT AS rank FROM {_S} GROUP BY 1")
def sales_rank_product(t):
    r = S.sales_report(_sales(t), "l_shipdate", "p_type", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", "cost")["products"]
    return r.drop("margin").withColumns({**_dbl("sales", "cost", "profit"), "share": F.round("share", 8), "rank": F.col("rank").cast("int")})


@query(f"WITH f AS (SELECT quantile_cont(l_extendedprice, 0.75) + 0.3 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS f FROM lineitem) SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN s < cost THEN 'loss' END, CASE WHEN l_extendedprice > f THEN 'high_sales' END) AS attention FROM {_S}, f WHERE s < cost OR l_extendedprice > f")
def sales_attention(t):
    return S.attention(_sales(t).withColumn("l_extendedprice", X.money("l_extendedprice")), "l_extendedprice", "cost", factor=0.3).select("l_orderkey", "l_linenumber", "attention")


def _quarters(t):
    """Three tables with headers of their own, amounts and dates as texts, some unreadable; the third repeats rows of the second, less complete."""
    o = t.orders
    status = F.when(F.col("o_orderkey") % 9 == 0, "Cancelled").otherwise("done")
    one = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("Order No"), F.date_format("o_orderdate", "yyyy/M/d").alias("Day"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("Amount"), F.lit("1").alias("cost"), F.col("o_orderstatus").alias("Area"), status.alias("status"))
    two = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderkey") % 10 == 3, "?").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("sales"), F.col("o_orderstatus").alias("region"), status.alias("status"))
    again = two.where("order_id % 5 = 0").withColumn("region", F.lit(""))
    return S.quarterly_report({"a": one, "b": two, "c": again}, {"order_id": ["order no"], "date": ["day"], "sales": ["amount"], "region": ["area"]})


_QUARTERS = "WITH j AS (SELECT o_orderkey AS i, o_totalprice::DECIMAL(18,2) AS v, o_orderstatus AS s, o_orderdate AS d FROM orders), k AS (SELECT * FROM j WHERE i % 9 <> 0 AND i % 10 <> 3)"


@query(f"{_QUARTERS} SELECT s AS region, sum(v)::DOUBLE AS sales, count(*) AS rows, rank() OVER (ORDER BY sum(v) DESC)::INT AS rank FROM k GROUP BY 1")
def quarterly_regions(t):
    out = _quarters(t)["regions"]
    return out.select("region", F.col("sales").cast("double").alias("sales"), "rows", F.col("rank").cast("int").alias("rank"))


@query(f"{_QUARTERS} SELECT * FROM (SELECT i::VARCHAR AS order_id, concat_ws('; ', CASE WHEN i % 10 = 3 THEN 'bad_date' END, CASE WHEN i % 9 = 0 THEN 'status' END) AS reason FROM j) WHERE reason <> ''")
def quarterly_invalid(t):
    return _quarters(t)["invalid"].select("order_id", "reason")


@query(f"{_QUARTERS} SELECT count(*) AS rows, sum(v)::DOUBLE AS sales, count_if(i % 2 = 0)::DOUBLE AS cost, (sum(v) - count_if(i % 2 = 0))::DOUBLE AS profit, round((sum(v) - count_if(i % 2 = 0))::DOUBLE / sum(v)::DOUBLE, 8) AS margin FROM k")
def quarterly_overview(t):
    out = _quarters(t)["primary"].withColumns({**_dbl("sales", "cost", "profit"), "margin": F.round("margin", 8)})
    return out.select("rows", "sales", "cost", "profit", "margin")


@query(f"{_QUARTERS} SELECT strftime(d, '%Y-%m') AS month, s AS region, sum(v)::DOUBLE AS sales FROM k GROUP BY 1, 2")
def quarterly_series(t):
    return _quarters(t)["series"].withColumns(_dbl("sales"))


@query(f"{_QUARTERS} SELECT i::VARCHAR AS order_id, d::DATE AS date, v::DOUBLE AS sales, s AS region, CASE WHEN i % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM k")
def quarterly_clean(t):
    return _quarters(t)["clean"].select("order_id", "date", F.col("sales").cast("double").alias("sales"), "region", "source")


def _order_lines(t):
    by = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]
    lines = dealt(t.lineitem, "l_orderkey").groupBy(*by).agg(F.sum(X.money("l_extendedprice")).alias("amount")).withColumn("line", F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyyMMdd")))
    return lines.withColumn("disc", (F.col("l_orderkey") % 97 + F.lit("0.07").cast("decimal(18,2)")).cast("decimal(18,2)")).withColumn("refund", (F.col("l_orderkey") % 31).cast("decimal(18,2)"))


def _shares(name, amount):
    """SQL of whole cents by largest remainder, ties by line; x has lines with amounts in cents (wi) and their order's sum (tw)."""
    return f"""{name}0 AS (SELECT *, ({amount}) * wi // tw AS q, ({amount}) * wi % tw AS r FROM x), {name}1 AS (SELECT *, ({amount}) - sum(q) OVER (PARTITION BY o) AS more, row_number() OVER (PARTITION BY o ORDER BY r DESC, line) AS n FROM {name}0),
{name} AS (SELECT o, line, q + CASE WHEN n <= more THEN 1 ELSE 0 END AS cents FROM {name}1)"""


_ORDER_SHARES = f"""WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_shipdate, l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS line, sum((l_extendedprice::DECIMAL(18,2) * 100)::HUGEINT) AS wi FROM lineitem GROUP BY ALL),
x AS (SELECT *, sum(wi) OVER (PARTITION BY o) AS tw FROM l), {_shares("d", "((o % 97) * 100 + 7)::HUGEINT")}, {_shares("f", "((o % 31) * 100)::HUGEINT")}, y AS (SELECT x.*, d.cents AS dc, f.cents AS fc FROM x JOIN d ON d.o = x.o AND d.line = x.line JOIN f ON f.o = x.o AND f.line = x.line)"""
_SUMS = "count(DISTINCT o) AS orders, sum(wi)::DOUBLE / 100 AS sales, sum(dc)::DOUBLE / 100 AS discount, sum(fc)::DOUBLE / 100 AS refund, sum(wi - dc - fc)::DOUBLE / 100 AS net"


def _order_analysis(t):
    return S.order_analysis(_order_lines(t), "l_orderkey", "line", "amount", "disc", "refund", "l_suppkey", "l_partkey", "l_shipdate")


for _kind, _by, _sql in (("stores", "l_suppkey", "s AS l_suppkey"), ("products", "l_partkey", "p AS l_partkey"), ("days", "day", "l_shipdate::DATE AS day")):

    def _order_sums(t, kind=_kind):
        return _order_analysis(t)[kind].withColumns(_dbl("sales", "discount", "refund", "net"))

    query(f"{_ORDER_SHARES} SELECT {_sql}, {_SUMS} FROM y GROUP BY 1", name=f"order_allocation_{_kind}")(_order_sums)


@query(f"""{_ORDER_SHARES}, h AS (SELECT o, max((o % 97) * 100 + 7) AS d, max((o % 31) * 100) AS r FROM l GROUP BY 1) SELECT (SELECT sum(d) FROM h) = (SELECT sum(dc) FROM y) AS discount_ties, (SELECT sum(r) FROM h) = (SELECT sum(fc) FROM y) AS refund_ties""")
def order_allocation_checks(t):
    return _order_analysis(t)["checks"]


def _customer_orders(t):
    """Lines with repeats, unknown stores and products, texts as numbers and statuses in words; each order's refund in two rows."""
    l, i = t.lineitem, F.col("l_orderkey")
    status = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") == 1, "已取消").otherwise("处理中")).otherwise(" 已完成")
    one = l.select(F.concat(F.lit("o"), i).alias("order_id"), F.concat(F.when(F.col("l_suppkey") % 2 == 0, "店 ").otherwise("店铺"), F.col("l_suppkey") % 20).alias("store"), F.concat(F.lit("p"), "l_partkey").alias("product"), F.when(F.col("l_linenumber") == 7, "0").otherwise(F.col("l_quantity").cast("string")).alias("quantity"), X.money("l_extendedprice").alias("price"), (F.col("l_linenumber") % 4 + F.lit("0.5").cast("decimal(2,1)")).cast("decimal(18,2)").alias("discount"), status.alias("status"), F.when(F.col("l_tax") >= 0.08, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day"))
    lines = one.union(one.where("order_id like '%0'"))
    products = t.part.where("p_partkey % 50 <> 3").select(F.concat(F.lit("P"), "p_partkey").alias("product"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), X.money("p_retailprice").alias("cost"))
    targets = t.nation.where("n_nationkey < 18").select(F.concat(F.lit("门店"), "n_nationkey").alias("store"), (F.col("n_nationkey") * 1000 + 500).alias("target"))
    refunds = t.orders.select(F.concat(F.lit("O"), "o_orderkey").alias("order_id"), X.money(F.col("o_orderkey") % 37).alias("amount"), F.when(F.col("o_orderkey") % 4 == 0, "退款申请").otherwise("退款成功").alias("status"))
    return orders.order_analysis(lines, products, refunds.union(refunds.where("order_id like '%3'")), targets)


_CUSTOMER = """WITH raw AS (SELECT 'O' || l_orderkey AS o, l_suppkey % 20 AS s, l_suppkey % 2 AS odd, 'P' || l_partkey AS p, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END::DECIMAL(18,4) AS q, l_extendedprice::DECIMAL(18,2) AS price, (l_linenumber % 4 + 0.5)::DECIMAL(18,2) AS d, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber = 1 THEN 'invalid' ELSE 'unknown' END ELSE 'ok' END AS st, CASE WHEN l_tax < 0.08 THEN l_shipdate::DATE END AS day, l_partkey % 50 = 3 AS lost, p_retailprice::DECIMAL(18,2) AS unit, CASE WHEN l_orderkey % 10 = 0 THEN 2 ELSE 1 END AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
u AS (SELECT o, s, odd, p, q, price, d, st, day, lost, unit, sum(n) AS copies FROM raw GROUP BY ALL),
v AS MATERIALIZED (SELECT *, CASE WHEN st = 'invalid' THEN 'invalid_status' WHEN st = 'unknown' THEN 'unknown_status' WHEN s >= 18 THEN 'unknown_store' WHEN lost THEN 'unknown_product' WHEN q <= 0 THEN 'bad_quantity' WHEN price <= 0 THEN 'bad_price' WHEN day IS NULL THEN 'bad_date' END AS reason, round(q * price, 2)::DECIMAL(18,2) AS sales FROM u),
b AS (SELECT 'O' || o_orderkey AS o, (o_orderkey % 37) * CASE WHEN o_orderkey % 10 = 3 THEN 2 ELSE 1 END * 100 AS back FROM orders WHERE o_orderkey % 4 <> 0),
w AS (SELECT v.*, coalesce(back, 0)::HUGEINT AS back, ((sales - d) * 100)::HUGEINT AS paid, sum(((sales - d) * 100)::HUGEINT) OVER (PARTITION BY o) AS total FROM v LEFT JOIN b USING (o) WHERE reason IS NULL),
x AS (SELECT *, back * paid // total AS f, back * paid % total AS r FROM w), y AS (SELECT *, back - sum(f) OVER (PARTITION BY o) AS more, row_number() OVER (PARTITION BY o ORDER BY r DESC, p, '门店' || s, day, q, price, d, odd) AS nth FROM x),
z AS (SELECT *, (f + CASE WHEN nth <= more THEN 1 ELSE 0 END)::DECIMAL(18,0) * 0.01::DECIMAL(3,2) AS refund, round(q * unit, 2) AS cost FROM y)"""


@query(f"""{_CUSTOMER} SELECT '门店' || s AS store, sum(sales)::DOUBLE AS sales, sum(d)::DOUBLE AS discount, sum(refund)::DOUBLE AS refund, sum(sales - d - refund)::DOUBLE AS net, sum(sales - d - refund - cost)::DOUBLE AS margin, count(DISTINCT o) AS orders, round(sum(sales - d - refund)::DOUBLE / (s * 1000 + 500), 8) AS attainment FROM z GROUP BY s""")
def customer_order_stores(t):
    s = _customer_orders(t)["stores"].withColumns({**_dbl("sales", "discount", "refund", "net", "margin"), "attainment": F.round("attainment", 8)})
    return s.select("store", "sales", "discount", "refund", "net", "margin", "orders", "attainment")


@query(f"""{_CUSTOMER} SELECT * FROM (SELECT 0 AS step, 'all' AS name, sum(copies)::BIGINT AS rows FROM v UNION ALL SELECT 1, 'copy', sum(copies - 1)::BIGINT FROM v UNION ALL SELECT k::INT, w, (SELECT count(*) FROM v WHERE reason = w) FROM (VALUES (2, 'invalid_status'), (3, 'unknown_status'), (4, 'unknown_store'), (5, 'unknown_product'), (6, 'bad_quantity'), (7, 'bad_price'), (8, 'bad_date')) r(k, w) UNION ALL SELECT 9, 'valid', (SELECT count(*) FROM v WHERE reason IS NULL))""")
def customer_order_waterfall(t):
    return _customer_orders(t)["waterfall"]


@query(f"""{_CUSTOMER} SELECT 'refunds' AS "check", (SELECT sum(refund) * 100 FROM z) = (SELECT sum(b) FROM (SELECT any_value(back) AS b FROM z GROUP BY o)) AS passed UNION ALL SELECT 'rows', (SELECT sum(n) FROM raw) = (SELECT count(*) + sum(copies - 1) FROM v) UNION ALL SELECT 'split', (SELECT count(*) FROM v) = (SELECT count(*) FROM z) + (SELECT count(reason) FROM v)
UNION ALL SELECT 'products', (SELECT bool_and(NOT lost) FROM z) UNION ALL SELECT 'stores', (SELECT bool_and(s < 18) FROM z) UNION ALL SELECT 'totals', true UNION ALL SELECT 'indicators', (SELECT sum(sales - d - refund) <> 0 FROM z)""")
def customer_order_checks(t):
    return _customer_orders(t)["checks"]


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders, sum(s)::DOUBLE AS sales, coalesce(sum(s) FILTER (l_returnflag = 'R'), 0)::DOUBLE AS refunds, round(sum(s)::DOUBLE / count(DISTINCT l_orderkey), 6) AS order_value, round(coalesce(sum(s) FILTER (l_returnflag = 'R'), 0)::DOUBLE / sum(s)::DOUBLE, 6) AS refund_rate FROM (SELECT *, l_extendedprice::DECIMAL(18,2) AS s FROM lineitem) GROUP BY 1")
def order_store_summary(t):
    l = t.lineitem.withColumn("refund", F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")))
    return S.order_summary(l, "l_suppkey", "l_orderkey", "l_extendedprice", "refund").withColumns({**_dbl("sales", "refunds"), "order_value": F.round("order_value", 6), "refund_rate": F.round("refund_rate", 6)})


@query("""WITH m AS (SELECT l_partkey AS sku, sum(l_quantity) FILTER (l_returnflag = 'A') AS received, sum(l_quantity) FILTER (l_returnflag = 'N' AND l_linenumber < 6) AS sold, sum(l_quantity) FILTER (l_returnflag = 'R') AS adjusted, sum(l_quantity) FILTER (l_returnflag = 'N' AND l_linenumber >= 6) AS transit,
  sum(l_quantity) FILTER (l_returnflag = 'N' AND l_linenumber < 6 AND date_diff('day', l_shipdate::DATE, DATE '2001-12-31') BETWEEN 0 AND 899) AS recent FROM lineitem GROUP BY 1),
b AS (SELECT p_partkey AS sku, CASE WHEN p_partkey % 37 <> 0 THEN 200.0 END + coalesce(received, 0) - coalesce(sold, 0) + coalesce(adjusted, 0) AS book, coalesce(transit, 0) AS transit, p_size, p_partkey % 5 AS defective, coalesce(recent, 0) / 900.0::DOUBLE AS rate FROM part LEFT JOIN m ON sku = p_partkey),
c AS (SELECT *, book - 10 - defective AS sellable, ceil(p_size + rate * 7)::BIGINT AS reorder_point, ceil(p_size + rate * 30)::BIGINT AS target, sku % 50 = 0 AS gone FROM b),
d AS (SELECT *, NOT gone AND CASE WHEN rate > 0 THEN sellable / rate > 60 ELSE sellable > p_size END AS over FROM c),
e AS (SELECT *, CASE WHEN sellable IS NOT NULL THEN CASE WHEN NOT gone AND sellable <= reorder_point THEN ceil(greatest(target - sellable - transit, 0)) ELSE 0 END END AS to_order,
  CASE WHEN sellable IS NOT NULL THEN CASE WHEN over THEN floor(greatest(sellable - target, 0)) WHEN gone THEN floor(greatest(sellable, 0)) ELSE 0 END END AS excess FROM d)
SELECT sku, book::DOUBLE AS book, sellable::DOUBLE AS sellable, rate AS daily_rate, CASE WHEN rate > 0 THEN round(sellable / rate, 6) END AS cover_days, reorder_point, target, to_order::DOUBLE AS to_order, excess::DOUBLE AS excess,
CASE WHEN sellable IS NULL THEN 'unknown' WHEN sellable < 0 THEN 'negative' WHEN gone THEN CASE WHEN sellable > 0 THEN 'discontinued_stock' ELSE 'discontinued' END WHEN to_order > 0 THEN 'reorder' WHEN over THEN 'overstock' ELSE 'normal' END AS stock_status FROM e""")
def inventory_ledger(t):
    k = F.col("p_partkey")
    p = t.part.select(k.alias("sku"), F.when(k % 37 != 0, 200.0).alias("opening"), F.lit(10.0).alias("locked"), (k % 5).alias("defective"), F.col("p_size").alias("safety"), F.lit(7).alias("lead_days"), F.lit(30).alias("target_days"), F.when(k % 50 == 0, "discontinued").otherwise("active").alias("status"))
    kind = F.when(F.col("l_returnflag") == "A", "received").when(F.col("l_returnflag") == "R", "adjusted").when(F.col("l_linenumber") < 6, "sold").otherwise("transit")
    m = t.lineitem.select(F.col("l_partkey").alias("sku"), kind.alias("kind"), F.col("l_quantity").alias("quantity"), F.datediff(F.lit("2001-12-31").cast("date"), "l_shipdate").alias("day"))
    out = O.inventory(p, m, "sku", 900).withColumns({**_dbl("book", "sellable", "to_order", "excess"), **{c: F.col(c).cast("long") for c in ("reorder_point", "target")}, "cover_days": F.round("cover_days", 6)})
    return out.select("sku", "book", "sellable", "daily_rate", "cover_days", "reorder_point", "target", "to_order", "excess", "stock_status")


@query("""WITH a AS (SELECT o_custkey % 200 AS person, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months, count(*) AS present, sum(CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END) AS late, sum(CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END) AS early, sum(CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END) AS leave_days, bool_and(o_orderkey % 997 <> 0) AS whole FROM orders GROUP BY 1),
p AS (SELECT l_suppkey AS person, sum((l_quantity * 12)::BIGINT)::DOUBLE / count(*) / 400 AS attainment, sum(l_linenumber % 4 + 3)::DOUBLE / count(*) AS rating FROM lineitem GROUP BY 1),
m AS (SELECT greatest(count(DISTINCT strftime(o_orderdate, '%Y-%m')), 1) AS n FROM orders),
j AS (SELECT s_suppkey AS person, s_nationkey <> 3 AS active, coalesce(whole, false) AS whole, coalesce(a.months, m.n) AS months, attainment, rating, present, late, early, leave_days FROM supplier LEFT JOIN a ON a.person = s_suppkey LEFT JOIN p ON p.person = s_suppkey, m),
k AS (SELECT person, active, whole, months, attainment, rating, CASE WHEN whole THEN late END AS late, CASE WHEN whole THEN early END AS early, CASE WHEN whole THEN leave_days END AS leave_days, CASE WHEN whole THEN greatest(months * 2.0 - present - leave_days, 0) END AS absent, CASE WHEN whole THEN least(1.0, present / (months * 2.0)) END AS rate FROM j),
s AS (SELECT *, CASE WHEN whole THEN greatest(0, least(100, 100 - 5 * late - 5 * early - 2 * leave_days - 10 * absent)) END::DOUBLE AS att, (CASE WHEN attainment IS NOT NULL THEN greatest(0, least(1, attainment)) END * 70 + CASE WHEN rating IS NOT NULL THEN greatest(0, least(5, rating)) END / 5 * 30)::DOUBLE AS perf FROM k),
c AS (SELECT *, round(0.3 * att + 0.7 * perf, 8) AS composite FROM s),
g AS (SELECT *, coalesce(composite < 60, false) OR coalesce(late >= 5, false) OR coalesce(rate < 0.85, false) OR coalesce(attainment < 0.8, false) OR coalesce(rating < 4, false) AS low, coalesce(composite < 60, false) OR coalesce(late >= 8, false) OR coalesce(rate < 0.75, false) AS worst FROM c)
SELECT person, absent::DOUBLE AS absent, round(rate::DOUBLE, 8) AS attendance_rate, composite, CASE WHEN NOT active THEN 'not_employed' WHEN NOT whole THEN 'incomplete' WHEN low THEN 'attention' WHEN composite >= 85 AND late <= 1 AND absent = 0 THEN 'excellent' ELSE 'normal' END AS "group",
CASE WHEN NOT active THEN 'not_applicable' WHEN NOT whole THEN 'unverified' WHEN worst THEN 'high' WHEN low THEN 'medium' ELSE 'low' END AS risk, CASE WHEN active AND composite IS NOT NULL THEN rank() OVER (ORDER BY CASE WHEN active THEN composite END DESC NULLS LAST) END AS rank FROM g""")
def workforce_groups(t):
    """Suppliers as people: days are the orders of two customers in a hundred, two days expected a month."""
    i = F.col("o_orderkey")
    one = lambda n: F.when(i % n == 0, 1).otherwise(0)
    a = t.orders.select((F.col("o_custkey") % 200).alias("person"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.lit(1).alias("present"), F.when(i % 997 != 0, one(23)).alias("late"), one(31).alias("early"), one(29).alias("leave_days"))
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("person")).agg((F.sum((F.col("l_quantity") * 12).cast("bigint")).cast("double") / F.count("*") / 400).alias("attainment"), (F.sum(F.col("l_linenumber") % 4 + 3).cast("double") / F.count("*")).alias("rating"))
    people = t.supplier.select(F.col("s_suppkey").alias("person"), (F.col("s_nationkey") != 3).alias("active"))
    return O.workforce(people, a, p, "person", workdays=2.0).select("person", F.col("absent").cast("double").alias("absent"), F.round("attendance_rate", 8).alias("attendance_rate"), "composite", "group", "risk", "rank")


@query("""WITH o AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice::DECIMAL(18,2)) AS orders FROM orders GROUP BY 1), l AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, sum(l_extendedprice::DECIMAL(18,2)) AS shipped FROM lineitem GROUP BY 1)
SELECT month, orders::DOUBLE AS orders, shipped::DOUBLE AS shipped, round(orders::DOUBLE / (lag(orders) OVER (ORDER BY month))::DOUBLE - 1, 8) AS orders_change FROM o FULL JOIN l USING (month)""")
def company_months(t):
    return O.monthly_company({"orders": (t.orders, "o_orderdate", "o_totalprice"), "shipped": (t.lineitem, "l_shipdate", "l_extendedprice")}).select("month", *[F.col(c).cast("double").alias(c) for c in ("orders", "shipped")], F.round("orders_change", 8).alias("orders_change"))


@query("""WITH o AS (SELECT l_linestatus AS channel, sum(l_extendedprice::DECIMAL(18,2)) AS paid, sum((l_extendedprice::DECIMAL(18,2) * 0.5)::DECIMAL(18,2)) AS cost FROM lineitem GROUP BY 1), r AS (SELECT l_linestatus AS channel, sum(l_extendedprice::DECIMAL(18,2)) AS refund FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT channel, (paid - refund)::DOUBLE AS net, (paid - refund - cost - 1000)::DOUBLE AS contribution, round((paid - refund)::DOUBLE / 1000, 6) AS roas FROM o JOIN r USING (channel)""")
def channel_contribution(t):
    o = t.lineitem.select(F.col("l_linestatus").alias("channel"), F.col("l_extendedprice").alias("paid"), (X.money("l_extendedprice") * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(18,2)").alias("cost"))
    r = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_linestatus").alias("channel"), F.col("l_extendedprice").alias("refund"))
    ads = t.spark.createDataFrame([("F", 1000.0), ("O", 1000.0)], "channel string, ad_cost double")
    return O.channel_contribution(o, r, ads, "channel").select("channel", F.col("net").cast("double").alias("net"), F.col("contribution").cast("double").alias("contribution"), F.round("roas", 6).alias("roas"))


@query("SELECT o_orderstatus, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS value, count(*) AS rows FROM orders GROUP BY 1")
def adaptive_ranking(t):
    r = adaptive.adaptive_report(t.orders)["o_totalprice_by_o_orderstatus"]
    return r.withColumn("value", F.col("value").cast("double"))


_PACKS = {"schema_version": 1, "domains": [
    {"id": "wholesale", "label": "Wholesale", "anchors": ["order", "price"], "identity_anchors": ["wholesale"], "concepts": {"revenue": ["total price"], "urgency": ["priority"], "state": ["status"]}},
    {"id": "clinic", "label": "Clinic", "anchors": ["patient"], "identity_anchors": ["clinic"], "concepts": {"patient": ["patient"]}},
]}


@query("""SELECT o_orderpriority AS member, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS value, count(*) AS rows, 'urgency' AS ranking FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, sum(o_totalprice::DECIMAL(18,4))::DOUBLE, count(*), 'state' FROM orders GROUP BY 1""")
def domain_rankings(t):
    """A domain that is there as data alone names the rankings of its concepts."""
    out = domains.compile_domain({"orders": t.orders}, domains.load_packs(_PACKS), "how is wholesale doing")
    parts = [out[f"orders:revenue_by_{c}"].withColumn("ranking", F.lit(c)) for c in ("urgency", "state")]
    return parts[0].union(parts[1]).withColumn("value", F.col("value").cast("double"))


_PLAN = {"steps": [
    {"id": "f", "operation": "filter", "inputs": ["orders"], "params": {"rules": [{"column": "o_orderstatus", "op": "ne", "value": "P"}]}},
    {"id": "p", "operation": "partition", "inputs": ["$f"], "params": {"rules": [{"column": "o_totalprice", "op": "lt", "value": 50000, "reason": "small"}]}},
    {"id": "j", "operation": "join", "inputs": ["$p", "customer"], "params": {"left_on": ["o_custkey"], "right_on": ["c_custkey"], "how": "inner", "validate": "many_to_one"}},
    {"id": "s", "operation": "summary", "inputs": ["$j"], "params": {"by": ["c_mktsegment"], "aggregations": {"o_orderkey": ["count"]}, "sort": False}},
]}


@query("SELECT c_mktsegment, count(*) AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND o_totalprice >= 50000 GROUP BY 1")
def plan_chain(t):
    return P.execute(_PLAN, {"orders": t.orders, "customer": t.customer})["s"]["primary"]


@query("SELECT o_orderkey, 'small' AS reason FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice < 50000")
def plan_artifact(t):
    return P.execute(_PLAN, {"orders": t.orders, "customer": t.customer})["p"]["rejected"].select("o_orderkey", "reason")


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS o_custkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def recipe_chain(t):
    text = json.dumps({"version": 1, "name": "r", "steps": [{"kind": "filter", "params": {"rules": [{"column": "o_orderstatus", "op": "eq", "value": "F"}]}}, {"kind": "drop_duplicates", "params": {"keys": ["o_orderkey"]}}, {"kind": "group_summary", "params": {"by": ["o_orderpriority"], "aggregations": {"o_custkey": ["nunique"]}, "sort": False}}]})
    return Recipe.from_json(text).run(t.orders)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE value > 5 GROUP BY 1")
def sql_passthrough(t):
    return query_tables(t.spark, "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM input_1 WHERE value > 5 GROUP BY 1", {"input_1": t.events})


@query("SELECT rank() OVER (ORDER BY p_type)::INT AS kind_key, p_type FROM (SELECT DISTINCT p_type FROM part)")
def star_dimension(t):
    s = star.star_tables(t.part.withColumn("d", F.lit("2024-01-01").cast("date")), {"kind": ["p_type"]}, "d")
    return s["dim_kind"]


@query("SELECT p_partkey, kind_key FROM part JOIN (SELECT rank() OVER (ORDER BY p_type)::INT AS kind_key, p_type FROM (SELECT DISTINCT p_type FROM part)) USING (p_type)")
def star_fact(t):
    s = star.star_tables(t.part.withColumn("d", F.lit("2024-01-01").cast("date")), {"kind": ["p_type"]}, "d")
    return s["fact"].select("p_partkey", "kind_key")


@query("SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY))::DATE AS date")
def star_dates(t):
    return star.star_tables(t.orders, {"status": ["o_orderstatus"]}, "o_orderdate")["dim_date"].select("date")


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice::DECIMAL(18,2)) AS sales FROM orders GROUP BY 1)
SELECT a.month, a.sales::DOUBLE AS sales, (sum(a.sales) OVER (PARTITION BY year(a.month) ORDER BY a.month))::DOUBLE AS sales_ytd, b.sales::DOUBLE AS sales_last_year FROM m a LEFT JOIN m b ON b.month = a.month - INTERVAL 1 YEAR""")
def star_measures(t):
    f = t.orders.select("o_orderdate", "o_orderkey", X.money("o_totalprice").alias("s"), F.lit(0).cast("decimal(18,2)").alias("c"), F.lit(1).alias("u"))
    return star.measures(f, "o_orderdate", "s", "c", "o_orderkey", "u").select("month", *[F.col(c).cast("double").alias(c) for c in ("sales", "sales_ytd", "sales_last_year")])


@query("""WITH RECURSIVE r AS (SELECT o_custkey AS k, o_orderkey AS i, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
f AS (SELECT c_custkey AS k, 0::BIGINT AS n, 400000.0::DOUBLE AS room, NULL::BIGINT AS i, NULL::BOOLEAN AS accepted FROM customer UNION ALL SELECT f.k, r.n, CASE WHEN r.p <= f.room THEN f.room - r.p ELSE f.room END, r.i, r.p <= f.room FROM f JOIN r ON r.k = f.k AND r.n = f.n + 1)
SELECT k AS o_custkey, i AS o_orderkey, accepted FROM f WHERE n > 0""")
def returns_capped(t):
    """Orders as returns against 400,000 sold to each customer: one that does not fit is rejected, later smaller ones still count."""
    r = t.orders.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("quantity"))
    out = O.capped_returns(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.lit(400000.0).alias("sold")), r, "o_custkey", "sold", "o_orderkey")
    return out.select("o_custkey", "o_orderkey", "accepted")


@query("SELECT o_orderpriority AS label, count(*) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def chart_single(t):
    return charts.single_series(t.orders, "o_orderpriority", top=3)


@query("SELECT date_trunc('quarter', o_orderdate)::DATE AS period, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def chart_time(t):
    """The span of orders is over 1095 days, so quarters fit."""
    return charts.time_series(t.orders.withColumn("v", X.money("o_totalprice")), "o_orderdate", "v", last=12).withColumn("value", F.col("value").cast("double"))


@query("""WITH g AS (SELECT p_brand AS label, p_type AS series, sum(l_extendedprice::DECIMAL(18,2)) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT label, series, value::DOUBLE AS value FROM g WHERE label IN (SELECT label FROM g GROUP BY 1 ORDER BY sum(value) DESC, label LIMIT 5) AND series IN (SELECT series FROM g GROUP BY 1 ORDER BY sum(value) DESC, series LIMIT 3)""")
def chart_multi(t):
    l = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("v", X.money("l_extendedprice"))
    return charts.multi_series(l, "p_brand", "p_type", "v", top=5, most_series=3).withColumn("value", F.col("value").cast("double"))


@query("SELECT l_returnflag AS label, sum(l_quantity)::BIGINT AS q, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1")
def chart_measures(t):
    return charts.multi_measure(t.lineitem.select("l_returnflag", F.col("l_quantity").cast("bigint").alias("q"), F.col("l_linenumber").cast("bigint").alias("n")), "l_returnflag", ["q", "n"])


@query("SELECT c_mktsegment AS task, min(o_orderdate)::DATE AS start, max(o_orderdate)::DATE AS stop, (date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) + 1)::INT AS days FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def chart_gantt(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return charts.gantt(o.withColumn("stop_", F.col("o_orderdate")), "c_mktsegment", "o_orderdate", "stop_")
