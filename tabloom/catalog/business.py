"""Business texts, masters, restaurant results, allocation of receipts, selection."""

from pyspark.sql import functions as F

from tabloom.functions import business as B, expressions as X
from tabloom.operators import clean, dedup, masters
from tabloom.reports import charts, commerce, operations as O, restaurant, sales as S

from . import query



def _pick(key, values):
    """One of a few texts by key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


def _pick_sql(key, values):
    return f"([{', '.join('NULL' if v is None else chr(39) + v + chr(39) for v in values)}])[{key} % {len(values)} + 1]"


_NUMBERS = [("1,234.5元", "1234.5"), ("(12件)", "-12"), ("15%", "15"), ("￥ 7", "7"), ("abc", "NULL"), ("", "NULL"), ("3分", "3"), ("-0.5", "-0.5")]


@query(f"SELECT o_orderkey, ([{', '.join(v for _, v in _NUMBERS)}])[o_orderkey % {len(_NUMBERS)} + 1]::DOUBLE AS value FROM orders")
def business_numbers(t):
    return t.orders.select("o_orderkey", B.parse_business_number(_pick(F.col("o_orderkey"), [a for a, _ in _NUMBERS])).alias("value"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END WHEN 5 THEN NULL ELSE d END AS day
FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def business_dates(t):
    """Days as year-month-day with several marks, day-month-year, month-day-year (read as day first where both could be) and day numbers."""
    d = F.col("o_orderdate")
    forms = [F.date_format(d, "yyyy年M月d日"), F.date_format(d, "yyyy.MM.dd"), F.date_format(d, "d/M/yyyy"), F.datediff(d, F.lit("1899-12-30")).cast("string"), F.date_format(d, "M-d-yyyy"), F.lit("soon")]
    return t.orders.select("o_orderkey", B.parse_business_date(F.element_at(F.array(*forms), (F.col("o_orderkey") % 6).cast("int") + 1)).alias("day"))


_STATES = ["未完成", "交易完成", "退款申请中", "完成", "已 支付", "退款成功", "尚未到账", "已入库", "待验收", "审批通过", "待审核", None]
_STATE_CODES = {
    "order_status": ["invalid", "success", "invalid", "success", "success", "unknown", "unknown", "unknown", "unknown", "unknown", "unknown", "unknown"],
    "refund_status": ["unknown", "unknown", "pending", "unknown", "unknown", "confirmed", "pending", "unknown", "unknown", "unknown", "pending", "unknown"],
    "receipt_status": ["unknown", "unknown", "unknown", "unknown", "unknown", "unknown", "unknown", "confirmed", "pending", "unknown", "unknown", "unknown"],
    "adjustment_status": ["unknown", "unknown", "unknown", "unknown", "unknown", "unknown", "unknown", "unknown", "unknown", "confirmed", "unknown", "unknown"],
}


@query("SELECT o_orderkey, " + ", ".join(f"{_pick_sql('o_orderkey', v)} AS {k}" for k, v in _STATE_CODES.items()) + " FROM orders")
def business_statuses(t):
    text = _pick(F.col("o_orderkey"), _STATES)
    return t.orders.select("o_orderkey", *[getattr(B, k)(text).alias(k) for k in _STATE_CODES])


@query(f"SELECT c_custkey, {_pick_sql('c_custkey', ['high', 'medium', 'low', 'unknown'])} AS own, CASE WHEN c_custkey % 4 = 0 OR c_acctbal > 9000 THEN 'high' WHEN c_custkey % 3 <> 0 THEN 'unknown' WHEN c_custkey % 4 = 1 THEN 'medium' ELSE 'low' END AS combined FROM customer")
def risk_levels(t):
    """A source level and one by balance; every third customer has a master row."""
    k = F.col("c_custkey")
    source, own = _pick(k, ["严重", "Moderate", "良好", None]), F.when(F.col("c_acctbal") > 9000, "high").otherwise("low")
    return t.customer.select("c_custkey", B.risk_level(source).alias("own"), B.combined_risk(source, own, k % 3 == 0).alias("combined"))


@query("SELECT c_custkey, n_regionkey AS region, 'R' || n_regionkey AS label FROM customer JOIN nation ON c_nationkey = n_nationkey")
def attribute_join(t):
    d = t.nation.select(F.concat(F.lit(" "), F.col("n_nationkey").cast("string")).alias("code"), F.concat(F.lit("R"), "n_regionkey").alias("label"))
    out = masters.attribute_join(t.customer, d, "c_nationkey", "code", ["label"])
    return out.select("c_custkey", F.substring("label", 2, 9).cast("int").alias("region"), "label")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'Store ' || s_suppkey || '店' END AS store FROM supplier")
def store_names(t):
    """Names written otherwise; every fifth store's name is ambiguous, as two masters read alike."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Store "), k.cast("string"), F.lit("店"))
    master = t.supplier.select(name.alias("name")).union(t.supplier.where(k % 5 == 0).select(F.concat(F.lit("store-"), k.cast("string"), F.lit("门店")).alias("name")))
    typed = t.supplier.select("s_suppkey", F.concat(F.lit("STORE_"), k.cast("string"), F.lit(" 店铺")).alias("typed"))
    return masters.map_names(typed, "typed", master, "name", B.store_key, "store").select("s_suppkey", "store")


@query("SELECT DISTINCT lower(p_brand) AS value, p_brand AS suggestion, 1.0::DOUBLE AS score FROM part")
def alias_suggestions(t):
    """Brands in lower case against brands as they are written."""
    return masters.alias_suggestions(t.part.select(F.lower("p_brand").alias("b")), t.part, "b", "p_brand")


_SM = "(SELECT s_nationkey AS k, l_shipdate, l_extendedprice::DECIMAL(18,2) AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
_RM = f"""WITH r AS (SELECT 'S' || k AS store, date_trunc('month', l_shipdate)::DATE AS month, sum(p) AS revenue, sum(p) FILTER (day(l_shipdate) = 1) AS refund, count(*)::DECIMAL(18,2) AS n FROM {_SM} GROUP BY 1, 2),
x AS (SELECT store, month, revenue, coalesce(refund, 0) AS refund, revenue - coalesce(refund, 0) AS net, n * 100 AS food, n * 50 AS labor, n * 7 AS platform, n * 5 AS rent, n AS utilities, n * 2 AS marketing FROM r),
y AS (SELECT *, net - food - labor - platform - rent - utilities - marketing AS profit FROM x)"""


def _store_months(t):
    l = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("p", X.money("l_extendedprice"))
    g = l.groupBy(F.concat(F.lit("S"), "s_nationkey").alias("store"), F.date_trunc("month", "l_shipdate").alias("month"))
    g = g.agg(F.sum("p").alias("revenue"), F.sum(F.when(F.dayofmonth("l_shipdate") == 1, F.col("p"))).alias("refund"), F.count("*").cast("decimal(18,2)").alias("n"))
    return g.select("store", "month", "revenue", "refund", *[(F.col("n") * k).cast("decimal(18,2)").alias(c) for c, k in zip(restaurant.COSTS, (100, 50, 7, 5, 1, 2))])


@query(_RM + """, s AS (SELECT store, sum(revenue) AS revenue, sum(net) AS net, sum(profit) AS profit, sum(food) AS food FROM y GROUP BY 1)
SELECT store, revenue::DOUBLE AS revenue, profit::DOUBLE AS profit, round(profit::DOUBLE / net::DOUBLE, 8) AS margin, round(food::DOUBLE / net::DOUBLE, 8) AS food_rate, rank() OVER (ORDER BY profit DESC) AS profit_rank, rank() OVER (ORDER BY net DESC) AS revenue_rank,
CASE WHEN store = (SELECT arg_max(store, profit) FROM s) THEN 'best' WHEN store = (SELECT arg_max(store, net) FROM s) AND store = (SELECT arg_min(store, profit::DOUBLE / net::DOUBLE) FROM s) THEN 'large_but_weak' ELSE 'watch' END AS verdict FROM s""")
def restaurant_stores(t):
    out = restaurant.diagnosis(_store_months(t))["stores"]
    return out.select("store", F.col("revenue").cast("double").alias("revenue"), F.col("profit").cast("double").alias("profit"), F.round("margin", 8).alias("margin"), F.round("food_rate", 8).alias("food_rate"), "profit_rank", "revenue_rank", "verdict")


@query(_RM + """, m AS (SELECT month, sum(revenue) AS revenue, sum(net) AS net, sum(profit) AS profit FROM y GROUP BY 1)
SELECT month, revenue::DOUBLE AS revenue, profit::DOUBLE AS profit, round(profit::DOUBLE / net::DOUBLE, 8) AS margin, round(revenue::DOUBLE / lag(revenue::DOUBLE) OVER (ORDER BY month) - 1, 8) AS revenue_change, round(profit::DOUBLE / net::DOUBLE - lag(profit::DOUBLE / net::DOUBLE) OVER (ORDER BY month), 8) AS margin_change FROM m""")
def restaurant_months(t):
    out = restaurant.diagnosis(_store_months(t))["months"]
    return out.select("month", F.col("revenue").cast("double").alias("revenue"), F.col("profit").cast("double").alias("profit"), *[F.round(c, 8).alias(c) for c in ("margin", "revenue_change", "margin_change")])


@query(_RM + ", t AS (SELECT sum(net)::DOUBLE AS net, " + ", ".join(f"sum({c})::DOUBLE AS {c}" for c in restaurant.COSTS) + " FROM y) " + " UNION ALL ".join(f"SELECT '{c}' AS cost, {c} AS amount, round({c} / net, 8) AS share FROM t" for c in restaurant.COSTS))
def restaurant_costs(t):
    return restaurant.diagnosis(_store_months(t))["costs"].select("cost", F.col("amount").cast("double").alias("amount"), F.round("share", 8).alias("share"))


_PU = """WITH p AS (SELECT DISTINCT 'R' || l_orderkey AS receipt, l_partkey::VARCHAR AS ingredient, CASE l_linenumber % 3 WHEN 0 THEN 'Box' WHEN 1 THEN 'kg' ELSE 'sack' END AS unit, l_quantity AS quantity, l_extendedprice AS price, l_returnflag = 'N' AS ok, l_shipdate FROM lineitem),
c AS (SELECT receipt, ingredient, unit, count(*) > 1 AS conflict FROM p GROUP BY ALL)"""


@query(_PU + """ SELECT ingredient, unit, conflict, CASE WHEN unit = 'sack' THEN 'review' ELSE 'converted' END AS unit_status, count(*) AS rows, sum(CASE WHEN unit = 'Box' THEN quantity * 12 WHEN unit = 'kg' THEN quantity END)::DOUBLE AS base_quantity, count_if(ok AND NOT conflict)::BIGINT AS counted FROM p JOIN c USING (receipt, ingredient, unit) GROUP BY ALL""")
def restaurant_purchases(t):
    """Lines as purchases in boxes of 12 kg, in kg, and in sacks that nobody can convert."""
    l = t.lineitem
    unit = F.when(F.col("l_linenumber") % 3 == 0, "Box").when(F.col("l_linenumber") % 3 == 1, "kg").otherwise("sack")
    p = l.select(F.col("l_shipdate").alias("day"), F.concat(F.lit("R"), "l_orderkey").alias("receipt"), F.lit("s").alias("store"), F.col("l_partkey").cast("string").alias("ingredient"), F.col("l_quantity").alias("quantity"), unit.alias("unit"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_returnflag") == "N", "已入库").otherwise("待验收").alias("status"))
    m = t.part.select(F.col("p_partkey").cast("string").alias("ingredient"), F.lit("box").alias("purchase_unit"), F.lit("KG").alias("base_unit"), F.lit(12.0).alias("factor"), F.col("p_retailprice").alias("standard_price"))
    out = restaurant.purchases(p, m)
    return out.groupBy("ingredient", "unit", "conflict", "unit_status").agg(F.count("*").alias("rows"), F.sum("base_quantity").alias("base_quantity"), F.count_if("counted").alias("counted"))


@query("""WITH r AS (SELECT l_orderkey AS o, sum(l_extendedprice::DECIMAL(18,2)) AS refund FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), v AS (SELECT o_orderkey AS o, o_orderkey % 5 + 1 AS score FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT o AS order_no, CASE WHEN score IS NULL THEN 'lone_refund' ELSE 'review' END AS record, CASE WHEN score IS NULL THEN 'no_review' WHEN refund IS NULL THEN 'no_refund' ELSE 'matched' END AS match, refund::DOUBLE AS refund, CASE WHEN score IS NOT NULL THEN score < 4 END AS attention FROM v FULL JOIN r USING (o)""")
def restaurant_reviews(t):
    """All orders but urgent ones as reviews; returned lines as refunds."""
    v = t.orders.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderdate").alias("day"), F.lit("s").alias("store"), F.col("o_orderkey").alias("order_no"), (F.col("o_orderkey") % 5 + 1).alias("score"), F.lit("ok").alias("label"), F.lit("").alias("text"))
    r = t.lineitem.select(F.col("l_orderkey").alias("order_no"), F.col("l_extendedprice").alias("amount"), F.lit("k").alias("kind"), F.lit("r").alias("reason"), F.lit("w").alias("owner"), F.when(F.col("l_returnflag") == "R", "退款成功").otherwise("退款申请").alias("status"))
    return restaurant.reviews_with_refunds(v, r).select("order_no", "record", "match", F.col("refund").cast("double").alias("refund"), "attention")


@query("SELECT c_custkey AS application, c_acctbal <= 5000 AND c_acctbal <= 100 * (c_custkey % 80) AS applied FROM customer")
def receipts_applied(t):
    """One application for each customer, of a receipt of 5000 to a document of its own size."""
    c = t.customer
    r = c.select(F.col("c_custkey").alias("receipt"), F.lit(5000.0).alias("amount"))
    d = c.select(F.col("c_custkey").alias("document"), (F.col("c_custkey") % 80 * 100.0).alias("amount"))
    return O.apply_receipts(r, d, c.select(F.col("c_custkey").alias("application"), F.col("c_custkey").alias("receipt"), F.col("c_custkey").alias("document"), F.col("c_acctbal").alias("amount")))


@query("""WITH p AS (SELECT l_partkey AS entry, max(l_quantity) AS a, CASE WHEN l_partkey % 9 <> 0 THEN min(l_linenumber) END AS b, bool_or(l_linestatus = 'F') AS f, bool_or(l_returnflag = 'R') AS g FROM lineitem GROUP BY l_partkey),
z AS (SELECT CASE WHEN max(a) <= 1.05 THEN 100 WHEN max(a) <= 5.05 THEN 20 WHEN max(a) <= 10.05 THEN 10 ELSE 1 END AS za, CASE WHEN max(b) <= 1.05 THEN 100 WHEN max(b) <= 5.05 THEN 20 WHEN max(b) <= 10.05 THEN 10 ELSE 1 END AS zb FROM p),
s AS (SELECT entry, a * za AS x, b * zb AS y, CASE WHEN f THEN 8.0 ELSE 0 END + CASE WHEN g THEN 1.0 ELSE 0 END AS penalty, CASE WHEN NOT g THEN 1.5 ELSE 0 END AS bonus FROM p, z),
r AS (SELECT *, coalesce(y, x) AS latest, CASE WHEN y IS NULL THEN x ELSE (x + y) / 2 END AS mean, CASE WHEN y IS NULL THEN 1 ELSE 2 END AS rounds FROM s),
q AS (SELECT *, round(0.7 * mean + 0.3 * latest - penalty - (1 - rounds / 2.0) * 5 + bonus, 8)::DOUBLE AS score FROM r)
SELECT entry, score, penalty::DOUBLE AS penalty, CASE WHEN penalty >= 4 THEN 'medium' ELSE 'low' END AS risk, row_number() OVER (ORDER BY score DESC, latest DESC, mean DESC, rounds DESC, entry) AS position, row_number() OVER (ORDER BY score DESC, latest DESC, mean DESC, rounds DESC, entry) <= 8 AS selected FROM q""")
def selection(t):
    """Parts as entries: two rounds of scores on different scales, the second with gaps, and comments in the words of the rules."""
    p = t.lineitem.groupBy(F.col("l_partkey").alias("entry")).agg(F.max("l_quantity").alias("a"), F.min("l_linenumber").alias("m"), F.when(F.bool_or(F.col("l_linestatus") == "F"), "主要结论有误").alias("note"), F.when(F.bool_or(F.col("l_returnflag") == "R"), "内容偏少").otherwise("完成度较高").alias("more"))
    p = p.withColumn("b", F.when(F.col("entry") % 9 != 0, F.col("m")))
    out = S.selection(p, "entry", ["a", "b"], ["note", "more"])
    return out.select("entry", "score", "penalty", "risk", F.col("position").cast("long").alias("position"), "selected")


@query("SELECT event_type, count(*) AS events FROM (SELECT DISTINCT event_id, ts, user_id, event_type, value, props FROM events) GROUP BY 1")
def events_once(t):
    """Events written twice count once."""
    e = t.events
    return dedup.deduplicate_events(e.union(e.where("user_id % 3 = 0")), ["event_id"]).groupBy("event_type").agg(F.count("*").alias("events"))


@query("SELECT n_nationkey, n_name FROM nation")
def unique_master(t):
    return dedup.unique_master(t.nation.union(t.nation), ["n_nationkey"]).select("n_nationkey", "n_name")


@query("SELECT o_orderkey, 1::BIGINT AS kept, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS rejected FROM (SELECT DISTINCT o_orderkey FROM orders)")
def guarded_dedup(t):
    """Every fourth order is written twice: the first stays, the other is rejected."""
    o = t.orders.select("o_orderkey", "o_totalprice")
    out = dedup.guarded_dedup(o.union(o.where("o_orderkey % 4 = 0")), ["o_orderkey"])
    n = lambda k: out[k].groupBy("o_orderkey").agg(F.count("*").alias({"primary": "kept"}.get(k, k)))
    return n("primary").join(n("rejected"), "o_orderkey", "left").select("o_orderkey", "kept", F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"))


@query("SELECT p_partkey, 'p_name' AS column_name, p_name AS value FROM part WHERE length(p_name) > 12")
def long_texts(t):
    return clean.long_text_details(t.part.select("p_partkey", "p_name"), "p_partkey", 12)


@query("SELECT c_custkey AS key, c_nationkey::DOUBLE AS x, c_acctbal AS y FROM customer")
def chart_scatter(t):
    """More points are allowed than there are."""
    return charts.scatter(t.customer, "c_nationkey", "c_acctbal", "c_custkey", 10_000_000)


def _commerce(t):
    """Lines as order lines of five channels, one refund for each order, settlements and advertising by month and channel, stock by part."""
    key = [F.col("l_orderkey").alias("order_no"), F.col("o_orderpriority").alias("channel"), F.col("o_custkey").alias("customer")]
    price = X.money("l_extendedprice")
    cut = (price * X.money("l_discount")).cast("decimal(18,2)")
    orders = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderdate").alias("day"), *key, F.col("l_partkey").alias("sku"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), price.alias("list_price"), cut.alias("discount"), (price - cut).alias("paid"), F.when(F.col("l_returnflag") == "A", "已取消").otherwise("交易完成").alias("status"))
    products = t.part.select(F.col("p_partkey").alias("sku"), F.lit("goods").alias("kind"), (F.col("p_size") * 0.25).alias("unit_cost"), F.col("p_size").alias("safety"))
    refunds = t.orders.select(F.date_add("o_orderdate", 20).alias("day"), F.col("o_orderkey").alias("refund_no"), F.col("o_orderkey").alias("order_no"), F.lit(None).cast("bigint").alias("sku"), (X.money("o_totalprice") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)").alias("amount"), F.when(F.col("o_orderstatus") == "F", "退款成功").otherwise("退款申请").alias("status"))
    g = t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.col("o_orderpriority").alias("channel")).agg(F.sum(X.money("o_totalprice")).alias("base"), F.count("*").cast("decimal(18,2)").alias("n"))
    part = lambda k: (F.col("n") * k).cast("decimal(18,2)")
    settlements = g.select("month", "channel", "base", part(3).alias("commission"), part(2).alias("service"), part(1).alias("logistics"), part(10).alias("refund_offset"), (F.col("base") - part(16)).alias("received"))
    ads = g.select("month", "channel", part(50).alias("spend"), part(400).alias("attributed"))
    stock = t.part.select(F.lit("2001-12-01").cast("date").alias("month"), F.col("p_partkey").alias("sku"), (F.col("p_size") * 10).alias("sellable"), F.lit(1.0).alias("value"))
    return commerce.diagnosis(products, orders, refunds, settlements, ads, stock)


_CO = """WITH l AS (SELECT o_orderkey AS o, o_orderpriority AS channel, o_custkey AS customer, l_partkey AS sku, l_linenumber AS n, l_quantity AS quantity, date_trunc('month', o_orderdate)::DATE AS month, l_extendedprice::DECIMAL(18,2) AS lp,
(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(18,2))::DECIMAL(18,2) AS cut, l_returnflag = 'A' AS gone FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d AS (SELECT DISTINCT * FROM l WHERE NOT gone), s AS (SELECT d.*, lp - cut AS paid, (quantity::DECIMAL(12,2) * (p_size * 0.25)::DECIMAL(18,2))::DECIMAL(18,2) AS cost FROM d JOIN part ON p_partkey = sku),
w AS (SELECT DISTINCT o, channel, customer, month FROM s), q AS (SELECT o_orderkey AS o, date_trunc('month', o_orderdate + INTERVAL 20 DAY)::DATE AS rm, (o_totalprice::DECIMAL(18,2) * 0.01::DECIMAL(3,2))::DECIMAL(18,2) AS amount, o_orderstatus = 'F' AS ok FROM orders),
r AS (SELECT q.*, w.channel, w.customer, w.month FROM q LEFT JOIN w USING (o) WHERE ok), g AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS channel, sum(o_totalprice::DECIMAL(18,2)) AS base, count(*)::DECIMAL(18,2) AS n FROM orders GROUP BY 1, 2)"""


@query(_CO + """, a AS (SELECT channel, sum(paid) AS paid, count(DISTINCT o) AS orders, sum(cost) AS cost FROM s GROUP BY 1), b AS (SELECT channel, sum(amount) AS refund FROM r WHERE channel IS NOT NULL GROUP BY 1), c AS (SELECT channel, sum(n) AS n, sum(base) AS base FROM g GROUP BY 1)
SELECT channel, paid::DOUBLE AS paid, orders, coalesce(refund, 0)::DOUBLE AS refund, (n * 6)::DOUBLE AS fees, (base - n * 16)::DOUBLE AS received, (base - n * 16 - cost - n * 50)::DOUBLE AS contribution, round(coalesce(refund, 0)::DOUBLE / paid::DOUBLE, 8) AS refund_rate, 8.0::DOUBLE AS roas,
CASE WHEN base - n * 16 - cost - n * 50 < 0 THEN 'P0' WHEN (base - n * 16 - cost - n * 50)::DOUBLE / (SELECT sum(paid)::DOUBLE FROM a) < 0.03 THEN 'P1' ELSE 'P2' END AS priority FROM a JOIN c USING (channel) LEFT JOIN b USING (channel)""")
def commerce_channels(t):
    out = _commerce(t)["channels"]
    return out.select("channel", "orders", "priority", F.round("refund_rate", 8).alias("refund_rate"), F.round("roas", 8).alias("roas"), *[F.col(c).cast("double").alias(c) for c in ("paid", "refund", "fees", "received", "contribution")])


@query(_CO + """, a AS (SELECT month, sum(paid) AS paid, sum(cost) AS cost FROM s GROUP BY 1), b AS (SELECT rm AS month, sum(amount) AS refund FROM r GROUP BY 1), c AS (SELECT month, sum(n) AS n, sum(base) AS base FROM g GROUP BY 1)
SELECT month, coalesce(paid, 0)::DOUBLE AS paid, coalesce(refund, 0)::DOUBLE AS refund, (coalesce(paid, 0) - coalesce(refund, 0) - coalesce(cost, 0))::DOUBLE AS gross, coalesce(base - n * 16, 0)::DOUBLE AS received FROM a FULL JOIN b USING (month) FULL JOIN c USING (month)""")
def commerce_months(t):
    return _commerce(t)["months"].select("month", *[F.col(c).cast("double").alias(c) for c in ("paid", "refund", "gross", "received")])


@query(_CO + """, a AS (SELECT month, sum(paid) AS paid, sum(cost) AS cost FROM s GROUP BY 1), b AS (SELECT month, sum(amount) AS refund FROM r WHERE month IS NOT NULL GROUP BY 1)
SELECT month, coalesce(paid, 0)::DOUBLE AS paid, coalesce(refund, 0)::DOUBLE AS refund, (paid - coalesce(refund, 0) - cost)::DOUBLE AS gross FROM a FULL JOIN b USING (month)""")
def commerce_order_months(t):
    return _commerce(t)["order_months"].select("month", *[F.col(c).cast("double").alias(c) for c in ("paid", "refund", "gross")])


@query(_CO + """ SELECT sku, sum(paid)::DOUBLE AS paid, sum(paid - cost)::DOUBLE AS gross, round(sum(cut)::DOUBLE / sum(lp)::DOUBLE, 8) AS discount_rate, CASE WHEN sum(paid - cost) < 0 THEN 'P0' WHEN sum(paid - cost)::DOUBLE / sum(paid)::DOUBLE < 0.2 THEN 'P1' ELSE 'P2' END AS priority FROM s GROUP BY 1""")
def commerce_products(t):
    return _commerce(t)["products"].select("sku", "priority", F.round("discount_rate", 8).alias("discount_rate"), *[F.col(c).cast("double").alias(c) for c in ("paid", "gross")])


@query(_CO + """, a AS (SELECT customer, sum(paid) AS paid, count(DISTINCT o) AS orders FROM s GROUP BY 1), b AS (SELECT customer, sum(amount) AS refund FROM r WHERE customer IS NOT NULL GROUP BY 1)
SELECT customer, orders, paid::DOUBLE AS paid, coalesce(refund, 0)::DOUBLE AS refund, CASE WHEN coalesce(refund, 0)::DOUBLE / paid::DOUBLE >= 0.4 THEN 'P0' WHEN coalesce(refund, 0)::DOUBLE / paid::DOUBLE >= 0.2 THEN 'P1' ELSE 'P2' END AS priority FROM a LEFT JOIN b USING (customer)""")
def commerce_customers(t):
    return _commerce(t)["customers"].select("customer", "orders", "priority", *[F.col(c).cast("double").alias(c) for c in ("paid", "refund")])


@query(_CO + """, u AS (SELECT sku, sum(quantity) AS units FROM s WHERE month = (SELECT max(month) FROM s) GROUP BY 1)
SELECT p_partkey AS sku, coalesce(units, 0)::DOUBLE AS units, (p_size * 9)::BIGINT AS above_safety, CASE WHEN units > 0 THEN round(p_size * 10 / units, 8) END AS months_left, CASE WHEN p_size * 10 / units >= 18 THEN 'P0' WHEN p_size * 10 / units >= 9 THEN 'P1' ELSE 'P2' END AS priority FROM part LEFT JOIN u ON sku = p_partkey""")
def commerce_inventory(t):
    return _commerce(t)["inventory"].select("sku", "priority", F.col("units").cast("double").alias("units"), F.col("above_safety").cast("long").alias("above_safety"), F.round("months_left", 8).alias("months_left"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS channel, (count(*) * 6)::DOUBLE AS fees, 0.0::DOUBLE AS gap FROM orders GROUP BY 1, 2")
def commerce_settlements(t):
    return _commerce(t)["settlements"].select("month", "channel", F.col("fees").cast("double").alias("fees"), F.col("gap").cast("double").alias("gap"))


@query("SELECT o_orderkey AS order_no FROM orders WHERE o_orderstatus <> 'F'")
def commerce_pending(t):
    return _commerce(t)["pending"].select("order_no")


@query(_CO + """ SELECT (SELECT sum(paid) FROM s)::DOUBLE AS paid, (SELECT sum(amount) FROM r)::DOUBLE AS refund, (SELECT sum(amount) FROM q WHERE NOT ok)::DOUBLE AS pending_refund, ((SELECT sum(paid - cost) FROM s) - (SELECT sum(amount) FROM r))::DOUBLE AS gross, (SELECT sum(base - n * 66) FROM g)::DOUBLE - (SELECT sum(cost) FROM s)::DOUBLE AS contribution""")
def commerce_totals(t):
    return _commerce(t)["primary"].select(*[F.col(c).cast("double").alias(c) for c in ("paid", "refund", "pending_refund", "gross", "contribution")])
