"""Facts of one business period under a declared policy, made of the star tables; the SQL states each output from the raw rows."""

from datetime import date

from pyspark.sql import functions as F

from tabloom.reports.multifact import MultiFact, Policy

from . import query

POLICY = Policy(date(1996, 1, 1), date(1999, 12, 31), ("done", "paid"), ("cancelled",), stock_multiplier=2.0, ar_ratio=0.3)


def _dec(c, scale=2):
    return F.col(c).cast(f"decimal(18,{scale})")


def _times(c, factor):
    """A share of an amount in whole cents."""
    return (_dec(c) * F.lit(factor).cast("decimal(3,2)")).cast("decimal(18,2)")


def _facts(t):
    """Rows come in another order than they were made in."""
    mixed = lambda df: df.orderBy(F.xxhash64(*[F.col(c) for c in df.columns]))
    day, text = lambda c: F.col(c).cast("date"), lambda c: F.col(c).cast("string")
    l, p, o, c = t.lineitem, t.part, t.orders, t.customer
    k = F.col("l_partkey") % 25
    status = F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "N", "paid").when(F.col("l_linenumber") % 2 == 0, "cancelled").otherwise("held")
    sales = l.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 3).alias("version"), day("l_shipdate").alias("day"), F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("n"), k)).otherwise(F.concat(F.lit("NATION_"), k)).alias("org_name"), F.col("l_partkey").alias("sku"), _dec("l_quantity", 4).alias("quantity"), _dec("l_extendedprice").alias("paid"), status.alias("status"), F.when(F.col("l_tax") >= 0.08, "box").otherwise("pc").alias("unit"), (F.col("l_orderkey") % 100).alias("customer"), F.concat("l_linestatus", F.col("l_linenumber") % 3).alias("channel"))
    products = p.where("p_partkey % 101 <> 7").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.lit("pc").alias("unit"), F.when(F.col("p_size") % 3 == 0, 6).when(F.col("p_size") % 3 == 1, 12).alias("per_case"), F.col("p_size").alias("safety"), F.lit(30).alias("target_days"))
    orgs = t.nation.where("n_nationkey < 24").select(F.col("n_nationkey").alias("org"), F.col("n_name").alias("name"), F.concat(F.lit("n"), "n_nationkey", F.lit("；x"), "n_nationkey").alias("aliases"))
    start = F.when(F.col("p_partkey") % 3 == 0, "1997-06-01").when(F.col("p_partkey") % 5 == 0, "1998-07-01").otherwise("1998-01-01")
    one = p.select(F.col("p_partkey").alias("sku"), F.lit("1990-01-01").cast("date").alias("start"), F.lit("1997-12-31").cast("date").alias("stop"), _times("p_retailprice", "0.5").alias("cost"))
    costs = one.union(p.select("p_partkey", start.cast("date"), F.lit(None).cast("date"), _times("p_retailprice", "0.6")))
    i = F.col("o_orderkey")
    refund = lambda rows, mark, share, seq: rows.select(F.concat(F.lit(mark), i).alias("refund_id"), i.alias("order_id"), F.when(i % 6 == 0, 1).alias("line"), F.date_add(day("o_orderdate"), 700).alias("day"), share.alias("amount"), F.when(i % 7 == 0, "退款申请").otherwise("退款成功").alias("status"), (i + seq).alias("seq"))
    refunds = refund(o.where("o_orderkey % 3 = 0"), "R", _times("o_totalprice", "0.2"), 0).union(refund(o.where("o_orderkey % 9 = 0"), "S", _times("o_totalprice", "0.1"), 10_000_000)).union(refund(o.where("o_orderkey % 51 = 0"), "R", _times("o_totalprice", "0.25"), 20_000_000))
    line = l.where("l_orderkey % 4 = 0").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"))
    single = line.agg(F.count("*").alias("n"), F.min("l_partkey").alias("sku"), F.min(F.col("l_tax") >= 0.08).alias("box"), F.min(day("l_shipdate")).alias("day"), F.min(_dec("l_quantity", 4)).alias("quantity")).where("n = 1")
    share = lambda mark, part, n: F.struct(F.lit(mark).alias("mark"), F.lit(part).cast("decimal(3,2)").alias("part"), F.lit(n).alias("n"))
    back = single.drop("n").withColumn("s", F.explode(F.array(share("X", "0.6", 1), share("Y", "0.5", 2), share("Z", "0.1", 3)))).select(F.concat("s.mark", "order_id", F.lit("-"), "line").alias("return_id"), "order_id", "line", "sku", F.when(F.col("box"), "box").otherwise("pc").alias("unit"), F.date_add("day", 10).alias("day"), F.ceil(F.col("quantity") * F.col("s.part")).alias("quantity"), F.when(F.col("order_id") % 16 == 0, "pending").otherwise("accepted").alias("status"), (F.col("order_id") * 100 + F.col("line") * 10 + F.col("s.n")).alias("seq"))
    bought = l.select(F.concat(F.lit("P"), "l_orderkey", F.lit("-"), "l_linenumber").alias("receipt_id"), k.alias("org"), F.col("l_partkey").alias("sku"), F.when(F.col("l_linenumber") % 3 == 0, "case").otherwise("pc").alias("unit"), day("l_shipdate").alias("day"), F.col("l_quantity").alias("quantity"), _times("l_extendedprice", "0.01").alias("price"), F.when(F.col("l_tax") >= 0.07, "USD").otherwise("CNY").alias("currency"), F.when(F.col("l_linestatus") == "F", "received").otherwise("open").alias("status"))
    q = F.col("p_partkey")
    stock = p.where("p_partkey % 41 <> 5").select((q % 25).alias("org"), q.alias("sku"), (F.col("p_size") + 500).alias("quantity"), F.when(q % 17 == 0, "1996-02-01").otherwise("1996-01-01").cast("date").alias("day"))
    adjusted = p.where("p_partkey % 4 = 0").select(q.alias("adjustment_id"), (q % 25).alias("org"), q.alias("sku"), F.lit("pc").alias("unit"), F.lit("1997-03-01").cast("date").alias("day"), (-F.col("p_size")).alias("quantity"), F.when(q % 8 == 0, "approved").otherwise("draft").alias("status"))
    count = lambda rows, gap, more: rows.select((q % 25).alias("org"), q.alias("sku"), F.date_sub(F.lit("1999-12-31").cast("date"), gap).alias("day"), (F.col("p_size") + more).alias("quantity"))
    counts = count(p.where("p_partkey % 2 = 0"), 0, 100).union(count(p, 30, 90)).union(count(p.where("p_partkey % 10 = 0"), 0, 70))
    settled = o.where("o_orderkey % 10 = 0").select(i.alias("settlement_id"), F.concat(F.when(F.col("o_orderstatus") == "F", "F").otherwise("O"), i % 3).alias("channel"), F.trunc(day("o_orderdate"), "month").alias("month"), _dec("o_totalprice").alias("base"), _times("o_totalprice", "0.05").alias("commission"), F.lit(3.5).alias("delivery"), F.when(i % 70 != 0, 1.25).alias("promotion"), F.lit(2).alias("offset"), (_dec("o_totalprice") - _times("o_totalprice", "0.05") - F.when(i % 30 == 0, F.lit("7.75")).otherwise(F.lit("6.75")).cast("decimal(4,2)")).cast("decimal(18,2)").alias("received"), F.date_add(day("o_orderdate"), 20).alias("arrives"), F.when(i % 20 == 0, "arrived").otherwise("open").alias("status"))
    n, bal = F.col("c_custkey"), F.abs(_dec("c_acctbal"))
    customers = c.select(n.alias("customer"), bal.alias("credit"), (n % 60).alias("term_days"))
    opening = c.select(F.concat(F.lit("A"), n).alias("document"), (n % 25).alias("org"), n.alias("customer"), bal.alias("amount"), F.date_add(F.lit("1999-10-01").cast("date"), (n % 180).cast("int")).alias("due"))
    receipts = c.select(F.concat(F.lit("C"), n).alias("receipt"), (n % 25).alias("org"), (bal + 500).alias("amount"), F.when(n % 13 == 0, "USD").otherwise("CNY").alias("currency"), F.date_add(F.lit("1997-01-01").cast("date"), (n % 50).cast("int")).alias("day"), F.when(n % 11 == 0, "open").otherwise("arrived").alias("status"))
    use = lambda x, share: c.select(F.concat(F.lit(f"a{x}-"), n).alias("application"), F.concat(F.lit("C"), n).alias("receipt"), F.lit("opening").alias("kind"), F.concat(F.lit("A"), n).alias("document"), F.lit(None).cast("int").alias("line"), (bal * F.lit(share).cast("decimal(3,2)")).cast("decimal(18,2)").alias("amount"), F.date_add(F.lit("1997-01-20").cast("date"), F.when(n % 9 == 0, 0).otherwise(60)).alias("day"), (n * 10 + x).alias("seq"))
    sold = sales.where("order_id % 50 = 0").groupBy("order_id", "line").agg(F.max("day").alias("d"), F.max("paid").alias("paid"), F.max("sku").alias("sku"))
    sold = sold.select(F.concat(F.lit("s"), "order_id", F.lit("-"), "line"), F.concat(F.lit("C"), F.col("sku") % 25), F.lit("sale"), text("order_id"), F.col("line"), _times("paid", "0.02"), F.date_add("d", 800), F.col("order_id") * 10 + F.col("line") + 100_000_000)
    made = {"sales": sales, "products": products, "orgs": orgs, "costs": costs, "refunds": refunds, "returns": back, "purchases": bought, "opening_stock": stock, "adjustments": adjusted, "counts": counts, "settlements": settled, "customers": customers, "opening_ar": opening, "receipts": receipts, "applications": use(1, "0.6").union(use(2, "0.5")).union(use(3, "0.3")).union(sold)}
    return MultiFact({name: mixed(df) if name in ("refunds", "returns", "applications") else df for name, df in made.items()}, POLICY)


def _d(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


_SALES = """WITH s AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey % 3 AS version, l_shipdate::DATE AS day, CASE WHEN l_suppkey % 4 = 0 THEN 'n' ELSE 'NATION_' END || (l_partkey % 25) AS org_name, l_partkey AS sku, l_quantity::DECIMAL(18,4) AS quantity, l_extendedprice::DECIMAL(18,2) AS paid,
  CASE WHEN l_returnflag = 'A' THEN 'done' WHEN l_returnflag = 'N' THEN 'paid' WHEN l_linenumber % 2 = 0 THEN 'cancelled' ELSE 'held' END AS status, CASE WHEN l_tax >= 0.08 THEN 'box' ELSE 'pc' END AS unit, l_orderkey % 100 AS customer, l_linestatus || (l_linenumber % 3) AS channel FROM lineitem),
u AS (SELECT DISTINCT * FROM s), t AS (SELECT *, max(version) OVER (PARTITION BY order_id, line) AS top, count(*) OVER (PARTITION BY order_id, line) AS every FROM u),
w AS (SELECT *, count(*) OVER (PARTITION BY order_id, line) AS n, row_number() OVER (PARTITION BY order_id, line ORDER BY channel) AS nth FROM t WHERE version = top),
z AS (SELECT order_id, line, count(DISTINCT (sku, day, org_name, quantity, paid, status, unit, customer)) AS kinds FROM w GROUP BY 1, 2),
v AS (SELECT w.*, sku % 25 AS org, CASE WHEN status = 'cancelled' THEN 'bad_status' WHEN status = 'held' THEN 'unknown_status' WHEN sku % 101 = 7 THEN 'unknown_product' WHEN day NOT BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' THEN 'outside_period' WHEN sku % 25 = 24 THEN 'unknown_org' WHEN unit <> 'pc' THEN 'other_unit' END AS reason FROM w JOIN z USING (order_id, line) WHERE kinds = 1 AND nth = 1),
k AS (SELECT p_partkey AS sku, DATE '1990-01-01' AS a, DATE '1997-12-31' AS b, (p_retailprice::DECIMAL(18,2) * 0.5)::DECIMAL(18,2) AS cost FROM part UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN DATE '1997-06-01' WHEN p_partkey % 5 = 0 THEN DATE '1998-07-01' ELSE DATE '1998-01-01' END, DATE '9999-01-01', (p_retailprice::DECIMAL(18,2) * 0.6)::DECIMAL(18,2) FROM part),
c AS (SELECT order_id, line, CASE WHEN count(*) = 1 THEN max(cost) END AS unit_cost FROM v JOIN k ON k.sku = v.sku AND day BETWEEN a AND b WHERE reason IS NULL GROUP BY 1, 2),
g AS MATERIALIZED (SELECT v.*, unit_cost, round(quantity * unit_cost::DECIMAL(18,4), 2)::DECIMAL(18,2) AS cost, strftime(day, '%Y-%m') AS month FROM v LEFT JOIN c USING (order_id, line) WHERE reason IS NULL)"""

_REFUNDS = f"""{_SALES}, r0 AS (SELECT 'R' || o_orderkey AS refund_id, o_orderkey AS o, o_orderdate::DATE + 700 AS day, (o_totalprice::DECIMAL(18,2) * 0.2)::DECIMAL(18,2) AS amount, o_orderkey AS seq FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 'S' || o_orderkey, o_orderkey, o_orderdate::DATE + 700, (o_totalprice::DECIMAL(18,2) * 0.1)::DECIMAL(18,2), o_orderkey + 10000000 FROM orders WHERE o_orderkey % 9 = 0
  UNION ALL SELECT 'R' || o_orderkey, o_orderkey, o_orderdate::DATE + 700, (o_totalprice::DECIMAL(18,2) * 0.25)::DECIMAL(18,2), o_orderkey + 20000000 FROM orders WHERE o_orderkey % 51 = 0),
r1 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY refund_id) > 1 THEN 'key_conflict' WHEN o % 7 = 0 THEN 'not_confirmed' WHEN day > DATE '1999-12-31' THEN 'after_cutoff' END AS reason FROM r0),
q0 AS (SELECT refund_id, seq, o, line, paid, amount, r1.day AS rday, g.day AS gday, (amount * 100)::HUGEINT AS u, (paid * 100)::HUGEINT AS w FROM r1 JOIN g ON g.order_id = o AND (o % 6 <> 0 OR line = 1) WHERE r1.reason IS NULL),
q1 AS (SELECT *, sum(w) OVER p AS tw, bool_or(rday < gday) OVER p AS early, row_number() OVER (PARTITION BY refund_id ORDER BY line) AS n, count(*) OVER p AS m FROM q0 WINDOW p AS (PARTITION BY refund_id)),
q2 AS (SELECT *, least(u, sum((2 * u * w + tw) // (2 * tw)) OVER (PARTITION BY refund_id ORDER BY line)) AS c FROM q1),
q3 AS (SELECT *, CASE WHEN n = m THEN u ELSE c END - coalesce(lag(c) OVER (PARTITION BY refund_id ORDER BY line), 0) AS share FROM q2),
e1 AS (SELECT refund_id, o, bool_and(share <= w) AS fits FROM q3 WHERE refund_id LIKE 'R%' AND NOT early GROUP BY 1, 2),
e2 AS (SELECT b.refund_id, b.o, bool_and(b.share <= b.w - coalesce(CASE WHEN e1.fits THEN a.share END, 0)) AS fits FROM q3 b LEFT JOIN q3 a ON a.refund_id = 'R' || b.o AND a.line = b.line LEFT JOIN e1 ON e1.refund_id = a.refund_id WHERE b.refund_id LIKE 'S%' AND NOT b.early GROUP BY 1, 2),
rr AS MATERIALIZED (SELECT r1.refund_id, o AS order_id, r1.day, amount, coalesce(r1.reason, CASE WHEN x.early IS NULL THEN 'orphan' WHEN x.early THEN 'before_sale' WHEN NOT coalesce(e1.fits, e2.fits) THEN 'above_paid' END) AS reason FROM r1 LEFT JOIN (SELECT refund_id, bool_or(early) AS early FROM q3 GROUP BY 1) x USING (refund_id) LEFT JOIN e1 USING (refund_id, o) LEFT JOIN e2 USING (refund_id, o)),
rs AS (SELECT o AS order_id, line, sum(share)::DECIMAL(18,2) / 100 AS refund FROM q3 JOIN rr USING (refund_id) WHERE reason IS NULL GROUP BY 1, 2)"""

_RETURNS = """b0 AS (SELECT order_id, line, min(sku) AS sku, min(quantity) AS q, min(unit) AS unit, min(day) AS day FROM s WHERE order_id % 4 = 0 GROUP BY 1, 2 HAVING count(*) = 1),
b1 AS (SELECT b0.*, g.unit_cost, CASE WHEN order_id % 16 = 0 OR b0.day + 10 NOT BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' THEN 'not_accepted' WHEN g.sku IS NULL THEN 'no_such_sale' END AS reason, ceil(q * 0.6) AS x, ceil(q * 0.5) AS y, ceil(q * 0.1) AS z FROM b0 LEFT JOIN g USING (order_id, line)),
b2 AS (SELECT *, x + y <= q AS yes, x + CASE WHEN x + y <= q THEN y ELSE 0 END + z <= q AS zes FROM b1),
b3 AS (SELECT 'X' || order_id || '-' || line AS return_id, order_id, line, x AS quantity, unit_cost, reason FROM b2 UNION ALL SELECT 'Y' || order_id || '-' || line, order_id, line, y, unit_cost, coalesce(reason, CASE WHEN NOT yes THEN 'above_sold' END) FROM b2 UNION ALL SELECT 'Z' || order_id || '-' || line, order_id, line, z, unit_cost, coalesce(reason, CASE WHEN NOT zes THEN 'above_sold' END) FROM b2),
bb AS MATERIALIZED (SELECT *, CASE WHEN reason IS NULL THEN round(quantity::DECIMAL(18,4) * unit_cost::DECIMAL(18,4), 2)::DECIMAL(18,2) END AS reversal FROM b3)"""

_NET = f"""{_REFUNDS}, {_RETURNS}, bs AS (SELECT order_id, line, CASE WHEN count(reversal) = count(*) THEN sum(reversal) END AS back, true AS any_back FROM bb WHERE reason IS NULL GROUP BY 1, 2),
f AS MATERIALIZED (SELECT g.*, coalesce(rs.refund, 0)::DECIMAL(18,2) AS refund, (CASE WHEN any_back THEN back ELSE 0 END)::DECIMAL(18,2) AS reversal, paid - coalesce(rs.refund, 0)::DECIMAL(18,2) AS net, paid - coalesce(rs.refund, 0)::DECIMAL(18,2) - cost + CASE WHEN any_back THEN back ELSE 0 END AS margin FROM g LEFT JOIN rs USING (order_id, line) LEFT JOIN bs USING (order_id, line))"""


@query(f"""{_SALES}, x AS (SELECT order_id, line, 'copy' AS reason, count(*) - (SELECT count(*) FROM u WHERE u.order_id = s.order_id AND u.line = s.line) AS rows FROM s GROUP BY 1, 2
UNION ALL SELECT order_id, line, 'superseded', count(*) FILTER (version < top) FROM t GROUP BY 1, 2 UNION ALL SELECT order_id, line, CASE WHEN kinds > 1 THEN 'conflict' ELSE 'repeated' END, any_value(n) - CASE WHEN kinds > 1 THEN 0 ELSE 1 END FROM w JOIN z USING (order_id, line) GROUP BY 1, 2, kinds
UNION ALL SELECT order_id, line, reason, 1 FROM v WHERE reason IS NOT NULL UNION ALL SELECT order_id, line, 'no_cost', 1 FROM g WHERE unit_cost IS NULL) SELECT order_id, line, reason, CAST(rows AS BIGINT) AS rows FROM x WHERE rows > 0""")
def multifact_excluded(t):
    return _facts(t).excluded_sales


@query(f"{_NET} SELECT order_id, line, CAST(org AS BIGINT) AS org, sku::VARCHAR AS sku, month, paid::DOUBLE AS paid, cost::DOUBLE AS cost, refund::DOUBLE AS refund, reversal::DOUBLE AS reversal, net::DOUBLE AS net, margin::DOUBLE AS margin FROM f")
def multifact_sales(t):
    s = _d(_facts(t).sales, "paid", "cost", "refund", "reversal", "net", "margin")
    return s.select("order_id", "line", F.col("org").cast("long").alias("org"), "sku", "month", "paid", "cost", "refund", "reversal", "net", "margin")


@query(f"{_REFUNDS} SELECT refund_id, order_id, amount::DOUBLE AS amount, reason FROM rr")
def multifact_refunds(t):
    return _d(_facts(t).refunds, "amount").select("refund_id", "order_id", "amount", "reason")


@query(f"{_SALES}, {_RETURNS} SELECT return_id, quantity::DOUBLE AS quantity, reversal::DOUBLE AS reversal, reason FROM bb")
def multifact_returns(t):
    return _d(_facts(t).returns, "quantity", "reversal").select("return_id", "quantity", "reversal", "reason")


_BOUGHT = """p0 AS (SELECT DISTINCT 'P' || l_orderkey || '-' || l_linenumber AS receipt_id, l_partkey % 25 AS org, l_partkey AS sku, CASE WHEN l_linenumber % 3 = 0 THEN 'case' ELSE 'pc' END AS unit, l_shipdate::DATE AS day, l_quantity::DECIMAL(18,4) AS quantity, (l_extendedprice::DECIMAL(18,2) * 0.01)::DECIMAL(18,2) AS price, l_tax >= 0.07 AS usd, l_linestatus = 'F' AND l_shipdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AS there FROM lineitem),
p1 AS (SELECT p0.*, count(*) FILTER (there) OVER (PARTITION BY receipt_id, org, p0.sku, unit) AS n, CASE WHEN unit = 'pc' THEN 1 WHEN p_size % 3 = 0 THEN 6 WHEN p_size % 3 = 1 THEN 12 END AS factor FROM p0 JOIN part ON p_partkey = p0.sku),
pp AS (SELECT *, CASE WHEN NOT there THEN 'not_received' WHEN n > 1 THEN 'key_conflict' WHEN sku % 101 = 7 OR factor IS NULL THEN 'unit_unclear' END AS reason FROM p1)"""


@query(f"WITH {_BOUGHT} SELECT receipt_id, sku::VARCHAR AS sku, unit, CASE WHEN reason IS NULL THEN (quantity * factor)::DOUBLE END AS pieces, CASE WHEN reason IS NULL AND NOT usd THEN round(quantity * price, 2)::DOUBLE END AS cash, reason FROM pp")
def multifact_purchases(t):
    return _d(_facts(t).purchases, "pieces", "cash").drop("org")


@query(f"""{_SALES}, {_RETURNS}, {_BOUGHT}, m AS (SELECT org, sku, 'b' AS kind, quantity * factor AS q FROM pp WHERE reason IS NULL UNION ALL SELECT org, sku, 's', quantity FROM g UNION ALL SELECT g.org, g.sku, 'r', bb.quantity FROM bb JOIN g USING (order_id, line) WHERE bb.reason IS NULL UNION ALL SELECT p_partkey % 25, p_partkey, 'a', -p_size FROM part WHERE p_partkey % 8 = 0 AND p_partkey % 101 <> 7),
n AS (SELECT org, sku, coalesce(sum(q) FILTER (kind = 'b'), 0) AS bought, coalesce(sum(q) FILTER (kind = 's'), 0) AS sold, coalesce(sum(q) FILTER (kind = 'r'), 0) AS returned, coalesce(sum(q) FILTER (kind = 'a'), 0) AS adjusted FROM m GROUP BY 1, 2),
o AS (SELECT p_partkey % 25 AS org, p_partkey AS sku, p_size + 500 AS opening, p_partkey % 17 = 0 AS late FROM part WHERE p_partkey % 41 <> 5),
y AS (SELECT org, sku, string_agg(why, '; ' ORDER BY why) AS why FROM (SELECT DISTINCT org, sku, 'purchase_' || reason AS why FROM pp WHERE reason IN ('key_conflict', 'unit_unclear')) GROUP BY 1, 2),
j AS (SELECT coalesce(o.org, n.org) AS org, coalesce(o.sku, n.sku) AS sku, opening, coalesce(bought, 0) AS bought, coalesce(sold, 0) AS sold, coalesce(returned, 0) AS returned, coalesce(adjusted, 0) AS adjusted, concat_ws('; ', CASE WHEN opening IS NULL THEN 'no_opening' END, CASE WHEN late THEN 'opening_date' END, why) AS unclear FROM o FULL JOIN n ON o.org = n.org AND o.sku = n.sku LEFT JOIN y ON y.org = coalesce(o.org, n.org) AND y.sku = coalesce(o.sku, n.sku)),
l AS (SELECT *, (coalesce(opening, 0) + bought - sold + returned + adjusted) AS known FROM j), h AS (SELECT l.*, CASE WHEN unclear = '' THEN known END AS closing, CASE WHEN sku % 101 <> 7 THEN p_size END AS safety, CASE WHEN sku % 101 <> 7 THEN (p_retailprice::DECIMAL(18,2) * 0.6)::DECIMAL(18,2) END AS unit_cost, p_size FROM l JOIN part ON p_partkey = sku),
i AS (SELECT *, CASE WHEN sold > 0 THEN greatest(closing, 0)::DOUBLE * 1461 / sold::DOUBLE + closing::DOUBLE * 0 END AS cover FROM h)
SELECT org::VARCHAR AS org, sku::VARCHAR AS sku, opening::DOUBLE AS opening, bought::DOUBLE AS bought, sold::DOUBLE AS sold, returned::DOUBLE AS returned, known::DOUBLE AS known, closing::DOUBLE AS closing, unclear, round(closing * unit_cost, 2)::DOUBLE AS value, round(cover, 6) AS cover_days, CASE WHEN sku % 10 = 0 THEN NULL WHEN sku % 2 = 0 THEN p_size + 100 ELSE p_size + 90 END::DOUBLE AS counted,
CASE WHEN sku % 2 = 0 AND sku % 10 <> 0 THEN p_size + 100 - closing END::DOUBLE AS count_gap, CASE WHEN sku % 10 = 0 THEN 'conflict' WHEN sku % 2 = 0 THEN 'at_cutoff' ELSE 'other_day' END AS count_basis,
CASE WHEN closing IS NULL THEN 'unclear' WHEN closing < 0 THEN 'negative' WHEN closing < safety THEN 'below_safety' WHEN sku % 101 <> 7 AND cover > 60 THEN 'overstock' WHEN sold = 0 AND closing > 0 THEN 'no_sales' ELSE 'normal' END AS status FROM i""")
def multifact_stock(t):
    s = _d(_facts(t).stock, "opening", "bought", "sold", "returned", "known", "closing", "value", "counted", "count_gap")
    return s.withColumn("cover_days", F.round("cover_days", 6)).drop("adjusted", "unit_cost", "counted_on")


_CASH = f"""{_NET.replace("WITH s AS", "WITH RECURSIVE s AS", 1)}, cu AS (SELECT c_custkey AS n, abs(c_acctbal::DECIMAL(18,2)) AS bal FROM customer),
docs AS (SELECT 'A' || n AS doc, 'opening' AS kind, n % 25 AS org, bal AS base, NULL::DATE AS since, DATE '1999-10-01' + (n % 180)::INT AS due FROM cu UNION ALL SELECT order_id || '|' || line, 'sale', org, net, day, day + (customer % 60)::INT FROM f),
rc AS (SELECT 'C' || n AS receipt, n % 25 AS org, bal + 500 AS cash, DATE '1997-01-01' + (n % 50)::INT AS day, n % 13 <> 0 AND n % 11 <> 0 AS there FROM cu),
a0 AS (SELECT 'a' || x || '-' || n AS application, 'C' || n AS receipt, 'A' || n AS doc, (bal * share)::DECIMAL(18,2) AS amount, CASE WHEN n % 9 = 0 THEN DATE '1997-01-20' ELSE DATE '1997-03-21' END AS day, n * 10 + x AS seq FROM cu, (VALUES (1, 0.6), (2, 0.5), (3, 0.3)) AS y(x, share)
  UNION ALL SELECT 's' || order_id || '-' || line, 'C' || (max(sku) % 25), order_id || '|' || line, (max(paid) * 0.02)::DECIMAL(18,2), max(day) + 800, order_id * 10 + line + 100000000 FROM s WHERE order_id % 50 = 0 GROUP BY order_id, line),
a1 AS (SELECT a0.*, rc.cash, docs.base, docs.org, CASE WHEN docs.doc IS NULL OR NOT coalesce(rc.there, false) OR a0.day > DATE '1999-12-31' THEN 'no_match' WHEN rc.org <> docs.org THEN 'other_org' WHEN a0.day < rc.day OR a0.day < docs.since THEN 'too_early' END AS reason FROM a0 LEFT JOIN rc USING (receipt) LEFT JOIN docs USING (doc)),
a2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY receipt ORDER BY seq) AS nth FROM a1 WHERE reason IS NULL),
a3 AS (SELECT receipt, 0::BIGINT AS nth, max(cash)::DECIMAL(18,2) AS room, '' AS doc, 0::DECIMAL(18,2) AS left_, '' AS application, false AS ok FROM a2 GROUP BY receipt
  UNION ALL SELECT y.receipt, y.nth, (y.room - CASE WHEN y.ok THEN y.amount ELSE 0 END)::DECIMAL(18,2), y.doc, (y.before - CASE WHEN y.ok THEN y.amount ELSE 0 END)::DECIMAL(18,2), y.application, y.ok FROM (SELECT a2.receipt, a2.nth, a3.room, a2.doc, a2.amount, a2.application, CASE WHEN a2.doc = a3.doc THEN a3.left_ ELSE a2.base END AS before, a2.amount <= a3.room AND a2.amount <= CASE WHEN a2.doc = a3.doc THEN a3.left_ ELSE a2.base END AS ok FROM a3 JOIN a2 ON a2.receipt = a3.receipt AND a2.nth = a3.nth + 1) y),
ap AS (SELECT a1.*, coalesce(a1.reason, CASE WHEN NOT a3.ok THEN 'above_room' END) AS why FROM a1 LEFT JOIN a3 ON a3.application = a1.application)"""


@query(f"{_CASH} SELECT application, receipt, amount::DOUBLE AS amount, why AS reason FROM ap")
def multifact_applications(t):
    return _d(_facts(t).applications, "amount").drop("org")


@query(f"{_CASH} SELECT replace(docs.doc, '|', '-') AS doc, kind, docs.org::VARCHAR AS org, docs.base::DOUBLE AS base, coalesce(sum(amount) FILTER (why IS NULL), 0)::DOUBLE AS applied, (docs.base - coalesce(sum(amount) FILTER (why IS NULL), 0))::DOUBLE AS closing, greatest(date_diff('day', due, DATE '1999-12-31'), 0)::BIGINT AS overdue_days FROM docs LEFT JOIN ap ON ap.doc = docs.doc GROUP BY docs.doc, kind, docs.org, docs.base, due")
def multifact_receivables(t):
    r = _d(_facts(t).receivables, "base", "applied", "closing")
    return r.select(F.when(F.col("line") == "", F.col("document")).otherwise(F.concat_ws("-", "document", "line")).alias("doc"), "kind", "org", "base", "applied", "closing", F.col("overdue_days").cast("long").alias("overdue_days"))


_SETTLED = """st AS (SELECT o_orderkey AS settlement_id, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END || (o_orderkey % 3) AS channel, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice::DECIMAL(18,2) AS base, (o_totalprice::DECIMAL(18,2) * 0.05)::DECIMAL(18,2) + 4.75 AS fees, CASE WHEN o_orderkey % 30 = 0 THEN 1.00 ELSE 0.00 END AS gap, o_orderkey % 20 = 0 AND o_orderdate::DATE + 20 <= DATE '1999-12-31' AS there FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 70 <> 0 AND date_trunc('month', o_orderdate) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')"""


@query(f"WITH {_SETTLED} SELECT settlement_id, channel, month, fees::DOUBLE AS fees, gap::DOUBLE AS gap, CASE WHEN there THEN 0 ELSE base - fees - 2 - gap END::DOUBLE AS to_come FROM st")
def multifact_settlements(t):
    return _d(_facts(t).settlements, "fees", "gap", "to_come").select("settlement_id", "channel", "month", "fees", "gap", "to_come")


@query(f"""{_NET}, {_SETTLED}, a AS (SELECT month, count(DISTINCT order_id) AS orders, sum(paid) AS paid, sum(refund) AS refund, sum(net) AS net, CASE WHEN count(margin) = count(*) THEN sum(margin) END AS margin FROM f GROUP BY 1),
b AS (SELECT strftime(day, '%Y-%m') AS month, sum(amount) AS refunded_in FROM rr WHERE reason IS NULL GROUP BY 1), c0 AS (SELECT month, sum(fees) AS fees FROM st GROUP BY 1)
SELECT month, coalesce(orders, 0) AS orders, coalesce(net, 0)::DOUBLE AS net, coalesce(refund, 0)::DOUBLE AS refund, coalesce(refunded_in, 0)::DOUBLE AS refunded_in, coalesce(fees, 0)::DOUBLE AS fees, (CASE WHEN orders IS NULL THEN 0 ELSE margin END - coalesce(fees, 0))::DOUBLE AS contribution FROM a FULL JOIN b USING (month) FULL JOIN c0 USING (month)""")
def multifact_months(t):
    return _d(_facts(t).months, "net", "refund", "refunded_in", "fees", "contribution").select("month", "orders", "net", "refund", "refunded_in", "fees", "contribution")


@query(f"""{_NET}, {_SETTLED}, a AS (SELECT channel, count(DISTINCT order_id) AS orders, sum(net) AS net, CASE WHEN count(margin) = count(*) THEN sum(margin) END AS margin FROM f GROUP BY 1), b AS (SELECT channel, sum(fees) AS fees, sum(CASE WHEN there THEN 0 ELSE base - fees - 2 - gap END) AS to_come FROM st GROUP BY 1)
SELECT channel, orders, net::DOUBLE AS net, margin::DOUBLE AS margin, coalesce(fees, 0)::DOUBLE AS fees, coalesce(to_come, 0)::DOUBLE AS to_come, (margin - coalesce(fees, 0))::DOUBLE AS contribution FROM a LEFT JOIN b USING (channel)""")
def multifact_channels(t):
    return _d(_facts(t).channels, "net", "margin", "fees", "to_come", "contribution").select("channel", "orders", "net", "margin", "fees", "to_come", "contribution")


@query(f"""{_CASH}, d AS (SELECT org, sum(base) - coalesce((SELECT sum(amount) FROM ap WHERE why IS NULL AND ap.org = docs.org), 0) AS receivable FROM docs GROUP BY org), a AS (SELECT org, count(DISTINCT order_id) AS orders, sum(net) AS net FROM f GROUP BY 1)
SELECT n_nationkey::VARCHAR AS org, coalesce(orders, 0) AS orders, coalesce(net, 0)::DOUBLE AS net, coalesce(receivable, 0)::DOUBLE AS receivable, coalesce(receivable::DOUBLE / net::DOUBLE > 0.3, false) AS attention FROM nation LEFT JOIN a ON a.org = n_nationkey LEFT JOIN d ON d.org = n_nationkey WHERE n_nationkey < 24""")
def multifact_orgs(t):
    return _d(_facts(t).orgs, "net", "receivable").select("org", "orders", "net", "receivable", "attention")
