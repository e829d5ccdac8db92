"""Outliers, segments, regression, finance."""

from pyspark.sql import functions as F

from tabloom.functions import expressions as X
from tabloom.operators import finance, stats as S
from tabloom.operators.quantiles import quantiles

from . import query

_Q = "q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)"


@query(f"WITH {_Q} SELECT o_orderkey, 'o_totalprice' AS column_name, o_totalprice AS value, CASE WHEN o_totalprice < q1 - 0.3 * (q3 - q1) THEN 'low' ELSE 'high' END AS side, round(abs(o_totalprice - m) / (q3 - q1), 8) AS score FROM orders, q WHERE o_totalprice < q1 - 0.3 * (q3 - q1) OR o_totalprice > q3 + 0.3 * (q3 - q1)")
def outliers_iqr(t):
    return S.outliers(t.orders, ["o_orderkey"], ["o_totalprice"], factor=0.3).withColumn("score", F.round("score", 8))


@query("WITH q AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) SELECT o_orderkey, 'o_totalprice' AS column_name, o_totalprice AS value, CASE WHEN o_totalprice < m THEN 'low' ELSE 'high' END AS side, round(abs(o_totalprice - m) / s, 6) AS score FROM orders, q WHERE abs(o_totalprice - m) > 1.5 * s")
def outliers_zscore(t):
    return S.outliers(t.orders, ["o_orderkey"], ["o_totalprice"], "zscore", 1.5).withColumn("score", F.round("score", 6))


@query(f"WITH {_Q} SELECT 'o_totalprice' AS column_name, count(*) AS n, round(max(m), 4) AS center, round(max(q3 - q1), 4) AS spread, count_if(o_totalprice < q1 - 0.3 * (q3 - q1) OR o_totalprice > q3 + 0.3 * (q3 - q1))::BIGINT AS outliers FROM orders, q")
def outlier_summary(t):
    return S.outlier_summary(t.orders, ["o_totalprice"], factor=0.3).select("column_name", "n", F.round("center", 4).alias("center"), F.round("spread", 4).alias("spread"), "outliers")


_RFM = """WITH p AS (SELECT o_custkey AS customer, count(*) AS frequency, sum(o_totalprice::DECIMAL(18,2)) AS monetary, date_diff('day', max(o_orderdate)::DATE, (SELECT max(o_orderdate)::DATE + 1 FROM orders)) AS recency FROM orders GROUP BY 1),
s AS (SELECT *, {r} AS a, {f} AS f, {m} AS m FROM p), c AS (SELECT customer, frequency, monetary, recency, 6 - a AS r, f, m FROM s),
g AS (SELECT *, CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'champion' WHEN r >= 3 AND f >= 3 THEN 'loyal' WHEN r >= 4 AND f <= 2 THEN 'potential' WHEN r <= 2 AND f >= 3 THEN 'at_risk' WHEN r <= 2 AND f <= 2 THEN 'hibernating' ELSE 'regular' END AS segment FROM c)""".format(
    **{k: f"least(5, greatest(1, ceil(round((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER () * 5, 9))))::INT" for k, c in (("r", "recency"), ("f", "frequency"), ("m", "monetary"))}
)


@query(_RFM + " SELECT customer, recency::INT AS recency, frequency, monetary::DOUBLE AS monetary, r::INT AS r, f, m, segment FROM g")
def rfm_customers(t):
    c = S.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice")["customers"]
    return c.select("customer", "recency", "frequency", F.col("monetary").cast("double").alias("monetary"), F.col("r").cast("int").alias("r"), "f", "m", "segment")


@query(_RFM + " SELECT segment, count(*) AS customers, sum(monetary)::DOUBLE AS monetary, round(avg(recency), 6) AS mean_recency FROM g GROUP BY 1")
def rfm_segments(t):
    s = S.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice")["segments"]
    return s.select("segment", "customers", F.col("monetary").cast("double").alias("monetary"), F.round("mean_recency", 6).alias("mean_recency"))


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY 1")
def regression(t):
    r = S.regression(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
    return r.select("l_returnflag", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"))


@query("""WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT e.event_type, q.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
count_if(value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::BIGINT AS outliers, least(30, count_if(value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)))::INT AS shown,
coalesce(round(list_sum(list_slice(list_sort(list(value) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))), 1, 30)), 4), 0)::DOUBLE AS shown_sum FROM events e JOIN q USING (event_type) GROUP BY ALL""")
def box_stats(t):
    b = S.box_stats(t.events, "value", "event_type")
    shown = F.aggregate("outlier_values", F.lit(0.0), lambda a, x: a + x)
    return b.withColumns({**{c: F.round(c, 6) for c in ("q1", "median", "q3")}, "shown": F.size("outlier_values"), "shown_sum": F.round(shown, 4)}).drop("outlier_values")


@query("""SELECT l_returnflag, 'l_extendedprice' AS column_name, count(*) AS n, count(DISTINCT l_extendedprice) AS distinct_values, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_discount', count(*), count(DISTINCT l_discount), round(quantile_cont(l_discount, 0.1), 6), round(quantile_cont(l_discount, 0.5), 6), round(quantile_cont(l_discount, 0.99), 6) FROM lineitem GROUP BY 1""")
def quantiles_exact(t):
    q = quantiles(t.lineitem, ["l_extendedprice", "l_discount"], (0.1, 0.5, 0.99), ["l_returnflag"])
    return q.select("l_returnflag", "column_name", "n", "distinct_values", *[F.round(F.col("q")[i], 6).alias(f"p{p}") for i, p in enumerate((10, 50, 99))])


@query("""WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT greatest(1, least(10, ceil((l_quantity - lo) / ((hi - lo) / 10))))::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT i::INT AS bin, round(lo + (i - 1) * (hi - lo) / 10, 6) AS low, round(lo + i * (hi - lo) / 10, 6) AS high, coalesce(n, 0) AS n FROM e, range(1, 11) r(i) LEFT JOIN b ON bin = i""")
def histogram(t):
    h = S.histogram(t.lineitem, "l_quantity", 10)
    return h.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


def _receivables(t):
    o = t.orders
    return o.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("due"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).when(F.col("o_orderkey") % 3 == 1, F.lit(100.0)).alias("paid"))


_AR = """WITH d AS (SELECT o_orderkey, o_custkey, greatest(o_totalprice::DECIMAL(18,2) - CASE o_orderkey % 3 WHEN 0 THEN o_totalprice::DECIMAL(18,2) WHEN 1 THEN 100 ELSE 0 END, 0)::DECIMAL(18,2) AS outstanding, date_diff('day', o_orderdate::DATE, DATE '2001-06-30')::INT AS days_overdue FROM orders),
a AS (SELECT *, CASE WHEN days_overdue <= 0 THEN 'not_due' WHEN days_overdue <= 30 THEN '1-30' WHEN days_overdue <= 60 THEN '31-60' WHEN days_overdue <= 90 THEN '61-90' ELSE '>90' END AS bucket FROM d WHERE outstanding > 0)"""


@query(_AR + " SELECT o_orderkey, outstanding::DOUBLE AS outstanding, days_overdue, bucket FROM a")
def ar_aging(t):
    return finance.ar_aging(_receivables(t), "o_custkey", "due", "amount", "paid", "2001-06-30")["detail"].select("o_orderkey", F.col("outstanding").cast("double").alias("outstanding"), "days_overdue", "bucket")


@query(_AR + " SELECT position, b.bucket, count(a.bucket) AS items, coalesce(sum(outstanding), 0)::DOUBLE AS outstanding FROM (VALUES (0, 'not_due'), (1, '1-30'), (2, '31-60'), (3, '61-90'), (4, '>90'), (5, 'invalid_date')) b(position, bucket) LEFT JOIN a ON a.bucket = b.bucket GROUP BY 1, 2")
def ar_buckets(t):
    return finance.ar_aging(_receivables(t), "o_custkey", "due", "amount", "paid", "2001-06-30")["buckets"].withColumn("outstanding", F.col("outstanding").cast("double"))


@query(_AR + " SELECT o_custkey, coalesce(sum(outstanding) FILTER (bucket = '>90'), 0)::DOUBLE AS over_90, sum(outstanding)::DOUBLE AS total FROM a GROUP BY 1")
def ar_customer_pivot(t):
    p = finance.ar_aging(_receivables(t), "o_custkey", "due", "amount", "paid", "2001-06-30")["parties"]
    return p.select("o_custkey", F.col("`>90`").cast("double").alias("over_90"), F.col("total").cast("double").alias("total"))


@query("""SELECT year(l_shipdate) AS y, l_returnflag, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS actual, sum((l_quantity * 2500)::DECIMAL(18,2))::DOUBLE AS budget, (sum(l_extendedprice::DECIMAL(18,2)) - sum((l_quantity * 2500)::DECIMAL(18,2)))::DOUBLE AS variance,
round((sum(l_extendedprice::DECIMAL(18,2)) - sum((l_quantity * 2500)::DECIMAL(18,2)))::DOUBLE / sum((l_quantity * 2500)::DECIMAL(18,2))::DOUBLE, 8) AS variance_rate, sum(l_extendedprice::DECIMAL(18,2)) <= sum((l_quantity * 2500)::DECIMAL(18,2)) AS favourable FROM lineitem GROUP BY 1, 2""")
def budget_variance(t):
    l = t.lineitem.select(F.year("l_shipdate").cast("bigint").alias("y"), "l_returnflag", "l_extendedprice", (F.col("l_quantity") * 2500).alias("b"))
    v = finance.budget_variance(l, ["y", "l_returnflag"], "l_extendedprice", "b")
    return v.withColumns({**{c: F.col(c).cast("double") for c in ("actual", "budget", "variance")}, "variance_rate": F.round("variance_rate", 8)})


_CF = "SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE o_orderstatus WHEN 'F' THEN o_totalprice::DECIMAL(18,2) WHEN 'O' THEN -o_totalprice::DECIMAL(18,2) END AS net FROM orders"


@query(f"SELECT month, coalesce(sum(greatest(net, 0)) FILTER (net IS NOT NULL), 0)::DOUBLE AS inflow, coalesce(-sum(least(net, 0)) FILTER (net IS NOT NULL), 0)::DOUBLE AS outflow, sum(net)::DOUBLE AS net, count_if(net IS NULL)::BIGINT AS unknown, (sum(sum(net)) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING))::DOUBLE AS cumulative FROM ({_CF}) GROUP BY month")
def cash_flow_monthly(t):
    m = finance.cash_flow(t.orders, "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice", ["F"], ["O"])["monthly"]
    return m.withColumns({c: F.col(c).cast("double") for c in ("inflow", "outflow", "net", "cumulative")})


@query("""WITH n AS (SELECT c_nationkey AS k, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS revenue, count(*)::DOUBLE AS net_profit, count_if(c_acctbal < 0)::DOUBLE AS total_assets FROM customer GROUP BY 1)
SELECT k, ratio, round(value, 8) AS value FROM (SELECT k, 'net_margin' AS ratio, net_profit / nullif(revenue, 0) AS value FROM n UNION ALL SELECT k, 'return_on_assets', net_profit / nullif(total_assets, 0) FROM n UNION ALL SELECT k, 'asset_turnover', revenue / nullif(total_assets, 0) FROM n)""")
def ratios_long(t):
    n = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.sum(X.money("c_acctbal")).cast("double").alias("revenue"), F.count("*").cast("double").alias("net_profit"), F.count_if(F.col("c_acctbal") < 0).cast("double").alias("total_assets"))
    return finance.financial_ratios(n, ["k"])["long"].withColumn("value", F.round("value", 8))


@query("""SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice::DECIMAL(18,2) ELSE 0 END)::DOUBLE AS debit, sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice::DECIMAL(18,2) ELSE 0 END)::DOUBLE AS credit, count(*) AS lines,
abs(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice::DECIMAL(18,2) ELSE -l_extendedprice::DECIMAL(18,2) END)) <= 50000 AS balanced FROM lineitem GROUP BY 1""")
def journal_audit(t):
    l = t.lineitem.select("l_orderkey", F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).alias("d"), F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).alias("c"))
    v = finance.journal_audit(l, "l_orderkey", "d", "c", 50000.0)["vouchers"]
    return v.select("l_orderkey", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"), "lines", "balanced")
