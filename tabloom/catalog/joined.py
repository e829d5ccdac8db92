"""Joins, lookups, comparisons, relationships."""

from pyspark.sql import functions as F

from tabloom.functions import expressions as X
from tabloom.operators import joins as J

from . import query


def _small(t):
    """All customers and orders; negated keys have no partner on the other side."""
    k = F.col("c_custkey")
    c = t.customer.select(F.when(k % 10 < 7, k).otherwise(-2 * k - 1).alias("c_custkey"), "c_name", F.col("c_acctbal").alias("amount"))
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, -2 * F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("c_custkey"), F.col("o_totalprice").alias("amount"))
    return o, c


_O = "(SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -2 * o_custkey ELSE o_custkey END AS c_custkey, o_totalprice AS amount FROM orders) o"
_C = "(SELECT CASE WHEN c_custkey % 10 < 7 THEN c_custkey ELSE -2 * c_custkey - 1 END AS c_custkey, c_name, c_acctbal AS amount FROM customer) c"
for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):

    def _join(t, how=_how):
        o, c = _small(t)
        return J.join_tables(o, c, ["c_custkey"], how=how).select("o_orderkey", "c_custkey", "amount_left", "c_name", "amount_right")

    query(f"SELECT o_orderkey, coalesce(o.c_custkey, c.c_custkey) AS c_custkey, o.amount AS amount_left, c_name, c.amount AS amount_right FROM {_O} {_sql} JOIN {_C} ON o.c_custkey = c.c_custkey", name=f"join_{_how}")(_join)


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t):
    return J.join_tables(t.nation, t.region, how="cross", allow_cross=True, max_output_rows=1000).select("n_name", "r_name")


@query("""WITH a AS (SELECT l_suppkey % 50 AS k, count(*) AS lc FROM lineitem GROUP BY 1), b AS (SELECT s_suppkey % 70 AS k, count(*) AS rc FROM supplier GROUP BY 1)
SELECT sum(coalesce(lc, 0) * coalesce(rc, 0) + CASE WHEN rc IS NULL THEN lc ELSE 0 END)::BIGINT AS output_rows, max(coalesce(lc, 0)) AS left_multiplicity, max(coalesce(rc, 0)) AS right_multiplicity,
coalesce(count_if(lc > 1 AND rc > 1), 0)::BIGINT AS many_to_many_keys, 0::BIGINT AS missing_key_rows FROM a FULL JOIN b USING (k)""")
def join_size_estimate(t):
    return J.estimate_join(t.lineitem.select((F.col("l_suppkey") % 50).alias("k")), t.supplier.select((F.col("s_suppkey") % 70).alias("j")), ["k"], ["j"], "left").select("output_rows", "left_multiplicity", "right_multiplicity", F.col("many_to_many_keys").cast("bigint").alias("many_to_many_keys"), "missing_key_rows")


_LOOK = "SELECT c_custkey, o_orderkey, o_orderkey IS NOT NULL AS matched FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey {d}) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE {w}) ON o_custkey = c_custkey"
for _keep, _d, _w in (("first", "", "r = 1"), ("last", "DESC", "r = 1"), ("none", "", "n = 1")):

    def _lookup(t, keep=_keep):
        return J.lookup_match(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey", ["o_orderkey"], keep, ["o_orderkey"])

    query(_LOOK.format(d=_d, w=_w), name=f"lookup_{_keep}")(_lookup)


@query("SELECT l_orderkey, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity = 50")
def master_join(t):
    s = J.master_join(t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), t.nation, ["n_nationkey"], ["n_name"])
    return J.master_join(t.lineitem.where("l_quantity = 50").withColumnRenamed("l_suppkey", "s_suppkey"), s, ["s_suppkey"], ["n_name"]).select("l_orderkey", "n_name")


@query("SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def anti(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


_BANDS = "(SELECT p_partkey, DATE '1996-01-01' AS a, DATE '1998-12-31' AS b, p_retailprice AS v FROM part UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN DATE '1998-06-01' ELSE DATE '1999-01-01' END, DATE '2000-12-31', p_retailprice + 1 FROM part)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE AS d, l_extendedprice, (SELECT CASE WHEN count(*) = 1 THEN max(v) END FROM {_BANDS} x WHERE x.p_partkey = l_partkey AND l_shipdate::DATE BETWEEN a AND b) AS price FROM lineitem")
def interval_price(t):
    one = t.part.select("p_partkey", F.lit("1996-01-01").cast("date").alias("start"), F.lit("1998-12-31").cast("date").alias("stop"), F.col("p_retailprice").alias("price"))
    two = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lit("1998-06-01")).otherwise(F.lit("1999-01-01")).cast("date").alias("start"), F.lit("2000-12-31").cast("date").alias("stop"), (F.col("p_retailprice") + 1).alias("price"))
    fact = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_shipdate").cast("date").alias("d"), "l_extendedprice")
    return J.interval_join(fact, one.union(two).withColumnRenamed("p_partkey", "p_partkey"), "p_partkey", "d", "price").withColumnRenamed("p_partkey", "l_partkey")


@query("""WITH b AS (SELECT l_partkey AS k, l_shipdate::DATE AS a, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate::DATE + (l_quantity * 3)::INT END AS b, CASE WHEN l_linenumber = 7 THEN DATE '9999-01-01' ELSE l_shipdate::DATE + (l_quantity * 3)::INT END AS e FROM lineitem)
SELECT x.k, x.a AS start, x.b AS stop, CAST(count(*) - 1 AS BIGINT) AS overlaps FROM (SELECT *, row_number() OVER () AS i FROM b) x JOIN b y ON x.k = y.k AND y.a <= x.e AND x.a <= y.e GROUP BY x.i, x.k, x.a, x.b""")
def interval_overlaps(t):
    """Spans of lines by part, some without an end, and how many others of the part each meets."""
    d = F.col("l_shipdate").cast("date")
    return J.interval_overlaps(t.lineitem.select(F.col("l_partkey").alias("k"), d.alias("start"), F.when(F.col("l_linenumber") != 7, F.date_add(d, (F.col("l_quantity") * 3).cast("int"))).alias("stop")), "k")


@query("SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM orders a JOIN orders b ON a.o_totalprice BETWEEN b.o_totalprice - 26 AND b.o_totalprice + 26 AND abs(a.o_totalprice - b.o_totalprice) <= 25 AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 30 WHERE a.o_orderkey < b.o_orderkey")
def range_amount(t):
    a = t.orders.select(F.col("o_orderkey").alias("left_key"), F.col("o_totalprice").alias("la"), F.col("o_orderdate").alias("ld"))
    b = t.orders.select(F.col("o_orderkey").alias("right_key"), F.col("o_totalprice").alias("ra"), F.col("o_orderdate").alias("rd"))
    return J.range_join(a, b, "la", "ra", 25.0, (F.abs(F.datediff("ld", "rd")) <= 30) & (F.col("left_key") < F.col("right_key"))).select("left_key", "right_key")


@query("""SELECT period, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines FROM (SELECT date_trunc('month', o_orderdate)::DATE AS period FROM orders UNION SELECT date_trunc('month', l_shipdate)::DATE FROM lineitem)
LEFT JOIN (SELECT date_trunc('month', o_orderdate)::DATE AS period, count(*) AS orders FROM orders GROUP BY 1) USING (period) LEFT JOIN (SELECT date_trunc('month', l_shipdate)::DATE AS period, count(*) AS lines FROM lineitem GROUP BY 1) USING (period)""")
def spine_merge(t):
    from tabloom.operators.relational import period_spine

    o, l = t.orders.select(X.period("o_orderdate", "month").alias("period")), t.lineitem.select(X.period("l_shipdate", "month").alias("period"))
    facts = {"o": o.groupBy("period").agg(F.count("*").alias("orders")), "l": l.groupBy("period").agg(F.count("*").alias("lines"))}
    return J.merge_on_spine(period_spine((o, "period"), (l, "period")), facts, ["period"]).fillna(0)


@query("SELECT c_custkey, n_nationkey AS code FROM customer JOIN nation ON c_nationkey = n_nationkey")
def alias_codes(t):
    master = t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit("; Nat"), F.col("n_nationkey").cast("string")).alias("aliases"))
    c = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("Nat"), F.col("c_nationkey").cast("string"))).alias("org"))
    return J.alias_join(c, "org", master, "code", "name", "aliases").select("c_custkey", "code")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS lc FROM orders GROUP BY 1), b AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN -c_custkey ELSE c_custkey END AS k, count(*) AS rc FROM customer GROUP BY 1), j AS (SELECT * FROM a FULL JOIN b USING (k))
SELECT sum(lc) FILTER (rc IS NOT NULL)::BIGINT AS matched_rows, sum(lc)::BIGINT AS left_rows, count_if(lc IS NOT NULL AND rc IS NOT NULL)::BIGINT AS matched_keys, count(lc) AS left_keys, count(rc) AS right_keys,
round(sum(lc) FILTER (rc IS NOT NULL) / sum(lc), 6) AS row_coverage, round(count_if(lc IS NOT NULL AND rc IS NOT NULL) / count(lc), 6) AS key_coverage, round(count_if(lc IS NOT NULL AND rc IS NOT NULL) / count(rc), 6) AS right_coverage,
CASE WHEN max(lc) > 1 THEN 'N' ELSE '1' END || ':' || CASE WHEN max(rc) > 1 THEN 'N' ELSE '1' END AS cardinality, sum(lc) FILTER (rc IS NOT NULL) / sum(lc) >= 0.8 AS accepted FROM j""")
def relationship(t):
    return J.relationship(t.orders, t.customer.withColumn("c_custkey", F.when(F.col("c_custkey") % 4 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey"))), "o_custkey", "c_custkey")


def _edge(lt, lk, rt, rk):
    return f"""SELECT '{lt}' AS left_table, '{lk}' AS left_key, '{rt}' AS right_table, '{rk}' AS right_key, card AS cardinality, CASE WHEN card = 'N:N' THEN 'blocked' WHEN cov >= 0.8 THEN 'candidate' ELSE 'review' END AS status
FROM (SELECT CASE WHEN max(lc) > 1 THEN 'N' ELSE '1' END || ':' || CASE WHEN max(rc) > 1 THEN 'N' ELSE '1' END AS card, greatest(coalesce(sum(lc) FILTER (rc IS NOT NULL), 0) / sum(lc), count_if(lc IS NOT NULL AND rc IS NOT NULL) / count(rc)) AS cov
FROM (SELECT {lk} AS k, count(*) AS lc FROM {lt} GROUP BY 1) FULL JOIN (SELECT {rk} AS k, count(*) AS rc FROM {rt} GROUP BY 1) USING (k))"""


@query(" UNION ALL ".join(_edge(*e) for e in (("customer", "c_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "supplier", "s_nationkey"), ("nation", "n_nationkey", "supplier", "s_nationkey"))))
def relationship_edges(t):
    g = J.relationship_graph({"customer": t.customer, "nation": t.nation, "supplier": t.supplier}, {"customer": ["c_nationkey"], "nation": ["n_nationkey"], "supplier": ["s_nationkey"]})
    return g.select("left_table", "left_key", "right_table", "right_key", "cardinality", "status")


def _snapshots(t):
    """All orders twice; negated keys stand for rows that are only in one of the two."""
    i = F.col("o_orderkey")
    old = t.orders.select(F.when(i % 11 == 0, -i).otherwise(i).alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    new = t.orders.select(F.when(i % 13 == 0, -i).otherwise(i).alias("k"), F.when(F.col("o_orderkey") % 17 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"), F.when(F.col("o_orderkey") % 19 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("p"))
    return old, new.union(new.where("k % 29 = 0"))


_OLD = "o AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, o_orderstatus AS s, o_totalprice AS p FROM orders)"
_NEW = "n AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 19 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders)"
_DIFF = {
    "added": "SELECT k::VARCHAR AS k, s, p FROM n WHERE k % 29 <> 0 AND k NOT IN (SELECT k FROM o)", "removed": "SELECT k::VARCHAR AS k, s, p FROM o WHERE k NOT IN (SELECT k FROM n)",
    "modified": "SELECT n.k::VARCHAR AS k, concat_ws('; ', CASE WHEN o.s <> n.s THEN 's' END, CASE WHEN o.p <> n.p THEN 'p' END) AS changed, o.s AS s_old, n.s AS s_new, o.p AS p_old, n.p AS p_new FROM o JOIN n USING (k) WHERE n.k % 29 <> 0 AND (o.s <> n.s OR o.p <> n.p)",
    "unchanged": "SELECT n.k::VARCHAR AS k, n.s, n.p FROM o JOIN n USING (k) WHERE n.k % 29 <> 0 AND o.s = n.s AND o.p = n.p", "duplicates_new": "SELECT k::VARCHAR AS k, s, p FROM n WHERE k % 29 = 0 UNION ALL SELECT k::VARCHAR, s, p FROM n WHERE k % 29 = 0",
}
for _k, _v in _DIFF.items():
    query(f"WITH {_OLD}, {_NEW} {_v}", name=f"table_diff_{_k}")(lambda t, k=_k: J.compare_tables(*_snapshots(t), ["k"])[k])
