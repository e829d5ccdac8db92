"""Filters, projections, replacements, masks, sets, dedup, windows over rows."""

from pyspark.sql import functions as F

from tabloom.functions import expressions as X
from tabloom.operators import clean, dedup, profile, quality, relational as R, validation as V

from . import query


@query("SELECT l_orderkey, l_partkey, l_quantity, l_shipdate::DATE AS l_shipdate FROM lineitem WHERE l_returnflag IN ('A','R') AND l_quantity BETWEEN 10 AND 20 AND l_discount <> 0.05")
def filter_ops(t):
    rules = [{"column": "l_returnflag", "op": "in", "value": ["A", "R"]}, {"column": "l_quantity", "op": "between", "value": [10, 20]}, {"column": "l_discount", "op": "ne", "value": 0.05}]
    return R.filter_rows(t.lineitem, rules).select("l_orderkey", "l_partkey", "l_quantity", F.col("l_shipdate").cast("date").alias("l_shipdate"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE starts_with(o_orderpriority, '1') OR ends_with(o_orderpriority, 'LOW') OR contains(o_orderstatus, 'P')")
def filter_or(t):
    rules = [{"column": "o_orderpriority", "op": "starts_with", "value": "1"}, {"column": "o_orderpriority", "op": "ends_with", "value": "LOW"}, {"column": "o_orderstatus", "op": "contains", "value": "P"}]
    return R.filter_rows(t.orders, rules, "or").select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL AND nullif(o_orderstatus, 'P') NOT IN ('F')")
def filter_nulls(t):
    o = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return R.filter_rows(o, [{"column": "s", "op": "not_in", "value": ["F"]}, {"column": "s", "op": "not_null"}])


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def select_rename_sort(t):
    return R.select_rename_sort(t.customer, ["c_custkey", "c_name", "c_mktsegment"], {"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment"}, [("segment", True), ("id", False)])


@query("SELECT o_orderkey, CASE CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END WHEN 'F' THEN 'filled' ELSE CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END END AS o_orderstatus FROM orders")
def replace_exact(t):
    return R.replace_values(t.orders.select("o_orderkey", "o_orderstatus"), [{"column": "o_orderstatus", "old": "P", "new": "pending"}, {"column": "o_orderstatus", "old": "F", "new": "filled"}])


@query("SELECT p_partkey, regexp_replace(p_name, 'widget', 'gadget', 'gi') AS p_name FROM part")
def find_replace_text(t):
    return R.find_replace(t.part.select("p_partkey", "p_name"), "p_name", "WIDGET", "gadget", whole=False, ignore_case=True)


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'none') AS s, coalesce(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END, 0.0) AS p FROM orders")
def fill_missing(t):
    o = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("p"))
    return R.fill_missing(o, {"s": "none", "p": 0.0})


@query("""SELECT p_partkey, p_size, p_retailprice, round(p_retailprice / p_size, 8) AS per_size, round(p_retailprice / p_size * 2.0, 6) AS twice FROM part WHERE p_size > 0""")
def derive_columns(t):
    f = [{"name": "per_size", "op": "divide", "left": "p_retailprice", "right": "p_size"}, {"name": "twice", "op": "multiply", "left": "per_size", "right": 2, "round": 6}]
    return R.derive_columns(t.part.select("p_partkey", "p_size", "p_retailprice").where("p_size > 0"), f, "coerce")["primary"].withColumn("per_size", F.round("per_size", 8))


@query("SELECT p_partkey FROM part WHERE nullif(p_size % 5, 0) IS NULL")
def derive_review(t):
    p = t.part.withColumn("z", F.col("p_size") % 5)
    return R.derive_columns(p, [{"name": "q", "op": "divide", "left": "p_retailprice", "right": "z"}], "coerce")["review"].select("p_partkey")


_ROUTE = [{"column": "o_totalprice", "op": "gt", "value": 400000, "reason": "large"}, {"column": "o_orderstatus", "op": "eq", "value": "P", "reason": "pending"}]


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 400000 OR o_orderstatus = 'P')")
def partition_primary(t):
    return R.partition_rows(t.orders, _ROUTE)["primary"].select("o_orderkey")


@query("SELECT o_orderkey, concat_ws('; ', CASE WHEN o_totalprice > 400000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END) AS reason FROM orders WHERE o_totalprice > 400000 OR o_orderstatus = 'P'")
def partition_rejected(t):
    return R.partition_rows(t.orders, _ROUTE)["rejected"].select("o_orderkey", "reason")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_orders(t):
    return R.top_k(t.orders, [("o_totalprice", False)], 25, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def topk_within(t):
    return R.top_k(t.orders, [("o_totalprice", False)], 2, ["o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS row_pos, o_orderkey FROM orders")
def row_positions(t):
    return R.number_rows(t.orders.select("o_orderkey"), ["o_orderkey"])


@query("SELECT ((r - 1) // 4000)::BIGINT AS table_no, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1")
def row_chunk_sizes(t):
    return R.split_rows(t.orders.select("o_orderkey"), 4000, ["o_orderkey"]).groupBy("table_no").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'E' WHEN 'PROMO' THEN 'P' ELSE p_type END AS kind FROM part")
def value_mapping(t):
    return R.apply_mapping(t.part, "p_type", {"ECONOMY": "E", "PROMO": "P"}, "kind").select("p_partkey", "kind")


def _mask(method, sql):
    @query(f"SELECT c_custkey, {sql} AS v FROM customer", name=f"mask_{method}")
    def _(t, method=method):
        source = {"phone": F.concat(F.lit("138-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")), "email": F.concat(F.lower("c_mktsegment"), F.lit("@example.com"))}.get(method, F.col("c_name"))
        return t.customer.select("c_custkey", X.mask(source, method, "s").alias("v"))


_mask("partial", "left(c_name, 1) || repeat('*', length(c_name) - 2) || right(c_name, 1)")
_mask("full", "repeat('*', greatest(3, length(c_name)))")
_mask("hash", "left(sha256('s' || c_name), 16)")
_mask("phone", "'138' || '****' || right(lpad(c_custkey::VARCHAR, 8, '0'), 4)")
_mask("email", "left(lower(c_mktsegment), 1) || repeat('*', greatest(3, length(c_mktsegment) - 1)) || '@example.com'")
_mask("name", "left(c_name, 1) || repeat('*', greatest(1, length(c_name) - 1))")
_mask("id", "left(c_name, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4)")


@query("SELECT 'c' AS source, c_custkey AS id, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal, NULL FROM supplier")
def union_outer(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return R.union_tables({"c": c, "s": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))}, "outer", "source")


@query("SELECT c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_inner(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return R.union_tables({"c": c, "s": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))}, "inner")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t):
    return R.distinct_rows(t.orders.select("o_orderstatus", "o_orderpriority"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def key_except(t):
    return R.keys_except(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), ["k"]).select(F.col("k").alias("c_custkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def key_intersect(t):
    return R.keys_intersect(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), ["k"]).select(F.col("k").alias("c_custkey"))


@query("SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS period FROM orders UNION SELECT DISTINCT date_trunc('month', l_shipdate)::DATE FROM lineitem")
def period_spine(t):
    return R.period_spine((t.orders.select(X.period("o_orderdate", "month").alias("m")), "m"), (t.lineitem.select(X.period("l_shipdate", "month").alias("m")), "m"))


_ALL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_DEDUP = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS r, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE {keep}"
_ORDER = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


def _dedup(keep, sql):
    @query(sql, name=f"dedup_{keep}")
    def _(t, keep=keep):
        return dedup.drop_duplicates(t.lineitem, ["l_orderkey", "l_linenumber"], keep, ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


_dedup("first", _DEDUP.format(order=_ORDER, keep="r = 1"))
_dedup("last", _DEDUP.format(order=", ".join(f"{c} DESC" for c in _ORDER.split(", ")), keep="r = 1"))
_dedup("none", _DEDUP.format(order=_ORDER, keep="n = 1"))


@query("SELECT o_custkey, max(o_orderkey) AS version_kept FROM orders GROUP BY 1")
def version_current(t):
    v = dedup.version_select(t.orders.select("o_custkey", F.col("o_orderkey").alias("v"), "o_totalprice"), ["o_custkey"], "v", ["o_totalprice"])
    return v.where("status = 'current'").select("o_custkey", F.col("v").alias("version_kept"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS v, l_partkey AS c FROM lineitem),
m AS (SELECT k, v, count(DISTINCT c) AS d, count(*) AS n FROM l GROUP BY ALL), b AS (SELECT k, max(d) AS d, max(v) AS top FROM m GROUP BY 1)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN b.d > 1 THEN 'quarantined' WHEN r > 1 THEN 'duplicate' WHEN v < b.top THEN 'superseded' ELSE 'current' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY k, v ORDER BY c) AS r FROM l) JOIN b USING (k)) GROUP BY 1""")
def version_states(t):
    v = dedup.version_select(t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("v"), F.col("l_partkey").alias("c")), ["k"], "v", ["c"])
    return v.groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END) + (CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END) DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def most_complete(t):
    o = t.orders.withColumn("a", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))).withColumn("b", F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderpriority")))
    return dedup.most_complete(o, "o_custkey", ["a", "b"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT sum(n)::BIGINT AS total_rows, count(*) AS distinct_rows, sum(n - 1)::BIGINT AS extra_rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS repeated_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_rows(t):
    return dedup.duplicate_count(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, min(l_shipdate)::DATE AS d FROM lineitem GROUP BY 1, 2")
def exact_unique_first(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("d"))
    return dedup.exact_unique(rows, ["d"], ["d"])


@query("""SELECT count(*) AS total_rows, sum((doc_id IS NULL)::INT + (text IS NULL OR trim(text) = '')::INT + (lang IS NULL OR trim(lang) = '')::INT + (source IS NULL OR trim(source) = '')::INT)::BIGINT AS missing_cells,
0::BIGINT AS extra_rows, 0::BIGINT AS repeated_rows, round(sum((doc_id IS NULL)::INT + (text IS NULL OR trim(text) = '')::INT + (lang IS NULL OR trim(lang) = '')::INT + (source IS NULL OR trim(source) = '')::INT) / (count(*) * 4.0), 6)::DOUBLE AS missing_share FROM documents""")
def quality_metrics(t):
    return profile.quality_metrics(t.documents.select("doc_id", "text", "lang", "source"))


@query("""SELECT 0 AS position, 'o_custkey' AS column_name, count(*) AS total_rows, 0::BIGINT AS missing, count(DISTINCT o_custkey) AS distinct_values, min(o_custkey)::VARCHAR AS minimum, max(o_custkey)::VARCHAR AS maximum FROM orders
UNION ALL SELECT 1, 'o_orderstatus', count(*), 0, count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders
UNION ALL SELECT 2, 's', count(*), count_if(o_orderkey % 7 = 0)::BIGINT, count(DISTINCT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END), min(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END), max(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END) FROM orders""")
def profile_orders(t):
    return profile.profile(t.orders.select("o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("s"))).drop("data_type")


def _rough(t):
    """Orders with gaps, a constant, an empty and a mixed column, keys that repeat or are missing, and rows that repeat."""
    i = F.col("o_orderkey")
    o = t.orders.select(F.when(i % 11 != 0, i - i % 3 * F.when(i % 200 == 1, 1).otherwise(0)).alias("k"), F.when(i % 7 != 0, F.col("o_orderpriority")).otherwise(F.when(i % 14 == 0, "  ")).alias("s"), F.lit("CNY").alias("same"), F.lit(None).cast("string").alias("none"), F.when(i % 5 == 0, "n/a").otherwise((i % 40).cast("string")).alias("mixed"), F.concat(F.lit("order-"), i).alias("label"), F.col("o_orderstatus").alias("status_code"), F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")
    return o.union(o.where("k % 50 = 7"))


_ROUGH = """WITH a AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey - CASE WHEN o_orderkey % 200 = 1 THEN o_orderkey % 3 ELSE 0 END END AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS s, 'CNY' AS same, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE (o_orderkey % 40)::VARCHAR END AS mixed, 'order-' || o_orderkey AS label, o_orderstatus, o_orderdate, o_totalprice FROM orders),
r AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE k % 50 = 7), t AS (SELECT count(*) AS n FROM r), d AS (SELECT coalesce(sum(x), 0) AS x FROM (SELECT count(*) AS x FROM r GROUP BY k, s, same, mixed, label, o_orderstatus, o_orderdate, o_totalprice HAVING count(*) > 1)), g AS (SELECT coalesce(sum(x), 0) AS x FROM (SELECT count(*) AS x FROM r WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1))"""


@query(f"""{_ROUGH}, i AS (SELECT 'MISSING_VALUES' AS code, 'low' AS severity, 'k' AS column_name, count_if(k IS NULL)::BIGINT AS rows FROM r UNION ALL SELECT 'MISSING_VALUES', 'medium', 's', count_if(s IS NULL)::BIGINT FROM r UNION ALL SELECT 'MISSING_VALUES', 'high', 'none', n FROM t UNION ALL SELECT 'EMPTY_COLUMN', 'high', 'none', n FROM t UNION ALL SELECT 'CONSTANT_COLUMN', 'info', 'same', n FROM t
UNION ALL SELECT 'MIXED_TYPES', 'medium', 'mixed', n FROM t UNION ALL SELECT 'DUPLICATE_ROWS', 'medium', NULL, x::BIGINT FROM d UNION ALL SELECT 'MISSING_KEYS', 'high', NULL, count_if(k IS NULL)::BIGINT FROM r UNION ALL SELECT 'DUPLICATE_KEYS', 'high', NULL, x::BIGINT FROM g) SELECT code, severity, column_name, rows, round(rows / n, 8) AS ratio FROM i, t""")
def quality_issues(t):
    return quality.quality_report(_rough(t), ["k"])["issues"].withColumn("ratio", F.round("ratio", 8))


@query(f"""{_ROUGH}, p AS (SELECT n, (SELECT count_if(k IS NULL) + count_if(s IS NULL) + count(*) FROM r) / (n * 9.0)::DOUBLE AS m, (SELECT x FROM d) / n AS dup, ((SELECT x FROM g) + (SELECT count_if(k IS NULL) FROM r)) / n AS keys FROM t),
q AS (SELECT *, round(100 - (m * 35 + dup * 20 + 15 / 9.0 + 5 / 9.0 + 10 / 9.0 + keys * 15), 1)::DOUBLE AS score FROM p) SELECT score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS grade, n AS total_rows, round(m, 4) AS missing_share, round(dup, 4)::DOUBLE AS duplicates_share, round(keys, 4)::DOUBLE AS keys_share FROM q""")
def quality_score(t):
    return quality.quality_report(_rough(t), ["k"])["score"].select("score", "grade", "total_rows", "missing_share", "duplicates_share", "keys_share")


@query(f"""{_ROUGH} SELECT 0 AS position, 'k' AS column_name, 'integer' AS semantic_type, count_if(k IS NULL)::BIGINT AS missing, count(DISTINCT k) AS distinct_values FROM r UNION ALL SELECT 1, 's', 'category', count_if(s IS NULL)::BIGINT, count(DISTINCT s) FROM r UNION ALL SELECT 2, 'same', 'category', 0, 1 UNION ALL SELECT 3, 'none', 'empty', count(*), 0 FROM r
UNION ALL SELECT 4, 'mixed', 'category', 0, count(DISTINCT mixed) FROM r UNION ALL SELECT 5, 'label', CASE WHEN count(DISTINCT label) = count(*) THEN 'identifier' WHEN count(DISTINCT label) <= 0.1 * count(*) THEN 'category' ELSE 'text' END, 0, count(DISTINCT label) FROM r UNION ALL SELECT 6, 'status_code', 'identifier', 0, count(DISTINCT o_orderstatus) FROM r
UNION ALL SELECT 7, 'd', 'datetime', 0, count(DISTINCT o_orderdate) FROM r UNION ALL SELECT 8, 'o_totalprice', 'number', 0, count(DISTINCT o_totalprice) FROM r""")
def profile_meanings(t):
    """Exact counts; without them only columns whose meaning hangs on it are counted one by one."""
    return quality.profile_columns(_rough(t), exact=True).select("position", "column_name", "semantic_type", "missing", "distinct_values")


@query("SELECT count(*) AS total_rows, 0::BIGINT AS missing_cells, sum(o_custkey)::DOUBLE AS total_o_custkey, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total_o_totalprice FROM orders")
def table_metadata(t):
    m = profile.metadata(t.orders.select("o_custkey", "o_totalprice"))
    return m.withColumns({c: F.col(c).cast("double") for c in m.columns if c.startswith("total_o")})


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_acctbal::DECIMAL(18,2))::DOUBLE END AS v FROM customer""")
def parse_numbers(t):
    text = F.when(F.col("c_custkey") % 4 == 0, F.lit("n/a")).when(F.col("c_custkey") % 4 == 1, F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), F.format_number(-F.col("c_acctbal"), 2), F.lit(")"))).otherwise(F.format_number("c_acctbal", 2))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit(" $"), F.format_number("c_acctbal", 2))).otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    return t.customer.withColumn("t", text).select("c_custkey", X.parse_number("t").cast("double").alias("v"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate::DATE END AS d FROM orders")
def parse_dates(t):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy/M/d")).when(k == 2, F.date_format("o_orderdate", "yyyy.MM.dd")).when(k == 3, F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")).cast("string")).otherwise("soon")
    return t.orders.withColumn("t", text).select("o_orderkey", X.parse_date("t").alias("d"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE trim(c_name) END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'missing' ELSE c_mktsegment END AS seg FROM customer")
def smart_clean(t):
    c = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("seg"))
    return clean.smart_clean(c, missing="fill", fill={"seg": "missing"}, infer=False)


@query("SELECT c_custkey, c_custkey % 2 = 0 AS flag, c_custkey::BIGINT AS whole, c_acctbal AS amount, lpad(c_custkey::VARCHAR, 9, '0') AS code FROM customer")
def infer_types(t):
    c = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, " Yes").otherwise("no").alias("flag"), F.col("c_custkey").cast("string").alias("whole"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("amount"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("code"))
    return clean.cast_to(c, clean.infer_types(c))


@query("SELECT p_partkey, upper(trim(p_name)) AS p_name FROM part")
def normalize_fields(t):
    p = t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("　"), F.translate("p_name", "abcdefghij", "ａｂｃｄｅｆｇｈｉｊ"))).otherwise(F.col("p_name")).alias("p_name"))
    return clean.normalize_fields(p, ["p_name"], case="upper")


@query("SELECT o_orderkey, 's' AS column_name FROM orders WHERE o_orderkey % 7 = 0")
def blank_details(t):
    return clean.blank_details(t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).otherwise(" ").alias("s"), "o_totalprice"), "o_orderkey")


_RULES = [
    {"rule": "not_null", "column": "s", "name": "not_null"}, {"rule": "unique", "column": "o_custkey", "name": "unique"}, {"rule": "range", "column": "o_totalprice", "min": 1000, "max": 450000, "name": "range"},
    {"rule": "regex", "column": "o_orderpriority", "pattern": r"\d-[A-Z]+", "name": "regex"}, {"rule": "allowed_values", "column": "s", "values": ["F", "O"], "name": "allowed"},
    {"rule": "numeric", "column": "n", "integer_only": True, "name": "numeric", "severity": "warning"}, {"rule": "date", "column": "d", "format": "yyyy-MM-dd", "name": "date"}, {"rule": "column_compare", "column": "o_totalprice", "other": "o_custkey", "op": "gt", "as": "numeric", "name": "compare"},
]


def _ruled(t):
    return t.orders.withColumns({"s": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")), "n": F.when(F.col("o_orderkey") % 11 == 0, "1.5").otherwise("12"), "d": F.when(F.col("o_orderkey") % 13 == 0, "31/12").otherwise("2024-01-31")})


_BAD = {
    "not_null": "o_orderkey % 7 = 0", "unique": "count(*) OVER (PARTITION BY o_custkey) > 1", "range": "o_totalprice < 1000 OR o_totalprice > 450000", "regex": "NOT regexp_full_match(o_orderpriority, '[0-9]-[A-Z]+')",
    "allowed": "o_orderkey % 7 <> 0 AND o_orderstatus NOT IN ('F', 'O')", "numeric": "o_orderkey % 11 = 0", "date": "o_orderkey % 13 = 0", "compare": "NOT (o_totalprice > o_custkey)",
}


@query("SELECT rule, severity, count(*) AS checked, count_if(bad)::BIGINT AS failed FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, '{'warning' if k == 'numeric' else 'error'}' AS severity, {v} AS bad FROM orders" for k, v in _BAD.items()) + ") GROUP BY 1, 2")
def validate_results(t):
    return V.validate(_ruled(t), _RULES, ["o_orderkey"])["results"]


for _k, _v in _BAD.items():

    def _failures(t, k=_k):
        return V.validate(_ruled(t), [r for r in _RULES if r["name"] == k], ["o_orderkey"])["failures"].select("o_orderkey", "rule")

    query(f"SELECT o_orderkey, '{_k}' AS rule FROM (SELECT o_orderkey, {_v} AS bad FROM orders) WHERE bad", name=f"validate_{_k}")(_failures)


@query("""SELECT 'NULLS' AS code, 's' AS column_name, 'error' AS severity, count_if(o_orderkey % 7 = 0)::BIGINT AS rows FROM orders
UNION ALL SELECT 'NOT_UNIQUE', 'o_custkey', 'error', sum(n)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1) UNION ALL SELECT 'RANGE', 'o_totalprice', 'warning', count_if(o_totalprice > 400000)::BIGINT FROM orders
UNION ALL SELECT 'EXTRA_COLUMN', 'o_orderkey', 'warning', 0 UNION ALL SELECT 'MISSING_COLUMN', 'gone', 'error', 0""")
def contract_issues(t):
    o = _ruled(t).select("o_orderkey", "s", "o_custkey", "o_totalprice")
    return V.contract_issues(o, {"columns": {"s": {"type": "string", "nullable": False, "allowed": ["P", "F", "O"]}, "o_custkey": {"unique": True}, "o_totalprice": {"max": "400000", "min": "0"}, "gone": {}}})


_BROKEN = "CAST(count(*) AS BIGINT) AS rows, array_to_string(list_slice(list_sort(list(o_orderkey::VARCHAR)), 1, 20), ',') AS samples FROM orders WHERE"


@query(f"""SELECT 'CROSS_FIELD' AS code, 'price per customer' AS column_name, 'error' AS severity, {_BROKEN} abs(o_totalprice - 100.0 * o_custkey - 50000) > 250000 HAVING count(*) > 0
UNION ALL SELECT 'CROSS_FIELD', 'balance of keys', 'error', {_BROKEN} abs(coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END, 0) * 2.0 - o_orderkey) > 2000 HAVING count(*) > 0 UNION ALL SELECT 'CROSS_FIELD', 'o_custkey,o_orderkey', 'error', {_BROKEN} o_custkey > o_orderkey AND o_orderkey % 5 <> 0 HAVING count(*) > 0
UNION ALL SELECT 'PATTERN', 'o_orderpriority', 'error', {_BROKEN} o_orderpriority NOT LIKE '_-%' OR o_orderpriority LIKE '4%' HAVING count(*) > 0""")
def contract_formulas(t):
    """Formulas, a balance with missing parts, a comparison and a pattern, with the twenty smallest keys that break each."""
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("c"), "o_custkey", "o_totalprice", "o_orderpriority")
    cross = [{"type": "formula", "name": "price per customer", "fields": ["o_totalprice", "o_custkey"], "coefficients": {"o_totalprice": 1, "o_custkey": -100}, "expected": 50000, "tolerance": 250000}, {"type": "balance", "name": "balance of keys", "fields": ["c", "o_orderkey"], "coefficients": {"c": 2, "o_orderkey": -1}, "tolerance": 2000}, {"type": "compare", "name": "o_custkey,o_orderkey", "fields": ["c", "o_orderkey"], "operator": "le"}]
    contract = {"columns": {**{c: {} for c in o.columns}, "o_orderpriority": {"pattern": "[1-35]-.*"}}, "cross": cross}
    return V.contract_issues(o, contract, key="o_orderkey").withColumn("samples", F.array_join("samples", ","))


_TREE = """SELECT '{name}' AS ordering, CAST(max(n) AS BIGINT) AS total_rows, sha256(string_agg(h, '' ORDER BY up)) AS digest FROM (SELECT up, sum(n) AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM
(SELECT pos, pos // 1024 AS up, 1 AS n, sha256('bigint:' || length(o_orderkey::VARCHAR) || ':' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN 'string:null' ELSE 'string:' || length(o_orderpriority) || ':' || o_orderpriority END) AS h FROM (SELECT *, row_number() OVER (ORDER BY {by}) - 1 AS pos FROM orders)) GROUP BY up)"""


@query(" UNION ALL ".join(_TREE.format(name=n, by=b).replace("max(n)", "sum(n)") for n, b in (("key", "o_orderkey"), ("customer", "o_custkey, o_orderkey"))))
def fingerprint_ordered(t):
    """The same rows in two orders have two digests."""
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("p"), "o_custkey")
    made = [profile.ordered_fingerprint(o, by, columns=["o_orderkey", "p"]) for by in (["o_orderkey"], ["o_custkey", "o_orderkey"])]
    return made[0].select(F.lit("key").alias("ordering"), "total_rows", "digest").union(made[1].select(F.lit("customer"), "total_rows", "digest"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus IN ('F')")
def scope_rows(t):
    return V.in_scope(t.orders, "o_orderdate", "1996-01-01", "1997-01-01", {"o_orderstatus": ["F"]})["primary"].select("o_orderkey")


@query("SELECT o_orderkey, 'after_cutoff' AS reason FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'")
def cutoff_rest(t):
    return V.through_cutoff(t.orders, "o_orderdate", "2000-12-31")["rest"].select("o_orderkey", "reason")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'status' WHEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'P' ORDER BY o_orderkey) > 1 THEN 'duplicate' ELSE 'prepared' END AS reason FROM orders) GROUP BY 1""")
def business_policy(t):
    out = V.prepare_business(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), {"status": {"column": "o_orderstatus", "keep": ["F", "O"], "drop": ["P"]}, "keys": ["o_custkey"], "numeric": ["o_totalprice"]})
    return out["excluded"].select("reason").union(out["prepared"].select(F.lit("prepared"))).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'click'")
def props_json(t):
    return t.events.where("event_type = 'click'").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN contains(lower(o_orderpriority), 'not') THEN 'open' WHEN contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high') THEN 'hot' ELSE 'unknown' END AS status FROM orders) GROUP BY 1")
def status_words(t):
    return t.orders.select(X.classify("o_orderpriority", [("open", ["not"]), ("hot", ["urgent", "high"])]).alias("status")).groupBy("status").agg(F.count("*").alias("n"))
