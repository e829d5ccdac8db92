"""Reconciliation and fuzzy matching."""

from pyspark.sql import functions as F

from tabloom.operators import matching as M

from . import query


def _ledgers(t):
    """Orders against themselves with rows left out, repeated and changed by key; ids of the right ledger grow with the keys."""
    o, i = t.orders, F.col("o_orderkey")
    left = o.select(i.alias("id"), F.when(i % 10 != 9, i).alias("k"), F.col("o_totalprice").alias("a"), F.col("o_orderdate").alias("d"), F.col("o_custkey").alias("c"))
    right = o.where(i % 17 != 0).select((i * 10 + 1).alias("id"), F.when(i % 10 != 9, i).alias("k"), F.when(i % 7 == 0, F.col("o_totalprice") + 0.5).when(i % 11 == 0, F.col("o_totalprice") + 5).otherwise(F.col("o_totalprice")).alias("a"), F.when(i % 13 == 0, F.date_add("o_orderdate", 9)).otherwise(F.col("o_orderdate").cast("date")).alias("d"), F.col("o_custkey").alias("c"))
    return left, right.union(right.where("k % 29 = 0").withColumn("id", F.col("id") + 1))


def _out(t):
    return M.reconcile(*_ledgers(t), "k", "a", "d", ["c"], tolerance=1.0, days=2)


def _plain(df):
    return df.withColumns({c: F.col(c).cast("double") for c in ("score", "amount_gap")}).withColumn("day_gap", F.col("day_gap").cast("long"))


_L = "o AS (SELECT o_orderkey AS i, o_totalprice::DECIMAL(18,2) AS a, o_orderdate::DATE AS d, o_custkey AS c FROM orders)"
_R = f"{_L}, x AS (SELECT i, a, d, (a + CASE WHEN i % 7 = 0 THEN 0.5 WHEN i % 11 = 0 THEN 5 ELSE 0 END)::DECIMAL(18,2) AS ra, d + CASE WHEN i % 13 = 0 THEN 9 ELSE 0 END AS rd, c FROM o WHERE i % 17 <> 0)"


@query(f"""WITH {_R}, s AS (SELECT i, abs(a - ra) AS g, abs(date_diff('day', d, rd)) AS n FROM x WHERE i % 10 <> 9 AND i % 29 <> 0),
u AS (SELECT *, CASE WHEN g = 0 AND n = 0 THEN 'matched' WHEN g <= 1 AND n = 0 THEN 'amount_difference' WHEN g = 0 AND n <= 2 THEN 'date_difference' ELSE 'review' END AS status FROM s)
SELECT i AS left_id, i * 10 + 1 AS right_id, status, CASE WHEN status = 'matched' THEN 1.0 WHEN status <> 'review' THEN 0.98 WHEN g <= 1 AND n <= 2 THEN 0.9 ELSE 0.7 END::DOUBLE AS score, g::DOUBLE AS amount_gap, n::BIGINT AS day_gap FROM u""")
def reconcile_keyed(t):
    return _plain(_out(t)["links"].where("candidate_rank is null and left_id % 10 <> 9").drop("candidate_rank"))


@query(f"WITH {_R} SELECT 'left' AS side, i AS id FROM o WHERE i % 10 <> 9 AND i % 29 = 0 AND i % 17 <> 0 UNION ALL SELECT 'right', i * 10 + 1 FROM x WHERE i % 10 <> 9 AND i % 29 = 0 UNION ALL SELECT 'right', i * 10 + 2 FROM x WHERE i % 10 <> 9 AND i % 29 = 0")
def reconcile_duplicates(t):
    return _out(t)["duplicates"].select("side", "id")


_KEYLESS = f"""{_R}, ol AS (SELECT i AS left_id, a, d, c FROM o WHERE i % 10 = 9 OR i % 17 = 0), r AS (SELECT i * 10 + 1 AS right_id, ra, rd, c FROM x WHERE i % 10 = 9),
p AS (SELECT left_id, right_id, abs(a - ra) AS g, abs(date_diff('day', d, rd)) AS n, ol.c = r.c AS same FROM ol JOIN r ON a BETWEEN ra - 1 AND ra + 1 AND d BETWEEN rd - 2 AND rd + 2),
q AS (SELECT *, round(0.45::DECIMAL(4,2) * (1 - 0.5::DECIMAL(2,1) * g) + 0.25::DECIMAL(4,2) * (1 - 0.25::DECIMAL(4,2) * n) + CASE WHEN same THEN 0.3::DECIMAL(2,1) ELSE 0 END, 4)::DOUBLE AS score, count(*) OVER (PARTITION BY left_id) = 1 AND count(*) OVER (PARTITION BY right_id) = 1 AND g = 0 AND n = 0 AND same AS auto FROM p)"""


@query(f"WITH {_KEYLESS} SELECT left_id, right_id, 'matched' AS status, 0.95::DOUBLE AS score, 0.0::DOUBLE AS amount_gap, 0::BIGINT AS day_gap FROM q WHERE auto")
def reconcile_auto(t):
    return _plain(_out(t)["links"].where("candidate_rank is null and left_id % 10 = 9 and status = 'matched'").drop("candidate_rank"))


@query(f"WITH {_KEYLESS} SELECT left_id, right_id, score, g::DOUBLE AS amount_gap, n::BIGINT AS day_gap, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, g, n, right_id)::INT AS candidate_rank FROM q WHERE NOT auto QUALIFY candidate_rank <= 20")
def reconcile_review(t):
    return _plain(_out(t)["links"].where("candidate_rank is not null").drop("status"))


@query(f"WITH {_KEYLESS} SELECT left_id AS id FROM ol WHERE left_id NOT IN (SELECT left_id FROM q)")
def reconcile_left_only(t):
    return _out(t)["left_only"].select("id")


@query(f"WITH {_KEYLESS}, v AS (SELECT right_id FROM q WHERE NOT auto QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, g, n, right_id) <= 20 UNION SELECT right_id FROM q WHERE auto) SELECT right_id AS id FROM r WHERE right_id NOT IN (SELECT right_id FROM v)")
def reconcile_right_only(t):
    return _out(t)["right_only"].select("id")


@query(f"WITH {_KEYLESS}, c AS (SELECT CASE WHEN i % 29 = 0 THEN 'duplicate' ELSE 'keyed' END AS s FROM x WHERE i % 10 <> 9) SELECT (SELECT count(*) FROM o) AS left_rows, (SELECT count(*) FROM x) + (SELECT count(*) FROM x WHERE i % 10 <> 9 AND i % 29 = 0) AS right_rows, (SELECT count(*) FROM q WHERE auto) + (SELECT count(*) FROM x WHERE i % 10 <> 9 AND i % 29 <> 0 AND a = ra AND d = rd) AS matched, (SELECT count(*) FROM o WHERE (i % 10 = 9 OR i % 17 = 0) AND i NOT IN (SELECT left_id FROM q)) AS left_only, 3 * (SELECT count(*) FROM c WHERE s = 'duplicate') AS duplicates")
def reconcile_summary(t):
    return M.reconcile_summary(*_ledgers(t), _out(t)).select("left_rows", "right_rows", "matched", "left_only", "duplicates")


@query()
def fuzzy_lookup(t):
    """Misspelt supplier names against the master; the ratio has no SQL form, tests hold it to brute force."""
    s = t.supplier.select("s_suppkey", F.concat(F.regexp_replace("s_name", "#0+", "#"), F.lit(" Co., Ltd")).alias("typed"))
    master = t.supplier.select(F.regexp_replace("s_name", "#0+", "#").alias("s_name"), "s_nationkey")
    return M.fuzzy_lookup(s, master, "typed", "s_name", ["s_nationkey"], threshold=0.8, gap=0.02)


@query()
def fuzzy_clusters(t):
    """Spellings of part kinds, grouped greedily on at most 1000 distinct values."""
    p = t.part.select(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit(" LLC"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lower("p_type"), F.lit("s"))).otherwise(F.col("p_type")).alias("kind"))
    return M.cluster_similar(p, "kind")


_HALVES = """WITH a AS (SELECT o_orderkey AS i, o_totalprice::DECIMAL(18,2) AS v, o_orderdate::DATE AS d FROM orders), b AS (SELECT i * 10 + 1 AS j, (v * 0.5)::DECIMAL(18,2) AS v, d FROM a UNION ALL SELECT i * 10 + 2, v - (v * 0.5)::DECIMAL(18,2), d + 1 FROM a),
m AS (SELECT i, a.v AS lv, j, b.v AS rv FROM (SELECT *, d + unnest([-1, 0, 1]) AS at_ FROM a) a JOIN b ON b.d = at_ AND b.v <= a.v AND b.v > 0), n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY abs(rv - lv / 2), j) AS r FROM m)"""


def _halves(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"), F.col("o_orderdate").cast("date").alias("d"))
    half = (F.col("v") * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(18,2)")
    return a, a.select((F.col("id") * 10 + 1).alias("id"), half.alias("v"), "d").union(a.select((F.col("id") * 10 + 2).alias("id"), (F.col("v") - half).cast("decimal(18,2)").alias("v"), F.date_add("d", 1).alias("d")))


@query(f"{_HALVES} SELECT x.i AS left_id, x.j AS right_a, y.j AS right_b FROM n x JOIN n y ON x.i = y.i AND x.j < y.j AND x.rv + y.rv = x.lv WHERE x.r <= 10 AND y.r <= 10")
def reconcile_split_pairs(t):
    """Orders against their halves; of each order the ten parts nearest to its half are tried."""
    return M.reconcile_splits(*_halves(t), "v", "d", days=1, parts=10).select("left_id", "right_a", "right_b")


@query(f"""{_HALVES}, k AS (SELECT i, lv, least(count(*), 5) AS tried, count(*) > 5 AS cut FROM m GROUP BY 1, 2), w AS (SELECT j, b.v AS lv, i, a.v AS rv FROM (SELECT *, d + unnest([-1, 0, 1]) AS at_ FROM b) b JOIN a ON a.d = at_ AND a.v <= b.v AND a.v > 0),
x AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY abs(rv - lv / 2), i) AS r FROM w), y AS (SELECT j, least(count(*), 5) AS tried, count(*) > 5 AS cut FROM w GROUP BY 1)
SELECT CAST((SELECT sum(tried * (tried - 1) // 2) FROM k) + (SELECT coalesce(sum(tried * (tried - 1) // 2), 0) FROM y) AS BIGINT) AS combinations, CAST((SELECT count_if(cut) FROM k) + (SELECT count_if(cut) FROM y) AS BIGINT) AS truncated,
(SELECT count(*) FROM n x JOIN n y ON x.i = y.i AND x.j < y.j AND abs(x.rv + y.rv - x.lv) <= 1 WHERE x.r <= 5 AND y.r <= 5) + (SELECT count(*) FROM x p JOIN x q ON p.j = q.j AND p.i < q.i AND abs(p.rv + q.rv - p.lv) <= 1 WHERE p.r <= 5 AND q.r <= 5) AS groups""".replace("m AS (SELECT", "m AS MATERIALIZED (SELECT").replace("a.v AND b.v > 0)", "a.v + 1 AND b.v > 0)").replace("b.v AND a.v > 0)", "b.v + 1 AND a.v > 0)"))
def reconcile_split_groups(t):
    """Both ways, with five parts each and a tolerance of one."""
    return M.split_groups(*_halves(t), "v", "d", tolerance=1.0, days=1, parts=5)["summary"].select("combinations", "truncated", "groups")
