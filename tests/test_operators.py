"""Small hand-written cases, guards, and properties."""

import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions import expressions as X
from tabloom.operators import aggregate as A, clean, dedup, finance, joins as J, matching as M, profile, relational as R, stats as S, validation as V
from tabloom.operators.order import written_once
from tabloom.operators.relational import OperatorError
from tabloom.reports import operations as O


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_join_guards(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("x", 2), ("z", 3)], "k string, w int")
    with pytest.raises(OperatorError):
        J.join_tables(a, b, ["k"], how="inner")
    with pytest.raises(OperatorError):
        J.join_tables(a, b, ["k"], how="inner", allow_many_to_many=True, max_output_rows=3)
    assert J.join_tables(a, b, ["k"], how="inner", allow_many_to_many=True, max_output_rows=4).count() == 4
    with pytest.raises(OperatorError):
        J.join_tables(a.union(spark.createDataFrame([(" ", 9)], "k string, v int")), b.limit(1), ["k"])
    with pytest.raises(OperatorError):
        J.join_tables(a, b, ["k"], validate="many_to_one", guard=False)


def test_parse_number(spark):
    cases = {"1,234.50": 1234.5, "1,23": None, "(12)": -12.0, "$ 5": 5.0, "12%": 0.12, "1d": None, "NaN": None, "": None, "-0.5": -0.5, "abc": None, "￥1,000": 1000.0}
    df = spark.createDataFrame(list(cases.items()), "t string, want double").withColumn("got", X.parse_number("t").cast("double"))
    assert [(r.t, r.got) for r in df.collect()] == list(cases.items())


def test_masks(spark):
    r = spark.sql("select '13812345678' p, 'alice@example.com' e, 'Ann' n, cast(null as string) z").select(X.mask("p", "phone"), X.mask("e", "email"), X.mask("n", "name"), X.mask("z", "hash"), X.mask("n")).first()
    assert tuple(r) == ("138****5678", "a****@example.com", "A**", None, "A*n")


def test_filters_ignore_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert rows(R.filter_rows(df, [{"column": "s", "op": "ne", "value": "b"}])) == [(1, "a")]
    assert R.filter_rows(df, [{"column": "s", "op": "not_in", "value": ["a"]}]).count() == 0


def test_plan_chain_numbers(spark):
    df = spark.createDataFrame([("A1", "s", "ok", 100, 40), ("A1", "s", "ok", 100, 40), ("A2", "s", "ok", 90, 40), ("A3", "s", "void", 5, 1)], "id string, store string, status string, revenue int, cost int")
    one = dedup.guarded_dedup(df, ["id"])
    assert one["rejected"].count() == 1
    parts = R.partition_rows(one["primary"], [{"column": "status", "op": "eq", "value": "void", "reason": "void"}])
    assert parts["rejected"].count() == 1
    out = R.derive_columns(parts["primary"], [{"name": "profit", "op": "subtract", "left": "revenue", "right": "cost"}])["primary"]
    assert rows(A.group_summary(out, ["store"], {"revenue": ["sum"], "profit": ["sum"]})) == [("s", 190, 110.0)]


def test_derive_review(spark):
    df = spark.createDataFrame([(10, 2.0), (0, 1.0), (None, 1.0)], "sales int, profit double")
    out = R.derive_columns(df, [{"name": "m", "op": "divide", "left": "profit", "right": "sales"}], "coerce")
    assert out["review"].count() == 2
    with pytest.raises(OperatorError):
        R.derive_columns(df, [{"name": "m", "op": "divide", "left": "profit", "right": "sales"}])


def test_infer_types(spark):
    df = spark.createDataFrame([("00123", "1234567890123456", "1", "yes", "2024-01-02"), ("00456", "1234567890123457", "2", "no", "2024-02-03")], "code string, card string, n string, flag string, day_date string")
    assert clean.infer_types(df) == {"code": "string", "card": "string", "n": "bigint", "flag": "boolean", "day_date": "timestamp"}


@pytest.mark.parametrize("method", ["largest", "last"])
def test_allocations_conserve_cents(spark, method):
    rnd = random.Random(4)
    data = [(g, i, round(rnd.uniform(0, 500), 2), float(rnd.choice([0, 1, 3, 7.5, 100]))) for g in range(150) for i in range(rnd.randint(1, 6))]
    amount = {g: a for g, i, a, w in data if i == 0}
    df = spark.createDataFrame([(g, i, amount[g], w) for g, i, _, w in data], "g int, i int, amt double, w double")
    f = A.allocate_largest_remainder if method == "largest" else A.allocate_last_residual
    out = f(df, ["g"], "amt", "w", ["i"]).toPandas()
    for g, x in out.groupby("g"):
        assert (x.allocated >= 0).all() and (x.allocated[x.w == 0] == 0).all()
        if (x.w > 0).any():
            assert round(float(x.allocated.sum()), 2) == amount[g]


def test_version_select(spark):
    df = spark.createDataFrame([("a", "1", 5), ("a", "2", 6), ("b", "x", 1), ("c", "1", 1), ("c", "1", 2), ("d", "1", 1), ("d", "1", 1)], "k string, v string, p int")
    got = {(r.k, r.v, r.p): r.status for r in dedup.version_select(df, ["k"], "v", ["p"]).collect() if r.k != "d"}
    assert got == {("a", "1", 5): "superseded", ("a", "2", 6): "current", ("b", "x", 1): "quarantined", ("c", "1", 1): "quarantined", ("c", "1", 2): "quarantined"}
    assert sorted(r.status for r in dedup.version_select(df, ["k"], "v", ["p"]).where("k = 'd'").collect()) == ["current", "duplicate"]


def test_compare_keys(spark):
    old = spark.createDataFrame([("1", 5), ("001", 6), ("7", 1), ("7", 2), (" ", 3)], "k string, v int")
    new = spark.createDataFrame([(1.0, 5), (2.0, 9)], "k double, v int")
    out = J.compare_tables(old, new, ["k"])
    assert {k: out[k].count() for k in ("added", "removed", "modified", "unchanged", "duplicates_old", "invalid_old")} == {"added": 1, "removed": 1, "modified": 0, "unchanged": 1, "duplicates_old": 2, "invalid_old": 1}


def test_rfm_single_customer(spark):
    df = spark.createDataFrame([("c", "2024-01-01", 5.0), (None, "2024-01-01", 1.0)], "c string, d string, a double").withColumn("d", F.to_timestamp("d"))
    out = S.rfm(df, "c", "d", "a")
    r = out["customers"].first()
    assert (r.recency, r.frequency, r.r, r.f, r.m, r.segment) == (1, 1, 5, 5, 5, "champion")
    assert out["invalid"].count() == 1


def test_ar_and_journal(spark):
    ar = spark.createDataFrame([("a", "2026-08-01", 1000.0, 0.0), ("b", "2026-06-20", 3000.0, 500.0), ("c", "2026-09-10", 800.0, None), ("d", None, 10.0, 10.0)], "p string, due string, amt double, paid double").withColumn("due", F.to_date("due"))
    out = finance.ar_aging(ar, "p", "due", "amt", "paid", "2026-08-31")
    assert {r.bucket: r["items"] for r in out["buckets"].collect()} == {"not_due": 1, "1-30": 1, "31-60": 0, "61-90": 1, ">90": 0, "invalid_date": 0}
    j = spark.createDataFrame([("v1", 10.0, 0.0), ("v1", 0.0, 10.0), ("v2", 5.0, 0.0), ("v2", 0.0, 4.0)], "v string, d double, c double")
    assert finance.journal_audit(j, "v", "d", "c")["vouchers"].where("not balanced").count() == 1


def test_validation_gate(spark):
    df = spark.createDataFrame([(1, "a"), (2, " ")], "i int, s string")
    with pytest.raises(OperatorError):
        V.quality_gate(df, [{"rule": "not_null", "column": "s"}], ["i"])
    assert V.quality_gate(df, [{"rule": "not_null", "column": "s", "severity": "warning"}], ["i"]).count() == 2
    with pytest.raises(OperatorError):
        V.safe_pattern("(?<=a)b")


def test_contract_round_trip(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    c = V.infer_contract(o)
    assert V.contract_issues(o, c).count() == 0
    assert {r.code for r in V.contract_issues(o.limit(5).withColumn("x", F.lit(1)).drop("o_custkey"), c).collect()} >= {"EXTRA_COLUMN", "MISSING_COLUMN"}


def test_quality(spark):
    df = spark.createDataFrame([("1", None, "c"), ("1", None, "c"), (" ", 2.0, "c"), ("x", 3.0, "c")], "id string, amount double, k string")
    codes = {i[0] for i in profile.quality(df, ["id"])["issues"]}
    assert codes >= {"MISSING_VALUES", "DUPLICATE_ROWS", "DUPLICATE_KEYS", "MISSING_KEYS", "CONSTANT_COLUMN", "MIXED_TYPES"}


def test_fuzzy_text_and_lookup(spark):
    n = spark.createDataFrame([("  ＡＢＣ　科技有限责任公司  ",), ("Acme Co., Ltd",)], "s string").select(M.normalized(F.col("s"))).collect()
    assert n[0][0] == "abc科技"
    s = spark.createDataFrame([("Acme Trading",), ("Acme Tradng",), ("Zzz",), (None,)], "s string")
    m = spark.createDataFrame([("Acme Trading", 1), ("Other Works", 2)], "name string, code int")
    got = {r.s: (r.status, r.code) for r in M.fuzzy_lookup(s, m, "s", "name", ["code"], 0.85).collect()}
    assert got == {"Acme Trading": ("matched", 1), "Acme Tradng": ("matched", 1), "Zzz": ("unmatched", None), None: ("unmatched", None)}


def test_reconcile_every_row_lands_once(spark):
    left = spark.createDataFrame([(1, "A", 10.0, "2024-01-01", "x"), (2, "B", 20.0, "2024-01-01", "x"), (3, "C", 30.0, "2024-01-01", "x"), (4, None, 40.0, "2024-01-01", "y"), (5, "D", 5.0, "2024-01-01", "x"), (6, "D", 5.0, "2024-01-01", "x"), (7, "E", 1.0, "2024-01-01", "x")], "id int, k string, a double, d string, c string")
    right = spark.createDataFrame([(11, "A", 10.0, "2024-01-01", "x"), (12, "B", 25.0, "2024-01-01", "x"), (13, "C", 30.0, "2024-01-09", "x"), (14, None, 40.0, "2024-01-01", "y"), (15, "D", 5.0, "2024-01-01", "x"), (17, "R", 900.0, "2024-01-01", "x")], "id int, k string, a double, d string, c string")
    out = M.reconcile(left, right, "k", "a", "d", ["c"], tolerance=0.1, days=2)
    assert {(r.left_id, r.right_id): r.status for r in out["links"].collect()} == {(1, 11): "matched", (2, 12): "review", (3, 13): "review", (4, 14): "matched"}
    assert rows(out["duplicates"].select("side", "id")) == [("left", 5), ("left", 6), ("right", 15)]
    assert [r.id for r in out["left_only"].collect()] == [7] and [r.id for r in out["right_only"].collect()] == [17]


def test_splits(spark):
    a = spark.createDataFrame([(1, 1.0, "2024-01-01")], "id int, a double, d string")
    b = spark.createDataFrame([(1, 0.3, "2024-01-01"), (2, 0.7, "2024-01-02"), (3, 0.6, "2024-01-01")], "id int, a double, d string")
    assert rows(M.reconcile_splits(a, b, "a", "d", days=2).select("left_id", "right_a", "right_b")) == [(1, 1, 2)]


def test_ordered_folds(spark):
    lines = spark.createDataFrame([(1, 10.0)], "line int, sold double")
    back = spark.createDataFrame([(1, 1, 6.0), (2, 1, 7.0), (3, 1, 4.0)], "n int, line int, quantity double")
    assert [r.accepted for r in O.capped_returns(lines, back, "line", "sold", "n").orderBy("n").collect()] == [True, False, True]
    written_once(spark.range(1))  # names a folder for checkpoints where none is set
    rec = spark.createDataFrame([(1, 100.0), (2, 50.0)], "receipt int, amount double")
    doc = spark.createDataFrame([(1, 80.0), (2, 100.0)], "document int, amount double")
    app = spark.createDataFrame([(1, 1, 1, 80.0), (2, 1, 2, 30.0), (3, 1, 2, 20.0), (4, 2, 2, 50.0)], "application long, receipt int, document int, amount double")
    assert [r.applied for r in O.apply_receipts(rec, doc, app).orderBy("application").collect()] == [True, False, True, True]


def test_shuffle_invariance(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    for f in (lambda d: dedup.drop_duplicates(d, ["o_custkey"], "first", ["o_orderdate"]), lambda d: R.number_rows(d.select("o_orderkey"), ["o_orderkey"])):
        assert rows(f(o)) == rows(f(o.repartition(7)))
