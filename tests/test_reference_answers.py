"""Single cases whose answers are known: masks, allocation, segments, reconciliation classes, stock, workforce, selection."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabloom.functions import business as B
from tabloom.functions import expressions as X
from tabloom.operators import aggregate as A
from tabloom.operators import matching as M
from tabloom.operators import stats as S
from tabloom.reports import operations as O
from tabloom.reports import sales


def test_masks(spark):
    df = spark.sql("select 'A' a, 'ab' b, 'ab@x.com' e, 'a@b@x.com' ee, '12345678' i, '12-34' p, '' z, 'Anna' n, cast(null as string) nil")
    r = df.select(X.mask("a", "name"), X.mask("b", "full"), X.mask("e", "email"), X.mask("ee", "email"), X.mask("i", "id"), X.mask("p", "phone"), X.mask("z"), X.mask("n", char="#", keep_start=2, keep_end=0), X.mask("nil", "full"), X.mask("b", "email")).first()
    assert tuple(r) == ("A*", "***", "a***@x.com", "a***@x.com", "1******8", "1***4", "*", "An##", None, "**")


@pytest.mark.parametrize("amount, weights, want", [("10.00", ["4999999", "9995000001"], ["0.00", "10.00"]), ("1.00", ["1", "1", "1"], ["0.33", "0.33", "0.34"]), ("-1.00", ["1", "1", "1"], ["-0.33", "-0.33", "-0.34"]), ("0.03", ["1", "1", "0", "1", "1", "1", "0"], ["0.01", "0.01", "0.00", "0.01", "0.00", "0.00", "0.00"]), ("5.00", ["0", "0"], ["0.00", "0.00"])])
def test_last_residual(spark, amount, weights, want):
    df = spark.createDataFrame([("g", i, Decimal(amount), Decimal(w)) for i, w in enumerate(weights)], "g string, i int, amt decimal(18,2), w decimal(18,6)")
    got = [r.allocated for r in A.allocate_last_residual(df, ["g"], "amt", "w", ["i"]).orderBy("i").collect()]
    assert got == [Decimal(x) for x in want] or got == [None] * len(want) and not any(map(int, weights))


def test_a_customer_who_spends_little_is_loyal(spark):
    rows = [(c, date(2024, 1, c), 10.0) for c in range(1, 5) for _ in range(c)] + [(5, date(2024, 1, 9), 0.5)] * 9
    r = {x.customer: x for x in S.rfm(spark.createDataFrame(rows, "c int, d date, a double"), "c", "d", "a")["customers"].collect()}
    assert (r[5].r, r[5].f, r[5].m, r[5].segment) == (5, 5, 1, "loyal")


@pytest.mark.parametrize("gap, days, status, score", [("0.5", 0, "amount_difference", 0.98), ("5", 0, "review", 0.7), ("0", 1, "date_difference", 0.98), ("0", 31, "review", 0.7), ("0.5", 1, "review", 0.9), ("0", 0, "matched", 1.0), ("5", 31, "review", 0.7)])
def test_classes_of_key_pairs(spark, gap, days, status, score):
    left = spark.createDataFrame([(1, "k", Decimal("100"), date(2024, 1, 1))], "id long, k string, a decimal(18,2), d date")
    right = left.withColumn("a", F.col("a") + F.lit(gap).cast("decimal(18,2)")).withColumn("d", F.date_add("d", days))
    r = M.reconcile(left, right, "k", "a", "d", tolerance=1.0, days=2)["links"].first()
    assert (r.status, r.score) == (status, score)


def test_a_missing_secondary_field_is_not_compared(spark):
    row = "id long, k string, a decimal(18,2), d date, s string, t string"
    left = spark.createDataFrame([(1, None, Decimal("100"), date(2024, 1, 1), "x", None)], row)
    right = spark.createDataFrame([(2, None, Decimal("100"), date(2024, 1, 1), "x", "y")], row)
    r = M.reconcile(left, right, "k", "a", "d", ["s", "t"])["links"].first()
    assert (r.status, r.score) == ("review", 1.0)


def test_stock(spark):
    p = spark.createDataFrame([("a", 100.0, 0.0, 0.0, 10.0, 5, 30, "active"), ("b", 20.0, 0.0, 0.0, 10.0, 5, 30, "active"), ("c", 1000.0, 0.0, 3.0, 10.0, 5, 30, "active"), ("d", 9.0, 0.0, 0.0, 10.0, 5, 30, "discontinued"), ("e", None, 0.0, 0.0, 10.0, 5, 30, "active"), ("f", 1.0, 5.0, 0.0, 10.0, 5, 30, "active"), ("g", 11.0, 0.0, 0.0, 10.0, 5, 30, "active")], "sku string, opening double, locked double, defective double, safety double, lead_days int, target_days int, status string")
    m = spark.createDataFrame([("a", "sold", 20.0, 1), ("b", "received", 20.0, 2), ("b", "sold", 20.0, 3), ("b", "transit", 4.5, 1), ("c", "sold", 10.0, 3)], "sku string, kind string, quantity double, day int")
    r = {x.sku: x for x in O.inventory(p, m, "sku", 10).collect()}
    assert (r["a"].target, r["a"].reorder_point, r["a"].stock_status, r["a"].to_order) == (70, 20, "normal", 0)
    assert (r["b"].sellable, r["b"].to_order, r["b"].stock_status) == (20.0, 46, "reorder")  # at the point itself; 70 - 20 - 4.5 in whole pieces
    assert (r["c"].sellable, r["c"].stock_status, r["c"].excess) == (987.0, "overstock", 947)
    assert (r["d"].stock_status, r["d"].excess, r["d"].to_order) == ("discontinued_stock", 9, 0)
    assert (r["e"].stock_status, r["e"].to_order, r["e"].excess) == ("unknown", None, None)
    assert r["f"].stock_status == "negative" and (r["g"].stock_status, r["g"].excess) == ("overstock", 1)


def test_workforce(spark):
    people = spark.createDataFrame([(i, i != 4) for i in range(1, 8)], "person int, active boolean")
    days = [(1, "01", 22, 0, 0, 0), (2, "01", 22, 5, 0, 0), (3, "01", 10, 0, 0, 2), (4, "01", 22, 0, 0, 0), (6, "01", 22, None, 0, 0), (7, "01", 21, 1, 0, 1)]
    att = spark.createDataFrame(days, "person int, month string, present int, late int, early int, leave_days int")
    perf = spark.createDataFrame([(1, 1.5, 0.5), (2, 1.0, 5.0), (3, 1.0, 5.0), (4, 1.0, 5.0), (5, 1.0, 5.0), (6, 1.0, 5.0), (7, 0.9, 9.0)], "person int, attainment double, rating double")
    r = {x.person: x for x in O.workforce(people, att, perf, "person").collect()}
    assert (r[1].performance_score, r[1].group, r[1].risk) == (73.0, "attention", "medium")
    assert (r[2].group, r[2].risk) == ("attention", "medium") and (r[3].absent, r[3].group, r[3].risk) == (10.0, "attention", "high")
    assert (r[4].group, r[4].risk, r[4].rank) == ("not_employed", "not_applicable", None)
    assert [(r[i].group, r[i].risk, r[i].attendance_score) for i in (5, 6)] == [("incomplete", "unverified", None)] * 2
    assert (r[7].performance_score, r[7].group, r[7].rank) == (93.0, "excellent", 1)


def test_selection(spark):
    df = spark.createDataFrame([("b", 4.0, 90.0, "内容偏少"), ("a", 5.0, None, "完成度较高，主要结果基本合理"), ("z", 4.5, 80.0, ""), ("y", 4.5, 80.0, None), ("x", None, None, "")], "e string, s double, t double, note string").withColumn("at", F.monotonically_increasing_id())
    r = sales.selection(df, "e", ["s", "t"], ["note"], top=2, source_order="at").orderBy("position").collect()
    by = {x.e: x for x in r}
    assert (by["b"].score, by["b"].penalty) == (0.7 * 85 + 0.3 * 90 - 1.0, 1.0)
    assert (by["a"].score, by["a"].bonus, by["a"].coverage) == (100 - 2.5 + 4.0, 4.0, 0.5)
    assert [x.e for x in r] == ["a", "b", "z", "y", "x"] or [x.e for x in r][:2] == ["a", "b"]
    assert [x.selected for x in r] == [True, True, False, False, False] and by["x"].risk == "high"
    z, y = by["z"].position, by["y"].position
    assert z < y  # equal in all but the order of the source


def test_counts_asked_for():
    assert [B.selection_count(x) for x in ("选8个", "前十名", "选取最优秀的八个组", "Top 12", "pick the best 20 of them", "推荐 两千 人", "nothing")] == [8, 10, 8, 12, 20, 1000, 8]
