"""Matching against brute force, contracts, masters, sources and guards on small tables."""

import io
import json
import random
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tabloom.functions import business as B
from tabloom.operators import aggregate as A, contracts as C, masters, matching as M, order, validation as V
from tabloom.operators.relational import OperatorError
from tabloom.plans import plan as P
from tabloom.plans.sqlguard import check_parsed
from tabloom.reports import adaptive, charts
from tabloom.sources import files, xlsx


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_company_endings(spark):
    cases = {"Costco": "costco", "Zinc": "zinc", "Mexico": "mexico", "  ＡＢＣ　科技有限责任公司  ": "abc科技", "Acme Co., Ltd.": "acme", "Acme Corporation": "acme", "公司": "公司", "集团公司": "集团", "X-集团有限公司": "x", "A Corporation LLC": "a"}
    df = spark.createDataFrame(list(cases.items()), "s string, want string").withColumn("got", M.normalized(F.col("s")))
    assert {r.s: r.got for r in df.collect()} == cases


def test_fuzzy_lookup_finds_the_two_best(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    names = ["costco", "cost", "abxcxd", "axbxcxd", "abcd", "acme trading", "acme tradng", "acmetrade", "zz", "zzz", "zinc", "mexico", "mexi", "delta works", "deltaworks", "gamma"]
    typed = ["Costco", "abcd", "Acme Tradin", "zi", "Mexico", "delta", "gamma ray", "q", None, ""]
    src = spark.createDataFrame([(i, t) for i, t in enumerate(typed)], "i int, t string")
    lookup = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "n string, at int")
    got = {r.i: r for r in M.fuzzy_lookup(src, lookup, "t", "n", ["at"], 0.7, 0.0, ["at"]).collect()}
    bare = [n.replace(" ", "") for n in names]
    first = {b: bare.index(b) for b in bare}
    for i, t in enumerate(typed):
        if not t:
            assert got[i].status == "unmatched" and got[i].candidate is None
            continue
        x = t.lower().replace(" ", "")
        best = sorted((-SequenceMatcher(None, x, b, autojunk=False).ratio(), at) for b, at in first.items())[:2]
        assert (got[i].candidate, got[i].second) == (names[best[0][1]], names[best[1][1]]) and got[i].score == round(-best[0][0], 4) and got[i].second_score == round(-best[1][0], 4)
    assert got[0].status == "matched" and got[0].at == 0


def test_clusters_by_brute_force(spark):
    values = ["Acme", "acme", "Acme LLC", "Acmee", "Zeta", "Zetta", "Other"] + ["Acme"]
    got = {(r.value, r.suggestion, r.n) for r in M.cluster_similar(spark.createDataFrame([(v,) for v in values], "v string"), "v", 0.85).collect()}
    assert got == {("Acme", "Acme", 2), ("acme", "Acme", 1), ("Acme LLC", "Acme", 1), ("Acmee", "Acme", 1), ("Zeta", "Zeta", 1), ("Zetta", "Zeta", 1)}


def test_positions_and_totals_across_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 13).alias("v")).repartition(9)
    got = order.running_total(order.number_rows(df, ["x"], "pos"), ["x"], "v", "total").orderBy("x").collect()
    total = 0
    for i, r in enumerate(got):
        total += r.v
        assert (r.x, r.pos, r.total) == (i, i, total)
    t = spark.createDataFrame([("a", 5.0), ("b", 7.0), ("c", 5.0), ("d", None)], "k string, v double")
    assert rows(order.add_ranks(t, "v", "top", "p")) == [("a", 5.0, 2, 0.5), ("b", 7.0, 1, 1.0), ("c", 5.0, 2, 0.5), ("d", None, None, None)]


def test_shares_refuse_what_has_none(spark):
    for values in ((-5.0, 3.0), (0.0, 0.0)):
        with pytest.raises(OperatorError):
            A.contribution(spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "k string, v double"), "k", "v")


def test_adaptive_sums_of_nothing_are_unknown(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0)], "kind string, amount double")
    assert {r.kind: r.value for r in adaptive.adaptive_report(df)["amount_by_kind"].collect()} == {"a": None, "b": 2}


def test_business_texts(spark):
    assert [B.chinese_integer(x) for x in ("十", "二十一", "一百零五", "两千三百", "7", "x", "")] == [10, 21, 105, 2300, 7, None, None]
    assert [B.selection_count(x) for x in ("选取最优秀的八个组", "前十名", "top 5", "nothing said")] == [8, 10, 5, 8]
    from tabloom.functions.expressions import parse_number

    r = spark.sql("select '人民币100' a, '１２．５' b, '3/4/2024' c, '2/13/2024' d, '45000' e, null f").select(parse_number("a").cast("double"), parse_number("b").cast("double"), *[B.parse_business_date(c).cast("string") for c in "cdef"]).first()
    assert tuple(r) == (100.0, 12.5, "2024-04-03", "2024-02-13", "2023-03-15", None)


def test_attribute_join_guards(spark):
    fact = spark.createDataFrame([(" a", 1), ("b", 2)], "k string, v int")
    good = spark.createDataFrame([("a", "x", 1.0), ("b ", "y", 2.0)], "k string, label string, price double")
    assert rows(masters.attribute_join(fact, good, "k", "k", ["label"])) == [(" a", 1, "x"), ("b", 2, "y")]
    for bad, fields in ((good, ["price"]), (good.union(good), ["label"]), (good.where("label = 'x'"), ["label"]), (good.union(good.selectExpr("' '", "'z'", "1.0D")), ["label"])):
        with pytest.raises(OperatorError):
            masters.attribute_join(fact, bad, "k", "k", fields)
    out = V.prepare_business(fact.withColumn("k", F.trim("k")), {"numeric": ["v"], "joins": [{"right": good, "left_key": "k", "right_key": "k", "fields": ["label"]}]})
    assert rows(out["prepared"]) == [("a", 1, "x"), ("b", 2, "y")] and rows(out["audit"]) == [("included", 2)] and out["original"].count() == 2


def test_store_maps_and_aliases(spark):
    m = spark.createDataFrame([("一号店",), ("1号门店",), ("Two",)], "name string")
    typed = spark.createDataFrame([("1号 店铺",), ("two",), ("1号门店",), ("none",), (None,)], "t string")
    assert {r.t: r.store for r in masters.map_names(typed, "t", m, "name", B.store_key, "store").collect()} == {"1号 店铺": None, "two": "Two", "1号门店": "1号门店", "none": None, None: None}
    got = {r.value: r.suggestion for r in masters.alias_suggestions(spark.createDataFrame([("Blue Bottle",), ("Teapot",), ("qqq",)], "a string"), spark.createDataFrame([("Blue Bottle 500ml",), ("Tea pot",), ("Cup",)], "b string"), "a", "b").collect()}
    assert got == {"Blue Bottle": "Blue Bottle 500ml", "Teapot": "Tea pot"}


def test_metric_contracts(spark):
    df = spark.createDataFrame([("s1", "2024-01-31", "10", "2", "CNY"), ("s2", "2024-01-31", "30", "3", "CNY"), ("s1", "2024-02-29", "20", "5", "CNY")], "store string, day string, `销售额` string, `利润` string, money string").withColumn("利润率", F.lit("1%"))
    c = C.metric_contract(df, "销售额", "sum", "CNY", "day", "money", ["store", "day"])
    assert (c["status"], c["grain"], c["valid"]) == ("confirmed", ["store", "day"], 3) and C.evaluate_metric(df, c).first().value == 60
    r = C.metric_contract(df, "利润率", "weighted_ratio")
    assert (r["numerator"], r["denominator"]) == ("利润", "销售额") and abs(C.evaluate_metric(df, r).first().value - 10 / 60) < 1e-9
    assert C.evaluate_metric(df, C.metric_contract(df, "销售额", "last", "", "day", entity=["store"])).first().value is None  # s2 has no later balance
    bad = df.unionByName(df.limit(1)).withColumn("money", F.when(F.col("利润") == "5", "USD").otherwise(F.col("money")))
    assert C.metric_contract(bad, "销售额", "sum", "CNY", "day", "money")["issues"] == ["DUPLICATE_ROWS", "CURRENCIES"]
    assert C.metric_contract(df.withColumn("x", F.lit(None).cast("string")), "x", "sum")["issues"] == ["INCOMPLETE"]
    e = C.question_evidence(["profitability", "channel", "workforce"], [c, r])
    assert [x["status"] for x in e] == ["partial", "available", "unavailable"]
    assert rows(C.ratio_by_name(df.select("store", F.col("销售额").cast("double").alias("销售额"), F.col("利润").cast("double").alias("利润"), "利润率"), "利润率", ["store"])) == [("s1", 7 / 30), ("s2", 0.1)]


def test_encodings_sheets_and_archives(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("名,值\n甲,1\n".encode("gb18030"))
    (tmp_path / "u.csv").write_bytes("﻿名,值\n甲,1\n".encode())
    assert [files.read_table(spark, str(tmp_path / n)).collect()[0][0] for n in ("g.csv", "u.csv")] == ["甲", "甲"]
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    xlsx.write_workbook(str(tmp_path / "w.xlsx"), {"one": df, "two": df.withColumn("n", F.lit(2))})
    with pytest.raises(OperatorError):
        files.read_table(spark, str(tmp_path / "w.xlsx"))
    assert files.read_table(spark, str(tmp_path / "w.xlsx"), "two").first().n == "2" and list(files.read_tables(spark, str(tmp_path / "w.xlsx"))) == ["one", "two"]
    files.write_csv_zip(str(tmp_path / "z.zip"), {"t": df.withColumn("f", F.lit("=1"))}, [{"step": "made"}])
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert sorted(z.namelist()) == ["operations.csv", "t.csv"] and "'=1" in io.TextIOWrapper(z.open("t.csv"), "utf-8-sig").read()
    df.createOrReplaceTempView("browse_me")
    assert ("browse_me", "n", "int") in rows(files.browse(spark)) and files.schema_only(df).count() == 0


def test_parsed_guard_and_chart_checks(spark):
    spark.range(3).createOrReplaceTempView("guarded")
    assert check_parsed(spark, "select * from guarded") == "select * from guarded"
    with pytest.raises(OperatorError):
        check_parsed(spark, "drop view guarded")
    df = spark.createDataFrame([("a", -1.0), ("b", 2.0)], "k string, v double")
    assert charts.check_spec({"kind": "bar", "label": "k", "value": "v"}, df) == []
    assert charts.check_spec({"kind": "pie", "label": "k", "value": "v"}, df) and charts.check_spec({"kind": "x"}, df) and charts.check_spec({"kind": "bar", "value": "k"}, df) and charts.check_spec({"kind": "line", "label": "k", "value": "v"}, df)


def test_plan_operations(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 4.0)], "id int, k string, v double")
    plan = {"steps": [{"id": "q", "operation": "quality", "inputs": ["t"]}, {"id": "d", "operation": "describe", "inputs": ["t"], "params": {"columns": ["v"]}}, {"id": "s", "operation": "split", "inputs": ["t"], "params": {"rows_per_table": 1, "order_by": ["id"]}},
                      {"id": "r", "operation": "recipe", "inputs": ["t"], "params": {"recipe": {"version": 1, "name": "x", "steps": [{"kind": "filter", "params": {"rules": [{"column": "id", "op": "gt", "value": 1}]}}]}}}]}
    out = P.execute(json.dumps(plan), {"t": df})
    assert out["q"]["primary"].first().total_rows == 2 and out["d"]["primary"].first()["mean"] == 3 and out["r"]["primary"].count() == 1 and sorted(r.table_no for r in out["s"]["primary"].collect()) == [0, 1]


def test_kendall_by_brute_force(spark):
    import random

    rnd = random.Random(2)
    data = [(rnd.randint(0, 30), rnd.choice([7, 7, 7, rnd.randint(0, 400)]), rnd.random()) for _ in range(300)]
    got = {(r.a, r.b): (r.n, r.value) for r in A.correlation(spark.createDataFrame(data, "x int, y int, z double").repartition(5), ["x", "y", "z"], "kendall").collect()}
    sign = lambda v: (v > 0) - (v < 0)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        s = tx = ty = 0
        for k, p in enumerate(data):
            for q in data[:k]:
                a, b = sign(p[i] - q[i]), sign(p[j] - q[j])
                s, tx, ty = s + a * b, tx + (a != 0), ty + (b != 0)
        n, value = got["xyz"[i], "xyz"[j]]
        assert n == 300 and abs(value - s / (tx * ty) ** 0.5) < 1e-9


def test_compare_keeps_first_of_repeated_keys(spark):
    from tabloom.operators import joins as J

    old = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 5, 1)], "k string, v int, n int")
    new = spark.createDataFrame([("a", 1, 1), ("b", 6, 1), ("b", 5, 2)], "k string, v int, n int")
    out = J.compare_tables(old, new, ["k"], ["v"], duplicates="first", order_by=["n"])
    assert rows(out["unchanged"]) == [("a", 1)] and rows(out["modified"]) == [("b", "v", 5, 6)] and out["duplicates_old"].count() == 2
    out = J.compare_tables(old, new, ["k"], ["v"])
    assert all(out[k].count() == 0 for k in ("added", "removed", "modified", "unchanged")) and out["duplicates_new"].count() == 2


def test_split_groups_both_ways_and_their_limit(spark):
    led = lambda name, amounts: spark.createDataFrame([(f"{name}{i + 1}", a, "2026-03-01") for i, a in enumerate(amounts)], "id string, v string, d string")
    out = M.split_groups(led("L", ["0.3", "0.4", "0.6"]), led("R", ["0.1", "0.2", "1.0"]), "v", "d")
    assert rows(out["groups"].select("match_type", "whole", "part_a", "part_b", "score")) == [("split_1_to_2", "L1", "R1", "R2", 0.8), ("split_2_to_1", "R3", "L2", "L3", 0.8)]
    out = M.split_groups(led("L", ["100"]), led("R", ["1", "2", "3", "4", "5"]), "v", "d", max_combinations=2)
    assert out["groups"].count() == 0 and tuple(out["summary"].select("evaluated", "limit_hit").first()) == (2, True)


def test_ordered_fingerprint_has_two_levels(spark):
    """However many blocks there are, their digests become one in one step."""
    from hashlib import sha256

    from tabloom.operators.profile import ordered_fingerprint

    df = spark.range(11).selectExpr("id", "-id AS down")
    digest = lambda x: sha256("".join(x).encode()).hexdigest()
    for n, block in ((11, 2), (11, 100), (0, 2)):
        for by, ids in (("id", range(n)), ("down", range(n - 1, -1, -1))):
            cells = [digest([f"bigint:{len(str(i))}:{i}"]) for i in ids]
            got = ordered_fingerprint(df.limit(n), [by], ["id"], block).first()
            assert (got.total_rows, got.digest) == (n, digest(digest(cells[i : i + block]) for i in range(0, n, block)))


def test_best_texts_are_kept_from_block_to_block(spark, monkeypatch):
    """Names of few letters with a near copy each: what the first block finds keeps the others from being compared (two of every block would make 1600)."""
    asked = spark.sparkContext.accumulator(0)

    class Counted(SequenceMatcher):
        def ratio(self):
            asked.add(1)
            return super().ratio()

    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "SequenceMatcher", Counted)
    dice = random.Random(3)
    names = ["".join(dice.choices("abcdef", k=12)) for _ in range(40)]
    names += [n + "g" for n in names]
    src = spark.createDataFrame([(n,) for n in names], "t string")
    got = {r.t: (r.candidate, r.score, r.second, r.second_score) for r in M.fuzzy_lookup(src, src.withColumnRenamed("t", "n"), "t", "n", [], 0.7, 0.0, ["n"]).collect()}
    for t in names:
        best = sorted((-SequenceMatcher(None, t, n, autojunk=False).ratio(), n) for n in names)[:2]
        assert got[t] == (best[0][1], round(-best[0][0], 4), best[1][1], round(-best[1][0], 4))
    assert 0 < asked.value < 800


def test_receipts_of_many_components_are_folded_together(spark, monkeypatch):
    from tabloom.reports import operations as O

    monkeypatch.setattr(O, "FOLDED", 8, raising=False)
    side = lambda name, n, x: spark.createDataFrame([(i, x) for i in range(n)], f"{name} int, amount double")
    app = spark.createDataFrame([(i, i // 2, i // 3, float(i % 7)) for i in range(40)], "application long, receipt int, document int, amount double")
    out = O.apply_receipts(side("receipt", 20, 6.0), side("document", 14, 8.0), app)
    r, d, want = dict.fromkeys(range(20), 6.0), dict.fromkeys(range(14), 8.0), {}
    for i in range(40):
        x = float(i % 7)
        want[i] = x <= r[i // 2] and x <= d[i // 3]
        r[i // 2] -= x * want[i]
        d[i // 3] -= x * want[i]
    assert {x.application: x.applied for x in out.collect()} == want and len(set(want.values())) == 2
    assert "pmod" in out._jdf.queryExecution().optimizedPlan().toString()  # not a group for each component


def test_commerce_outputs_read_lines_that_are_written_once(spark, sf):
    """Sums by month come from the written lines and sums, not from the orders once for each reader; what is not asked for is not built."""
    from tabloom.catalog import QUERIES
    from tabloom.reports import commerce

    plan = QUERIES["commerce_order_months"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
    none = spark.createDataFrame([], "x int")
    assert "customers" in list(commerce.diagnosis(none, none, none, none, none, none))
