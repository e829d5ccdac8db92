"""What is shuffled and written grows no faster than the input."""

import random
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tabloom.operators import capacity
from tabloom.operators.order import written_by, written_once
from tabloom.reports.multifact import CRITICAL, MultiFact, Policy, latest_versions


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_versions_are_dealt_by_key_once(spark):
    one = lambda o, v, **more: {"order_id": o, "line": 1, "version": v, "day": date(2024, 1, 1), "org_name": "a", "sku": "s", "quantity": 1, "paid": 2, "status": "done", "unit": "pc", "customer": "c", "channel": "x", **more}
    rows = [one("a", "1"), one("a", "2", paid=3), one("a", "2", paid=3), one("b", "1"), one("b", "1", paid=9), one("c", "?"), one("c", "1"), one("d", "1", channel="z"), one("d", "1"), one("d", "1", sku=" s"), one(None, "1"), one(None, "1")]
    kept, gone = latest_versions(spark.createDataFrame(rows), ["order_id", "line"], "version", CRITICAL)
    assert exchanges(kept) == 1
    assert {(r.order_id, r.paid, r.channel) for r in kept.collect()} == {("a", 3, "x"), ("d", 2, "x")}
    want = {("a", "copy", 1), ("a", "superseded", 1), ("b", "conflict", 2), ("c", "bad_version", 2), ("d", "repeated", 2), (None, "copy", 1), (None, "missing_key", 1)}
    assert {(r.order_id, r.reason, r.rows) for r in gone.collect()} == want


def test_rounds_write_what_is_open(spark, monkeypatch):
    """Keys that suffice are never written, and later rounds hold fewer legs than the first."""
    wrote = []

    def counted(df):
        out = written_once(df)
        if "_k" in df.columns:
            wrote.append(out.count())
        return out

    monkeypatch.setattr(capacity, "written_once", counted)
    dice = random.Random(3)
    legs = [(e, k, Decimal(dice.randint(1, 9))) for e in range(300) for k in (f"wide{e % 20}", f"tight{e % 7}")]
    caps = [(f"wide{i}", Decimal(10_000)) for i in range(20)] + [(f"tight{i}", Decimal(60)) for i in range(7)]
    got = capacity.accept_in_order(spark.createDataFrame(legs, "e int, k string, x decimal(10,2)").withColumn("o", F.col("e")), spark.createDataFrame(caps, "k string, c decimal(10,2)"), "e", "o", "k", "x", "c")
    left, want = dict(caps), {}
    for e in range(300):
        mine = [(k, x) for i, k, x in legs if i == e]
        want[e] = all(x <= left[k] for k, x in mine)
        left |= {k: left[k] - x for k, x in mine if want[e]}
    assert {r.e: r.accepted for r in got.collect()} == want
    assert max(wrote) <= 300 and sum(wrote) < 3 * len(legs) and wrote[-1] == 0


def test_reviews_and_allocations_are_shuffled_once(spark):
    from tabloom.reports import restaurant, sales

    reviews = spark.createDataFrame([(1, 3, "ok"), (1, 5, "slow"), (2, 5, "ok"), (None, 5, "ok")], "order_no int, score int, label string")
    refunds = spark.createDataFrame([(1, 2.5, "k"), (1, 1.0, " "), (9, 4.0, "z"), (None, 7.0, "n")], "order_no int, amount double, kind string").withColumns({"reason": F.lit("r"), "owner": F.lit("o"), "status": F.lit("退款成功")})
    out = restaurant.reviews_with_refunds(reviews, refunds)
    assert exchanges(out) == 2
    got = sorted((str(r.order_no), r.record, r.match, str(r.refund), str(r.attention)) for r in out.collect())
    assert got == sorted([("1", "review", "matched", "3.50", "True"), ("1", "review", "matched", "3.50", "True"), ("2", "review", "no_refund", "None", "False"), ("None", "review", "no_refund", "None", "False"), ("9", "lone_refund", "no_review", "4.00", "None"), ("None", "lone_refund", "no_review", "7.00", "None")])
    lines = spark.createDataFrame([(o, i, 10.0 + i, 7.0, 3.0, "s", "p", date(2024, 1, 1 + i)) for o in range(5) for i in range(3)], "o int, line int, amount double, disc double, ref double, s string, p string, day date")
    made = sales.order_analysis(lines, "o", "line", "amount", "disc", "ref", "s", "p", "day")
    assert exchanges(made["checks"]) == 2 and tuple(made["checks"].first()) == (True, True)
    assert sum(r.orders for r in made["days"].collect()) == 15


def test_lines_are_met_where_they_are(spark):
    """What speaks of lines is dealt to the buckets that lines were written in, by numbers or, where orders are no numbers, by text."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = spark.createDataFrame([(7, 1, 5.0), (7, 2, 6.0), (8, 1, 9.0)], "order_id bigint, line int, paid double")
        facts = MultiFact({"sales": lines}, Policy(date(2024, 1, 1), date(2024, 1, 31), ("done",)))
        said = spark.createDataFrame([("7", "1", 1), ("07", "1", 2), (" 7 ", "2", 3), ("x", "1", 4), (None, "1", 5)], "o string, l string, n int")
        met = written_by(lines, *facts._key).join(facts._dealt(said, _to="o", _at="l"), facts._same())
        assert exchanges(met) == 1  # of what speaks of them
        assert {(r.n, r.paid) for r in met.collect()} == {(1, 5.0), (3, 6.0)}
        texts = lines.withColumns({"order_id": F.concat(F.lit(" x"), "order_id"), "_order_id": F.concat(F.lit("x"), "order_id")})
        facts = MultiFact({"sales": texts}, facts.policy)
        assert facts._key == {"_order_id": "string", "line": "int"}
        said = spark.createDataFrame([("x7", "2", 1), (" x8", "1", 2), ("x9", "1", 3)], "o string, l string, n int")
        met = written_by(texts, *facts._key).join(facts._dealt(said, _to="o", _at="l"), facts._same())
        assert exchanges(met) == 1
        assert {(r.n, r.paid) for r in met.collect()} == {(1, 6.0), (2, 9.0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_capacities_may_come_with_legs(spark):
    dice = random.Random(5)
    legs = [(e, k, Decimal(dice.randint(1, 9))) for e in range(60) for k in ("a", f"b{e % 5}")]
    caps = {"a": Decimal(150), **{f"b{i}": Decimal(20 * i) for i in range(5)}}
    rows = spark.createDataFrame([(e, e, k, x, caps[k]) for e, k, x in legs], "e int, o int, k string, x decimal(10,2), c decimal(10,2)")
    want = capacity.accept_in_order(rows.drop("c"), spark.createDataFrame(list(caps.items()), "k string, c decimal(10,2)"), "e", "o", "k", "x", "c")
    refused = {r.e for r in capacity.refused_in_order(rows, "e", "o", "k", "x", "c").collect()}
    assert refused == {r.e for r in want.collect() if not r.accepted} and 0 < len(refused) < 60


def test_tasks_follow_the_lines(spark, monkeypatch):
    """More lines get more tasks, whatever the session asks for, so that none holds more; the session's settings come back."""
    from tabloom.operators import order

    day, keep = date(2024, 1, 5), ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    ids = spark.range(600).select((F.col("id") / 3).cast("long").alias("order_id"), (F.col("id") % 3).cast("int").alias("line"))
    tables = {
        "sales": ids.select("*", F.lit(1).alias("version"), F.lit(day).alias("day"), F.lit("a").alias("org_name"), F.lit("S").alias("sku"), F.lit(10).alias("quantity"), F.lit(20).alias("paid"), F.lit("done").alias("status"), F.lit("pc").alias("unit"), F.lit("c").alias("customer"), F.concat(F.lit("x"), "line").alias("channel")),
        "products": spark.createDataFrame([("S", "s", "k", "pc", 6, 1, 30)], "sku string, name string, category string, unit string, per_case int, safety int, target_days int"),
        "orgs": spark.createDataFrame([("A", "a", None)], "org string, name string, aliases string"),
        "costs": spark.createDataFrame([("S", day, None, 1.5)], "sku string, start date, stop date, cost double"),
        "refunds": ids.select(F.concat(F.lit("R"), "order_id").alias("refund_id"), "order_id", "line", F.lit(day).alias("day"), F.lit(2).alias("amount"), F.lit("退款成功").alias("status"), F.col("order_id").alias("seq")).where("line = 0"),
        "returns": ids.select(F.concat_ws("-", F.lit("B"), "order_id", "line").alias("return_id"), "order_id", "line", F.lit("S").alias("sku"), F.lit("pc").alias("unit"), F.lit(day).alias("day"), (F.col("line") * 5 + 1).alias("quantity"), F.lit("accepted").alias("status"), (F.col("order_id") * 10 + F.col("line")).alias("seq")).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).select(F.concat("return_id", F.lit("/"), "n").alias("return_id"), "order_id", "line", "sku", "unit", "day", "quantity", "status", (F.col("seq") * 10 + F.col("n")).alias("seq")),
        "settlements": spark.createDataFrame([], "settlement_id int, channel string, month date, base int, commission int, delivery int, promotion int, offset int, received int, arrives date, status string"),
    }
    before = [spark.conf.get(k, None) for k in keep]
    made = {}
    for rows in (1_000_000, 60):
        monkeypatch.setattr(order, "ROWS", rows)
        facts = MultiFact(tables, Policy(date(2024, 1, 1), date(2024, 1, 31), ("done",)))
        lines = facts._sold.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
        back = facts.returns
        made[rows] = (back.rdd.getNumPartitions(), lines, sorted(map(str, back.collect())), sorted(map(str, facts.channels.collect())))
        assert [spark.conf.get(k, None) for k in keep] == before
    (few, many, *one), (more, less, *two) = made.values()
    assert one == two and len(one[1]) == 3 and "'above_sold'" in str(one[0])
    assert few == 16 and more == 40 and less < many and less <= 60


def test_orders_are_counted_in_tasks_that_follow_the_lines(spark, monkeypatch):
    from tabloom.operators import order

    monkeypatch.setattr(order, "ROWS", 10)
    sold = spark.range(90).select((F.col("id") / 2).cast("long").alias("order_id"), F.concat(F.lit("x"), F.col("id") % 3).alias("channel"), *[F.lit(2).cast("decimal(18,2)").alias(c) for c in ("paid", "refund", "net", "cost", "reversal", "margin")])
    facts = MultiFact({"sales": sold}, Policy(date(2024, 1, 1), date(2024, 1, 31), ("done",)))
    facts.__dict__["_sold"] = sold
    with order.spread(spark, 100):
        out = facts._by("channel")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert any("channel#" in line and "order_id#" in line and ", 40)" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line)
    assert {r.channel: (r.orders, r.paid) for r in out.collect()} == {f"x{i}": (30, 60) for i in range(3)}


def test_capped_returns_are_read_in_batches_of_many_lines(spark, tmp_path):
    """No group for each line; a line goes on from batch to batch, and what is unknown stays so, as in the SQL."""
    import duckdb
    from tabloom import catalog

    dice = random.Random(7)
    orders = [(i, dice.choice([1, 2, 3, 3, 3, 4, None, 99]), dice.choice([90_000.0, 150_000.0, 350_000.0, 450_000.0, 0.0, None, float("nan")])) for i in range(400)]
    orders += [(400, 5, float("-inf")), (401, 5, float("inf")), (402, 5, 1.0), (403, 6, 1.0), (None, 6, 400_000.0), (404, 6, 399_999.0), (405, 6, 0.5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 7, None)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(catalog.ORACLES["returns_capped"]).fetchall()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = catalog.QUERIES["returns_capped"](spark, str(tmp_path))
        got = [(r.o_custkey, r.o_orderkey, r.accepted) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, got)) == sorted(map(str, want)) and {a for *_, a in got} == {True, False, None}
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
