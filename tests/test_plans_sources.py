import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tabloom.operators.relational import OperatorError
from tabloom.plans import plan as P
from tabloom.plans.recipe import Recipe
from tabloom.plans.sqlguard import check_read_only, query_tables
from tabloom.sources import files, xlsx
from tabloom import streaming


@pytest.mark.parametrize("bad", ["drop table x", "select 1; select 2", "insert into a select 1", "with a as (select 1) delete from b", "", "set x=1"])
def test_guard_refuses(bad):
    with pytest.raises(OperatorError):
        check_read_only(bad)


def test_guard_allows(spark):
    assert check_read_only("SELECT 'drop; table' AS x -- delete\n;")
    with pytest.raises(OperatorError):
        query_tables(spark, "select * from t", {"t": spark.range(5)}, max_rows=4)


def test_plan_refuses(spark):
    step = {"id": "a", "operation": "filter", "inputs": ["t"], "params": {"rules": []}}
    for bad in ({"steps": []}, {"steps": [step | {"operation": "nope"}]}, {"steps": [step | {"params": {"rules": [], "code": 1}}]}, {"steps": [step | {"inputs": ["$z"]}]}, {"steps": [step, step]}, {"steps": [step | {"x": 1}]}):
        with pytest.raises(OperatorError):
            P.parse(json.dumps(bad))
    assert P.preview({"steps": [step]}, {"t": spark.range(3)}) == [{"id": "a", "artifacts": {"primary": ["id"]}}]


def test_recipe_round_trip(spark):
    r = Recipe.from_json(json.dumps({"version": 1, "name": "x", "steps": [{"kind": "filter", "params": {"rules": [{"column": "id", "op": "gt", "value": 1}]}}, {"kind": "select", "params": {"columns": ["id"]}, "enabled": False}]}))
    assert Recipe.from_json(r.to_json()) == r and r.run(spark.range(4)).count() == 2
    with pytest.raises(OperatorError):
        Recipe.from_json(json.dumps({"version": 1, "steps": [{"kind": "filter", "params": {"f": 1}}]}))


def test_csv_keeps_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,x\n007,NA,\n008,"a,b\nc",=1+1\n')
    df = files.read_table(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("007", "NA", ""), ("008", "a,b\nc", "=1+1")]
    files.write_csv(df, str(tmp_path / "out"))
    assert "'=1+1" in {r.x for r in files.read_csv(spark, str(tmp_path / "out")).collect()}


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("=x", 2.0), (None, None)], "s string, v double")
    xlsx.write_workbook(str(tmp_path / "w.xlsx"), {"One/Two": df, "one_two": df})
    got = xlsx.read_workbook(spark, str(tmp_path / "w.xlsx"))
    assert list(got) == ["One_Two", "one_two_2"]
    assert [tuple(r) for r in got["One_Two"].collect()] == [("a", "1.5"), ("'=x", "2.0"), (None, None)]
    with pytest.raises(OperatorError):
        xlsx.write_workbook(str(tmp_path / "y.xlsx"), {"t": df}, max_rows=2)


def test_export_verified(spark, tmp_path):
    df = spark.range(10).withColumn("s", F.col("id").cast("string"))
    assert files.export_verified(df, str(tmp_path / "p"))["ok"]
    assert not files.verify_delivery(df.limit(9), df)["ok"]


def test_header_promotion(spark):
    df = spark.createDataFrame([(0, "Report", None, ""), (1, "Date", "Amount", "Region"), (2, "2024-01-01", "5", "east"), (3, "", None, "")], "n int, a string, b string, c string")
    out = files.promote_header(df, [{"date"}, {"amount"}, {"region"}], "n", least=3)
    assert out.columns == ["n", "Date", "Amount", "Region"] and out.count() == 1


def test_streaming(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.windowed_trend(stream, "ts", "value", how="count", by=["event_type"]).writeStream.outputMode("complete").format("memory").queryName("trend").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("trend").agg(F.sum("value")).first()[0] == events.count()
    streaming.catch_up(streaming.distinct_events(stream, "ts", ["event_id"], "40 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_audit_and_tasks(spark, tmp_path):
    from tabloom.plans import audit

    run, df = audit.Run("r"), spark.range(7).withColumn("s", F.lit("x"))
    run.watch("numbers", df).write.parquet(str(tmp_path / "o"))
    assert [(x["artifact"], x["rows"]) for x in run.log()] == [("numbers", 7)]
    run.save(spark, str(tmp_path / "lineage"))
    assert spark.read.parquet(str(tmp_path / "lineage")).count() == 1
    audit.save_task(spark, str(tmp_path / "task"), {"a": df, "b/1": df.limit(2)}, {"by": "me"})
    got = audit.load_task(spark, str(tmp_path / "task"))
    assert {k: v.count() for k, v in got.items()} == {"a": 7, "b/1": 2} and got["a"].columns == ["id", "s"]
    assert audit.accept({"a": (df, df)}, {"a": (got["a"], df)})["accepted"]
    assert not audit.accept({"a": (df, df.limit(1))}, {}, df)["accepted"]


def test_preview_runs_nothing(spark):
    """Ranking, quantiles and guards work on empty tables: no job is started."""
    from tabloom.plans import plan as P

    df = spark.createDataFrame([(i % 7, date(2024, 1, 1), float(i), "p") for i in range(50)], "c int, d date, a double, p string")
    steps = [{"id": "r", "operation": "rfm", "inputs": ["t"], "params": {"customer": "c", "date": "d", "amount": "a"}}, {"id": "o", "operation": "outliers", "inputs": ["t"], "params": {"key": ["c"], "columns": ["a"]}}, {"id": "s", "operation": "sales_report", "inputs": ["t"], "params": {"date": "d", "product": "p", "seller": "p", "region": "p", "quantity": "a", "sales": "a", "cost": "a"}}]
    spark.sparkContext.setJobGroup("preview", "preview")
    shapes = {s["id"]: s["artifacts"] for s in P.preview({"steps": steps}, {"t": df})}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "segment" in shapes["r"]["primary"] and "score" in shapes["o"]["primary"] and "rank" in shapes["s"]["products"]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("preview")) == 0


def test_the_parser_guards_every_entry(spark):
    from tabloom.plans.sqlguard import check_parsed

    t = {"t": spark.range(3)}
    assert query_tables(spark, "with x as (select id from t) select count(*) n from x where id > 0", t).first().n == 2
    for bad in ("with x as (select 1) insert into t select * from x", "select * from (select 1", "values (1)"):
        with pytest.raises(OperatorError):
            query_tables(spark, bad, t)
    assert check_parsed(spark, "select top 3 * from [t]", other_dialect=True)
    with pytest.raises(OperatorError):
        check_parsed(spark, "select 1; drop table t", other_dialect=True)


def test_plans_over_several_tables(spark):
    left = spark.createDataFrame([("L1", 30.0, date(2024, 1, 1))], "id string, v double, d date")
    right = spark.createDataFrame([("R1", 10.0, date(2024, 1, 1)), ("R2", 20.0, date(2024, 1, 1))], "id string, v double, d date")
    bands = spark.createDataFrame([("R1", date(2023, 1, 1), None, 5.0)], "id string, start date, stop date, p double")
    steps = [
        {"id": "s", "operation": "split_groups", "inputs": ["l", "r"], "params": {"amount": "v", "date": "d"}},
        {"id": "i", "operation": "interval_join", "inputs": ["r", "b"], "params": {"key": "id", "when": "d", "value": "p"}},
        {"id": "m", "operation": "mask", "inputs": ["r"], "params": {"rules": {"id": "partial"}, "char": "#", "keep_end": 0}},
        {"id": "q", "operation": "quarterly_report", "inputs": ["q1"], "params": {"names": ["one"], "aliases": {}}},
    ]
    q1 = spark.createDataFrame([("a", "2024-01-01", "p", "s", "n", "1", "10", "4", "done")], "order_id string, date string, product string, seller string, region string, quantity string, sales string, cost string, status string")
    out = P.execute({"steps": steps}, {"l": left, "r": right, "b": bands, "q1": q1})
    assert [tuple(r)[1:4] for r in out["s"]["primary"].collect()] == [("L1", "R1", "R2")]
    assert sorted((r.id, r.p) for r in out["i"]["primary"].collect()) == [("R1", 5.0), ("R2", None)]
    assert sorted(r.id for r in out["m"]["primary"].collect()) == ["R#", "R#"] and out["q"]["regions"].count() == 1
