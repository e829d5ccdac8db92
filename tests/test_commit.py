"""Outputs that are committed together, runs that die, and bookmarks."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators.relational import OperatorError
from tabloom.sources.commit import bookmark, commit_outputs, committed, read_committed, take_new


def test_a_run_that_dies_between_two_writes(spark, tmp_path):
    folder = str(tmp_path / "out")
    one, two = spark.range(10), spark.range(5).withColumn("x", F.lit("a"))
    with pytest.raises(OperatorError):
        read_committed(spark, folder, "one")
    commit_outputs({"one": one, "two": two}, folder, "r1", {"src": "10"})
    fatal = spark.range(20).withColumn("x", F.when(F.col("id") == 7, F.raise_error(F.lit("dies"))).otherwise(F.lit("b")))
    with pytest.raises(Exception, match="dies"):
        commit_outputs({"one": spark.range(100), "two": fatal}, folder, "r2", {"src": "20"})
    assert (tmp_path / "out" / "run-r2" / "one").exists()  # written, and seen by nobody
    assert (read_committed(spark, folder, "one").count(), read_committed(spark, folder, "two").count(), bookmark(spark, folder, "src")) == (10, 5, "10")
    made = commit_outputs({"one": spark.range(100), "two": two.union(two)}, folder, "r2", {"src": "20"})
    assert made["rows"] == {"one": 100, "two": 10} and (read_committed(spark, folder, "one").count(), bookmark(spark, folder, "src")) == (100, "20")
    assert commit_outputs({"one": spark.range(1)}, folder, "r2") == made == committed(spark, folder)  # not done twice
    commit_outputs({"one": spark.range(3)}, folder, "r3")
    assert (read_committed(spark, folder, "one").count(), read_committed(spark, folder, "two").count(), bookmark(spark, folder, "src")) == (3, 10, "20")


def test_bookmarks_move_with_the_data(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.createDataFrame([(i, i if i % 4 else None) for i in range(12)], "id long, at long")
    seen = []
    for n, upto in enumerate((6, 6, 12)):
        new, marks = take_new(df.where(F.col("id") < upto), "at", folder, "t")
        seen.append(sorted(r.id for r in new.collect()))
        commit_outputs({"new": new}, folder, f"r{n}", marks)
    assert seen == [[1, 2, 3, 5], [], [6, 7, 9, 10, 11]] and bookmark(spark, folder, "t") == "11"
