"""What a plan did: row counts observed while it runs, fingerprints, acceptance."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.profile import fingerprint
from tabloom.sources.files import verify_delivery


class Run:
    """Counts rows of named artifacts as they pass, without an action of their own."""

    def __init__(self, name: str):
        self.name, self.id, self.started = name, uuid.uuid4().hex, datetime.now(timezone.utc)
        self.seen: dict[str, Observation] = {}

    def watch(self, artifact: str, df: DataFrame) -> DataFrame:
        self.seen[artifact] = Observation(f"{artifact}-{self.id}")
        return df.observe(self.seen[artifact], F.count(F.lit(1)).alias("rows"))

    def log(self) -> list[dict]:
        """A record for each watched artifact that an action has computed."""
        return [{"run": self.id, "name": self.name, "artifact": a, "rows": o.get["rows"], "started": self.started.isoformat()} for a, o in self.seen.items()]

    def save(self, spark: SparkSession, path: str) -> None:
        """Appends the records to the lineage table."""
        spark.createDataFrame(self.log(), "run string, name string, artifact string, rows long, started string").write.mode("append").parquet(path)


def accept(inputs: dict[str, tuple[DataFrame, DataFrame]], delivered: dict[str, tuple[DataFrame, DataFrame]], reviews: DataFrame | None = None) -> dict:
    """inputs: name -> (before, after), which must be equal; delivered: name -> (read back, meant); reviews must be empty."""
    same = lambda a, b: tuple(fingerprint(a).first()) == tuple(fingerprint(b).first())
    out = {"inputs_unchanged": all(same(a, b) for a, b in inputs.values()), "delivered": all(verify_delivery(a, b)["ok"] for a, b in delivered.values()), "no_reviews": reviews is None or reviews.isEmpty()}
    return out | {"accepted": all(out.values())}


def save_task(spark: SparkSession, path: str, tables: dict[str, DataFrame], note: dict | None = None) -> None:
    """Tables as Parquet and a manifest, under a folder that must be new."""
    rows = []
    for k, (name, df) in enumerate(sorted(tables.items())):
        df.write.parquet(f"{path}/table-{k}")
        rows.append((name, f"table-{k}", json.dumps(df.schema.jsonValue()), json.dumps(note or {})))
    spark.createDataFrame(rows, "name string, folder string, table_schema string, note string").coalesce(1).write.json(f"{path}/manifest")


def load_task(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    from pyspark.sql.types import StructType

    rows = spark.read.json(f"{path}/manifest").collect()  # a row for each table
    return {r.name: spark.read.schema(StructType.fromJson(json.loads(r.table_schema))).parquet(f"{path}/{r.folder}") for r in rows}
