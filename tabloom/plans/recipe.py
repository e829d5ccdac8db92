"""Recipes: versioned JSON lists of steps over one table."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tabloom.operators import aggregate, clean, dedup, relational
from tabloom.operators.relational import OperatorError

VERSION, MAX_STEPS, MAX_BYTES = 1, 100, 1_000_000

#: Step -> (function, parameters it takes).
STEPS = {
    "clean": (clean.smart_clean, {"trim", "blanks_to_null", "drop_empty_rows", "drop_empty_columns", "infer", "missing", "fill", "subset", "dedupe", "keys", "order_by"}),
    "replace": (relational.replace_values, {"rules"}),
    "select": (relational.select_rename_sort, {"columns", "rename", "sort_by", "nulls_last", "tie"}),
    "fill_missing": (relational.fill_missing, {"values", "default", "columns"}),
    "drop_duplicates": (dedup.drop_duplicates, {"keys", "keep", "order_by"}),
    "filter": (relational.filter_rows, {"rules", "how"}),
    "group_summary": (aggregate.group_summary, {"by", "aggregations", "dropna", "order", "sort"}),
}


@dataclass(frozen=True)
class Step:
    kind: str
    params: dict = field(default_factory=dict)
    enabled: bool = True


@dataclass(frozen=True)
class Recipe:
    name: str
    steps: tuple[Step, ...]

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        if len(text.encode()) > MAX_BYTES:
            raise OperatorError("the recipe is too large")
        data = json.loads(text)
        if set(data) - {"version", "name", "steps"} or data.get("version") != VERSION:
            raise OperatorError("not a recipe of this version")
        steps = []
        if not 1 <= len(data["steps"]) <= MAX_STEPS:
            raise OperatorError(f"between 1 and {MAX_STEPS} steps")
        for i, s in enumerate(data["steps"]):
            if set(s) - {"kind", "params", "enabled"} or s.get("kind") not in STEPS:
                raise OperatorError(f"step {i + 1}: unknown kind or field")
            unknown = set(s.get("params", {})) - STEPS[s["kind"]][1]
            if unknown:
                raise OperatorError(f"step {i + 1}: unknown parameters {', '.join(sorted(unknown))}")
            steps.append(Step(s["kind"], s.get("params", {}), s.get("enabled", True)))
        return cls(data.get("name", ""), tuple(steps))

    def to_json(self) -> str:
        return json.dumps({"version": VERSION, "name": self.name, "steps": [{"kind": s.kind, "params": s.params, "enabled": s.enabled} for s in self.steps]})

    def run(self, df: DataFrame) -> DataFrame:
        """A fold of lazy transformations; names must stay unique after each."""
        for i, s in enumerate(self.steps):
            if not s.enabled:
                continue
            params = dict(s.params)
            if "sort_by" in params:
                params["sort_by"] = [tuple(x) for x in params["sort_by"]]
            try:
                df = STEPS[s.kind][0](df, **params)
            except OperatorError as e:
                raise OperatorError(f"step {i + 1} ({s.kind}): {e}") from e
            if len({c.lower() for c in df.columns}) < len(df.columns):
                raise OperatorError(f"step {i + 1} ({s.kind}) makes names repeat")
        return df
