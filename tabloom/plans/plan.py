"""Plans: steps with named inputs and outputs, as plain data. Checked as a whole, then lowered without running anything."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tabloom.operators import aggregate, clean, dedup, finance, joins, masters, matching, profile, quality, relational, stats, validation
from tabloom.operators.order import nothing_written
from tabloom.operators.relational import OperatorError
from tabloom.reports import adaptive, commerce, multifact, operations, orders, restaurant, sales

MAX_STEPS, MAX_BYTES = 20, 256_000


@dataclass(frozen=True)
class Operation:
    """run(inputs, params) -> outputs; always one named primary. required and optional name the parameters."""

    run: Callable[[list[DataFrame], dict], dict[str, DataFrame]]
    inputs: tuple[int, int | None]
    required: frozenset[str]
    optional: frozenset[str] = frozenset()


REGISTRY: dict[str, Operation] = {}


def register(name: str, inputs: tuple[int, int | None], required=(), optional=()):
    """The extension point: plans carry data only, so new work is a new registered operation."""

    def add(f):
        REGISTRY[name] = Operation(f, inputs, frozenset(required), frozenset(optional))
        return f

    return add


def _one(name, f, required=(), optional=(), primary=None):
    def run(inputs, params):
        out = f(inputs[0], **params)
        if isinstance(out, DataFrame):
            return {"primary": out}
        out = {k: v for k, v in out.items() if isinstance(v, DataFrame)}
        return out if primary is None else {"primary": out[primary], **{k: v for k, v in out.items() if k != primary}}

    register(name, (1, 1), required, optional)(run)


_one("clean", clean.smart_clean, (), ("missing", "fill", "dedupe", "keys", "infer", "trim", "order_by"))
_one("normalize_fields", clean.normalize_fields, ("columns",), ("form", "case", "mapping"))
_one("select", relational.select_rename_sort, (), ("columns", "rename", "sort_by", "tie", "nulls_last"))
_one("filter", relational.filter_rows, ("rules",), ("how",))
_one("replace", relational.replace_values, ("rules",))
_one("fill_missing", relational.fill_missing, (), ("values", "default", "columns"))
_one("derive_columns", relational.derive_columns, ("formulas",), ("errors",))
_one("partition", relational.partition_rows, ("rules",), ("reason", "joint"))
_one("mask", relational.mask_columns, ("rules",), ("salt", "char", "keep_start", "keep_end"))
_one("deduplicate", dedup.guarded_dedup, ("keys",), ("allow_conflicts", "order_by"))
_one("drop_duplicates", dedup.drop_duplicates, (), ("keys", "keep", "order_by"))
_one("summary", aggregate.group_summary, ("by", "aggregations"), ("dropna", "order", "sort"))
_one("trend", aggregate.trend, ("date", "values"), ("grain", "how", "by"))
_one("trend_report", aggregate.trend_report, ("date", "values"), ("grain", "how", "by"))
_one("contribution", aggregate.contribution, ("category", "value"), ("how", "core", "top"))
_one("pivot", aggregate.cross_pivot, ("index", "column"), ("value", "how", "fill", "margins"))
_one("correlation", aggregate.correlation, ("columns",), ("method",))
_one("outliers", stats.outliers, ("key", "columns"), ("method", "factor"))
_one("rfm", stats.rfm, ("customer", "date", "amount"), ("transaction", "reference", "quantiles"), "customers")
_one("validate", validation.validate, ("rules", "key"), (), "results")
_one("scope", validation.in_scope, (), ("date", "start", "stop", "entities"))
_one("ar_aging", finance.ar_aging, ("party", "due", "amount", "paid", "as_of"), ("buckets",), "detail")
_one("budget_variance", finance.budget_variance, ("by", "actual", "budget"), ("view",))
_one("cash_flow", finance.cash_flow, ("date", "direction", "category", "amount", "inflow", "outflow"), (), "monthly")
_one("journal_audit", finance.journal_audit, ("voucher", "debit", "credit"), ("tolerance",), "vouchers")
_one("describe", aggregate.describe, ("columns",), ("percentiles",))
_one("quality", profile.quality_metrics)
_one("quality_report", quality.quality_report, (), ("keys",))
_one("profile_columns", quality.profile_columns, (), ("samples", "exact"))
_one("profile", profile.profile, (), ("exact",))
_one("split", relational.split_rows, ("rows_per_table", "order_by"))
_one("financial_ratios", finance.financial_ratios, ("key",), (), "wide")
_one("sales_report", sales.sales_report, ("date", "product", "seller", "region", "quantity", "sales", "cost"), ("satisfaction",))
_one("order_analysis", sales.order_analysis, ("order", "line", "amount", "discount", "refund", "store", "product", "date"))
_one("selection", sales.selection, ("entry", "scores"), ("comments", "penalties", "bonuses", "top", "source_order"))
_one("restaurant_diagnosis", restaurant.diagnosis, (), ("store", "month"))
_one("fuzzy_clusters", matching.cluster_similar, ("column",), ("threshold", "max_unique"))


@register("join", (2, 2), (), ("on", "left_on", "right_on", "how", "suffixes", "validate", "allow_many_to_many", "max_output_rows"))
def _join(inputs, params):
    return {"primary": joins.join_tables(*inputs, **params)}


@register("lookup", (2, 2), ("source_key", "lookup_key", "values"), ("keep", "order_by", "match"))
def _lookup(inputs, params):
    return {"primary": joins.lookup_match(*inputs, **params)}


@register("attribute_join", (2, 2), ("left_key", "right_key", "fields"))
def _attributes(inputs, params):
    return {"primary": masters.attribute_join(*inputs, **params)}


@register("recipe", (1, 1), ("recipe",))
def _recipe(inputs, params):
    from .recipe import Recipe

    return {"primary": Recipe.from_json(json.dumps(params["recipe"])).run(inputs[0])}


@register("compare", (2, 2), ("keys",), ("columns", "duplicates", "order_by"))
def _compare(inputs, params):
    out = joins.compare_tables(*inputs, **params)
    return {"primary": out["modified"], **out}


@register("fuzzy_lookup", (2, 2), ("source_key", "lookup_key", "values"), ("threshold", "gap"))
def _fuzzy(inputs, params):
    return {"primary": matching.fuzzy_lookup(*inputs, **params)}


@register("reconcile", (2, 2), ("key", "amount", "date"), ("secondary", "left_id", "right_id", "tolerance", "days", "rounding", "splits"))
def _reconcile(inputs, params):
    out = matching.reconcile(*inputs, **params)
    return {"primary": out["links"], **out}


def _many(name, f, low, high, required=(), optional=(), primary=None):
    """An operation over several tables in order."""

    def run(inputs, params):
        out = f(*inputs, **params)
        return {"primary": out} if isinstance(out, DataFrame) else {"primary": out[primary], **{k: v for k, v in out.items() if k != primary}}

    register(name, (low, high), required, optional)(run)


_many("split_groups", matching.split_groups, 2, 2, ("amount", "date"), ("left_id", "right_id", "tolerance", "days", "parts", "max_combinations"), "groups")
_many("inventory", operations.inventory, 2, 2, ("sku", "days"), ("multiplier",))
_many("workforce", operations.workforce, 3, 3, ("person",), ("workdays", "excellent", "attention"))
_many("customer_orders", orders.order_analysis, 2, 4, (), ("low_margin",), "primary")
_many("commerce_diagnosis", commerce.diagnosis, 6, 6, (), (), "primary")
_one("adaptive_report", adaptive.adaptive_report, (), ("top",))
_one("contract_issues", validation.contract_issues, ("contract",), ("key", "samples"))
_one("ordered_fingerprint", profile.ordered_fingerprint, ("order_by",), ("columns",))
_one("interval_overlaps", joins.interval_overlaps, ("key",), ("start", "stop", "name"))


@register("interval_join", (2, 2), ("key", "when", "value"), ("start", "stop", "output"))
def _interval(inputs, params):
    return {"primary": joins.interval_join(*inputs, **params)}


@register("quarterly_report", (1, None), ("names", "aliases"), ("dropped",))
def _quarterly(inputs, params):
    if len(params["names"]) != len(inputs):
        raise OperatorError("a name for each table")
    return dict(sales.quarterly_report(dict(zip(params["names"], inputs)), **{k: v for k, v in params.items() if k != "names"}))


#: Outputs of several facts that a plan may ask for.
FACTS = ("sales", "excluded_sales", "refunds", "returns", "purchases", "stock", "applications", "receivables", "cash", "settlements", "months", "orgs", "channels", "items", "checks")


@register("multifact", (1, None), ("names", "policy", "outputs"))
def _multifact(inputs, params):
    from datetime import date

    wanted = list(params["outputs"])
    if len(params["names"]) != len(inputs) or not wanted or set(wanted) - set(FACTS):
        raise OperatorError(f"a name for each table, and outputs among {', '.join(FACTS)}")
    rule = {k: date.fromisoformat(v) if k in ("start", "cutoff") else tuple(v) if isinstance(v, list) else v for k, v in params["policy"].items()}
    made = multifact.MultiFact(dict(zip(params["names"], inputs)), multifact.Policy(**rule))
    return {"primary": getattr(made, wanted[0]), **{name: getattr(made, name) for name in wanted}}


@register("union", (1, None), (), ("how", "source"))
def _union(inputs, params):
    return {"primary": relational.union_tables({f"input_{i + 1}": f for i, f in enumerate(inputs)}, **params)}


@dataclass(frozen=True)
class PlanStep:
    id: str
    operation: str
    inputs: tuple[str, ...]
    params: dict = field(default_factory=dict)


def parse(text: str | dict) -> list[PlanStep]:
    """Strict: unknown fields, operations, parameters or forward references are errors. inputs: table or $step[:artifact]."""
    if isinstance(text, str):
        if len(text.encode()) > MAX_BYTES:
            raise OperatorError("the plan is too large")
        text = json.loads(text)
    if set(text) - {"steps", "name"} or not 1 <= len(text.get("steps", [])) <= MAX_STEPS:
        raise OperatorError(f"a plan has between 1 and {MAX_STEPS} steps and no other fields")
    steps, known = [], set()
    for s in text["steps"]:
        if set(s) - {"id", "operation", "inputs", "params"} or not {"id", "operation", "inputs"} <= set(s):
            raise OperatorError("a step has id, operation, inputs and params")
        op = REGISTRY.get(s["operation"])
        if op is None:
            raise OperatorError(f"unknown operation: {s['operation']}")
        params = s.get("params", {})
        if missing := op.required - set(params):
            raise OperatorError(f"{s['id']}: missing {', '.join(sorted(missing))}")
        if unknown := set(params) - op.required - op.optional:
            raise OperatorError(f"{s['id']}: unknown {', '.join(sorted(unknown))}")
        low, high = op.inputs
        if len(s["inputs"]) < low or high is not None and len(s["inputs"]) > high:
            raise OperatorError(f"{s['id']}: wrong number of inputs")
        for i in s["inputs"]:
            if i.startswith("$") and i[1:].split(":")[0] not in known:
                raise OperatorError(f"{s['id']}: {i} is not an earlier step")
        if s["id"] in known:
            raise OperatorError(f"{s['id']} repeats")
        known.add(s["id"])
        steps.append(PlanStep(s["id"], s["operation"], tuple(s["inputs"]), params))
    return steps


def execute(plan: str | dict | list[PlanStep], tables: dict[str, DataFrame]) -> dict[str, dict[str, DataFrame]]:
    """Outputs of every step, lazily: step id -> artifact -> DataFrame."""
    steps = plan if isinstance(plan, list) else parse(plan)
    done: dict[str, dict[str, DataFrame]] = {}

    def find(ref: str) -> DataFrame:
        if not ref.startswith("$"):
            if ref not in tables:
                raise OperatorError(f"unknown table: {ref}")
            return tables[ref]
        step, _, artifact = ref[1:].partition(":")
        if (artifact or "primary") not in done[step]:
            raise OperatorError(f"{step} has no {artifact}")
        return done[step][artifact or "primary"]

    for s in steps:
        params = dict(s.params)
        if "sort_by" in params:
            params["sort_by"] = [tuple(x) for x in params["sort_by"]]
        try:
            done[s.id] = REGISTRY[s.operation].run([find(i) for i in s.inputs], params)
        except OperatorError as e:
            raise OperatorError(f"{s.id} ({s.operation}): {e}") from e
        for name, df in done[s.id].items():
            if len({c.lower() for c in df.columns}) < len(df.columns):
                raise OperatorError(f"{s.id}: {name} has repeated columns")
    return done


def preview(plan: str | dict, tables: dict[str, DataFrame]) -> list[dict]:
    """Shapes only: columns of every artifact, found on empty tables of the same columns. No table is read or written.

    Guards see no rows, so what only data can break is not reported; columns that follow from data (of a pivot) are those of an empty table.
    """
    empty = {n: df.sparkSession.createDataFrame([], df.schema) for n, df in tables.items()}
    with nothing_written():
        return [{"id": i, "artifacts": {k: v.columns for k, v in out.items()}} for i, out in execute(plan, empty).items()]
