"""Rule engine, quality gate, data contracts and scope filters."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import col, is_missing

from .relational import OperatorError, require_columns

#: Constructs a rule's pattern may not use.
FORBIDDEN = re.compile(r"\(\?[<!=P]|\\[1-9]|\(\?\(")


def safe_pattern(pattern: str) -> str:
    if len(pattern) > 256 or FORBIDDEN.search(pattern):
        raise OperatorError("the pattern is too long or uses look-around or back references")
    re.compile(pattern)
    return pattern


def failure(rule: dict) -> Column:
    """True where a row breaks the rule; unique is decided by a window. Nulls pass all rules but not_null."""
    kind, c = rule["rule"], rule.get("column")
    x = col(c) if isinstance(c, str) else None
    if kind == "not_null":
        return is_missing(c) if rule.get("blank", True) else x.isNull()
    if kind == "unique":
        keys = [c] if isinstance(c, str) else list(c)
        known = reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys])
        return (known | F.lit(rule.get("nulls", False))) & (F.count("*").over(Window.partitionBy(*keys)) > 1)
    if kind == "range":
        v = x if rule.get("as") == "date" else x.try_cast("double")
        tests = [v < F.lit(rule["min"])] * ("min" in rule) + [v > F.lit(rule["max"])] * ("max" in rule)
        return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False)) | (x.isNotNull() & v.isNull())
    if kind == "regex":
        p, how = safe_pattern(rule["pattern"]), rule.get("match", "fullmatch")
        p = {"fullmatch": f"^(?:{p})$", "match": f"^(?:{p})", "search": p}[how]
        return F.coalesce(~x.cast("string").rlike(p), F.lit(False))
    if kind == "allowed_values":
        return F.coalesce(~x.isin(*rule["values"]), F.lit(False))
    if kind == "numeric":
        text = F.trim(x.cast("string"))
        good = text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$")
        if rule.get("integer_only"):
            good = good & (text.try_cast("double") == F.floor(text.try_cast("double")))
        return x.isNotNull() & ~F.coalesce(good, F.lit(False))
    if kind == "date":
        d = F.try_to_timestamp(x.cast("string"), F.lit(rule["format"])) if rule.get("format") else F.try_to_timestamp(x.cast("string"))
        bad = d.isNull()
        for name, test in (("min", lambda v: d < v), ("max", lambda v: d > v)):
            if name in rule:
                bad = bad | F.coalesce(test(F.lit(rule[name]).cast("timestamp")), F.lit(False))
        return x.isNotNull() & bad
    if kind == "column_compare":
        a, b = x, col(rule["other"])
        if rule.get("as") == "numeric":
            a, b = a.try_cast("double"), b.try_cast("double")
        ok = {"eq": a == b, "ne": a != b, "gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[rule["op"]]
        return F.coalesce(~ok, F.lit(False))
    raise OperatorError(f"unknown rule: {kind}")


def _name(rule: dict, i: int) -> str:
    return rule.get("name") or f"{rule['rule']}_{rule['column'] if isinstance(rule['column'], str) else '_'.join(rule['column'])}_{i}"


def validate(df: DataFrame, rules: list[dict], key: list[str]) -> dict[str, DataFrame]:
    """failures (key, rule, severity), a row for each; results (rule, severity, rows, failed), a row for each rule."""
    for r in rules:
        require_columns(df, *([r["column"]] if isinstance(r["column"], str) else r["column"]))
    flags = df.select(*key, *[failure(r).alias(f"_bad{i}") for i, r in enumerate(rules)])
    marks = [F.struct(F.lit(_name(r, i)).alias("rule"), F.lit(r.get("severity", "error")).alias("severity"), F.col(f"_bad{i}").alias("bad")) for i, r in enumerate(rules)]
    long = flags.select(*key, F.explode(F.array(*marks)).alias("m")).select(*key, "m.*")
    return {"failures": long.where("bad").drop("bad"), "results": long.groupBy("rule", "severity").agg(F.count("*").alias("checked"), F.count_if("bad").alias("failed"))}


def quality_gate(df: DataFrame, rules: list[dict], key: list[str]) -> DataFrame:
    """The input, or an error if a rule of severity error fails."""
    bad = validate(df, rules, key)["results"].where("severity = 'error' and failed > 0").collect()  # a row for each rule
    if bad:
        raise OperatorError("; ".join(f"{r.rule}: {r.failed}" for r in sorted(bad)))
    return df


def infer_contract(df: DataFrame, most_values: int = 30) -> dict:
    """Types, null and unique facts, small value sets and ranges, from one aggregate."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(col(c)).alias(f"k{i}"), F.count_distinct(col(c)).alias(f"d{i}"), F.min(col(c)).cast("string").alias(f"lo{i}"), F.max(col(c)).cast("string").alias(f"hi{i}")]
    r = df.agg(*aggs).first().asDict()
    out = {"rows": r["n"], "columns": {}}
    for i, (c, t) in enumerate(df.dtypes):
        spec = {"type": t, "nullable": r[f"k{i}"] < r["n"], "unique": r[f"d{i}"] == r["n"] > 0}
        if t == "string" and 0 < r[f"d{i}"] <= most_values and not spec["unique"]:
            spec["allowed"] = sorted(x[0] for x in df.select(c).where(col(c).isNotNull()).distinct().collect())
        elif t != "string":
            spec |= {"min": r[f"lo{i}"], "max": r[f"hi{i}"]}
        out["columns"][c] = spec
    return out


_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}


def cross_field(rule: dict, columns: list[str]) -> Column:
    """True for rows that break a rule over several fields.

    compare: {fields: [left, right], operator}, held where a field is null. formula and balance: {fields, coefficients, expected, tolerance}: the
    weighted sum of the numbers among the fields must lie within the tolerance of what is expected (0), missing ones counting 0; rows
    without any number are held. Rules are data: an unknown type, operator, field or coefficient is an error before anything is read.
    """
    kind, fields = rule.get("type", "compare"), [str(f) for f in rule.get("fields", ())]
    if kind not in ("compare", "formula", "balance") or not fields or len(fields) > 8 or set(fields) - set(columns):
        raise OperatorError(f"no such rule over several fields: {kind} of {', '.join(fields)}")
    if kind == "compare":
        if rule.get("operator") not in _COMPARE or len(fields) != 2:
            raise OperatorError("a comparison has two fields and one of " + ", ".join(_COMPARE))
        return ~F.coalesce(_COMPARE[rule["operator"]](*map(col, fields)), F.lit(True))
    weights = {str(k): float(v) for k, v in dict(rule.get("coefficients", {})).items()}
    if set(weights) != set(fields) or any(not math.isfinite(w) or abs(w) > 1_000_000 for w in weights.values()):
        raise OperatorError("a formula has a coefficient of at most a million for each field")
    numbers = {f: col(f).cast("string").try_cast("double") for f in fields}
    numbers = {f: F.when(~F.isnan(x), x) for f, x in numbers.items()}
    total = reduce(lambda a, b: a + b, [F.coalesce(numbers[f] * w, F.lit(0.0)) for f, w in weights.items()])
    some = reduce(lambda a, b: a | b, [x.isNotNull() for x in numbers.values()])
    return some & (F.abs(total - float(rule.get("expected", 0.0))) > float(rule.get("tolerance", 0.0)))


def _row_checks(df: DataFrame, contract: dict) -> list[tuple[str, str, str, Column]]:
    """(code, column, severity, broken) of all checks that look at one row."""
    out = []
    for c, spec in contract["columns"].items():
        if c not in df.columns:
            continue
        x = col(c)
        if not spec.get("nullable", True):
            out.append(("NULLS", c, "error", x.isNull() | (F.trim(x.cast("string")) == "")))
        if spec.get("allowed"):
            out.append(("NOT_ALLOWED", c, "error", ~x.isin(*spec["allowed"])))
        bounds = [(side, F.lit(spec[side]).cast(df.schema[c].dataType)) for side in ("min", "max") if spec.get(side) is not None]
        if bounds:
            out.append(("RANGE", c, "warning", reduce(lambda a, b: a | b, [x < v if side == "min" else x > v for side, v in bounds])))
        if spec.get("pattern"):
            out.append(("PATTERN", c, "error", ~x.cast("string").rlike(f"^(?:{safe_pattern(spec['pattern'])})$")))
    for rule in contract.get("cross", []):
        bad = cross_field(rule, df.columns) if "fields" in rule else cross_field({**rule, "type": "compare", "fields": [rule["left"], rule["right"]], "operator": {"lte": "le", "gte": "ge"}.get(rule["op"], rule["op"])}, df.columns)
        out.append(("CROSS_FIELD", rule.get("name") or ",".join(rule["fields"] if "fields" in rule else (rule["left"], rule["right"])), "error", bad))
    return out


def contract_issues(df: DataFrame, contract: dict, key: str | None = None, samples: int = 20) -> DataFrame:
    """(code, column_name, severity, rows): what df breaks of a contract; with a key also samples, the smallest keys of rows that break a check.

    Broken rows are counted where they are read, a row for each check. Of their keys every part of a check keeps `samples`, and of those the check;
    no check's rows are gathered. All rows of a repeated value break uniqueness.
    """
    spark, have = df.sparkSession, dict(df.dtypes)
    found = []
    for c, spec in contract["columns"].items():
        if c not in have:
            found += [("MISSING_COLUMN", c, "error", 0)] if spec.get("required", True) else []
        elif spec.get("type") and have[c] != spec["type"]:
            found.append(("TYPE", c, "error", 0))
    found += [("EXTRA_COLUMN", c, "warning", 0) for c in have if c not in contract["columns"] and not contract.get("allow_extra", False)]
    checks = _row_checks(df, contract)
    keys = [col(key).cast("string").alias("_key")] if key else []
    broken = df.select(*keys, F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(i)) for i, (*_, bad) in enumerate(checks)]).cast("array<int>"))).alias("_i")) if checks else None
    names = [x[:3] for x in checks]
    for c, spec in contract["columns"].items():
        if spec.get("unique") and c in have:
            twice = df.where(col(c).isNotNull()).groupBy(col(c).alias("_v")).agg(F.count("*").alias("_n")).where("_n > 1")
            more = df.join(twice, col(c) == F.col("_v")).select(*keys, F.lit(len(names)).alias("_i"))
            broken = more if broken is None else broken.union(more)
            names.append(("NOT_UNIQUE", c, "error"))
    low, high = contract.get("rows_between", (0, None))
    limits = spark.createDataFrame([(low, high if high is not None else 2**63 - 1)], "_low long, _high long")
    out = df.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(limits)).where("rows < _low or rows > _high").select(F.lit("ROWS").alias("code"), F.lit(None).cast("string").alias("column_name"), F.lit("error").alias("severity"), "rows")
    out = spark.createDataFrame(found, "code string, column_name string, severity string, rows long").union(out)
    if key:
        out = out.withColumn("samples", F.array().cast("array<string>"))
    if broken is not None:
        what = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "_i int, code string, column_name string, severity string")
        counts = broken.groupBy("_i").agg(F.count("*").alias("rows"))
        made = F.broadcast(what).join(counts, "_i")
        if key:
            few = broken.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(64)))
            for part in (["_i", "_part"], ["_i"]):
                few = few.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy("_key"))).where(F.col("_r") <= samples).drop("_r")
            made = made.join(few.groupBy("_i").agg(F.array_sort(F.collect_list("_key")).alias("samples")), "_i")
        out = out.unionByName(made.drop("_i"))
    return out


def in_scope(df: DataFrame, date: str | None = None, start: str | None = None, stop: str | None = None, entities: dict[str, list] | None = None) -> dict[str, DataFrame]:
    """primary: rows in the half-open period [start, stop) and with the wanted entities; excluded: the rest with reasons."""
    tests = []
    if date and start:
        tests.append(("before_period", col(date) >= F.lit(start).cast("timestamp")))
    if date and stop:
        tests.append(("after_period", col(date) < F.lit(stop).cast("timestamp")))
    tests += [(f"other_{c}", col(c).isin(*v)) for c, v in (entities or {}).items()]
    reasons = F.concat_ws("; ", *[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests])
    marked = df.withColumn("scope_reason", reasons)
    return {"primary": marked.where("scope_reason = ''").drop("scope_reason"), "excluded": marked.where("scope_reason <> ''")}


def through_cutoff(df: DataFrame, date: str, cutoff: str) -> dict[str, DataFrame]:
    """primary: rows up to the end of the cutoff day; rest: the others with a reason."""
    end = F.date_add(F.lit(cutoff).cast("date"), 1).cast("timestamp")
    ok = F.coalesce(col(date) < end, F.lit(False))
    return {"primary": df.where(ok), "rest": df.where(~ok).withColumn("reason", F.when(col(date).isNull(), "no_date").otherwise("after_cutoff"))}


def prepare_business(df: DataFrame, policy: dict) -> dict[str, DataFrame]:
    """Applies a rules policy: rename, value maps, known statuses, dedup keys, numeric columns, derivations.

    policy: {rename, maps: {column: {old: new}}, status: {column, keep, drop}, keys, numeric: [..], derive: [..],
    joins: [{right: DataFrame, left_key, right_key, fields}]}. Returns prepared, excluded (with a reason), original (the table as it
    came) and audit (rows by what became of them); an unknown status is an error.
    """
    original = df
    from .relational import apply_mapping, derive_columns

    df = df.withColumnsRenamed(policy.get("rename", {}))
    for c, m in policy.get("maps", {}).items():
        df = apply_mapping(df, c, m)
    reason = F.lit("")
    if s := policy.get("status"):
        known = [*s["keep"], *s["drop"]]
        if not df.where(~F.coalesce(col(s["column"]).isin(*known), F.lit(False))).isEmpty():
            raise OperatorError("unknown status")
        reason = F.when(col(s["column"]).isin(*s["drop"]), "status").otherwise(reason)
    for c in policy.get("numeric", []):
        reason = F.when((reason == "") & col(c).try_cast("double").isNull(), f"invalid {c}").otherwise(reason)
    marked = df.withColumn("reason", reason)
    if keys := policy.get("keys"):
        w = Window.partitionBy(*keys, "reason").orderBy(*df.columns)
        marked = marked.withColumn("_n", F.row_number().over(w)).withColumn("reason", F.when((F.col("reason") == "") & (F.col("_n") > 1), "duplicate").otherwise(F.col("reason"))).drop("_n")
    good = marked.where("reason = ''").drop("reason")
    if d := policy.get("derive"):
        good = derive_columns(good, d, "coerce")["primary"]
    for j in policy.get("joins", []):
        from .masters import attribute_join

        good = attribute_join(good, j["right"], j["left_key"], j["right_key"], j["fields"])
    audit = marked.groupBy(F.when(F.col("reason") == "", "included").otherwise(F.col("reason")).alias("outcome")).agg(F.count("*").alias("rows"))
    return {"prepared": good, "excluded": marked.where("reason <> ''"), "original": original, "audit": audit}
