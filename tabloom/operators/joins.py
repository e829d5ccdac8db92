"""Joins with guards, lookups, interval and range joins, comparisons and relationship tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import canonical_key, col, is_missing

from .order import running_totals, written_once
from .relational import OperatorError, require_columns


def estimate_join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str = "inner") -> DataFrame:
    """One row: exact output rows, largest multiplicities, rows with a missing key. From counts by key only."""
    k = [f"k{i}" for i in range(len(left_on))]
    a = left.groupBy(*[col(c).alias(n) for c, n in zip(left_on, k)]).agg(F.count("*").alias("lc"))
    b = right.groupBy(*[col(c).alias(n) for c, n in zip(right_on, k)]).agg(F.count("*").alias("rc"))
    both = a.join(b, k, "full")
    lc, rc = F.coalesce("lc", F.lit(0)), F.coalesce("rc", F.lit(0))
    rows = lc * rc
    if how in ("left", "outer"):
        rows = rows + F.when(rc == 0, lc).otherwise(0)
    if how in ("right", "outer"):
        rows = rows + F.when(lc == 0, rc).otherwise(0)
    gone = reduce(lambda x, y: x | y, [is_missing(n) for n in k])
    return both.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("output_rows"), F.coalesce(F.max(lc), F.lit(0)).alias("left_multiplicity"), F.coalesce(F.max(rc), F.lit(0)).alias("right_multiplicity"), F.coalesce(F.sum(F.when((lc > 1) & (rc > 1), 1)), F.lit(0)).alias("many_to_many_keys"), F.coalesce(F.sum(F.when(gone, lc + rc)), F.lit(0)).alias("missing_key_rows"))


def join_tables(left: DataFrame, right: DataFrame, on: list[str] | None = None, left_on: list[str] | None = None, right_on: list[str] | None = None, how: str = "left", suffixes: tuple[str, str] = ("_left", "_right"), validate: str | None = None, allow_many_to_many: bool = False, max_output_rows: int | None = None, guard: bool = True, allow_cross: bool = False) -> DataFrame:
    """Equi-join; columns other than keys that collide get suffixes; equal key names appear once.

    guard: a missing key, a many-to-many key (unless allowed) or too many output rows is an error, found from counts by
    key before anything is joined. validate: one_to_one, one_to_many or many_to_one. how="cross" needs allow_cross.
    """
    if how == "cross":
        if not allow_cross:
            raise OperatorError("a cross join must be allowed explicitly")
        if max_output_rows is not None and left.count() * right.count() > max_output_rows:
            raise OperatorError("the cross join is too large")
        clash = set(left.columns) & set(right.columns)
        return left.withColumnsRenamed({c: c + suffixes[0] for c in clash}).crossJoin(right.withColumnsRenamed({c: c + suffixes[1] for c in clash}))
    left_on, right_on = list(left_on or on or []), list(right_on or on or [])
    if not left_on or len(left_on) != len(right_on):
        raise OperatorError("both sides need as many keys")
    require_columns(left, *left_on)
    require_columns(right, *right_on)
    if guard or validate or max_output_rows is not None:
        e = estimate_join(left, right, left_on, right_on, how).first()
        if guard and e.missing_key_rows:
            raise OperatorError(f"{e.missing_key_rows} rows have a missing key")
        if guard and e.many_to_many_keys and not allow_many_to_many:
            raise OperatorError("keys repeat on both sides")
        if validate in ("one_to_one", "one_to_many") and e.left_multiplicity > 1 or validate in ("one_to_one", "many_to_one") and e.right_multiplicity > 1:
            raise OperatorError(f"the keys are not {validate}")
        if max_output_rows is not None and e.output_rows > max_output_rows:
            raise OperatorError(f"the join makes {e.output_rows} rows")
    same = [a for a, b in zip(left_on, right_on) if a == b]
    clash = (set(left.columns) & set(right.columns)) - set(same)
    ren_l, ren_r = {c: c + suffixes[0] for c in clash}, {c: c + suffixes[1] for c in clash}
    left, right = left.withColumnsRenamed(ren_l), right.withColumnsRenamed(ren_r)
    right = right.withColumnsRenamed({c: f"__{c}" for c in same})
    test = [col(ren_l.get(a, a)) == col(f"__{b}" if a == b else ren_r.get(b, b)) for a, b in zip(left_on, right_on)]
    out = left.join(right, test, "full" if how == "outer" else how)
    out = out.withColumns({c: F.coalesce(col(c), col(f"__{c}")) for c in same}) if how in ("right", "outer") else out
    return out.drop(*[f"__{c}" for c in same])


def lookup_match(source: DataFrame, lookup: DataFrame, source_key: str, lookup_key: str, values: list[str], keep: str = "first", order_by: list[str] = (), match: str | None = "matched", suffix: str = "_lookup") -> DataFrame:
    """Left join to one lookup row for each key, so source rows never multiply. keep: first or last by order_by, or none (repeated keys match nothing)."""
    require_columns(lookup, lookup_key, *values)
    w = Window.partitionBy(lookup_key)
    if keep == "none":
        one = lookup.withColumn("_n", F.count("*").over(w)).where("_n = 1")
    else:
        order = [col(c).asc() if keep == "first" else col(c).desc() for c in order_by or lookup.columns]
        one = lookup.withColumn("_n", F.row_number().over(w.orderBy(*order))).where("_n = 1")
    names = {v: v + suffix if v in source.columns else v for v in values}
    one = one.select(col(lookup_key).alias("_key"), *[col(v).alias(n) for v, n in names.items()], F.lit(True).alias("_hit"))
    out = source.join(one, col(source_key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return (out.withColumn(match, F.coalesce("_hit", F.lit(False))) if match else out).drop("_hit")


def master_join(fact: DataFrame, master: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Many-to-one: master keys must be unique and not missing, every fact row must find its master."""
    if not master.groupBy(*on).count().where("count > 1").isEmpty() or not master.where(reduce(lambda a, b: a | b, map(is_missing, on))).isEmpty():
        raise OperatorError("the master's keys repeat or are missing")
    if not fact.join(master, on, "left_anti").isEmpty():
        raise OperatorError("some rows have no master")
    return fact.join(master.select(*on, *columns), on, "left")


def _sound(bands: DataFrame, key: str, start: str, stop: str, *more: Column) -> DataFrame:
    """Bands that hold something, as _k, _a, _b (null: without end)."""
    return bands.where(col(key).isNotNull() & (col(start) <= F.coalesce(col(stop), col(start)))).select(col(key).alias("_k"), col(start).alias("_a"), col(stop).alias("_b"), *more)


def interval_join(fact: DataFrame, bands: DataFrame, key: str, when: str, value: str, start: str = "start", stop: str = "stop", output: str | None = None) -> DataFrame:
    """The band's value where exactly one band of the key holds the date (both ends included; a null end holds on), else null.

    A sweep over starts, distinct dates of the facts and ends in the order of key and time: running sums of bands that are open and
    of their numbers say at each date how many hold it and, where one does, which. The sweep is dealt to ranges, so neither the
    bands nor the facts of a key meet in one task.
    """
    b = written_once(_sound(bands, key, start, stop, col(value).alias("_v")).withColumn("_n", F.monotonically_increasing_id() + 1))
    point = lambda df, at, order, open_: df.select("_k", F.col(at).alias("_t"), F.lit(order).alias("_o"), F.lit(open_).alias("_open"), (F.col("_n") * open_).alias("_which"))
    asked = fact.select(col(key).alias("_k"), col(when).alias("_t")).where("_k is not null and _t is not null").distinct()
    every = point(b, "_a", 0, 1).union(asked.select("_k", "_t", F.lit(1), F.lit(0), F.lit(0).cast("long"))).union(point(b.where("_b is not null"), "_b", 2, -1))
    swept = running_totals(every, ["_k"], ["_t", "_o", "_which"], {"_holding": F.col("_open").cast("long"), "_number": F.col("_which")})
    one = swept.where("_o = 1 and _holding = 1").select("_k", "_t", F.col("_number").alias("_n")).join(b.select("_n", "_v"), "_n").drop("_n")
    return fact.join(one, (col(key) == F.col("_k")) & (col(when) == F.col("_t")), "left").withColumn(output or value, F.col("_v")).drop("_k", "_t", "_v")


def interval_overlaps(bands: DataFrame, key: str, start: str = "start", stop: str = "stop", name: str = "overlaps") -> DataFrame:
    """Bands (key, start, stop) with the number of other bands of the key that share a date with each; those that hold nothing, or have no key, are left out.

    What began by a band's end less what ended before its start, by running sums over ranges of key and time.
    """
    b = written_once(_sound(bands, key, start, stop).withColumn("_n", F.monotonically_increasing_id()))
    # at one date: ends before it count for a start there, starts at it count for an end there
    begins = b.select("_k", F.lit(False).alias("_late"), F.col("_a").alias("_t"), F.lit(0).alias("_o"), "_n")
    ends = b.select("_k", F.col("_b").isNull().alias("_late"), F.coalesce("_b", "_a").alias("_t"), F.lit(1).alias("_o"), "_n")
    swept = running_totals(begins.union(ends), ["_k"], ["_late", "_t", "_o", "_n"], {"_begun": (1 - F.col("_o")).cast("long"), "_ended": F.when(F.col("_o") == 1, 1).otherwise(0).cast("long")})
    per = swept.groupBy("_n").agg(F.max(F.when(F.col("_o") == 1, F.col("_begun"))).alias("_begun"), F.max(F.when(F.col("_o") == 0, F.col("_ended"))).alias("_ended"))
    return b.join(per, "_n").select(F.col("_k").alias(key), F.col("_a").alias(start), F.col("_b").alias(stop), (F.col("_begun") - F.col("_ended") - 1).alias(name))


def range_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float, extra: Column | None = None) -> DataFrame:
    """Pairs with abs(left - right) <= tolerance: values are binned by the tolerance and neighbouring bins equi-joined."""
    if tolerance <= 0:
        out = left.join(right, col(left_value) == col(right_value))
    else:
        lb = left.withColumn("_bin", F.floor(col(left_value) / tolerance))
        rb = right.withColumn("_rbin", F.floor(col(right_value) / tolerance)).withColumn("_bin", F.explode(F.array(F.col("_rbin") - 1, F.col("_rbin"), F.col("_rbin") + 1))).drop("_rbin")
        out = lb.join(rb, "_bin").where(F.abs(col(left_value) - col(right_value)) <= tolerance).drop("_bin")
    return out if extra is None else out.where(extra)


def merge_on_spine(spine: DataFrame, facts: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """Facts that were aggregated by themselves, left-joined on a common spine."""
    return reduce(lambda a, f: a.join(f, on, "left"), facts.values(), spine)


def alias_join(df: DataFrame, column: str, master: DataFrame, code: str, name: str, aliases: str | None = None, separators: str = "[;；、]") -> DataFrame:
    """Adds the code whose name or alias the column holds; an alias of two codes is an error, unknown ones give null."""
    names = master.select(col(code).alias("_code"), F.trim(col(name)).alias("_name"))
    if aliases:
        names = names.union(master.select(col(code), F.explode(F.split(F.coalesce(col(aliases), F.lit("")), separators)).alias("x")).select(code, F.trim("x")))
    names = names.where("_name <> ''").distinct()
    if not names.groupBy("_name").count().where("count > 1").isEmpty():
        raise OperatorError("an alias names two codes")
    return df.join(names, F.trim(col(column)) == F.col("_name"), "left").drop("_name").withColumnRenamed("_code", code if code not in df.columns else f"{code}_master")


def relationship(left: DataFrame, right: DataFrame, left_key: str, right_key: str, accept: float = 0.8) -> DataFrame:
    """One row: coverages both ways, uniqueness, cardinality and whether the left may look up the right."""
    a = left.where(~is_missing(left_key)).groupBy(canonical_key(left_key).alias("k")).agg(F.count("*").alias("lc"))
    b = right.where(~is_missing(right_key)).groupBy(canonical_key(right_key).alias("k")).agg(F.count("*").alias("rc"))
    j = a.join(b, "k", "full")
    hit = F.col("lc").isNotNull() & F.col("rc").isNotNull()
    out = j.agg(
        F.coalesce(F.sum(F.when(hit, F.col("lc"))), F.lit(0)).alias("matched_rows"), F.coalesce(F.sum("lc"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum(F.when(hit, 1)), F.lit(0)).cast("long").alias("matched_keys"), F.count("lc").alias("left_keys"), F.count("rc").alias("right_keys"),
        F.coalesce(F.max("lc"), F.lit(0)).alias("ml"), F.coalesce(F.max("rc"), F.lit(0)).alias("mr"),
    )
    card = F.concat(F.when(F.col("ml") > 1, "N").otherwise("1"), F.lit(":"), F.when(F.col("mr") > 1, "N").otherwise("1"))
    share = lambda x, y: F.round(F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0)), 6)
    out = out.withColumns({"row_coverage": share("matched_rows", "left_rows"), "key_coverage": share("matched_keys", "left_keys"), "right_coverage": share("matched_keys", "right_keys"), "cardinality": card})
    return out.withColumn("accepted", (F.col("row_coverage") >= accept) & (F.col("mr") <= 1)).drop("ml", "mr")


def relationship_graph(frames: dict[str, DataFrame], keys: dict[str, list[str]], accept: float = 0.8) -> DataFrame:
    """relationship() of every pair of key columns of different tables, with a status."""
    edges = []
    names = sorted(frames)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for ka in keys.get(a, []):
                for kb in keys.get(b, []):
                    edges.append(relationship(frames[a], frames[b], ka, kb, accept).select(F.lit(a).alias("left_table"), F.lit(ka).alias("left_key"), F.lit(b).alias("right_table"), F.lit(kb).alias("right_key"), "*"))
    if not edges:
        raise OperatorError("no pair of keys")
    out = reduce(lambda x, y: x.union(y), edges)
    best = F.greatest("row_coverage", "right_coverage")
    return out.withColumn("status", F.when(F.col("cardinality") == "N:N", "blocked").when(best >= accept, "candidate").otherwise("review"))


def compare_tables(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None, joint: str = "; ", duplicates: str = "exclude", order_by: list[str] = ()) -> dict[str, DataFrame]:
    """Full outer difference by canonical keys: added, removed, modified, unchanged, duplicate and invalid keys of a side.

    duplicates: exclude (all rows of a repeated key go to their own result) or first (by order_by).
    """
    columns = columns or [c for c in old.columns if c in new.columns and c not in keys]
    k = [f"_k{i}" for i in range(len(keys))]

    def side(df: DataFrame, row: str, n: str):
        """A row for each key (its only one, or the first by order), rows of repeated keys, rows without a key."""
        df = df.select(*[canonical_key(c).alias(n) for c, n in zip(keys, k)], *columns, *[c for c in order_by if c not in columns])
        bad = reduce(lambda a, b: a | b, [F.col(x).isNull() for x in k])
        good, value = df.where(~bad), F.struct(*columns)
        one = F.min_by(value, F.struct(*(order_by or columns))) if duplicates == "first" else F.first(value)
        per = good.groupBy(*k).agg(F.count("*").alias(n), one.alias(row))
        return per, good.join(per.where(F.col(n) > 1).select(*k), k), df.where(bad)

    (a, dup_a, bad_a), (b, dup_b, bad_b) = side(old, "_old", "_na"), side(new, "_new", "_nb")
    j = a.join(b, k, "full")  # both lie by key already
    if duplicates == "exclude":  # a key that repeats on one side is compared on neither
        j = j.where("coalesce(_na, 1) = 1 and coalesce(_nb, 1) = 1")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_old.`{c}`").eqNullSafe(F.col(f"_new.`{c}`")), F.lit(c)) for c in columns]))
    j = j.withColumn("changed", F.concat_ws(joint, changed))
    back = [F.col(n).alias(c) for n, c in zip(k, keys)]
    pair = [x for c in columns for x in (F.col(f"_old.`{c}`").alias(f"{c}_old"), F.col(f"_new.`{c}`").alias(f"{c}_new"))]
    both = j.where("_old is not null and _new is not null")
    named = lambda df: df.withColumnsRenamed(dict(zip(k, keys)))
    return {
        "added": j.where("_old is null").select(*back, "_new.*"), "removed": j.where("_new is null").select(*back, "_old.*"),
        "modified": both.where("changed <> ''").select(*back, "changed", *pair), "unchanged": both.where("changed = ''").select(*back, "_new.*"),
        "duplicates_old": named(dup_a), "duplicates_new": named(dup_b), "invalid_old": named(bad_a), "invalid_new": named(bad_b),
    }
