"""Sweeps over ranges: running totals in groups, effective intervals and their overlaps, capacities in order."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabloom.operators import joins as J
from tabloom.operators.capacity import accept_in_order
from tabloom.operators.order import running_totals


def test_running_totals_in_groups(spark):
    rng = random.Random(2)
    rows = [(None if g == 3 else g, i, rng.randint(-5, 9)) for i, g in enumerate(rng.choices([1, 1, 1, 2, 3], k=400))]
    df = spark.createDataFrame(rows, "g int, i int, x int").repartition(5)
    got = {r.i: (r.a, r.b) for r in running_totals(df, ["g"], ["i"], {"a": F.col("x"), "b": F.lit(1)}).collect()}
    want, seen = {}, {}
    for g, i, x in rows:
        a, b = seen.get(g, (0, 0))
        seen[g] = want[i] = (a + x, b + 1)
    assert got == want and running_totals(df.limit(0), ["g"], ["i"], {"a": F.col("x")}).count() == 0


def bands_and_facts(seed):
    rng, day = random.Random(seed), lambda n: date(2024, 1, 1) + timedelta(n)
    bands = [(rng.choice(["a", "a", "a", "b", None]), None if rng.random() < 0.05 else day(s), None if rng.random() < 0.1 else day(s + rng.randint(-1, 9)), float(i)) for i, s in enumerate(rng.choices(range(120), k=60))]
    facts = [(i, rng.choice(["a", "a", "b", "c", None]), None if rng.random() < 0.05 else day(rng.randint(-5, 140))) for i in range(300)]
    return bands, facts


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals(spark, seed):
    bands, facts = bands_and_facts(seed)
    b = spark.createDataFrame(bands, "k string, start date, stop date, v double")
    got = {r.i: r.v for r in J.interval_join(spark.createDataFrame(facts, "i int, k string, d date"), b, "k", "d", "v").collect()}
    holds = lambda x, k, d: x[0] == k and x[1] is not None and d is not None and x[1] <= d and (x[2] is None or d <= x[2])
    for i, k, d in facts:
        hit = [x[3] for x in bands if k is not None and holds(x, k, d)]
        assert got[i] == (hit[0] if len(hit) == 1 else None)
    sound = [x for x in bands if x[0] is not None and x[1] is not None and (x[2] is None or x[1] <= x[2])]
    far = date(9999, 1, 1)
    want = sorted(str((k, s, e, sum(o[0] == k and o[1] <= (e or far) and s <= (o[2] or far) for o in sound) - 1)) for k, s, e, _ in sound)
    assert sorted(str(tuple(r)) for r in J.interval_overlaps(b, "k").collect()) == want


def test_a_key_with_a_hundred_thousand_bands(spark):
    bands = spark.range(100_000).select(F.lit("k").alias("k"), (F.col("id") * 2).alias("start"), (F.col("id") * 2 + 1 + F.when(F.col("id") % 1000 == 0, 1).otherwise(0)).alias("stop"), F.col("id").alias("v"))
    facts = spark.range(0, 200_000, 7).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    got = J.interval_join(facts, bands, "k", "t", "v")
    twice = F.col("t") % 2000 == 2
    assert got.where(F.when(twice, F.col("v").isNotNull()).otherwise(F.col("v").isNull() | (F.col("v") != F.floor(F.col("t") / 2)))).count() == 0
    assert J.interval_overlaps(bands, "k").agg(F.sum("overlaps")).first()[0] == 200


@pytest.mark.parametrize("seed", range(4))
def test_events_fit_in_order(spark, seed):
    rng = random.Random(seed)
    caps = {f"k{i}": Decimal(rng.randint(0, 60)) for i in range(6)}
    legs = []
    for e in range(120):
        for k in rng.sample(sorted(caps) + ["unknown"] * (seed == 3), rng.randint(1, 3) if seed else 1):
            legs.append((e, 119 - e, k, None if seed == 2 and rng.random() < 0.03 else Decimal(rng.randint(0, 12))))
    left, want = dict(caps), {}
    by = {}
    for e, o, k, x in legs:
        by.setdefault((o, e), []).append((k, x))
    for (_, e), parts in sorted(by.items()):
        good = all(x is not None and k in left and x <= left[k] for k, x in parts)
        want[e] = good
        if good:
            for k, x in parts:
                left[k] -= x
    rng.shuffle(legs)
    got = accept_in_order(spark.createDataFrame(legs, "e int, o int, k string, x decimal(10,2)"), spark.createDataFrame(list(caps.items()), "k string, cap decimal(10,2)"), "e", "o", "k", "x", "cap")
    assert {r.e: r.accepted for r in got.collect()} == want and 0 < sum(want.values()) < 120


def test_split_parts_across_ranges_write_no_pairs(spark, monkeypatch):
    """Equal amounts, wholes and parts of a day in many ranges, against all pairs; what is written holds a row for each whole and for each day of a part."""
    from itertools import combinations
    from tabloom.operators import matching, order

    dice, wrote, write = random.Random(5), [], order.written_once

    def counted(df):
        out = write(df)
        wrote.append(out.count())
        return out

    monkeypatch.setattr(matching, "RANGE", 7, raising=False)
    monkeypatch.setattr(order, "written_once", counted)
    monkeypatch.setattr(matching, "written_once", counted)
    a = [(f"w{i}", Decimal(dice.choice([8, 8, 10, 12, -6])), date(2024, 1, 2)) for i in range(25)]
    b = [(i, Decimal(dice.choice([2, 4, 4, 4, 5, 5, 6, 8, -3, -2])), date(2024, 1, dice.choice([1, 2, 2, 3, 9]))) for i in range(60)]
    left, right = (spark.createDataFrame(x, f"id {t}, v decimal(18,2), d date") for x, t in ((a, "string"), (b, "int")))
    got = {tuple(r) for r in matching.reconcile_splits(left, right, "v", "d", tolerance=1, days=1, parts=4).collect()}
    want, tried, cut = set(), 0, 0
    for i, v, d in a:
        may = sorted((abs(abs(x) - abs(v) / 2), j, x) for j, x, e in b if x * v > 0 and abs(x) <= abs(v) + 1 and abs((e - d).days) <= 1)
        pairs = list(combinations(sorted((j, x) for _, j, x in may[:4]), 2))
        tried, cut = tried + len(pairs), cut + (len(may) > 4)
        want |= {(i, p, q, abs(v - x - y)) for (p, x), (q, y) in pairs if abs(v - x - y) <= 1}
    assert got == want and want
    assert max(wrote) <= len(a) + 3 * len(b)
    made = matching.split_groups(left, right, "v", "d", tolerance=1, days=1, parts=4)["groups"].where("match_type = 'split_1_to_2'")
    assert {(r.whole, int(r.part_a), int(r.part_b), r.gap) for r in made.collect()} == want
    few = matching.split_groups(left, right.limit(0), "v", "d", tolerance=1, days=1, parts=4)["summary"].first()
    assert (few.combinations, few.truncated, few.groups) == (0, 0, 0)
    assert (tried, cut) == tuple(matching._combinations(left, right, "v", "d", "id", "id", 1, 1, 4, False).agg({"combinations": "sum", "truncated": "sum"}).select("sum(combinations)", "sum(truncated)").first())
