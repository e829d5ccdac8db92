"""Phrases, centroids and order MinHash held to brute force, on odd rows and on the smallest tables."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.llm import centroids, ordermin, phrases, queries
from tabloom.llm._common import load


def brute_phrases(rows, least, covered=100, most=2000, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").encode().lower().decode()):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        cover = Counter()
        for p, a in found.items():
            for q in {p[i : i + m] for m in range(2, len(p)) for i in range(len(p) - m + 1)}:
                cover[q] = max(cover[q], a)
        best = []
        for p, a in found.items():
            if not 0 < covered * a <= 100 * cover[p]:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(best)[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("kind", ["plain", "many shards", "cut inside pieces", "half covered"])
def test_phrases_equal_brute_force(spark, sf, kind):
    docs = load(spark, sf, "documents").where("doc_id % 2 = 0").select("lang", "text")
    given = {"plain": {}, "many shards": {"shard_words": 700, "bucket_keys": 300}, "cut inside pieces": {"shard_words": 40, "bucket_keys": 300, "stretch": 60}, "half covered": {"covered": 50}}[kind]
    want = brute_phrases([tuple(r) for r in docs.collect()], 4, given.get("covered", 100), 60)
    assert len(want) > 60 and rows_of(phrases.collocations(docs, least=4, most=60, **given)) == want


def test_phrases_of_odd_rows(spark):
    rows = [("en", "A b, a B\x0bc d"), ("en", None), (None, "x y x y x y"), ("und", "x y"), ("en", ""), ("fr", " \t .,"), ("en", "a b c d " * 400 + "a b"), ("new\nline", "é É é É"), ("en", "a b")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"ids": F.lit(1), "_salt": F.lit(2), "a": F.lit("x"), "shard": F.lit(3)})
    for extra in ({}, {"shard_words": 50, "stretch": 16, "bucket_keys": 2}):
        assert rows_of(phrases.collocations(docs, least=2, **extra)) == brute_phrases(rows, 2)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs, least=10_000).count() == 0


def test_scores_pass_64_bits(spark):
    """1000 * a * n overflows a long; the score does not."""
    langs, names, grams = (spark.createDataFrame(*x) for x in (([("en", 9 * 10**12)], "lang string, n long"), ([(1, "en", "a", 4 * 10**12), (2, "en", "b", 3 * 10**12)], "id long, lang string, word string, f long"), ([([1, 2], 2 * 10**12)], "ids array<long>, f long")))
    old = phrases.frequent_phrases
    phrases.frequent_phrases = lambda *a, **b: (langs, names, grams)
    try:
        assert rows_of(phrases.collocations(None)) == [("en", 1, "a b", 2 * 10**12, 4 * 10**12, 3 * 10**12, 9 * 10**12, 1500)]
    finally:
        phrases.frequent_phrases = old


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(0, 4))
@settings(max_examples=150, deadline=None)
def test_intervals_count_phrases(ids, lead):
    ids = np.array(ids)
    order, lcp = phrases.suffix_array(ids, 5)
    assert sorted(order.tolist()) == list(range(len(ids)))
    assert all(ids[a : a + 5].tolist() <= ids[b : b + 5].tolist() for a, b in zip(order, order[1:]))
    space = phrases.room(ids)
    for k in range(1, 6):
        starts, ends, n = phrases.intervals(order, lcp, space, k, np.arange(len(ids)) + k > lead)
        got = {tuple(ids[order[s] : order[s] + k].tolist()): c for s, c in zip(starts, n.tolist())}
        want = Counter(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1) if i + k > lead and (ids[i : i + k] > 0).all())
        assert got == dict(want)


@given(st.lists(st.integers(0, 2**63), max_size=20))
def test_packed_numbers(numbers):
    a = np.array(numbers, np.uint64)
    assert (phrases.unpack(phrases.pack(a), len(a)) == a).all()


# ---- centroids


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [x for *_, x in sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [min((gap(v, x), j) for j, x in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        a = near()
        for j in range(len(c)):
            own = [v for (_, v), (_, at) in zip(kept, a) if at == j]
            c[j] = [sum(x) // len(own) for x in zip(*own)] if own else c[j]
    a = near()
    part = Counter()
    for d, j in a:
        part[j] += d
    fits = lambda x: x if x < 2**63 else None
    return Counter((i, j, fits(d), fits(part[j]), fits(sum(part.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, a))


@pytest.mark.parametrize("kind", ["grid", "ties", "wide"])
def test_clusters_equal_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    v = {"grid": rng.integers(-3, 4, (90, 64)) / 1024 + 1e-7, "ties": np.repeat(rng.integers(0, 2, (60, 1)), 64, axis=1) / 2048.0, "wide": rng.normal(size=(40, 64)) * 10.0 ** rng.integers(-3, 300, (40, 1))}[kind]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, v[0].tolist()), (None, v[1].tolist()), (91, None), (92, [1.0] * 63), (93, [float("nan")] * 64), (94, [None] + [1.0] * 63), (95, [float("inf")] * 64), (96, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "distance": F.lit("y")})
    out = centroids.cluster(df)
    assert out.columns == ["vec_id", "embedding", "cluster", "distance", "_cluster", "_distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in out.select("vec_id", "_cluster", "_distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == brute_clusters(rows)
    few = centroids.cluster(df.where("vec_id < 3"))
    assert few.count() == 3 and centroids.cluster(df.limit(0)).count() == 0


@given(st.integers(0, 10**6), st.sampled_from([1, 40, 3000, 4_000_000]))
@settings(max_examples=60, deadline=None)
def test_screen_never_loses_the_nearest(seed, width):
    rng = np.random.default_rng(seed)
    c = rng.integers(-width, width + 1, (6, 64))
    v = np.concatenate([c[rng.integers(0, 6, 20)] + rng.integers(-1, 2, (20, 64)), (c[:3] + c[3:]) // 2])
    d = ((v[:, None].astype(object) - c[None]) ** 2).sum(axis=2)
    assert all(centroids.screen(v, c)[i, d[i].argmin()] for i in range(len(v)))
    near, best = centroids.assign(v, c)
    assert (near == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


# ---- order MinHash


def plain_print(text):
    """Components with Python integers, one hash function at a time."""
    m = 2**64 - 1
    g = 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    def gram(c):
        """Of one more, twice as many and so on, each from two that overlap."""
        grams, have = list(c), 1
        while have < len(c):
            step = min(have, len(c) - have)
            grams = [(a * pow(g, step + 1, 2**64) + b) & m for a, b in zip(grams, grams[step:])]
            have += step
        return grams[0]

    k = min(ordermin.K, len(text))
    hashes, seen, x = [], Counter(), []
    for i in range(len(text) - k + 1 if text else 0):
        h = mix(gram([ord(ch) + 1 for ch in text[i : i + k]]))
        hashes.append(h)
        x.append(mix((h + (seen[h] + 1) * g) & m) >> 32)
        seen[h] += 1
    out = []
    for j in range(1, ordermin.SKETCHES + 1):
        a = mix(j * g & m) >> 32 | 1
        chosen = sorted(sorted(range(len(x)), key=lambda i: (x[i] * a % 2**32, i))[: ordermin.L])
        h = len(chosen)
        for i in chosen:
            h = mix((h + hashes[i]) * g & m)
        out.append(h >> 48)
    return out


def check_prints(got, rows):
    """rows: (key, text) in descending order."""
    assert len(got) == len(rows)
    for i, (k, text) in enumerate(rows):
        text, then = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + then[:half]
        r = got[k]
        own, fresh, other = map(plain_print, (text, new, then))
        hexed = lambda p: "".join(f"{x:04x}" for x in p)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(new.encode()).hexdigest(), hexed(own), hexed(fresh))
        assert r.near_edited == np.mean(np.equal(own, fresh)) and r.near_next == np.mean(np.equal(own, other))


def test_order_minhash_equals_plain_loops(spark):
    rng = np.random.default_rng(5)
    texts = ["", None, "a", "ab", "éü😀", "abcabcabcabc" * 40, "the same text twice", "the same text twice"] + ["".join(rng.choice(list("ab cde"), n)) for n in (5, 6, 7, 11, 12, 13, 300, 9001)]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)) * 3 - 9, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_to": F.lit(1), "_t": F.lit(2), "n_chars": F.lit("x")}).repartition(3)
    out = ordermin.fingerprints(df)
    assert out.columns[:4] == ["doc_id", "_to", "_t", "n_chars"]
    check_prints({r.doc_id: r for r in out.drop("n_chars").withColumnRenamed("_n_chars", "n_chars").collect()}, sorted(rows, reverse=True))


def test_order_minhash_of_repeats(spark):
    rows = [(1, "one text"), (1, "one text"), (1, "one text"), (1, "another text"), (None, "no key"), (None, "no key"), (5, None)]
    got = ordermin.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    new = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id, r.n_chars].append(r.edited_sha256)
    assert set(by) == {(1, 8), (1, 12), (None, 6), (5, 0)}
    assert by[1, 8].count(new("one text", "one text")) == 2 and len(by[1, 8]) == 3 and len(by[1, 12]) == 1
    assert sorted(by[None, 6]) == sorted([new("no key", "no key"), new("no key", "")])
    one = ordermin.fingerprints(spark.createDataFrame(rows[:1], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == new("one text", "one text")
    assert ordermin.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_occurrences_when_upper_bits_agree():
    """Hashes that differ in their lower bits alone are told apart."""
    h = np.array([5, 6, 5, 6, 5, 7], np.uint64)
    assert (np.diff(np.unique(ordermin.elements(h), return_counts=True)[1]) == 0).all() and len(set(ordermin.elements(h).tolist())) == 6
    assert ordermin._sorted_places(h).tolist() == [0, 2, 4, 1, 3, 5]


def test_order_minhash_knows_order_and_edits():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    text, swapped = " ".join(words), " ".join(words[200:] + words[:200])
    like = lambda a, b: ordermin.likeness(ordermin.Read(a).print, ordermin.Read(b).print)
    near = [like(text, " ".join(words[: 400 - n] + [w[::-1] for w in words[400 - n :]])) for n in (0, 10, 80, 200)]
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.8
    assert like(text, swapped) < 0.75  # nearly all k-mers stay


def test_queries_on_the_smallest_tables(spark, sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t[:-8]} as select * from read_parquet('{sf}/{t}')")
    for name in ("op11_suffix_array_phrases", "op12_exact_centroids"):
        got = queries.QUERIES[name](spark, sf).toPandas()
        want = con.sql(queries.ORACLES[name]).df()[list(got.columns)]
        assert len(got) and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
    docs = sorted([(r.doc_id, r.text) for r in load(spark, sf, "documents").collect() if r.doc_id < 40 or r.doc_id > 180], reverse=True)
    some = spark.createDataFrame(docs, "doc_id long, text string")
    check_prints({r.doc_id: r for r in ordermin.fingerprints(some).collect()}, [(k, t) for k, t in docs])
