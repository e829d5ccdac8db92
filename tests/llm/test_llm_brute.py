"""Learners, layouts and repeats held to plain loops over the same rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import bagminhash as G, brown, linededup, packing, sharding, toxicity
from tabloom.llm._common import load


def test_ftrl_equals_a_plain_loop(spark):
    """Weights and scores against per-coordinate updates with a dictionary."""
    rng, words = np.random.default_rng(4), ["red", "green", "blue", "stone", "tree", "vile"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, int("vile" in t and "red" in t)) for i, t in enumerate(texts)], "doc_id long, text string, toxic int")
    at, w, bias = toxicity.fit(docs.drop("toxic"), docs.drop("text"))

    import xxhash

    def mix(x):
        m = 2**64 - 1
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    def features(text):
        h = [xxhash.xxh64_intdigest(x, seed=6) for x in re.findall(r"\w+", text.lower())]
        little = lambda b: int.from_bytes(b, "little")
        h = [little(xxhash.xxh64_digest(x, seed=6)) for x in re.findall(r"\w+", text.lower())]
        stems = [little(xxhash.xxh64_digest(x[: toxicity.STEM], seed=7)) for x in re.findall(r"\w+", text.lower())]
        every = h + stems + [mix((h[i] * (2 * k + 1) + k) % 2**64) ^ h[i + k] for k in toxicity.REACH for i in range(len(h) - k)]
        return Counter((x * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS) for x in every)

    order = [r.doc_id for r in docs.orderBy(F.xxhash64(F.lit(7), F.col("doc_id")), "doc_id", F.xxhash64("text")).collect()]
    label = {r.doc_id: r.toxic for r in docs.collect()}
    rows = []
    for i in order:
        f = features(texts[i])
        rows.append(({k: float(np.float32(toxicity.SCALE * n / max(1, sum(f.values())) ** 0.5)) for k, n in f.items()}, label[i]))
    z, n, zb, nb = defaultdict(float), defaultdict(float), 0.0, 0.0
    a, b, l1 = toxicity.ALPHA, toxicity.BETA, toxicity.L1
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((b + n[k] ** 0.5) / a)
    shuffle = np.random.default_rng(6)
    for _ in range(toxicity.EPOCHS):
        for i in shuffle.permutation(len(rows)):
            x, y = rows[i]
            bb = -zb / ((b + nb**0.5) / a)
            own = {k: weight(k) for k in x}
            e = 1 / (1 + math.exp(-(sum(own[k] * v for k, v in x.items()) + bb))) - y
            for k, v in x.items():
                g = e * v
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / a * own[k]
                n[k] += g * g
            zb += e - ((nb + e * e) ** 0.5 - nb**0.5) / a * bb
            nb += e * e
    want = {k: weight(k) for k in z if weight(k)}
    assert set(at.tolist()) == set(want) and max(abs(want[k] - v) for k, v in zip(at.tolist(), w.tolist())) < 1e-4
    scored = {r.doc_id: r.score for r in toxicity.score(docs.drop("toxic"), (at, w, bias)).collect()}
    bb = -zb / ((b + nb**0.5) / a)
    for i, t in enumerate(texts):
        f = features(t)
        s = toxicity.SCALE * sum(n * want.get(k, 0.0) for k, n in f.items()) / max(1, sum(f.values())) ** 0.5
        assert abs(scored[i] - 1 / (1 + math.exp(-(s + bb)))) < 1e-4


def test_brown_scores_equal_a_dictionary_model(spark, sf):
    """A class bigram over dictionaries, on the learnt classes, gives every score; rounds raise the likelihood."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    held = brown.held_out()
    model, _, _ = brown.fit(docs, held, clustered=150, frequent=600, rounds=6)
    assert len(model.likelihoods) >= 3 and max(model.likelihoods) > model.likelihoods[0] and len(set(model.cls[:150])) > 20
    rows = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    count = Counter(w for i, t in rows.items() if not out[i] for w in t)
    learnt = {w: int(c) for w, c in zip(model.words, model.cls) if c < brown.CLASSES}
    assert len(learnt) > 150 and all(count[w] >= brown.LEAST for w in learnt)
    end = brown.CLASSES + brown.FORMS
    cls = lambda w: learnt.get(w, brown.CLASSES + brown.form(w))
    pair, before, after = Counter(), Counter(), Counter()
    for i, t in rows.items():
        if not out[i]:
            k = [end, *map(cls, t), end]
            for a, b in zip(k, k[1:]):
                pair[a, b] += 1
                before[a] += 1
                after[b] += 1
    n_cls, total = end + 1, sum(pair.values())
    members, kinds = Counter(), Counter()
    for w, n in count.items():
        members[cls(w)] += n
        kinds[cls(w)] += 1

    def p(a, w):
        c = end if w is None else cls(w)
        uni = (after[c] + 1) / (total + n_cls)
        q = (pair[a, c] + brown.SMOOTH * uni) / (before[a] + brown.SMOOTH)
        if w is None:
            return q
        return q * (count[w] / members[c] if w in learnt else (count[w] + 1) / (members[c] + kinds[c] + 1))

    got = {r.doc_id: r.score for r in brown.score(docs, held, clustered=150, frequent=600, rounds=6).collect()}
    for i, t in rows.items():
        a, want = end, 0.0
        for w in [*t, None]:
            want += math.log10(p(a, w))
            a = end if w is None else cls(w)
        assert abs(got[i] - want) < 1e-6 * max(1, len(t)), i


def test_resharding_moves_no_more_than_the_flow(spark, sf):
    """What really moves is within a few rows of the least that any layout with these capacities moves."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    out, _ = sharding.reshard(docs, F.pmod(F.col("doc_id"), F.lit(5)), 8)
    rows = out.select("_old", "_shard", "_size").toPandas()
    supply = rows.groupby("_old")._size.sum()
    capacity = sharding.near_equal(int(supply.sum()), 8)
    least = sum(int(n) - min(int(n), capacity.get(int(i), 0)) for i, n in supply.items())
    moved = rows[rows._old != rows._shard]._size.sum()
    assert least <= moved + rows._size.max() * 8 and moved <= least + 2 * 8 * rows._size.max()


def test_packed_ids_of_documents(spark, sf):
    """Pieces of whole documents hold the library's ids, and lie gapless in sequences."""
    import public_tokenizers as tok
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    docs = load(spark, sf, "documents").select("doc_id", "text")
    out = packing.pack(docs).toPandas().sort_values(["doc_id", "piece"])
    got = {i: b"".join(map(bytes, g.ids)) for i, g in out.groupby("doc_id")}
    for r in docs.collect():
        assert np.frombuffer(got[r.doc_id], "<u4").tolist() == [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
    plain = packing.pack(docs, keep_ids=False)
    assert "ids" not in plain.columns and plain.count() == len(out)


@pytest.fixture(scope="module")
def repeated(spark):
    long = "\n".join(f"line {i} with some words of its own" for i in range(30))
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, long), (3, long), (3, long), (4, long), (None, long), (None, long), (5, None), (5, None), (6, ""), (6, ""), (7, "x\n" + long)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_near_dedup_keeps_one_of_repeated_rows(repeated):
    out = G.dedup(repeated).toPandas()
    assert len(out) == 14 and out[out.kept].groupby(["doc_id", out.text.fillna("-")], dropna=False).size().max() == 1
    assert sorted(out[out.kept].doc_id.tolist()) == [1, 3, 5, 6] and out[out.doc_id.isna()].class_id.tolist() == [3, 3]


def test_line_dedup_keeps_one_of_repeated_rows(repeated):
    out = linededup.dedup_lines(repeated).toPandas()
    whole = out[(out.text.fillna("").str.len() > 100)]
    assert len(out) == 14 and whole.doc_id.tolist() == [3] and out[out.doc_id == 7].text.tolist() == ["x"]
    assert (out[out.doc_id == 1].text == "a b c").all() and out[out.doc_id == 5].text.isna().all()


def test_clashing_names_pass_through(repeated):
    made = ["kept", "class_id", "n_lines", "n_removed", "node", "_t", "_d", "salts"]
    clash = repeated.select("*", *[F.lit(f"given {c}").alias(c) for c in made])
    near, lines = G.dedup(clash), linededup.dedup_lines(clash)
    assert {"_kept", "_class_id"} <= set(near.columns) and {"_n_lines", "_n_removed"} <= set(lines.columns)
    for out in (near, lines):
        assert out.select(*made).distinct().collect() == [tuple(f"given {c}" for c in made)] and out.count() == 14
    assert near.where("_kept").count() == 4


def test_large_components_lose_no_link(spark, monkeypatch):
    """A large group of near copies, texts at its edge and strangers that share buckets: classes as by brute force, in one block and many."""
    from test_llm_operators import brute_classes

    rng, base = np.random.default_rng(8), [f"w{i}" for i in range(220)]
    texts = []
    for k in range(90):
        t = list(base)
        for j in rng.choice(220, 1 + k % 3, replace=False):
            t[j] = f"e{k}_{j}"
        texts.append(t)
    for k in range(60):  # edits of edits: some link with a few members only
        t = list(texts[int(rng.integers(0, 90))])
        for j in rng.choice(220, int(rng.integers(3, 14)), replace=False):
            t[j] = f"f{k}_{j}"
        texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_classes(rows)
    for block in (16, 256):
        monkeypatch.setattr(G, "BLOCK", block)
        got = defaultdict(set)
        for r in G.dedup(docs).collect():
            got[r.class_id].add(r.doc_id)
        assert {frozenset(v) for v in got.values()} == want


def test_index_odd_rows(spark):
    """Lengths are searched by themselves; rows without an id, repeated ids, ties and unsound vectors have their stated place."""
    from tabloom.llm import multiindex

    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)] + [(100 + i, rng.standard_normal(3).tolist()) for i in range(9)]
    rows += [(None, [1.0] * 8), (200, None), (220, []), (240, [0.0] * 8), (260, [1.0, None] + [0.0] * 6), (0, [9.0] * 8), (61, rows[7][1]), (62, rows[7][1])]
    got = multiindex.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=5).toPandas()
    sound = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and any(v)]
    hits = 0
    for q in {i for i, _ in sound if i % 20 == 0}:
        x = min((v.tolist(), v) for i, v in sound if i == q)[1]
        best = sorted((-float(v @ x), i) for i, v in sound if i != q and len(v) == len(x))
        g = got[got.query_id == q].sort_values("rank")
        assert len(g) == min(5, len(best)) and list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
        assert all(any(abs(s + p) < 1e-9 and i == j for s, j in best) for i, p in zip(g.vec_id, g.score))
        hits += len(set(g.vec_id) & {i for _, i in best[:5]})
    assert hits >= 0.9 * len(got) and set(got.query_id) == {0, 20, 40, 100}


def test_long_payloads_and_small_files(spark, monkeypatch):
    """Payloads far beyond a file's share are read back whole, in files and batches of their own."""
    from tabloom.llm import warc

    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "HAND_ON", 5_000)
    rows = [(i, f"http://h{i % 3}.org/{i}", ("é" * (300_000 if i == 7 else 50 * (i % 5)) + str(i % 4))) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in warc.archive(pages).collect()}
    seen = {}
    for i, _, body in rows:
        first = seen.setdefault(body, i)
        r = out[i]
        assert r.payload_bytes == len(body.encode()) and r.record_type == ("response" if first == i else "revisit") and r.refers_to == (None if first == i else first)


def test_components_in_one_task_and_by_rounds(spark, monkeypatch):
    from tabloom.llm import graph

    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = []
    for few in (10**6, 0):
        monkeypatch.setattr(graph, "FEW", few)
        got.append({r.node: r.component for r in graph.components(df).collect()})
    assert got[0] == got[1] and got[0][1060] == 1000 and len(got[0]) == len({x for a, b in edges if a != b for x in (a, b)})
    assert graph.components(df.where("a < 0")).count() == 0
