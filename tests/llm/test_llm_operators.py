"""Operators on small tables with nulls, ties, repeats, empty and long texts, and on the smallest driver tables."""

import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.llm import bagminhash as G, brown, collision, linededup, mixing, multiindex, packing, queries, sharding, toxicity, warc
from tabloom.llm._common import load

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _h string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "a b c", "en", "s1", 5, "x", "y"), (1, "a b c", "en", "s1", 5, "x", "y"), (2, None, None, None, None, None, None), (3, "", "en", "s2", 0, "x", "y"), (None, "lost key", None, "s1", 8, None, None), (4, " \t\n ", "en", "s2", 4, "x", "y"), (5, long, "en", "s2", len(long), "x", "y"), (6, long, "en", "s3", len(long), "x", "y"), (7, None, "en", "s3", None, "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return len((text or "").encode().split())


def test_reshard(odd, none):
    out, moved = sharding.reshard(odd, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)), 4)
    got = sharding.number_slots(out).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in odd.collect())
    by = defaultdict(list)
    for r in got:
        by[r._shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    empty, _ = sharding.reshard(none, F.lit(0), 4)
    assert sharding.number_slots(empty).count() == 0


def test_reshard_names(odd):
    """Any names of extra columns: those that the operator and its joins use, too."""
    extra = ("_cuts", "_start", "slot", "slot_extra", "_old", "_size", "_shard", "_chunk", "_tier", "_n", "_own", "_dir", "__extra_0")
    docs = odd.drop("_h", "size").withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in extra})
    out, _ = sharding.reshard(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)), 4)
    assert out.columns == [*docs.columns, "__old", "__size", "_h", "__shard", "__chunk"]
    got = sharding.number_slots(out, shard="__shard", chunk="__chunk").collect()
    assert len(got) == 9 and all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in got for c in extra)
    by = defaultdict(list)
    for r in got:
        by[r["__shard"]].append(r["_slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_reshard_sizes(spark, sf):
    out = queries.op1_flow_resharding(spark, sf).toPandas()
    docs = {r.doc_id: r.text for r in load(spark, sf, "documents").select("doc_id", "text").collect()}
    assert len(out) == len(docs) and all(zlib.crc32(docs[a].encode()) == b and len(docs[a].encode()) + 16 == c for a, b, c in zip(out.doc_id, out.text_crc32, out["size"]))
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * out["size"].max()


def test_mix(odd, none, spark, sf):
    out = mixing.mix(odd).toPandas().rename(columns={"size": "given", "_size": "size"})
    assert len(out) == 9 and set(out.given.dropna()) == {"y"} and (out["size"] == [words(t) for t in out.text]).all() and (out.taken <= 3 * out["size"]).all() and (out.taken % out["size"].clip(lower=1) == 0).all()
    assert mixing.mix(none).count() == 0
    a, b = (queries.op9_subset_sum_mix(spark, sf).toPandas().sort_values("doc_id") for _ in range(2))
    assert (a.taken.to_numpy() == b.taken.to_numpy()).all()
    src = {r.doc_id: r.source for r in load(spark, sf, "documents").select("doc_id", "source").collect()}
    g = a.assign(s=a.doc_id.map(src)).groupby("s").agg(own=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), longest=("size", "max"))
    weight = np.array([1, 2, 3] * len(g))[: len(g)].astype(float)
    want, free = np.zeros(len(g)), np.ones(len(g), bool)
    while True:  # water filling, step by step
        left = g.own.sum() - 3 * g.own[~free].sum()
        want = np.where(free, left * weight / max(weight[free].sum(), 1), 3 * g.own)
        over = free & (want > 3 * g.own + 1e-9)
        if not over.any():
            break
        free &= ~over
    assert (g.own == g.said).all() and np.allclose(g.target, want) and (abs(g.taken - g.target) <= g.longest).all()


def test_mix_caps(spark):
    docs = spark.createDataFrame([(i, "w " * (2 if i < 3 else 50), "a" if i < 3 else "b") for i in range(30)], "doc_id long, text string, source string")
    t = mixing.mix(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert {r.source: (round(r.t), r.k) for r in t}["a"] == (18, 18)  # three times its six words


def test_pack(odd, none):
    from tokenizers import Tokenizer
    import public_tokenizers as p

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    out = packing.pack(odd.withColumn("start", F.lit("clash"))).toPandas()
    assert {"start", "_start"} <= set(out.columns)
    want = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in odd.collect())
    per = Counter()
    for (_, _), g in out.groupby([out.doc_id.fillna(-1), out.ids_crc32.map(lambda _: 0)]):
        per.update([(g.doc_id.iloc[0], int(g.length.sum()))])
    assert sum(n * k[1] for k, n in want.items()) == out.length.sum()
    assert all(zlib.crc32(bytes(b)) == c and len(b) == 4 * n for b, c, n in zip(out.ids, out.ids_crc32, out.length))
    long = out[out.doc_id == 5].sort_values("piece")
    assert (long.length[1:] == 2048).all() and (long._start.to_numpy() == long.length.cumsum().shift(fill_value=0).to_numpy()).all()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == g.length.cumsum().shift(fill_value=0).to_numpy()).all() and g.length.sum() <= 2048
    assert packing.pack(none).count() == 0


def test_pack_special_strings(spark):
    from tokenizers import Tokenizer
    import public_tokenizers as p

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|>" * 3000, "x"]
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    for i, text in enumerate(texts):
        got = b"".join(map(bytes, out[out.doc_id == i].sort_values("piece").ids))
        assert np.frombuffer(got, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_warc(spark):
    pages = spark.createDataFrame([(5, "http://b.com/x", "same"), (3, "http://a.com/", "same"), (None, None, "same"), (4, "http://a.com/", "é\r\n\r\nWARC/1.1\r\n日"), (6, None, None), (2, "u\r\nX: y", ""), (3, "http://a.com/", "same")], "page_id long, url string, html string").withColumn("payload", F.lit(1))
    out = {(r.page_id, r.payload_bytes): r for r in warc.archive(pages).collect()}
    assert len(out) == 6 and out[3, 4].record_type == "response" and out[5, 4].refers_to == 3 and out[None, 4].refers_to == 3
    assert out[2, 0].record_type == "response" and out[6, 0].refers_to == 2 and out[4, len("é\r\n\r\nWARC/1.1\r\n日".encode())].record_type == "response"
    assert warc.archive(pages.where("page_id = 99")).count() == 0
    small = {r.page_id: r.record_type for r in warc.archive(pages, least_bytes=5).collect()}
    assert set(small.values()) == {"response"}


def test_warc_payloads_and_order(spark, sf):
    from tabloom.llm._common import fresh_path

    pages, path = load(spark, sf, "pages"), fresh_path(spark, "warc-test")
    warc.write_archive(pages, path)
    back = warc.read_archive(spark, path)
    got = {r.page_id: r.payload for r in back.where("record_type = 'response'").collect()}
    want = {r.page_id: r.html or "" for r in pages.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    rows = warc.merge_runs(back).collect()  # partitions in order
    keys = [(r.url_key, r.time, r.page_id) for r in rows]
    assert keys == sorted(keys) and len(keys) == len(want)


def test_damaged_records_are_refused(spark):
    body = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:AAAA\r\nX-Payload-Length: 1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc._records("f", body))


def test_toxicity(spark, odd, none):
    rows = [(i, " ".join(np.random.default_rng(i).choice(["red", "green", "blue", "stone", "tree"], 30)) + (" vile rogue" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.select("doc_id", F.when(F.col("doc_id") != 8, F.col("y")).alias("toxic"), F.lit(1).alias("text"))
    model = toxicity.fit(docs, labels.drop("text"), held_out=toxicity.held_out())
    got = toxicity.score(docs, model, name="y").toPandas()
    assert "_y" in got.columns and ((got["_y"] >= toxicity.REJECT) == (got.y == 1)).mean() > 0.98
    out = toxicity.score(odd, model).toPandas()
    assert len(out) == 9 and out.score.between(0, 1).all() and out[out.text.isna()].score.nunique() == 1
    assert toxicity.score(none, model).count() == 0
    nothing = toxicity.fit(docs, labels.drop("text").where("toxic > 5"))
    assert toxicity.score(docs, nothing).agg(F.max("score")).first()[0] == 0


def test_toxicity_ignores_held_out_labels(spark, sf):
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x, held_out=toxicity.held_out()) for x in (labels, flipped))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == b[2]


def test_brown(spark, odd, none, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    out = brown.score(docs, brown.held_out(), clustered=200, frequent=500, rounds=2).toPandas().set_index("doc_id")
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [b"\n"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        r = out.loc[i]
        assert r.held_out == held[i] and r.n_tokens == len(t) and r.n_known == sum(c[w] > 0 for w in t) and r.train_tokens == n
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6
    h = out[out.held_out]
    assert h.score.sum() > h.base_score.sum()
    got = brown.score(odd.withColumn("held_out", F.lit(1)), brown.held_out(), clustered=5, frequent=8, rounds=1).toPandas()
    assert len(got) == 9 and np.isfinite(got.score).all() and (got.n_tokens == got.n_tokens.astype(int)).all()
    assert brown.score(none, brown.held_out()).count() == 0
    untrained = brown.score(odd, F.lit(True)).toPandas()
    assert np.isfinite(untrained.score).all() and (untrained.n_known == 0).all() and (untrained.train_tokens == 0).all()


def test_brown_is_a_distribution(spark):
    """The probabilities of all texts of up to two words (known ones, and one unseen of each form) sum to less than one."""
    train = [(i, t) for i, t in enumerate(["a b c, d", "a b é", "c, a a", "zz a", "b"] * 3)]
    known = [*sorted({w for _, t in train for w in t.split()}), "new", "new,", "né", "né,"]
    probe = ["", *known, *[f"{a} {b}" for a in known for b in known]]
    docs = spark.createDataFrame(train + [(1000 + k, t) for k, t in enumerate(probe)], "doc_id long, text string")
    out = brown.score(docs, F.col("doc_id") >= 1000, clustered=3, frequent=4, rounds=1).where("doc_id >= 1000").toPandas()
    p = (10**out.score).groupby(out.n_tokens).sum()
    assert 0.2 < p.sum() < 1 + 1e-9 and (p > 0.02).all()


def brute_classes(rows, threshold=0.8):
    h = G.WordHashes()
    sets = [G.shingles(t, h) if t is not None else None for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x is not None and y is not None and (x == y or len(sets[a]) and len(sets[b]) and min(len(sets[a]), len(sets[b])) >= threshold * max(len(sets[a]), len(sets[b])) and G.similarity(sets[a], sets[b]) >= threshold):
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = defaultdict(set)
    for i, (k, _) in enumerate(rows):
        out[find(i)].add(k)
    return {frozenset(v) for v in out.values()}


def test_near_dedup(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    extra = [(10_000, None), (10_001, None), (10_002, ""), (10_003, ""), (10_004, "one two"), (10_005, "one two"), (10_006, " \n"), (10_007, "one  two")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("kept", F.lit(1)).drop("kept")
    out = G.dedup(docs).collect()
    got = defaultdict(set)
    for r in out:
        got[r.class_id].add(r.doc_id)
    want = brute_classes([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    assert {frozenset(v) for v in got.values()} == want and all(min(v) == k for k, v in got.items())
    assert sum(r.kept for r in out) == len(want)


def test_near_dedup_chain(spark):
    """A chain of edits is one class though its ends are far apart."""
    base = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(12):
        base[k * 30 : k * 30 + 4] = [f"x{k}_{j}" for j in range(4)]
        texts.append(" ".join(base))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.class_id for r in G.dedup(docs).collect()} == {0}


def test_near_dedup_odd(odd, none):
    out = G.dedup(odd).collect()
    assert len(out) == 9 and {r.doc_id: r.class_id for r in out}[6] == 5 and {r.doc_id: r.class_id for r in out}[7] == 7
    assert G.dedup(none).count() == 0


def brute_lines(rows, least=50):
    """Non-blank line numbers to delete: any run of at least `least` words that begins elsewhere earlier."""
    seen, gone = set(), defaultdict(set)
    for k, text in rows:
        lines = [x for x in (text or "").split("\n") if x.strip()]
        n = [words(x) for x in lines]
        for s in range(len(lines)):
            total = 0
            for e in range(s, min(len(lines), s + 120)):
                total += n[e]
                if total >= least:
                    key = tuple(lines[s : e + 1])
                    if key in seen:
                        gone[k].update(range(s, e + 1))
                    seen.add(key)
    return gone


def test_line_dedup(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    run = "\n".join(f"line {i} of the shared passage" for i in range(9))
    extra = [(20_000, f"alpha\n{run}\n\nomega"), (20_001, f"{run}\nbeta"), (20_002, "short\nshort\nshort"), (20_003, "\n".join(run.split("\n")[:8])), (20_004, run + "\n" + run), (20_005, None), (20_006, "")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    out = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    want = brute_lines([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    assert {k: r.n_removed for k, r in out.items() if r.n_removed} == {k: len(v) for k, v in want.items()}
    assert out[20_000].text == f"alpha\n{run}\n\nomega" and out[20_001].text == "beta" and out[20_002].n_removed == 0 and out[20_003].text == run.rsplit("\n", 1)[0] and out[20_004].text == "" and out[20_005].text is None and out[20_006].text == ""


def test_line_dedup_odd(odd, none):
    out = {(r.doc_id, r.source): r for r in linededup.dedup_lines(odd).collect()}
    assert out[5, "s2"].n_removed == 0 and out[6, "s3"].text == "" and out[1, "s1"].text == "a b c"
    assert linededup.dedup_lines(none).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")


def test_collision(spark):
    rng = np.random.default_rng(3)
    rows, v = [], rng.standard_normal((300, 24))
    v[100:160] = v[100] + 0.08 * rng.standard_normal((60, 24))
    v[160:200] = v[7]
    v[210] = v[209] * 3
    rows = [(i, [float(np.float32(x)) for x in v[i]], i % 2 if i < 200 else 5, "c") for i in range(300)]
    rows += [(900, None, 1, "c"), (901, [0.0] * 24, 1, "c"), (902, [float("nan")] * 24, 1, "c"), (903, rows[7][1], None, "c"), (None, rows[7][1], 1, "c"), (904, [1.0, None], 1, "c"), (905, [1.0, 2.0], 1, "c"), (906, [1.0, 2.0], 1, "c")]
    out = collision.near_duplicates(vectors(spark, rows)).collect()
    assert len(out) == len(rows)
    x = {r[0]: np.asarray(r[1], float) for r in rows[:300]}
    link = {i: [j for j in x if j != i and rows[i][2] == rows[j][2] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.93] for i in x}
    comp = {}
    for i in sorted(x):
        if i not in comp:
            todo = [i]
            while todo:
                a = todo.pop()
                if a not in comp:
                    comp[a] = i
                    todo += link[a]
    got = {r.vec_id: r for r in out}
    assert all(got[i].n_links == len(link[i]) and got[i].component_id == comp[i] and got[i].kept == (comp[i] == i) for i in x)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 904)) and got[None].kept is False and got[906].component_id == 905
    assert collision.near_duplicates(vectors(spark, [])).count() == 0


def test_index(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((900, 16)).astype(np.float32)
    v[50:110] = v[50]
    rows = [(i, [float(x) for x in v[i]], 0, "c") for i in range(900)] + [(2000, None, 0, "c"), (2020, [0.0] * 16, 0, "c"), (2040, [float("inf")] * 16, 0, "c")]
    out = multiindex.search(vectors(spark, rows), F.col("id") % 20 == 0).toPandas()
    x, hit = v.astype(float), 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        g = out[out.query_id == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(s[g.vec_id], g.score)
        assert sorted(zip(-g.score, g.vec_id)) == list(zip(-g.score, g.vec_id))
        hit += len(set(want) & set(g.vec_id))
    assert hit / (45 * 20) >= 0.9 and out.query_id.nunique() == 45
    few = multiindex.search(vectors(spark, rows[:5]), F.col("id") == 0).toPandas()
    assert len(few) == 4
    assert multiindex.search(vectors(spark, []), F.col("id") == 0).count() == 0
    assert multiindex.search(vectors(spark, rows[1:5]), F.col("id") == 0).count() == 0


def test_index_small_cells(spark):
    """Every query gets k rows, or all there are, however small its own cell is."""
    rng, e = np.random.default_rng(9), np.eye(8)
    cells = [(c, c) for c in range(4) for _ in range(300)] + [(0, 1)] * 5  # a side cell of five
    v = np.array([np.concatenate((e[a], e[b])) for a, b in cells]) + 0.02 * rng.standard_normal((len(cells), 16))
    rows = [(i, [float(np.float32(x)) for x in r], 0, "c") for i, r in enumerate(v)]
    out = multiindex.search(vectors(spark, rows), (F.col("id") % 4 == 0) | (F.col("id") >= 1200)).toPandas()
    assert out.groupby("query_id").size().tolist() == [20] * 305
    assert (out[out.query_id >= 1200].groupby("query_id").vec_id.agg(lambda x: (x >= 1200).sum()) == 4).all()
    tiny = [(i, [float(x) for x in r], 0, "c") for i, r in enumerate(rng.standard_normal((8, 4)))]
    assert multiindex.search(vectors(spark, tiny), F.lit(True)).toPandas().groupby("query_id").size().tolist() == [7] * 8


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t[:-8]} as select * from read_parquet('{sf}/{t}')")
    want, got = con.sql(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, sf).toPandas()
    c = sorted(want.columns)
    assert sorted(got.columns) == c
    plain = lambda v: "None" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    a, b = (sorted(tuple(map(plain, r)) for r in x[c].astype(object).values.tolist()) for x in (got, want))
    assert a == b


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = load(spark, sf, "documents")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        if k < len(cp.STAGES) - 1:
            from tabloom.llm._common import materialize

            docs = materialize(docs, "t")
            assert docs.columns == columns
        seen[name] = docs.count()
    total = before.count()
    assert seen["toxicity"] < load(spark, sf, "documents").count() and seen["line dedup"] == seen["toxicity"] and seen["near dedup"] < seen["line dedup"]
    assert docs.where("piece = 0").count() == total


def test_pipeline_clashing_columns(spark, odd, sf):
    """Extra columns named as those of the stages pass through and decide nothing."""
    import corpus_pipeline as cp

    plain = odd.drop("size")
    names = ["size", "taken", "kept", "toxic_score", "n_removed", "n_lines", "class_id", "source_size", "target", "_copy"]
    values = [F.lit("y"), F.lit(0), F.lit(False), F.lit(1.0), F.lit(7), F.lit("y"), F.lit("y"), F.lit("y"), F.lit("y"), F.lit("y")]
    clashing = plain.select("*", *[v.alias(n) for n, v in zip(names, values)])
    rows = lambda df: sorted(map(repr, df.select(plain.columns).collect()))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, clashing, sf)
        assert out.columns == clashing.columns and rows(out) == rows(stage(spark, plain, sf)), name
        assert out.count() and out.select(*names).distinct().count() == 1
    assert cp.pack_sequences(spark, clashing, sf).where("piece = 0").count() == 9


def test_archive_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    """One payload a thousand times the mean, others of mixed sizes: no file is above the bound but that of the one long record."""
    import gzip

    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(0, 100, 300)] + [9000] * 20 + [100_000]
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", f"{i}:" + "x" * n) for i, n in enumerate(sizes)], "page_id long, url string, html string").repartition(3, "page_id")
    path = str(tmp_path / "w")
    warc.write_archive(pages, path)
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").rglob("part-*.gz")]
    assert sum(f.count(b"WARC/1.1") for f in files) == len(sizes) and sum(len(f) > 40_000 for f in files) == 1
    assert max(files, key=len).count(b"WARC/1.1") == 1 and len(files) < 40
    back = warc.read_archive(spark, path).toPandas()
    assert sorted(back.page_id) == list(range(len(sizes))) and back.groupby("run").offset.min().eq(0).all() and back.run.nunique() == len(files)
