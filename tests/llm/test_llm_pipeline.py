"""The corpus pipeline, stage by stage against brute force over what the stage before kept, and on empty tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm import toxicity
from tabloom.llm._common import load, materialize

from test_llm_operators import brute_classes, brute_lines, words  # noqa: I001


def plain_score(text, model):
    """The classifier's score from a dictionary of weights."""
    import xxhash

    at, w, bias = model
    weight, m = dict(zip(at.tolist(), w.tolist())), 2**64 - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    tokens = re.findall(r"\w+", (text or "").lower())
    little = lambda s, seed: int.from_bytes(xxhash.xxh64_digest(s, seed=seed), "little")
    h = [little(x, 6) for x in tokens]
    every = h + [little(x[: toxicity.STEM], 7) for x in tokens] + [mix((h[i] * (2 * k + 1) + k) % 2**64) ^ h[i + k] for k in toxicity.REACH for i in range(len(h) - k)]
    f = Counter((x * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS) for x in every)
    s = toxicity.SCALE * sum(n * weight.get(k, 0.0) for k, n in f.items()) / max(1, sum(f.values())) ** 0.5
    return 1 / (1 + math.exp(-(s + bias)))


def without(text, gone):
    """The text without the non-blank lines of these numbers; empty if nothing else is left."""
    lines = (text or "").split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    out = {full[i] for i in gone}
    return text if not gone else "" if len(gone) == len(full) else "\n".join(x for i, x in enumerate(lines) if i not in out)


def targets(sizes):
    """Words of each source by weights 1, 2, 3, at most three times its own, filled step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    own, weight = np.array([sizes[s] for s in names], float), np.array([1, 2, 3] * len(names))[: len(names)].astype(float)
    want, free = np.zeros(len(names)), np.ones(len(names), bool)
    while True:
        left = own.sum() - 3 * own[~free].sum()
        want = np.where(free, left * weight / max(weight[free].sum(), 1), 3 * own)
        over = free & (want > 3 * own + 1e-9)
        if not over.any():
            return dict(zip(names, want))
        free &= ~over


def test_every_stage_does_what_brute_force_does(spark, sf):
    import corpus_pipeline as cp
    import public_tokenizers
    from tokenizers import Tokenizer

    stages = dict(cp.STAGES)
    docs = load(spark, sf, "documents")
    seen = [docs]
    for name in list(stages)[:-1]:
        seen.append(materialize(stages[name](spark, seen[-1], sf), "t"))
        assert seen[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in df.collect()} for df in seen]
    model = toxicity.fit(docs, load(spark, sf, "labels"), held_out=toxicity.held_out())
    scores = {k: plain_score(r.text, model) for k, r in rows[0].items()}
    assert all(abs(s - toxicity.REJECT) > 1e-4 for s in scores.values()) and set(rows[1]) == {k for k, s in scores.items() if s < toxicity.REJECT} != set(rows[0])
    gone = brute_lines([(k, rows[1][k].text) for k in sorted(rows[1])])
    assert gone and {k: r.text for k, r in rows[2].items()} == {k: without(r.text, gone.get(k, ())) for k, r in rows[1].items()}
    assert all(r.n_chars == len(r.text) for k, r in rows[2].items() if k in gone)
    classes = brute_classes([(k, rows[2][k].text) for k in sorted(rows[2])])
    assert set(rows[3]) == {min(c) for c in classes} and all(rows[3][k] == rows[2][k] for k in rows[3])
    copies, size, by = Counter(r.doc_id for r in seen[4].collect()), {k: words(r.text) for k, r in rows[3].items()}, defaultdict(list)
    for k, r in rows[3].items():
        by[r.source].append(k)
    goal = targets({s: sum(size[k] for k in ks) for s, ks in by.items()})
    assert set(copies) <= set(rows[3]) and max(copies.values()) <= 3 and all(rows[4][k] == rows[3][k] for k in rows[4])
    for s, ks in by.items():
        assert abs(sum(copies[k] * size[k] for k in ks) - goal[s]) <= max(size[k] for k in ks)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for k, n in copies.items():
        ids = t.encode(rows[4][k].text or "", add_special_tokens=False).ids + [0]
        first, at = len(ids) % 2048 or 2048, 0
        for piece, length in enumerate([first] + [2048] * ((len(ids) - first) // 2048)):
            want[k, piece, at, length, zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())] += n
            at += length
    packed = stages["pack"](spark, seen[4], sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(places) <= 1.05 * sum(k[3] * n for k, n in want.items()) / 2048 + 2


def test_empty_tables(spark, sf, tmp_path):
    import corpus_pipeline as cp

    docs = load(spark, sf, "documents")
    for name, stage in cp.STAGES:
        out = stage(spark, docs.where("doc_id < 0"), sf)
        assert out.count() == 0 and (name == "pack" or out.columns == docs.columns), name
    docs.where("doc_id < 0").write.parquet(str(tmp_path / "documents.parquet"))
    load(spark, sf, "labels").withColumn("toxic", F.col("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
