"""MinHash near-dedup with BagMinHash signatures over multisets of word shingles.

An element of weight w (how often a shingle stands in a text) is a bundle of Poisson processes, one for each step of a
dyadic discretisation of weights, [0, 1), [1, 2), [2, 4), [4, 8), ...; a process' points come in order of time, each
falls on one signature position and, within its step, on a weight that must lie below w. A position keeps the earliest
time. Processes stop once they pass the latest time of a full signature, so short work is done for each element; equal
positions of two signatures are an unbiased estimate of weighted Jaccard similarity. All elements of many texts advance
together, vectorised.

Signatures are cut in bands; equal bands are candidates. Copies of a text stand in once. Within a band bucket texts are
compared with the bucket's first; what stays outside that component is compared with several members of the others, and
what is then still outside, with all of them, so no link between different texts of a bucket is lost while a large
group of near copies costs as many pairs as it has members. Pairs whose signatures agree too little for the threshold
are passed over; the others are verified on the shingle multisets of the whole texts.

Defined cases: null texts are alone; texts without words are only copies of equal texts; texts of fewer words than a
shingle are one shingle; of rows that repeat both key and text one is kept; a null key comes last; an empty table
gives an empty result; extra columns pass through, and where they clash the new columns get leading underscores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, discard, materialize, mix64, shelter, small_batches
from .copies import LAST, ROW, distinct_texts, mark_repeats, salt, with_identity
from .graph import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
#: Signature positions; bands use the first of them, all of them judge a candidate.
POSITIONS = 256
#: Deviations below the threshold that a candidate's agreement may lie: a linked pair falls below in 3 of a million cases.
SLACK = 4.5
#: Texts of one packed block of a bucket.
BLOCK = 256
#: Entries that a worker keeps of its word cache, about 20 MB.
CACHE = 100_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _times(k: int) -> np.uint64:
    return np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        h = xxhash.xxh64_digest(word, seed=3)
        if len(self) < CACHE:
            self[word] = h
        return h


def shingles(text: str, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of a text's word shingles, with repeats."""
    h = np.frombuffer(b"".join(map(hashes.__getitem__, text.encode().split())), "<u8")
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = mix64(out * _GOLD + h[j : len(h) - k + 1 + j])
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets given as arrays with repeats."""
    return counted_similarity(*np.unique(a, return_counts=True), *np.unique(b, return_counts=True))


def counted_similarity(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> float:
    """The same of distinct elements with their counts."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both, every = np.minimum(n[i], m[j]).sum(), n.sum() + m.sum()
    return both / (every - both) if every else 0.0


def signatures(multisets: list[np.ndarray], size: int = POSITIONS) -> np.ndarray:
    """(texts, size) uint32 signatures; texts without elements get zeros."""
    n_docs = len(multisets)
    best = np.full(n_docs * size, np.inf)
    name = np.zeros(n_docs * size, np.uint64)
    doc, elem, weight = [], [], []
    for d, s in enumerate(multisets):
        x, n = np.unique(s, return_counts=True)
        doc.append(np.full(len(x), d))
        elem.append(x)
        weight.append(n)
    if not n_docs or not sum(map(len, elem)):
        return np.zeros((n_docs, size), np.uint32)
    doc, elem, weight = np.concatenate(doc), np.concatenate(elem), np.concatenate(weight)
    # one process for each element and dyadic step below its weight
    steps, d0, e0, w0, rate0 = int(weight.max() - 1).bit_length() + 1, [], [], [], []
    for s in range(steps):
        low = 0 if s == 0 else 1 << (s - 1)
        own = np.flatnonzero(weight > low)
        d0.append(doc[own])
        e0.append(mix64(elem[own] + _times(s + 1)))
        w0.append(weight[own] - low)
        rate0.append(np.full(len(own), max(1, low), np.float64))
    d, e, w, rate = map(np.concatenate, (d0, e0, w0, rate0))
    t, k = np.zeros(len(d)), 0
    has = np.zeros(n_docs, bool)
    has[doc] = True
    while len(d):
        k += 1
        a = mix64(e + _times(k))
        b = mix64(a ^ np.uint64(0xD1B54A32D192ED03))
        t = t - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        position = ((b >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        level = ((b & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate).astype(np.int64)
        fit = np.flatnonzero(level < w)
        at = d[fit] * size + position[fit]
        order = np.lexsort((a[fit], t[fit]))[::-1]  # the earliest is written last
        at, when, who = at[order], t[fit][order], a[fit][order]
        better = when < best[at]
        at, when, who = at[better], when[better], who[better]
        best[at], name[at] = when, who
        last = best.reshape(n_docs, size).max(axis=1)
        on = np.flatnonzero(t < last[d])
        d, e, w, rate, t = d[on], e[on], w[on], rate[on], t[on]
    out = (mix64(name) >> np.uint64(32)).astype(np.uint32).reshape(n_docs, size)
    out[~has] = 0
    return out


def sketch(docs: DataFrame, text: str, words: int = WORDS) -> DataFrame:
    """The identity, sig and bands of rows with shingles; sig keeps 16 bits of every position."""

    def run(frames):
        hashes = WordHashes()
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                sets = [shingles(x, hashes, words) for x in part[text]]
                sig = signatures(sets)
                some = np.array([len(s) > 0 for s in sets], bool)
                if not some.any():
                    continue
                key = np.zeros((len(part), BANDS), np.uint64)
                for j in range(ROWS):
                    key = mix64(key * _GOLD + sig[:, j * BANDS : (j + 1) * BANDS])
                key = mix64(key + np.arange(BANDS, dtype=np.uint64) * _GOLD).view(np.int64)
                yield pd.DataFrame({**{c: part[c][some] for c in ROW}, "sig": [s.tobytes() for s in sig[some].astype(np.uint16)], "bands": list(key[some])})

    return docs.select(*ROW, text).mapInPandas(run, "_t long, _u long, _d long, sig binary, bands array<long>")


def least_agreement(threshold: float) -> float:
    return threshold - SLACK * (threshold * (1 - threshold) / POSITIONS) ** 0.5


def _agree(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree often enough to be verified."""

    def run(frames):
        for frame in frames:
            if len(frame):
                x = np.frombuffer(b"".join(frame["sa"]), np.uint16).reshape(len(frame), -1)
                y = np.frombuffer(b"".join(frame["sb"]), np.uint16).reshape(len(frame), -1)
                yield frame.loc[(x == y).mean(axis=1) >= least_agreement(threshold), ["a", "b"]]

    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def _across(mixed: DataFrame, threshold: float, words: int) -> DataFrame:
    """Links (a, b) between texts of a bucket that lie in different components, of which one is outside the bucket's largest.

    mixed: band, node, component, outside, sig, bands, text of buckets with several components. Texts that are alike but do not
    link may be very many, so pairs never become rows: they are judged and verified on the texts where a bucket's blocks lie, in
    the first band that they share, and a text hands on one link to each component.
    """
    field = ("node", "component", "outside", "sig", "bands", "text")
    n = mixed.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = mixed.join(n, "band").withColumn("outside", F.col("outside").cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    packed = dealt.groupBy("band", "blocks", "block").agg(F.collect_list(F.struct(*field)).alias("m"), F.max("outside").alias("some"))
    split = lambda c: [F.transform(c, lambda x: x[f]).alias(f"{c}_{f}") for f in field]  # noqa: B023, E731
    nothing = lambda c: [F.array().cast(t).alias(f"{c}_{f}") for f, t in zip(field, ("array<long>", "array<long>", "array<int>", "array<binary>", "array<array<long>>", "array<string>"))]
    alone = packed.where("blocks = 1").select("band", *split("m"), *nothing("n"))
    several = packed.where("blocks > 1")
    other = several.select("band", F.col("block").alias("block_b"), F.col("m").alias("n"), F.col("some").alias("some_b"))
    met = several.join(other, "band").where("block < block_b and some + some_b > 0").select("band", *split("m"), *split("n"))
    met = alone.union(several.where("some > 0").select("band", *split("m"), *nothing("n"))).union(met)

    def run(batches):
        import pyarrow as pa

        least = int(np.ceil(least_agreement(threshold) * POSITIONS))
        hashes = WordHashes()
        for batch in batches:
            out_a, out_b = [], []
            for k in range(batch.num_rows):
                cell = lambda c: batch.column(batch.schema.get_field_index(c))[k].values  # noqa: B023, E731
                same = not len(cell("n_node"))
                sides = []
                for c in ("m", "m" if same else "n"):
                    sigs = np.frombuffer(b"".join(cell(f"{c}_sig").to_pylist()), np.uint16).reshape(-1, POSITIONS)
                    sides.append((np.array(cell(f"{c}_node")), np.array(cell(f"{c}_component")), np.array(cell(f"{c}_outside")), sigs, np.array(cell(f"{c}_bands").flatten()).reshape(-1, BANDS), cell(f"{c}_text")))
                (ra, ca, oa, sa, ba, ta), (rb, cb, ob, sb, bb, tb) = sides
                open_ = (ca[:, None] != cb[None, :]) & ((oa[:, None] + ob[None, :]) > 0)
                if same:
                    open_ &= np.arange(len(ra))[:, None] < np.arange(len(rb))[None, :]
                band, sets = batch.column(0)[k].as_py(), {}

                def shingled(side, i, texts):
                    if (side, i) not in sets:
                        sets[side, i] = np.unique(shingles(texts[i].as_py(), hashes, words), return_counts=True)  # noqa: B023
                    return sets[side, i]  # noqa: B023

                for i in np.flatnonzero(open_.any(axis=1)):
                    j = np.flatnonzero(open_[i])
                    j = j[(sb[j] == sa[i]).sum(axis=1) >= least]
                    shared = np.where(bb[j] == ba[i], bb[j], np.iinfo(np.int64).max)
                    done = set()
                    for x in j[shared.min(axis=1) == band] if len(j) else ():
                        if cb[x] not in done and counted_similarity(*shingled(0, i, ta), *shingled(0 if same else 1, x, tb)) >= threshold:
                            done.add(cb[x])
                            out_a.append(ra[i])
                            out_b.append(rb[x])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    with small_batches(mixed.sparkSession, 8):
        return materialize(met.mapInArrow(run, "a long, b long"), "across")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """Of pairs (a, b), those of at least the threshold. Every text meets its pairs once, pairs then meet by number."""
    ends = pairs.withColumn("p", F.xxhash64("a", "b")).select("p", "a", "b", F.explode(F.array("a", "b")).alias("node"))
    ends = ends.join(texts, "node").groupBy("p", "a", "b").agg(F.min_by("text", "node").alias("x"), F.max_by("text", "node").alias("y"))

    def run(frames):
        hashes = WordHashes()
        for frame in frames:
            keep = [similarity(shingles(x, hashes, words), shingles(y, hashes, words)) >= threshold for x, y in zip(frame["x"], frame["y"])]
            yield frame.loc[np.array(keep, bool), ["a", "b"]]

    return ends.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, heads: DataFrame, repeats: bool, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """(node, class_node) of the distinct texts (see copies.distinct_texts) that are near duplicates: the smallest node that links lead to."""
    body = with_identity(docs.where(F.col(text).isNotNull()), key, text).select(*ROW, F.col(text).alias("text"))
    # copies are sketched where they lie and dropped after, which is cheaper than shuffling texts
    made = sketch(body, "text", words)
    if repeats:
        made = made.groupBy(*ROW).agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    sketches = materialize(made.join(heads.select(*ROW, "node"), ROW).select(*ROW, "node", "sig", "bands"), "sketches")
    sigs = sketches.select("node", "sig")
    bucket = sketches.select(*ROW, "node", F.explode("bands").alias("band"))
    several = bucket.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1")
    bucket = materialize(bucket.join(several.select("band", "lead"), "band"), "buckets")
    texts = body.join(bucket.select(*ROW, "node").distinct(), ROW).select("node", "text")
    if repeats:
        texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    texts, bucket = materialize(texts, "bucket-texts"), bucket.drop(*ROW)

    def join(found: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        both = materialize(found if links is None else found.union(links).distinct(), "links")
        if links is not None:
            discard(links)
        return both, materialize(components(both), "components")

    def judged(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return _verify(materialize(_agree(pairs, sigs, threshold), "candidates"), texts, threshold, words)

    links, comp = join(judged(bucket.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))), None)
    for last in (False, True):
        own = bucket.drop("lead").join(comp.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        by_hash = F.xxhash64("band", "node")
        sizes = own.groupBy("band", "component").agg(F.count("*").alias("n"), F.min_by("node", by_hash).alias("lead"), F.max_by("node", by_hash).alias("lead2"))
        mixed = sizes.groupBy("band").agg(F.count("*").alias("k"), F.max_by(F.struct("component", "lead", "lead2"), F.struct("n", "component")).alias("top")).where("k > 1")
        members = own.join(mixed.select("band", "top"), "band").withColumn("outside", F.col("component") != F.col("top.component"))
        if last:  # what is still outside is held against every member of its buckets
            found = _across(members.select("band", "node", "component", "outside").join(sketches.select("node", "sig", "bands"), "node").join(texts, "node"), threshold, words)
        else:  # and before that against two members of the bucket's largest component, other ones in every band
            found = judged(members.where("outside").select(F.col("node").alias("a"), F.explode(F.array("top.lead", "top.lead2")).alias("b")))
        links, comp = join(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), links)
    for table in (sketches, texts, links):
        discard(table)
    return comp.select("node", F.col("component").alias("class_node"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """docs with class_id (key of the class's first member) and kept (whether the row is that member)."""
    docs, back = shelter(docs, key, text)
    bound_batches(docs.sparkSession)
    heads, repeats = distinct_texts(docs, key, text)
    classes = near_duplicates(docs, heads, repeats, key, text, threshold, words)
    classes = classes.join(heads.select(F.col("node").alias("class_node"), F.col("_d").alias("class_d")), "class_node")
    own = heads.join(classes, "node", "left").select("_t", "_u", "salts", F.col("_d").alias("first_d"), F.coalesce("class_d", "_d").alias("class_d"), F.coalesce(F.col("node") == F.col("class_node"), F.lit(True)).alias("leads"))
    own = materialize(own, "classes").withColumn("_salt", F.explode("salts")).drop("salts")
    # copies of a text meet their class by salt; rows without a text stand for themselves
    marked = mark_repeats(docs, key, text, repeats)
    some = marked.where(F.col(text).isNotNull()).withColumn("_salt", salt()).join(own, ["_t", "_u", "_salt"])
    some = some.withColumn("kept", F.col("leads") & (F.col("_d") == F.col("first_d")) & ~F.col("_again"))
    bare = marked.where(F.col(text).isNull()).withColumns({"class_d": F.col("_d"), "kept": ~F.col("_again")})
    columns = [*docs.columns, F.when(F.col("class_d") != LAST, F.col("class_d")).alias("class_id"), "kept"]
    return back(some.select(*columns).union(bare.select(*columns)), ["class_id", "kept"])
