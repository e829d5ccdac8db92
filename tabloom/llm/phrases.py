r"""Phrase collocations by suffix arrays over word ids.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\x0A-\x0D]` and into words `[^\x20\x09]+`, and gathered by language into
shards of some million words. Within a shard numpy prefix doubling sorts the suffixes of its word ids, and the LCP intervals of
depth k are its phrases of k words with their counts. Counts of all shards are merged by key in three steps, each of which sends on
only what can still be frequent, as no phrase is more frequent than a phrase inside it:

1. words; the frequent ones get global ids, all others part pieces from here on;
2. pairs of frequent words; a shard is told which of its pairs are frequent by one bit for each;
3. phrases of three to five words all of whose pairs are frequent.

Shards are written in buckets by their number, so that what comes back to them is shuffled and they are not. What a shard sends to a bucket of keys is one row of packed arrays. A key stands in a shard once, so a word in every text is a row
entry for each shard and no bucket is hot; the number of buckets grows with the number of words.

Candidates are phrases of 2 to 5 words with a = f(phrase) >= least. Their score is that of their weakest cut,
floor(1000 * a * n / (l * r)), in decimals of 38 digits. A candidate goes if its words lie inside a longer candidate that is at least
`covered` percent as frequent. Each language's best `most` remain.

Defined cases: a null text is empty; a null language is `und`; empty texts and pieces hold no words; a text of any length is read
whole (a shard that ends within a piece hands its last words to the next one, which does not count them again); repeated rows count
as often as they stand there; an empty table gives an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, materialize, materialize_by, mix64, small_batches

#: Phrases have at most so many words.
LONGEST = 5
#: Occurrences of a candidate, the share of them (in percent) that a longer one must hold to cover it, and rows kept for a language.
LEAST, COVERED, MOST = 100, 100, 2000
#: Words of a shard, about.
SHARD = 1_000_000
#: Keys that a bucket holds, about.
BUCKET = 1_000_000
#: Bytes of a text that are split into words at a time.
STRETCH = 8 << 20

_MARKS = bytes.maketrans(b"\t.,;:!?\x0a\x0b\x0c\x0d", b" " + b"\n" * 10)


def pack(a: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, high planes of zeros left out: compresses well and takes no more than the largest needs."""
    planes = np.ascontiguousarray(a, dtype="<u8").view(np.uint8).reshape(len(a), 8).T
    width = 8
    while width and not planes[width - 1].any():
        width -= 1
    return bytes([width]) + planes[:width].tobytes()


def unpack(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((8, n), np.uint8)
    out[: blob[0]] = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], n)
    return np.ascontiguousarray(out.T).reshape(-1).view("<u8")


# ---- suffix arrays of one shard


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` ids at least, and the ids that each shares with the one before it, up to `depth`."""
    n = len(ids)
    rank, step = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.argsort(rank, kind="stable")
    lcp, alike = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    for d in range(depth):
        a, b = order[:-1] + d, order[1:] + d
        alike &= (a < n) & (b < n)
        alike &= ids[np.minimum(a, n - 1)] == ids[np.minimum(b, n - 1)]
        lcp[1:] += alike
    return order, lcp


def room(ids: np.ndarray) -> np.ndarray:
    """Words from here to the next break (0)."""
    n = len(ids)
    ends = np.where(ids == 0, np.arange(n), n)
    return np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)


def intervals(order, lcp, space, k: int, counted, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LCP intervals of depth k without a break that count `least` times: where they start in the order, where the next one does, and how often they count."""
    starts = np.flatnonzero(lcp < k)
    ends = np.append(starts[1:], len(order))
    n = np.add.reduceat(counted[order].astype(np.int64), starts) if len(starts) else starts
    there = (space[order[starts]] >= k) & (n >= least)
    return starts[there], ends[there], n[there]


def runs(ids: np.ndarray, link: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of least (2 or 3) or more words with a link from each to the next, a 0 after each stretch; and where the words stood."""
    before, before2 = np.append(False, link)[:-1], np.append([False, False], link)[:-2]
    after = np.append(link, False)[1:]
    inside = link | before if least == 2 else (link & after) | (before & link) | (before & before2)
    at = np.flatnonzero(inside)
    twice = np.repeat(at, 1 + ~link[at])
    breaks = np.append(False, twice[1:] == twice[:-1]) if len(twice) else np.zeros(0, bool)
    return np.where(breaks, 0, ids[twice]), twice


# ---- shards


SHARDS = "lang string, lead int, words long, ids binary, length long, vocabulary binary, counts binary, entries long"


class _Shard:
    """Ids of the words of one language, 0 for the end of a piece; the first `lead` of them belong to the shard before."""

    def __init__(self, lang: str):
        self.lang, self.lead, self.n = lang, 0, 0
        self.vocabulary: defaultdict = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.vocabulary[b"\n"] = 0
        self.parts: list[np.ndarray] = []

    def add(self, tokens: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.vocabulary.__getitem__, tokens), np.int64, len(tokens)))
        self.n += len(tokens)

    def row(self):
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids[self.lead :], minlength=len(self.vocabulary))[1:]
        return (self.lang, self.lead, int(counts.sum()), pack(ids), len(ids), b"\n".join(list(self.vocabulary)[1:]), pack(counts), len(counts))

    def goes_on(self) -> bool:
        return next((bool(p[-1]) for p in reversed(self.parts) if len(p)), False)

    def rest(self) -> _Shard:
        """The shard that goes on within the same piece."""
        out, names = _Shard(self.lang), list(self.vocabulary)
        tail = np.concatenate(self.parts)[-(LONGEST - 1) :]
        ends = np.flatnonzero(tail == 0)
        out.add([names[i] for i in tail[ends[-1] + 1 if len(ends) else 0 :]])
        out.lead = out.n
        return out


def _tokens(body: bytes, stretch: int):
    """Words, and `\\n` where a piece ends, in lists of bounded length."""
    body, start = body.lower().translate(_MARKS).replace(b"\n", b" \n "), 0
    while len(body) - start > stretch and (cut := body.find(b" ", start + stretch)) > 0:
        yield list(filter(None, body[start:cut].split(b" ")))
        start = cut
    yield [*filter(None, body[start:].split(b" ")), b"\n"]


def _shards(batches, size: int, stretch: int):
    held: dict[str, _Shard] = {}
    names = [c.split()[0] for c in SHARDS.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    def out(shard):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(shard.row(), types)], names=names)

    for batch in batches:
        for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            for tokens in _tokens(body.as_py(), stretch):
                shard = held.get(lang) or held.setdefault(lang, _Shard(lang))
                shard.add(tokens)
                if shard.n >= size:
                    yield out(held.pop(lang))
                    if shard.goes_on():
                        held[lang] = shard.rest()
        if sum(s.n for s in held.values()) >= 2 * size:
            yield from map(out, held.values())
            held = {}
    yield from map(out, held.values())


# ---- words


def _bucket_of_words(lang: str, words: list[bytes], buckets: int) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) % buckets for w in words), np.int64, len(words))


def _by_bucket(bucket: np.ndarray):
    """(bucket, places in it) of each bucket that is met; the order is the same wherever this is asked."""
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return [(int(bucket[part[0]]), part) for part in np.split(order, at[1:])] if len(order) else []


def _send_words(frames, buckets: int):
    for frame in frames:
        for shard, lang, blob, counts, n in zip(frame["shard"], frame["lang"], frame["vocabulary"], frame["counts"], frame["entries"]):
            if n:
                words, c = np.array(blob.split(b"\n"), dtype=object), unpack(counts, n)
                rows = [(b, shard, lang, b"\n".join(words[at]), pack(c[at]), len(at)) for b, at in _by_bucket(_bucket_of_words(lang, words, buckets))]
                yield pd.DataFrame(rows, columns=["bucket", "shard", "lang", "words", "counts", "n"])


MERGED = "shard long, bucket long, ids binary, n long, langs array<string>, words binary, counts binary"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _merge_words(frame: pd.DataFrame, buckets: int, least: int) -> pd.DataFrame:
    """What goes back to each shard: global ids of its words, 0 for rare ones; and one row (shard -1) with the frequent words."""
    total: Counter = Counter()
    sent = []
    for shard, lang, blob, counts, n in zip(frame["shard"], frame["lang"], frame["words"], frame["counts"], frame["n"]):
        keys = [(lang, w) for w in blob.split(b"\n")]
        sent.append((shard, keys))
        for k, c in zip(keys, unpack(counts, n).tolist()):
            total[k] += c
    bucket = int(frame["bucket"].iloc[0])
    kept = sorted(k for k, c in total.items() if c >= least)
    ids = {k: 1 + bucket + buckets * i for i, k in enumerate(kept)}
    rows = [(shard, bucket, pack(np.fromiter((ids.get(k, 0) for k in keys), np.int64, len(keys))), len(keys), [], b"", b"") for shard, keys in sent]
    if kept:
        rows.append((-1, bucket, pack(np.array([ids[k] for k in kept])), len(kept), [k[0] for k in kept], b"\n".join(k[1] for k in kept), pack(np.array([total[k] for k in kept]))))
    return _frame(rows, MERGED)


def _name_words(frames):
    for frame in frames:
        for ids, n, langs, words, counts in zip(frame["ids"], frame["n"], frame["langs"], frame["words"], frame["counts"]):
            yield pd.DataFrame({"id": unpack(ids, n).astype(np.int64), "lang": list(langs), "word": [w.decode() for w in words.split(b"\n")], "f": unpack(counts, n).astype(np.int64)})


def _recode(frames, buckets: int):
    """Shards with global ids for local ones."""
    for frame in frames:
        for shard, lang, lead, blob, length, vocabulary, back in zip(frame["shard"], frame["lang"], frame["lead"], frame["ids"], frame["length"], frame["vocabulary"], frame["back"]):
            words, found = vocabulary.split(b"\n"), {b["bucket"]: (b["ids"], b["n"]) for b in back}
            ids = np.zeros(len(words) + 1, np.uint64)
            for bucket, at in _by_bucket(_bucket_of_words(lang, words, buckets)):
                ids[at + 1] = unpack(*found[bucket])
            yield _frame([(shard, lead, pack(ids[unpack(blob, length)]), length)], CODED)


# ---- phrases of several words

CODED = "shard long, lead int, ids binary, length long"
SENT = "k int, bucket long, shard long, keys array<binary>, counts binary, n long"
GRAMS = "k int, bucket long, shard long, flags binary, keys array<binary>, counts binary, n long"


class _Sorted:
    """Suffix array of the stretches of words that hang together."""

    def __init__(self, ids: np.ndarray, link: np.ndarray, lead: int, least: int, depth: int):
        self.ids, self.at = runs(ids, link, least)
        self.order, self.lcp = suffix_array(self.ids, depth)
        self.space, self.lead = room(self.ids), lead

    def phrases(self, k: int):
        # pairs among the words handed on count nothing here, but whether they are frequent is asked: longer phrases begin with them
        starts, ends, n = intervals(self.order, self.lcp, self.space, k, self.at + k > self.lead, least=int(k > 2))
        first = self.order[starts]
        return starts, ends, n, [self.ids[first + d] for d in range(k)]


def _pairs(ids: np.ndarray, lead: int) -> _Sorted:
    return _Sorted(ids, np.append((ids[:-1] > 0) & (ids[1:] > 0), False), lead, 2, 2)


def _bucket_of(keys: list[np.ndarray], buckets: int) -> np.ndarray:
    h = np.zeros(len(keys[0]), np.uint64)
    for key in keys:
        h = mix64((h ^ key.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return (h % np.uint64(buckets)).astype(np.int64)


def _sent(k: int, shard: int, keys: list[np.ndarray], n: np.ndarray, buckets: int) -> pd.DataFrame:
    return _frame([(k, b, shard, [pack(x[at]) for x in keys], pack(n[at]), len(at)) for b, at in _by_bucket(_bucket_of(keys, buckets))], SENT)


def _send_pairs(frames, buckets: int):
    for frame in frames:
        for shard, lead, blob, length in zip(frame["shard"], frame["lead"], frame["ids"], frame["length"]):
            _, _, n, keys = _pairs(unpack(blob, length).astype(np.int64), lead).phrases(2)
            yield _sent(2, shard, keys, n, buckets)


def _send_longer(frames, buckets: int):
    """Phrases of three words and more, all pairs of which are frequent."""
    for frame in frames:
        for shard, lead, blob, length, back in zip(frame["shard"], frame["lead"], frame["ids"], frame["length"], frame["back"]):
            ids = unpack(blob, length).astype(np.int64)
            pairs = _pairs(ids, lead)
            starts, ends, n, keys = pairs.phrases(2)
            found, frequent = {b["bucket"]: b["flags"] for b in back}, np.zeros(len(starts), bool)
            for bucket, at in _by_bucket(_bucket_of(keys, int(back[0]["of"]))):
                frequent[at] = np.unpackbits(np.frombuffer(found[bucket], np.uint8), count=len(at)).astype(bool)
            link = np.zeros(length, bool)
            for s, e in zip(starts[frequent], ends[frequent]):
                link[pairs.at[pairs.order[s:e]]] = True
            longer = _Sorted(ids, link, lead, 3, LONGEST)
            for k in range(3, LONGEST + 1):
                _, _, n, keys = longer.phrases(k)
                yield _sent(k, shard, keys, n, buckets)


def _merge_grams(frame: pd.DataFrame, least: int, back: bool) -> pd.DataFrame:
    """A bit for each key that a shard sent, if it waits for one; and one row (shard -1) with the frequent keys and their counts."""
    k, bucket, sizes = int(frame["k"].iloc[0]), int(frame["bucket"].iloc[0]), frame["n"].to_numpy()
    columns = [np.concatenate([unpack(x[d], n) for x, n in zip(frame["keys"], sizes)]) for d in range(k)]
    counts = np.concatenate([unpack(x, n) for x, n in zip(frame["counts"], sizes)]).astype(np.int64)
    name = np.zeros(len(counts), np.int64)
    for c in columns:  # equal names, equal ids so far
        name = np.unique(name * (len(counts) + 1) + np.unique(c, return_inverse=True)[1], return_inverse=True)[1]
    total, first = np.zeros(name.max() + 1, np.int64), np.zeros(name.max() + 1, np.int64)
    np.add.at(total, name, counts)
    first[name] = np.arange(len(name))
    frequent = total >= least
    rows = []
    if back:
        flags = np.split(frequent[name], np.cumsum(sizes)[:-1])
        rows = [(k, bucket, shard, np.packbits(f).tobytes(), [], b"", len(f)) for shard, f in zip(frame["shard"], flags)]
    if frequent.any():
        rows.append((k, bucket, -1, b"", [pack(c[first[frequent]]) for c in columns], pack(total[frequent]), int(frequent.sum())))
    return _frame(rows, GRAMS)


def _name_grams(frames):
    for frame in frames:
        for keys, counts, n in zip(frame["keys"], frame["counts"], frame["n"]):
            ids = np.stack([unpack(x, n).astype(np.int64) for x in keys], axis=1)
            yield pd.DataFrame({"ids": list(ids), "f": unpack(counts, n).astype(np.int64)})


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread: list[str], salts: int = 32) -> DataFrame:
    """rows joined with the one row of table that has their keys. Rows of a frequent key are dealt to salts by `spread`."""
    own = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    needed = own.select(*keys, "_salt").distinct()
    return own.join(table.join(needed, keys), [*keys, "_salt"]).drop("_salt")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, shard_words: int = SHARD, bucket_keys: int = BUCKET, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n) words of each language; (id, lang, word, f) frequent words; (ids, f) frequent phrases of 2 to LONGEST of them."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark, 256):
        raw = texts.mapInArrow(lambda b: _shards(b, shard_words, stretch), SHARDS).withColumn("shard", F.monotonically_increasing_id())
        raw = materialize_by(raw, "phrase-shards", "shard")
    entries, words = raw.agg(F.coalesce(F.sum("entries"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    sizes = raw.groupBy("lang").agg(F.sum("words").alias("n"))
    sizes = materialize(sizes.where("n > 0"), "phrase-languages")
    of_words, of_grams = max(tasks, -(-entries // max(1, bucket_keys // 4))), max(tasks, -(-words // (2 * bucket_keys)))

    with small_batches(spark, 1):  # a row is a whole shard
        sent = raw.select("shard", "lang", "vocabulary", "counts", "entries").mapInPandas(lambda f: _send_words(f, of_words), "bucket long, shard long, lang string, words binary, counts binary, n long")
        merged = materialize(sent.groupBy("bucket").applyInPandas(lambda f: _merge_words(f, of_words, least), MERGED), "phrase-words")
        back = merged.where("shard >= 0").groupBy("shard").agg(F.collect_list(F.struct("bucket", "ids", "n")).alias("back"))
        coded = materialize_by(raw.drop("counts").join(back, "shard").mapInPandas(lambda f: _recode(f, of_words), CODED), "phrase-coded", "shard")
        names = materialize(merged.where("shard < 0").select("ids", "n", "langs", "words", "counts").mapInPandas(_name_words, "id long, lang string, word string, f long"), "phrase-names")
        discard(raw)
        discard(merged)
        pairs = coded.mapInPandas(lambda f: _send_pairs(f, of_grams), SENT)
        pairs = materialize(pairs.groupBy("k", "bucket").applyInPandas(lambda f: _merge_grams(f, least, True), GRAMS), "phrase-pairs")
        back = pairs.where("shard >= 0").groupBy("shard").agg(F.collect_list(F.struct("bucket", "flags", F.lit(of_grams).alias("of"))).alias("back"))
        longer = coded.join(back, "shard").mapInPandas(lambda f: _send_longer(f, of_grams), SENT)
        longer = materialize(longer.groupBy("k", "bucket").applyInPandas(lambda f: _merge_grams(f, least, False), GRAMS), "phrase-longer")
        every = pairs.where("shard < 0").union(longer).select("keys", "counts", "n").mapInPandas(_name_grams, "ids array<long>, f long")
        grams = materialize(every, "phrase-grams")
    for table in (coded, pairs, longer):
        discard(table)
    return sizes, names, grams


def _slices(ids) -> F.Column:
    """All contiguous parts of 2 words or more, but for the whole."""
    return F.flatten(F.transform(F.sequence(F.lit(2), F.size(ids) - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size(ids) - n + 1), lambda s: F.slice(ids, s, n))))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered: int = COVERED, most: int = MOST, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    langs, names, grams = frequent_phrases(docs, text, lang, least, **sizes)
    # texts of the candidates
    spelt = lookup(grams.select("ids", "f", F.posexplode("ids").alias("at", "id")), names.select("id", "lang", "word"), ["id"], ["ids"])
    spelt = spelt.groupBy("ids").agg(F.first("f").alias("a"), F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelt = spelt.select("ids", "a", "lang", F.array_join(F.col("words.word"), " ").alias("phrase"))
    found = materialize(lookup(spelt, langs, ["lang"], ["ids"]), "phrase-candidates")
    # the weakest cut
    known = names.select(F.array("id").alias("part"), "f").union(grams.select(F.col("ids").alias("part"), "f"))
    cuts = found.select("ids", "a", "n", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.expr("slice(ids, 1, k)").alias("part")), F.struct(F.lit(1).alias("side"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("part")))
    parts = lookup(cuts.select("*", F.inline(sides)), known, ["part"], ["ids"])
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    cuts = parts.groupBy("ids", "k", "a", "n").agg(of(0).alias("l"), of(1).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumns({"_top": (wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), "_low": (wide("l") * wide("r")).cast("decimal(38,0)")})
    weakest = cuts.groupBy("ids").agg(F.min(F.struct(F.expr("_top div _low").alias("score"), "k", "l", "r")).alias("cut"))
    # what stands inside a longer one
    longer = found.where(F.size("ids") > 2).select(F.col("a").alias("whole"), F.explode(_slices(F.col("ids"))).alias("ids")).groupBy("ids").agg(F.max("whole").alias("whole"))
    left = found.join(weakest, "ids").join(longer, "ids", "left").where(f"whole is null or whole * 100 < a * {int(covered)}")
    left = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each of 64 parts of a language first, so that no task gets all of a language's candidates
    part = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    best = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_at", part).where(F.col("_at") <= most).drop("_part", "_at")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
