"""Language-model scoring with class-based n-grams over exchange clusters (Brown classes).

P(word | word before) = P(class | class before) * P(word | class). The `clustered` most frequent words get classes by
the exchange algorithm, distributed: every round counts, over the whole training corpus and in parallel, how often each
word stands before and after each class; then the words of the round's half, one after the other, move to the class that gains
most likelihood. Rounds end when the likelihood of the corpus no longer rises, and its best classes stand. The other words in memory that occur LEAST times at least make the same choice
once, from the contexts of all their occurrences. What is left falls into a few classes by form (non-ASCII bytes, ending
in punctuation), whose emissions add one to every count and keep one count for unseen words; the end of a text is a class
of its own. Transitions are smoothed towards the class unigram.

What a worker holds is bounded: the `frequent` words with their counts. Words beyond them are counted and looked up by
shuffles. Words are bytes between ASCII white space, A-Z in lower case.

Defined cases: a null text is empty, so its one token is the end; empty training rows still count as ends; with no
training rows every probability comes from the added ones; repeated rows are scored each by itself; a null key is
trained on unless its crc32 (of the empty text) says otherwise; an empty table gives an empty result; only the key is kept of the other columns.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, crc_mod, discard, materialize, small_batches

CLASSES = 64
CLUSTERED = 16_384
FREQUENT = 200_000
#: Rounds at most, of half the words each; they end when the last two raised the likelihood by less than this part of it.
ROUNDS = 10
SETTLED = 5e-4
#: Words that occur less often have too few contexts, and stand for what is unseen.
LEAST = 3
#: Classes by form of the words that are not clustered.
FORMS = 4
#: Counts that the class unigram adds to each transition row.
SMOOTH = 4.0
#: Words a worker counts before it hands the counts on.
FLUSH = 400_000
#: Words of one block of the exchange step, and the partial sums that a block's counts are merged in.
BLOCK, SALTS = 1024, 16


def form(word: bytes) -> int:
    return 2 * (not word.isascii()) + (not word[-1:].isalnum() and word[-1] < 128)


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word binary, n), counted in the tasks first."""

    def count(frames):
        seen: Counter = Counter()
        for frame in frames:
            for body in frame[text]:
                seen.update((body or "").encode().lower().split())
                if len(seen) > FLUSH:
                    yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                    seen = Counter()
        if seen:
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    return texts.select(text).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, frequent: int) -> tuple[list[bytes], np.ndarray]:
    """The words that occur at least as often as makes them `frequent` words at most, most frequent first.

    The cut is found from how many words have each count, so nothing is sorted or sent beyond the words themselves.
    """
    by_count = sorted(((r.n, r.k) for r in counts.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)  # a row for each distinct count
    least, total = None, 0
    for n, k in by_count:
        total += k
        if total > frequent:
            break
        least = n
    if least is None:
        return [], np.zeros(0, np.int64)
    table = counts.where(F.col("n") >= least).toArrow()
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], n[order].astype(np.int64)


def encode(docs: DataFrame, key: str, text: str, held_out, vocab: dict[bytes, int]) -> DataFrame:
    """Per row: ids (binary int32; -1 - form for words out of vocab) and the other words (binary, joined by blanks)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(frames):
        find = shared.value.get
        for frame in frames:
            ids, rest = [], []
            for body in frame[text]:
                words = (body or "").encode().lower().split()
                row = [find(w, -1) for w in words]
                other = []
                if -1 in row:
                    for i, k in enumerate(row):
                        if k < 0:
                            other.append(words[i])
                            row[i] = -1 - form(words[i])
                ids.append(np.array(row, np.int32).tobytes())
                rest.append(b" ".join(other))
            yield pd.DataFrame({"key": frame[key].astype("Int64"), "held_out": frame["held_out"], "ids": ids, "rest": rest})

    return docs.select(F.col(key).cast("long").alias(key), text, held_out.alias("held_out")).mapInPandas(run, "key long, held_out boolean, ids binary, rest binary")


def _classes_of(ids: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Classes of a row's ids; forms follow the learnt classes."""
    return np.where(ids >= 0, cls[np.maximum(ids, 0)], CLASSES - 1 - ids)


def _corpus(ids_column) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of the ids of many rows, each followed by an end (id -1 - FORMS), and no row before the first."""
    end = np.array([-1 - FORMS], np.int32)
    return np.concatenate([end, *(x for b in ids_column for x in (np.frombuffer(b, np.int32), end))])


def context_counts(train: DataFrame, cls: np.ndarray, clustered: int) -> DataFrame:
    """(block, counts): for each word of the block, how often each class follows and precedes it, as one int64 array.

    Block -1 holds the counts of class pairs.
    """
    n_cls = CLASSES + FORMS + 1
    shared = train.sparkSession.sparkContext.broadcast(cls)
    blocks = -(-clustered // BLOCK)

    def count(frames):
        c = shared.value
        sums = np.zeros((blocks * BLOCK, 2, n_cls), np.int64)
        flat, size, any_rows, pairs = sums.reshape(-1), sums.size, False, np.zeros(n_cls * n_cls, np.int64)
        for frame in frames:
            if not len(frame):
                continue
            any_rows = True
            ids = _corpus(frame["ids"])
            k = _classes_of(ids, c)
            pairs += np.bincount(k[:-1] * n_cls + k[1:], minlength=n_cls * n_cls)
            a = np.flatnonzero((ids[:-1] >= 0) & (ids[:-1] < clustered))
            b = np.flatnonzero((ids[1:] >= 0) & (ids[1:] < clustered)) + 1
            flat += np.bincount(np.concatenate((ids[a].astype(np.int64) * 2 * n_cls + k[a + 1], ids[b].astype(np.int64) * 2 * n_cls + n_cls + k[b - 1])), minlength=size)
        if any_rows:
            yield pd.DataFrame({"block": np.arange(-1, blocks), "counts": [pairs.tobytes(), *(sums[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(blocks))]})

    def add(frame):
        total = np.sum([np.frombuffer(x, np.int64) for x in frame["counts"]], axis=0)
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "counts": [total.tobytes()]})

    parts = train.select("ids").mapInPandas(count, "block int, counts binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return parts.groupBy("block", "salt").applyInPandas(add, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary")


def transitions(train: DataFrame, cls: np.ndarray) -> np.ndarray:
    """Counts of class pairs over the corpus; a row's first class follows the end class."""
    n_cls = CLASSES + FORMS + 1
    shared = train.sparkSession.sparkContext.broadcast(cls)

    def count(frames):
        total = np.zeros(n_cls * n_cls, np.int64)
        for frame in frames:
            k = _classes_of(_corpus(frame["ids"]), shared.value)
            total += np.bincount(k[:-1] * n_cls + k[1:], minlength=n_cls * n_cls)
        yield pd.DataFrame({"pair": np.arange(n_cls * n_cls), "n": total})

    got = train.select("ids").mapInPandas(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # classes squared
    out = np.zeros(n_cls * n_cls, np.int64)
    out[got["pair"]] = got["n"]
    return out.reshape(n_cls, n_cls)


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of the corpus under class bigrams, but for the part that classes do not change."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=0)).sum() - _xlogx(pairs.sum(axis=1)).sum())


def _gains(out: np.ndarray, into: np.ndarray, own: int, n2: np.ndarray, left, right, base_out, base_in) -> np.ndarray:
    """What each class gains if a word of class `own`, with these counts of classes after and before it, moves there."""
    total = out.sum()
    o, n = np.flatnonzero(out), np.flatnonzero(into)
    m_out, m_in, m_left, m_right = n2[:, o].copy(), n2.T[:, n].copy(), left.copy(), right.copy()
    b_out, b_in = base_out[:, o].copy(), base_in[:, n].copy()
    m_out[own] -= out[o]
    m_in[own] -= into[n]
    m_left[own] -= total
    m_right[own] -= total
    b_out[own], b_in[own] = _xlogx(m_out[own]), _xlogx(m_in[own])
    gain = (_xlogx(m_out + out[o]) - b_out).sum(axis=1) + (_xlogx(m_in + into[n]) - b_in).sum(axis=1)
    return gain - (_xlogx(m_left + total) - _xlogx(m_left) + _xlogx(m_right + total) - _xlogx(m_right))


def exchange(contexts: DataFrame, cls: np.ndarray, pairs: np.ndarray, parity: int, clustered: int) -> np.ndarray:
    """Classes after one pass over the words of the round's half, most frequent first, each moving where it gains most.

    A move changes the counts that the next word sees, without which all words of a kind would run to one class. So the pass
    is one task, over the `clustered` words' counts; what a word's neighbours were called before the pass stands for them.
    """
    shared = contexts.sparkSession.sparkContext.broadcast((cls[:clustered], pairs))

    def move(frames):
        blobs = {int(block): blob for frame in frames for block, blob in zip(frame["block"], frame["counts"])}
        new, n2 = shared.value[0].copy(), shared.value[1].copy()
        left, right, base_out, base_in = n2.sum(axis=1), n2.sum(axis=0), _xlogx(n2), _xlogx(n2.T)
        for block in sorted(blobs):
            counts = np.frombuffer(blobs[block], np.int64).reshape(BLOCK, 2, CLASSES + FORMS + 1)
            for i in range(min(BLOCK, clustered - block * BLOCK)):
                w = block * BLOCK + i
                if (w * 0x9E3779B1 >> 7) % 2 != parity:
                    continue
                (out, into), own = counts[i], new[w]
                gain = _gains(out, into, own, n2, left, right, base_out, base_in)[:CLASSES]
                to = int(gain.argmax())
                if to == own or gain[to] <= gain[own] + 1e-9:
                    continue
                total, both = out.sum(), [own, to]
                for c, sign in ((own, -1), (to, 1)):
                    n2[c] += sign * out
                    n2[:, c] += sign * into
                    left[c] += sign * total
                    right[c] += sign * total
                base_out[both], base_in[both] = _xlogx(n2[both]), _xlogx(n2.T[both])
                base_out[:, both], base_in[:, both] = _xlogx(n2[:, both]), _xlogx(n2.T[:, both])
                new[w] = to
        yield pd.DataFrame({"word": np.arange(clustered), "cls": new})

    got = contexts.coalesce(1).mapInPandas(move, "word int, cls int").toPandas()  # a row per clustered word
    new = cls.copy()
    new[got["word"]] = got["cls"]
    return new


def join_classes(train: DataFrame, cls: np.ndarray, pairs: np.ndarray, first: int, learnt: int) -> np.ndarray:
    """Classes with those of the words first to learnt - 1 chosen by one exchange step, from counts that are shuffled as they are, few a word."""
    n_cls = CLASSES + FORMS + 1
    shared = train.sparkSession.sparkContext.broadcast((cls, pairs))

    def count(frames):
        c = shared.value[0]
        for frame in frames:
            if not len(frame):
                continue
            ids = _corpus(frame["ids"])
            k = _classes_of(ids, c)
            a = np.flatnonzero((ids[:-1] >= first) & (ids[:-1] < learnt))
            b = np.flatnonzero((ids[1:] >= first) & (ids[1:] < learnt)) + 1
            code, n = np.unique(np.concatenate((ids[a].astype(np.int64) * 2 * n_cls + k[a + 1], ids[b].astype(np.int64) * 2 * n_cls + n_cls + k[b - 1])), return_counts=True)
            yield pd.DataFrame({"code": code, "n": n})

    def choose(frame):
        old, n2 = shared.value
        left, right, base_out, base_in = n2.sum(axis=1), n2.sum(axis=0), _xlogx(n2), _xlogx(n2.T)
        frame = frame.sort_values("code")
        code, n = frame["code"].to_numpy(), frame["n"].to_numpy()
        words, starts = np.unique(code // (2 * n_cls), return_index=True)
        best = []
        for w, lo, hi in zip(words, starts, [*starts[1:], len(code)]):
            counts = np.zeros(2 * n_cls, np.int64)
            counts[code[lo:hi] % (2 * n_cls)] = n[lo:hi]
            best.append(int(_gains(counts[:n_cls], counts[n_cls:], old[w], n2, left, right, base_out, base_in)[:CLASSES].argmax()))
        return pd.DataFrame({"word": words, "cls": best})

    counts = materialize(train.select("ids").mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "rare-contexts")
    got = counts.groupBy((F.col("code") / (2 * n_cls * BLOCK)).cast("long").alias("block")).applyInPandas(choose, "word int, cls int").toPandas()  # a row per word in memory
    new = cls.copy()
    new[got["word"]] = got["cls"]
    return new


class Model(NamedTuple):
    """words and freq: what is in memory, most frequent first; cls: their classes; trans: log10 P(class | class before); emit: log10 P(word | class)."""

    words: list[bytes]
    freq: np.ndarray
    cls: np.ndarray
    trans: np.ndarray
    emit: np.ndarray
    form_total: np.ndarray
    n_all: int
    v_all: int
    ends: int
    likelihoods: list[float]


def fit(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text", clustered: int = CLUSTERED, frequent: int = FREQUENT, rounds: int = ROUNDS) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the counts of all training words (word, n), and the encoded rows."""
    counts = materialize(word_counts(docs.where(~held_out), text), "word-counts")
    ends = docs.where(~held_out).count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, v_all = sums[0] + ends, sums[1] + (ends > 0)
    words, freq = _frequent(counts, frequent)
    vocab = {w: i for i, w in enumerate(words)}
    learnt = int((freq >= LEAST).sum())
    clustered = min(clustered, learnt)
    forms = np.array([form(w) for w in vocab], np.int64)
    cls = np.concatenate((CLASSES + forms, [0]))  # one more entry, so that an empty vocabulary can be indexed
    cls[:clustered] = np.arange(clustered) * CLASSES // max(1, clustered) if clustered < 2 * CLASSES else forms[:clustered] * (CLASSES // FORMS) + np.arange(clustered) % (CLASSES // FORMS)
    coded = materialize(encode(docs, key, text, held_out, vocab).withColumn("rid", F.monotonically_increasing_id()), "coded-texts")
    train, seen = coded.where("not held_out"), []
    best, best_pairs = cls, None
    with small_batches(docs.sparkSession, 2_500):  # ids are short, and a task sums what it has read
        for k in range(rounds if clustered else 0):
            contexts = materialize(context_counts(train, cls, clustered), "contexts")
            found = [np.frombuffer(r.counts, np.int64) for r in contexts.where("block < 0").collect()]  # one row
            pairs = np.sum(found, axis=0).reshape(CLASSES + FORMS + 1, -1) if found else np.zeros((CLASSES + FORMS + 1,) * 2, np.int64)
            seen.append(likelihood(pairs))
            if seen[-1] == max(seen):
                best, best_pairs = cls, pairs
            if k > 1 and max(seen) - max(seen[:-2]) <= SETTLED * abs(max(seen)):
                break
            cls = exchange(contexts.where("block >= 0"), cls, pairs, k % 2, clustered)
            discard(contexts)
        for step in range(2):  # the last round's classes, then those of the other words; each stands if the likelihood does not fall
            if step and learnt > clustered:
                cls = join_classes(train, best, best_pairs, clustered, learnt)
            if best_pairs is None or not np.array_equal(cls, best):
                pairs = transitions(train, cls)
                seen.append(likelihood(pairs))
                if seen[-1] == max(seen):
                    best, best_pairs = cls, pairs
            cls = best
    pairs = best_pairs.astype(float)
    in_class = cls[: len(freq)] < CLASSES

    # classes: learnt, forms, end. Counts of form classes also hold the rare words
    n_cls, total = CLASSES + FORMS + 1, pairs.sum()
    uni = (pairs.sum(axis=0) + 1) / (total + n_cls)
    trans = np.log10((pairs + SMOOTH * uni) / (pairs.sum(axis=1, keepdims=True) + SMOOTH))
    form_of = F.when(F.col("word").cast("string").rlike(r"[^\x00-\x7F]"), 2).otherwise(0) + F.when(F.substring(F.hex("word"), -2, 2).rlike("^(3[0-9]|[46][1-9A-F]|[57][0-9A]|[89A-F].)$"), 0).otherwise(1)
    shapes = counts.groupBy(form_of.alias("f")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas().set_index("f")
    form_total = np.array([float(shapes["n"].get(f, 0) + shapes["v"].get(f, 0)) for f in range(FORMS)]) + 1
    for f in range(FORMS):  # without the words that have a learnt class
        own = in_class & (forms == f)
        form_total[f] -= freq[own].sum() + own.sum()
    learnt_n = np.bincount(cls[: len(freq)][in_class], freq[in_class], CLASSES)
    emit = np.log10((freq + 1) / form_total[forms]) if len(freq) else np.empty(0)
    emit[in_class] = np.log10(freq[in_class] / learnt_n[cls[: len(freq)][in_class]])
    return Model(words, freq, cls, trans, emit, form_total, int(n_all), int(v_all), ends, seen), counts, coded


def score(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text", clustered: int = CLUSTERED, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; held_out rows are not learnt from."""
    spark = docs.sparkSession
    bound_batches(spark)
    model, counts, coded = fit(docs, held_out, key, text, clustered, frequent, rounds)
    n_all, v_all, ends = model.n_all, model.v_all, model.ends
    base = np.log10((model.freq + 1) / (n_all + v_all + 1))
    base_end = float(np.log10((ends + 1) / (n_all + v_all + 1)))
    shared = spark.sparkContext.broadcast((model.cls, model.trans, model.emit, base))
    end = CLASSES + FORMS

    def run(frames):
        cls, trans, emit, base = shared.value
        for frame in frames:
            rows = []
            for blob in frame["ids"]:
                ids = np.frombuffer(blob, np.int32)
                k = np.concatenate(([end], _classes_of(ids, cls), [end]))
                known = ids[ids >= 0]
                rows.append((len(ids) + 1, len(known) + (ends > 0), base_end + base[known].sum(), trans[k[:-1], k[1:]].sum() + emit[known].sum()))
            n, known, b, s = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"rid": frame["rid"], "key": frame["key"].astype("Int64"), "held_out": frame["held_out"], "n_tokens": n, "n_known": known, "base": b, "score": s})

    here = coded.select("rid", "key", "held_out", "ids").mapInPandas(run, "rid long, key long, held_out boolean, n_tokens long, n_known long, base double, score double")
    rare = materialize(_rare_words(coded), "rare-words")
    per_form = F.element_at(F.array(*[F.lit(float(np.log10(x))) for x in model.form_total]), F.col("f") + 1)
    c = F.coalesce(F.col("n"), F.lit(0))
    rare = rare.join(counts, "word", "left").withColumn("f", F.col("f").cast("int"))
    rare = rare.select("rid", (F.col("k") * (c > 0).cast("long")).alias("n_known"), (F.col("k") * (F.log10(c + 1) - float(np.log10(n_all + v_all + 1)))).alias("base"), (F.col("k") * (F.log10(c + 1) - per_form)).alias("score"))
    rare = rare.groupBy("rid").agg(F.sum("n_known").alias("n_known_"), F.sum("base").alias("base_"), F.sum("score").alias("score_"))
    out = here.join(rare, "rid", "left")
    plus = lambda a: F.col(a) + F.coalesce(F.col(f"{a}_"), F.lit(0))
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", plus("n_known").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), plus("base").alias("base_score"), plus("score").alias("score"))


def _rare_words(coded: DataFrame) -> DataFrame:
    """(rid, word, f, k): how often a row holds each word that is not held in memory."""

    def run(frames):
        for frame in frames:
            rid, word, f, k = [], [], [], []
            for r, blob in zip(frame["rid"], frame["rest"]):
                for w, n in Counter(blob.split()).items():
                    rid.append(r)
                    word.append(w)
                    f.append(form(w))
                    k.append(n)
            yield pd.DataFrame({"rid": rid, "word": word, "f": f, "k": k}).astype({"rid": "int64", "f": "int32", "k": "int64"})

    return coded.where("length(rest) > 0").select("rid", "rest").mapInPandas(run, "rid long, word binary, f int, k long")


def held_out(key: str = "doc_id") -> F.Column:
    return crc_mod(key, 7) == 2
