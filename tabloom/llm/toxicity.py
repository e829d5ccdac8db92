"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words and their stems, word pairs and pairs that skip one or two words, hashed to a fixed
number of coordinates; a coordinate's value is its count over the square root of the number of features, scaled. The learner keeps two
sums per coordinate (FTRL-proximal), so every coordinate has its own rate, and L1 leaves most weights exactly zero; the
rest is broadcast (bounded by the number of coordinates) and every whole text is scored in one pass over the table.

Fitting uses at most `max_rows` labelled rows, the first by a hash of their key; that bound is a parameter and the only
one. Scoring covers all rows.

Defined cases: a null or empty text has no features and gets the score of the bias; several labels of one key count as
the largest; null labels and null keys are not learnt from; with no labelled rows every score is 0; an empty table
gives an empty result; extra columns pass through; equal texts get equal scores.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, crc_mod, free_name, mix64

BITS = 22
MAX_ROWS = 8_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
#: Words ahead that a pair may reach: neighbours, and skips of one and two words.
REACH = (1, 2, 3)
#: Letters of a word's stem.
STEM = 5
#: Factor on feature values, which are small in long texts.
SCALE = 10.0
#: Entries that a worker keeps of its word cache, about 20 MB.
CACHE = 100_000
#: Scores from here on are rejected.
REJECT = 0.3


class WordHashes(dict):
    """64-bit hashes of a word and of its stem (its first letters), 8 bytes each, computed once for each frequent word."""

    def __missing__(self, word: str) -> bytes:
        import xxhash

        h = xxhash.xxh64_digest(word, seed=6) + xxhash.xxh64_digest(word[:STEM], seed=7)
        if len(self) < CACHE:
            self[word] = h
        return h


def features(text: str, hashes: WordHashes, words=re.compile(r"\w+").findall) -> np.ndarray:
    """Coordinates of all features of a text, with repeats."""
    both = np.frombuffer(b"".join(map(hashes.__getitem__, words(text.lower()))), "<u8")
    h = both[::2]
    parts = [both]
    for k in REACH:
        if len(h) > k:
            parts.append(mix64(h[:-k] * np.uint64(2 * k + 1) + np.uint64(k)) ^ h[k:])
    return (np.concatenate(parts) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal; the bias has no L1."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.zb = self.nb = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, z, n):
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def bias(self) -> float:
        return -self.zb / ((self.beta + self.nb**0.5) / self.alpha)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        z, n, b = self.z[at], self.n[at], self.bias()
        w = self.weights(z, n)
        error = 1 / (1 + np.exp(-np.clip(w @ value + b, -35, 35))) - label
        g = error * value
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g
        self.zb += error - ((self.nb + error * error) ** 0.5 - self.nb**0.5) / self.alpha * b
        self.nb += error * error


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", held_out=None, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse weights (coordinates, values, bias); held_out: column of labels' rows that are not learnt from."""
    bound_batches(docs.sparkSession)
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    if held_out is not None:
        rows = rows.where(~held_out)
    chosen = rows.groupBy(key).agg(F.max(label).alias("_y")).orderBy(F.xxhash64(F.lit(6), key), key).limit(max_rows)
    sample = docs.select(key, text).join(F.broadcast(chosen), key).orderBy(F.xxhash64(F.lit(7), key), key, F.xxhash64(text)).limit(max_rows)

    def train(frames):
        hashes, seen = WordHashes(), []
        for frame in frames:
            for body, y in zip(frame[text], frame["_y"]):
                f = features(body or "", hashes)
                at, n = np.unique(f, return_counts=True)
                seen.append((at.astype(np.int32), (SCALE * n / max(1, len(f)) ** 0.5).astype(np.float32), int(y)))
        model, order = Ftrl(), np.random.default_rng(6)
        for _ in range(EPOCHS):
            for i in order.permutation(len(seen)):
                model.learn(*seen[i])
        w = model.weights(model.z, model.n)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"at": np.append(at, -1), "w": np.append(w[at], model.bias() if seen else -np.inf)})

    got = sample.coalesce(1).mapInPandas(train, "at long, w double").toPandas()  # at most 2**BITS rows
    own = got[got["at"] >= 0]
    bias = got.loc[got["at"] < 0, "w"]
    return own["at"].to_numpy(np.int64), own["w"].to_numpy(np.float32), float(bias.iloc[0]) if len(bias) else float("-inf")


def score(docs: DataFrame, model, text: str = "text", name: str = "score", keep_text: bool = True) -> DataFrame:
    """Adds the probability of label 1 to every row."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    bound_batches(docs.sparkSession)
    name = free_name(docs, name)[0]
    keep = [c for c in docs.columns if keep_text or c != text]
    schema = StructType([*(docs.schema[c] for c in keep), StructField(name, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column, kept = docs.columns.index(text), [docs.columns.index(c) for c in keep]

    def run(batches):
        import pyarrow as pa

        at, w, bias = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w
        hashes = WordHashes()
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, body in enumerate(batch.column(column)):
                f = features(body.as_py() or "", hashes)
                out[i] = SCALE * dense[f].sum(dtype=np.float64) / max(1, len(f)) ** 0.5
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-(out + bias)))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(p)], names=[*keep, name])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> F.Column:
    return crc_mod(key, 4) == 2
