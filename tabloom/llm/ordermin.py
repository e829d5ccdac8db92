r"""Order MinHash: fingerprints whose likeness follows the edit distance, and an edited text for each document to try them on.

A text is the sequence of its k-mers of K code points; the n-th occurrence of a k-mer is (k-mer, n), so no two elements are equal.
For each of SKETCHES hash functions the L elements with the smallest hashes are selected and put back in the order in which they
stand in the text; the hash of that tuple of k-mers is one component. Two texts agree in a component with the chance that they
share the L smallest elements in the same order: a transposed text loses components though its k-mers stay.

Elements are hashed once to 32 well-mixed bits x; hash function j is a_j x mod 2^32 with an odd a_j, a bijection. Text is read in
blocks of BLOCK elements, so that a text of any length needs bounded memory besides itself. A text and its edited form share
their first half, which is hashed once.

The next document is the one before in the order of keys. Keys and hashes alone are sorted first; P - 1 bounds of ranges reach the
driver (P: shuffle partitions), and texts are shuffled once, to the task of their range. A range's first row is also sent to the range that
ends there, so that every row finds its next one beside it.

Defined cases: a null text is empty; an empty text has no elements and the constant components of an empty tuple (likeness 1 to another
empty one); a text shorter than K is one element; with fewer than L elements the tuple has all of them; a null key comes last; rows of
equal keys are ordered by the hash of their text; of rows that repeat key and text all but one have themselves as next; a single row is its own
next; an empty table gives an empty result; extra columns pass through, and where they clash the new columns get leading underscores.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, discard, materialize, mix64, shelter
from .copies import mark_repeats

#: Code points of a k-mer, elements of a tuple, components of a fingerprint, and elements of a block.
K, L, SKETCHES, BLOCK = 6, 2, 128, 2048

_G = np.uint64(0x9E3779B97F4A7C15)
_A = (mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _G) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_POWERS = [np.uint64(pow(int(_G), k + 1, 1 << 64)) for k in range(K + 1)]
_FULL = np.iinfo(np.uint64).max
_NONE, _HALF, _PLACE, _EVERY = np.iinfo(np.uint32).max, np.uint64(32), np.uint64((1 << 20) - 1), np.arange(SKETCHES)


def kmers(text: str) -> np.ndarray:
    """Hash of each k-mer, in order; a shorter text is one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if not len(c):
        return c
    h, have, need = c, 1, min(K, len(c))
    while have < need:  # from grams of `have` to overlapping grams of up to twice as many
        step = min(have, need - have)
        h = h[:-step] * _POWERS[step] + h[step:]
        have += step
    return mix64(h)


def _sorted_places(h: np.ndarray) -> np.ndarray:
    """Places in the order of hash and place. The upper bits of the hash are sorted with the place below them, unless they mix two hashes up."""
    if len(h) < 1 << 20:
        order = (np.sort(h & ~_PLACE | np.arange(len(h), dtype=np.uint64)) & _PLACE).astype(np.int64)
        s = h[order]
        if not ((s[1:] != s[:-1]) & ((s[1:] ^ s[:-1]) <= _PLACE)).any():
            return order
    return np.argsort(h, kind="stable")


def elements(h: np.ndarray) -> np.ndarray:
    """32 bits for each k-mer and the number of its occurrence."""
    order = _sorted_places(h)
    s = h[order]
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1])[: len(s)], at, 0))).astype(np.uint64)
    return (mix64(h + (nth + np.uint64(1)) * _G) >> np.uint64(32)).astype(np.uint32)


@functools.cache
def _room() -> np.ndarray:
    return np.empty(SKETCHES * BLOCK, np.uint32)


def smallest(x: np.ndarray, first: int = 0, held: np.ndarray | None = None) -> np.ndarray:
    """hash << 32 | place of the L smallest elements, a column for each hash function, in order; held: those of earlier elements.

    Of equal hashes the earlier place comes first; where there are fewer elements, the rest is all ones.
    """
    best = np.full((L, SKETCHES), _FULL) if held is None else held.copy()
    for start in range(0, len(x), BLOCK):
        part = x[start : start + BLOCK]
        values = np.multiply(part, _A[:, None], out=_room()[: SKETCHES * len(part)].reshape(SKETCHES, len(part)))
        for _ in range(min(L, len(part))):
            at = values.argmin(axis=1)
            low = values[_EVERY, at].astype(np.uint64) << _HALF | (at + first + start).astype(np.uint64)
            if not (low < best[-1]).any():
                break
            values[_EVERY, at] = _NONE
            for i in range(L):
                best[i], low = np.minimum(best[i], low), np.maximum(best[i], low)
    return best


def components(h: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """16 bits of the hash of each tuple, its k-mers in text order."""
    n = min(L, len(h))
    place = np.sort((chosen[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64), axis=0)
    out = np.full(SKETCHES, n, np.uint64)
    for d in range(n):
        out = mix64((out + h[place[d]]) * _G)
    return (out >> np.uint64(48)).astype(np.uint16)


class Read:
    """A text with its fingerprint; what its first half gives is kept for its edited form."""

    def __init__(self, text: str):
        self.text, self.hashes = text, kmers(text)
        self.shared = max(0, len(text) - len(text) // 2 - K + 1)  # k-mers within the half that an edit leaves
        x = elements(self.hashes)
        self.start = smallest(x[: self.shared])
        self.print = components(self.hashes, smallest(x[self.shared :], self.shared, self.start))

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        new = edit(self.text, other)
        h = kmers(new)
        n = min(self.shared, len(h))
        return new, components(h, smallest(elements(h)[n:], n, self.start))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edit(text: str, other: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _ranges(rows: DataFrame, order: list[str], parts: int) -> list[tuple]:
    """The smallest row of each of `parts` ranges of about equal size, in order; a row for each range."""
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    found = dealt.groupBy("_part").agg(F.min(F.struct(*order)).alias("m")).collect()
    discard(dealt)
    return sorted(tuple(r.m) for r in found)


def _placed(rows: DataFrame, bounds: list[tuple], order: list[str]) -> DataFrame:
    """Adds _range and _first: the range of a row, and whether it is the range's first. Bounds are looked up in two steps, by the first of every so many and then among those."""
    width = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    one = "struct<" + ",".join(f"{n}:{t}" for n, t in rows.select(*order).dtypes) + ">"
    table = rows.sparkSession.createDataFrame([([p[0] for p in parts], parts)], f"_heads array<{one}>, _parts array<array<{one}>>")  # one row
    upto = lambda array: F.size(F.filter(array, lambda x: x <= F.struct(*order)))
    met = rows.crossJoin(F.broadcast(table)).withColumn("_head", upto("_heads") - 1).withColumn("_at", upto(F.get("_parts", F.col("_head"))) - 1)
    met = met.withColumn("_first", F.get(F.get("_parts", F.col("_head")), F.col("_at")) == F.struct(*order)).withColumn("_range", F.col("_head") * width + F.col("_at"))
    return met.drop("_heads", "_parts", "_head", "_at")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without text, with n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    docs, back = shelter(docs, key, text)
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    order = ["_n", "_k", "_t", "_u"]
    place = {"_n": F.col(key).isNull().cast("int"), "_k": F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit(0).cast("long")), "_t": F.xxhash64(F.lit(1), text), "_u": F.xxhash64(F.lit(2), text)}
    ids = materialize(docs.select(*[c.alias(n) for n, c in place.items()]), "order")
    repeats = ids.groupBy(*order).count().where("count > 1").limit(1).count() > 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _ranges(ids, order, parts)
    discard(ids)
    many = max(1, len(bounds))
    marked = _placed(mark_repeats(docs, key, text, repeats).select(*docs.columns, "_again").withColumns(place), bounds, order)
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("kind"))
    ahead = F.struct(F.pmod(F.col("_range") - 1, F.lit(many)).cast("int").alias("range"), F.lit(1).alias("kind"))
    placed = marked.withColumn("_to", F.when(~F.col("_again") & F.col("_first"), F.array(own, ahead)).otherwise(F.array(own)))
    # a repeated row needs no neighbour, so those are dealt evenly
    placed = placed.select(*docs.columns, "_again", *order, F.explode("_to").alias("_to"))
    spread = F.when(F.col("_again"), F.pmod(F.monotonically_increasing_id(), F.lit(many)).cast("int")).otherwise(F.col("_to.range"))
    dealt = placed.repartitionById(many, spread).sortWithinPartitions("_again", "_to.range", "_to.kind", *order)
    kept = [c for c in docs.columns if c != text]
    made = [StructField("n_chars", LongType()), StructField("edited_sha256", StringType()), StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())]
    schema = StructType([*[docs.schema[c] for c in kept], *made])
    columns = [*kept, text, "_again", (F.col("_to.kind") == 1).alias("_follows")]

    def compare(batches):
        """Rows stand in order, the first row of the next range last; a row waits for the one after it."""
        waiting = None

        def judged(row, own: Read, then: Read):
            new, fresh = own.edited(then.text)
            hexed = [x.astype(">u2").tobytes().hex() for x in (own.print, fresh)]
            return row, (len(own.text), hashlib.sha256(new.encode()).hexdigest(), *hexed, likeness(own.print, fresh), likeness(own.print, then.print))

        for batch in batches:
            done, rows = [], batch.select(kept)
            for i, (body, repeat, follows) in enumerate(zip(*[batch.column(len(kept) + j).to_pylist() for j in range(3)])):
                read = Read(body)
                if waiting is not None:
                    done.append(judged(*waiting, read))
                    waiting = None
                if repeat:
                    done.append(judged(rows.slice(i, 1), read, read))
                elif not follows:
                    waiting = rows.slice(i, 1), read
            if done:
                head = pa.Table.from_batches([row for row, _ in done]).combine_chunks()
                new = [pa.array(v, t) for v, t in zip(zip(*[x for _, x in done]), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in head.columns], *new], names=schema.names)

    return back(dealt.select(*columns).mapInArrow(compare, schema), [f.name for f in made])
