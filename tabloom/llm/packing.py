"""Best-fit packing by the linear grouping scheme.

Documents become token ids; only those longer than a sequence are cut, their first piece taking the remainder.
Pieces are counted by length, so that what is solved never grows beyond `seq_len` sizes:

1. large pieces, sorted by length, form groups of equal cardinality, each rounded up to its longest member;
2. the few rounded sizes are packed by configurations (multisets that fit a sequence): the configuration linear
   programme is solved by column generation with a knapsack pricing step, rounded down, and its remainder is packed
   first-fit-decreasing over configurations;
3. actual pieces take the places of the rounded ones, group by group in length order;
4. small pieces go best-fit, longest first, into the smallest gap that holds them, new sequences opening last.

The plan is a table of runs: so many pieces of a length, ranks a to b, lie in sequences c, c+1, ... at one offset.
Pieces are ranked within their length (hash parts are ranked by themselves and shifted) and look their place up.

Defined cases: a null text packs as the empty one (the end token alone); equal texts are separate pieces; an empty
table gives an empty result; texts of any length are tokenised whole; extra columns of docs pass through `pieces`.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bound_batches, free_name, materialize, shelter

SEQ_LEN = 2048
#: Lengths from this part of a sequence upwards are large.
LARGE = 1 / 8
#: Groups of equal cardinality that large lengths are rounded up within.
GROUPS = 100
#: Hash parts of a length, so that a hot length is never in one task.
PARTS = 64
#: Special strings of the default tokenizer and their ids, which it gives wherever a text holds them.
SPECIALS = {"<|endoftext|>": 50256}
#: Entries that a worker keeps of its text-fragment cache, about 40 MB.
CACHE = 200_000


class FragmentIds(dict):
    """Token ids (little-endian unsigned 32-bit) of text fragments that start at a lone space.

    The vocabulary's pattern never lets a token cross from a non-space into a lone space, so a text's ids are its
    fragments' ids in order; most fragments are frequent words, which are looked up instead of merged again.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("fragments", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, fragment: str) -> bytes:
        ids = np.array(self.encode(fragment), "<u4").tobytes()
        if len(self) < CACHE:
            self[fragment] = ids
        return ids

    def text_ids(self, text: str) -> bytes:
        import re

        first, *rest = text.split(" ") if not re.search(r"\s\s", text) else re.split(r"(?<=\S) (?=\S)", text)
        head = self[first] if first else b""
        return head + b"".join(map(self.__getitem__, [" " + x for x in rest]))

    def with_specials(self, text: str, specials: dict[str, int]) -> bytes:
        """Ids of a text whose special strings are tokens of their own; what lies between them is tokenised by itself."""
        import re

        if not any(s in text for s in specials):
            return self.text_ids(text)
        parts = re.split("(" + "|".join(map(re.escape, specials)) + ")", text)
        return b"".join(specials[x].to_bytes(4, "little") if i % 2 else self.text_ids(x) for i, x in enumerate(parts))


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tokenize(docs: DataFrame, text: str = "text", seq_len: int = SEQ_LEN, end_id: int = 0, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """Explodes docs into pieces: piece, start, length, ids (binary, little-endian u32), ids_crc32; text is dropped.

    tokenizer: path of a byte-pair rank file and its pattern, which knows no special strings; the path must exist on every
    executor. The default one has SPECIALS.
    """
    keep = [c for c in docs.columns if c != text]
    made = free_name(docs, "piece", "start", "length", "ids", "ids_crc32")
    how, specials = tokenizer, {} if tokenizer else SPECIALS
    end = int(end_id).to_bytes(4, "little")
    from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

    schema = StructType([docs.schema[c] for c in keep] + [StructField(n, t()) for n, t in zip(made, (IntegerType, LongType, LongType, BinaryType, LongType))])

    def cut(batches):
        import pyarrow as pa

        fragments = FragmentIds(*(how or default_tokenizer()))
        for batch in batches:
            texts, at, rows = batch.column(batch.schema.get_field_index(text)), [], []
            for i in range(batch.num_rows):
                ids = fragments.with_specials(texts[i].as_py() or "", specials) + end
                n = len(ids) // 4
                start, stop = 0, n % seq_len or min(n, seq_len)
                piece = 0
                while start < n:
                    part = ids[4 * start : 4 * stop]
                    at.append(i)
                    rows.append((piece, start, stop - start, part, zlib.crc32(part)))
                    start, stop, piece = stop, stop + seq_len, piece + 1
            old = batch.select(keep).take(pa.array(at, pa.int64()))
            new = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*old.columns, *new], names=[*keep, *made])

    return docs.mapInArrow(cut, schema)


def configurations(sizes: list[int], counts: list[int], cap: int) -> list[tuple[dict[int, int], int]]:
    """Packs counts[i] pieces of sizes[i] (distinct) into sequences of cap: [(pattern {i: multiplicity}, times)]."""
    m = len(sizes)
    if not m:
        return []
    w, d = np.array(sizes), np.array(counts, float)
    cols = [np.eye(m)[i] * (cap // w[i]) for i in range(m)]
    basis = list(range(m))
    inv = np.diag([1.0 / (cap // x) for x in w])
    x = inv @ d
    for it in range(60 * m):
        price = inv.sum(axis=0)
        best, pick = np.zeros(cap + 1), np.full(cap + 1, -1)
        for i in np.flatnonzero(price > 1e-12):  # unbounded knapsack, a size at a time
            for _ in range(cap // int(w[i])):
                more = best[: -w[i]] + price[i]
                up = np.flatnonzero(more > best[w[i] :] + 1e-12)
                if not len(up):
                    break
                best[up + w[i]], pick[up + w[i]] = more[up], i
        col, c = np.zeros(m), cap
        while pick[c] >= 0:
            col[pick[c]] += 1
            c -= int(w[pick[c]])
        if price @ col <= 1 + 1e-4:
            break
        step = inv @ col
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        cols.append(col)
        basis[out] = len(cols) - 1
        pivot = inv[out] / step[out]
        inv -= np.outer(step, pivot)
        inv[out] = pivot
        x = inv @ d if it % 20 == 0 else x - step * ratio[out]
        x[out] = ratio[out]
        np.maximum(x, 0, out=x)
    left, plan = np.array(counts, np.int64), []
    for k in np.argsort(-x):
        col = cols[basis[k]].astype(np.int64)
        times = int(min([np.floor(x[k] + 1e-9), *(left[col > 0] // col[col > 0])])) if col.any() else 0
        if times > 0:
            left -= times * col
            plan.append(({int(i): int(col[i]) for i in np.flatnonzero(col)}, times))
    order = np.argsort(-w)
    while left.any():  # the remainder, fewer sequences than sizes: fullest configuration first, by largest
        room, col = cap, np.zeros(m, np.int64)
        for i in order:
            n = min(int(left[i]), room // int(w[i]))
            col[i], room = n, room - n * int(w[i])
        times = int(min(left[col > 0] // col[col > 0]))
        left -= times * col
        plan.append(({int(i): int(col[i]) for i in np.flatnonzero(col)}, times))
    return plan


def plan_runs(hist: dict[int, int], cap: int, groups: int = GROUPS, large: float = LARGE) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) that pack all pieces of the histogram, one per sequence."""
    runs, rank = [], defaultdict(int)
    seq = 0

    def put(length, n, first, offset):
        runs.append((length, rank[length], n, first, offset))
        rank[length] += n

    if hist.get(cap):
        put(cap, hist[cap], 0, 0)
        seq = hist[cap]
    small = {x: n for x, n in hist.items() if n and x < max(1, int(cap * large))}
    big = sorted((x, n) for x, n in hist.items() if n and x < cap and x not in small)
    total = sum(n for _, n in big)
    # groups of equal cardinality: sizes is each group's longest, members its lengths in order
    members: list[list[list[int]]] = []
    size_of: list[int] = []
    each, room = -(-total // groups) if total else 1, 0
    for x, n in big:
        while n:
            if room == 0:
                members.append([])
                size_of.append(0)
                room = each
            k = min(n, room)
            members[-1].append([x, k])
            size_of[-1] = x
            n, room = n - k, room - k
    merged: dict[int, list[list[int]]] = {}
    for x, own in zip(size_of, members):
        merged.setdefault(x, []).extend(own)
    sizes = sorted(merged)
    plan = configurations(sizes, [sum(n for _, n in merged[x]) for x in sizes], cap)
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> [first sequence, sequences]
    queue = {x: [list(p) for p in reversed(merged[x])] for x in sizes}
    for pattern, times in plan:
        slots = [sizes[i] for i, n in sorted(pattern.items(), reverse=True) for _ in range(n)]
        while times:  # as many sequences as the same actual lengths can fill
            need: dict[tuple[int, int], int] = defaultdict(int)
            chosen, ahead = [], {x: [list(p) for p in queue[x][-len(slots) :]] for x in set(slots)}
            for x in slots:
                own = ahead[x]
                chosen.append((x, own[-1][0]))
                need[x, own[-1][0]] += 1
                own[-1][1] -= 1
                if not own[-1][1]:
                    own.pop()
            n = times
            for (x, length), k in need.items():
                have = next(p[1] for p in reversed(queue[x]) if p[0] == length)
                n = min(n, max(1, have // k))
            used: dict[int, int] = defaultdict(int)
            for x, length in chosen:
                put(length, n, seq, used[0])
                used[0] += length
                p = next(p for p in reversed(queue[x]) if p[0] == length)
                p[1] -= n
                if not p[1]:
                    queue[x].remove(p)
            if used[0] < cap:
                gaps[cap - used[0]].append([seq, n])
            seq, times = seq + n, times - n
    free = sorted(gaps)
    import bisect

    for length in sorted(small, reverse=True):
        n = small[length]
        while n:
            k = bisect.bisect_left(free, length)
            if k == len(free):  # new sequences, filled with this length
                per = cap // length
                new = max(1, n // per)
                fill = min(per, n)
                for j in range(fill):
                    put(length, new, seq, j * length)
                n -= new * fill
                gap = cap - fill * length
                if gap:
                    if gap not in gaps or not gaps[gap]:
                        bisect.insort(free, gap)
                    gaps[gap].append([seq, new])
                seq += new
                continue
            gap = free[k]
            first, have = gaps[gap].pop()
            per = gap // length
            if n >= per:
                take, fill = min(have, n // per), per
            else:
                take, fill = 1, n
            for j in range(fill):
                put(length, take, first, cap - gap + j * length)
            n -= take * fill
            if take < have:
                gaps[gap].append([first + take, have - take])
            if not gaps[gap]:
                free.pop(k)
            rest = gap - fill * length
            if rest:
                if not gaps[rest]:
                    bisect.insort(free, rest)
                gaps[rest].append([first, take])
    return runs


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", seq_len: int = SEQ_LEN, tokenizer=None, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents (see tokenize) with sequence_id and offset; sequences hold at most seq_len tokens.

    Without keep_ids the ids themselves are left out, and not written in between either.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs, back = shelter(docs, key, text)
    piece, start, length, ids, crc = free_name(docs, "piece", "start", "length", "ids", "ids_crc32")
    seq_id, offset = free_name(docs, "sequence_id", "offset")
    pieces = tokenize(docs, text, seq_len, tokenizer=tokenizer).withColumn("_part", F.pmod(F.xxhash64(key, piece, crc), F.lit(PARTS)).cast("int"))
    pieces = materialize(pieces if keep_ids else pieces.drop(ids), "pack-pieces")
    parts = pieces.groupBy(length, "_part").agg(F.count("*").alias("n")).toPandas()  # at most seq_len x PARTS rows
    hist = {int(k): int(v) for k, v in parts.groupby(length)["n"].sum().items()}
    runs = pd.DataFrame(plan_runs(hist, seq_len), columns=["length", "rank", "n", "seq", "offset"])
    parts = parts.sort_values([length, "_part"])
    parts["before"] = parts.groupby(length)["n"].cumsum() - parts["n"]
    where = []  # a part's own runs only: it needs those that its ranks meet
    by_length = {k: g.sort_values("rank").to_numpy() for k, g in runs.groupby("length")}
    for size, part, n, before in parts[[length, "_part", "n", "before"]].itertuples(index=False):
        g = by_length[size]
        lo, hi = np.searchsorted(g[:, 1], before, "right") - 1, np.searchsorted(g[:, 1], before + n, "left")
        where.append((int(size), int(part), int(before), [(int(r[1]), int(r[3]), int(r[4])) for r in g[lo:hi]]))
    places = spark.createDataFrame(where, f"`{length}` long, _part int, _before long, _runs array<struct<rank:long,seq:long,offset:long>>")
    rank = F.row_number().over(Window.partitionBy(length, "_part").orderBy(F.xxhash64(key, piece, crc), key, piece)) - 1
    # pieces already lie by length and part, so the places, a row for each, are sent there
    out = pieces.withColumn("_own", rank).join(places.hint("merge"), [length, "_part"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    run = F.element_at(F.filter("_runs", lambda r: r["rank"] <= F.col("_rank")), -1)
    out = out.withColumn("_run", run).withColumn(seq_id, F.col("_run.seq") + F.col("_rank") - F.col("_run.rank")).withColumn(offset, F.col("_run.offset"))
    return back(out, [piece, start, length, *([ids] if keep_ids else []), crc, seq_id, offset])
