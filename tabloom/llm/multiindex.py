"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own codebook (k-means on a bounded sample); a cell of the index is a pair of
centroids, and every vector is in one. A query ranks the centroids of both halves and walks the pairs in order of their
summed distance with a heap, until the cells seen hold its budget of entries; the entries are reranked by the exact
measure. The budget is calibrated: a bounded number of queries is searched by brute force, and the budget is what
brings the wanted share of their true neighbours into the cells walked.

The nearness is the inner product, so the distance of a centroid is its negated inner product with the query's half.
Of equal vectors only the k + 1 smallest ids can be in any answer, so the others stay out of the index.

Codebooks grow with the table, so that cells hold PER_CELL entries or so, up to MOST_CODES centroids a half: the sample
cannot place more, and what walks hold, a size for each cell, stays a few MB. Beyond that cells grow instead.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an
id; vectors of different lengths have no product, so each length is an index of its own; rows that share an id are not
each other's neighbours, and of query rows that share one the smallest vector is searched; ties go to the smaller id; a
query with fewer than k candidates gets all; an empty table or one without queries gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, sound

SAMPLE = 20_000
CALIBRATE = 64
RECALL = 0.93
#: Entries of a cell, and most centroids of a half.
PER_CELL, MOST_CODES = 16, 1024
#: Below this share of a block's products the visited ones are computed by themselves.
SPARSE = 0.15
BLOCK, QUERIES = 1024, 256
#: Blocks of entries that one rerank task holds.
GROUP = 32


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)


def walk(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, budget: float):
    """Cells (i, j) in order of d1[i] + d2[j], by a heap over the two sorted lists, until budget entries are seen."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1].tolist(), d2[o2].tolist()
    heap, seen, done = [(a[0] + b[0], 0, 0)], 0, [0] * (len(a) + 1)
    while heap and seen < budget:
        _, i, j = heapq.heappop(heap)
        yield int(o1[i]), int(o2[j])
        seen += sizes[o1[i], o2[j]]
        if j + 1 < len(b):  # the pair to the right, once the one above it is out
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def _vectors(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids, without those at -inf."""
    some = np.flatnonzero(score > -np.inf)
    if len(some) > k:
        cut = np.partition(score[some], len(some) - k)[len(some) - k]
        some = some[score[some] >= cut]
    return some[np.lexsort((ids[some], -score[some]))][:k]


class Index(NamedTuple):
    """entries: id, c1, c2, x; books: both codebooks; cells: entries by (c1, c2); budget: entries that a walk must see."""

    entries: DataFrame
    books: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray
    half: int
    budget: float

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(self.books, self.half, q)


def _distances(books, half: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return -(q[:half] @ books[0].T), -(q[half:] @ books[1].T) if len(q) > half else np.zeros(len(books[0]))


def build(own: DataFrame, queries: DataFrame, dim: int, k: int, recall: float = RECALL, seed: int = 8) -> Index:
    """The index of own (id, v; vectors of dim components), with a budget calibrated on some of queries (id, v)."""
    half = max(1, dim // 2)
    h1, h2 = F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")
    slim = own.select("id", "v", h1, h2, F.pmod(F.xxhash64("id"), F.lit(32)).alias("salt"))
    for by in (["h1", "h2", "salt"], ["h1", "h2"]):
        slim = slim.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("n") <= k + 1)
    sample = _vectors(r.v for r in own.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).select("v").toLocalIterator())
    size = int(min(MOST_CODES, max(2, 2 ** round(np.log2(max(4, slim.count() / PER_CELL)) / 2))))
    books = (codebook(sample[:, :half], size, seed), codebook(sample[:, half:], size, seed + 1))
    shared = own.sparkSession.sparkContext.broadcast(books)

    def assign(frames):
        for frame in frames:
            if len(frame):
                x = _vectors(frame["v"])
                yield pd.DataFrame({"id": frame["id"], "c1": nearest(x[:, :half], shared.value[0]), "c2": nearest(x[:, half:], shared.value[1]) if dim > half else 0, "x": [r.tobytes() for r in x]})

    entries = materialize(slim.select("id", "v").mapInPandas(assign, "id long, c1 int, c2 int, x binary"), "index")
    cells = np.zeros((size, size), np.int64)
    for r in entries.groupBy("c1", "c2").count().toLocalIterator():  # at most a row for each cell, MOST_CODES squared
        cells[r.c1, r.c2] = r["count"]
    index = Index(entries, books, cells, half, 0.0)
    return index._replace(budget=_calibrate(entries, queries, cells, index.distances, k, recall, seed))


def search(rows: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, seed: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query (a column over id) holds."""
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & sound("v")).withColumn("query", is_query)
    queries = own.where("query").groupBy("id").agg(F.min("v").alias("v"))
    lengths = sorted(r.d for r in queries.select(F.size("v").alias("d")).distinct().collect())  # lengths of vectors, few in any table
    found = [_search(own.where(F.size("v") == d).select("id", "v"), queries.where(F.size("v") == d), d, k, recall, seed) for d in lengths]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = reduce(lambda a, b: a.union(b), found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(own: DataFrame, queries: DataFrame, dim: int, k: int, recall: float, seed: int) -> DataFrame:
    """query_id, vec_id, score: the best of each block, k of a query or more in all."""
    spark = own.sparkSession
    index = build(own, queries, dim, k, recall, seed)
    cells, size = index.cells, len(index.cells)
    plan = spark.sparkContext.broadcast((index.books, cells, index.budget))
    half = index.half

    def visit(frames):
        books, sizes, budget = plan.value
        for frame in frames:
            out = []
            for q, v in zip(frame["id"], frame["v"]):
                v = np.asarray(v, np.float64)
                masks: dict[int, np.ndarray] = {}
                for i, j in walk(*_distances(books, half, v), sizes, budget):
                    if sizes[i, j]:
                        if i not in masks:
                            masks[i] = np.zeros(size, bool)
                        masks[i][j] = True
                out += [(q, i, np.packbits(m, bitorder="little").tobytes(), v.tobytes()) for i, m in masks.items()]
            yield pd.DataFrame(out, columns=["q", "c1", "mask", "x"])

    n_q = max(1, queries.count())
    parts = min(-(-n_q // 64), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_q // 4096)))  # walks cost time, not bytes
    visits = queries.repartition(parts, "id").mapInPandas(visit, "q long, c1 int, mask binary, x binary")
    visits = visits.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(-(-n_q // QUERIES))).cast("int"))

    def pack_queries(frame):
        return pd.DataFrame({"c1": [frame["c1"].iloc[0]], "qb": [frame["qb"].iloc[0]], "q": [frame["q"].to_numpy(np.int64).tobytes()], "mask": [b"".join(frame["mask"])], "qx": [b"".join(frame["x"])]})

    # entries of one first-half centroid are a block, or several
    per_row = cells.sum(axis=1)
    blocks_of = spark.createDataFrame([(i, max(1, -(-int(n) // BLOCK))) for i, n in enumerate(per_row)], "c1 int, blocks int")  # MOST_CODES rows
    n_groups = max(1, -(-int(np.maximum(1, -(-per_row // BLOCK)).sum()) // GROUP))

    def pack_entries(frame):
        return pd.DataFrame({"c1": [frame["c1"].iloc[0]], "block": [frame["block"].iloc[0]], "id": [frame["id"].to_numpy(np.int64).tobytes()], "c2": [frame["c2"].to_numpy(np.int64).tobytes()], "x": [b"".join(frame["x"])]})

    entries = index.entries.join(F.broadcast(blocks_of), "c1").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    entries = entries.groupBy("c1", "block").applyInPandas(pack_entries, "c1 int, block int, id binary, c2 binary, x binary")
    asked = visits.groupBy("c1", "qb").applyInPandas(pack_queries, "c1 int, qb int, q binary, mask binary, qx binary")
    met = entries.join(asked, "c1").withColumn("part", F.pmod(F.xxhash64("c1", "block"), F.lit(n_groups)).cast("int"))

    def rerank(frame):
        best: dict[int, list] = {}
        for r in frame.itertuples(index=False):
            ids, c2, x = np.frombuffer(r.id, np.int64), np.frombuffer(r.c2, np.int64), np.frombuffer(r.x, np.float64).reshape(-1, dim)
            q, qx = np.frombuffer(r.q, np.int64), np.frombuffer(r.qx, np.float64).reshape(-1, dim)
            seen = np.unpackbits(np.frombuffer(r.mask, np.uint8).reshape(len(q), -1), axis=1, bitorder="little")[:, c2].astype(bool)
            seen &= ids[None, :] != q[:, None]
            whole = qx @ x.T if seen.mean() > SPARSE else None
            for i, own_id in enumerate(q.tolist()):
                at = np.flatnonzero(seen[i])
                s = x[at] @ qx[i] if whole is None else whole[i, at]
                top = at[_top(s, ids[at], k)]
                if len(top):
                    kept = best.setdefault(own_id, [np.empty(0, np.int64), np.empty(0)])
                    kept[0], kept[1] = np.concatenate((kept[0], ids[top])), np.concatenate((kept[1], (x[top] * qx[i]).sum(axis=1)))
        out = []
        for q, (ids, s) in best.items():
            at = _top(s, ids, k)
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at], "score": s[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return materialize(met.groupBy("qb", "part").applyInPandas(rerank, "query_id long, vec_id long, score double"), "neighbours")


def _calibrate(index: DataFrame, queries: DataFrame, cells: np.ndarray, distances, k: int, recall: float, seed: int) -> float:
    """Entries that a walk must see so that `recall` of the true neighbours of a few queries lie in its cells.

    Never fewer than k + 1, one of which may be the query itself, so that a walk ends with k candidates or all there are.
    """
    asked = queries.select("id", "v").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(CALIBRATE).collect()
    if not asked:
        return 0.0
    ids, x = np.array([r.id for r in asked]), _vectors(r.v for r in asked)
    shared = index.sparkSession.sparkContext.broadcast((ids, x))

    def exact(frames):
        ids, x = shared.value
        for frame in frames:
            if not len(frame):
                continue
            own = frame["id"].to_numpy(np.int64)
            s = x @ np.frombuffer(b"".join(frame["x"]), np.float64).reshape(len(frame), -1).T
            for i, q in enumerate(ids):
                s[i, own == q] = -np.inf
                at = _top(s[i], own, k)
                yield pd.DataFrame({"q": i, "s": s[i, at], "id": own[at], "c1": frame["c1"].to_numpy()[at], "c2": frame["c2"].to_numpy()[at]})

    true = index.mapInPandas(exact, "q int, s double, id long, c1 int, c2 int").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))).where(F.col("n") <= k)
    need, order = [], {}
    for r in true.collect():  # CALIBRATE x k rows
        if r.q not in order:
            seen, at = 0, {}
            for i, j in walk(*distances(x[r.q]), cells, float("inf")):
                at[i, j] = seen
                seen += cells[i, j]
            order[r.q] = at
        need.append(order[r.q][r.c1, r.c2] + 1)
    return max(float(np.quantile(need, recall, method="higher")) if need else 0.0, k + 1.0)
