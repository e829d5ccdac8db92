r"""Exact k-means over integer vectors: screened in float32, settled in integers.

Each component x of a kept vector becomes floor(1024 * x). A batch of vectors meets the centroids in one float32 matrix product,
which gives s = |c|^2 - 2 v.c for each pair, the squared distance but for |v|^2. With n components, unit roundoff u = 2^-24 and
g = (n + 4) u / (1 - (n + 4) u), a float32 product of n-vectors, whatever its order of summation and with its inputs rounded to
float32, is off by at most g |v|.|c|, so s lies within e = 2 g |v| |c| + g |c|^2 of what is computed (Cauchy-Schwarz; norms in double,
rounded up by a millionth). Centroids whose interval [s - e, s + e] reaches below every upper end are the shortlist. Where
it has more than one, their distances are computed in exact integers and the smallest number wins ties. So the assignment is
exactly that of integer arithmetic, and no vector is assigned by a rounded value.

Rounds are jobs that send a row of exact sums for each task and centroid; only the centroids (k rows) reach the driver. Sums are
kept in limbs of 48 bits, so that components of any size add up exactly.

Defined cases: a vector that is null, has another number of components than `dim`, or holds null or non-finite ones takes no part and
has no row; with fewer vectors than k there are as many centroids; equal hashes of seeds (repeated ids) are ordered by the vector; a null id
hashes as the empty text; repeated vectors count as often as they stand there; distances and sums that no long can hold are null; an empty
table gives an empty result; extra columns pass through, and where they clash the new columns get leading underscores.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shelter

#: Components of a vector, centroids, rounds, what a component is multiplied by, and the seed of the first centroids.
DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Components up to here are handled as 64-bit integers; beyond, as Python's integers.
NARROW = 1 << 22
#: Bits of a limb of a sum.
LIMB = 48


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) for doubles: int64 where all are narrow, else Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * SCALE)
    if not y.size or np.abs(y).max() <= NARROW:
        return y.astype(np.int64)
    return np.array([int(v) * SCALE if abs(v) > 2**53 else int(np.floor(v * SCALE)) for v in x.reshape(-1).tolist()], dtype=object).reshape(x.shape)


def screen(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids may be the nearest: bool, a row for each vector. Integers of any size come as doubles or Python's integers."""
    v64, c64 = v.astype(np.float64), c.astype(np.float64)
    n = v.shape[1] + 4
    g = n * 2.0**-24 / (1 - n * 2.0**-24)
    with np.errstate(over="ignore", invalid="ignore"):
        s = (v.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
        squares = (c64 * c64).sum(axis=1)
        s = squares - 2 * s
        nv, nc = np.sqrt((v64 * v64).sum(axis=1)) * 1.000001, np.sqrt(squares) * 1.000001
        e = (2 * g * nv[:, None] * nc + g * squares * 1.000001) + np.abs(s) * 2.0**-40
        upper = (s + e).min(axis=1)
        maybe = s - e <= upper[:, None]
    return maybe | ~np.isfinite(s).all(axis=1)[:, None]  # what float32 cannot hold is settled in integers


def assign(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (ties: the smaller number), and the exact squared distance."""
    if v.dtype != c.dtype:
        v, c = v.astype(object), c.astype(object)
    maybe = screen(v, c)
    nearest = maybe.argmax(axis=1)
    best = ((v - c[nearest]) ** 2).sum(axis=1)
    open_ = np.flatnonzero(maybe.sum(axis=1) > 1)
    for j in range(len(c)):
        at = open_[maybe[open_, j] & (nearest[open_] != j)]
        d = ((v[at] - c[j]) ** 2).sum(axis=1)
        nearer = (d < best[at]).astype(bool)  # numbers ascend, so an equal distance leaves the smaller one
        best[at[nearer]], nearest[at[nearer]] = d[nearer], j
    return nearest, best


def _components(column: pa.Array, dim: int) -> np.ndarray:
    return integers(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), dim))


def _limbs(x: int) -> list[int]:
    """Digits of an integer in base 2**LIMB: all but the last are not negative."""
    out = []
    while not -(1 << LIMB) < x < 1 << LIMB:
        out.append(x & ((1 << LIMB) - 1))
        x >>= LIMB
    return [*out, x]


SUMS = "cluster int, at int, limb int, part decimal(38,0)"


def _sums(batches, c: np.ndarray):
    """Exact sums of the components of each cluster (at 0 on), their number (-1) and the distances (-2), in limbs."""
    k, dim = c.shape
    total = np.zeros((k, dim + 2), dtype=object)
    for batch in batches:
        v = _components(batch.column(0), dim)
        if len(v):
            nearest, best = assign(v, c)
            for j in np.unique(nearest):
                own = nearest == j
                total[j, :dim] += v[own].sum(axis=0).astype(object)
                total[j, dim] += int(own.sum())
                total[j, dim + 1] += sum(best[own].tolist())
    rows = [(j, i if i < dim else dim - 1 - i, limb, Decimal(x)) for j in range(k) for i in range(dim + 2) if total[j, i] for limb, x in enumerate(_limbs(int(total[j, i])))]
    columns = list(zip(*rows)) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0)))], names=["cluster", "at", "limb", "part"])


def _measured(vectors: DataFrame, c: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Sums, counts and summed distances of the clusters around c: k x (dim + 2) numbers in all."""
    k, dim = c.shape
    parts = vectors.mapInArrow(lambda b: _sums(b, c), SUMS).groupBy("cluster", "at", "limb").agg(F.sum("part").alias("part")).collect()
    total = np.zeros((k, dim + 2), dtype=object)
    for r in parts:
        total[r.cluster, r["at"] if r["at"] >= 0 else dim - 1 - r["at"]] += int(r.part) << (LIMB * r.limb)
    return total[:, :dim], total[:, dim].tolist(), total[:, dim + 1].tolist()


def _shaped(rows: list) -> np.ndarray:
    """Centroids as int64 if all components are narrow."""
    wide = any(abs(x) > NARROW for r in rows for x in r)
    return np.array(rows, dtype=object if wide else np.int64)


def kept(vector: str, dim: int) -> F.Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine, F.lit(False))


def fit(vectors: DataFrame, key: str, vector: str, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> tuple[np.ndarray, list[int]]:
    """Centroids after the rounds, and the summed distance of each one's vectors. The table is read rounds + 2 times."""
    own = vectors.where(kept(vector, dim))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    first = own.select(name.alias("_h"), F.col(vector).alias("_v")).orderBy("_h", "_v").limit(k).collect()
    c = _shaped([integers(np.array(r._v, dtype=np.float64)).tolist() for r in first])
    if not first:
        return np.zeros((0, dim), np.int64), []
    for _ in range(rounds):
        sums, counts, _ = _measured(own.select(vector), c)
        c = _shaped([[int(x) // n for x in s] if n else old for s, n, old in zip(sums, counts, c.tolist())])
    return c, _measured(own.select(vector), c)[2]


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """The kept vectors with cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

    vectors, back = shelter(vectors, key, vector)
    c, inertia = fit(vectors, key, vector, k, rounds, dim, seed)
    fits = lambda x: x if -(1 << 63) <= x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    own, whole = [fits(x) for x in inertia], fits(sum(inertia))
    made = [StructField("cluster", IntegerType()), StructField("distance", LongType()), StructField("cluster_inertia", LongType()), StructField("inertia", LongType()), StructField("centroid_sha256", StringType())]
    schema, at = StructType([*vectors.schema.fields, *made]), vectors.columns.index(vector)

    def label(batches):
        for batch in batches:
            if batch.num_rows:
                nearest, best = assign(_components(batch.column(at), dim), c)
                near, far = nearest.tolist(), [fits(int(x)) for x in best.tolist()]
                new = [pa.array(near, pa.int32()), pa.array(far, pa.int64()), pa.array([own[j] for j in near], pa.int64()), pa.array([whole] * len(near), pa.int64()), pa.array([digest[j] for j in near], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return back(vectors.where(kept(vector, dim)).mapInArrow(label, schema), [f.name for f in made])
