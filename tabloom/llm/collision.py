"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random lines. Two vectors at distance d differ by N(0, d squared) on each line, so a
pair at the cosine threshold falls into each other's window of `WIDTH` deviations with a known probability, and the
count that such a pair reaches but for a millionth of cases follows from the binomial law. Vectors of a label are
sorted by their first projection into cells; cells that lie within a window that no linked pair leaves are paired as
packed blocks, collisions of a block's pairs are counted on all lines, and pairs that reach the count are verified by
cosine in double precision. A block pair hands on, for each vector, the number of its links and one link to the
smallest vector it hangs together with there, so a dense group costs rows in proportion to its vectors.

Equal vectors stand in once, with their number. Labels are compared within themselves only, as are lengths of vectors.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows without a label or id, link
with nothing (a row without an id has no component and is not kept); repeated ids are vectors of their own and share
a component id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, small_batches, sound, with_first
from .graph import components, forest

THRESHOLD = 0.93
LINES = 32
#: Half a window, in deviations of a pair at the threshold.
WIDTH = 2.0
#: The same for the sorting line, where a linked pair must not be missed.
SAFE = 5.5
MISS = 1e-6
CELL = 1024


def least_count(lines: int = LINES, width: float = WIDTH, miss: float = MISS) -> int:
    """Collisions that a pair at the threshold reaches with probability 1 - miss."""
    p, below = erf(width / sqrt(2)), 0.0
    for t in range(lines + 1):
        below += comb(lines, t) * p**t * (1 - p) ** (lines - t)
        if below > miss:
            return t
    return 0


def project(rows: DataFrame, vector: str, lines: int, seed: int) -> DataFrame:
    """Adds p0 (sorting line) and the packed unit vector and its projections."""

    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            unit, proj = [], []
            for v in frame[vector]:
                x = np.asarray(v, np.float64)
                unit.append(x / np.sqrt(x @ x))
            for dim in sorted({len(x) for x in unit}):
                at = [i for i, x in enumerate(unit) if len(x) == dim]
                u = np.stack([unit[i] for i in at])
                a = np.random.default_rng([seed, dim]).standard_normal((dim, lines))
                p = (u @ a).astype(np.float32)
                out = frame.iloc[at].drop(columns=vector)
                yield out.assign(dim=dim, p0=p[:, 0].astype(float), unit=[x.tobytes() for x in np.stack([np.asarray(frame[vector].iloc[i], np.float64) for i in at])], proj=[x.tobytes() for x in p])

    return rows.mapInPandas(run, "rep long, label string, copies long, dim int, p0 double, unit binary, proj binary")


def links(rows: DataFrame, vector: str, threshold: float = THRESHOLD, lines: int = LINES, seed: int = 2) -> DataFrame:
    """rows: rep, label, copies and the vector. (rep, other, n): n rows link with rep in one block pair, other among them or theirs."""
    spark = rows.sparkSession
    apart = sqrt(2 - 2 * threshold)
    bin_width, window, count = SAFE * apart / 4, np.float32(WIDTH * apart), least_count(lines)
    own = materialize(project(rows.select("rep", "label", "copies", vector), vector, lines, seed).withColumn("bin", F.floor(F.col("p0") / bin_width).cast("int")), "projections")
    sizes = own.groupBy("label", "dim", "bin").agg(F.count("*").alias("n"))
    own = own.join(sizes, ["label", "dim", "bin"]).withColumn("cell", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / CELL)).cast("int"))

    def pack(frame):
        frame = frame.sort_values("rep")
        h = frame.iloc[0]
        return pd.DataFrame({"label": [h["label"]], "dim": [h["dim"]], "bin": [h["bin"]], "cell": [h["cell"]], "rep": [frame["rep"].to_numpy(np.int64).tobytes()], "copies": [frame["copies"].to_numpy(np.int64).tobytes()], "unit": [b"".join(frame["unit"])], "proj": [b"".join(frame["proj"])]})

    cells = own.groupBy("label", "dim", "bin", "cell").applyInPandas(pack, "label string, dim int, bin int, cell int, rep binary, copies binary, unit binary, proj binary")
    cells = materialize(cells, "cells")
    left = cells.withColumn("step", F.explode(F.array(*map(F.lit, range(5))))).select("label", "dim", (F.col("bin") + F.col("step")).alias("bin"), "step", F.col("cell").alias("cell_a"), *[F.col(c).alias(f"{c}_a") for c in ("rep", "copies", "unit", "proj")])
    pairs = left.join(cells, ["label", "dim", "bin"]).where("step > 0 or cell_a <= cell").withColumn("same", F.expr("step = 0 and cell_a = cell"))
    pairs = pairs.repartition(F.xxhash64("label", "bin", "step", "cell_a", "cell"))

    def count_pairs(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids = [np.frombuffer(x, np.int64) for x in (r.rep_a, r.rep)]
                copies = [np.frombuffer(x, np.int64) for x in (r.copies_a, r.copies)]
                p, q = (np.frombuffer(x, np.float32).reshape(-1, lines).T.copy() for x in (r.proj_a, r.proj))
                hits = np.zeros((len(ids[0]), len(ids[1])), np.uint8)
                for a, b in zip(p, q):
                    hits += np.abs(a[:, None] - b[None, :]) <= window
                i, j = np.nonzero(hits >= count)
                if r.same:
                    i, j = i[i < j], j[i < j]
                u, v = (np.frombuffer(x, np.float64).reshape(-1, r.dim) for x in (r.unit_a, r.unit))
                nu, nv = np.sqrt((u * u).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
                good = np.zeros(len(i), bool)
                for at in range(0, len(i), 1 << 17):
                    s = slice(at, at + (1 << 17))
                    good[s] = np.einsum("ij,ij->i", u[i[s]], v[j[s]]) / (nu[i[s]] * nv[j[s]]) >= threshold
                i, j = i[good], j[good]
                if not len(i):
                    continue
                if r.same:
                    every, number = ids[0], np.bincount(i, copies[1][j], len(ids[0])) + np.bincount(j, copies[0][i], len(ids[0]))
                else:
                    every = np.concatenate(ids)
                    number = np.concatenate((np.bincount(i, copies[1][j], len(ids[0])), np.bincount(j, copies[0][i], len(ids[1]))))
                    j = j + len(ids[0])
                order = np.argsort(every, kind="stable")
                place = np.empty(len(every), np.int64)
                place[order] = np.arange(len(every))
                root = every[order][forest(place[i], place[j], len(every))][place]
                on = np.flatnonzero(number)
                yield pd.DataFrame({"rep": every[on], "other": root[on], "n": number[on].astype(np.int64)})

    with small_batches(spark):
        return materialize(pairs.mapInPandas(count_pairs, "rep long, other long, n long"), "links")


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """key, n_links, component_id and kept of every row."""
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    on = sound("vector") & F.col("label").isNotNull() & F.col("key").isNotNull()
    own = own.withColumn("h1", F.xxhash64(F.lit(1), "vector")).withColumn("h2", F.xxhash64(F.lit(2), "vector"))
    linked = materialize(with_first(own.where(on), ["label", "h1", "h2"], "key", "rep"), "vectors")
    heads = linked.groupBy("rep", "label").agg(F.count("*").alias("copies"), F.any_value("vector").alias("vector")).withColumn("label", F.col("label").cast("string"))
    found = links(heads, "vector", threshold)
    comp = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    per = heads.select("rep", "copies").join(found.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    per = per.select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = linked.select("key", "rep").join(per, "rep").select("key", "n_links", "component_id")
    out = out.unionByName(own.where(~on).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
