"""Connected components by alternating stars, every round a job over edges in the shared folder.

No more than FEW edges, which is a few MB, are joined in one task instead: rounds of jobs over them would be nothing but overhead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


FEW = 200_000


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that hangs together with each of n, over links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _whole(frames):
    edges = pd.concat(list(frames) or [pd.DataFrame({"u": [], "v": []})])
    nodes, at = np.unique(edges[["u", "v"]].to_numpy(np.int64).T, return_inverse=True)
    i, j = at.reshape(2, -1)
    yield pd.DataFrame({"node": nodes, "component": nodes[forest(i, j, len(nodes))]})


def _mark(edges: DataFrame):
    """Changes with the set of edges."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges (a, b) of longs -> (node, component): the smallest node reachable. Nodes without edges are absent.

    Large-star and small-star rounds keep the number of edges within the first one's; a node's neighbours are only
    aggregated to their minimum, never gathered.
    """
    cur = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    seen = _mark(cur)
    if seen[0] <= FEW:
        return cur.coalesce(1).mapInPandas(_whole, "node long, component long")
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "edges")
        mark = _mark(new)
        discard(cur)
        cur = new
        if mark == seen:
            break
        seen = mark
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
