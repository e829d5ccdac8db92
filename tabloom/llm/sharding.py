"""Minimum-cost-flow resharding.

Rows lie in old shards; new shards have byte capacities. A transport problem (old shards supply, new shards
demand; a byte that stays costs nothing, a byte that moves costs one, or what a cost matrix says) is solved by
successive shortest paths on a network with one node per shard. The flows are carried out as block transfers:
within an old shard rows are ordered by a hash, and contiguous hash ranges go to the targets. Large rows are placed
first and the flow is solved again for the smaller ones over what capacity is left, so the capacities are met to
within a fraction of the smallest rows. The result is a routing table of a few hash ranges for each old shard; rows
are routed on the map side and written once, grouped by shard; shards that nothing leaves or enters stay as they are.

Defined cases: a null text counts 0 bytes; a null key is hashed as such; equal rows (same key and text) share a
hash and may be split only as one; an empty table gives an empty result; extra columns pass through under any names, and where
they clash the operator's own columns get leading underscores.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_name, fresh_path, materialize, shelter

#: Bytes that a row takes besides its text.
OVERHEAD = 16
#: Rows of at least so many bytes are placed in this order, each tier over what capacity the earlier ones left.
TIERS = (8192, 2048, 512, 0)
#: log2 of the number of hash blocks for an old shard and tier.
BLOCK_BITS = 10


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int], cost=lambda i, j: int(i != j), limit=None) -> dict[tuple[int, int], int]:
    """Flow (old, new) -> bytes of least total cost; limit: most bytes on an arc (old, new), if any.

    Successive shortest paths over residual arcs; the number of nodes is the number of shards, never of rows.
    """
    olds, news = sorted(supply), sorted(capacity)
    source, sink = ("s", 0), ("t", 0)
    arcs: dict = {}

    def arc(a, b, cap, price):
        arcs.setdefault(a, {})[b] = [cap, price]
        arcs.setdefault(b, {}).setdefault(a, [0, -price])

    for i in olds:
        arc(source, ("o", i), supply[i], 0)
        for j in news:
            most = supply[i] if limit is None else min(supply[i], limit.get((i, j), 0))
            if most > 0:
                arc(("o", i), ("n", j), most, cost(i, j))
    for j in news:
        arc(("n", j), sink, capacity[j], 0)
    while True:
        far, via, queue, queued = {source: 0}, {}, deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for b, (cap, price) in arcs.get(a, {}).items():
                if cap > 0 and far[a] + price < far.get(b, float("inf")):
                    far[b], via[b] = far[a] + price, a
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if sink not in via:
            break
        path, b = [], sink
        while b != source:
            path.append((via[b], b))
            b = via[b]
        push = min(arcs[a][b][0] for a, b in path)
        for a, b in path:
            arcs[a][b][0] -= push
            arcs[b][a][0] += push
    return {(i, j): arcs[("n", j)][("o", i)][0] for i in olds for j in news if ("o", i) in arcs.get(("n", j), {}) and arcs[("n", j)][("o", i)][0] > 0}


def near_equal(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def _routing(spark, routes: dict[tuple[int, int], list[tuple[int | None, int]]]) -> DataFrame:
    """(old, tier) -> [(hash below which, new shard)]; at most one row for each old shard and tier."""
    rows = [(old, tier, [(2**63 - 1 if t is None else t, j) for t, j in cuts]) for (old, tier), cuts in routes.items()]
    return spark.createDataFrame(rows, "_old int, _tier int, _cuts array<struct<below:long,shard:int>>")


def _route(df: DataFrame, routing: DataFrame) -> DataFrame:
    """Adds _shard; the routing table has a row for each old shard and tier, so it is broadcast."""
    found = F.element_at(F.filter("_cuts", lambda c: (F.col("_h") < c["below"]) | (c["below"] == 2**63 - 1)), 1)["shard"]
    return df.join(F.broadcast(routing), ["_old", "_tier"]).withColumn("_shard", found).drop("_cuts")


def plan_transfers(rows: DataFrame, capacities: dict[int, int]) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """rows: _old, _tier, _h, _size. Returns the routing table and the bytes of each (old, new) transfer."""
    spark = rows.sparkSession
    blocks = {(r._old, r._tier, r.blk): r.bytes for r in rows.groupBy("_old", "_tier", F.shiftright("_h", 64 - BLOCK_BITS).cast("int").alias("blk")).agg(F.sum("_size").alias("bytes")).collect()}  # at most shards x tiers x blocks
    supply: dict[int, int] = {}
    for (old, _, _), n in blocks.items():
        supply[old] = supply.get(old, 0) + n
    room = dict(capacities)
    if sum(supply.values()) > sum(room.values()):
        raise ValueError("the new shards cannot hold the old ones")
    quota = min_cost_flow(supply, room)
    routes: dict = {}
    moved: dict = {}
    tiers = sorted({tier for _, tier, _ in blocks})
    for tier in tiers:
        have: dict[int, int] = {}
        for (old, t, _), n in blocks.items():
            if t == tier:
                have[old] = have.get(old, 0) + n
        flow = min_cost_flow(have, room, limit=None if tier == tiers[-1] else quota)
        left = {i: n - sum(f for (o, _), f in flow.items() if o == i) for i, n in have.items()}
        for i, n in left.items():  # what rounding left without room goes where most is free
            if n > 0 or not any(o == i for o, _ in flow):
                j = max(room, key=lambda j: (room[j] - sum(f for (_, t), f in flow.items() if t == j), -j))
                flow[i, j] = flow.get((i, j), 0) + n
        wanted = []
        for i in sorted(have):
            targets = sorted((j for o, j in flow if o == i), key=lambda j: (j != i, j))
            routes[i, tier] = [[None, j] for j in targets]
            at, want, k = 0, flow[i, targets[0]], 0
            for blk in sorted(b for o, t, b in blocks if (o, t) == (i, tier)):
                n = blocks[i, tier, blk]
                while k < len(targets) - 1 and want < at + n:
                    wanted.append((i, tier, k, blk, want - at))
                    routes[i, tier][k][0] = (blk + 1) << (64 - BLOCK_BITS)
                    k += 1
                    want += flow[i, targets[k]]
                at += n
        if wanted:
            cut = spark.createDataFrame(wanted, "_old int, _tier int, _k int, _blk int, _at long")
            own = rows.where(F.col("_tier") == tier).withColumn("_blk", F.shiftright("_h", 64 - BLOCK_BITS).cast("int"))
            own = own.join(F.broadcast(cut.select("_old", "_tier", "_blk").distinct()), ["_old", "_tier", "_blk"])  # a row for each cut
            own = own.groupBy("_old", "_tier", "_blk", "_h").agg(F.sum("_size").alias("_size"))
            run = F.sum("_size").over(Window.partitionBy("_old", "_tier", "_blk").orderBy("_h"))
            own = own.withColumn("_mid", run - F.col("_size") / 2)
            for r in own.join(F.broadcast(cut), ["_old", "_tier", "_blk"]).where("_mid > _at").groupBy("_old", "_tier", "_k").agg(F.min("_h").alias("h")).collect():
                routes[r._old, r._tier][r._k][0] = r.h
        done = _route(rows.where(F.col("_tier") == tier), _routing(spark, {k: v for k, v in routes.items() if k[1] == tier}))
        for r in done.groupBy("_old", "_shard").agg(F.sum("_size").alias("n")).collect():
            room[r._shard] = max(0, room[r._shard] - r.n)
            quota[r._old, r._shard] = max(0, quota.get((r._old, r._shard), 0) - r.n)
            moved[r._old, r._shard] = moved.get((r._old, r._shard), 0) + r.n
    return _routing(spark, routes), moved


def reshard(docs: DataFrame, old_shard, capacities: dict[int, int] | int, key: str = "doc_id", text: str = "text", file_bytes: int = 128 << 20) -> tuple[DataFrame, dict]:
    """Move rows from the shards that the column expression old_shard names (not negative) to new ones.

    capacities: bytes of each new shard, or their number for near-equal ones. Returns the rows, read back from the
    rewritten files, with the columns of docs and `_old`, `_size`, `_shard`, `_chunk`, `_h`; and the transfers.
    The slots of a shard follow from number_slots().
    """
    (old,) = free_name(docs, "_old")
    back = shelter(docs, key, text)[1]
    docs = shelter(docs.withColumn(old, old_shard.cast("int")), key, text, old)[0].withColumnRenamed(old, "_old")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    tier = reduce(lambda rest, k: F.when(F.col("_size") >= TIERS[k], k).otherwise(rest), range(len(TIERS) - 2, -1, -1), F.lit(len(TIERS) - 1))
    full = docs.withColumns({"_size": size, "_h": F.xxhash64(F.lit(11), F.col(key), F.crc32(F.col(text).cast("binary")))}).withColumn("_tier", tier)
    rows = materialize(full.select("_old", "_tier", "_h", "_size"), "reshard-rows")
    if isinstance(capacities, int):
        total = rows.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
        capacities = near_equal(total, capacities)
    routing, moved = plan_transfers(rows, capacities)
    changed = {s for (i, j), n in moved.items() if i != j and n for s in (i, j)}
    largest = max([1, *(sum(n for (_, t), n in moved.items() if t == j) for j in capacities)])
    chunks = max(1, -(-largest // file_bytes))
    routed = _route(full, routing).withColumn("_chunk", F.pmod(F.xxhash64("_h"), F.lit(chunks)).cast("int")).drop("_tier")
    touched = F.col("_shard").isin(*changed) if changed else F.lit(False)
    path = fresh_path(docs.sparkSession, "reshard-files")
    place = F.array_position(F.array(*[F.lit(j) for j in sorted(capacities)]), F.col("_shard")) - 1
    # a task writes one chunk of one shard, of file_bytes or so
    routed.where(touched).withColumn("_dir", F.col("_shard")).repartitionById(len(capacities) * chunks, (place * chunks + F.col("_chunk")).cast("int")).sortWithinPartitions("_shard", "_chunk", "_h").write.partitionBy("_dir").parquet(path)
    written = docs.sparkSession.read.schema(routed.schema).parquet(path).select(*routed.columns) if changed else None
    kept = routed.where(~touched)
    out = kept if written is None else written if len(changed) >= len({j for _, j in moved}) else written.unionByName(kept)
    return back(out, ["_old", "_size", "_h", "_shard", "_chunk"]), moved


def number_slots(rows: DataFrame, key: str = "doc_id", shard: str = "_shard", chunk: str = "_chunk", order: str = "_h") -> DataFrame:
    """Adds slot: gapless from 0 in each shard. A chunk is numbered by itself and shifted by the chunks before it."""
    rows, back = shelter(rows, key, shard, chunk, order)
    rows = rows.withColumnsRenamed({shard: "_shard", chunk: "_chunk", order: "_h"})
    sizes = rows.groupBy("_shard", "_chunk").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_start", before).drop("_n")
    own = F.row_number().over(Window.partitionBy("_shard", "_chunk").orderBy("_h", key))
    numbered = rows.withColumn("_own", own).join(F.broadcast(starts), ["_shard", "_chunk"]).withColumn("slot", (F.col("_own") - 1 + F.col("_start")).cast("long")).drop("_own", "_start")
    return back(numbered.withColumnsRenamed({"_shard": shard, "_chunk": chunk, "_h": order}), ["slot"])
