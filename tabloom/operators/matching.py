"""Fuzzy matching and ledger reconciliation."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import canonical_key, col

from .order import ranges, written_once
from .relational import OperatorError, number_rows

#: Endings of company names that do not tell companies apart.
COMPANY_SUFFIXES = (
    "集团股份有限公司", "集团有限责任公司", "有限责任公司", "股份有限公司", "集团有限公司", "集团公司", "有限公司", "公司", "集团", "co., ltd.", "co., ltd", "co. ltd.", "co. ltd", "co ltd",
    "company limited", "limited liability company", "corporation", "incorporated", "llc",
)
#: Punctuation that is left at the end once an ending is gone.
LEFTOVER = ".,，。·-_/"
#: Normalised texts of a block or so; blocks of the two sides meet pairwise.
BLOCK = 1024
#: Rows of parts and wholes that meet in one task.
RANGE = 1 << 18


def normalized(column: Column, suffixes: tuple[str, ...] = COMPANY_SUFFIXES) -> Column:
    """NFKC, case folded, without white space, without company endings; a text that is nothing but an ending keeps it."""
    bare = sorted({re.sub(r"\s+", "", x.casefold()) for x in suffixes} - {""}, key=len, reverse=True)
    ends = re.compile(f"(?s)^(.+?)(?:[{re.escape(LEFTOVER)}]*(?:{'|'.join(map(re.escape, bare))}))+$") if bare else None

    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        s = s.str.normalize("NFKC").str.casefold().str.replace(r"\s+", "", regex=True)
        return s.str.replace(ends, lambda m: m[1].rstrip(LEFTOVER), regex=True) if ends else s

    return clean(column.cast("string"))


def text_ratio(a: str | Column, b: str | Column) -> Column:
    """Ratcliff-Obershelp similarity."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q, autojunk=False).ratio() if p is not None and q is not None else None for p, q in zip(x, y)])

    return ratio(col(a), col(b))


def _counted(texts: list[str], letters):
    """How often each of the letters (code points, ascending) stands in each text: a matrix."""
    import numpy as np

    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.searchsorted(letters, codes)
    return np.bincount(np.repeat(np.arange(len(texts)), [len(x) for x in texts]) * len(letters) + at, minlength=len(texts) * len(letters)).reshape(len(texts), -1)


def _two_best(pairs: DataFrame, holds: bool = False) -> DataFrame:
    """pairs: block_a, a (texts), b (structs of pos and text), as `_met` makes them. (text, pos, score): the two best of b for each of a.

    The letters that two texts share, and after them their longest common subsequence, bound their ratio from above. A block of a goes through all blocks of
    b in one task, the likest first, and keeps its two best meanwhile; only what may be above the second best, or tie with it, is compared, so nothing that could be
    among the two is passed over. Ties go to the smaller pos. With holds, a text that the other holds
    counts as the ratio of their lengths at least, which lies below the same bounds.
    """

    def score(x: str, y: str) -> float:
        ratio = SequenceMatcher(None, x, y, autojunk=False).ratio()
        return max(ratio, min(len(x), len(y)) / max(len(x), len(y))) if holds and (x in y or y in x) else ratio

    def common(masks: dict[str, int], full: int, y: str) -> int:
        """Length of the longest common subsequence, a bit for each letter of x."""
        v = full
        for ch in y:
            u = v & masks.get(ch, 0)
            v = (v + u) | (v - u)
        return full.bit_length() - (v & full).bit_count()

    def through(texts: list[str], others: list[tuple[int, str]], best: list[list[tuple[float, int]]]) -> None:
        import numpy as np

        points = lambda x: np.unique(np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32))
        names = [y for _, y in others]
        letters = np.union1d(points(texts), points(names))
        a, b = _counted(texts, letters), _counted(names, letters)
        shared = np.zeros((len(texts), len(names)), np.int32)
        for i in range(len(letters)):
            ra, rb = np.flatnonzero(a[:, i]), np.flatnonzero(b[:, i])
            if len(ra) and len(rb):
                shared[np.ix_(ra, rb)] += np.minimum.outer(a[ra, i], b[rb, i]).astype(np.int32)
        bound = 2.0 * shared / np.add.outer([len(x) for x in texts], [len(y) for y in names])
        second = np.array([-x[1][0] if len(x) == 2 else 0.0 for x in best])
        for r, text in enumerate(texts):
            may = np.flatnonzero(bound[r] >= second[r] - 1e-12)
            masks: dict[str, int] = {}
            for i, ch in enumerate(text):
                masks[ch] = masks.get(ch, 0) | 1 << i
            full = (1 << len(text)) - 1
            for i in may[np.argsort(-bound[r][may], kind="stable")]:
                least = -best[r][1][0] - 1e-12 if len(best[r]) == 2 else 0.0
                if bound[r][i] < least:
                    break
                pos, other = others[i]
                if len(best[r]) == 2 and 2.0 * common(masks, full, other) / (len(text) + len(other)) < least:
                    continue
                best[r] = sorted([*best[r], (-score(text, other), pos)])[:2]

    def run(frames):
        now, texts, best = None, [], []
        made = lambda: pd.DataFrame([(x, pos, -s) for x, two in zip(texts, best) for s, pos in two], columns=["text", "pos", "score"]).astype({"text": str, "pos": "int64", "score": float})
        for frame in frames:
            for block, a, b in zip(frame["block_a"], frame["a"], frame["b"]):
                if block != now:
                    if now is not None:
                        yield made()
                    now, texts, best = block, list(a), [[] for _ in a]
                through(texts, sorted((x["pos"], x["text"]) for x in b), best)
        if now is not None:
            yield made()

    return pairs.mapInPandas(run, "text string, pos long, score double")


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """a (_n) and b (_pos, _n) in blocks of neighbours in the order of texts, of a quarter of BLOCK and of BLOCK or so: each block of a with every block of b, the nearest first."""
    both = number_rows(a.select("_n", F.lit(None).cast("long").alias("_pos")).union(b.select("_n", F.col("_pos").cast("long"))), ["_n", "_pos"], "_at")
    n = both.agg(F.max("_at").alias("n")).first().n or 0
    small, large = max(1, BLOCK // 2), 2 * BLOCK
    x = both.where("_pos is null").groupBy(F.expr(f"_at div {small}").alias("block_a")).agg(F.collect_list("_n").alias("a"))
    y = both.where("_pos is not null").groupBy(F.expr(f"_at div {large}").alias("block_b")).agg(F.collect_list(F.struct(F.col("_pos").alias("pos"), F.col("_n").alias("text"))).alias("b"))
    met = x.withColumn("block_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n // large).cast("long")))).join(y, "block_b")
    far = F.abs(F.col("block_b") * large + large // 2 - F.col("block_a") * small)
    return met.repartition(n // small + 1, "block_a").sortWithinPartitions("block_a", far, "block_b").select("block_a", "a", "b")


def fuzzy_lookup(source: DataFrame, lookup: DataFrame, source_key: str, lookup_key: str, values: list[str], threshold: float = 0.85, gap: float = 0.03, order_by: list[str] | None = None) -> DataFrame:
    """Adds candidate, score, second, second_score, status (matched, review, unmatched) and, when matched, values.

    Every distinct normalised source text is held against all distinct normalised lookup texts, in blocks, so the two best
    are always found; ties go to the lookup row that comes first by order_by (the key and values, if not given). Rows of
    one normalised text stand as its first row; if their values differ, what matches them goes to review. Missing and
    empty texts are unmatched without a candidate.
    """
    order_by = order_by or [lookup_key, *values]
    s = source.select(col(source_key).alias("_raw")).distinct().withColumn("_n", normalized(F.col("_raw")))
    rows = lookup.select(col(lookup_key).alias("_cand"), *[col(v).alias(f"_v{i}") for i, v in enumerate(values)], *[col(c).alias(f"_o{i}") for i, c in enumerate(order_by)])
    rows = rows.withColumn("_n", normalized(F.col("_cand"))).where("_n <> ''")
    order, payload = F.struct(*[f"_o{i}" for i in range(len(order_by))]), [f"_v{i}" for i in range(len(values))]
    several = F.count_distinct(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})) > 1 if payload else F.lit(False)
    first = rows.groupBy("_n").agg(F.min(order).alias("_first"), several.alias("_mixed"), F.min_by(F.struct("_cand", *payload), order).alias("_row"))
    k = number_rows(first, ["_first", "_n"], "_pos").select("_pos", "_n", "_mixed", "_row.*")
    found = _two_best(_met(s.where("_n <> ''").select("_n").distinct(), k))
    w = Window.partitionBy("text").orderBy(F.desc("score"), "pos")
    top = found.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy(F.col("text").alias("_n")).agg(*[F.max(F.when(F.col("_r") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("pos", "score")])
    top = top.join(k.drop("_n").withColumnRenamed("_pos", "pos1"), "pos1").join(k.select(F.col("_pos").alias("pos2"), F.col("_cand").alias("_second")), "pos2", "left")
    out = source.join(s, col(source_key).eqNullSafe(F.col("_raw")), "left").join(top, "_n", "left")
    clear = ~F.col("_mixed") & (F.col("score2").isNull() | (F.col("score1") - F.col("score2") > gap))
    status = F.when(F.col("score1") >= threshold, F.when(clear, "matched").otherwise("review")).otherwise("unmatched")
    out = out.withColumn("_status", status)
    extra = [F.when(F.col("_status") == "matched", F.col(p)).alias(v if v not in source.columns else f"{v}_lookup") for v, p in zip(values, payload)]
    return out.select(*[col(c) for c in source.columns], F.col("_cand").alias("candidate"), F.round("score1", 4).alias("score"), F.col("_second").alias("second"), F.round("score2", 4).alias("second_score"), F.col("_status").alias("status"), *extra)


def cluster_similar(df: DataFrame, column: str, threshold: float = 0.85, max_unique: int = 1000) -> DataFrame:
    """Greedy groups of similar spellings: (group_id, value, n, suggestion). Refuses more than max_unique values."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("norm", normalized(F.col("value")))
    rows = counts.orderBy(F.desc("n"), "value").limit(max_unique + 1).collect()
    if len(rows) > max_unique:
        raise OperatorError(f"more than {max_unique} distinct values")
    groups: list[list] = []
    for r in rows:
        home = next((g for g in groups if g[0].norm == r.norm or SequenceMatcher(None, g[0].norm, r.norm, autojunk=False).ratio() >= threshold), None)
        groups.append([r]) if home is None else home.append(r)
    out = [(f"G{i + 1:03d}", r.value, r.n, g[0].value) for i, g in enumerate(g for g in groups if len(g) > 1) for r in g]
    return df.sparkSession.createDataFrame(out, "group_id string, value string, n long, suggestion string")


def reconcile(left: DataFrame, right: DataFrame, key: str, amount: str, date: str, secondary: list[str] = (), left_id: str = "id", right_id: str = "id", tolerance: float = 0.0, days: int = 0, rounding: int = 20, splits: bool = False) -> dict[str, DataFrame]:
    """Two ledgers in phases; every row lands in one bucket (a review may repeat a right row).

    duplicates: keys that repeat on a side, both sides' rows. Unique key pairs are matched (equal amount and date),
    amount_difference (within the tolerance, on the same date), date_difference (the same amount, within the days) or else for review. Rows left over pair within the tolerances: matched only if they are each other's one candidate, exact in amount
    and date, equal in all secondary fields and without differing keys; else ranked candidates for review, `rounding` at most for
    a left row. The rest is left_only and right_only. With splits, leftovers of one side that two of the other add up to stand in split_groups (and
    split_summary) instead.
    """
    def side(df, i):
        names = {"k": canonical_key(key), "a": col(amount).cast("decimal(18,2)"), "d": col(date).cast("date")}
        return df.select(col(i).alias("id"), *[v.alias(n) for n, v in names.items()], *[canonical_key(c).alias(f"s{j}") for j, c in enumerate(secondary)])

    a, b = written_once(side(left, left_id)), written_once(side(right, right_id))  # a few narrow columns, read by every phase
    na, nb = (x.where("k is not null").groupBy("k").agg(F.count("*").alias(n)) for x, n in ((a, "na"), (b, "nb")))
    state = na.join(nb, "k", "full").fillna(0, ["na", "nb"])
    repeated = state.where("na > 1 or nb > 1")
    duplicates = a.join(repeated, "k").select(F.lit("left").alias("side"), "id", "k").union(b.join(repeated, "k").select(F.lit("right").alias("side"), "id", "k"))
    single = state.where("na = 1 and nb = 1").select("k")
    l1 = a.join(single, "k").select("k", F.col("id").alias("left_id"), F.col("a").alias("la"), F.col("d").alias("ld"))
    r1 = b.join(single, "k").select("k", F.col("id").alias("right_id"), F.col("a").alias("ra"), F.col("d").alias("rd"))
    pairs = l1.join(r1, "k")
    da, dd = F.abs(F.col("la") - F.col("ra")), F.abs(F.datediff("ld", "rd"))
    tol = F.lit(tolerance).cast("decimal(18,2)")
    status = F.when(da.isNull() | dd.isNull(), "review").when((da == 0) & (dd == 0), "matched").when((da <= tol) & (dd == 0), "amount_difference").when((da == 0) & (dd <= days), "date_difference").otherwise("review")
    score = F.when(da.isNull(), 0.6).when(dd.isNull(), 0.65).when(status == "matched", 1.0).when(status.isin("amount_difference", "date_difference"), 0.98).when((da <= tol) & (dd <= days), 0.9).otherwise(0.7)
    keyed = pairs.select("left_id", "right_id", status.alias("status"), score.alias("score"), da.alias("amount_gap"), dd.alias("day_gap"))
    # rows whose key is missing or has no partner
    one_a = a.join(state.where("na > 1 or nb > 0").select("k"), "k", "left_anti")
    one_b = b.join(state.where("nb > 1 or na > 0").select("k"), "k", "left_anti")
    sec = [f"s{j}" for j in range(len(secondary))]
    step = max(tolerance, 0.01)
    la = one_a.where("a is not null and d is not null").select(F.col("id").alias("left_id"), F.col("k").alias("lk"), F.col("a").alias("la"), F.col("d").alias("ld"), *[F.col(s).alias(f"l{s}") for s in sec], F.floor(F.col("a") / step).alias("bin"))
    rb = one_b.where("a is not null and d is not null").select(F.col("id").alias("right_id"), F.col("k").alias("rk"), F.col("a").alias("ra"), F.col("d").alias("rd"), *[F.col(s).alias(f"r{s}") for s in sec], F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor(F.col("a") / step) + i)).alias("bin"))
    near = written_once(la.join(rb, "bin").drop("bin").where((da <= tol) & (dd <= days)))
    w1, w2 = Window.partitionBy("left_id"), Window.partitionBy("right_id")
    conflict = F.col("lk").isNotNull() & F.col("rk").isNotNull() & (F.col("lk") != F.col("rk"))
    alike = [F.coalesce((F.col(f"l{s}") == F.col(f"r{s}")).cast("int"), F.lit(0)) for s in sec]
    compared = sum([(F.col(f"l{s}").isNotNull() & F.col(f"r{s}").isNotNull()).cast("int") for s in sec], F.lit(0))
    same = F.coalesce(F.try_divide(sum(alike, F.lit(0)).cast("decimal(4,0)"), compared.cast("decimal(4,0)")), F.lit(0))
    # exact decimals, so that a score at half a unit rounds alike everywhere
    exact = lambda x: F.lit(str(x)).cast("decimal(6,4)")
    quality = lambda gap, limit: exact(1) - exact(0.5) * F.coalesce(F.try_divide(gap.cast("decimal(12,2)"), F.lit(str(limit)).cast("decimal(12,2)")), exact(0)).cast("decimal(10,6)")
    raw = (exact(0.45) * quality(da, tolerance) + exact(0.25) * quality(dd, days) + (exact(0.3) * same.cast("decimal(10,6)") if sec else exact(0))).cast("decimal(20,10)")
    raw = raw if sec else (raw / exact(0.7)).cast("decimal(20,10)")
    near = near.withColumn("score", F.round(F.when(conflict, (raw * exact(0.8)).cast("decimal(20,10)")).otherwise(raw), 4).cast("double")).withColumn("nl", F.count("*").over(w1)).withColumn("nr", F.count("*").over(w2))
    auto_ok = (F.col("nl") == 1) & (F.col("nr") == 1) & (da == 0) & (dd == 0) & ~conflict & F.lit(bool(sec)) & (sum(alike, F.lit(0)) == len(sec))
    near = near.withColumn("auto", auto_ok).withColumn("amount_gap", da).withColumn("day_gap", dd)
    auto = near.where("auto").select("left_id", "right_id", F.lit("matched").alias("status"), F.least(F.col("score"), F.lit(0.95)).alias("score"), "amount_gap", "day_gap")
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), "amount_gap", "day_gap", "right_id"))
    review = near.where("not auto").withColumn("candidate_rank", rank).where(F.col("candidate_rank") <= rounding).select("left_id", "right_id", F.lit("review").alias("status"), "score", "amount_gap", "day_gap", "candidate_rank")
    links = keyed.withColumn("candidate_rank", F.lit(None).cast("int")).union(auto.withColumn("candidate_rank", F.lit(None).cast("int"))).union(review)
    left_only = one_a.join(auto.select(F.col("left_id").alias("id")), "id", "left_anti").join(review.select(F.col("left_id").alias("id")), "id", "left_anti")
    right_only = one_b.join(auto.select(F.col("right_id").alias("id")), "id", "left_anti").join(review.select(F.col("right_id").alias("id")), "id", "left_anti")
    # keys that repeat on one side only keep their rows out of the leftovers
    left_only, right_only = (x.join(repeated.select("k"), "k", "left_anti").select("id", "k", "a", "d") for x in (left_only, right_only))
    out = {"duplicates": duplicates, "links": links, "left_only": left_only, "right_only": right_only}
    if splits:
        left_only, right_only = written_once(left_only), written_once(right_only)
        made = split_groups(left_only, right_only, "a", "d", tolerance=tolerance, days=days, parts=rounding)
        groups = written_once(made["groups"])
        side = lambda kind: groups.select(F.explode(F.when(F.col("match_type") == kind, F.array("whole")).otherwise(F.array("part_a", "part_b"))).alias("_id")).distinct()
        rest = lambda df, used: df.join(used, df["id"].cast("string") == F.col("_id"), "left_anti")
        out |= {"left_only": rest(left_only, side("split_1_to_2")), "right_only": rest(right_only, side("split_2_to_1")), "split_groups": groups, "split_summary": made["summary"]}
    return out


def reconcile_summary(left: DataFrame, right: DataFrame, out: dict[str, DataFrame]) -> DataFrame:
    """One row of counters over a reconciliation's results: rows of both sides, links by status, duplicates and leftovers."""
    links = out["links"].agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "amount_difference", "date_difference", "review")], F.count_distinct(F.when(F.col("status") == "review", F.col("left_id"))).alias("review_left"))
    counts = {"left_rows": left, "right_rows": right, "duplicates": out["duplicates"], "left_only": out["left_only"], "right_only": out["right_only"]}
    for name, df in counts.items():
        links = links.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))  # one row each
    return links


def _tried(parts: int, tolerance: float, close: bool):
    """A range of parts and wholes to its pairs of nearest parts: those within the tolerance if close, else all. A last row without ids counts the pairs, and the wholes that had more parts to choose from."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        named = lambda c: table.column(c).combine_chunks()
        own, x, k = (named(c).to_numpy(zero_copy_only=False) for c in ("_own", "_x", "_k"))
        group = named("_s").to_numpy(zero_copy_only=False).astype(np.int64) * (1 << 32) + named("_day").to_numpy(zero_copy_only=False)
        codes = np.unique(named("part").to_numpy(zero_copy_only=False)[k == 0], return_inverse=True)[1]  # ids by their order
        at = np.flatnonzero(k == 0)
        order = np.lexsort((codes, x[at], group[at]))
        at, codes = at[order], codes[order]
        px, pg = x[at], group[at]
        wholes = np.flatnonzero((k == 1) & own)
        wholes = wholes[np.argsort(group[wholes], kind="stable")]
        slack, none, pairs = int(round(tolerance * 100)), np.iinfo(np.int64).max, [np.triu_indices(n, 1) for n in range(parts + 1)]
        found, combinations, cut = [], 0, 0
        bounds = np.flatnonzero(np.diff(group[wholes], prepend=none, append=none)) if len(wholes) else []
        for i, j in zip(bounds[:-1], bounds[1:]):
            first, last = np.searchsorted(pg, group[wholes[i]], "left"), np.searchsorted(pg, group[wholes[i]], "right")
            for some in np.array_split(wholes[i:j], -(-(j - i) // 16384)):
                half = x[some]  # in cents where x of a part is in half cents
                low = first + np.searchsorted(px[first:last], half, "right")
                near = low[:, None] + np.arange(-2 * parts, parts + 1)
                there = (near >= first) & (near < last)
                near = np.clip(near, 0, max(len(px) - 1, 0))
                size = px[near] if len(px) else np.zeros(near.shape, np.int64)
                there &= size <= 2 * (half[:, None] + slack)
                cut += int((there.sum(axis=1) > parts).sum())
                far = np.where(there, np.abs(size - half[:, None]), none)
                best = np.lexsort((codes[near] if len(px) else near, far))[:, :parts]
                near, size, there = (np.take_along_axis(y, best, 1) for y in (near, size, there))
                n = there.sum(axis=1)
                for m in range(2, parts + 1):
                    rows = np.flatnonzero(n == m)
                    u, v = pairs[m]
                    if not len(rows) or not len(u):
                        continue
                    gap = np.abs(2 * half[rows, None] - size[rows][:, u] - size[rows][:, v]) // 2
                    one, two = near[rows][:, u], near[rows][:, v]
                    apart = codes[one] != codes[two]
                    combinations += int(apart.sum())
                    r, c = np.nonzero(apart & (gap <= slack) if close else apart)
                    one, two = one[r, c], two[r, c]
                    swap = codes[one] > codes[two]
                    found.append((some[rows[r]], at[np.where(swap, two, one)], at[np.where(swap, one, two)], gap[r, c]))
        w, a, b, g = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
        of = lambda c, rows: pa.concat_arrays([named(c).take(pa.array(rows, pa.int64())), pa.nulls(1, named(c).type)])
        more = lambda n: pa.concat_arrays([pa.nulls(len(w), pa.int64()), pa.array([n], pa.int64())])
        return pa.table({"whole": of("whole", w), "part_a": of("part", a), "part_b": of("part", b), "cents": pa.concat_arrays([pa.array(g, pa.int64()), pa.nulls(1, pa.int64())]), "combinations": more(combinations), "truncated": more(cut)})

    return run


def _combinations(whole: DataFrame, part: DataFrame, amount: str, date: str, whole_id: str, part_id: str, tolerance: float, days: int, parts: int, close: bool) -> DataFrame:
    """(whole, part_a, part_b, gap, combinations, truncated): pairs of a whole's `parts` nearest parts (within the tolerance if close, else all), and a row for each range with counts only.

    The nearest to half of the whole: of the same sign, not zero, no larger than the whole and the tolerance, and within so many days; ties go to the smaller
    id. Parts go to each day whose wholes may take them, so a whole finds all of its parts in one order: by sign, day and size, dealt to ranges of
    RANGE rows. A range also gets the parts next to it from the ranges of its days, and pairs are tried where the parts lie: neither
    parts of a whole nor pairs beyond the tolerance become rows. Of equal parts only those with the smallest ids can be near.
    """
    day = lambda: F.datediff(col(date).cast("date"), F.lit("1970-01-01").cast("date"))
    facts = lambda df, i, name, unit: df.select(col(i).alias(name), col(amount).cast("decimal(18,2)").alias("_v"), day().alias("_day")).where("_v <> 0 and _day is not null").withColumns({"_s": F.signum("_v").cast("int"), "_x": (F.abs("_v") * unit).cast("long")}).drop("_v")
    a, b = facts(whole, whole_id, "whole", 100), facts(part, part_id, "part", 200)  # half cents against cents: a whole stands at its half
    b = b.withColumn("_day", F.explode(F.sequence(F.col("_day") - days, F.col("_day") + days)))
    equal = Window.partitionBy("_s", "_day", "_x").orderBy("part")
    b = b.withColumn("_r", F.row_number().over(equal)).where(F.col("_r") <= parts + 1).drop("_r")
    kinds = {"part": b.schema["part"].dataType, "whole": a.schema["whole"].dataType}
    side = lambda df, k: df.select("_s", "_day", "_x", F.lit(k).alias("_k"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    dealt = ranges(side(b, 0).union(side(a, 1)), ["_s", "_day", "_x", "_k", "part"]).withColumn("_p", F.expr(f"_id div {RANGE}"))
    held = dealt.groupBy("_s", "_day", "_p").agg(F.lit(1).alias("_n"))
    several = held.withColumn("_n", F.sum("_n").over(Window.partitionBy("_s", "_day"))).where("_n > 1").drop("_n")
    edge = dealt.where("_k = 0").join(F.broadcast(several), ["_s", "_day", "_p"])  # days at the ends of ranges
    end = lambda by, n: edge.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_day", "_p").orderBy(by))).where(F.col("_r") <= n).withColumnRenamed("_p", "_q").drop("_r")

    def beside(rows, n, by, other):
        met = rows.join(F.broadcast(several), ["_s", "_day"]).where(other)
        return met.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_day", "_p").orderBy(by))).where(F.col("_r") <= n).select("_p", "_s", "_day", "_x", "_k", "part", "whole", F.lit(False).alias("_own"))

    before, after = beside(end(F.desc("_id"), 2 * parts), 2 * parts, F.desc("_id"), F.col("_q") < F.col("_p")), beside(end(F.asc("_id"), parts + 1), parts + 1, F.asc("_id"), F.col("_q") > F.col("_p"))
    every = dealt.select("_p", "_s", "_day", "_x", "_k", "part", "whole", F.lit(True).alias("_own")).union(before).union(after)
    out = f"whole {kinds['whole'].simpleString()}, part_a {kinds['part'].simpleString()}, part_b {kinds['part'].simpleString()}, cents long, combinations long, truncated long"
    made = every.groupBy("_p").applyInArrow(_tried(parts, tolerance, close), out)
    gap = (F.col("cents").cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)")
    return made.select("whole", "part_a", "part_b", gap.alias("gap"), "combinations", "truncated")


def reconcile_splits(left: DataFrame, right: DataFrame, amount: str, date: str, left_id: str = "id", right_id: str = "id", tolerance: float = 0.0, days: int = 0, parts: int = 20) -> DataFrame:
    """Left rows that two right rows add up to: (left_id, right_a, right_b, gap). Of each left row the `parts` parts nearest to half of it are tried."""
    found = _combinations(left, right, amount, date, left_id, right_id, tolerance, days, parts, close=True)
    return found.where("combinations is null").select(F.col("whole").alias("left_id"), F.col("part_a").alias("right_a"), F.col("part_b").alias("right_b"), "gap")


def split_groups(left: DataFrame, right: DataFrame, amount: str, date: str, left_id: str = "id", right_id: str = "id", tolerance: float = 0.0, days: int = 0, parts: int = 20, max_combinations: int | None = None) -> dict[str, DataFrame]:
    """One row against two of the other ledger, both ways, for review only.

    groups: match_type (split_1_to_2 or split_2_to_1), whole, part_a, part_b (ids as text), gap, score (0.8 exact, else 0.72).
    summary: one row (combinations, evaluated, limit_hit, truncated, groups). With max_combinations so many combinations are evaluated in order of
    type and ids, and limit_hit says whether any were left out; truncated counts the rows that had more eligible parts than were tried.
    """
    both = {"split_1_to_2": (left, right, amount, date, left_id, right_id), "split_2_to_1": (right, left, amount, date, right_id, left_id)}
    ids = lambda df, kind: df.select(F.lit(kind).alias("match_type"), *[F.col(c).cast("string").alias(c) for c in ("whole", "part_a", "part_b")], "gap", "combinations", "truncated")
    made = written_once(reduce(DataFrame.union, [ids(_combinations(*x, tolerance, days, parts, close=max_combinations is None), kind) for kind, x in both.items()]))
    every, counts = made.where("combinations is null").drop("combinations", "truncated"), made.where("combinations is not null")
    close = F.col("gap") <= F.lit(tolerance).cast("decimal(18,2)")
    if max_combinations is not None:
        every = number_rows(every, ["match_type", "whole", "part_a", "part_b"], "_n")
        close = close & (F.col("_n") < max_combinations)
    groups = every.where(close).select("match_type", "whole", "part_a", "part_b", "gap", F.when(F.col("gap") == 0, 0.8).otherwise(0.72).alias("score"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    most = F.lit(max_combinations).cast("long") if max_combinations is not None else F.col("combinations")
    summary = counts.agg(total("combinations"), total("truncated")).crossJoin(F.broadcast(groups.agg(F.count("*").alias("groups"))))  # one row each
    return {"groups": groups, "summary": summary.select("combinations", F.least("combinations", most).alias("evaluated"), (F.col("combinations") > most).alias("limit_hit"), "groups", "truncated")}
