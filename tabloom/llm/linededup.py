r"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

A document is the sequence of its non-blank lines. Ranks of the lines sort all suffixes by their first line; a round of
doubling ranks pairs (rank here, rank 2**j lines on), which sorts by twice as many lines. A rank comes from a range
sort over the distinct pairs, so a hot line is one row there. Suffixes whose prefix occurs once leave the array, as
nothing longer of theirs repeats. A run counts from `min_words` words, and lines hold a word each at least, so a run
that decides has `min_words` lines at most and doubling may end there: two overlapping ranks of 2**j lines name any
stretch of 2**j to 2**(j+1) lines. The suffixes that share the stretch from a line to its `min_words`-th word are an LCP
interval of that depth; so are those that share a stretch which ends there. Every repeated run is the union of such
stretches within it, so deleting all occurrences in an interval but its first deletes just the later copies of maximal
repeated runs.

Copies of a whole text stand in the array once; later copies lose all their lines. Order is by key, then by text hash.

Defined cases: null text stays null, counts 0 lines; empty and blank texts stay; of rows that repeat both key and text one
counts as the first and the others as later copies; a null key comes last; a text below `min_words` words is never changed;
an empty table gives an empty result; extra columns pass through, and where they clash the new columns get leading underscores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._common import bound_batches, discard, materialize, shelter
from .copies import ROW, distinct_texts, mark_repeats, ranked, with_identity

MIN_WORDS = 50

LINE = "_t long, _u long, _d long, i int, id long, id2 long, ahead int, back int"


def _lines(frames, text: str, min_words: int):
    """Lines of documents; ahead and back: lines from here on, and up to here, that hold min_words words (0: too few)."""
    import xxhash

    for frame in frames:
        of, cols = [], [[] for _ in range(5)]
        for k, body in enumerate(frame[text]):
            lines = [x for x in body.encode().split(b"\n") if x.strip()]
            cum = np.zeros(len(lines) + 1, np.int64)
            np.cumsum([len(x.split()) for x in lines], out=cum[1:])
            if cum[-1] < min_words:
                continue
            n = len(lines)
            at = np.arange(n)
            stop = np.searchsorted(cum, cum[:-1] + min_words)  # cum[stop] >= cum[i] + min_words
            start = np.searchsorted(cum, cum[1:] - min_words, "right") - 1
            both = np.frombuffer(b"".join(map(xxhash.xxh128_digest, lines)), "<i8")
            of.append(np.full(n, k))
            for c, x in zip(cols, (at, both[::2], both[1::2], np.where(stop <= n, stop - at, 0), np.where(cum[1:] >= min_words, at + 1 - start, 0))):
                c.append(x)
        if of:
            of = np.concatenate(of)
            yield pd.DataFrame({**{c: frame[c].to_numpy()[of] for c in ROW}, **dict(zip(("i", "id", "id2", "ahead", "back"), map(np.concatenate, cols)))})


def suffix_ranks(lines: DataFrame, levels: int) -> list[DataFrame]:
    """For each j: (node, i, r) of the suffixes whose first 2**j lines occur again somewhere, in suffix order by r."""
    again = lines.groupBy("id", "id2").agg(F.count("*").alias("n")).where("n > 1").select("id", "id2")
    names = materialize(ranked(again, "id", "id2"), "line-ranks")
    out = [materialize(lines.select("node", "i", "id", "id2").join(names, ["id", "id2"]).select("node", "i", F.col("_rank").alias("r")), "suffix-0")]
    discard(names)
    for j in range(levels):
        step = 1 << j
        later = F.first("r").over(Window.partitionBy("node").orderBy("i").rangeBetween(step, step))
        pairs = out[-1].withColumn("r2", later).where("r2 is not null")
        keys = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1").select("r", "r2")
        names = materialize(ranked(keys, "r", "r2"), "pair-ranks")
        out.append(materialize(pairs.join(names, ["r", "r2"]).select("node", "i", F.col("_rank").alias("r")), f"suffix-{j + 1}"))
        discard(names)
    return out


def repeated_lines(docs: DataFrame, heads: DataFrame, repeats: bool, key: str, text: str, min_words: int) -> DataFrame:
    """(_t, _u, _d, _gone) of the first row of each text: numbers of the non-blank lines to delete, null for none."""
    own = with_identity(docs.where(F.col(text).isNotNull()), key, text).select(*ROW, text)
    lines = own.mapInPandas(lambda frames: _lines(frames, text, min_words), LINE)
    if repeats:  # made unique where they are read, before copies of a line meet
        lines = lines.dropDuplicates([*ROW, "i"])
    lines = materialize(lines.join(heads.select(*ROW, "node"), ROW).drop(*ROW), "lines")
    levels = max(0, min_words.bit_length() - 1)
    ranks = suffix_ranks(lines, levels)
    every = ranks[0].withColumn("j", F.lit(0))
    for j, r in enumerate(ranks[1:], 1):
        every = every.unionByName(r.withColumn("j", F.lit(j)))
    spans = lines.where("ahead > 0").select("node", F.col("i").alias("s"), F.col("ahead").alias("n")).union(lines.where("back > 0").select("node", (F.col("i") - F.col("back") + 1).alias("s"), F.col("back").alias("n"))).distinct()
    spans = spans.withColumn("j", F.floor(F.log2("n") + 1e-9).cast("int"))
    spans = spans.join(every.select("node", F.col("i").alias("s"), "j", F.col("r").alias("r1")), ["node", "s", "j"])
    spans = spans.withColumn("i", (F.col("s") + F.col("n") - F.expr("shiftleft(1, j)")).cast("int")).join(every.select("node", "i", "j", F.col("r").alias("r2")), ["node", "i", "j"])
    spans = materialize(spans.select("node", "s", "n", "r1", "r2"), "spans")
    for table in (lines, *ranks):
        discard(table)
    interval = spans.groupBy("r1", "r2", "n").agg(F.min(F.struct("node", "s")).alias("m"), F.count("*").alias("k")).where("k > 1").drop("k")
    later = spans.join(interval, ["r1", "r2", "n"]).where(F.struct("node", "s") > F.col("m"))
    gone = later.select("node", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("i")).distinct()
    marks = materialize(heads.join(gone.groupBy("node").agg(F.collect_list("i").alias("_gone")), "node", "left").select(*ROW, "_gone"), "deletions")
    discard(spans)
    return marks


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated runs deleted from text, and n_lines, n_removed (non-blank lines)."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    docs, back = shelter(docs, key, text)
    bound_batches(docs.sparkSession)
    heads, repeats = distinct_texts(docs, key, text)
    marks = repeated_lines(docs, heads, repeats, key, text, min_words).withColumn("_first", F.lit(True))
    # texts are shuffled once at any size; a row without a mark is a later copy
    marked = mark_repeats(docs, key, text, repeats).join(marks.hint("merge"), ROW, "left")
    first = (F.coalesce("_first", F.lit(False)) & ~F.col("_again")).alias("_first")
    schema = StructType([*docs.schema.fields, StructField("n_lines", IntegerType()), StructField("n_removed", IntegerType())])
    names, at = docs.columns, docs.columns.index(text)

    def rebuild(batches):
        import pyarrow as pa

        for batch in batches:
            first, drop = batch.column(len(names)), batch.column(len(names) + 1)
            texts, n_lines, n_gone = [], [], []
            for body, is_first, numbers in zip(batch.column(at).to_pylist(), first.to_pylist(), drop.to_pylist()):
                lines = body.split("\n") if body is not None else []
                full = [x for x in lines if x.strip(" \t\n\r\x0b\x0c")]
                out = set(numbers or ())
                if is_first is False and sum(len(x.encode().split()) for x in full) >= min_words:
                    out = set(range(len(full)))
                if out:
                    kept, i = [], 0
                    for x in lines:
                        blank = not x.strip(" \t\n\r\x0b\x0c")
                        if blank or i not in out:
                            kept.append(x)
                        i += not blank
                    body = "\n".join(kept) if len(out) < len(full) else ""
                texts.append(body)
                n_lines.append(len(full))
                n_gone.append(len(out))
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int32()), pa.array(n_gone, pa.int32())], names=schema.names)

    return back(marked.select(*docs.columns, first, "_gone").mapInArrow(rebuild, schema), ["n_lines", "n_removed"])
