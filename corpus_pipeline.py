"""A corpus pipeline over `documents`: five stages, each applied to all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined cases: a null or empty text has no toxic words and stays as it is; empty texts are copies of each other, null ones of
nothing; both count no words, so the mix takes neither. Of rows that repeat both key and text one stays; a null key comes last and
is a key like others; ties go to the smaller key, then to the text's hash; texts of any length are read whole; an empty table gives
an empty result; extra columns pass through all stages but the last.

Columns that the operators add may clash with extra columns of docs, so stages take their names from free_name, as the operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import bagminhash, linededup, mixing, packing, toxicity
from tabloom.llm._common import discard, free_name, load, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), held_out=toxicity.held_out())
    (score,) = free_name(docs, "toxic_score")
    return toxicity.score(docs, model, name=score).where(F.col(score) < toxicity.REJECT).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs leave the texts; every document stays."""
    out = linededup.dedup_lines(docs)
    _, removed = free_name(docs, "n_lines", "n_removed")
    return out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class stays."""
    _, kept = free_name(docs, "class_id", "kept")
    return bagminhash.dedup(docs).where(F.col(kept)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand in the result as often as the mix takes them."""
    size, _, _, taken = free_name(docs, "size", "source_size", "target", "taken")
    out = mixing.mix(docs).where(F.col(taken) > 0)
    times = F.floor(F.col(taken) / F.col(size)).cast("int")
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), times)).alias(*free_name(out, "_copy"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs.select("doc_id", "text"), keep_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("mix sources", mix_sources),
    ("pack", pack_sequences),
]

#: SQL cannot express the classifier, the signatures, the knapsack or the tokenizer; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-stage")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
