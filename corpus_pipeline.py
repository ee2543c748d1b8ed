"""A corpus from raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import line_dedup, mixing, packing, simhash, toxicity
from tidewheel.llm.common import checkpoint_folder, table

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below 0.5; null and empty texts stay, and all do where nothing could be learned (no label, labels of one kind, no word)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, "toxic")
    if not model.trained:
        return docs.select(*DOCUMENT)
    return toxicity.scores(docs.select(*DOCUMENT), model).where("score < 0.5").select(*DOCUMENT)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur elsewhere before; those left without a word by that go."""
    out = line_dedup.dedup(docs.select(*DOCUMENT))
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*DOCUMENT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id (those without one come last), once.

    Documents that share an id are told apart by their texts: unlike ones both stay.
    """
    docs = docs.select(*DOCUMENT)
    stays = simhash.similar(docs.select("doc_id", "text"), similarity=0.8, shingle=5).where("kept").select(F.col("k").alias("_k")).distinct()
    return docs.withColumn("_k", simhash.row_key()).join(stays, "_k", "left_semi").dropDuplicates(["_k"]).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted so that the sources' shares hold in every stretch."""
    return mixing.mixed(docs.select(*DOCUMENT))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents; each is a sequence, with its ids' checksum; sequences of a bucket follow the mixing schedule.

    Files read again come in any order, so the schedule is worked out once more.
    """
    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(mixing.mixed(docs.select("doc_id", "text", "source")).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), longest=1024, end=0, ranks=ranks)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A string kernel's machine and fingerprints can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn on all documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = checkpoint_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder}/{k}_{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
