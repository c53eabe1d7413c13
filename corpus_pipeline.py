"""The corpus pipeline: every stage reads all that the one before it has kept and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm import minhash, packing, quality, toxicity
from sievecraft.llm.common import fresh_name, materialise, table
from sievecraft.llm.dedup import DigestIndex, digest
from sievecraft.llm.queries import tokenizer_path


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose id and text are not among the dropped ones; an id may be null or stand for several texts."""
    id_, of = fresh_name("id", docs), fresh_name("of", docs)
    gone = dropped.select(F.col("doc_id").alias(id_), F.col("digest").alias(of)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (digest() == F.col(of)), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the documents that the noisy-channel classifier does not find toxic; learns from all labels."""
    return _without(docs, toxicity.classify(docs, table(spark, sf_dir, "labels"), digests=True).where("predicted = 1"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the documents that the line field finds good; learns from all labels."""
    return _without(docs, quality.classify(docs, table(spark, sf_dir, "labels"), digests=True).where("predicted = 0"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of equal texts, the one with the largest id."""
    return DigestIndex(spark).kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document, that of the smallest id, of each group of near copies (five words, 0.8)."""
    return minhash.kept_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into windows of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifiers and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
