"""From documents to packed sequences: drop low quality, exact and near copies, mix the sources, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxweave.llm import exact_dedup, mixing, ngram_join, ordinal_quality, packing
from fluxweave.llm.common import materialise, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return ordinal_quality.keep_good(docs, read(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similar shingle sets connect, the document with the smallest doc_id stays."""
    return ngram_join.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    return mixing.take_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with the sequence and offset of each."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", dedup_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: Models, a near-duplicate join and a packing program are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
