"""A corpus pipeline: toxic documents go, copies and near copies go, sources are mixed, the mix is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import curriculum, exact_dedup, jaccard_join, packing, toxicity
from tidelog.llm.common import documents, saved, trim_heaps


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go."""
    trim_heaps(spark)
    return toxicity.keep_clean(docs, toxicity.labels_of(spark, sf_dir))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    trim_heaps(spark)
    return exact_dedup.keep_first(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 of five-word shingles one stays."""
    trim_heaps(spark)
    return jaccard_join.keep_one(docs, n=5, num=8, den=10)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: a row per copy that the mix takes, in order of position."""
    trim_heaps(spark)
    return curriculum.mix(docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    trim_heaps(spark)
    return packing.packed_documents(docs)


STAGES = [("toxicity", stage_toxicity), ("exact_dedup", stage_exact_dedup), ("ngram_jaccard_join", stage_near_dedup), ("curriculum_mix", stage_mix), ("best_fit_packing", stage_pack)]

#: Scoring, the join's components and packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
