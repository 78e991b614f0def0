"""A training corpus from documents: five operators, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tacita.llm import contamination, jaccard, mixing, quality, sharding
from tacita.llm.shared import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 or more of their five-word shingles, the one with the smallest id stays.
    SimHashes within 7 bits are linked and verified; an exact join finds the pairs that are further apart."""
    return jaccard.keep_one(docs, shingle_words=5, similarity=0.8, radius=7)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in a twentieth of their words or more go."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to weights by the root of their size; a document stands as often as it is drawn."""
    return mixing.mix_sources(docs, alpha=0.5).drop("n_copies", "copy", "shuffle_key")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are dealt to 24 shards of near equal size."""
    return sharding.sharded(docs, shards=24)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Suffix arrays and shingle joins have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
