"""Stages that turn documents into a training corpus; each calls one operator of ``telespan.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from telespan.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from telespan.llm.base import documents
from telespan.scratch import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger scores below one half."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold little or nothing of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample whose token weights are nearest the target marginals."""
    return mixing.sample(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, checksum, shard and position of every document left."""
    return sharding.shard_documents(docs).select(
        "doc_id", "size", "text_crc32", "shard", F.col("position").cast("bigint").alias("slot"), "map_version"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The tagger, the sketches and the digests have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
