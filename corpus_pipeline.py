"""The training corpus, stage by stage: each stage works on all documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm import decontam, interleave, mixing, quality, simhash
from reelgrid.llm.shared import released, remove, shared_folder

#: Documents that score below are rejected.
LEAST_QUALITY = 0.3
#: Words of a shingle, bits up to which fingerprints are compared further, and the shared part of shingles that links.
SHINGLE, RADIUS, SIMILARITY = 5, 24, 0.8
SHARDS = 16


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the factorisation machine takes for bad ones."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter(f"score >= {LEAST_QUALITY}").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return simhash.deduplicated(docs, words=SHINGLE, radius=RADIUS, similarity=SIMILARITY)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out documents until sources have their share of the words."""
    return mixing.mixed(docs, stored=True)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document of the mix its shard and place."""
    return interleave.interleave(docs, SHARDS, stored=True)


STAGES = [
    ("quality classifier", good_documents),
    ("near-duplicates", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing", weighted_mix),
    ("sharding", shards),
]

#: A fitted classifier decides first, which SQL can't express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder; each result is written and read again.

    What a stage wrote on its way, and the documents it was given, go as soon as its own are written.
    """
    docs, given = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        folder = shared_folder(spark)
        with released(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(folder)
        if given:
            remove(spark, given)
        docs, given = spark.read.schema(made.schema).parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
