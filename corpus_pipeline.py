"""From raw documents to shards of training text: five stages, each over all that its predecessor kept.

Each stage function takes (spark, docs, sf_dir); all but the last return the columns of docs, unchanged whatever their names.
Sharding replaces columns named shard and slot. Empty tables pass through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgram.llm import common, decontaminate, mixing, near_dups, quality, shard, simhash


def beside(docs: DataFrame, taken: set[str], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f(docs) with the columns of docs: those whose names f uses itself have others meanwhile."""
    other = {c: common.unused(docs, f"kept_{c}") for c in docs.columns if c.lower() in taken}
    return f(docs.withColumnsRenamed(other)).select(*[F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, rejects go."""
    net = quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return beside(docs, {"score", "predicted"}, lambda rows: quality.scored(rows, net).filter(F.col("predicted") == 1))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays. Fingerprints at 2 or fewer differing bits link documents (simhash.py); the
    exact similarity of five-word shingles, 0.8 and more, also links those whose fingerprints are further apart."""
    return near_dups.deduplicated(docs, linked=simhash.linked)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, edited or not, go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose source, language and topic shares follow the targets."""
    return beside(docs, {"topic", "tokens", "prob"}, mixing.mixed)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with shard and slot."""
    return shard.assign_shards(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_filter),
    ("mixing", mix),
    ("sharding", shards),
]
#: The classifier, the walk embedding and the similarity join can't be written in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.fresh_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if k:
            common.delete(spark, f"{root}/{k - 1}")
    return docs
