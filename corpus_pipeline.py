"""From raw documents to a shard manifest: toxic documents go, near copies go, benchmark passages go, sources are mixed to weight, the rest is sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm.decontaminate import decontaminated
from veilscan.llm.mixing import emitted, mixed
from veilscan.llm.ngram_join import first_of_each
from veilscan.llm.sharding import sharded
from veilscan.llm.storage import settled
from veilscan.llm.toxicity import toxicity

# Models are trained and near copies searched by Python code, which SQL can't express; tests/llm compares the rows of each stage on sf0.001 with brute force or
# SQL, but for the classifiers of toxicity: there only that what they reject goes, and their hits on held-out labels.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject; columns and texts stay as they are."""
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("NOT rejected").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word n-grams, the one with the smallest id."""
    return first_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a benchmark item has; n_chars follows the text."""
    clean = decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them: not at all, once or twice."""
    return emitted(mixed(docs)).select(*docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest: a row per document, with its shard and its place there."""
    return sharded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", cut_benchmark),
    ("mix_sources", mix_sources),
    ("shards", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
