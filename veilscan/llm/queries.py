"""One query per operator, over its whole table and with production parameters. Digest columns are derived from the operators' own results here."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .conversation_repair import conversation_repairs
from .decontaminate import benchmark_hits
from .embedding_dedup import vector_links
from .licenses import license_scan
from .mixing import mixed
from .ngram_join import similarity_classes
from .packing import packed
from .quality import quality_scores
from .sharding import byte_shards
from .suffix_dedup import without_repeats
from .token_counts import edited_counts, pre_token_trees, read_ranks, redaction_edits
from .toxicity import toxicity

TOKENIZERS = "/opt/tokenizers"  # the folder of public vocabulary files, read by the driver

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark, sf_dir):
    return toxicity(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")).drop("text")


@query
def op2_benchmark_decontamination(spark, sf_dir):
    found = benchmark_hits(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark")).drop("text")
    return found.selectExpr(
        "doc_id",
        "n_words",
        "n_hit",
        "cast(size(items) as bigint) AS n_items",
        "sha2(array_join(array_sort(transform(items, i -> cast(i as string))), ','), 256) AS items_sha256",
        "n_hit > 0 AS contaminated",
    )


@query
def op3_sharding(spark, sf_dir):
    shards = byte_shards(load(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_mix_sources(spark, sf_dir):
    return mixed(load(spark, sf_dir, "documents"), carry=()).drop("source", "copies")


@query
def op6_ngram_jaccard_join(spark, sf_dir):
    return similarity_classes(load(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_embedding_near_dedup(spark, sf_dir):
    return vector_links(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op7_suffix_array_dedup(spark, sf_dir):
    return without_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_license_scan(spark, sf_dir):
    return license_scan(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op9_token_counts(spark, sf_dir):
    """Tokens before and after mail addresses, long numbers and runs of blanks are edited away."""
    ranks = read_ranks(os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return edited_counts(pre_token_trees(redaction_edits(docs), ranks), ranks).drop("text")


@query
def op10_quality_classifier(spark, sf_dir):
    """The fold is the remainder of crc32(doc_id as text) by 3: rows of remainder 1 are held out, their labels never read."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    learnt = load(spark, sf_dir, "labels").where(~fold)
    scored = quality_scores(load(spark, sf_dir, "documents").select("doc_id", "text"), learnt).drop("text")
    return scored.select("doc_id", fold.alias("held_out"), "score", "predicted")


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with nulls as one space and some rows dropped, emptied, without sentence ends, doubled or given to the user, as the checksum of conv_id and turn says."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    key = F.concat(conv, F.lit(":"), turn)
    kind = F.col("_kind")
    hurt = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_kind")).where(kind != 0)
    hurt = hurt.withColumn("text", F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    hurt = hurt.withColumn("role", F.when(kind == 4, "user").otherwise(F.col("role")))
    return hurt.withColumn("_copy", F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_kind", "_copy")


@query
def op11_conversation_repair(spark, sf_dir):
    conversations = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = conversation_repairs(damaged(conversations)).withColumnRenamed("conv_id", "_its_conv")
    every = conversations.select("conv_id").distinct()
    found = every.join(repaired, every["conv_id"].eqNullSafe(repaired["_its_conv"]), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query
def op12_phrase_collocations(spark, sf_dir):
    return collocations(load(spark, sf_dir, "documents").select("text", "lang"))


@query
def op13_best_fit_packing(spark, sf_dir):
    with open(os.path.join(TOKENIZERS, "word_bpe_49k.json"), encoding="utf-8") as file:
        return packed(load(spark, sf_dir, "documents").select("doc_id", "text"), file.read())
