"""The registered queries of the corpus operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairband.llm import ann, byte_bpe, exact_dedup, hard_negatives, lm_scoring, minhash_dedup, mixing, packing, prefix_trie, quality, sharding, substring_dedup, toxicity
from fairband.llm.common import load


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(load(spark, sf_dir, "documents", "doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels", "doc_id", "toxic"), toxicity.remainder("doc_id", 5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", (toxicity.remainder("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(load(spark, sf_dir, "documents", "doc_id", "text"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(load(spark, sf_dir, "documents", "doc_id", "text"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(load(spark, sf_dir, "documents", "doc_id", "text"), shards=8)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    forest = quality.fit(docs, load(spark, sf_dir, "labels", "doc_id", "quality"), toxicity.remainder("doc_id", 4) != 2)
    return quality.score(docs, forest).select(
        "doc_id", (toxicity.remainder("doc_id", 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(load(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    conv = F.col("conv_id")
    turns = prefix_trie.turn_table(conversations, family=conv - conv % 5, head=F.crc32(conv.cast("string")) % 9)
    return prefix_trie.prefix_trie(turns)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, vec_id, label = load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), F.col("vec_id"), F.col("label")
    return hard_negatives.mine(vectors, vec_id % 50 == 0, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_ann": op10_ann,
    "op11_packing": op11_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE: dict[str, str] = {
    "op1_lm_scoring": lm_scoring.QUERY_SQL,
    "op4_exact_dedup": exact_dedup.QUERY_SQL,
    "op8_mixing": mixing.QUERY_SQL,
    "op12_prefix_trie": prefix_trie.QUERY_SQL,
    "op13_hard_negatives": hard_negatives.QUERY_SQL,
}
