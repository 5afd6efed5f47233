"""From raw documents to token ids: a pipeline of five corpus operators.

Toxic documents go, of equal texts one stays, of near copies one stays, sources
are mixed to their target weights, and what is left is encoded.  Every stage gets
the table that the stage before it wrote.

In every stage a null text counts as empty, texts are read whole however long they
are, rows with null ids take part, an empty table gives an empty result, and
columns beside those of documents pass through whatever their names (the last
stage has its own columns).  What repeated rows and ties give is said at each stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairband.llm import byte_bpe, exact_dedup, minhash_dedup, mixing, toxicity
from fairband.llm.common import load
from fairband.session import scratch_path

RANKS = "byte_bpe_50k.tiktoken"


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels outside its held-out fifth, scores below 0.5.

    Every row is scored for itself, so repeated rows share their fate; a score of exactly 0.5 goes.
    """
    model = toxicity.fit(docs, load(spark, sf_dir, "labels", "doc_id", "toxic"), toxicity.remainder("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest id (any id before null).

    Of rows that repeat both id and text one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies, the document with the smallest id (null before any).

    Documents are alike from a weighted Jaccard similarity of exactly 0.8 on; rows that repeat a kept id all stay;
    texts without words are classes of their own.
    """
    return minhash_dedup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of 1.5 times all words takes them: not at all, once or twice.

    A null source is a source; texts without words are never taken; rows that repeat an id
    are taken as often as the one of them taken most often; ties follow the id's hash.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian 32-bit) in place of the text, and whether they decode to it.

    One row per row; an empty text has no ids.
    """
    path = public_tokenizers.path(RANKS)
    both = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return both.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", harmless),
    ("exact_dedup", distinct),
    ("minhash_dedup", unlike),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]
# learned scores, sampled signatures and merges are beyond SQL; tests/llm compares every stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below ``spark.checkpoint.dir`` and read again.

    Returns ``doc_id, lang, source, n_chars, n_tokens, ids, exact``: a row for every time that the mix takes a document.
    """
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
