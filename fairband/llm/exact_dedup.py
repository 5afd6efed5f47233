"""Exact duplicates by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 writes a slim key table (digest, id) from one scan of the texts and sets,
for every digest, a few bits of a blocked Bloom filter; bits hit at least twice
make the filter of possibly repeated digests.  Pass 2 probes the keys with that
filter.  A digest with an unrepeated bit is certainly unique: its row passes
straight through.  Only the rest is shuffled and grouped, so false positives cost
a little work and never change the result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairband.llm.common import (MOST_FILTER_BITS, aside, filter_bitmaps, filter_bits, filter_block, filter_blocks, filter_hit,
                                 with_group_facts, written)


def lower_ascii(text: Column) -> Column:
    """Null as empty; A-Z lower-cased and nothing else (plain ASCII takes the quick path)."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16,
                     hashes: int = 3, max_filter_bits: int = MOST_FILTER_BITS, salts: int = 64) -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z only.

    Returns one row per input row: ``id_col``, ``keep_id`` (largest id of the
    group), ``group_size``, ``kept``, ``text_sha256``; other input columns are not
    read, so their names cannot clash.  A null text counts as empty, a null id as
    the smallest; of rows that repeat both id and text exactly one is kept.  An
    empty table gives an empty result.

    ``bits_per_row`` sizes the filter, ``max_filter_bits`` (2^28: 32 MB) bounds what
    is broadcast whatever the input; beyond it the share of rows that pass straight
    through falls, the result stays exact.
    """
    keys = written(docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(lower_ascii(F.col(text_col)), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row")), "dedup-keys")
    blocks, digest = filter_blocks(keys.count(), bits_per_row, max_filter_bits), F.col("digest")
    repeated = filter_bitmaps(keys, digest, blocks, hashes, least_hits=2)  # at most blocks x 4 KB
    probed = (keys.withColumn("block", filter_block(digest, blocks)).join(F.broadcast(repeated), "block", "left")
              .select("id", "digest", "row", filter_hit(F.col("bitmap"), filter_bits(digest, hashes)).alias("maybe")))

    unique = probed.filter(~F.col("maybe")).select(
        "id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    rest = probed.filter("maybe").select(
        "id", "digest", "row", F.struct("id", "row").alias("best"), F.lit(1).cast("long").alias("group_size"))
    grouped = with_group_facts(
        rest.withColumnsRenamed({"best": "_own", "group_size": "_one"}), "digest", F.xxhash64("row"),
        {"best": (F.max, "_own", F.max), "group_size": (F.sum, "_one", F.sum)}, salts)
    regrouped = grouped.select("id", "digest", F.col("best.id").alias("keep_id"), "group_size",
                              (F.col("row") == F.col("best.row")).alias("kept"))
    return unique.unionByName(regrouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    Survivors are found by id.  Ids that several rows carry (only there an id
    does not name one row) are told apart by their text once more.  Null texts count
    as empty ones; a null id is an id, smaller than others; of rows that repeat id and text one stays;
    texts of any length are compared by digest; an empty table stays empty; extra columns may have any name.
    """
    docs, back = aside(docs, "__kept_id", "__kept_text", "__rows", "__own_text")
    kept = written(exact_duplicates(docs, id_col, text_col, **options).filter("kept")
                   .select(F.col(id_col).alias("__kept_id"), F.col("text_sha256").alias("__kept_text")), "dedup-kept")
    shared = docs.groupBy(F.col(id_col).alias("__kept_id")).agg(F.count("*").alias("__rows")).filter("__rows > 1").drop("__rows")
    same = F.col(id_col).eqNullSafe(F.col("__kept_id"))
    plain = docs.join(shared, same, "left_anti").join(kept.hint("shuffle_hash"), same, "left_semi")
    told_apart = (docs.join(shared, same, "left_semi").withColumn("__own_text", F.sha2(lower_ascii(F.col(text_col)), 256))
                  .join(kept, same & (F.col("__own_text") == F.col("__kept_text")), "left_semi"))
    return back(plain.unionByName(told_apart.dropDuplicates([id_col, "__own_text"]).drop("__own_text")))


QUERY_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY digest) AS keep_id,
       count(*) OVER (PARTITION BY digest) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY digest) AS kept,
       digest AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz')) AS digest
      FROM documents)
"""
