"""Repeated passages by content-defined chunking.

A gear rolling hash over the last 16 bytes cuts every text where it is largest in
its neighbourhood, so the cuts follow the content alone: an insertion moves only
the chunks it touches.  Chunks are deduplicated by digest over the whole corpus, and
runs of neighbouring repeated chunks make the passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairband.llm.common import aside, python_workers, written

WINDOW = 16  # bytes that the hash depends on
REACH = 16  # a cut's hash is the largest of so many bytes on either side
MOST_BYTES = 256
GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, 256, dtype=np.uint32)
LEAST_WORDS = 20  # of a passage, in whole chunks
NO_ID = -(1 << 63)
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\v\f\r")] = True


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte: sum of the last 16 bytes' gears, the k-th last shifted left by k."""
    h = GEAR[raw]
    for span in (1, 2, 4, 8):
        earlier = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += earlier
    return h


def cuts(raw: np.ndarray) -> np.ndarray:
    """Positions after the bytes whose hash is the largest within ``REACH`` bytes: 33 bytes apart on average, 17 at least."""
    h = gear_hashes(raw)
    edge = np.zeros(REACH, h.dtype)
    most = np.concatenate((edge, h, edge))
    for span in (1, 2, 4, 8):
        most = np.maximum(most[:-span], most[span:])  # of 16 neighbours in the end
    found = np.flatnonzero((h > most[:len(h)]) & (h >= most[REACH + 1:])) + 1
    return found[(found > REACH) & (found <= len(h) - REACH)]


def chunk_ends(raw: np.ndarray) -> list[int]:
    """Ends of the chunks: the cuts, and more after every 256 bytes without one.

    Ends move to the next start of a character, so every chunk is valid UTF-8.
    """
    size = len(raw)
    inner = (raw & 0xC0) == 0x80
    at = cuts(raw)
    for _ in range(3):
        at = at + inner[at]
    ends, last = [], 0
    for cut in [*at.tolist(), size]:
        while cut - last > MOST_BYTES:
            last += MOST_BYTES
            while last < size and inner[last]:
                last += 1
            ends.append(last)
        if cut > last:
            last = cut
            ends.append(last)
    return ends


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, row, seq, start, bytes, words, digest)`` of every chunk of every whole text.

    ``doc`` is the id (a null one: the smallest long), ``row`` tells rows apart that
    share it, ``words`` counts the words that begin in the chunk, ``digest`` is a
    64-bit digest of its bytes.
    """
    python_workers(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            digests = []
            for doc, row, text in zip(batch["doc"], batch["row"], batch["text"]):
                data = text.encode()
                if not data:
                    continue
                raw = np.frombuffer(data, np.uint8)
                ends = chunk_ends(raw)
                starts = [0, *ends[:-1]]
                digests += [hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(starts, ends)]
                space = SPACE[raw]
                begun = np.cumsum(~space & np.concatenate(([True], space[:-1])))
                at, n = np.array(ends), len(ends)
                for to, values in zip(out, (np.full(n, doc), np.full(n, row), np.arange(n), starts, at - starts,
                                            np.diff(begun[at - 1], prepend=0))):
                    to.append(values)
            if digests:
                yield pd.DataFrame(dict(zip(("doc", "row", "seq", "start", "bytes", "words"), map(np.concatenate, out)))
                                   | {"digest": np.frombuffer(b"".join(digests), "<i8")})

    return (docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("doc"), F.monotonically_increasing_id().alias("row"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .mapInPandas(cut, "doc long, row long, seq int, start int, bytes int, words int, digest long"))


def repeated_chunks(parts: DataFrame) -> DataFrame:
    """The chunks whose digest occurs in two or more documents, with ``first_doc``, the smallest of them.

    Digests are reduced before they are shuffled.  Only digests of several
    documents remain for the join; where one of those is so common that its chunks
    fill a partition, adaptive execution splits that partition.
    """
    several = (parts.groupBy("digest").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
               .filter("first_doc <> last_doc").drop("last_doc"))
    return parts.join(several, "digest")


def _runs(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """Runs of neighbouring repeated chunks with at least ``least_words`` words, and the parts that an earlier document holds."""
    found = repeated_chunks(written(chunks(docs, id_col, text_col), "chunks"))
    in_text = Window.partitionBy("doc", "row").orderBy("seq")
    return (found.withColumn("run", F.col("seq") - F.row_number().over(in_text))
            .withColumn("part", F.when(F.col("first_doc") < F.col("doc"), F.struct("start", "bytes")))
            .groupBy("doc", "row", "run").agg(
                F.min("start").alias("start"), F.sum("bytes").alias("bytes"), F.sum("words").alias("words"),
                F.count("*").alias("chunks"), F.min("first_doc").alias("first_doc"), F.collect_list("part").alias("parts"))
            .filter(F.col("words") >= least_words))


def _id(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages of at least ``least_words`` words, in whole chunks, that other documents hold too.

    Returns one row per passage: ``id_col``, ``start`` and ``bytes`` (UTF-8 offsets),
    ``words``, ``chunks``, ``first_doc_id`` (smallest id that holds a chunk of it) and
    ``removed_bytes`` (what is left out if every chunk stays in its first document
    only).  Documents without such a passage have no row.  Null and empty texts have
    no chunks; rows that repeat an id are one document; a null id counts as the
    smallest.  Other columns are not read; an empty table gives an empty result.
    """
    removed = F.aggregate("parts", F.lit(0).cast("long"), lambda total, x: total + x["bytes"])
    return _runs(docs, id_col, text_col, least_words).select(
        _id("doc").alias(id_col), "start", "bytes", "words", "chunks", _id("first_doc").alias("first_doc_id"),
        removed.alias("removed_bytes")).distinct()


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with every chunk of a repeated passage left in its first document only; other columns unchanged, whatever their names.

    Null and empty texts stay as they are; a null id is an id; rows that repeat an id are one document
    and lose the same bytes; very long texts are cut like others; an empty table stays empty.
    """
    docs, back = aside(docs, "__cut_id", "__cut")
    python_workers(docs.sparkSession)
    later = (_runs(docs, id_col, text_col, least_words).filter(F.size("parts") > 0)
             .select(_id("doc").alias("__cut_id"), F.explode("parts").alias("part")).groupBy("__cut_id")
             .agg(F.collect_set("part").alias("__cut")))

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, cuts):
            if spans is not None and text is not None:
                data = text.encode()
                for span in sorted(spans, key=lambda s: -s["start"]):
                    data = data[:span["start"]] + data[span["start"] + span["bytes"]:]
                text = data.decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    names = [without(F.col(text_col), F.col("__cut")).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return back(docs.join(later, F.col(id_col).eqNullSafe(F.col("__cut_id")), "left").select(*names))
