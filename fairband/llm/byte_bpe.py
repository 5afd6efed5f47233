"""Byte-level BPE encoding and decoding by merge replay over an inverted index.

Every task gathers the distinct pieces of its documents block by block, lays the
pieces it has not seen yet out as one corpus of byte tokens with linked
neighbours, and keeps an inverted index from the rank of a mergeable pair to the
positions where it occurs.  Ranks are replayed in order; a merge touches only the
pair's two neighbours and posts the new pairs they form.  Documents are then
assembled from the encoded pieces.  No text is shuffled.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairband.llm.common import held, python_workers

SPAN = 100_000  # pieces looked at together
CACHED = 300_000  # encoded pieces a worker remembers
SHIFT = 20  # a pair of token ids as one integer


def read_ranks(path: str) -> bytes:
    """The rank file, read once by the driver; its size does not depend on the data."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(rank_file: bytes) -> dict[bytes, int]:
    """Ids by token."""
    return {base64.b64decode(token): int(rank) for token, rank in
            (line.split() for line in rank_file.splitlines() if line.strip())}


class Vocabulary:
    """Ids by token, and the id that each mergeable pair of ids becomes."""

    def __init__(self, rank_file: bytes):
        self.ids = parse_ranks(rank_file)
        self.pairs: dict[int, int] = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << SHIFT | right] = rank
        single = [bytes([b]) for b in range(256)]
        self.byte_ids = np.array([self.ids[b] for b in single])
        self.byte_pairs = np.array([self.ids.get(a + b, -1) for a in single for b in single])


class Decoder:
    """All tokens' bytes end to end, and where each token's begin."""

    def __init__(self, rank_file: bytes):
        tokens = {rank: token for token, rank in parse_ranks(rank_file).items()}
        table = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(t) for t in table])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(lengths.sum()) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.blob[at].tobytes()


def replay(vocabulary: Vocabulary, words: list[bytes]) -> list[list[int]]:
    """Token ids of each word: always the lowest rank first, leftmost first among equals."""
    if not words:
        return []
    lengths = np.array([len(w) for w in words])
    ends = np.cumsum(lengths)
    corpus = np.frombuffer(b"".join(words), np.uint8)
    token = vocabulary.byte_ids[corpus].tolist()
    after = np.arange(1, len(corpus) + 1)
    after[ends - 1] = -1
    before = np.arange(-1, len(corpus) - 1)
    before[ends - lengths] = -1
    owner = np.repeat(np.arange(len(words)), lengths)
    # the rank that each position and its right neighbour would merge to (-1: none)
    merge = np.full(len(corpus), -1)
    merge[:-1] = vocabulary.byte_pairs[corpus[:-1].astype(np.int32) << 8 | corpus[1:]]
    merge[ends - 1] = -1
    found = np.flatnonzero(merge >= 0)
    by_rank = found[np.argsort(merge[found], kind="stable")]
    ranks, first = np.unique(merge[by_rank], return_index=True)
    index = dict(zip(ranks.tolist(), (x.tolist() for x in np.split(by_rank, first[1:])))) if len(found) else {}
    after, before, owner, merge = after.tolist(), before.tolist(), owner.tolist(), merge.tolist()
    pair = vocabulary.pairs.get
    heap = list(index)
    heapify(heap)
    while heap:
        rank = heappop(heap)
        positions = index.pop(rank, None)
        if positions is None:
            continue
        positions.sort()
        waiting, later = -1, []
        for p in positions:
            if merge[p] != rank:
                continue  # a neighbour merged meanwhile
            if waiting >= 0 and owner[p] == waiting:
                later.append(p)
                continue
            q, left = after[p], before[p]
            end = after[q]
            token[p], after[p], merge[q] = rank, end, -1
            if end >= 0:
                before[end] = p
                new = merge[p] = pair(rank << SHIFT | token[end], -1)
                if new >= 0:
                    if (at := index.get(new)) is None:
                        index[new] = [p]
                        heappush(heap, new)
                    else:
                        at.append(p)
                    if new < rank:
                        waiting = owner[p]  # this word goes on with the lower rank first
            else:
                merge[p] = -1
            if left >= 0:
                new = merge[left] = pair(token[left] << SHIFT | rank, -1)
                if new >= 0:
                    if (at := index.get(new)) is None:
                        index[new] = [left]
                        heappush(heap, new)
                    else:
                        at.append(left)
                    if new < rank:
                        waiting = owner[p]
        if later:
            if rank not in index:
                index[rank] = []
                heappush(heap, rank)
            index[rank] += later
    out = []
    for p in (ends - lengths).tolist():
        ids = []
        while p >= 0:
            ids.append(token[p])
            p = after[p]
        out.append(ids)
    return out


class Encoder:
    """Encodes texts; remembers the pieces seen so far, up to a fixed number."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        plain = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")  # the same on ASCII once in brackets
        plain = re.sub(r"(?<!\[)(?<!\\s)(?<!Z)(A-Za-z|0-9)(?=\+)", r"[\1]", plain)
        self.plain = re.compile(plain, re.ASCII) if r"\p" not in plain else self.pattern
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: Iterable[str]) -> None:
        new = {p for p in pieces if p not in self.known}
        if len(self.known) + len(new) > CACHED:
            self.known = {}
            new = set(pieces)
        whole, words = [], []
        for p in new:
            raw = p.encode()
            if (rank := self.vocabulary.ids.get(raw)) is not None:
                whole.append((p, [rank]))  # a piece that is a token stays one
            else:
                words.append((p, raw))
        encoded = replay(self.vocabulary, [raw for _, raw in words])
        for p, ids in [*whole, *zip((p for p, _ in words), encoded)]:
            self.known[p] = struct.pack(f"<{len(ids)}I", *ids)

    def _block(self, texts: list[list[str]]) -> list[bytes]:
        self._learn({p for pieces in texts for p in pieces})
        known = self.known
        return [b"".join([known[p] for p in pieces]) for pieces in texts]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of each text, in blocks of about ``SPAN`` pieces; a long text is a block of its own spans."""
        block, held = [], 0
        for text in texts:
            pattern = self.plain if text.isascii() else self.pattern
            if len(text) > 4 * SPAN:
                yield from self._block(block)
                block, held = [], 0
                matches = (m.group() for m in pattern.finditer(text))
                yield b"".join(self._block([span])[0] for span in iter(lambda: list(islice(matches, SPAN)), []))
                continue
            pieces = pattern.findall(text)
            block.append(pieces)
            held += len(pieces)
            if held >= SPAN:
                yield from self._block(block)
                block, held = [], 0
        yield from self._block(block)


def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return held(("byte_bpe", hash(rank_file), pattern), lambda: Encoder(Vocabulary(rank_file), pattern))


@lru_cache(maxsize=2)
def _decoder(rank_file: bytes) -> Decoder:
    """One decoder per worker process and vocabulary."""
    return Decoder(rank_file)


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col``: the token ids of the whole text as little-endian unsigned 32-bit integers.

    ``pattern`` splits a text into pieces, each encoded separately, without special
    tokens.  Null and empty texts give empty ids.  A column named ``ids_col`` is
    replaced; other columns pass through untouched, empty tables stay empty.
    """
    spark = docs.sparkSession
    python_workers(spark)
    rank_file = spark.sparkContext.broadcast(read_ranks(rank_path))

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(rank_file.value, pattern)
        for texts in batches:
            yield pd.Series(list(encoder.encode(texts)), dtype=object)

    return docs.withColumn(ids_col, ids(F.coalesce(F.col(text_col), F.lit(""))))


def decode(docs: DataFrame, rank_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add ``bytes_col``: the bytes that the packed ids of ``ids_col`` stand for (null ids: no bytes).

    A column named ``bytes_col`` is replaced; other columns pass through untouched, rows are
    decoded whole and each for itself, empty tables stay empty.
    """
    spark = docs.sparkSession
    python_workers(spark)
    rank_file = spark.sparkContext.broadcast(read_ranks(rank_path))

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = _decoder(rank_file.value)
        for packed in batches:
            yield pd.Series([decoder.decode(x) for x in packed], dtype=object)

    return docs.withColumn(bytes_col, decoded(F.coalesce(F.col(ids_col), F.lit(b""))))


def token_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Encode, decode, and reduce both to digests: ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    One row per input row, with null or repeated ids too; null texts are empty and have no ids; texts are
    encoded whole, however long; other columns are not read; an empty table gives an empty result.
    """
    both = decode(encode(docs.select(id_col, text_col), rank_path, pattern, text_col), rank_path)
    return both.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
