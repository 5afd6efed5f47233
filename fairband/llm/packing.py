"""Cost-balanced packing of token ids into training sequences.

A document's step costs a linear part (its tokens pass every layer) and a quadratic
part (attention inside the document).  Documents are gathered, in the order in which
a task reads them, into loads of some hundred sequences; inside a load they go,
longest first, each to the sequence of least cost so far that has room for it.
The sequences of a load hold exactly its tokens: full ones, and for what is left
over one for every power of two in that number, so nothing is padded.  Loads are
made where the texts are read: neither texts nor ids are shuffled.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fairband.llm.common import held, python_workers

CAPACITY = 2048
LOAD = 256  # full sequences that a load has tokens for, about
QUADRATIC = 1 / 4096  # a document of 4,096 tokens costs as much for attention as for the rest
END = 1  # id that closes a document
CACHED = 1 << 20  # words whose ids a worker remembers

FOREIGN = re.compile("[^\x00-\u02ff]").search  # texts with such characters are split by the library
AHEAD = 1 << 20  # characters that are split before their new words are learned


def _characters(category: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x370) if unicodedata.category(chr(c))[0] == category)


class WordEncoder:
    """Ids of whole texts as the library gives them, word by word and remembering words.

    The vocabulary lower-cases, drops white space and encodes every word by
    itself.  Texts of Latin characters are split here with the same pattern; the
    library encodes the words not seen yet.  Texts with other characters, or with
    the strings of special tokens, go to the library whole.
    """

    def __init__(self, tokenizer_json: str):
        self.library = Tokenizer.from_str(tokenizer_json)
        settings = json.loads(tokenizer_json)
        # the same vocabulary for words that are lower-cased and split already, one a line
        settings |= {"normalizer": None, "added_tokens": []}
        settings["pre_tokenizer"]["pretokenizers"][0] = {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False}
        self.lines = Tokenizer.from_str(json.dumps(settings))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters, digits, spaces = _characters("L"), _characters("N"), r"\t-\r \x85\xa0"
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+").findall
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        encoded = self.lines.encode("\n".join(words), add_special_tokens=False)
        ids, of = np.array(encoded.ids, "<u4").tobytes(), np.array(encoded.word_ids)
        cuts = (4 * np.flatnonzero(np.diff(of, prepend=-1))).tolist()
        if len(cuts) != len(words):
            self.known.update((w, self._whole(w)) for w in words)
        else:
            self.known.update(zip(words, (ids[a:b] for a, b in zip(cuts, [*cuts[1:], len(ids)]))))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of every text; new words are learned for about a megabyte of text at a time."""
        ahead, size = [], 0
        for text in texts:
            whole = FOREIGN(text) or any(s in text for s in self.special)
            words = None if whole else self.words(text.lower())
            ahead.append((text if whole else None, words))
            size += len(text)
            if size >= AHEAD:
                yield from self._known(ahead)
                ahead, size = [], 0
        yield from self._known(ahead)

    def _known(self, split: list[tuple]) -> Iterator[bytes]:
        if len(self.known) > CACHED:
            self.known.clear()
        found = [words and list(map(self.known.get, words)) for _, words in split]
        new = {w for (_, words), ids in zip(split, found) if ids and None in ids for w, x in zip(words, ids) if x is None}
        if new:
            self._learn(list(new))
        for (text, words), ids in zip(split, found):
            if words is None:
                yield self._whole(text)
            else:
                known = self.known  # looked up again only where a word was new: most of the time goes into such looks
                yield b"".join([known[w] if x is None else x for w, x in zip(words, ids)] if None in ids else ids)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def _encoder(tokenizer_json: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    return held(("words", hash(tokenizer_json)), lambda: WordEncoder(tokenizer_json))


def cost(length, quadratic: float = QUADRATIC):
    """Estimated cost of a piece: linear in its tokens, and quadratic for attention inside it."""
    return length + quadratic * length * length


def capacities(tokens: int, capacity: int) -> np.ndarray:
    """Sizes of sequences that hold ``tokens`` without padding: full ones, then powers of two."""
    full, rest = divmod(tokens, capacity)
    return np.array([capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def balance(lengths: np.ndarray, capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Place documents of these lengths: ``(document, start, length, sequence, offset)`` per piece.

    A document's whole multiples of ``capacity`` are sequences of their own.  The
    rests go longest first (ties: in the given order) to the sequence of least
    cost that has room for them; one that fits nowhere is cut over the cheapest
    sequences with room.
    """
    pieces, sequences = [], 0
    for i in np.flatnonzero(lengths >= capacity).tolist():
        for start in range(0, int(lengths[i]) // capacity * capacity, capacity):
            pieces.append((i, start, capacity, sequences, 0))
            sequences += 1
    rests = lengths % capacity
    sizes = capacities(int(rests.sum()), capacity)
    room, costs = sizes.copy(), np.zeros(len(sizes))
    for i in np.argsort(-rests, kind="stable").tolist():
        left = int(rests[i])
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            s = int(np.where(fits, costs, np.inf).argmin())
            length = min(left, int(room[s]))
            pieces.append((i, int(lengths[i]) - left, length, sequences + s, int(sizes[s] - room[s])))
            room[s] -= length
            costs[s] += cost(length, quadratic)
            left -= length
    return pieces


OUT = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, load: int = LOAD, quadratic: float = QUADRATIC,
         end_id: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the token ids of all documents, placed in sequences of ``capacity`` ids.

    Returns per piece ``id_col``, ``start`` (ids of its document before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens`` (with the
    closing ``end_id``, if any), ``sequence_id``, ``offset`` (in the sequence, gapless from 0)
    and ``cost``.  Every id lies in one piece.  A sequence holds ``capacity`` ids
    or a power of two of them.

    Null and empty texts have the closing id alone (no rows where there is none); rows with null or repeated ids, and
    repeated texts, are documents like others; texts are encoded whole, however long, and the longest
    are cut at every ``capacity`` ids.  Ties in length keep the order of reading.  An empty table gives an empty
    result; other columns are not read.  Sequence ids hold the number of the reading partition,
    so the same files and split sizes give the same result, also after a lost executor.
    """
    spark = docs.sparkSession
    python_workers(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a fixed file of some MB
    closing = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def place(held: list[tuple], first: int) -> tuple[pd.DataFrame, int]:
        pieces = balance(np.array([len(ids) // 4 for _, ids in held], np.int64), capacity, quadratic)
        out = pd.DataFrame({
            "id": pd.Series([held[i][0] for i, *_ in pieces], dtype=object),
            "start": [p[1] for p in pieces], "length": [p[2] for p in pieces],
            "ids": [held[i][1][4 * start:4 * (start + n)] for i, start, n, *_ in pieces],
            "doc_tokens": [len(held[p[0]][1]) // 4 for p in pieces],
            "sequence_id": [first + p[3] for p in pieces], "offset": [p[4] for p in pieces],
            "cost": [cost(p[2], quadratic) for p in pieces]})
        return out, first + 1 + max((p[3] for p in pieces), default=-1)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary.value)
        sequence, held, tokens = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for doc_id, ids in zip(batch["id"].astype(object).where(batch["id"].notna(), None), encoder.encode_all(batch["text"])):
                held.append((doc_id, ids + closing))
                tokens += len(held[-1][1]) // 4
                if tokens >= load * capacity:
                    out, sequence = place(held, sequence)
                    yield out
                    held, tokens = [], 0
        if held:
            yield place(held, sequence)[0]

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(packed, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)
