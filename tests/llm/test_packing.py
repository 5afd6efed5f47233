import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fairband.llm import packing
from fairband.llm.queries import QUERIES
from llm_rows import edge_documents, edge_rows, empty_documents, with_clashes

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = packing.WordEncoder(open(PATH, encoding="utf-8").read())


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aZß'sİÿΣ \t\x1c\x85́.9½²'<|endoftext>", max_size=120))
def test_any_text_as_the_library(text):
    assert list(np.frombuffer(OWN.encode(text), "<u4")) == library_ids(text)[:-1]


def test_special_strings_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 2)
    for text in ("a <|endoftext|> b", "İstanbul don't WE'LL...'s", "one two three four", "one five two six", "x" * 5000, "naïve ½ café  1999"):
        assert list(np.frombuffer(OWN.encode(text), "<u4")) == library_ids(text)[:-1]


def whole(pieces, documents, capacity):
    """Pieces as (document key, start, length, sequence, offset): every id once, sequences gapless and without padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in pieces:
        assert length > 0
        by_doc[doc].append((start, length))
        by_seq[sequence].append((offset, length))
    assert {d: n for d, n in documents.items() if n} == {d: sum(n for _, n in parts) for d, parts in by_doc.items()}
    for parts in [*by_doc.values(), *by_seq.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    sizes = [sum(n for _, n in parts) for parts in by_seq.values()]
    assert all(n == capacity or n < capacity and n & (n - 1) == 0 for n in sizes)
    return sizes


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=60), st.sampled_from([8, 32, 64]))
def test_balance_is_whole(lengths, capacity):
    pieces = packing.balance(np.array(lengths, np.int64), capacity)
    sizes = whole(pieces, dict(enumerate(lengths)), capacity)
    assert sum(1 for n in sizes if n < capacity) < capacity.bit_length()


def greedy(lengths, capacity, quadratic):
    """The same rule with plain lists, for lengths below the capacity."""
    sizes = packing.capacities(sum(lengths), capacity).tolist()
    room, costs, out = list(sizes), [0.0] * len(sizes), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        left = lengths[i]
        while left:
            able = [s for s in range(len(sizes)) if room[s] >= left] or [s for s in range(len(sizes)) if room[s] > 0]
            s = min(able, key=lambda s: (costs[s], s))
            n = min(left, room[s])
            out.append((i, lengths[i] - left, n, s, sizes[s] - room[s]))
            room[s] -= n
            costs[s] += n + quadratic * n * n
            left -= n
    return out


def test_least_cost_sequence_with_room():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 64, rng.integers(1, 80)).tolist()
        assert packing.balance(np.array(lengths), 64, 0.01) == greedy(lengths, 64, 0.01)


def test_costs_are_more_even_than_first_fit():
    lengths = np.random.default_rng(2).lognormal(5, 1, 3000).astype(np.int64).clip(1, 1000)  # no rest fills a sequence by itself

    def spread(pieces):
        costs = defaultdict(float)
        for _, _, n, s, _ in pieces:
            costs[s] += packing.cost(n)
        full = sorted(costs.values())[12:]
        return np.std(full)

    room, fitted = [], []
    for i in np.argsort(-lengths):
        s = next((s for s, r in enumerate(room) if r >= lengths[i]), None)
        if s is None:
            s = len(room)
            room.append(2048)
        fitted.append((i, 0, int(lengths[i]), s, 0))
        room[s] -= lengths[i]
    assert spread(packing.balance(lengths)) < 0.6 * spread(fitted)


def test_edge_rows(spark):
    docs = with_clashes(edge_documents(spark), "start", "length", "ids", "id", "cost", "offset")
    got = packing.pack(docs, PATH, capacity=256, load=3).collect()
    want = sorted(((r[0], tuple(library_ids(r[1]))) for r in edge_rows()), key=repr)
    assert sum(len(ids) for _, ids in want) == sum(r["length"] for r in got)
    ids_of, texts = {k: v for k, v in want if k not in (None, 11)}, defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        if r["doc_id"] in ids_of:
            texts[r["doc_id"]].append((r["start"], r["ids"]))
            assert r["doc_tokens"] == len(ids_of[r["doc_id"]])
    assert {k: tuple(np.frombuffer(b"".join(b for _, b in sorted(v)), "<u4")) for k, v in texts.items()} == ids_of
    assert sorted(r["doc_tokens"] for r in got if r["doc_id"] is None and r["start"] == 0) == sorted(len(v) for k, v in want if k is None)
    by_seq = defaultdict(int)
    for r in got:
        by_seq[r["sequence_id"]] += r["length"]
    assert all(n == 256 or n & (n - 1) == 0 for n in by_seq.values())
    assert packing.pack(empty_documents(spark), PATH).count() == 0
    none = packing.pack(docs.filter("text is null or text = ''"), PATH, end_id=None)
    assert none.count() == 0


def test_query(spark, sf_dir):
    rows = QUERIES["op11_packing"](spark, sf_dir).collect()
    docs = {r.doc_id: library_ids(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}
    whole([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows], {d: len(i) for d, i in docs.items()}, 2048)
    for r in rows:
        part = np.array(docs[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(docs[r.doc_id])
