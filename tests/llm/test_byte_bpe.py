import base64
import hashlib

import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fairband.llm import byte_bpe
from llm_rows import edge_documents, edge_rows, empty_documents, with_clashes

PATH = P.path("byte_bpe_50k.tiktoken")


def reference(path=PATH):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.read_ranks(PATH))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="abetino ", max_size=200), max_size=8))
def test_any_text_as_the_library(texts):
    own = byte_bpe.Encoder(byte_bpe.Vocabulary(byte_bpe.read_ranks(PATH)) if not hasattr(reference, "v") else reference.v, P.PATTERN)
    reference.v = own.vocabulary
    reference.e = getattr(reference, "e", None) or reference()
    packed = list(own.encode(texts))
    assert [list(memoryview(p).cast("I")) for p in packed] == [reference.e.encode_ordinary(t) for t in texts]


def test_a_lower_rank_that_appears_late_goes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"yz": 300, b"xyz": 256, b"wx": 299, b"wxyz": 257, b"xx": 301}
    lines = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
    lib = tiktoken.Encoding("t", pat_str=r"(?s).+", mergeable_ranks={t: i for i, (t, _) in enumerate(sorted(ranks.items(), key=lambda x: x[1]))}, special_tokens={})
    order = {r: i for i, (_, r) in enumerate(sorted(ranks.items(), key=lambda x: x[1]))}
    words = [b"wxyzxxyz", b"xxxxx", b"wxwxyz", b"yzyzxyz", b"xyzxyzxyzwxyz"]
    got = byte_bpe.replay(byte_bpe.Vocabulary(lines), words)
    assert [[order[i] for i in ids] for ids in got] == [lib.encode_ordinary(w.decode()) for w in words]


def test_white_space_of_the_pattern():
    # the characters that the splitting pattern's \s stands for in the library
    spaces = {c for c in range(0x3001) if regex.match(r"\s", chr(c))}
    assert spaces == {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def test_edge_rows_round_trip(spark):
    lib = reference()
    docs = with_clashes(edge_documents(spark), "ids", "decoded")
    got = sorted((tuple(r) for r in byte_bpe.token_digests(docs, PATH, P.PATTERN).collect()), key=repr)
    want = []
    for doc_id, text, *_ in edge_rows():
        ids = lib.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_documents_table_as_the_library(spark, sf_dir):
    lib = reference()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = byte_bpe.encode(docs.select("doc_id", "text"), PATH, P.PATTERN)
    for r in ids.collect():
        assert list(memoryview(r.ids).cast("I")) == lib.encode_ordinary(r.text)


def test_long_text_in_spans_and_forgotten_pieces(monkeypatch, vocabulary):
    monkeypatch.setattr(byte_bpe, "SPAN", 50)
    monkeypatch.setattr(byte_bpe, "CACHED", 60)
    lib, text = reference(), " ".join(f"word{i} aaaa{'b' * (i % 9)}" for i in range(400))
    own = byte_bpe.Encoder(vocabulary, P.PATTERN)
    assert [list(memoryview(p).cast("I")) for p in own.encode([text, "", text[:150]])] == [
        lib.encode_ordinary(t) for t in (text, "", text[:150])]


def test_empty_table(spark):
    assert byte_bpe.token_digests(empty_documents(spark), PATH, P.PATTERN).count() == 0
