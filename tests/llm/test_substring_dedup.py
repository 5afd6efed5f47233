import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fairband.llm import substring_dedup as S
from llm_rows import SCHEMA, edge_documents, edge_rows, empty_documents, with_clashes


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(n))


def test_hash_is_the_rolling_one():
    raw = np.random.default_rng(0).integers(0, 256, 300).astype(np.uint8)
    last, want = [], []
    for b in raw.tolist():
        last = (last + [b])[-S.WINDOW:]
        want.append(sum(int(S.GEAR[x]) << k for k, x in enumerate(reversed(last))) & 0xFFFFFFFF)
    assert S.gear_hashes(raw).tolist() == want and S.gear_hashes(raw[:5]).tolist() == want[:5]


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=900))
def test_chunks_cover_the_text_in_whole_characters(text):
    data = text.encode("utf-8", "ignore")
    if data:
        ends = S.chunk_ends(np.frombuffer(data, np.uint8))
        assert ends[-1] == len(data) and ends == sorted(set(ends))
        for a, b in zip([0, *ends], ends):
            data[a:b].decode()
            assert b - a <= S.MOST_BYTES + 3


def test_insertion_moves_few_cuts():
    rng = np.random.default_rng(5)
    a = words(rng, 800).encode()
    b = a[:700] + b"inserted here " + a[700:]

    def cut(x):
        ends = S.chunk_ends(np.frombuffer(x, np.uint8))
        return {x[i:j] for i, j in zip([0, *ends], ends)}

    assert len(cut(a) - cut(b)) <= 4


def brute(data, least=S.LEAST_WORDS):
    """The same passages by plain dictionaries."""
    docs, holders = [], defaultdict(set)
    for doc, text, *_ in data:
        doc, raw = S.NO_ID if doc is None else doc, (text or "").encode()
        ends = S.chunk_ends(np.frombuffer(raw, np.uint8)) if raw else []
        parts = [(a, raw[a:b]) for a, b in zip([0, *ends], ends)]
        docs.append((doc, raw, parts))
        for _, p in parts:
            holders[hashlib.sha256(p).digest()].add(doc)
    out = set()
    for doc, raw, parts in docs:
        run = []
        for a, p in [*parts, (None, None)]:
            owners = holders[hashlib.sha256(p).digest()] if p is not None else ()
            if len(owners) > 1:
                run.append((a, p, min(owners)))
                continue
            n = sum(1 for a_, p_, _ in run for i in range(a_, a_ + len(p_))
                    if raw[i:i + 1] not in b" \t\n\v\f\r" and (i == 0 or raw[i - 1:i] in b" \t\n\v\f\r"))
            if run and n >= least:
                first = min(r[2] for r in run)
                out.add((None if doc == S.NO_ID else doc, run[0][0], sum(len(r[1]) for r in run), n, len(run),
                         None if first == S.NO_ID else first, sum(len(r[1]) for r in run if r[2] < doc)))
            run = []
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    passage, common = words(rng, 60), words(rng, 40)
    data = edge_rows() + [(500 + i, f"{words(rng, 80)} {passage if i % 3 == 0 else ''} {words(rng, 30)} {common if i % 2 else ''}", "en", "a", 1)
                          for i in range(60)]
    docs = with_clashes(spark.createDataFrame(data, SCHEMA), "doc", "row", "seq", "digest", "start", "run")
    got = {tuple(r) for r in S.repeated_passages(docs).collect()}
    assert got == brute(data)
    flagged = {g[0] for g in got}
    assert {500 + i for i in range(60) if i % 3 == 0} <= flagged and 502 not in flagged


def test_on_the_documents_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {tuple(r) for r in S.repeated_passages(docs).collect()} == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_what_is_dropped_stays_once(spark):
    rng = np.random.default_rng(2)
    passage = words(rng, 70)
    data = [(i, f"{words(rng, 40)} {passage} {words(rng, 40)}", "en", "a", 1) for i in range(5)] + [(9, None, "en", "a", 0)]
    docs = spark.createDataFrame(data, SCHEMA)
    left = {r.doc_id: r.text for r in S.drop_repeats(docs).collect()}
    assert left[0] == data[0][1] and left[9] is None and S.drop_repeats(docs).columns == docs.columns
    assert all(len(left[i]) < len(data[i][1]) - 250 and data[i][1].startswith(left[i][:150]) for i in range(1, 5))


def test_empty_table(spark):
    assert S.repeated_passages(empty_documents(spark)).count() == 0


def test_dropped_repeats_with_null_and_repeated_ids(spark):
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(120))
    data = [(1, "first " + passage, "en", "a", 1), (None, passage + " no id", "en", "a", 1), (7, "seventh " + passage + " end", "en", "a", 1),
            (7, "seventh " + passage + " end", "en", "a", 1), (8, None, None, None, None), (9, "", "en", "a", 0)]
    docs = with_clashes(spark.createDataFrame(data, SCHEMA), "__cut", "__cut_id")
    out = S.drop_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(data)
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r.text)
    assert got[None] == [data[1][1]]  # a null id is the smallest, so it keeps the passage
    assert len(got[1][0]) < len(data[0][1]) and got[7][0] == got[7][1] and len(got[7][0]) < len(data[2][1])
    assert got[8] == [None] and got[9] == [""]
    assert S.drop_repeats(docs.limit(0)).count() == 0
