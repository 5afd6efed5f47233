import hashlib
import re

import pytest

from fairband.llm.mixing import mix
from llm_rows import SCHEMA, edge_documents, edge_rows, empty_documents, with_clashes


def targets(sizes, weights=(3, 1, 2), share=1.5):
    """By water filling, one source stopping at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = budget - sum(full.values())
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: 2.0 * sizes[s] for s in over}


def brute(data):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s, _ in data]
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes)
    lot = lambda d: (hashlib.md5(("mix" if d[0] is None else f"mix:{d[0]}").encode()).hexdigest(), d[0] is not None, d[0] or 0, d[2])
    copies, out = [], []
    for s in sizes:
        total = 0
        for d in sorted((d for d in docs if d[1] == s), key=lot):
            total += d[2]
            k = len(out)
            out.append([d[0], d[2], sizes[s], want[s], 0])
            if d[2]:
                copies += [((total + c * sizes[s]) / want[s], lot(d), k) for c in (0, 1)]
    mixed = 0
    for _, _, k in sorted(copies):
        mixed += out[k][1]
        if mixed <= sum(want.values()):
            out[k][4] += out[k][1]
    return out


@pytest.mark.parametrize("extra", [[], [(900 + i, "word " * (i % 7), "en", "b", 1) for i in range(600)]])
def test_against_brute_force(spark, extra):
    data = edge_rows() + extra
    docs = with_clashes(spark.createDataFrame(data, SCHEMA), "size", "rank", "target", "finish", "lot")
    got = sorted(map(tuple, mix(docs).collect()), key=repr)
    want = sorted(map(tuple, brute(data)), key=repr)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want))


def test_sources_come_near_their_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)


def test_no_words_and_no_rows(spark):
    assert mix(empty_documents(spark)).count() == 0
    silent = spark.createDataFrame([(1, None, "en", "a", 1), (2, " ", "en", None, 1)], SCHEMA)
    assert sorted((r.doc_id, r.taken) for r in mix(silent).collect()) == [(1, 0), (2, 0)]
