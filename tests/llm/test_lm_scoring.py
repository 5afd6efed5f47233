import math
import re
from collections import Counter

from fairband.llm import lm_scoring as L
from llm_rows import SCHEMA, edge_documents, edge_rows, empty_documents, with_clashes


def brute(data):
    texts = [[w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
              for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")] for r in data]
    grams = lambda t: Counter(tuple(t[i:i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1))
    each = [grams(t) for t in texts]
    total = sum(each, Counter())
    words, out = sum(map(len, texts)), []
    for r, t, own in zip(data, texts, each):
        n = lambda *g: total[g] - own[g]
        s = 0.0
        for i, c in enumerate(t):
            if i > 1 and n(t[i - 2], t[i - 1], c):
                s += math.log(n(t[i - 2], t[i - 1], c) / n(t[i - 2], t[i - 1]))
            elif i > 0 and n(t[i - 1], c):
                s += math.log((0.4 if i > 1 else 1) * n(t[i - 1], c) / n(t[i - 1]))
            else:
                s += math.log(0.4 ** min(i, 2) * max(n(c), 0.5) / max(words - len(t), 1))
        out.append((r[0], len(t), s, s / len(t) if t else None))
    return sorted(out, key=repr)


def agree(got, want):
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 4))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert abs(g[2] - w[2]) < 1e-4 and (g[3] is None) == (w[3] is None) and abs((g[3] or 0) - (w[3] or 0)) < 2e-6


def test_against_brute_force(spark):
    docs = with_clashes(edge_documents(spark), "block", "table", "n_words", "id", "words")
    agree(L.lm_scores(docs), brute(edge_rows()))
    agree(L.lm_scores(docs, block_bytes=5000, table_bytes=3000), brute(edge_rows()))


def test_hot_text_and_counts_over_255(spark):
    data = [(i, "the same few words again", "en", "a", 1) for i in range(900)] + edge_rows()
    agree(L.lm_scores(spark.createDataFrame(data, SCHEMA), block_bytes=4000), brute(data))


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(1, "alone here", "en", "a", 1)], SCHEMA)
    agree(L.lm_scores(one), brute([(1, "alone here")]))
    assert L.lm_scores(empty_documents(spark)).count() == 0


def test_packed_keys():
    import numpy as np
    low = np.array([0, 1, 255, 256, 70_000, (1 << 40) - 1], np.uint64)
    assert (L._unpack(L._pack(low)) == low).all()
