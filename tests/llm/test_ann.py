import math

import numpy as np
from pyspark.sql import functions as F

from fairband.llm import ann
from llm_rows import with_clashes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, k=5, by=50):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in data
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in ok:
        if i % by == 0:
            near = {(-float((q * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))), j) for j, v in ok if j != i and len(v) == len(q)}
            out += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(near)[:k], start=1)]
    return sorted(set(out))


def agree(got, want):
    got = sorted(tuple(r) for r in got.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))


def test_awkward_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    data += [(100, data[0][1]), (101, data[0][1]), (102, data[0][1]), (103, None), (104, [0.0] * 6), (105, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (106, [math.nan] * 6), (107, [math.inf] + [0.0] * 5), (108, []), (150, [1.0, 2.0]), (151, [2.0, 1.0]), (None, data[1][1]),
             (200, [3.0]), (7, data[7][1]), (250, data[0][1]), (250, data[0][1])]
    df = with_clashes(spark.createDataFrame([(i, v, 1) for i, v in data], SCHEMA), "query", "size", "rank", "score", "block", "id")
    agree(ann.nearest(df, F.col("vec_id") % 50 == 0), brute(data))
    agree(ann.nearest(df, F.col("vec_id") % 50 == 0, block=10, query_block=1), brute(data))


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0], 1)], SCHEMA)
    assert ann.nearest(one, F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(one.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    data = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])]
    agree(ann.nearest(spark.createDataFrame([(i, v, 1) for i, v in data], SCHEMA), F.col("vec_id") % 50 == 0), brute(data))


def test_posted_ranks_give_the_footrule():
    rng = np.random.default_rng(1)
    rows, pivots = ann._unit(rng.normal(size=(40, 8))), ann._unit(rng.normal(size=(20, 8)))
    perms = ann.permutations(rows, pivots, 7)
    rank = np.full((40, 20), 7)
    np.put_along_axis(rank, perms, np.arange(7)[None, :], axis=1)
    agreed = np.zeros(40, int)
    for r, p in enumerate(perms[0]):
        at, ranks = ann.posting_lists(perms, 20)[p]
        agreed[at] += 7 - np.maximum(ranks, r)
    assert (np.abs(rank - rank[0]).sum(axis=1) == 2 * sum(range(1, 8)) - 2 * agreed).all()


def test_recall_on_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()]
    assert len(got) == len(want)
    found = {(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in want}
    assert len(found) >= 0.95 * len(want)
    exact = {(w[0], w[2]): w[3] for w in want}
    assert all(abs(g[3] - exact[g[0], g[2]]) < 1e-12 for g in got if (g[0], g[2]) in exact)
