import math
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from fairband.llm import hard_negatives as H
from fairband.llm.queries import ORACLE, QUERIES
from llm_rows import with_clashes

SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(data, by=50):
    rows = set()
    for i, v, label in data:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = tuple(math.floor(256 * float(np.float32(x))) for x in v)
            if sum(x * x for x in v) <= 2**53:
                rows.add((i, (label + 1) % 10 if i % 7 == 0 else label, v))
    out = []
    for i, label, v in rows:
        if i % by == 0:
            score = {(sum(a * b for a, b in zip(v, w)), j, l) for j, l, w in rows if j != i and len(w) == len(v)}
            for p, j, _ in sorted((s for s in score if s[2] == label), key=lambda s: (-s[0], s[1]))[:5]:
                fit = sorted((-n, k) for n, k, l in score if l != label and 50 * p <= 100 * n <= 95 * p)
                out += [(i, j, r, k, p, -n) for r, (n, k) in enumerate(fit[:3], start=1)]
    return sorted(out)


def mined(df, by=50, **kw):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % by == 0, label, **kw).select(*NAMES).collect())


def clustered(seed, n, size, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    return [(i, (centres[i % clusters] + 0.4 * rng.normal(size=size)).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def test_against_brute_force_with_one_and_many_blocks(spark):
    data = clustered(1, 700, 8)
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(data, 10)
    assert len(want) > 300
    assert mined(df, 10) == want
    assert mined(df, 10, sample=50, cell_rows=40, block=30, page=16) == want


def test_awkward_rows(spark):
    data = clustered(2, 120, 5)
    data += [(200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0], 1), (202, [math.nan] * 5, 1), (203, [math.inf] * 5, 1), (204, data[0][1], None),
             (None, data[0][1], 1), (250, [0.0] * 5, 1), (251, [0.0] * 5, 1), (252, [0.0] * 5, 2), (300, [1e30] * 5, 1), (301, [], 1), (350, [], 2), (302, [], 3),
             (400, [1.0, 2.0], 1), (401, [2.0, 1.0], 1), (402, [1.5, 1.0], 2), (403, [1.0, 1.0], 3), (450, data[0][1], 1), (450, data[0][1], 1),
             (450, data[3][1], 2), (7, data[7][1], 1), (-50, data[1][1], 2), (500, [3.0], 1)] + [(600 + i, data[5][1], 3) for i in range(60)]
    df = with_clashes(spark.createDataFrame(data, SCHEMA), "id", "key", "size", "norm", "anchor", "cell", "rank", "score", "vector")
    want = brute(data)
    assert mined(df) == want
    assert mined(df, sample=3, cell_rows=2, block=7, page=2) == want
    assert mined(df.limit(0)) == []
    assert mined(df.filter("vec_id = 0")) == []


def test_tree_covers_and_nests():
    rng = np.random.default_rng(3)
    rows = np.vstack([np.floor(256 * rng.normal(size=(500, 6))), np.full((90, 6), 7.0)])
    units = H.augmented(rows, float((rows * rows).sum(axis=1).max()))
    assert np.allclose((units * units).sum(axis=1), 1)
    order, nodes, radii = H.cover_tree(units, fanout=4, leaf=8)
    assert sorted(order) == list(range(len(rows)))
    inside = defaultdict(list)
    for n, ((start, end, parent, leaf), radius) in enumerate(zip(nodes, radii)):
        assert (np.arccos(np.clip(units[order[start:end]] @ units[order[start]], -1, 1)) <= radius).all()
        inside[parent].append((start, end))
        assert parent < n and (leaf or end - start > 8)
    for parent, parts in inside.items():
        if parent >= 0:  # children cut their parent's range, the first keeps its centre
            assert [parts[0][0], *[b for _, b in parts]] == [*[a for a, _ in parts], nodes[parent][1]] and parts[0][0] == nodes[parent][0]


def test_bounds_skip_rows_that_cannot_count():
    data = clustered(4, 4000, 4, clusters=40)
    rows = np.floor(256 * np.array([v for _, v, _ in data]))
    longest = float((rows * rows).sum(axis=1).max())
    order, nodes, radii = H.cover_tree(H.augmented(rows, longest))
    block = H.Block(order, np.zeros(len(rows), np.int64), rows[order], nodes, radii, longest)
    found = H.Found(np.full((50, 1), -np.inf), np.full((50, 1), np.inf), 5)
    block.search(found, rows[:50], np.arange(50), np.zeros(50, np.int64), True)
    assert block.opened < 0.3 * 50 * len(rows)
    query, score, ids = found.held[0]
    for q in range(50):
        exact = sorted((-int(rows[q] @ r), i) for i, r in enumerate(rows) if i != q)[:5]
        assert [(-int(s), int(i)) for s, i in zip(score[query == q], ids[query == q])] == exact


def test_query_against_sql_and_brute_force(spark, sf_dir):
    got = QUERIES["op13_hard_negatives"](spark, sf_dir)
    path = f"{sf_dir}/embeddings.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    rows = sorted(tuple(r) for r in got.select(*NAMES).collect())
    sql = db.execute(ORACLE["op13_hard_negatives"])
    assert [c[0] for c in sql.description] == NAMES and rows == sorted(sql.fetchall())
    assert rows == brute([(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(path).collect()]) and rows
