import math

import numpy as np
from hypothesis import assume, given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fairband.llm import quality as Q
from fairband.llm.toxicity import remainder
from llm_rows import edge_documents, edge_rows, empty_documents, with_clashes


def test_flat_trees_answer_as_the_learner(spark, sf_dir, monkeypatch):
    tables = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    kept = {}
    plain = Q.flatten
    monkeypatch.setattr(Q, "flatten", lambda model, nodes: kept.setdefault("forest", plain(kept.setdefault("model", model), nodes)))
    forest = Q.fit(docs, labels, remainder("doc_id", 4) != 2, trees=8)
    described = Q._described(docs, F.col("text"), F.col("doc_id")).withColumn("features", array_to_vector("statistics"))
    want = {r.doc_id: r.probability[1] for r in kept["model"].transform(described).collect()}
    got = {r.doc_id: r.score for r in Q.score(docs, forest).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9

    held = Q.score(docs, forest).join(labels, "doc_id").filter(remainder("doc_id", 4) == 2).collect()
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([(r.score >= 0.7) == r.quality for r in held]) > 0.9


def test_statistics():
    empty = Q.statistics("")
    assert len(empty) == len(Q.FEATURES) and not any(empty)
    s = dict(zip(Q.FEATURES, Q.statistics("AB c1 c1\n\nAB c1 c1 $$$ é")))
    assert abs(s["distinct_lines"] - 1) < 1e-12 and s["repeated_next"] == 2 / 8 and s["top_word"] == 4 / 8
    assert s["upper"] == 4 / 25 and s["wide"] == 2 / 25 and s["symbol_words"] == 1 / 8


def test_edge_rows_and_no_labels(spark):
    docs = with_clashes(edge_documents(spark), "score", "statistics", "_id")
    none = spark.createDataFrame([], "doc_id long, quality int")
    forest = Q.fit(docs, none, F.lit(True))
    assert {r.score for r in Q.score(docs, forest).collect()} == {0.5}
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(40)] + [(None, 1), (4, None), (4, 7)], "doc_id long, quality int")
    got = Q.score(docs, Q.fit(docs, labels, F.lit(True), trees=3)).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 == len({r.score for r in got if r.doc_id == 11})
    assert Q.score(empty_documents(spark), forest).count() == 0


def plain_statistics(text):
    """The same numbers, character by character and word by word."""
    raw, words = text.encode(), text.split()
    n, w = max(len(raw), 1), max(len(words), 1)
    share = lambda chars: sum(b in chars for b in raw) / n
    groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?'\"-()", b"!#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256)), b"|"]
    lines = [x for x in text.split("\n") if x.strip()]
    head, tail = words[:len(words) // 2], words[len(words) // 2:]
    ends = sum(1 for i in range(len(text) - 1) if all(c in "!#$%&*+/<=>@^_`{}~|" for c in text[i:i + 2]) and (i + 2 == len(text) or text[i + 2].isspace()))
    return [math.log1p(len(raw)), math.log1p(len(words)), len(raw) / w, *[share(g) for g in groups[:6]], share(groups[6]), share(groups[7]),
            len(set(words)) / w, max((words.count(x) for x in words), default=0) / w, len(set(lines)) / max(len(lines), 1),
            sum(a == b for a, b in zip(words, words[1:])) / w, ends / w, len({x for x in tail if x not in head}) / max(len(tail), 1),
            min(max((len(x) for x in words), default=0), 200)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 \n\t.,$#|%é\\~", max_size=60) | st.text(max_size=40))
def test_statistics_against_plain_counts(text):
    assume("\x1c" not in text and not any(0xD800 <= ord(c) < 0xE000 for c in text))
    assert np.allclose(Q.statistics(text), plain_statistics(text))


def test_trees_in_step_against_walks():
    rng = np.random.default_rng(6)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def grow(depth):
        at = len(feature)
        for column in (feature, threshold, left, right, value):
            column.append(0)
        feature[at], threshold[at], value[at] = -1, 0.0, float(rng.normal())
        if depth and rng.random() < 0.8:
            feature[at], threshold[at] = int(rng.integers(0, 4)), float(rng.integers(-1, 2))
            left[at], right[at] = grow(depth - 1), grow(depth - 1)
        return at

    for _ in range(7):
        roots.append(grow(4))
    forest = Q.Forest(*map(np.array, (roots, feature, threshold, left, right, value)), 4)
    rows = rng.integers(-2, 3, (50, 4)).astype(float)  # values on the thresholds too
    for row, margin in zip(rows, forest.margin(rows)):
        total = 0.0
        for node in roots:
            while feature[node] >= 0:
                node = left[node] if row[feature[node]] <= threshold[node] else right[node]
            total += value[node]
        assert abs(total - margin) < 1e-12
