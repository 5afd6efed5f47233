import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairband.llm import toxicity as X
from llm_rows import edge_documents, edge_rows, empty_documents, with_clashes


def brute_segments(s):
    """Recursively: the best segment (shortest, leftmost), then left and right of it."""
    def cut(a, b):
        best = max(((round(sum(s[i:j]), 9), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, _, i, j = best
        return cut(a, i) + [(i, j)] + cut(j, b)
    return cut(0, len(s))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5).map(lambda v: v + 0.013 * v * v), max_size=14))
def test_segments_against_brute_force(scores):
    got = X.maximal_segments(np.array(scores, dtype=float))
    if len({round(sum(scores[:i]), 9) for i in range(len(scores) + 1)}) == len(scores) + 1:  # no ties
        assert [(a, b) for a, b, _ in got] == brute_segments(scores)
    assert all(abs(v - sum(scores[a:b])) < 1e-9 and v > 0 for a, b, v in got)


def test_many_positive_tokens_take_linear_time():
    scores = np.tile([1.0, -0.6], 200_000)
    assert len(X.maximal_segments(scores)) == 1


def test_scale_solves_its_equation():
    values, counts = np.array([-1.0, 1.0]), np.array([75_000, 24_999])
    assert abs(X.karlin_scale(values, counts) - np.log(3)) < 1e-3
    assert X.karlin_scale(values, np.array([0, 0])) > 0


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    tables = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    return docs, X.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"), X.remainder("doc_id", 5) != 0)


def test_held_out_documents(spark, sf_dir, model):
    docs, fitted = model
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    got = X.score(docs, fitted).join(labels, "doc_id").filter(X.remainder("doc_id", 5) == 0).collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean]) > 0.8
    assert np.mean([c >= 0.5 for c in clean]) < 0.05


def test_edge_rows(spark, model):
    _, fitted = model
    got = X.score(with_clashes(edge_documents(spark), "score", "passages", "_id", "_scored"), fitted).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert len({r.score for r in got if r.doc_id == 11}) == 1


def test_no_rows_and_no_labels(spark):
    docs = edge_documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    fitted = X.fit(docs, none, F.lit(True))
    assert all(0 <= r.score <= 1 for r in X.score(docs, fitted).collect())
    assert X.score(empty_documents(spark), fitted).count() == 0
    one_sided = spark.createDataFrame([(i, 1) for i in range(100, 130)] + [(None, 0), (4, None)], "doc_id long, toxic int")
    assert X.score(docs, X.fit(docs, one_sided, F.lit(True))).count() == len(edge_rows())


def test_passages_hold_the_words_that_make_a_text_toxic(spark):
    docs = spark.createDataFrame(
        [(i, "calm words about the weather today " * 10, 0) for i in range(800)]
        + [(1000 + i, "calm words about the vile rotten filth weather today", 1) for i in range(200)], "doc_id long, text string, toxic int")
    fitted = X.fit(docs, docs.select("doc_id", "toxic"), F.lit(True))
    r = X.score(spark.createDataFrame([(1, "the weather " * 30 + "rotten vile filth " + "calm today " * 30)], "doc_id long, text string"), fitted).first()
    assert r.score > 0.5 and [(p["first"], p["after"]) for p in r.passages] == [(60, 63)]


def test_passages_that_use_the_same_words_count_in_full():
    model = X.Model({"vile$": 3.0, "rotten$": 2.5, "filth$": 3.5})
    scorer = X.Scorer(model)

    def found(text):
        tokens = X.words(text)
        return scorer.segments(tokens, scorer.token_scores(tokens))

    passage = "rotten vile filth "
    assert found(passage + "the weather " * 30 + passage) == [(0, 3, 9.0), (63, 66, 9.0)]
    scattered = ("vile " + "the weather " * 20 + "rotten " + "calm today " * 20 + "filth " + "a day " * 20) * 5
    assert found(scattered + passage)[-1][2] == 9.0
    (_, _, repeated), = found("vile " * 50)
    assert 3.0 < repeated < 3.0 * np.pi ** 2 / 6


def test_passages_at_both_ends_of_a_text_are_reported(spark):
    docs = spark.createDataFrame(
        [(i, "calm words about the weather today " * 10, 0) for i in range(800)]
        + [(1000 + i, "calm words about the vile rotten filth weather today", 1) for i in range(200)], "doc_id long, text string, toxic int")
    fitted = X.fit(docs, docs.select("doc_id", "toxic"), F.lit(True))
    ends = "rotten vile filth " + "the weather " * 400 + "rotten vile filth"
    r = X.score(spark.createDataFrame([(1, ends)], "doc_id long, text string"), fitted).first()
    assert [(p["first"], p["after"]) for p in r.passages] == [(0, 3), (803, 806)]
    assert abs(r.passages[0]["score"] - r.passages[1]["score"]) < 1e-9
