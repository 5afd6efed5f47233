from collections import Counter

import pytest
import test_byte_bpe
import test_exact_dedup
import test_minhash_dedup
import test_mixing

import corpus_pipeline
from fairband.llm import toxicity
from fairband.llm.common import load
from llm_rows import edge_rows, rows, with_clashes


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """The smallest tables plus awkward rows, toxic ones and near copies."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = [(5000 + i if i is None or i < 5000 else i, *r) for i, *r in edge_rows() if i is not None]
    more += [(9000 + i, f"you {w} and {w} liar " * 3 + f"number {i}", "en", "a", 1) for i, w in enumerate(["vile", "rotten", "filthy"] * 40)]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").unionByName(
        spark.createDataFrame([(9000 + i, 1, 1) for i in range(100)], "doc_id long, quality int, toxic int"))
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_against_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before, columns = [tuple(r) for r in docs.collect()], docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "byte_bpe":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [tuple(r) for r in docs.collect()]
        ids = Counter(r[0] for r in after)
        if name == "toxicity":
            raw = spark.read.parquet(f"{tables}/documents.parquet")
            model = toxicity.fit(raw, load(spark, tables, "labels", "doc_id", "toxic"), toxicity.remainder("doc_id", 5) != 0)
            scores = [(r.doc_id, r.score) for r in toxicity.score(raw, model).collect()]
            assert ids == Counter(i for i, s in scores if s < 0.5)
            assert not any(9000 <= i < 9200 for i in ids)
        elif name == "exact_dedup":
            assert ids == Counter(r[0] for r in test_exact_dedup.brute(before) if r[3])
        elif name == "minhash_dedup":
            assert ids == Counter(r[0] for r in test_minhash_dedup.brute(before) if r[3])
        elif name == "mixing":
            assert ids == Counter({r[0]: r[4] // r[1] for r in test_mixing.brute(before) if r[4]})
        else:
            lib = test_byte_bpe.reference()
            want = {r[0]: lib.encode_ordinary(r[1] or "") for r in before}
            assert ids == Counter(r[0] for r in before) and all(r.exact for r in docs.collect())
            assert all(list(memoryview(r.ids).cast("I")) == want[r.doc_id] and r.n_tokens == len(want[r.doc_id]) for r in docs.collect())
        left[name], before = len(after), after
    assert left["toxicity"] > left["exact_dedup"] > left["minhash_dedup"] > 0


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "exact"] and out.count() > 0


def test_awkward_and_empty_tables_pass_every_stage(spark, tables):
    for data in (edge_rows(), []):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, tables).count() >= min(len(data), 1)


HELPERS = ("__kept_id", "__kept_text", "__rows", "__own_text", "__mix_id", "__copies", "__cut_id", "__cut")


def test_extra_columns_may_have_the_helpers_names(spark, tables):
    docs = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    clashing = with_clashes(docs, *HELPERS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, tables)
        assert out.columns == clashing.columns, name
        assert rows(out.select(docs.columns)) == rows(stage(spark, docs, tables)), name
        assert all(v == "clash" for r in out.select(*HELPERS).collect() for v in r)
    encoded = dict(corpus_pipeline.STAGES)["byte_bpe"](spark, clashing, tables)
    assert rows(encoded) == rows(dict(corpus_pipeline.STAGES)["byte_bpe"](spark, docs, tables))
