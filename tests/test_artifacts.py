import json
import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from fairband.operators import artifacts as AR
from fairband.operators import features as FE
from fairband.operators import forests as FO
from fairband.plans.q_models import Train
from fairband.session import scratch_path

AGAIN = """
import json, sys
from fairband.operators import artifacts as AR
from fairband.plans.q_models import Train
from fairband.session import build_session
spark = build_session("local[2]", 4)
spark.sparkContext.setCheckpointDir(sys.argv[2])
pipeline, config, tables = AR.load(spark, sys.argv[1])
t = Train(spark, sys.argv[3])
rows = pipeline.transform(t.ctx.trained).select(t.spec.key, t.spec.low, t.spec.high, "scaled").collect()
print("ROWS" + json.dumps([config, sorted([list(r) for r in rows]), tables["importances"].count()]))
"""


@pytest.fixture(scope="module")
def saved(spark, sf_dir):
    t = Train(spark, sf_dir)
    s = t.spec
    forest = FO.fit(spark, t.sample, t.feats, trees=15, depth=5)
    train = t.rows.filter("split = 'train'")
    medians = FE.fit_medians(FE.train_test_split(t.ctx.trained, s.key).filter("split = 'train'"), list(s.base_features))
    pipeline = AR.scoring_pipeline(s, medians, FE.fit_scaler(train, t.feats), forest)
    base = scratch_path(spark, "t_artifacts_" + uuid.uuid4().hex[:8])
    shares = spark.createDataFrame(forest.importances(), "rank int, feature string, importance double")
    AR.save(pipeline, base, {"trees": 15, "features": t.feats}, {"importances": shares})
    return t, pipeline, base, shares


def test_stages_do_what_the_feature_table_does(saved):
    t, pipeline, _, _ = saved
    got = {r[0]: r[1:] for r in pipeline.transform(t.ctx.trained).select(t.spec.key, *t.feats).collect()}
    assert got == {r[0]: r[1:] for r in t.rows.select(t.spec.key, *t.feats).collect()}


def test_a_new_session_scores_every_row_alike(spark, sf_dir, saved):
    t, pipeline, base, _ = saved
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", AGAIN, base, spark.sparkContext.getCheckpointDir(), sf_dir], cwd=root, capture_output=True, text=True, timeout=300,
                         env=os.environ | {"PYTHONPATH": root})
    config, rows, n = json.loads(out.stdout.split("ROWS")[1])
    want = sorted(list(r) for r in pipeline.transform(t.ctx.trained).select(t.spec.key, t.spec.low, t.spec.high, "scaled").collect())
    assert rows == want and rows and config == {"trees": 15, "features": t.feats} and n == len(t.feats)


def test_versions(spark, saved):
    t, pipeline, base, shares = saved
    folder = AR.save(pipeline, base, {"trees": 16}, {"importances": shares.limit(3)})
    assert folder.endswith("v000001")
    assert AR.load(spark, base)[1] == {"trees": 16} and AR.load(spark, base)[2]["importances"].count() == 3
    assert AR.load(spark, base, 0)[1]["trees"] == 15
    shares.limit(1).write.mode("overwrite").parquet(f"{base}/versions/v000002/pipeline")  # a version that never got its manifest
    assert AR.load(spark, base)[1] == {"trees": 16}
    with pytest.raises(FileNotFoundError):
        AR.load(spark, base + "_none")


def test_statistics(spark, saved):
    t = saved[0]
    rows = {(r["scope"], r["name"]): r for r in AR.dataset_statistics(t.rows, t.spec).collect()}
    pay = sorted(r[0] for r in t.rows.select(t.spec.target).collect())
    assert rows["all", "all"]["n"] == len(pay) and rows["all", "all"]["max"] == pay[-1]
    assert sum(r["n"] for (scope, _), r in rows.items() if scope == "league") == len(pay)
    n = t.rows.filter(F.col(t.spec.position) == "Defender").count()
    assert n == rows["position", "Defender"]["n"]
