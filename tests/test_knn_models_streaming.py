import numpy as np
from pyspark.sql import functions as F

from fairband.operators.neighbors import similar_entities


def test_knn_equals_brute_force(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = similar_entities(emb, "vec_id", "embedding", k=4, cell_rows=100, leaf=8).collect()
    rows = emb.select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    X = np.array([r.embedding for r in rows], dtype=np.float64)
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    want = set()
    for i, q in enumerate(ids):
        order = sorted([(d[i, j], ids[j]) for j in range(len(ids)) if j != i])[:4]
        want |= {(int(q), int(n), r + 1) for r, (_, n) in enumerate(order)}
    assert {(r.query_id, r.neighbor_id, r.rank) for r in got} == want


def test_forest_ranges_are_consistent(spark, sf_dir):
    from fairband.operators import models as M
    from fairband.plans.q_models import Train
    t = Train(spark, sf_dir)
    model = M.forest(12, 5).fit(M.stable_order(t.train, t.spec.key))
    out = M.tree_predictions(model, t.table).select(
        "prediction", "tree_preds").collect()
    for r in out:
        assert abs(float(np.mean(r.tree_preds)) - r.prediction) < 1e-9
    rng = M.predict_range(model, t.table, t.spec).select("predicted_low_eur", "predicted_high_eur",
                                                         "log_low", "log_high", "tree_preds").collect()
    for r in rng:
        assert r.predicted_low_eur <= r.predicted_high_eur
        assert abs(r.log_low - np.percentile(r.tree_preds, 25)) < 1e-12
        assert abs(r.log_high - np.percentile(r.tree_preds, 75)) < 1e-12


def test_latest_snapshot_skips_uncommitted_and_current_epoch(spark):
    import uuid
    from fairband.session import scratch_path
    from fairband.streaming.rollup import latest_snapshot
    base = scratch_path(spark, "t_snap_" + uuid.uuid4().hex[:6])
    df = spark.range(3)
    df.write.parquet(f"{base}/snapshot_000000")
    df.write.parquet(f"{base}/snapshot_000001")
    # an epoch that died mid-write: files but no _SUCCESS marker
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{base}/snapshot_000002")
    assert latest_snapshot(spark, base).endswith("snapshot_000001")
    assert latest_snapshot(spark, base, before_epoch=1).endswith("snapshot_000000")
    assert latest_snapshot(spark, base + "_missing") is None
