import numpy as np
import pytest
from pyspark.sql import functions as F

from fairband.operators import grower as G
from fairband.operators import models as M
from fairband.operators import selection as S
from fairband.operators import trees as T
from fairband.operators.rows import HELD, IDLE, LEARNT, NO_FOLD, WHOLE, Rows, place, states
from fairband.plans.q_models import Train

MANY = 20_100  # more than trees were once searched and fitted on
GRIDS = {"Tuned RF": {"trees": (2, 3), "depth": (2, 3), "least": (3,)},
         "Tuned XGBoost": {"trees": (3, 4), "depth": (2,), "rate": (0.1,), "rows": (0.8,), "columns": (0.7,), "l1": (0.1,), "l2": (1.0,)},
         "Tuned GB": {"trees": (3, 4), "depth": (2,), "rate": (0.3,), "rows": (1.0,), "least": (3,)}}


def data(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=(n, 4)), rng.integers(0, 3, n), rng.integers(0, 2, (n, 3))])
    x = np.column_stack([x, np.exp(x[:, 0]), x[:, 1] ** 2])
    return x, x[:, 0] * 2 + np.where(x[:, 1] > 0.3, 1.5, 0) + x[:, 4] + 0.1 * rng.normal(size=n)


def grown(spark, codes, y, state, task):
    G.register(spark)
    columns = [state.astype(np.uint8).tobytes(), y.astype("<f8").tobytes(), *[np.ascontiguousarray(c).tobytes() for c in codes.T]]
    one = spark.createDataFrame([(columns, task)], "c array<binary>, t string")
    return np.frombuffer(one.select(G.grown("c", "t")).first()[0], "<f8")


@pytest.mark.parametrize("n, bins", [(300, 32), (3000, 64)])
def test_trees_of_the_jvm_are_those_of_numpy(spark, n, bins):
    x, y = data(n)
    codes = T.binned(x, T.quantile_edges(x, bins)).codes
    w = (np.arange(n) % 5 > 0).astype(float)
    state = np.where(w > 0, LEARNT, HELD)
    models = [T.Boost(depth=3), T.Boost(depth=4, rate=0.3, l1=0.5, l2=2.0, least=5)]
    got = grown(spark, codes, y, state, G.boosted_task(7, bins, (10, 40), models, "all")).reshape(2, 2, n)
    for m, model in enumerate(models):
        want = T.boosted(codes, bins, y, w, [model], 40, 7, stages=(10, 40))
        assert np.allclose(got[0, m], want[10][0], rtol=0, atol=1e-10) and np.allclose(got[1, m], want[40][0], rtol=0, atol=1e-10)
    one = np.ones(1)
    for depth, least in ((4, 3), (12, 1)):
        want, _, stopped = T.grow(codes, bins, y[None], w[None], depth, least * one, 0 * one, 0 * one, at_depths=(2,))
        got = grown(spark, codes, y, state, G.forest_task("none", bins, least, (1,), (2, depth), "all")).reshape(2, n)
        assert np.allclose(got[1], want[0], rtol=0, atol=1e-9) and np.allclose(got[0], stopped[2][0], rtol=0, atol=1e-9)


def test_what_the_jvm_says_of_sampled_fits(spark):
    x, y = data(2000)
    codes = T.binned(x, T.quantile_edges(x, 32)).codes
    state = np.where(np.arange(2000) % 5 == 0, HELD, np.where(np.arange(2000) % 7 == 0, IDLE, LEARNT))
    held, learnt = state == HELD, state == LEARNT
    model = T.Boost(depth=3, rows=0.7, columns=0.6, l1=0.1, l2=1.0)
    all_, few = (grown(spark, codes, y, state, G.boosted_task(7, 32, (20, r), [T.Boost(depth=2, rows=0.8), model], "all")).reshape(2, 2, -1) for r in (60, 30))
    assert np.array_equal(all_[0], few[0])  # a model passes through the smaller ones
    assert np.array_equal(all_[:, 1], grown(spark, codes, y, state, G.boosted_task(7, 32, (20, 60), [model], "all")).reshape(2, -1))  # whatever its batch
    numpy = T.boosted(codes, 32, y, learnt.astype(float), [model], 60, 7)[60][0]
    off = [((p - y)[held] ** 2).mean() for p in (all_[1, 1], numpy)]
    assert abs(off[0] / off[1] - 1) < 0.25
    changed = np.where(learnt, y, 1e6)  # other labels are never looked at
    assert np.array_equal(all_, grown(spark, codes, changed, state, G.boosted_task(7, 32, (20, 60), [T.Boost(depth=2, rows=0.8), model], "all")).reshape(2, 2, -1))
    scores = grown(spark, codes, y, state, G.boosted_task(7, 32, (60,), [model], "scores"))
    for at, rows in ((0, learnt), (3, held)):
        want = rows.sum(), ((y - all_[1, 1])[rows] ** 2).sum(), ((y[rows] - y[rows].mean()) ** 2).sum()
        assert np.allclose(scores[at:at + 3], want)
    deep = grown(spark, codes, y, state, G.forest_task(7, 32, 2, (5, 12), (3, 6), "all")).reshape(2, 2, -1)
    assert np.array_equal(deep[1, 0], grown(spark, codes, y, state, G.forest_task(7, 32, 2, (5,), (6,), "all")))
    assert np.array_equal(deep[0, 1], grown(spark, codes, y, state, G.forest_task(7, 32, 2, (12,), (3,), "all")))
    mean, low, high = grown(spark, codes, y, state, G.forest_task(7, 32, 2, (12,), (6,), "quartiles")).reshape(3, -1)
    each = np.diff([t * grown(spark, codes, y, state, G.forest_task(7, 32, 2, (t,), (6,), "all")) for t in range(1, 13)], axis=0, prepend=np.zeros((1, 2000)))
    assert np.allclose(mean, deep[1, 1], rtol=0, atol=1e-12)
    assert np.allclose([low, high], np.percentile(each, [25, 75], axis=0), rtol=0, atol=1e-9)


def test_states_of_rows():
    folds, places = np.array([0, 0, 1, 1, 2, -2]), np.array([5, 1, 2, 0, 3, 4], np.uint64)
    assert states(folds, places, (1, 1, WHOLE)).tolist() == [LEARNT, LEARNT, HELD, HELD, LEARNT, IDLE]
    assert states(folds, places, (1, 2, WHOLE)).tolist() == [LEARNT, LEARNT, HELD, HELD, HELD, IDLE]
    assert states(folds, places, (NO_FOLD, NO_FOLD, WHOLE)).tolist() == [LEARNT] * 5 + [IDLE]
    assert states(folds, places, (1, 1, 67)).tolist() == [IDLE, LEARNT, HELD, HELD, LEARNT, IDLE]
    assert states(folds, places, (1, 1, 1)).tolist() == [IDLE, LEARNT, HELD, HELD, IDLE, IDLE]


def many_rows(spark, n=MANY):
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    return spark.range(n).select(F.col("id").alias("player_pk"), "id", noise.alias("a"), (F.col("id") % 37 + 0.0).alias("b"), (F.col("id") % 2 + 0.0).alias("c"),
                                 F.floor(F.col("id") * 5 / n).cast("int").alias("fold"), (F.sin(F.col("id") % 37) + 3 * noise + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(7)) / 7).alias(M.LABEL))


@pytest.fixture
def big(spark, sf_dir, monkeypatch):
    """A ``Train`` whose train rows are ``MANY``."""
    monkeypatch.setattr(Train, "folded", property(lambda self: many_rows(spark)))
    monkeypatch.setattr(S, "GRIDS", GRIDS)
    t = Train(spark, sf_dir)
    t.feats = ["a", "b", "c"]
    return t


def test_the_search_learns_from_every_row(spark, big):
    rows = big.search.collect()
    assert len(rows) == 8 and all(r["folds"] == 5 for r in rows)
    pd = many_rows(spark).toPandas()
    x, y, folds = pd[["a", "b", "c"]].to_numpy(float), pd[M.LABEL].to_numpy(float), pd["fold"].to_numpy()
    scores = []
    for k in range(5):
        w = (folds != k).astype(float)
        codes = T.binned(x, T.quantile_edges(x[w > 0], S.SEARCH_BINS)).codes
        p = T.boosted(codes, S.SEARCH_BINS, y, w, [T.Boost(depth=2, rate=0.3, least=3)], 4, 42)[4][0]
        scores.append(1 - ((y - p)[w == 0] ** 2).sum() / ((y[w == 0] - y[w == 0].mean()) ** 2).sum())
    (row,) = (r for r in rows if r["model"] == "Tuned GB" and r["params"]["trees"] == 4)
    assert abs(row["cv_mean"] - np.mean(scores)) < 1e-9 and abs(row["cv_std"] - np.std(scores)) < 1e-9


def test_rows_are_named_by_what_they_hold(spark):
    rows = many_rows(spark, 500)
    a, b = Rows(rows, "id", ["a", "b"]), Rows(rows.orderBy("b").repartition(7), "id", ["a", "b"])
    assert a.digest(1) == b.digest(1) != a.digest(2)
    assert a.digest(1) != Rows(rows.withColumn("a", F.when(F.col("id") == 7, -1.0).otherwise(F.col("a"))), "id", ["a", "b"]).digest(1)


def test_the_learning_curve_grows_to_every_row(spark, big):
    curve = S.learning_curve(spark, big.sample, big.tuned_forest).collect()
    assert len(curve) == 50 and sum(r["train_rows"] for r in curve if r["train_share"] == 100) == 4 * MANY
    assert all(r["train_rows"] == 4 * MANY // 5 * r["train_share"] // 100 for r in curve)
    s, params = big.sample, {"trees": 1, "depth": 3, "least": 2}
    (row,) = (r for r in S.learning_curve(spark, s, params, shares=(30,)).collect() if r["fold"] == 2)
    state = states(s.folds, np.array([place(k) for k in s.keys.tolist()], np.uint64), (2, 2, 30))
    codes = T.binned(s.values, T.quantile_edges(s.values[state == LEARNT], T.BINS)).codes
    p = grown(spark, codes, s.labels, state, G.forest_task(42, T.BINS, 2, (1,), (3,), "all"))
    for name, on in (("train_r2", state == LEARNT), ("validation_r2", state == HELD)):
        assert abs(row[name] - (1 - ((s.labels - p)[on] ** 2).mean() / s.labels[on].var())) < 1e-9


def test_models_learn_from_and_predict_every_row(spark, big, monkeypatch):
    monkeypatch.setattr(S, "UNTUNED", {"Random Forest": {"trees": 2, "depth": 4, "least": 1}, "Gradient Boosting": {"trees": 3, "depth": 2, "rate": 0.1},
                                       "XGBoost": {"trees": 3, "depth": 2, "rate": 0.1, "l2": 1.0}})
    both = many_rows(spark, MANY + 700).withColumn("split", F.when(F.col("id") < MANY, "train").otherwise("test")).drop("fold")
    big.rows = both
    big.scaled = both.withColumn("b", F.col("b") / 10)
    models = big.models()
    oof = models.out_of_fold().groupBy("model").agg(F.count("prediction").alias("n"), F.count_distinct("key").alias("keys")).collect()
    assert {(r["model"], r["n"], r["keys"]) for r in oof} == {(m, MANY, MANY) for m in S.ORDER}
    table = {r["model"]: r for r in models.metrics().collect()}
    assert all(r["n_train"] == MANY and r["n_test"] == 700 for r in table.values())
    pd = both.orderBy("id").toPandas()
    x, y = pd[["a", "b", "c"]].to_numpy(float), pd[M.LABEL].to_numpy(float)
    w = (np.arange(len(y)) < MANY).astype(float)
    codes = T.binned(x, T.quantile_edges(x[w > 0], T.BINS)).codes
    p = T.boosted(codes, T.BINS, y, w, [T.Boost(depth=2, rate=0.1)], 3, 42)[3][0]
    fit = models.predictions.filter("model = 'Gradient Boosting' and out_a = -1").orderBy("key").toPandas()
    assert np.allclose(fit["prediction"], p, rtol=0, atol=1e-9) and (fit["split"] == np.where(w > 0, "train", "test")).all()
    pairs = models.predictions.filter("out_a <> out_b").groupBy("model", "out_a", "out_b").agg(F.count("*").alias("n"), F.count_if((F.col("fold") == F.col("out_a")) | (F.col("fold") == F.col("out_b"))).alias("left"))
    assert all(r["n"] == r["left"] == 2 * MANY // 5 for r in pairs.collect()) and pairs.count() == 10 * len(S.BASES)
    ranges = models.predictions.filter("model = 'Tuned RF' and out_a = -1").agg(F.count("*").alias("n"), F.count_if(F.col("low") <= F.col("high")).alias("ordered")).first()
    assert ranges["n"] == ranges["ordered"] == MANY + 700


def test_the_forest_of_all_rows_is_spark_mls_with_trees_of_the_learner(spark, monkeypatch):
    n = 3000
    rows = M.stable_order(M.assemble(many_rows(spark, n), ["a", "b", "c"]), "id")
    model = M.forest(7, 6, seed=5).fit(rows)
    x, y = (np.array([r[c] for r in rows.select("a", "b", "c", M.LABEL).collect()]) for c in (slice(0, 3), 3))
    edges = T.quantile_edges(x, 32)  # of all rows, as many as Spark ML's bins
    want = grown(spark, T.binned(x, edges).codes, y, np.zeros(n), G.forest_task(5, 32, 1, (7,), (6,), "all"))
    got = model.transform(rows).select("prediction", "leaves").collect()
    assert np.allclose([r["prediction"] for r in got], want, rtol=0, atol=1e-9)
    assert model.getNumTrees == 7 and all(t.depth <= 6 for t in model.trees) and abs(sum(model.featureImportances) - 1) < 1e-9
    nodes = M.node_table(model).select("treeID", "nodeData.*").collect()
    assert {r["rawCount"] for r in nodes if r["id"] == 0} == {n} and all(r["gain"] > 0 for r in nodes if r["leftChild"] >= 0)
    assert {r["split"]["leftCategoriesOrThreshold"][0] for r in nodes if r["leftChild"] >= 0 and r["split"]["featureIndex"] == 0} <= set(edges[0].tolist())
    monkeypatch.setattr(M, "TREES_PER_TASK", 2)
    assert M.forest(7, 6, seed=5).fit(rows).toDebugString.split("\n", 1)[1] == model.toDebugString.split("\n", 1)[1]
    few = M.forest(2, 3, seed=5, featureSubsetStrategy="onethird").fit(rows)  # Spark ML's own
    assert few.getNumTrees == 2


def test_a_forest_of_one_leaf(spark):
    rows = M.assemble(spark.range(20).selectExpr("id", "1.0 as a", "2.5 as label"), ["a"])
    model = M.forest(3, 4).fit(rows)
    assert {r["prediction"] for r in model.transform(rows).collect()} == {2.5} and model.totalNumNodes == 3


def test_tables_without_rows(spark):
    none = Rows(many_rows(spark, 10).filter("id < 0"), "id", ["a", "b"])
    assert [r["best"] for r in S.grid_search(spark, none, GRIDS).collect()] == []
    assert S.learning_curve(spark, none, {"trees": 2, "depth": 2, "least": 1}).count() == 0
    assert none.digest() != Rows(many_rows(spark, 10), "id", ["a", "b"]).digest()
