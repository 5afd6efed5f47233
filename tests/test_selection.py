import numpy as np
import pytest
from pyspark.sql import functions as F

from fairband.operators import forests as FO
from fairband.operators import models as M
from fairband.operators import selection as S
from fairband.operators import trees as T
from fairband.plans.q_models import Train

GRIDS = {"Tuned RF": {"trees": (5, 10), "depth": (2, 4), "least": (3, 5)},
         "Tuned XGBoost": {"trees": (5, 10), "depth": (2, 3), "rate": (0.1,), "rows": (0.8,), "columns": (0.7,), "l1": (0.0, 0.1), "l2": (1.0,)},
         "Tuned GB": {"trees": (5, 10), "depth": (2,), "rate": (0.1, 0.3), "rows": (1.0,), "least": (3,)}}


def data(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=(n, 4)), rng.integers(0, 3, n)])
    return x, x[:, 0] * 2 + np.where(x[:, 1] > 0.3, 1.5, 0) + x[:, 4] + 0.1 * rng.normal(size=n)


def cart(x, y, rows, depth, least):
    """Plain least-squares tree: (feature, threshold, left, right) or a mean."""
    best, parent = None, ((y[rows] - y[rows].mean()) ** 2).sum()
    if depth:
        for f in range(x.shape[1]):
            for a, b in zip(u := np.unique(x[rows, f]), u[1:]):
                left, right = rows[x[rows, f] <= (a + b) / 2], rows[x[rows, f] > (a + b) / 2]
                if min(len(left), len(right)) >= least:
                    rest = ((y[left] - y[left].mean()) ** 2).sum() + ((y[right] - y[right].mean()) ** 2).sum()
                    if rest < parent - 1e-7 and (best is None or rest < best[0] - 1e-9):
                        best = rest, f, (a + b) / 2, left, right
    if best is None:
        return y[rows].mean()
    return best[1], best[2], cart(x, y, best[3], depth - 1, least), cart(x, y, best[4], depth - 1, least)


def follow(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_a_tree_is_the_plain_tree():
    x, y = data(60)
    b = T.binned(x, T.quantile_edges(x, 64))
    weight = np.ones((1, 60))
    weight[0, 50:] = 0
    one, none = np.ones(1), np.zeros(1)
    got, trees, stopped = T.grow(b.codes, 64, y[None], weight, 4, 3 * one, none, none, keep=True, at_depths=(2,))
    for depth, value in ((4, got[0]), (2, stopped[2][0])):
        tree = cart(x, y, np.arange(50), depth, 3)
        # thresholds lie between values of all 60 rows here, of the 50 there: compare rows that were learned from
        assert np.allclose(value[:50], [follow(tree, r) for r in x[:50]])
    assert np.allclose(trees.predict(b.codes, 1), got)


def test_penalised_leaves_and_gains():
    codes = np.array([[0], [0], [1], [1], [1]], np.uint8)
    y, w = np.array([[-1.0, -3.0, 2.0, 4.0, 6.0]]), np.ones((1, 5))
    one = np.ones(1)
    got, _, _ = T.grow(codes, 2, y, w, 1, one, 2 * one, 0.5 * one)
    assert np.allclose(got, [[-3.5 / 4] * 2 + [11.5 / 5] * 3])
    got, _, _ = T.grow(codes, 2, y, w, 1, one, 2 * one, 20 * one)  # shrunken to nothing: no split, no value
    assert np.allclose(got, 0)
    got, _, _ = T.grow(codes, 2, y, w, 1, 3 * one, 0 * one, 0 * one)  # too few rows on the left
    assert np.allclose(got, y.mean())


def test_stages_are_the_fits_of_their_size():
    x, y = data()
    codes = T.binned(x, T.quantile_edges(x, 32)).codes
    w = (np.arange(300) % 5 > 0).astype(float)
    for models in ([T.Boost(depth=3)], [T.Boost(depth=3, rows=0.8, columns=0.6, l1=0.1, l2=1.0), T.Boost(depth=3, rate=0.3)]):
        long = T.boosted(codes, 32, y, w, models, 40, 7, stages=(10, 40))
        assert (long[10] == T.boosted(codes, 32, y, w, models, 10, 7)[10]).all()
        changed = np.where(w > 0, y, 1e6)  # left-out labels are never looked at
        assert (T.boosted(codes, 32, changed, w, models, 40, 7)[40] == long[40]).all()
    deep = T.forest(codes, 32, y, w, 20, 6, 5, 7, prefixes=(8, 20), depths=(3, 6))
    assert np.allclose(deep[6, 8], T.forest(codes, 32, y, w, 8, 6, 5, 7)[6, 8], rtol=0, atol=1e-12)
    assert np.allclose(deep[3, 20], T.forest(codes, 32, y, w, 20, 3, 5, 7)[3, 20], rtol=0, atol=1e-12)


def test_trees_do_not_depend_on_how_they_are_batched(monkeypatch):
    x, y = data()
    codes = T.binned(x, T.quantile_edges(x, 64)).codes
    whole = T.forest(codes, 64, y, np.ones(300), 12, 12, 1, 3)
    monkeypatch.setattr(T, "CELLS", 2000)
    assert np.allclose(whole[12, 12], T.forest(codes, 64, y, np.ones(300), 12, 12, 1, 3, batch=5)[12, 12], rtol=0, atol=1e-12)


def test_features_are_counted_in_few_passes(monkeypatch):
    """Small features share a pass, large ones pair up, equal columns are counted once; the splits stay those of plain sums."""
    x, y = data(2000)
    x = np.column_stack([x, np.exp(x[:, 0]), x[:, 1] > 0.3, x[:, 2] > 1, 3 * x[:, 4]])
    b = T.binned(x, T.quantile_edges(x, 32))
    passes = T.Features(b.codes, 32).passes(np.arange(9), True)
    keys, w, t = np.arange(2000) % 3, np.ones(2000), y
    both = passes.histogram(3, keys, np.arange(2000), None, t)
    for i, sums in enumerate(passes.left(both)):
        for c, (f, code) in enumerate(zip(passes.feature, passes.code)):
            on = b.codes[:, f] <= code
            assert np.allclose(sums[:, c], [(t if i else w)[on & (keys == k)].sum() for k in range(3)])
    assert len(passes.code) == sum(len(e) for e in b.edges)
    seen, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda cells, *a, **k: seen.append(len(cells)) or plain(cells, *a, **k))
    one = np.ones(1)
    got, _, _ = T.grow(b.codes, 32, y[None], np.ones((1, 2000)), 3, 5 * one, 0 * one, 0 * one)
    assert sum(seen) < 45_000  # 82,402 with two passes for each of the nine features
    assert len(np.unique(got)) == 8


def test_of_equal_features_a_tree_may_use_the_one_it_is_left():
    x, y = data(400)
    x = np.column_stack([x[:, 0], x[:, 0] ** 3, x[:, 1]])
    codes = T.binned(x, T.quantile_edges(x, 32)).codes
    allowed, one = np.array([[True, False, True], [False, True, True]]), np.ones(2)
    got, trees, _ = T.grow(codes, 32, np.stack([y, y]), np.ones((2, 400)), 3, one, 0 * one, 0 * one, allowed, keep=True)
    assert np.array_equal(got[0], got[1])
    used = [{int(f) for level in trees.levels for f in level.feature[level.tree == k] if f >= 0} for k in (0, 1)]
    assert used == [{0, 2}, {1, 2}]


def test_linear_fits_from_cross_products():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5))
    y = x @ [1.0, 0, -2, 0, 0.01] + 3 + 0.1 * rng.normal(size=80)
    z = np.column_stack([np.ones(80), x, y])
    xc, yc = x - x.mean(0), y - y.mean()
    ols, ridge, lasso = (S.solve(z.T @ z, k, a) for k, a in (("ols", 0), ("ridge", 1.0), ("lasso", 0.05)))
    assert np.abs(z[:, :-1].T @ (y - z[:, :-1] @ ols)).max() < 1e-8
    assert np.allclose(ridge[1:], np.linalg.solve(xc.T @ xc + np.eye(5), xc.T @ yc))
    grad = xc.T @ (yc - xc @ lasso[1:]) / 80
    assert np.allclose(grad[lasso[1:] != 0], 0.05 * np.sign(lasso[1:][lasso[1:] != 0])) and (np.abs(grad) <= 0.05 + 1e-9).all() and (lasso[1:] == 0).any()


@pytest.fixture(scope="module")
def train(spark, sf_dir):
    return Train(spark, sf_dir)


@pytest.fixture(scope="module")
def search(spark, train):
    return S.grid_search(spark, train.sample, GRIDS).collect()


def test_search_scores_every_candidate_and_marks_one_best(spark, train, search):
    assert len(search) == sum(len(S.candidates(g)) for g in GRIDS.values())
    for model, grid in GRIDS.items():
        rows = sorted((r for r in search if r["model"] == model), key=lambda r: r["candidate"])
        assert [r["candidate"] for r in rows if r["best"]] == [max(range(len(rows)), key=lambda i: (rows[i]["cv_mean"], -i))]
        assert all(r["folds"] == 5 for r in rows)
    s = train.sample
    row = next(r for r in search if r["model"] == "Tuned GB" and r["params"] == {"trees": 5.0, "depth": 2.0, "rate": 0.3, "rows": 1.0, "least": 3.0})
    scores = []
    for k in range(5):
        w = (s.folds != k).astype(float)
        codes = T.binned(s.values, T.quantile_edges(s.values[w > 0], S.SEARCH_BINS)).codes
        p = T.boosted(codes, S.SEARCH_BINS, s.labels, w, [T.Boost(depth=2, rate=0.3, least=3)], 5, 42)[5][0]
        held = w == 0
        scores.append(1 - ((s.labels - p)[held] ** 2).sum() / ((s.labels[held] - s.labels[held].mean()) ** 2).sum())
    assert abs(row["cv_mean"] - np.mean(scores)) < 1e-9 and abs(row["cv_std"] - np.std(scores)) < 1e-9
    assert S.grid_search(spark, s, GRIDS).count() == len(search)  # read back


def test_full_grids_are_the_default():
    assert [len(S.candidates(g)) for g in S.GRIDS.values()] == [27, 648, 72]


def test_one_table_of_predictions(spark, train, search):
    tuned = S.winners(S.grid_search(spark, train.sample, GRIDS))
    assert set(tuned) == set(GRIDS)
    small = {"Random Forest": {"trees": 6, "depth": 4, "least": 1}, "Gradient Boosting": {"trees": 6, "depth": 2, "rate": 0.1},
             "XGBoost": {"trees": 6, "depth": 2, "rate": 0.1, "l2": 1.0}}
    fold = train.folded.select(train.spec.key, "fold")
    models = S.Models(train.rows.join(fold, train.spec.key, "left"), train.scaled.join(fold, train.spec.key, "left"), train.spec, train.feats,
                      small | tuned, train.sample)
    oof = models.out_of_fold().toPandas()
    n = len(train.sample.keys)
    assert set(oof["model"]) == set(S.ORDER)
    for _, rows in oof.groupby("model"):  # every train row once
        assert len(rows) == n and set(rows["key"]) == set(train.sample.keys)

    def closed_form(frame):
        x, y = frame[list(S.BASES)].to_numpy(), frame["label"].to_numpy()
        w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + np.eye(5), (x - x.mean(0)).T @ (y - y.mean()))
        return np.concatenate([[y.mean() - x.mean(0) @ w], w])

    bases = oof[oof["model"].isin(S.BASES)].pivot(index=["key", "fold", "label"], columns="model", values="prediction").reset_index()
    meta = closed_form(bases)
    assert np.allclose(models.meta[S.NO_FOLD], meta)
    everything = models.predictions.toPandas()
    pairs = everything[(everything["out_a"] != everything["out_b"]) & everything["model"].isin(S.BASES)]
    inner = pairs[((pairs["out_a"] == 2) | (pairs["out_b"] == 2)) & (pairs["fold"] != 2)].pivot(index=["key", "label"], columns="model", values="prediction").reset_index()
    assert len(inner) == (oof[oof["model"] == "Ridge"]["fold"] != 2).sum() and np.allclose(models.meta[2], closed_form(inner))

    table = {r["model"]: r for r in models.metrics().collect()}
    assert [r["model"] for r in sorted(table.values(), key=lambda r: r["ordinal"])] == list(S.ORDER)
    for name in ("Lasso", "Tuned GB", S.STACK):
        rows = everything[(everything["model"] == name) & (everything["out_a"] == -1) & (everything["split"] == "test")]
        y, p = rows["label"].to_numpy(), rows["prediction"].to_numpy()
        a, e = np.expm1(y), np.expm1(p)
        got = table[name]
        assert got["n_test"] == len(rows) and got["n_train"] == n
        assert abs(got["test_r2"] - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
        assert abs(got["within_30"] - 100 * (np.abs(e - a) / a <= 0.3).mean()) < 1e-9 and abs(got["mae"] - np.abs(e - a).mean()) < 1e-6
        folds = oof[oof["model"] == name].groupby("fold").apply(lambda r: 1 - ((r["label"] - r["prediction"]) ** 2).mean() / r["label"].var(ddof=0))
        assert abs(got["cv_mean"] - folds.mean()) < 1e-9 and abs(got["cv_std"] - folds.std(ddof=0)) < 1e-9
    ranged = {m for m, r in table.items() if r["range_accuracy"] is not None}
    assert ranged == {"Tuned RF", "Tuned XGBoost", "Tuned GB", S.STACK}


def test_learning_curve_is_nested(spark, train):
    rows = S.learning_curve(spark, train.sample, {"trees": 4, "depth": 3, "least": 2}).collect()
    assert len(rows) == 50
    for f in range(5):
        sizes = [r["train_rows"] for r in sorted((r for r in rows if r["fold"] == f), key=lambda r: r["train_share"])]
        assert sizes == sorted(sizes) and sizes[-1] == (train.sample.folds != f).sum() and sizes[0] >= 1


def test_learning_curve_searches_the_grid_it_uses(spark, train, monkeypatch):
    from fairband.plans import q_models
    searched, plain = [], S.grid_search
    monkeypatch.setattr(S, "GRIDS", GRIDS)

    def search(spark, sample, grids=None, **k):
        searched.append(list(GRIDS if grids is None else grids))
        return plain(spark, sample, grids, **k)

    monkeypatch.setattr(S, "grid_search", search)
    assert q_models.q_learning_curve(spark, train.ctx.sf_dir).count() == 50
    assert searched == [["Tuned RF"]]
    alone = S.winners(plain(spark, train.sample, {"Tuned RF": GRIDS["Tuned RF"]}))
    assert alone["Tuned RF"] == S.winners(plain(spark, train.sample, GRIDS))["Tuned RF"]


def test_forest_ranges_and_attribution(spark, train):
    forest = FO.fit(spark, train.sample, train.feats, trees=25, depth=6)
    alone = T.forest(T.binned(train.sample.values, forest.edges).codes, T.BINS, train.sample.labels, np.ones(len(train.sample.labels)), 25, 6, 1, 42)
    rows = train.rows.select(train.spec.key, *train.feats)
    preds = {r[0]: r for r in FO.tree_predictions(forest, rows).select(train.spec.key, "prediction", "tree_preds").collect()}
    assert all(abs(np.mean(r["tree_preds"]) - r["prediction"]) < 1e-12 and len(r["tree_preds"]) == 25 for r in preds.values())
    assert np.allclose([preds[k]["prediction"] for k in train.sample.keys], alone[6, 25], rtol=0, atol=1e-12)
    for r in FO.predict_range(forest, rows, train.spec).collect():
        each = preds[r[train.spec.key]]["tree_preds"]
        assert abs(r["log_low"] - np.percentile(each, 25)) < 1e-12 and abs(r["log_high"] - np.percentile(each, 75)) < 1e-12
    attributed = FO.path_attribution(forest, rows)
    for r in attributed.collect():
        assert abs(r["bias"] + sum(r["contributions"]) - r["prediction"]) < 1e-9
    plan = attributed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryTableScan")[0] and "Generate" not in plan.split("InMemoryTableScan")[0]
    summary = FO.attribution_summary(attributed, train.feats).collect()
    want = np.abs(np.array([r["contributions"] for r in attributed.collect()])).mean(axis=0)
    assert len(summary) == len(train.feats)
    assert all(abs(r["mean_abs_contribution"] - want[train.feats.index(r["feature"])]) < 1e-12 for r in summary)
    shares = [i for _, _, i in forest.importances()]
    assert abs(sum(shares) - 1) < 1e-9 and shares == sorted(shares, reverse=True)


def test_the_full_forest_fits_within_a_minute(spark, train):
    import time
    began = time.time()
    forest = FO.fit(spark, train.sample, train.feats)
    assert forest.count == FO.TREES and max(len(g.levels) for _, g in forest.batches) <= FO.DEPTH + 1
    assert time.time() - began < 60
