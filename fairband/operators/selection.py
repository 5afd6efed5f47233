"""Model search, cross-validation and stacking around one table of predictions.

The work is laid out so that nothing is fitted twice:

* linear models need only cross products, one sum per fold over all rows (``gram``); every
  fit on any set of folds is a difference of those sums and a small solve;
* tree models are searched and fitted on all train rows (``rows``, ``grower``).  A task is one
  (batch of candidates, folds left out); a boosted model of 1,000 rounds scores its
  own prefixes, a deep forest its shallower and smaller ones;
* every fit leaves out no fold, one fold or two.  Predictions for left-out rows form
  one long table (row, folds left out, model, prediction) that cross-validation,
  stacking, its own cross-validation and the metric table all read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairband.functions.scalar import range_check_ok
from fairband.operators import grower as G
from fairband.operators import trees as T
from fairband.operators.models import LABEL
from fairband.operators.rows import FOLD, KEY, NO_FOLD, WHOLE, Rows, complete
from fairband.operators.rows import LABEL as LABELS
from fairband.session import materialize, scratch_path, send_package
from fairband.spec import PanelSpec

FOLDS = 5
MOST_ROWS = 20_000  # train rows of the forests that are kept whole (``forests``)
SEARCH_BINS = 32
BATCH = 6  # boosted models of a task of the search
AHEAD = 100_000  # predictions that a task hands on at once

# fixed values: the candidates searched
GRIDS = {
    "Tuned RF": {"trees": (300, 500, 800), "depth": (6, 8, 10), "least": (10, 15, 20)},
    "Tuned XGBoost": {"trees": (500, 800, 1000), "depth": (3, 4, 5), "rate": (0.005, 0.01, 0.05), "rows": (0.7, 0.8),
                      "columns": (0.7, 0.8), "l1": (0.1, 1.0, 5.0), "l2": (1.0, 5.0)},
    "Tuned GB": {"trees": (500, 800, 1000), "depth": (3, 4), "rate": (0.005, 0.01, 0.05), "rows": (0.7, 0.8), "least": (10, 15)},
}
LINEAR = {"Linear Regression": ("ols", 0.0), "Ridge": ("ridge", 1.0), "Lasso": ("lasso", 0.01)}
UNTUNED = {
    "Random Forest": {"trees": 200, "depth": 15, "least": 1},
    "Gradient Boosting": {"trees": 200, "depth": 5, "rate": 0.1},
    "XGBoost": {"trees": 200, "depth": 5, "rate": 0.1, "l2": 1.0},
}
STACK = "Stacking Ensemble"
BASES = ("Ridge", "Lasso", "Tuned RF", "Tuned GB", "Tuned XGBoost")
ORDER = (*LINEAR, *UNTUNED, "Tuned RF", "Tuned XGBoost", "Tuned GB", STACK)


def is_forest(model: str) -> bool:
    return model in ("Random Forest", "Tuned RF")


# ------------------------------------------------------------------ the sample

@dataclass
class Sample:
    """Bounded train rows in key order: keys, folds, labels and raw features."""
    keys: np.ndarray
    folds: np.ndarray
    labels: np.ndarray
    values: np.ndarray


def take_sample(train: DataFrame, key: str, features: list[str], most_rows: int = MOST_ROWS) -> Sample:
    """At most ``most_rows`` rows of ``train`` (with ``fold`` and the label), chosen by a hash of the key."""
    few = (train.orderBy(F.xxhash64(key), key).limit(most_rows)
           .select(key, "fold", LABEL, *[F.col(f).cast("double").alias(f) for f in features]).toPandas().sort_values(key, kind="stable"))
    return Sample(few[key].to_numpy(), few["fold"].to_numpy(np.int64), few[LABEL].to_numpy(float), few[features].to_numpy(float))


def over_tasks(spark: SparkSession, tasks: list, shared, work: Callable[[object, object], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``work(task, shared)`` for every task in a Spark partition of its own.  ``shared`` has a bounded size."""
    send_package(spark)
    both = spark.sparkContext.broadcast((tasks, shared))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                yield work(both.value[0][i], both.value[1])

    return spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInPandas(run, schema)


# ------------------------------------------------------------------ staged search

def candidates(grid: dict[str, tuple]) -> list[dict]:
    """All combinations of a grid; the order decides ties."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _search_tasks(grids: dict[str, dict], folds: list[int], batch: int = BATCH) -> list[tuple]:
    """(model, fold, candidates answered by one staged fit): forests by leaf size, boosting by depth in batches."""
    out = []
    for model, grid in grids.items():
        every = [c | {"candidate": i} for i, c in enumerate(candidates(grid))]
        fits: dict = {}
        for c in every:
            fit = ("least", c["least"]) if is_forest(model) else tuple((k, v) for k, v in c.items() if k not in ("trees", "candidate"))
            fits.setdefault(fit, []).append(c)
        if is_forest(model):
            parts = [list(cs) for cs in fits.values()]
        else:
            parts, by_depth = [], {}
            for cs in fits.values():
                by_depth.setdefault((cs[0]["depth"], cs[0].get("columns")), []).append(cs)
            for of in by_depth.values():
                parts += [sum(of[i:i + batch], []) for i in range(0, len(of), batch)]
        out += [(model, fold, part) for part in parts for fold in folds]

    def length(task: tuple) -> int:
        """About how much counting a task takes: a level below the root counts half of the rows."""
        stages, depths = {c["trees"] for c in task[2]}, {c["depth"] for c in task[2]}
        return max(stages) * (2 + max(depths)) * (1 if is_forest(task[0]) else len(task[2]) // len(stages))

    return sorted(out, key=lambda t: -length(t))  # the longest first, so that the last tasks are short


def _boost(c: dict) -> T.Boost:
    return T.Boost(**{k: c[k] for k in ("depth", "rate", "rows", "columns", "least", "l1", "l2") if k in c})


def _search(task: tuple, bins: int, seed: int) -> tuple[str, list[int]]:
    """The task in words, and the candidates in the order of its answers."""
    model, _, part = task
    stages = sorted({c["trees"] for c in part})
    if is_forest(model):
        depths, of = sorted({c["depth"] for c in part}), {(c["depth"], c["trees"]): c["candidate"] for c in part}
        return G.forest_task(seed, bins, part[0]["least"], stages, depths, "scores"), [of.get((d, t)) for d in depths for t in stages]
    models, of = sorted({_boost(c) for c in part}, key=lambda m: (m.rows, repr(m))), {(_boost(c), c["trees"]): c["candidate"] for c in part}
    return G.boosted_task(seed, bins, stages, models, "scores"), [of.get((m, t)) for t in stages for m in models]


def grid_search(spark: SparkSession, rows: Rows, grids: dict[str, dict] | None = None, bins: int = SEARCH_BINS, seed: int = 42) -> DataFrame:
    """One row per candidate of every grid: ``model, candidate, params, cv_mean, cv_std, folds, best``.

    R² of each held-out fold, its mean and population deviation; ``best`` is the
    highest mean, ties to the first candidate.  Results are kept below
    ``spark.checkpoint.dir`` under a digest of the rows and the grids, so the
    same search is not run twice.  Folds without rows, or with one value only, do not count.
    """
    grids = GRIDS if grids is None else grids
    path = scratch_path(spark, f"searches/{rows.digest(grids, bins, seed)}")
    schema = "model string, candidate int, fold int, n long, ss_res double, ss_tot double"
    if not complete(spark, path):
        tasks = _search_tasks(grids, rows.fold_numbers)
        searched = [_search(t, bins, seed) for t in tasks]
        heads, answers = [(model, fold) for model, fold, _ in tasks], [of for _, of in searched]

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i, out in zip(batch["id"], batch["out"]):
                    (model, fold), sums = heads[i], np.frombuffer(out, "<f8").reshape(-1, 6)
                    yield pd.DataFrame([(model, c, fold, int(s[3]), s[4], s[5]) for c, s in zip(answers[i], sums) if c is not None],
                                       columns=["model", "candidate", "fold", "n", "ss_res", "ss_tot"])

        fits = rows.fitted([((fold, fold, WHOLE), w) for (_, fold), (w, _) in zip(heads, searched)], bins)
        fits.select("id", "out").mapInPandas(scored, schema).write.mode("overwrite").parquet(path)
    scores = spark.read.schema(schema).parquet(path).withColumn("r2", 1 - F.col("ss_res") / F.nullif(F.col("ss_tot"), F.lit(0.0)))
    names = spark.createDataFrame([(m, i, {k: float(v) for k, v in c.items()}) for m, g in grids.items() for i, c in enumerate(candidates(g))],
                                  "model string, candidate int, params map<string,double>")
    table = scores.groupBy("model", "candidate").agg(F.avg("r2").alias("cv_mean"), F.stddev_pop("r2").alias("cv_std"),
                                                     F.count("r2").cast("int").alias("folds"))
    first = F.row_number().over(Window.partitionBy("model").orderBy(F.col("cv_mean").desc_nulls_last(), "candidate"))
    return names.join(table, ["model", "candidate"]).withColumn("best", first == 1)


def flat_params(table: DataFrame) -> DataFrame:
    """The search table with a column per parameter (null where a model has none)."""
    names = ("trees", "depth", "least", "rate", "rows", "columns", "l1", "l2")
    return table.select("model", "candidate", *[F.try_element_at("params", F.lit(n)).alias(n) for n in names], "cv_mean", "cv_std", "folds", "best")


def winners(table: DataFrame) -> dict[str, dict]:
    """Parameters of the best candidate of every grid."""
    whole = ("trees", "depth", "least")
    return {r["model"]: {k: int(v) if k in whole else v for k, v in r["params"].items()} for r in table.filter("best").collect()}


# ------------------------------------------------------------------ linear models

def gram(df: DataFrame, x: list[str], by: list[str]) -> dict[tuple, np.ndarray]:
    """Per group of ``by`` the cross products of ``(1, x..., label)`` over all rows, as one symmetric matrix.

    Every batch of rows becomes one matrix per group before anything is shuffled.
    """
    send_package(df.sparkSession)
    size = len(x) + 2
    upper = np.triu_indices(size)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby(by, sort=False):
                z = np.column_stack([np.ones(len(part)), part[[*x, LABEL]].to_numpy(float)])
                yield pd.DataFrame([(*name, (z.T @ z)[upper].tolist())], columns=[*by, "m"])

    kinds = ", ".join(f"{c} int" for c in by)
    each = df.select(*[F.col(c).cast("int").alias(c) for c in by], *x, LABEL).mapInPandas(products, f"{kinds}, m array<double>")
    cells = each.select(*by, F.posexplode("m").alias("cell", "v")).groupBy(*by, "cell").agg(F.sum("v").alias("v"))
    out: dict[tuple, np.ndarray] = {}
    for r in cells.collect():  # groups x (features + 2)^2 / 2 numbers
        m = out.setdefault(tuple(r[c] for c in by), np.zeros((size, size)))
        i, j = upper[0][r["cell"]], upper[1][r["cell"]]
        m[i, j] = m[j, i] = r["v"]
    return out


def solve(cross: np.ndarray, kind: str, alpha: float = 0.0) -> np.ndarray:
    """Intercept and coefficients from cross products: least squares, ridge ``|e|^2 + a|w|^2``, or lasso ``|e|^2/2n + a|w|_1``."""
    n = cross[0, 0]
    mean = cross[0, 1:] / n
    centred = cross[1:, 1:] - n * np.outer(mean, mean)
    xx, xy = centred[:-1, :-1], centred[:-1, -1]
    if kind == "ols":
        w = np.linalg.lstsq(xx, xy, rcond=1e-10)[0]
    elif kind == "ridge":
        w = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)
    else:
        w = np.zeros(len(xx))
        for _ in range(10_000):
            before = w.copy()
            for j in np.flatnonzero(np.diag(xx) > 1e-12 * n):
                rho = (xy[j] - xx[j] @ w + xx[j, j] * w[j]) / n
                w[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / (xx[j, j] / n)
            if np.abs(w - before).max() < 1e-12:
                break
    return np.concatenate([[mean[-1] - mean[:-1] @ w], w])


# ------------------------------------------------------------------ the long table

PREDICTED = "key long, split string, fold int, label double, model string, out_a int, out_b int, prediction double, low double, high double"


def _outs(folds: list[int], pairs: bool) -> list[tuple[int, int]]:
    """Folds left out by a fit: none, one, and two where stacking is cross-validated."""
    return [(NO_FOLD, NO_FOLD), *[(k, k) for k in folds], *(combinations(folds, 2) if pairs else [])]


def _fit(model: str, params: dict, seed: int, output: str) -> str:
    if is_forest(model):
        return G.forest_task(seed, T.BINS, params["least"], (params["trees"],), (params["depth"],), output)
    return G.boosted_task(seed, T.BINS, (params["trees"],), [_boost(params)], output)


def _predicted_rows(fits: DataFrame, heads: list[tuple[str, tuple[int, int]]]) -> DataFrame:
    """The predictions of ``fits`` (with keys, folds and labels): of held rows, or of all by fits that leave out nothing."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, out, also in zip(batch["id"], batch["out"], batch["a"]):
                model, (a, b) = heads[i]
                keys, folds, labels = (np.frombuffer(x, kind) for x, kind in zip(also, ("<i8", "<i4", "<f8")))
                of = np.flatnonzero(np.isin(folds, (a, b))) if a != NO_FOLD else np.arange(len(keys))
                values = np.frombuffer(out, "<f8").reshape(-1, len(of))
                for at in range(0, len(of), AHEAD):
                    some, part = of[at:at + AHEAD], slice(at, at + AHEAD)
                    yield pd.DataFrame({"key": keys[some], "split": np.where(folds[some] >= 0, "train", "test"), "fold": folds[some], "label": labels[some],
                                        "model": model, "out_a": a, "out_b": b, "prediction": values[0, part],
                                        "low": values[1, part] if len(values) > 1 else np.nan, "high": values[2, part] if len(values) > 1 else np.nan})

    return fits.mapInPandas(rows, PREDICTED)


class Models:
    """All ten models on one feature table: fitted once, predictions in one written table.

    ``table`` holds the key, ``split``, ``fold`` (train rows), label and raw features,
    ``scaled`` the same features standardised.  ``cv`` fits the models without each fold as well,
    ``pairs`` without each two, which the stack's own cross-validation needs.
    """

    def __init__(self, table: DataFrame, scaled: DataFrame, spec: PanelSpec, features: list[str], tuned: dict[str, dict],
                 train: Rows, pairs: bool = True, models: tuple[str, ...] = ORDER, seed: int = 42, cv: bool = True):
        self.spark, self.spec, self.features, self.models = table.sparkSession, spec, features, models
        self.params = {m: p for m, p in (UNTUNED | tuned).items() if m in models or (STACK in models and m in BASES)}
        self.linear = {m: p for m, p in LINEAR.items() if m in models or (STACK in models and m in BASES)}
        self.folds = train.fold_numbers if cv or STACK in models else []
        self.pairs = pairs and STACK in models
        self.predictions = self._predicted(table, scaled, train, seed)

    def _fitted_trees(self, table: DataFrame, train: Rows, seed: int) -> DataFrame:
        """Predictions of the tree models: each fit is a task, and scores its rows itself, so that no model travels."""
        every = Rows(table, self.spec.key, self.features)
        stacked = [m for m in self.params if m in BASES]
        cost = lambda t: -t[1]["trees"] * (2 + t[1]["depth"])
        some = sorted(((m, p, out) for m, p in self.params.items() for out in _outs(self.folds, self.pairs and m in stacked) if out[0] != NO_FOLD), key=cost)
        whole = sorted(((m, p, (NO_FOLD, NO_FOLD)) for m, p in self.params.items()), key=cost)
        path = scratch_path(self.spark, f"models/fits-{every.digest(self.params, self.folds, self.pairs, seed)}")
        if not complete(self.spark, path):
            parts = []
            for rows, tasks, outputs in ((every, whole, {"Tuned RF": "quartiles"}), (train, some, {})):
                words = [((*out, WHOLE), _fit(m, p, seed, outputs.get(m, "all" if out[0] == NO_FOLD else "held"))) for m, p, out in tasks]
                if tasks:
                    parts.append(_predicted_rows(rows.fitted(words, T.BINS, (KEY, FOLD, LABELS)), [(m, out) for m, _, out in tasks]))
            reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(PREDICTED).parquet(path)

    def _predicted(self, table: DataFrame, scaled: DataFrame, train: Rows, seed: int) -> DataFrame:
        key = self.spec.key
        fits = self._fitted_trees(table, train, seed) if self.params else None
        sums = gram(scaled.filter("split = 'train'"), self.features, ["fold"]) if self.linear else {}
        total = sum(sums.values())
        self.coefficients = {}
        for m, (kind, alpha) in self.linear.items():
            for out in _outs(self.folds, self.pairs and m in BASES):
                left = total - sum(sums[k,] for k in set(out) if k != NO_FOLD)
                self.coefficients[m, *out] = solve(left, kind, alpha)

        send_package(self.spark)
        shared = self.spark.sparkContext.broadcast(self.coefficients)  # bounded by the models' sizes
        features = self.features

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = np.column_stack([np.ones(len(batch)), batch[["z_" + f for f in features]].to_numpy(float)])
                fold = batch["fold"].to_numpy(np.int64)
                head = batch[["key", "split", "fold", "label"]]
                for (model, a, b), w in shared.value.items():
                    rows = np.isin(fold, (a, b)) if a != NO_FOLD else np.ones(len(fold), bool)
                    yield head[rows].assign(model=model, out_a=a, out_b=b, prediction=(x[rows] @ w), low=np.nan, high=np.nan)

        zs = scaled.select(key, "split", F.coalesce("fold", F.lit(-2)).cast("int").alias("fold"), F.col(LABEL).cast("double").alias("label"),
                           *[F.col(f).alias("z_" + f) for f in features])
        parts = [zs.withColumnRenamed(key, "key").mapInPandas(apply, PREDICTED)] if self.linear else []
        long = materialize(reduce(DataFrame.unionByName, [*parts, *([fits] if fits is not None else [])]), "predictions")
        return long.unionByName(self._stacked(long)) if STACK in self.models else long

    def _stacked(self, long: DataFrame) -> DataFrame:
        """Predictions of the stack: a ridge over out-of-fold predictions of its bases.

        For its own cross-validation the ridge that is tested on fold k learns from
        bases that saw neither fold k nor the row's own fold.
        """
        names = [f"m{i}" for i in range(len(BASES))]
        wide = materialize(long.filter(F.col("model").isin(*BASES)).groupBy("key", "split", "fold", "label", "out_a", "out_b")
                           .agg(*[F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(n) for m, n in zip(BASES, names)])
                           .withColumnRenamed("label", LABEL), "stack-inputs")
        oof = wide.filter("out_a = out_b and out_a >= 0 and m2 is not null")
        whole = gram(oof, names, ["fold"])
        self.meta = {NO_FOLD: solve(sum(whole.values()), "ridge", 1.0)}
        if self.pairs:
            inner = gram(wide.filter("out_a <> out_b"), names, ["out_a", "out_b", "fold"])
            for k in self.folds:  # rows of fold j, predicted without j and k, teach the ridge that is tested on k
                self.meta[k] = solve(sum(m for (a, b, j), m in inner.items() if k in (a, b) and j != k), "ridge", 1.0)

        def dot(w: np.ndarray) -> Column:
            return sum((F.lit(float(c)) * F.col(n) for c, n in zip(w[1:], names)), F.lit(float(w[0])))

        final = wide.filter(F.col("out_a") == NO_FOLD).withColumn("prediction", dot(self.meta[NO_FOLD]))
        parts = [final]
        for k, w in self.meta.items():
            if k != NO_FOLD:
                parts.append(oof.filter(F.col("out_a") == k).withColumn("prediction", dot(w)))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        none = F.lit(None).cast("double")
        return out.select("key", "split", "fold", F.col(LABEL).alias("label"), F.lit(STACK).alias("model"), "out_a", "out_b", "prediction",
                          none.alias("low"), none.alias("high"))

    def out_of_fold(self) -> DataFrame:
        """``key, fold, model, label, prediction``: every train row once per model, predicted without its fold."""
        return self.predictions.filter((F.col("out_a") == F.col("out_b")) & (F.col("out_a") >= 0)).select("key", "fold", "model", "label", "prediction")

    def cross_validation(self) -> DataFrame:
        """R² of every (model, fold)."""
        return self.out_of_fold().groupBy("model", "fold").agg(F.count("*").alias("n"), r2().alias("r2"))

    def metrics(self) -> DataFrame:
        """One row per model: scores of both splits, cross-validation, and for tuned ones the range accuracy of the tuned forest."""
        a, e = F.expm1("label"), F.expm1("prediction")
        test, train = F.col("split") == "test", F.col("split") == "train"
        within = F.when(a > 0, (F.abs(e - a) / a <= 0.3).cast("double"))
        fit = self.predictions.filter(F.col("out_a") == NO_FOLD)
        table = fit.groupBy("model").agg(
            r2(train).alias("train_r2"), r2(test).alias("test_r2"), F.avg(F.when(test, F.abs(e - a))).alias("mae"),
            F.sqrt(F.avg(F.when(test, (e - a) ** 2))).alias("rmse"), (F.avg(F.when(test, within)) * 100).alias("within_30"),
            F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"))
        cv = self.cross_validation().groupBy("model").agg(F.avg("r2").alias("cv_mean"), F.stddev_pop("r2").alias("cv_std"))
        hit = range_check_ok(F.expm1("label"), F.expm1("low"), F.expm1("high")).cast("double")
        accuracy = fit.filter((F.col("model") == "Tuned RF") & test).agg((F.avg(hit) * 100).alias("r")).select("r").scalar()
        tuned = F.col("model").startswith("Tuned") | (F.col("model") == STACK)
        return (table.join(cv, "model").withColumn("range_accuracy", F.when(tuned, accuracy))
                .withColumn("ordinal", F.array_position(F.array(*[F.lit(m) for m in ORDER]), F.col("model")).cast("int"))
                .select("ordinal", "model", "train_r2", "test_r2", "cv_mean", "cv_std", "mae", "rmse", "within_30", "range_accuracy", "n_train", "n_test"))


def r2(where: Column | None = None) -> Column:
    """1 - mean squared error / variance, in one pass; null for a single value."""
    y, p = F.col("label"), F.col("prediction")
    if where is not None:
        y, p = F.when(where, y), F.when(where, p)
    return 1 - F.avg((y - p) ** 2) / F.nullif(F.var_pop(y), F.lit(0.0))


# ------------------------------------------------------------------ learning curve

def learning_curve(spark: SparkSession, rows: Rows, params: dict, shares=range(10, 101, 10), seed: int = 42) -> DataFrame:
    """Forest R² on the rows it learned from and on the held-out fold, for growing nested shares of the other folds."""
    heads = [(s, f) for s in reversed(list(shares)) for f in rows.fold_numbers]
    words = G.forest_task(seed, T.BINS, params["least"], (params["trees"],), (params["depth"],), "both")

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, out in zip(batch["id"], batch["out"]):
                sums = np.frombuffer(out, "<f8").reshape(2, 3)  # of learnt and held rows
                yield pd.DataFrame([(*heads[i], int(sums[0, 0]), *[None if s[2] == 0 else 1 - s[1] / s[2] for s in sums])],
                                   columns=["train_share", "fold", "train_rows", "train_r2", "validation_r2"])

    fits = rows.fitted([((f, f, s), words) for s, f in heads], T.BINS)
    return fits.select("id", "out").mapInPandas(scored, "train_share int, fold int, train_rows int, train_r2 double, validation_r2 double")
