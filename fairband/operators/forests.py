"""Random forests on a bounded sample: grown in Spark tasks, applied to any number of rows.

Each task grows some of the trees (``trees.grow``) on the broadcast sample; the
forest that comes back is bounded by the sample.  Scoring, the quartiles of the
tree predictions and the attribution of a prediction to features are one pass
over the rows without a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairband.operators import trees as T
from fairband.operators.selection import Sample, over_tasks
from fairband.session import send_package
from fairband.spec import PanelSpec

TREES, DEPTH = 200, 15
TREES_PER_TASK = 10
AHEAD = 2048  # rows scored together


@dataclass
class Forest:
    """Edges of the feature bins and batches of grown trees."""
    features: list[str]
    edges: list[np.ndarray]
    batches: list[tuple[int, T.Trees]]

    @property
    def count(self) -> int:
        return sum(n for n, _ in self.batches)

    def each(self, values: np.ndarray) -> np.ndarray:
        """Prediction of every (tree, row)."""
        codes = T.binned(values, self.edges).codes
        return np.vstack([grown.predict(codes, n) for n, grown in self.batches])

    def importances(self) -> list[tuple[int, str, float]]:
        """(rank, feature, importance), strongest first: a tree's gains add up to one, trees count alike."""
        gains = np.vstack([grown.gains(n, len(self.features)) for n, grown in self.batches])
        total = gains.sum(axis=1, keepdims=True)
        share = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).mean(axis=0)
        share = share / share.sum() if share.sum() > 0 else share
        order = sorted(range(len(share)), key=lambda i: (-share[i], self.features[i]))
        return [(rank, self.features[i], float(share[i])) for rank, i in enumerate(order, start=1)]


def fit(spark: SparkSession, sample: Sample, features: list[str], trees: int = TREES, depth: int = DEPTH, least: float = 1,
        seed: int = 42, bins: int = T.BINS) -> Forest:
    """A forest over the whole sample; every tree depends on its number and ``seed`` only, not on the tasks."""
    edges = T.quantile_edges(sample.values, bins)

    def part(task: tuple, shared: tuple) -> pd.DataFrame:
        (first, count), (labels, codes) = task, shared
        _, kept = T.forest(codes, bins, labels, np.ones(len(labels)), count, depth, least, seed, batch=TREES_PER_TASK, keep=True, first=first)
        return pd.DataFrame([(first, pickle.dumps(kept))], columns=["first", "grown"])

    tasks = [(i, min(TREES_PER_TASK, trees - i)) for i in range(0, trees, TREES_PER_TASK)]
    got = over_tasks(spark, tasks, (sample.labels, T.binned(sample.values, edges).codes), part, "first int, grown binary").collect()
    return Forest(list(features), edges, sum((pickle.loads(r["grown"]) for r in sorted(got, key=lambda r: r["first"])), []))


def _mapped(forest: Forest, df: DataFrame, new: str, add) -> DataFrame:
    """``df`` with the columns that ``add(forest, values)`` gives for every row's features."""
    send_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(forest)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), AHEAD):
                rows = batch.iloc[at:at + AHEAD].reset_index(drop=True)
                yield pd.concat([rows, add(shared.value, rows[shared.value.features].to_numpy(float))], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, {new}")


def predict(forest: Forest, df: DataFrame) -> DataFrame:
    """Add ``prediction``, the mean of the trees (log scale)."""
    return _mapped(forest, df, "prediction double", lambda f, values: pd.DataFrame({"prediction": f.each(values).mean(axis=0)}))


def tree_predictions(forest: Forest, df: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``tree_preds``, the predictions of the trees (log scale)."""
    def add(f: Forest, values: np.ndarray) -> pd.DataFrame:
        each = f.each(values)
        return pd.DataFrame({"prediction": each.mean(axis=0), "tree_preds": list(each.T)})
    return _mapped(forest, df, "prediction double, tree_preds array<double>", add)


def predict_range(forest: Forest, df: DataFrame, spec: PanelSpec, low_q: float = 0.25, high_q: float = 0.75) -> DataFrame:
    """``predict_range``: quantiles (linear interpolation, log scale) and mean of the tree predictions, and the same as money."""
    def add(f: Forest, values: np.ndarray) -> pd.DataFrame:
        each = f.each(values)
        low, high = np.quantile(each, [low_q, high_q], axis=0)
        return pd.DataFrame({"log_low": low, "log_high": high, "log_center": each.mean(axis=0)})
    return (_mapped(forest, df, "log_low double, log_high double, log_center double", add)
            .withColumns({spec.low: F.expm1("log_low"), spec.high: F.expm1("log_high"), spec.center: F.expm1("log_center")}))


def path_attribution(forest: Forest, df: DataFrame) -> DataFrame:
    """``path_attribution``: add ``bias``, ``contributions`` (array in feature order) and ``prediction``.

    A feature's contribution is the sum of (child mean - node mean) over its splits
    on the row's way through every tree, averaged over the trees.  They are
    summed in a dense vector per row as the row goes down, so nothing is
    exploded or shuffled.  bias + sum of the contributions = prediction.
    """
    def add(f: Forest, values: np.ndarray) -> pd.DataFrame:
        codes = T.binned(values, f.edges).codes
        parts = [grown.steps(codes, n, len(f.features)) for n, grown in f.batches]
        bias, changes = sum(p[0] for p in parts) / f.count, sum(p[1] for p in parts) / f.count
        return pd.DataFrame({"bias": bias, "contributions": list(changes), "prediction": f.each(values).mean(axis=0)})
    return _mapped(forest, df, "bias double, contributions array<double>, prediction double", add)


def attribution_summary(attributed: DataFrame, features: list[str]) -> DataFrame:
    """``attribution_summary``: mean |contribution| and value-contribution correlation per feature, in one aggregate, largest first."""
    aggs = []
    for i, f in enumerate(features):
        c, v = F.element_at("contributions", i + 1), F.col(f).cast("double")
        spread = F.sqrt(F.var_pop(v) * F.var_pop(c))
        aggs.append(F.struct(F.lit(f).alias("feature"), F.avg(F.abs(c)).alias("mean_abs_contribution"),
                             (F.covar_pop(v, c) / F.nullif(spread, F.lit(0.0))).alias("dependence"), F.count("*").alias("n")))
    return (attributed.agg(F.array(*aggs).alias("rows")).select(F.inline("rows")).orderBy(F.col("mean_abs_contribution").desc(), "feature"))
