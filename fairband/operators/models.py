"""Model fitting with Spark ML and native (UDF-free) per-tree range scoring.

Targets are modelled on the log1p scale.  Inputs are range-partitioned and
sorted by key before every tree fit so results do not depend on how the
source files happened to be split.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairband.operators.features import split_bucket
from fairband.session import scratch_path
from fairband.spec import PanelSpec

LABEL = "label"


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    """``assemble``: ordered feature vector (VectorAssembler, JVM side)."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def with_label(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.withColumn(LABEL, F.log1p(F.col(spec.target)))


FEW_PARTITIONS, ROWS_PER_PARTITION = 4, 250_000
BOOSTED_ROWS_PER_PARTITION = 25_000  # small trees cost a task little: enough partitions for all cores, the last wave a short one
# node statistics of one pass: every task that runs holds as much; rows walk down again, which costs less than a kept table of nodes
TREE_MEMORY = dict(maxMemoryInMB=256, cacheNodeIds=False, checkpointInterval=10)


def stable_order(df: DataFrame, key: str, parts: int | None = None, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Deterministic partitioning for tree learners: same data and ``parts``, same model, on any cluster.

    Every task of a fit unpacks the trees grown so far, so small tables get few
    partitions, and large ones one for every ``rows_per_partition`` rows.
    """
    if parts is None:
        parts = max(FEW_PARTITIONS, -(-df.count() // rows_per_partition))
    return df.repartitionByRange(parts, F.col(key)).sortWithinPartitions(key)


def linear_model(kind: str, n: int = 1, y_std_pop: float = 1.0, alpha: float | None = None) -> LinearRegression:
    """OLS / ridge / lasso on already standardised inputs.

    ridge(alpha) = ``regParam = alpha / n * std_pop(y)`` with the normal-equation
    solver; lasso(alpha) = ``regParam = alpha, elasticNetParam = 1``.
    """
    base = dict(featuresCol="features", labelCol=LABEL, standardization=False)
    if kind == "linear":
        return LinearRegression(regParam=0.0, solver="normal", **base)
    if kind == "ridge":
        a = 1.0 if alpha is None else alpha
        return LinearRegression(regParam=a / n * y_std_pop, elasticNetParam=0.0, solver="normal", **base)
    if kind == "lasso":
        a = 0.01 if alpha is None else alpha
        return LinearRegression(regParam=a, elasticNetParam=1.0, **base)
    raise ValueError(kind)


TREES_PER_TASK = 5


class RowForest(RandomForestRegressor):
    """Spark ML's forest of all features over numbers, grown by the learner of ``rows``: a task grows some trees on all rows.

    The trees are cut at quantiles of all rows and do not depend on the tasks; the order of the rows
    decides what a tree draws.  What the learner cannot do, sampled features or categories, Spark ML fits.
    """

    def _grows(self, dataset: DataFrame) -> bool:
        get = self.getOrDefault
        plain = (get(self.featureSubsetStrategy) == "all" and get(self.bootstrap) and get(self.subsamplingRate) == 1.0 and get(self.minInfoGain) == 0.0
                 and get(self.minWeightFractionPerNode) == 0.0 and get(self.maxBins) <= 64 and not self.isSet(self.weightCol))
        about = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {})
        return plain and "nominal" not in about.get("attrs", {}) and "binary" not in about.get("attrs", {})

    def _fit_java(self, dataset: DataFrame):
        if not self._grows(dataset):
            return super()._fit_java(dataset)
        from fairband.operators import grower as G
        from fairband.operators.rows import NO_FOLD, WHOLE, Rows
        spark, each = dataset.sparkSession, vector_to_array(self.getFeaturesCol())
        width = dataset.select(F.size(each)).first()[0]
        names = [f"_f{i}" for i in range(width)]
        table = dataset.select(F.monotonically_increasing_id().alias("_at"), F.lit(0).alias("fold"), F.col(self.getLabelCol()).alias(LABEL), each.alias("_v"))
        rows = Rows(table.select("_at", "fold", LABEL, *[F.col("_v")[i].alias(n) for i, n in enumerate(names)]), "_at", names)
        trees, bins, least = self.getNumTrees(), self.getMaxBins(), self.getMinInstancesPerNode()
        tasks = [((NO_FOLD, NO_FOLD, WHOLE), G.forest_task(self.getSeed(), bins, least, (min(TREES_PER_TASK, trees - i),), (self.getMaxDepth(),), "nodes", i))
                 for i in range(0, trees, TREES_PER_TASK)]
        grown = rows.fitted(tasks, bins).orderBy("id").select("out")._jdf.collectAsList()  # the model: it stays in the driver's JVM
        edges = ";".join(",".join(map(repr, map(float, e))) for e in rows.edges(bins))
        return G.woods(spark).model(self.uid, grown, edges, trees)


def forest(num_trees: int = 200, max_depth: int = 15, seed: int = 42, **kw) -> RandomForestRegressor:
    """Random forest; every feature is a split candidate at every node (``'all'``)."""
    return RowForest(featuresCol="features", labelCol=LABEL, numTrees=num_trees,
                     maxDepth=max_depth, featureSubsetStrategy=kw.pop("featureSubsetStrategy", "all"),
                     seed=seed, leafCol="leaves", **{**TREE_MEMORY, **kw})


def boosting(max_iter: int = 200, max_depth: int = 5, step: float = 0.1, seed: int = 42, **kw) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol=LABEL, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step, seed=seed, **{**TREE_MEMORY, **kw})


# ---------------------------------------------------------------- native per-tree ranges

_SAVED: dict = {}


def node_table(model) -> DataFrame:
    """The fitted trees' node table ``(treeID, nodeData{id, prediction, leftChild,
    rightChild, split{featureIndex, ...}})`` read back with Spark from the model
    written once to the shared checkpoint folder."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = _SAVED.get(model.uid)
    if path is None:
        path = scratch_path(spark, f"models/{model.uid}")
        model.write().overwrite().save(path)
        _SAVED[model.uid] = path
    return spark.read.parquet(path + "/data")


def leaf_prediction_table(model) -> DataFrame:
    """One row per tree: leaf predictions ordered by leaf node id.

    The leaf index emitted by ``leafCol`` is the rank of the leaf among its
    tree's leaves ordered by node id.
    """
    nodes = node_table(model)
    leaves = nodes.filter(F.col("nodeData.leftChild") < 0).groupBy("treeID").agg(
        F.array_sort(F.collect_list(F.struct(F.col("nodeData.id").alias("id"),
                                             F.col("nodeData.prediction").alias("p")))).alias("_l"))
    return leaves.select("treeID", F.transform("_l", lambda s: s["p"]).alias("leaf_pred"))


def _interp(sorted_arr, q: float):
    n = F.size(sorted_arr)
    pos = F.lit(q) * (n - 1)
    lo_i = F.floor(pos).cast("int")
    hi_i = F.ceil(pos).cast("int")
    lo = F.element_at(sorted_arr, lo_i + 1)
    hi = F.element_at(sorted_arr, hi_i + 1)
    return lo + (hi - lo) * (pos - lo_i)


def _leaf_lookup(model):
    """Scalar-subquery column: array (per tree, by treeID) of leaf predictions.

    Its size is bounded by the model (trees x leaves), never by the data.
    """
    table = leaf_prediction_table(model)
    return (table.agg(F.sort_array(F.collect_list(F.struct("treeID", "leaf_pred"))).alias("t"))
            .select(F.transform("t", lambda s: s["leaf_pred"]).alias("lp")).scalar())


def tree_predictions(model, df: DataFrame) -> DataFrame:
    """Per-row array of the individual tree predictions (log scale), via leaf indices."""
    leaves = vector_to_array(F.col("leaves"))
    # the lookup is projected once as a column: subqueries may not sit inside lambdas
    return (model.transform(df).withColumn("_lp", _leaf_lookup(model))
            .withColumn("tree_preds", F.transform(
                leaves, lambda v, i: F.element_at(F.element_at(F.col("_lp"), i + 1), v.cast("int") + 1)))
            .drop("_lp"))


def predict_range(model, df: DataFrame, spec: PanelSpec, low_q: float = 0.25, high_q: float = 0.75) -> DataFrame:
    """``predict_range``: per-tree predictions -> P25 / P75 (linear interpolation on the
    log scale) and their mean, mapped back with expm1 — without any Python UDF."""
    t = tree_predictions(model, df).withColumn("_trees", F.array_sort("tree_preds"))
    return (t.withColumn("log_low", _interp(F.col("_trees"), low_q))
            .withColumn("log_high", _interp(F.col("_trees"), high_q))
            .withColumn("log_center", F.aggregate("_trees", F.lit(0.0), lambda a, x: a + x) / F.size("_trees"))
            .withColumn(spec.low, F.expm1("log_low"))
            .withColumn(spec.high, F.expm1("log_high"))
            .withColumn(spec.center, F.expm1("log_center"))
            .drop("_trees"))


# ---------------------------------------------------------------- evaluation

def regression_report(pred: DataFrame, spec: PanelSpec, model_name: str, split_col: str = "split") -> DataFrame:
    """Per split: R² (log scale), MAE / RMSE (money scale), within-30 %, in one aggregate."""
    y, p = F.col(LABEL), F.col("prediction")
    a, e = F.expm1(y), F.expm1(p)
    ybar = pred.groupBy(split_col).agg(F.avg(LABEL).alias("_ybar"))
    j = pred.join(ybar, split_col)
    return j.groupBy(split_col).agg(
        (1 - F.sum((y - p) ** 2) / F.nullif(F.sum((y - F.col("_ybar")) ** 2), F.lit(0.0))).alias("r2"),
        F.avg(F.abs(e - a)).alias("mae"), F.sqrt(F.avg((e - a) ** 2)).alias("rmse"),
        (F.avg(F.when(a > 0, (F.abs(e - a) / a <= 0.3).cast("double"))) * 100).alias("within_30"),
        F.count(F.lit(1)).alias("n")).withColumn("model", F.lit(model_name))


def with_folds(df: DataFrame, key: str, k: int = 5, contiguous: bool = True) -> DataFrame:
    """Fold id in 0..k-1.  ``contiguous=True``: unshuffled contiguous blocks in key order
    (fold = floor(rank * k / n), ranks from the distributed prefix-sum rank table);
    otherwise a key hash.  Neither depends on partitioning."""
    if not contiguous:
        return df.withColumn("fold", (split_bucket(key) % k).cast("int"))
    from fairband.operators.analytics import value_rank_table
    ranks = value_rank_table(df.select(key), key).select(key, (F.col("n_at_or_below") - 1).alias("_rk"))
    n = df.agg(F.count(F.lit(1))).scalar()
    return df.join(ranks, key, "left").withColumn(
        "fold", F.least(F.floor(F.col("_rk") * k / n), F.lit(k - 1)).cast("int")).drop("_rk")
