"""Registered model queries (rows-only checks: results depend on learned models)."""

from __future__ import annotations

import uuid
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairband.functions.scalar import in_range, range_check_ok, snap, status
from fairband.operators import artifacts as AR
from fairband.operators import features as FE
from fairband.operators import forests as FO
from fairband.operators import models as M
from fairband.operators import selection as S
from fairband.operators.panel import first_best
from fairband.operators.refresh import refresh_scores
from fairband.plans.context import Ctx, shared
from fairband.plans.oracle_sql import snap as SQL_SNAP, with_panel
from fairband.plans.registry import register
from fairband.session import scratch_path
from fairband.sources.buckets import BucketTable



class Train:
    """Feature table + label + split + folds for one data folder, assembled lazily."""

    def __init__(self, spark, sf_dir):
        self.ctx = Ctx(spark, sf_dir)
        self.spec = self.ctx.spec
        self.feats = self.spec.feature_columns

    @cached_property
    def rows(self):
        """Features and label of every trained row."""
        return shared(self.ctx.spark, self.ctx.sf_dir, self.spec, "train-rows",
                      lambda: M.with_label(FE.feature_table(self.ctx.trained, self.spec), self.spec))

    @cached_property
    def table(self):
        return M.assemble(self.rows, self.feats)

    @cached_property
    def scaled(self):
        sc = FE.fit_scaler(self.table.filter(F.col("split") == "train"), self.feats)
        x = FE.standard_scale(self.table.drop("features"), sc, self.feats)
        return M.assemble(x, self.feats)

    @property
    def train(self):
        return self.table.filter(F.col("split") == "train")

    @property
    def folded(self):
        """Train rows with equal folds: ranks are taken among the train rows alone."""
        return M.with_folds(self.rows.filter(F.col("split") == "train"), self.spec.key)

    @cached_property
    def rf(self):
        return FO.fit(self.ctx.spark, S.take_sample(self.folded, self.spec.key, self.feats), self.feats)

    @cached_property
    def sample(self):
        """All train rows: tree models are searched and fitted on them."""
        return S.Rows(self.folded, self.spec.key, self.feats)

    @cached_property
    def search(self):
        return S.grid_search(self.ctx.spark, self.sample)

    @cached_property
    def tuned(self):
        return S.winners(self.search)

    @cached_property
    def tuned_forest(self):
        """The winner of the forests' grid; candidates are scored one by one, so the other grids have no say in it."""
        return S.winners(S.grid_search(self.ctx.spark, self.sample, {"Tuned RF": S.GRIDS["Tuned RF"]}))["Tuned RF"]

    def models(self, names=S.ORDER, pairs=True, cv=True):
        """Ten models fitted once, with their table of predictions."""
        fold = self.folded.select(self.spec.key, "fold")
        tuned = self.tuned if any(n in S.GRIDS or n == S.STACK for n in names) else {}
        return S.Models(self.rows.join(fold, self.spec.key, "left"), self.scaled.join(fold, self.spec.key, "left"), self.spec, self.feats,
                        tuned, self.sample, pairs, names, cv=cv)

    def report(self, model, name):
        """Train and test scores of one model of the prediction table."""
        fit = self.models((model,), pairs=False, cv=False).predictions.filter((F.col("out_a") == S.NO_FOLD) & (F.col("model") == model))
        return M.regression_report(fit.withColumnRenamed("key", self.spec.key), self.spec, name)


def _report(model, df, spec, name):
    return M.regression_report(model.transform(df), spec, name)


def _linear(kind):
    def q(spark, sf_dir, t=None):
        t = t or Train(spark, sf_dir)
        tr = t.scaled.filter(F.col("split") == "train")
        n = tr.count()
        ystd = tr.agg(F.stddev_pop(M.LABEL)).first()[0]
        return _report(M.linear_model(kind, n=n, y_std_pop=ystd).fit(tr), t.scaled, t.spec, kind)
    return q


for _k in ("linear", "ridge", "lasso"):
    register(f"fit_{_k}")(_linear(_k))


@register("fit_rf")
def q_fit_rf(spark, sf_dir):
    t = Train(spark, sf_dir)
    return M.regression_report(FO.predict(t.rf, t.rows.select("split", M.LABEL, *t.feats)), t.spec, "random_forest")


@register("fit_gbt")
def q_fit_gbt(spark, sf_dir):
    return Train(spark, sf_dir).report("Gradient Boosting", "gradient_boosting")


@register("fit_xgb")
def q_fit_xgb(spark, sf_dir):
    """Boosting with penalised leaves (second-order gains with L1 and L2 terms)."""
    return Train(spark, sf_dir).report("XGBoost", "boosting_regularised")


@register("fit_rf_all_rows")
def q_fit_rf_all_rows(spark, sf_dir):
    """The learner that reads all rows in every pass, for train tables beyond the sample's bound."""
    t = Train(spark, sf_dir)
    return _report(M.forest().fit(M.stable_order(t.train, t.spec.key)), t.table, t.spec, "random_forest")


@register("fit_gbt_all_rows")
def q_fit_gbt_all_rows(spark, sf_dir):
    t = Train(spark, sf_dir)
    return _report(M.boosting().fit(M.stable_order(t.train, t.spec.key, rows_per_partition=M.BOOSTED_ROWS_PER_PARTITION)), t.table, t.spec, "gradient_boosting")


@register("predict_range")
def q_predict_range(spark, sf_dir):
    """Random-forest P25-P75 ranges for every trained row, plus error, flags and status."""
    t = Train(spark, sf_dir)
    s = t.spec
    out = FO.predict_range(t.rf, t.rows.select(s.key, "split", s.target, *[f for f in t.feats]), s)
    a = F.col(s.target)
    return out.select(
        s.key, "split", a.alias(s.target), s.low, s.high, s.center,
        F.coalesce(in_range(a, s.low, s.high), F.lit(False)).alias("actual_in_range"),
        F.coalesce(range_check_ok(a, s.low, s.high), F.lit(False)).alias("range_accuracy_result"),
        status(a, s.low, s.high).alias("status"))


def _new_features(t):
    """Features of entities outside the trained set: what is missing counts as 0.0, an unknown foot as the right one."""
    s = t.spec
    new = FE.onehot_drop_first(FE.encode_foot(t.ctx.untrained, s), s.position, s.position_categories)
    return FE.engineer_features(new.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in s.base_features}), s)


def _score_new(spark, sf_dir, runs=2):
    """Refresh the cache of new entities ``runs`` times: ``(train, features, current rows, run in which each was scored)``."""
    t = Train(spark, sf_dir)
    s = t.spec
    new = _new_features(t)
    table = BucketTable(spark, scratch_path(spark, "scores/new_" + uuid.uuid4().hex[:8]), s.key)
    score = lambda rows: FO.predict_range(t.rf, rows.select(s.key, *t.feats), s).select(s.key, s.low, s.high, s.center)
    scored = []
    for run in range(runs):
        current, made = refresh_scores(table, new, score, f"forest:{len(t.feats)}", f"2001-11-{4 + run:02d}")
        scored.append(made.select(s.key, F.lit(run + 1).alias("run")))
    return t, new, current, reduce(DataFrame.unionByName, scored)


@register("score_new_entities")
def q_score_new(spark, sf_dir):
    """Entities outside the trained set (e.g. other leagues): forest ranges, scored once and then read from the cache."""
    t, new, current, _ = _score_new(spark, sf_dir)
    s = t.spec
    out = new.select(s.key, s.league, s.target).join(current, s.key)
    return out.select(s.key, s.league, s.low, s.high, s.center, status(F.col(s.target), s.low, s.high).alias("status"))


@register("score_new_keys", with_panel(f"""
SELECT player_pk, 'forest:23' AS model_version, '2001-11-04' AS computed_on, 1 AS runs, 1 AS last_run, coalesce(minutes, 0.0) AS minutes,
  coalesce(market_value_eur, 0.0) AS market_value_eur, {SQL_SNAP('coalesce(rating, 0.0)', 6)} AS rating,
  CASE WHEN preferred_foot = 'Left' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS foot FROM untrained"""))
def q_score_new_keys(spark, sf_dir):
    """Which entities two refreshes scored (the second none), in which run, and what was filled in for them."""
    t, new, current, runs = _score_new(spark, sf_dir)
    key = t.spec.key
    per = runs.groupBy(key).agg(F.count("*").alias("runs"), F.max("run").alias("last_run"))
    return (new.join(current.select(key, "model_version", F.date_format("computed_at", "yyyy-MM-dd").alias("computed_on")), key).join(per, key)
            .select(key, "model_version", "computed_on", "runs", "last_run", "minutes", "market_value_eur", snap("rating", 6).alias("rating"),
                    F.col(t.spec.foot + "_code").alias("foot")))


@register("cross_validate")
def q_cv(spark, sf_dir):
    """R² of all ten models on each of the five folds, from the one out-of-fold table."""
    return Train(spark, sf_dir).models().cross_validation()


@register("grid_search")
def q_grid(spark, sf_dir):
    """All 747 candidates of the three grids with their five-fold scores; one best per grid."""
    return S.flat_params(Train(spark, sf_dir).search)


@register("stacking")
def q_stacking(spark, sf_dir):
    """Ridge over the out-of-fold predictions of ridge, lasso and the three tuned tree models."""
    return Train(spark, sf_dir).report(S.STACK, "stacking")


@register("model_metrics_table")
def q_metrics_table(spark, sf_dir):
    """Train, test and cross-validation scores of all ten models: one aggregate over one table of predictions."""
    return Train(spark, sf_dir).models().metrics()


@register("model_select")
def q_model_select(spark, sf_dir):
    """Highest test within-30 % among the tuned models and the stack; the first listed wins ties."""
    tab = q_metrics_table(spark, sf_dir).filter(F.col("model").isin("Tuned RF", "Tuned XGBoost", "Tuned GB", S.STACK))
    return first_best(tab.withColumn("g", F.lit(0)), ["g"], "within_30", "ordinal").drop("g")


@register("feature_importance")
def q_importance(spark, sf_dir):
    t = Train(spark, sf_dir)
    return spark.createDataFrame(t.rf.importances(), "rank int, feature string, importance double")


@register("learning_curve")
def q_learning_curve(spark, sf_dir):
    """Tuned forest on nested tenths of four folds: R² there and on the fifth, 10 sizes x 5 folds."""
    t = Train(spark, sf_dir)
    return S.learning_curve(spark, t.sample, t.tuned_forest)


@register("residual_std_model")
def q_residual_std_model(spark, sf_dir):
    t = Train(spark, sf_dir)
    p = FO.predict(t.rf, t.rows.select(M.LABEL, *t.feats))
    return p.agg(F.stddev_pop(F.col(M.LABEL) - F.col("prediction")).alias("residual_std"))


@register("path_attribution")
def q_path_attribution(spark, sf_dir):
    """Value and contribution of every (row, feature) in the full forest, with the row's additivity gap (bias + sum - prediction)."""
    t = Train(spark, sf_dir)
    key = t.spec.key
    a = FO.path_attribution(t.rf, t.rows.select(key, *t.feats))
    total = F.aggregate("contributions", F.col("bias"), lambda s, c: s + c)
    gap = a.withColumns({"additivity_gap": F.abs(total - F.col("prediction"))})
    names, values = F.array(*map(F.lit, t.feats)), F.array(*[F.col(f).cast("double") for f in t.feats])
    pairs = F.arrays_zip(names.alias("feature"), values.alias("value"), F.col("contributions").alias("contribution"))
    return gap.select(key, "bias", "prediction", "additivity_gap", F.explode(pairs).alias("p")).select(key, "bias", "prediction", "additivity_gap", "p.*")


@register("attribution_summary")
def q_attribution_summary(spark, sf_dir):
    t = Train(spark, sf_dir)
    return FO.attribution_summary(FO.path_attribution(t.rf, t.rows.select(t.spec.key, *t.feats)), t.feats)


@register("feature_contributions")
def q_feature_contributions(spark, sf_dir):
    """``feature_contributions`` / ``top_contributions``: per row the 10 most important
    forest features with value, dataset mean and direction."""
    from fairband.operators.explain import feature_contributions
    t = Train(spark, sf_dir)
    imps = t.rf.importances()
    row = t.rows.agg(*[F.avg(f).alias(f) for f in t.feats]).first()
    means = {f: row[f] for f in t.feats}
    out = feature_contributions(t.rows, imps, means, 10)
    return out.select(t.spec.key, F.posexplode("contributions").alias("rank0", "c")).select(
        t.spec.key, (F.col("rank0") + 1).alias("rank"), F.col("c.feature").alias("feature"),
        F.col("c.importance").alias("importance"), F.col("c.value").alias("value"),
        F.col("c.mean").alias("mean"), F.col("c.direction").alias("direction"))


def _artifacts(spark, sf_dir):
    """Fit, save and load again: ``(train, loaded pipeline, config, tables, pipeline as fitted)``."""
    t = Train(spark, sf_dir)
    s = t.spec
    base = FE.train_test_split(t.ctx.trained, s.key)
    medians = FE.fit_medians(base.filter(F.col("split") == "train"), list(s.base_features))
    train = t.rows.filter(F.col("split") == "train")
    fitted = AR.scoring_pipeline(s, medians, FE.fit_scaler(train, t.feats), t.rf)
    residual = FO.predict(t.rf, t.rows.select(M.LABEL, *t.feats)).agg(F.stddev_pop(F.col(M.LABEL) - F.col("prediction"))).first()[0]
    config = {"model": "forest", "trees": t.rf.count, "features": t.feats, "position_categories": sorted(s.position_categories),
              "residual_std": residual, "n_rows": t.rows.count(), "n_train": train.count()}
    tables = {"importances": spark.createDataFrame(t.rf.importances(), "rank int, feature string, importance double"),
              "statistics": AR.dataset_statistics(t.rows, s),
              "metrics": M.regression_report(FO.predict(t.rf, t.rows.select("split", M.LABEL, *t.feats)), s, "random_forest")}
    folder = scratch_path(spark, "artifacts/" + uuid.uuid4().hex[:12])
    AR.save(fitted, folder, config, tables)
    return (t, *AR.load(spark, folder), fitted)


@register("artifact_pipeline", with_panel("SELECT player_pk, true AS same_range, true AS same_scaled FROM trained"))
def q_artifact_pipeline(spark, sf_dir):
    """Every trained row scored from its raw panel columns by the saved and reloaded pipeline, against the pipeline as fitted."""
    t, loaded, _, _, fitted = _artifacts(spark, sf_dir)
    s = t.spec
    score = lambda p, tag: p.transform(t.ctx.trained).select(s.key, *[F.col(c).alias(c + tag) for c in (s.low, s.high, s.center, "scaled")])
    both = score(fitted, "").join(score(loaded, "_again"), s.key)
    same = lambda *cs: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(c + "_again")) for c in cs])
    return both.select(s.key, same(s.low, s.high, s.center).alias("same_range"), same("scaled").alias("same_scaled"))


@register("artifact_statistics", with_panel(f"""
, g AS (SELECT 'all' AS scope, 'all' AS name, gross_annual_eur AS v FROM trained UNION ALL SELECT 'league', league_name, gross_annual_eur FROM trained
        UNION ALL SELECT 'position', position, gross_annual_eur FROM trained)
SELECT scope, name, count(*) AS n, {SQL_SNAP('avg(v)', 4)} AS mean, {SQL_SNAP('min(v)', 4)} AS min, {SQL_SNAP('max(v)', 4)} AS max,
  {SQL_SNAP('stddev_samp(v)', 4)} AS std, {SQL_SNAP('quantile_cont(v, 0.5)', 4)} AS median FROM g GROUP BY 1, 2"""))
def q_artifact_statistics(spark, sf_dir):
    """The statistics table of a saved version: pay of all rows, by league and by position."""
    *_, tables, _ = _artifacts(spark, sf_dir)
    return tables["statistics"].select("scope", "name", "n", *[snap(c, 4).alias(c) for c in ("mean", "min", "max", "std", "median")])


@register("artifact_tables")
def q_artifact_tables(spark, sf_dir):
    """Config, importances and metrics of a saved version, one row per entry."""
    _, _, config, tables, _ = _artifacts(spark, sf_dir)
    rows = spark.createDataFrame([("config", k, str(v)) for k, v in sorted(config.items())], "artifact string, name string, value string")
    shares = tables["importances"].select(F.lit("importances").alias("artifact"), F.col("feature").alias("name"), F.col("importance").cast("string").alias("value"))
    scores = tables["metrics"].select(F.lit("metrics").alias("artifact"), F.concat_ws(".", "split", F.lit("r2")).alias("name"), F.col("r2").cast("string").alias("value"))
    return rows.unionByName(shares).unionByName(scores)
