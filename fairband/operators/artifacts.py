"""The fitted scoring pipeline as pipeline stages that can be saved, versioned and loaded again.

Every stage carries the panel's column roles and what it has learned as
parameters; the forest is saved as a table with one row per level of its trees.
``save`` writes a version folder (pipeline, config, metrics, importances, statistics)
and then a manifest; ``load`` opens the newest version that was completely written.
"""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsReadable, DefaultParamsWritable, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairband.operators import features as FE
from fairband.operators import forests as FO
from fairband.operators.trees import Level, Trees
from fairband.spec import PanelSpec


class PanelStage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage that knows the column roles, and numbers learned for some columns."""

    roles = Param(Params._dummy(), "roles", "column roles, as JSON", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "columns the numbers belong to", TypeConverters.toListString)
    numbers = Param(Params._dummy(), "numbers", "learned numbers", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, roles: str = "", columns: list | None = None, numbers: list | None = None):
        super().__init__()
        self._setDefault(roles="", columns=[], numbers=[])
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**given)

    def spec(self) -> PanelSpec:
        values = json.loads(self.getOrDefault(self.roles))
        return PanelSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def roles_of(spec: PanelSpec) -> str:
    return json.dumps(asdict(spec), sort_keys=True)


class EncodeFoot(PanelStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        return FE.encode_foot(df, self.spec())


class PositionDummies(PanelStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        spec = self.spec()
        return FE.onehot_drop_first(df, spec.position, spec.position_categories)


class MedianFill(PanelStage):
    """Nulls become the medians of the train rows."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return FE.median_impute(df, dict(zip(self.getOrDefault(self.columns), self.getOrDefault(self.numbers))))


class DeriveFeatures(PanelStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        return FE.engineer_features(df, self.spec())


class Scale(PanelStage):
    """Adds ``scaled``: the features less their mean, over their deviation (``numbers``: mean, deviation of each column in turn)."""

    def _transform(self, df: DataFrame) -> DataFrame:
        columns, n = self.getOrDefault(self.columns), self.getOrDefault(self.numbers)
        return df.withColumn("scaled", F.array(*[(F.col(c) - F.lit(n[2 * i])) / F.lit(n[2 * i + 1]) for i, c in enumerate(columns)]))


LEVELS = ("batch int, trees int, level int, feature array<short>, code array<short>, child array<int>, value array<double>, "
          "tree array<int>, gain array<float>")


class ForestRange(PanelStage):
    """Adds the forest's range and centre; ``columns`` are its features."""

    forest: FO.Forest | None = None

    def _transform(self, df: DataFrame) -> DataFrame:
        return FO.predict_range(self.forest, df, self.spec())

    def write(self) -> MLWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return ForestReader(cls)


class ForestWriter(MLWriter):
    def __init__(self, stage: ForestRange):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark, forest = self.sparkSession, self.stage.forest
        DefaultParamsWriter.saveMetadata(self.stage, path, spark)
        rows = [(b, count, i, *[getattr(level, name).tolist() for name in ("feature", "code", "child", "value", "tree", "gain")])
                for b, (count, grown) in enumerate(forest.batches) for i, level in enumerate(grown.levels)]
        spark.createDataFrame(rows, LEVELS).write.mode("overwrite").parquet(f"{path}/levels")
        spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(forest.edges)], "feature int, edges array<double>").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/edges")


class ForestReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ForestRange:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        batches: dict[int, tuple[int, Trees]] = {}
        for r in spark.read.schema(LEVELS).parquet(f"{path}/levels").orderBy("batch", "level").toLocalIterator():
            kinds = {"feature": np.int16, "code": np.int16, "child": np.int32, "value": float, "tree": np.int64, "gain": np.float32}
            level = Level(*[np.array(r[name], kind) for name, kind in kinds.items()])
            batches.setdefault(r["batch"], (r["trees"], Trees()))[1].levels.append(level)
        edges = [np.array(r["edges"], float) for r in spark.read.parquet(f"{path}/edges").orderBy("feature").collect()]
        stage.forest = FO.Forest(stage.getOrDefault(stage.columns), edges, [batches[b] for b in sorted(batches)])
        return stage


def scoring_pipeline(spec: PanelSpec, medians: dict, scaler: dict, forest: FO.Forest) -> PipelineModel:
    """Panel rows -> features, scaled features and salary range."""
    roles, features = roles_of(spec), list(forest.features)
    known = {c: m for c, m in medians.items() if m is not None}
    last = ForestRange(roles=roles, columns=features)
    last.forest = forest
    return PipelineModel([
        EncodeFoot(roles=roles), PositionDummies(roles=roles), MedianFill(roles=roles, columns=list(known), numbers=[float(m) for m in known.values()]),
        DeriveFeatures(roles=roles), Scale(roles=roles, columns=features, numbers=[float(x) for f in features for x in scaler[f]]), last])


def dataset_statistics(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Pay by ``scope`` (all rows, league, position): ``n, mean, median, min, max, std``."""
    from fairband.operators.quantiles import group_quantiles
    long = rows.select(F.col(spec.target).alias("v"), F.explode(F.array(
        F.struct(F.lit("all").alias("scope"), F.lit("all").alias("name")), F.struct(F.lit("league").alias("scope"), F.col(spec.league).alias("name")),
        F.struct(F.lit("position").alias("scope"), F.col(spec.position).alias("name")))).alias("g")).select("g.*", "v").filter("name is not null")
    facts = long.groupBy("scope", "name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
                                              F.stddev_samp("v").alias("std"))
    return facts.join(group_quantiles(long, ["scope", "name"], "v", {"median": 0.5}), ["scope", "name"])


def save(pipeline: PipelineModel, base: str, config: dict, tables: dict[str, DataFrame]) -> str:
    """Write the next version below ``base``: the pipeline, ``config`` and the tables, then the manifest that makes it current."""
    from fairband.streaming.rollup import latest_snapshot
    spark = SparkSession.getActiveSession()
    newest = latest_snapshot(spark, f"{base}/manifests")
    version = int(newest.rsplit("_", 1)[1]) + 1 if newest else 0
    folder = f"{base}/versions/v{version:06d}"
    pipeline.write().overwrite().save(f"{folder}/pipeline")
    spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(config.items())], "name string, value string").coalesce(1) \
        .write.mode("overwrite").json(f"{folder}/config")
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")
    entries = [("pipeline", f"{folder}/pipeline", ""), ("config", f"{folder}/config", "name string, value string"),
               *[(name, f"{folder}/{name}", table.schema.json()) for name, table in tables.items()]]
    spark.createDataFrame(entries, "name string, path string, schema string").coalesce(1).write.mode("overwrite").json(f"{base}/manifests/snapshot_{version:06d}")
    return folder


def load(spark: SparkSession, base: str, version: int | None = None) -> tuple[PipelineModel, dict, dict[str, DataFrame]]:
    """Pipeline, config and tables of the newest version (or of ``version``)."""
    from pyspark.sql.types import StructType
    from fairband.streaming.rollup import latest_snapshot
    newest = latest_snapshot(spark, f"{base}/manifests", None if version is None else version + 1)
    if newest is None:
        raise FileNotFoundError(f"no saved version below {base}")
    entries = {r["name"]: r for r in spark.read.schema("name string, path string, schema string").json(newest).collect()}
    config = {r["name"]: json.loads(r["value"]) for r in spark.read.schema("name string, value string").json(entries["config"]["path"]).collect()}
    tables = {n: spark.read.schema(StructType.fromJson(json.loads(e["schema"]))).json(e["path"]) for n, e in entries.items() if n not in ("pipeline", "config")}
    return PipelineModel.load(entries["pipeline"]["path"]), config, tables
