"""Rows that models are fitted on, of any number: written once by column, binned by what a fit learns from, dealt to tasks.

A fit that sees all rows in every round is one task of the JVM learner (``grower``).  It holds a row's
features as one byte each, about 100 bytes a row in all.  The driver holds none of the rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairband.operators import grower as G
from fairband.operators import trees as T
from fairband.operators.models import LABEL as LABEL_COLUMN
from fairband.session import scratch_path, send_package

NO_FOLD, NO_SPLIT = -1, -2  # folds of a fit that leaves out nothing; of rows that no fit learns from
KEY, FOLD, STATE, LABEL, FIRST = -4, -3, -2, -1, 0  # numbers of the columns; the features follow
LEARNT, HELD, IDLE = 0, 1, 2  # states of rows, as in Grower.java
WHOLE = 100
BLOCK = "column int, first long, folds binary, places binary, data binary"
CODED = "selection int, column int, data binary"


def complete(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def place(key: int) -> int:
    """Where a key stands in the order by which shares of the rows grow."""
    return int.from_bytes(hashlib.md5(str(key).encode(), usedforsecurity=False).digest()[:8], "big")


def states(folds: np.ndarray, places: np.ndarray, selection: tuple[int, int, int]) -> np.ndarray:
    """Per row whether a fit learns from it, is tested on it, or neither.

    ``selection`` is two folds left out and the share of the others, in percent, that is learned from;
    a larger share holds the smaller one.
    """
    out = np.full(len(folds), IDLE, np.uint8)
    held = np.isin(folds, selection[:2]) & (folds >= 0)
    out[held] = HELD
    learnt = np.flatnonzero(~held & (folds >= 0))
    if selection[2] < WHOLE:
        learnt = learnt[np.argsort(places[learnt], kind="stable")][:max(1, len(learnt) * selection[2] // WHOLE)]
    out[learnt] = LEARNT
    return out


class Rows:
    """Keys, folds, labels and raw features of ``rows``; those without a fold get predictions only."""

    def __init__(self, rows: DataFrame, key: str, features: list[str]):
        self.spark, self.features = rows.sparkSession, features
        self.rows = rows.select(F.col(key).cast("long").alias("key"), F.coalesce("fold", F.lit(NO_SPLIT)).cast("int").alias("fold"),
                                F.col(LABEL_COLUMN).cast("double").alias("label"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])

    @cached_property
    def _summary(self):
        each = [F.sum(F.xxhash64(F.lit(salt), *self.rows.columns).cast("decimal(38,0)")).cast("string").alias(f"h{salt}") for salt in (0, 1)]
        return self.rows.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("fold")).alias("folds"), *each).first()

    @property
    def fold_numbers(self) -> list[int]:
        return [f for f in self._summary["folds"] if f >= 0]

    def digest(self, *more) -> str:
        """Names the rows, whatever their order and partitions, and what is computed from them."""
        s = self._summary
        return hashlib.sha256(json.dumps([T.VERSION, s["n"], s["h0"], s["h1"], *more], sort_keys=True).encode()).hexdigest()[:32]

    @cached_property
    def _arrays(self) -> pd.DataFrame:
        return self.rows.toPandas().sort_values("key", kind="stable")

    # arrays of small tables, for checks; no query reads them
    keys = property(lambda self: self._arrays["key"].to_numpy())
    folds = property(lambda self: self._arrays["fold"].to_numpy(np.int64))
    labels = property(lambda self: self._arrays["label"].to_numpy(float))
    values = property(lambda self: self._arrays[[f"x{i}" for i in range(len(self.features))]].to_numpy(float))

    def _kept(self, name: str, schema: str, build) -> DataFrame:
        """A table written once for these rows."""
        path = scratch_path(self.spark, f"rows/{self.digest()}/{name}")
        if not complete(self.spark, path):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def columns(self) -> DataFrame:
        """Blocks of every column in key order."""
        width = len(self.features)

        def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                keys, folds = batch["key"].to_numpy("<i8"), batch["fold"].to_numpy("<i4").tobytes()
                places = np.array([place(k) for k in keys.tolist()], "<u8").tobytes()
                data = {KEY: keys, FOLD: keys[:0], LABEL: batch["label"].to_numpy("<f8")} | {i: batch[f"x{i}"].to_numpy("<f8") for i in range(width)}
                yield pd.DataFrame([(c, keys[0], folds, places, d.tobytes()) for c, d in data.items()], columns=["column", "first", "folds", "places", "data"])

        send_package(self.spark)
        return self._kept("columns", BLOCK, lambda: self.rows.repartitionByRange("key").sortWithinPartitions("key").mapInPandas(blocks, BLOCK))

    def coded(self, selections: list[tuple[int, int, int]], bins: int) -> DataFrame:
        """Per selection (its number) the states of the rows and the bins of every feature, by quantiles of the rows learned from; keys, folds and labels under -1."""
        width = len(self.features)

        def code(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("first")
            column, data = int(group["column"].iloc[0]), b"".join(group["data"])
            folds, places = (np.frombuffer(b"".join(group[c]), kind) for c, kind in (("folds", "<i4"), ("places", "<u8")))
            out = [(-1, column, folds.tobytes() if column == FOLD else data)] if column < FIRST else []
            for i, selection in enumerate(selections if column in (FOLD, *range(width)) else []):
                state = states(folds, places, selection)
                if column == FOLD:
                    out.append((i, STATE, state.tobytes()))
                    continue
                values = np.frombuffer(data, "<f8")
                (edges,) = T.quantile_edges(values[state == LEARNT][:, None], bins)
                out.append((i, column, T.binned(values[:, None], [edges]).codes.tobytes()))
            return pd.DataFrame(out, columns=["selection", "column", "data"])

        name = "codes-" + hashlib.sha256(json.dumps([selections, bins]).encode()).hexdigest()[:16]
        # a column is a group, and the groups are spread whatever their size
        return self._kept(name, CODED, lambda: self.columns().repartition(width + 3, "column").groupBy("column").applyInPandas(code, CODED))

    def edges(self, bins: int) -> list[list[float]]:
        """What cuts each feature into bins, for a fit that leaves out nothing: ``bins - 1`` numbers or fewer."""
        def cut(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("first")
            folds, values = np.frombuffer(b"".join(group["folds"]), "<i4"), np.frombuffer(b"".join(group["data"]), "<f8")
            return pd.DataFrame([(group["column"].iloc[0], T.quantile_edges(values[folds >= 0][:, None], bins)[0].tolist())], columns=["column", "edges"])

        each = self.columns().filter(F.col("column") >= FIRST).repartition(len(self.features), "column").groupBy("column").applyInPandas(cut, "column int, edges array<double>")
        found = dict(each.collect())
        return [list(found[i]) for i in range(len(self.features))]

    def fitted(self, tasks: list[tuple[tuple[int, int, int], str]], bins: int, also: tuple[int, ...] = ()) -> DataFrame:
        """Run ``(selection, task)`` of ``grower`` in a partition each: ``id, out`` and the columns ``also`` as binaries ``a``."""
        if not tasks:
            return self.spark.createDataFrame([], "id int, out binary, a array<binary>")
        G.register(self.spark)
        selections = list(dict.fromkeys(s for s, _ in tasks))
        named = F.broadcast(self.spark.createDataFrame([(i, selections.index(s), t) for i, (s, t) in enumerate(tasks)], "id int, chosen int, task string"))
        coded = self.coded(selections, bins)
        columns = coded.filter(F.col("column").isin(*also) | (F.col("column") >= STATE))
        dealt = columns.join(named, (F.col("selection") == F.col("chosen")) | (F.col("selection") < 0)).select("id", "task", "column", "data")
        each = dealt.repartitionByRange(len(tasks), "id").groupBy("id").agg(F.first("task").alias("task"), F.array_sort(F.collect_list(F.struct("column", "data"))).alias("c"))
        of = lambda keep: F.transform(F.filter("c", keep), lambda x: x["data"])
        each = each.select("id", "task", of(lambda x: x["column"] >= STATE).alias("c"), F.filter("c", lambda x: x["column"].isin(*also) if also else F.lit(False))["data"].alias("a"))
        return each.select("id", G.grown("c", "task").alias("out"), "a")
