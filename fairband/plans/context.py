"""Shared lazy building blocks for the registered queries."""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairband.operators import panel as P
from fairband.operators.valuation import score_with_peer_range
from fairband.sources.domain import DomainTables
from fairband.spec import PanelSpec, default_spec


_SHARED: dict[tuple, dict[str, DataFrame]] = {}


def shared(spark: SparkSession, sf_dir: str, spec: PanelSpec, name: str, build) -> DataFrame:
    """A persisted table that all queries on one folder share; opening another folder releases those of the one before."""
    key = (spark.sparkContext.applicationId, sf_dir, spec)
    if key not in _SHARED:
        release()
        _SHARED[key] = {}
    if name not in _SHARED[key]:
        _SHARED[key][name] = build().persist()
    return _SHARED[key][name]


def release() -> None:
    """Unpersist all shared tables (of a session that is still there)."""
    for (app, *_), tables in _SHARED.items():
        current = SparkSession.getActiveSession()
        if current is not None and current.sparkContext.applicationId == app:
            for table in tables.values():
                table.unpersist()
    _SHARED.clear()


class Ctx:
    """Lazily built panel views for one (session, data folder)."""

    def __init__(self, spark: SparkSession, sf_dir: str, spec: PanelSpec | None = None,
                 persist_panel: bool | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.spec = spec or default_spec()
        if persist_panel is None:
            persist_panel = os.environ.get("FAIRBAND_PERSIST_PANEL", "1") != "0"
        self.persist_panel = persist_panel

    @cached_property
    def tables(self) -> DomainTables:
        return DomainTables(self.spark, self.sf_dir)

    @cached_property
    def panel(self) -> DataFrame:
        """One row per entity.  A batch job that derives several outputs from it sets
        ``persist_panel`` so the lineitem aggregation runs once (cached blocks are
        recomputed from lineage if an executor is lost)."""
        build = lambda: P.base_projection(P.build_panel(self.tables, self.spec))
        return shared(self.spark, self.sf_dir, self.spec, "panel", build) if self.persist_panel else build()

    @cached_property
    def trained(self) -> DataFrame:
        return P.eligibility_filter(self.panel, self.spec)

    @cached_property
    def scored(self) -> DataFrame:
        """Trained rows with the peer-group range, errors and status."""
        return score_with_peer_range(self.trained, self.trained, self.spec) \
            .withColumn("prediction_available", F.lit(True))

    @cached_property
    def untrained(self) -> DataFrame:
        return P.untrained_star(self.panel, self.trained, self.spec)

    @cached_property
    def combined(self) -> DataFrame:
        return P.combined_view(self.scored, self.untrained)

    @cached_property
    def combined_status(self) -> DataFrame:
        from fairband.functions.scalar import status
        return self.combined.withColumn("status", status(
            F.col(self.spec.target), self.spec.low, self.spec.high, "prediction_available"))

    def table(self, name: str, columns=None) -> DataFrame:
        from fairband.sources.tables import read_table
        return read_table(self.spark, self.sf_dir, name, columns)
