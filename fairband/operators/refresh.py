"""Prediction cache: TTL reads, key differences and snapshot upserts (MERGE re-aim)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairband.functions.scalar import ttl_predicate
from fairband.session import materialize


def cache_read(cache: DataFrame, keys: DataFrame | None, version: str, as_of: str,
               ttl_days: int = 7, key: str = "player_pk") -> DataFrame:
    """Rows of ``version`` computed after ``as_of - ttl_days``, restricted to ``keys``."""
    fresh = cache.filter((F.col("model_version") == version) & ttl_predicate("computed_at", as_of, ttl_days))
    return fresh.join(keys.select(key).distinct(), key, "left_semi") if keys is not None else fresh


def anti_cached(keys: DataFrame, fresh: DataFrame, key: str = "player_pk") -> DataFrame:
    """Keys without a fresh cache entry (to be scored)."""
    return keys.select(key).distinct().join(fresh.select(key), key, "left_anti")


def cache_upsert(cache: DataFrame, updates: DataFrame, key: str = "player_pk") -> DataFrame:
    """Insert-or-replace by key: the newest ``computed_at`` wins (updates win ties).

    The result is meant to be written as a *new* snapshot folder; the folder
    being read is never overwritten in place.
    """
    u = updates.withColumn("_src", F.lit(1))
    c = cache.withColumn("_src", F.lit(0))
    w = Window.partitionBy(key).orderBy(F.col("computed_at").desc(), F.col("_src").desc())
    return (c.unionByName(u, allowMissingColumns=True)
            .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_src"))


def refresh_scores(table, entities: DataFrame, score, version: str, as_of: str, ttl_days: int = 7,
                   epoch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Score only what the cache does not hold: ``(all current rows, rows scored now)``.

    ``table`` is a ``BucketTable``; an entity counts as known while its row has this
    model version and is younger than ``ttl_days`` at ``as_of``.  ``score`` maps
    entities to their key and predicted columns.  A new version scores everything.
    """
    key, cache = table.key, table.read()
    known = None if cache is None else cache_read(cache, entities, version, as_of, ttl_days, key)
    todo = entities if known is None else entities.join(known.select(key), key, "left_anti")
    made = materialize(score(todo).withColumns({"model_version": F.lit(version), "computed_at": F.lit(as_of).cast("timestamp")}), "scored-now")
    table.upsert(made, epoch)
    return (made if known is None else known.unionByName(made)), made
