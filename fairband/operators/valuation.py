"""Fair-value ranges from peer groups, scoring and status labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairband.operators.panel import score_columns
from fairband.operators.quantiles import group_quantiles
from fairband.spec import PanelSpec


def peer_range(train: DataFrame, rows: DataFrame, spec: PanelSpec, peers=None,
               low_q: float = 0.25, high_q: float = 0.75, approx: bool = False) -> DataFrame:
    """``peer_range``: P25 / P75 of the target and expm1(mean log1p(target)) inside
    each peer group of ``train``, attached to every row of ``rows``.

    Quantiles are taken on the money scale (order statistics commute with the
    log transform; only the interpolation between two of them differs), so a
    bound that lands on an observed value equals it exactly.

    The per-group table has one row per peer group; AQE broadcasts it when its
    measured size allows and otherwise plans a shuffled join.
    """
    peers = list(peers or (spec.league, spec.position))
    q = group_quantiles(train, peers, spec.target, {"_p_low": low_q, "_p_high": high_q}, approx=approx,
                        extra={"_p_mean": F.avg(F.log1p(F.col("_v")))})
    stats = q.select(
        *peers,
        F.col("_p_low").alias(spec.low),
        F.col("_p_high").alias(spec.high),
        F.expm1("_p_mean").alias(spec.center))
    return rows.drop(spec.low, spec.high, spec.center).join(stats, peers, "left")


def score_with_peer_range(train: DataFrame, rows: DataFrame, spec: PanelSpec, **kw) -> DataFrame:
    return score_columns(peer_range(train, rows, spec, **kw), spec)
