"""Registered Structured Streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fairband.functions.scalar import snap
from fairband.operators import forests as FO
from fairband.plans.oracle_sql import snap as S, with_panel
from fairband.plans.q_models import Train
from fairband.plans.registry import register
from fairband.session import scratch_path
from fairband.sources.buckets import BucketTable
from fairband.streaming.rollup import event_stream, merged_windows, stream_log_rollup, stream_score_upsert


CLOSED = """log AS (
  SELECT time_bucket(INTERVAL 1 day, ts) AS window_start, event_type AS endpoint,
         CASE WHEN event_type = 'error' THEN (CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) >= 50 THEN 500 ELSE 404 END)
              WHEN CAST(json_extract(props, '$.k') AS INTEGER) = 0 THEN 0 ELSE 200 END AS status FROM events),
closed AS (
  SELECT window_start, endpoint, count(*) AS n, count(*) FILTER (WHERE status >= 200 AND status < 300) AS n_success,
         count(*) FILTER (WHERE status >= 500 OR status = 0) AS n_server_error, count(*) FILTER (WHERE status >= 400 AND status < 500) AS n_client_error
  FROM log GROUP BY 1, 2
  HAVING window_start + INTERVAL 1 day <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 hour FROM events))"""
RATE = "CASE WHEN n > n_client_error THEN n_server_error / (n - n_client_error) * 100 ELSE 0.0 END"


def _closed(spark, sf_dir):
    return stream_log_rollup(spark, sf_dir, "log_rollup_" + uuid.uuid4().hex[:8])


@register("stream_log_rollup", f"""WITH {CLOSED}
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, endpoint, n, n_success, n_server_error, n_client_error, {S(RATE, 6)} AS error_rate_pct FROM closed""")
def q_stream_rollup(spark, sf_dir):
    """Closed days x endpoint of the request log: status classes and error rate, in append mode."""
    return _closed(spark, sf_dir).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "endpoint", "n", "n_success",
                                         "n_server_error", "n_client_error", snap("error_rate_pct", 6).alias("error_rate_pct"))


@register("stream_latency_rollup")
def q_stream_latency(spark, sf_dir):
    """p50 and p95 of the closed windows from their sketches, and (window NULL) of all closed windows from the merged ones."""
    closed = _closed(spark, sf_dir)
    start = F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    whole = merged_windows(closed, ["endpoint"]).select(F.lit(None).cast("string").alias("window_start"), "endpoint", "n", "p50_ms", "p95_ms")
    return closed.select(start, "endpoint", "n", "p50_ms", "p95_ms").unionByName(whole)


@register("stream_score_upsert", with_panel("""
SELECT t.player_pk, CAST(max(l_shipdate) AS VARCHAR) AS computed_at, 'forest:23' AS model_version, true AS has_range
FROM trained t JOIN lineitem ON l_partkey = t.player_pk GROUP BY 1"""))
def q_stream_upsert(spark, sf_dir):
    """Entities touched by the activity stream, scored by the forest and upserted into a bucketed table."""
    t = Train(spark, sf_dir)
    s, key = t.spec, t.spec.key
    table = BucketTable(spark, scratch_path(spark, "streams/score_upsert_" + uuid.uuid4().hex[:8]), key, buckets=16)
    score = lambda rows: FO.predict_range(t.rf, rows, s).select(key, s.low, s.high, s.center)
    out = stream_score_upsert(event_stream(spark, sf_dir, "lineitem"), t.rows.select(key, *t.feats), score, table, f"forest:{len(t.feats)}")
    return out.select(key, F.date_format("computed_at", "yyyy-MM-dd HH:mm:ss").alias("computed_at"), "model_version",
                      (F.col(s.low) <= F.col(s.high)).alias("has_range"))
