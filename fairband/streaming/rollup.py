"""Streaming re-aims: windowed request-log rollup and incremental cache refresh.

Both write through ``foreachBatch`` into folders under the shared checkpoint
directory (never the driver's memory), with a checkpoint location so a
restarted query resumes from its last committed offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairband.session import scratch_path
from fairband.sources.tables import SCHEMAS


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """File stream over one table of the folder (declared schema, no inference)."""
    return (spark.readStream.schema(SCHEMAS[table]).option("pathGlobFilter", f"{table}.parquet")
            .option("maxFilesPerTrigger", 1).parquet(sf_dir))


def windowed_counts(events: DataFrame, window: str = "1 day", slide: str | None = None,
                    watermark: str = "1 hour") -> DataFrame:
    """Tumbling (or sliding) event-time windows x event_type: count and value sum.

    TIMESTAMP_NTZ cannot carry a watermark, so ``ts`` is cast to TIMESTAMP
    (session time zone is pinned to UTC).
    """
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return ev.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"),
                                                      F.sum("value").alias("value_sum"))


def windowed_log(events: DataFrame, window: str = "1 day", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Event-time windows x endpoint of the request log: status classes, server-error rate, and latencies.

    ``latency`` is a mergeable quantile sketch (KLL) of the elapsed milliseconds, of
    bounded size however many requests a window has.  Requests later than the
    watermark are dropped, the others count in their window while it is open.
    """
    from fairband.sources.io import request_log
    log = request_log(events.withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("ts", watermark)
    s, w = F.col("status"), (F.window("ts", window, slide) if slide else F.window("ts", window))
    return with_rates(log.groupBy(w.alias("w"), "endpoint").agg(
        F.count("*").alias("n"), F.count_if((s >= 200) & (s < 300)).alias("n_success"), F.count_if((s >= 500) | (s == 0)).alias("n_server_error"),
        F.count_if((s >= 400) & (s < 500)).alias("n_client_error"), F.kll_sketch_agg_double(F.col("elapsed_s") * 1000).alias("latency")))


def with_rates(rows: DataFrame) -> DataFrame:
    """Add the error rate over non-client requests, and p50 and p95 from the sketch."""
    den = F.col("n") - F.col("n_client_error")
    return rows.withColumns({
        "error_rate_pct": F.when(den > 0, F.col("n_server_error") / den * 100).otherwise(F.lit(0.0)),
        "p50_ms": F.kll_sketch_get_quantile_double("latency", F.lit(0.5)), "p95_ms": F.kll_sketch_get_quantile_double("latency", F.lit(0.95))})


def merged_windows(closed: DataFrame, by: list) -> DataFrame:
    """Closed windows put together (say days to a month): counts add up and sketches merge, no request is read again."""
    sums = [F.sum(c).alias(c) for c in ("n", "n_success", "n_server_error", "n_client_error")]
    return with_rates(closed.groupBy(*by).agg(*sums, F.kll_merge_agg_double("latency").alias("latency")))


def run_to_table(stream_df: DataFrame, name: str, output_mode: str = "append") -> str:
    """Drain the stream (``availableNow``) into a parquet folder; returns the folder.

    ``append``: only windows closed by the watermark are emitted and their state is dropped, so an
    unbounded stream runs in bounded memory; each batch lands in its own epoch sub-folder, so a retried
    epoch overwrites only itself.  ``complete``: each batch rewrites the whole result and state keeps every
    window; for bounded replays.
    """
    spark = stream_df.sparkSession
    out = scratch_path(spark, f"streams/{name}/table")
    ckpt = scratch_path(spark, f"streams/{name}/checkpoint")

    def sink(batch: DataFrame, epoch: int) -> None:
        if output_mode == "append":
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        else:
            batch.write.mode("overwrite").parquet(out)

    q = (stream_df.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def stream_log_rollup(spark: SparkSession, sf_dir: str, name: str, window: str = "1 day",
                      output_mode: str = "append", slide: str | None = None, events: DataFrame | None = None) -> DataFrame:
    """The request log of a folder (or of the stream ``events``) by window and endpoint, as a table of closed windows."""
    events = event_stream(spark, sf_dir) if events is None else events
    path = run_to_table(windowed_log(events, window, slide), name, output_mode)
    df = spark.read.parquet(path)
    return df.drop("epoch") if "epoch" in df.columns else df


def stream_score_upsert(activity: DataFrame, features: DataFrame, score, table, version: str, key_col: str = "l_partkey",
                        time_col: str = "l_shipdate") -> DataFrame:
    """Activity stream -> touched entities -> scored again and upserted; returns the table's rows.

    ``score`` maps rows of ``features`` to the key and predicted columns.  Every
    micro-batch scores the entities that it touches and rewrites their buckets of
    ``table`` (a ``BucketTable``) only; a retried epoch ends in the same manifest.
    """
    key = table.key

    def sink(batch: DataFrame, epoch: int) -> None:
        touched = batch.groupBy(F.col(key_col).alias(key)).agg(F.max(time_col).cast("timestamp").alias("computed_at"))
        fresh = score(features.join(touched.select(key), key, "left_semi")).join(touched, key)
        table.upsert(fresh.withColumn("model_version", F.lit(version)), epoch)

    q = (activity.writeStream.foreachBatch(sink).option("checkpointLocation", f"{table.base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return table.read()


def latest_snapshot(spark: SparkSession, base: str, before_epoch: int | None = None) -> str | None:
    """Newest committed ``snapshot_<epoch>`` folder under ``base`` (listed through the
    Hadoop file system of the path, so it works on HDFS / object stores and survives
    a driver restart).  A folder counts once its ``_SUCCESS`` marker exists."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(base + "/snapshot_*")) or []
    best = None
    for st in found:
        name = st.getPath().getName()
        epoch = int(name.split("_")[1])
        if before_epoch is not None and epoch >= before_epoch:
            continue
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath().toString() + "/_SUCCESS")):
            continue
        if best is None or epoch > best[0]:
            best = (epoch, st.getPath().toString())
    return best[1] if best else None
