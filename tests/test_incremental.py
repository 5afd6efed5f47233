"""Streams and refreshes: closed windows, merged sketches, buckets that stay, scores that are not made twice."""

import datetime
import uuid

import numpy as np
from pyspark.sql import functions as F

from fairband.operators.refresh import refresh_scores
from fairband.session import scratch_path
from fairband.sources.buckets import BucketTable
from fairband.sources.io import request_log
from fairband.streaming import rollup as R


def fresh(spark, name):
    return scratch_path(spark, f"t_{name}_{uuid.uuid4().hex[:8]}")


def batch_rows(spark, events, slack="1 hour"):
    log = request_log(events.withColumn("ts", F.col("ts").cast("timestamp")))
    s = F.col("status")
    rows = log.groupBy(F.window("ts", "1 day").alias("w"), "endpoint").agg(
        F.count("*").alias("n"), F.count_if((s >= 500) | (s == 0)).alias("bad"), F.count_if((s >= 400) & (s < 500)).alias("client"),
        F.sort_array(F.collect_list(F.col("elapsed_s") * 1000)).alias("ms"))
    return {(r["w"]["start"], r["endpoint"]): r for r in rows.collect()}


def test_append_mode_gives_closed_windows_equal_to_the_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    want, last = batch_rows(spark, events), events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0] - datetime.timedelta(hours=1)
    got = {(r["w"]["start"], r["endpoint"]): r for r in R.stream_log_rollup(spark, sf_dir, "a_" + uuid.uuid4().hex[:6]).collect()}
    assert set(got) == {k for k in want if k[0] + datetime.timedelta(days=1) <= last} and got
    for k, r in got.items():
        w = want[k]
        assert (r["n"], r["n_server_error"], r["n_client_error"]) == (w["n"], w["bad"], w["client"])
        assert abs(r["error_rate_pct"] - (w["bad"] / (w["n"] - w["client"]) * 100 if w["n"] > w["client"] else 0.0)) < 1e-12
        share = np.searchsorted(w["ms"], r["p95_ms"], side="right") / w["n"]
        assert share >= 0.95 - 0.03 and r["p50_ms"] <= r["p95_ms"]


def test_complete_mode_keeps_all_windows(spark, sf_dir):
    want = batch_rows(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))
    got = R.stream_log_rollup(spark, sf_dir, "c_" + uuid.uuid4().hex[:6], output_mode="complete").collect()
    assert {(r["w"]["start"], r["endpoint"]): r["n"] for r in got} == {k: r["n"] for k, r in want.items()}


def test_sketches_merge_within_their_error(spark, sf_dir):
    closed = R.stream_log_rollup(spark, sf_dir, "m_" + uuid.uuid4().hex[:6])
    month = {r["endpoint"]: r for r in R.merged_windows(closed, ["endpoint"]).collect()}
    last = closed.agg(F.max("w.end")).first()[0]
    log = request_log(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).filter(F.col("ts") < F.lit(last))
    for r in log.groupBy("endpoint").agg(F.sort_array(F.collect_list(F.col("elapsed_s") * 1000)).alias("ms")).collect():
        m = month[r["endpoint"]]
        assert m["n"] == len(r["ms"])
        for q, value in ((0.5, m["p50_ms"]), (0.95, m["p95_ms"])):
            assert abs(np.searchsorted(r["ms"], value, side="right") / len(r["ms"]) - q) < 0.05


def test_late_rows_are_dropped_and_state_goes(spark):
    folder = fresh(spark, "late")
    day = datetime.datetime(2024, 1, 1)
    rows = lambda *hours: [(i, day + datetime.timedelta(hours=h), 1, "view", 1.0, '{"k": 5}') for i, h in enumerate(hours)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for i, hours in enumerate([(1, 2, 30), (3, 31), (60, 4), (200,)]):  # hour 30 closes the first day; late rows are dropped from the batch after the next on
        spark.createDataFrame(rows(*hours), schema).coalesce(1).write.parquet(f"{folder}/f{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    got = R.stream_log_rollup(spark, "", "l_" + uuid.uuid4().hex[:6], events=stream)
    counts = {r["w"]["start"].day: r["n"] for r in got.collect()}
    assert counts == {1: 3, 2: 2, 3: 1}  # hour 3 came in the next batch, hour 4 too late


def cache_rows(spark, keys, value, on="2001-01-01"):
    return spark.createDataFrame([(k, float(value), "v1") for k in keys], "player_pk long, predicted_low_eur double, model_version string") \
        .withColumn("computed_at", F.lit(on).cast("timestamp"))


def files(table, buckets):
    rows = table.read(buckets).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t")).distinct().collect()
    return {(r["f"], r["t"]) for r in rows}


def test_only_touched_buckets_are_written_again(spark):
    table = BucketTable(spark, fresh(spark, "buckets"), buckets=8)
    assert table.read() is None and table.upsert(cache_rows(spark, [], 0)) == []
    table.upsert(cache_rows(spark, range(200), 1))
    before, first = table.manifest(), files(table, list(range(8)))
    touched = table.upsert(cache_rows(spark, [3, 1000], 2, "2001-01-02"))
    after = table.manifest()
    assert touched and len(touched) < 8 and {b for b in after if after[b] != before[b]} == set(touched)
    untouched = [b for b in range(8) if b not in touched]
    assert files(table, untouched) <= first
    rows = {r["player_pk"]: r["predicted_low_eur"] for r in table.read().collect()}
    assert rows == {k: 2.0 if k in (3, 1000) else 1.0 for k in [*range(200), 1000]}
    older = table.upsert(cache_rows(spark, [3], 9, "2000-01-01"))  # an older row does not replace a newer one
    assert older and table.read().filter("player_pk = 3").first()["predicted_low_eur"] == 2.0


def test_a_retried_epoch_ends_in_the_same_manifest(spark):
    table = BucketTable(spark, fresh(spark, "retry"), buckets=4)
    table.upsert(cache_rows(spark, range(20), 1), 0)
    table.upsert(cache_rows(spark, [5], 2, "2001-01-02"), 1)
    manifest, rows = table.manifest(), sorted(table.read().collect())
    table.upsert(cache_rows(spark, [5], 2, "2001-01-02"), 1)
    assert table.manifest() == manifest and sorted(table.read().collect()) == rows


def test_refresh_scores_nothing_twice(spark):
    table = BucketTable(spark, fresh(spark, "refresh"), buckets=4)
    entities = spark.createDataFrame([(k, float(k)) for k in range(30)], "player_pk long, x double")
    score = lambda rows: rows.select("player_pk", (F.col("x") * 2).alias("predicted_low_eur"))
    run = lambda rows, version, day: [df.count() for df in refresh_scores(table, rows, score, version, day)]
    assert run(entities.filter("player_pk < 10"), "v1", "2001-01-01") == [10, 10]
    assert run(entities.filter("player_pk < 10"), "v1", "2001-01-02") == [10, 0]
    assert run(entities, "v1", "2001-01-03") == [30, 20]
    assert run(entities, "v2", "2001-01-03") == [30, 30]  # a new version scores all
    assert run(entities, "v2", "2001-01-20") == [30, 30]  # older than the time to live
    assert table.read().count() == 30


def test_stream_rewrites_the_buckets_of_its_entities(spark):
    folder = fresh(spark, "activity")
    at = lambda d: datetime.datetime(2001, 1, d)
    schema = "l_partkey long, l_shipdate timestamp_ntz"
    spark.createDataFrame([(k, at(1)) for k in range(40)], schema).coalesce(1).write.parquet(f"{folder}/a")
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    features = spark.createDataFrame([(k, float(k)) for k in range(60)], "player_pk long, x double")
    table = BucketTable(spark, fresh(spark, "stream"), buckets=8)
    score = lambda rows: rows.select("player_pk", F.col("x").alias("predicted_low_eur"))
    assert R.stream_score_upsert(stream(), features, score, table, "v1").count() == 40
    before = table.manifest()
    spark.createDataFrame([(7, at(5)), (7, at(3)), (50, at(4)), (999, at(4))], schema).coalesce(1).write.parquet(f"{folder}/b")
    got = {r["player_pk"]: r["computed_at"] for r in R.stream_score_upsert(stream(), features, score, table, "v1").collect()}
    assert set(got) == {*range(40), 50} and got[7] == at(5) and got[50] == at(4) and got[8] == at(1)
    after = table.manifest()
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 2
