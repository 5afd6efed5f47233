import numpy as np
from pyspark.sql import functions as F

from fairband.operators.analytics import value_rank_table
from fairband.operators.quantiles import group_quantiles


def test_group_quantiles_match_numpy_small_and_large_groups(spark):
    rng = np.random.default_rng(7)
    rows = [(0, float(v)) for v in np.round(rng.normal(100, 30, 50000), 3)]   # bracket path (> 2*acc rows)
    rows += [(1, float(v)) for v in rng.integers(0, 5, 40)]                   # many ties
    rows += [(2, 3.5)]                                                         # single value
    rows += [(3, None)]                                                        # no values
    df = spark.createDataFrame(rows, "g int, v double")
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    got = {r["g"]: r for r in group_quantiles(df, ["g"], "v", probs).collect()}
    for g in (0, 1, 2):
        vals = np.array([v for k, v in rows if k == g and v is not None])
        for name, q in probs.items():
            assert abs(got[g][name] - np.percentile(vals, q * 100)) <= 1e-9 * max(1.0, abs(got[g][name]))
    assert 3 not in got  # no values -> no row; reports left-join onto their groups


def test_global_quantile_without_groups(spark):
    df = spark.range(0, 1001).select(F.col("id").cast("double").alias("v"))
    r = group_quantiles(df, [], "v", {"med": 0.5, "p10": 0.1}).first()
    assert r["med"] == 500.0 and abs(r["p10"] - 100.0) < 1e-9


def test_value_rank_table_prefix_sums(spark):
    vals = [5, 1, 3, 3, 9, 1, 1]
    df = spark.createDataFrame([(v,) for v in vals], "v int").repartition(3)
    got = {r["v"]: (r["n_equal"], r["n_at_or_below"]) for r in value_rank_table(df, "v").collect()}
    assert got == {1: (3, 3), 3: (2, 5), 5: (1, 6), 9: (1, 7)}


def test_every_small_size_and_coarse_brackets(spark):
    rng = np.random.default_rng(3)
    rows = [(n, float(v)) for n in range(1, 41) for v in np.round(rng.normal(0, 1, n), 1 if n % 2 else 6)]
    rows += [(100, float(v)) for v in np.round(rng.normal(0, 1, 3000), 2)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0}
    for accuracy in (10000, 50):
        got = {r["g"]: r for r in group_quantiles(df, ["g"], "v", probs, accuracy=accuracy).collect()}
        for g in got:
            vals = [v for k, v in rows if k == g]
            for name, q in probs.items():
                assert abs(got[g][name] - np.percentile(vals, q * 100)) < 1e-9, (g, name, accuracy)


def test_no_rows_give_null_and_no_job_runs_while_planning(spark):
    empty = spark.createDataFrame([], "g int, v double")
    rows = group_quantiles(empty, [], "v", {"med": 0.5}).collect()
    assert [r["med"] for r in rows] in ([], [None])
    assert group_quantiles(empty, ["g"], "v", {"med": 0.5}).count() == 0
    from fairband.operators.analytics import describe
    r = describe(empty, "v").first()
    assert (r["count"], r["q50"]) == (0, None)


def test_ranks_of_many_values_cached_and_from_files(spark, tmp_path):
    df = spark.range(0, 500_000).select((F.xxhash64("id") % 10_000_000).alias("v"))
    df.write.parquet(str(tmp_path / "v"))
    for source in (df.cache(), spark.read.parquet(str(tmp_path / "v"))):
        for merge in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
            ranks = value_rank_table(source, "v")
            from pyspark.sql import Window
            want = source.groupBy("v").agg(F.count("*").alias("c")).withColumn("below", F.sum("c").over(Window.orderBy("v")))
            wrong = ranks.join(want, "v", "full").filter("n_at_or_below IS DISTINCT FROM below OR n_equal IS DISTINCT FROM c")
            assert wrong.count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
