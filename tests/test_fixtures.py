"""Hand-made frames for the edge rows listed in FIXTURES.md §C."""

import datetime as dt
import json

from pyspark.sql import functions as F

from fairband.operators import analytics as A
from fairband.operators import filters as FL
from fairband.operators import refresh as RF
from fairband.operators.features import fit_scaler, standard_scale
from fairband.sources import io as IO
from fairband.spec import default_spec

SPEC = default_spec()


def test_cache_ttl_boundary_versions_and_duplicates(spark):
    as_of = dt.datetime(2024, 1, 8)
    rows = [(1, "v1", dt.datetime(2024, 1, 7)),       # fresh
            (2, "v1", dt.datetime(2024, 1, 1)),       # exactly 7 days old -> stale (strict >)
            (3, "v0", dt.datetime(2024, 1, 7)),       # other version
            (4, "v1", dt.datetime(2024, 1, 2)),       # duplicate key: older
            (4, "v1", dt.datetime(2024, 1, 6))]       # duplicate key: newer
    cache = spark.createDataFrame(rows, "player_pk long, model_version string, computed_at timestamp")
    fresh = RF.cache_read(cache, None, "v1", str(as_of), 7)
    assert sorted(r.player_pk for r in fresh.collect()) == [1, 4, 4]
    keys = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "player_pk long")
    assert sorted(r.player_pk for r in RF.anti_cached(keys, fresh).collect()) == [2, 3, 5]
    upd = spark.createDataFrame([(4, "v1", dt.datetime(2024, 1, 6)), (5, "v1", dt.datetime(2024, 1, 8))],
                                "player_pk long, model_version string, computed_at timestamp") \
        .withColumn("tag", F.lit("new"))
    out = {r.player_pk: r for r in RF.cache_upsert(cache, upd).collect()}
    assert len(out) == 5 and out[4].tag == "new" and out[5].tag == "new" and out[1].tag is None


def test_payload_rollup_rules(spark):
    docs = [
        {"player": {"id": 1, "name": "a"}, "statistics": [
            {"games": {"appearances": 0, "minutes": 400, "rating": "", "position": "Defender"},
             "goals": {"total": 1, "assists": None}, "league": {"name": "L1"}}]},
        {"player": {"id": 2, "name": "b"}, "statistics": []},
        {"player": {"id": 3, "name": "c"}, "statistics": [
            {"games": {"appearances": 5, "minutes": 450, "rating": "7.10", "position": "Attacker"},
             "goals": {"total": 2, "assists": 1}, "league": {"name": "L1"}},
            {"games": {"appearances": 5, "minutes": 300, "rating": "6.90", "position": "Goalkeeper"},
             "goals": {"total": 0, "assists": 0}, "league": {"name": "L2"}}]},
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "payload string")
    blocks = IO.json_payload_parse(df)
    assert blocks.count() == 4  # the document without blocks survives as one row
    got = {r.player_id: r for r in IO.statblock_rollup(blocks).collect()}
    assert got[1].appearances == 5 and got[1].rating == 0.0 and got[1].position == "Midfielder"  # no block with appearances
    assert got[2].appearances == 0 and got[2].position == "Midfielder"
    assert got[3].appearances == 10 and got[3].rating == 7.0 and got[3].position == "Attacker"  # tie -> first block


def test_group_stats_single_salary_and_peak_age_tie(spark):
    rows = [(1, "A", 20.0, 100.0), (2, "A", 20.0, 300.0), (3, "B", 25.0, 200.0), (4, "C", 30.0, None),
            (5, "A", 30.0, 200.0)]
    df = spark.createDataFrame(rows, "player_pk long, league_name string, age double, gross_annual_eur double") \
        .withColumn("overall", F.lit(80.0)).withColumn("short_name", F.concat(F.lit("p"), F.col("player_pk"))) \
        .withColumn("range_accuracy_result", F.lit(True))
    ls = {r.league_name: r for r in A.league_stats(df, SPEC).collect()}
    assert ls["B"].std_salary is None and ls["B"].median_salary == 200.0
    assert ls["C"].has_salary_data is False and ls["C"].median_salary is None
    assert ls["A"].top_paid_name == "p2" and abs(ls["A"].range_accuracy_pct - 100.0) < 1e-12
    # ages 20 and 30 both average 200 -> the lower age wins
    assert A.peak_age(df.filter(F.col("player_pk") != 3), SPEC).first().age == 20.0


def test_constant_column_scaling_and_correlation(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(10)], "x double, c double")
    sc = fit_scaler(df, ["x", "c"])
    assert sc["c"][1] == 1.0  # zero std -> 1
    out = standard_scale(df, sc, ["c"]).agg(F.max(F.abs("c"))).first()[0]
    assert out == 0.0
    pi = A.performance_index(df, ["x", "c"]).agg(F.max("performance_index")).first()[0]
    assert abs(pi - 0.5) < 1e-12  # constant column contributes 0
    corr = A.corr_matrix(df, ["x", "c"]).first()["corr"]
    assert corr is None or corr != corr  # undefined for a constant column (NULL / NaN)


def test_lookup_wildcards_and_regex_characters(spark):
    rows = [(1, "a%b", 10), (2, "axxb", 11), (3, "a.b", 12), (4, "a_b", None)]
    df = spark.createDataFrame(rows, "player_pk long, short_name string, api_football_id long") \
        .withColumn("long_name", F.col("short_name")).withColumn("club_name", F.lit(None).cast("string"))
    # ILIKE keeps user wildcards: '%' inside the text matches anything
    assert sorted(r.player_pk for r in FL.lookup_ilike(df, "a%b", SPEC).collect()) == [1, 2, 3]
    # substring search is literal
    assert [r.player_pk for r in FL.search_name(df, "a.b", SPEC).collect()] == [3]
    assert [r.player_pk for r in FL.search_name(df, "a%b", SPEC).collect()] == [1]
