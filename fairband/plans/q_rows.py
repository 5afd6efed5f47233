"""Row-level forms of queries whose registered form is an aggregate."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairband.functions.scalar import snap
from fairband.operators import filters as FL
from fairband.operators import panel as P
from fairband.operators import refresh as RF
from fairband.plans.context import Ctx
from fairband.plans.oracle_sql import snap as S, with_panel
from fairband.plans.q_io import CACHE_SQL, _cache
from fairband.plans.registry import register


@register("map_enrich_rows", with_panel("""
SELECT s.player_pk, s.short_name, i.nationality, i.api_football_id FROM scored s LEFT JOIN ident i ON s.player_pk = i.player_pk"""))
def q_map_enrich_rows(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    base = c.scored.drop("nationality", "api_football_id")
    return P.map_enrich(base, c.tables.identity, "player_pk", ["nationality", "api_football_id"]).select(
        "player_pk", "short_name", "nationality", "api_football_id")


@register("inner_benchmark_rows", with_panel(f"""
SELECT player_pk, {S('market_value_eur', 2)} AS market_value_eur,
       market_value_eur >= predicted_low_eur AND market_value_eur <= predicted_high_eur AS market_in_range
FROM scored WHERE market_value_eur IS NOT NULL AND market_value_eur > 0"""))
def q_inner_benchmark_rows(spark, sf_dir):
    """Trained rows that have an external value, and whether it lies inside the range."""
    c = Ctx(spark, sf_dir)
    mv = c.tables.market.filter(F.col("market_value_eur") > 0)
    v = F.col("market_value_eur")
    return c.scored.drop("market_value_eur").join(mv, "player_pk", "inner").select(
        "player_pk", snap("market_value_eur", 2).alias("market_value_eur"),
        ((v >= F.col("predicted_low_eur")) & (v <= F.col("predicted_high_eur"))).alias("market_in_range"))


@register("outlier_3sigma_rows", with_panel("""
, st AS (SELECT avg(gross_annual_eur) AS m, stddev_samp(gross_annual_eur) AS s FROM scored)
SELECT player_pk, gross_annual_eur > m + 3 * s OR gross_annual_eur < greatest(0.0, m - 3 * s) AS actual_outlier,
       predicted_center_eur > m + 3 * s OR predicted_center_eur < greatest(0.0, m - 3 * s) AS center_outlier FROM scored, st"""))
def q_outlier_rows(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    flagged = FL.outlier_3sigma(FL.outlier_3sigma(c.scored, c.spec, "gross_annual_eur"), c.spec, "predicted_center_eur")
    return flagged.select("player_pk", F.col("gross_annual_eur_outlier").alias("actual_outlier"),
                          F.col("predicted_center_eur_outlier").alias("center_outlier"))


@register("cache_upsert_rows", with_panel(f""", {CACHE_SQL},
upd AS (SELECT player_pk, predicted_low_eur, 'peer_range:v1' AS model_version, TIMESTAMP '2001-11-04' AS computed_at, 1 AS src
        FROM scored WHERE league_name = 'PROMO'),
u AS (SELECT player_pk, predicted_low_eur, model_version, computed_at, 0 AS src FROM cache UNION ALL BY NAME SELECT * FROM upd)
SELECT player_pk, {S('predicted_low_eur', 4)} AS predicted_low_eur, model_version, strftime(computed_at, '%Y-%m-%d') AS computed_on FROM (
  SELECT *, row_number() OVER (PARTITION BY player_pk ORDER BY computed_at DESC, src DESC) AS rn FROM u) WHERE rn = 1"""))
def q_cache_upsert_rows(spark, sf_dir):
    """Every row of the cache after new scores of one league were merged into it."""
    c = Ctx(spark, sf_dir)
    columns = ["player_pk", "predicted_low_eur", "predicted_high_eur", "predicted_center_eur"]
    new = c.scored.filter(F.col("league_name") == "PROMO").select(*columns, F.lit("peer_range:v1").alias("model_version"),
                                                                  F.lit("2001-11-04").cast("timestamp").alias("computed_at"))
    return RF.cache_upsert(_cache(c), new).select("player_pk", snap("predicted_low_eur", 4).alias("predicted_low_eur"), "model_version",
                                                  F.date_format("computed_at", "yyyy-MM-dd").alias("computed_on"))
