"""Core slice: panel -> eligibility -> peer range -> status -> top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairband.functions.scalar import snap
from fairband.operators.ranking import top_overpaid, top_underpaid
from fairband.operators.panel import build_panel
from fairband.plans.context import Ctx
from fairband.plans.oracle_sql import snap as S, with_panel
from fairband.plans.registry import register

MONEY = 4


def _money(c):
    return snap(c, MONEY).alias(c)


@register("top_overpaid", with_panel(f"""
SELECT player_pk, short_name, league_name, position,
       {S('gross_annual_eur', MONEY)} AS gross_annual_eur,
       {S('predicted_low_eur', MONEY)} AS predicted_low_eur,
       {S('predicted_high_eur', MONEY)} AS predicted_high_eur,
       {S('predicted_center_eur', MONEY)} AS predicted_center_eur,
       {S('gross_annual_eur - predicted_high_eur', MONEY)} AS overpaid_by, status
FROM scored WHERE gross_annual_eur - predicted_high_eur > 0
ORDER BY gross_annual_eur - predicted_high_eur DESC, player_pk LIMIT 20"""))
def q_top_overpaid(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    top = top_overpaid(ctx.scored, ctx.spec, 20)
    return top.select("player_pk", "short_name", "league_name", "position",
                      _money("gross_annual_eur"), _money("predicted_low_eur"),
                      _money("predicted_high_eur"), _money("predicted_center_eur"),
                      _money("overpaid_by"), "status")


@register("top_underpaid", with_panel(f"""
SELECT player_pk, short_name, league_name, position,
       {S('gross_annual_eur', MONEY)} AS gross_annual_eur,
       {S('predicted_low_eur - gross_annual_eur', MONEY)} AS underpaid_by, status
FROM scored WHERE predicted_low_eur - gross_annual_eur > 0
ORDER BY predicted_low_eur - gross_annual_eur DESC, player_pk LIMIT 20"""))
def q_top_underpaid(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    top = top_underpaid(ctx.scored, ctx.spec, 20)
    return top.select("player_pk", "short_name", "league_name", "position",
                      _money("gross_annual_eur"), _money("underpaid_by"), "status")


@register("peer_range", with_panel(f"""
SELECT league_name, position,
       {S('predicted_low_eur', MONEY)} AS predicted_low_eur,
       {S('predicted_high_eur', MONEY)} AS predicted_high_eur,
       {S('predicted_center_eur', MONEY)} AS predicted_center_eur
FROM peer"""))
def q_peer_range(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return (ctx.scored.select("league_name", "position", "predicted_low_eur",
                              "predicted_high_eur", "predicted_center_eur")
            .dropDuplicates(["league_name", "position"])
            .select("league_name", "position", _money("predicted_low_eur"),
                    _money("predicted_high_eur"), _money("predicted_center_eur")))


@register("status", with_panel("""
SELECT CASE WHEN NOT coalesce(prediction_available, true) OR predicted_low_eur IS NULL
                 OR predicted_high_eur IS NULL THEN 'prediction_not_available'
            WHEN gross_annual_eur IS NULL THEN 'unknown'
            WHEN gross_annual_eur > predicted_high_eur THEN 'overpaid'
            WHEN gross_annual_eur < predicted_low_eur THEN 'underpaid'
            ELSE 'fair' END AS status, count(*) AS n
FROM combined GROUP BY 1"""))
def q_status(spark, sf_dir):
    """``status`` over trained ∪ untrained (prediction_not_available for the latter)."""
    from fairband.functions.scalar import status
    ctx = Ctx(spark, sf_dir)
    c = ctx.combined.withColumn("status", status(F.col("gross_annual_eur"), "predicted_low_eur",
                                                 "predicted_high_eur", "prediction_available"))
    return c.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("score_all", with_panel(f"""
SELECT player_pk, {S('prediction_error_pct', 6)} AS prediction_error_pct, actual_in_range,
       range_accuracy_result, status FROM scored"""))
def q_score_all(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return ctx.scored.select("player_pk", snap("prediction_error_pct", 6).alias("prediction_error_pct"),
                             "actual_in_range", "range_accuracy_result", "status")


@register("scan_table", """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part""")
def q_scan_table(spark, sf_dir):
    return Ctx(spark, sf_dir).table("part")


@register("panel_left_joins", with_panel(f"""
SELECT player_pk, api_football_id, short_name, long_name, league_name, club_name, nationality,
       player_positions, position, age, overall, international_reputation, value_eur,
       preferred_foot, season, appearances, minutes, goals, assists,
       {S('rating', 6)} AS rating, market_value_eur, {S('gross_annual_eur', MONEY)} AS gross_annual_eur
FROM panel"""))
def q_panel(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return ctx.panel.withColumn("rating", snap("rating", 6)) \
        .withColumn("gross_annual_eur", snap("gross_annual_eur", MONEY))


@register("panel_chain", with_panel(f"""
SELECT player_pk, season, appearances, minutes, {S('rating', 6)} AS rating, market_value_eur,
       {S('gross_annual_eur', MONEY)} AS gross_annual_eur, nationality FROM panel"""))
def q_panel_chain(spark, sf_dir):
    """The same panel from the four separate tables, joined one after the other."""
    ctx = Ctx(spark, sf_dir)
    return build_panel(ctx.tables, ctx.spec, fused=False).select(
        "player_pk", "season", "appearances", "minutes", snap("rating", 6).alias("rating"), "market_value_eur",
        snap("gross_annual_eur", MONEY).alias("gross_annual_eur"), "nationality")


@register("panel_all_seasons", with_panel("""
SELECT a.player_pk, s.season, s.appearances, s.minutes, m.market_value_eur
FROM attrs a LEFT JOIN stats s ON a.player_pk = s.player_pk LEFT JOIN market m ON a.player_pk = m.player_pk"""))
def q_panel_all_seasons(spark, sf_dir):
    """One row per entity and season: the joins without the choice of the latest season."""
    ctx = Ctx(spark, sf_dir)
    return build_panel(ctx.tables, ctx.spec, latest_season=False, fused=False).select(
        "player_pk", "season", "appearances", "minutes", "market_value_eur")


@register("eligibility_filter", with_panel("""
SELECT league_name, count(*) AS n FROM trained GROUP BY league_name"""))
def q_eligibility(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return ctx.trained.groupBy("league_name").agg(F.count(F.lit(1)).alias("n"))
