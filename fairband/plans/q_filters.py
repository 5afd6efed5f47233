"""Registered filter / lookup / join queries over the combined (trained ∪ untrained) view."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairband.functions.scalar import snap
from fairband.operators import filters as FL
from fairband.operators import panel as P
from fairband.operators.ranking import compare_side_by_side, page_count, paginate, paginate_after
from fairband.plans.context import Ctx
from fairband.plans.oracle_sql import snap as S, with_panel
from fairband.plans.registry import register

OUT = ["player_pk", "short_name", "league_name", "position", "status"]
OUT_SQL = ", ".join(OUT)


def _out(df):
    return df.select(*OUT)


@register("filter_league", with_panel(f"""
SELECT {OUT_SQL} FROM cstat WHERE coalesce(contains(lower(league_name), 'eco'), false)"""))
def q_filter_league(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _out(FL.filter_league(c.combined_status, "ECO", c.spec))


@register("filter_position", with_panel(f"""
SELECT {OUT_SQL} FROM cstat WHERE coalesce(contains(lower(position), 'defend'), false)"""))
def q_filter_position(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _out(FL.filter_position(c.combined_status, "Defend", c.spec))


@register("filter_league_position", with_panel(f"""
SELECT {OUT_SQL} FROM cstat WHERE contains(lower(league_name), 'promo')
  AND contains(lower(position), 'attack')"""))
def q_filter_league_position(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _out(FL.filter_position(FL.filter_league(c.combined_status, "promo", c.spec), "attack", c.spec))


@register("filter_q", with_panel(f"""
SELECT {OUT_SQL} FROM cstat WHERE contains(lower(short_name), 'gear')
  OR contains(lower(long_name), 'gear') OR contains(lower(club_name), 'gear')"""))
def q_filter_q(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _out(FL.filter_q(c.combined_status, "Gear", c.spec))


@register("filter_regex", with_panel(f"""
SELECT {OUT_SQL} FROM cstat WHERE regexp_matches(short_name, '(?i)^(hot|cold) (ring|rod)$')"""))
def q_filter_regex(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _out(c.combined_status.filter(F.col("short_name").rlike("(?i)^(hot|cold) (ring|rod)$")))


@register("filter_exact", with_panel(f"""
SELECT {OUT_SQL} FROM cstat WHERE club_name = 'Brand#7'"""))
def q_filter_exact(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _out(FL.filter_exact(c.combined_status, "club_name", "Brand#7"))


@register("filter_max_salary", with_panel(f"""
SELECT {OUT_SQL} FROM cstat WHERE coalesce(gross_annual_eur, 0) <= 20000"""))
def q_filter_max_salary(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _out(FL.filter_max_salary(c.combined_status, 20000, c.spec))


def _status_sql(name):
    cond = {"overpaid": "gross_annual_eur > predicted_high_eur",
            "underpaid": "gross_annual_eur < predicted_low_eur",
            "fair": "gross_annual_eur >= predicted_low_eur AND gross_annual_eur <= predicted_high_eur"}[name]
    return with_panel(f"""
SELECT {OUT_SQL} FROM cstat WHERE coalesce(prediction_available, true)
  AND predicted_low_eur IS NOT NULL AND predicted_high_eur IS NOT NULL
  AND gross_annual_eur IS NOT NULL AND {cond}""")


for _name in ("overpaid", "underpaid", "fair"):
    def _mk(name):
        def q(spark, sf_dir):
            c = Ctx(spark, sf_dir)
            return _out(FL.filter_status(c.combined_status, name, c.spec))
        return q
    register(f"filter_status_{_name}", _status_sql(_name))(_mk(_name))


@register("search_name", with_panel("""
SELECT player_pk, short_name, long_name FROM cstat
WHERE contains(lower(short_name), 'blue') OR contains(lower(long_name), 'blue')
ORDER BY player_pk LIMIT 20"""))
def q_search_name(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return FL.search_name(c.combined_status, "Blue", c.spec).select("player_pk", "short_name", "long_name")


@register("lookup_ilike", with_panel("""
SELECT player_pk, short_name, api_football_id FROM panel
WHERE short_name ILIKE '%d_ri%' AND api_football_id IS NOT NULL
ORDER BY player_pk LIMIT 20"""))
def q_lookup_ilike(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return FL.lookup_ilike(c.panel, "d_ri", c.spec).select("player_pk", "short_name", "api_football_id")


_KEYS_SQL = """keys AS (
  SELECT DISTINCT l_partkey AS player_pk FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"""


def _keys(c):
    li = c.table("lineitem", ["l_orderkey", "l_partkey"])
    o = c.table("orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"]) \
        .filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
    return li.join(o, li.l_orderkey == o.o_orderkey, "left_semi").select(F.col("l_partkey").alias("player_pk"))


@register("point_lookup", with_panel(f""", {_KEYS_SQL}
SELECT c.player_pk, c.short_name, c.status FROM cstat c JOIN keys k ON c.player_pk = k.player_pk""")
          .replace("WITH ", "WITH ", 1))
def q_point_lookup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return FL.point_lookup(c.combined_status, _keys(c), "player_pk").select("player_pk", "short_name", "status")


@register("scan_keys", with_panel(f""", {_KEYS_SQL}
SELECT player_pk, season, appearances FROM stats WHERE player_pk IN (SELECT player_pk FROM keys)"""))
def q_scan_keys(spark, sf_dir):
    from fairband.sources.tables import scan_keys
    c = Ctx(spark, sf_dir)
    return scan_keys(c.tables.stats, _keys(c), "player_pk", ["player_pk", "season", "appearances"])


@register("scan_in_list", """
SELECT p_partkey, p_type FROM part WHERE p_type IN ('LARGE', 'SMALL')""")
def q_scan_in_list(spark, sf_dir):
    from fairband.sources.tables import scan_in_list
    c = Ctx(spark, sf_dir)
    return scan_in_list(c.table("part", ["p_partkey", "p_type"]), "p_type", ["LARGE", "SMALL"])


@register("paginate", with_panel(f"""
SELECT {OUT_SQL} FROM cstat ORDER BY gross_annual_eur DESC NULLS LAST, player_pk LIMIT 50 OFFSET 50"""))
def q_paginate(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _out(paginate(c.combined_status, c.spec, "actual_salary", "desc", page=2, per_page=50))


@register("paginate_asc_error", with_panel(f"""
SELECT {OUT_SQL} FROM cstat ORDER BY prediction_error_pct ASC NULLS LAST, player_pk LIMIT 30 OFFSET 60"""))
def q_paginate_asc(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _out(paginate(c.combined_status, c.spec, "prediction_error", "asc", page=3, per_page=30))


@register("paginate_after", with_panel(f"""
SELECT {OUT_SQL} FROM cstat ORDER BY gross_annual_eur DESC NULLS LAST, player_pk LIMIT 50 OFFSET 100"""))
def q_paginate_after(spark, sf_dir):
    """The third page, from the last row of the second."""
    c = Ctx(spark, sf_dir)
    last = paginate(c.combined_status, c.spec, page=2, per_page=50).select("gross_annual_eur", c.spec.key).collect()[-1]
    return _out(paginate_after(c.combined_status, c.spec, last[0], last[1], per_page=50))


@register("page_count", with_panel("""
SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages
FROM cstat WHERE contains(lower(league_name), 'a')"""))
def q_page_count(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return page_count(FL.filter_league(c.combined_status, "a", c.spec), 50)


@register("compare_side_by_side", with_panel("""
, req(ordinal, player_pk) AS (VALUES (0, 12), (1, 7), (2, 12), (3, 99999999), (4, 3))
SELECT r.ordinal, r.player_pk, s.short_name, coalesce(s.found, false) AS found
FROM req r LEFT JOIN (SELECT player_pk, short_name, true AS found FROM scored) s
  ON r.player_pk = s.player_pk"""))
def q_compare(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return compare_side_by_side(spark, c.scored.select("player_pk", "short_name"),
                                [12, 7, 12, 99999999, 3], c.spec) \
        .select("ordinal", "player_pk", "short_name", "found")


@register("combined_view", with_panel(f"""
SELECT player_pk, league_name, appearances, prediction_available, {S('predicted_low_eur', 4)} AS predicted_low_eur FROM combined"""))
def q_combined(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return c.combined.select("player_pk", "league_name", "appearances", "prediction_available",
                             snap("predicted_low_eur", 4).alias("predicted_low_eur"))


@register("untrained_star", with_panel(f"""
SELECT player_pk, short_name, league_name, {S('gross_annual_eur', 4)} AS gross_annual_eur,
       appearances FROM untrained"""))
def q_untrained(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return c.untrained.select("player_pk", "short_name", "league_name",
                              snap("gross_annual_eur", 4).alias("gross_annual_eur"), "appearances")


@register("anti_trained", with_panel("""
SELECT player_pk FROM panel WHERE player_pk NOT IN (SELECT player_pk FROM trained)"""))
def q_anti(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return P.anti_trained(c.panel, c.trained, "player_pk").select("player_pk")


@register("semi_keys", with_panel(f""", {_KEYS_SQL}
SELECT player_pk, short_name FROM trained WHERE player_pk IN (SELECT player_pk FROM keys)"""))
def q_semi(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return c.trained.join(_keys(c), "player_pk", "left_semi").select("player_pk", "short_name")


@register("lateral_latest", with_panel("""
SELECT player_pk, season, appearances FROM latest"""))
def q_lateral_latest(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return P.latest_per_key(c.tables.stats, "player_pk", "season").select("player_pk", "season", "appearances")


@register("latest_per_key_sql", with_panel("""
SELECT player_pk, season, minutes FROM latest"""))
def q_lateral_sql(spark, sf_dir):
    """Same rule written as Spark SQL ``LEFT JOIN LATERAL (... ORDER BY season DESC LIMIT 1)``."""
    c = Ctx(spark, sf_dir)
    c.tables.stats.createOrReplaceTempView("fb_stats")
    c.tables.attributes.createOrReplaceTempView("fb_attrs")
    return spark.sql("""
        SELECT a.player_pk, s.season, s.minutes FROM fb_attrs a
        JOIN LATERAL (SELECT season, minutes FROM fb_stats t WHERE t.player_pk = a.player_pk
                      ORDER BY season DESC NULLS LAST LIMIT 1) s""")


@register("map_enrich", with_panel("""
SELECT i.nationality, count(*) AS n FROM scored s LEFT JOIN ident i ON s.player_pk = i.player_pk
GROUP BY 1"""))
def q_map_enrich(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    out = P.map_enrich(c.scored.drop("nationality"), c.tables.identity, "player_pk", ["nationality"])
    return out.groupBy("nationality").agg(F.count(F.lit(1)).alias("n"))


@register("writeback_join", with_panel(f"""
SELECT p.player_pk, coalesce(p.gross_annual_eur > 0 AND p.gross_annual_eur BETWEEN pr.predicted_low_eur AND pr.predicted_high_eur, false) AS actual_in_range,
       pr.predicted_low_eur IS NOT NULL AS prediction_available, {S('pr.predicted_high_eur', 4)} AS predicted_high_eur
FROM panel p LEFT JOIN peer pr USING (league_name, position)"""))
def q_writeback(spark, sf_dir):
    """Peer ranges written back onto every panel row (untrained leagues get none)."""
    c = Ctx(spark, sf_dir)
    preds = c.panel.join(c.scored.select("league_name", "position", "predicted_low_eur",
                                         "predicted_high_eur", "predicted_center_eur")
                         .dropDuplicates(["league_name", "position"]),
                         ["league_name", "position"], "left").select(
        "player_pk", "predicted_low_eur", "predicted_high_eur", "predicted_center_eur")
    return P.writeback_join(c.panel, preds, c.spec).select(
        "player_pk", "actual_in_range", "prediction_available", snap("predicted_high_eur", 4).alias("predicted_high_eur"))


@register("inner_benchmark", with_panel(f"""
SELECT count(*) AS n,
       {S("avg(CASE WHEN market_value_eur >= predicted_low_eur AND market_value_eur <= predicted_high_eur THEN 1.0 ELSE 0.0 END) * 100", 6)} AS market_in_range_pct
FROM scored WHERE market_value_eur IS NOT NULL AND market_value_eur > 0"""))
def q_inner_benchmark(spark, sf_dir):
    """Predictions ⋈ market values (value present and > 0): share of market values inside the range."""
    c = Ctx(spark, sf_dir)
    mv = c.tables.market.filter(F.col("market_value_eur") > 0)
    j = c.scored.drop("market_value_eur").join(mv, "player_pk", "inner")
    inr = (F.col("market_value_eur") >= F.col("predicted_low_eur")) & (F.col("market_value_eur") <= F.col("predicted_high_eur"))
    return j.agg(F.count(F.lit(1)).alias("n"),
                 snap(F.avg(F.when(inr, 1.0).otherwise(0.0)) * 100, 6).alias("market_in_range_pct"))


@register("live_combine", with_panel("""
, live AS (SELECT player_pk, appearances, minutes FROM stats WHERE season = (SELECT max(season) FROM stats))
SELECT p.player_pk, coalesce(nullif(l.appearances, 0), p.appearances, 0.0) AS appearances,
       coalesce(nullif(l.minutes, 0), p.minutes, 0.0) AS minutes
FROM panel p LEFT JOIN live l ON p.player_pk = l.player_pk"""))
def q_live_combine(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    live = c.tables.stats.filter(F.col("season") == c.tables.stats.agg(F.max("season")).scalar()) \
        .select("player_pk", "appearances", "minutes")
    return P.live_combine(c.panel, live, "player_pk", ["appearances", "minutes"]).select("player_pk", "appearances", "minutes")


@register("outlier_3sigma", with_panel(f"""
, st AS (SELECT avg(gross_annual_eur) AS m, stddev_samp(gross_annual_eur) AS s FROM scored)
SELECT count(*) FILTER (WHERE gross_annual_eur > m + 3 * s OR gross_annual_eur < greatest(0.0, m - 3 * s)) AS n_actual,
       count(*) FILTER (WHERE predicted_center_eur > m + 3 * s OR predicted_center_eur < greatest(0.0, m - 3 * s)) AS n_pred
FROM scored, st"""))
def q_outlier(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    a = FL.outlier_3sigma(c.scored, c.spec, "gross_annual_eur")
    a = FL.outlier_3sigma(a, c.spec, "predicted_center_eur")
    return a.agg(F.count_if("gross_annual_eur_outlier").alias("n_actual"),
                 F.count_if("predicted_center_eur_outlier").alias("n_pred"))


@register("sanity_bounds", with_panel(f"""
SELECT count(*) FILTER (WHERE predicted_center_eur < 0) AS n_negative,
       count(*) FILTER (WHERE predicted_center_eur > 1e9) AS n_too_large,
       {S('min(predicted_center_eur)', 4)} AS min_value, {S('max(predicted_center_eur)', 4)} AS max_value
FROM scored"""))
def q_sanity(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    r = FL.sanity_bounds(c.scored, "predicted_center_eur")
    return r.select("n_negative", "n_too_large", snap("min_value", 4).alias("min_value"),
                    snap("max_value", 4).alias("max_value"))


@register("min_threshold_audit", with_panel("""
SELECT min(appearances) AS min_value, count(*) FILTER (WHERE appearances < 20) AS n_below FROM trained"""))
def q_min_threshold(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return FL.min_threshold_audit(c.trained, "appearances", 20)


@register("drop_admin", """
SELECT l_partkey, l_quantity FROM lineitem""")
def q_drop_admin(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    out = P.drop_admin(c.table("lineitem"), ["l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount",
                            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "not_a_column"])
    return out


@register("base_projection", with_panel("""
SELECT player_pk, short_name, position, league_name, nationality, age, appearances FROM trained"""))
def q_base_projection(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return P.base_projection(c.trained).select("player_pk", "short_name", "position", "league_name", "nationality", "age",
                                               "appearances")


@register("extremes", with_panel(f"""
(SELECT player_pk, {S('prediction_error_pct', 6)} AS prediction_error_pct, 'largest' AS side FROM scored
 ORDER BY prediction_error_pct DESC, player_pk LIMIT 5)
UNION ALL
(SELECT player_pk, {S('prediction_error_pct', 6)} AS prediction_error_pct, 'smallest' AS side FROM scored
 ORDER BY prediction_error_pct ASC, player_pk LIMIT 5)"""))
def q_extremes(spark, sf_dir):
    """``extremes`` / ``concat_extremes``: 5 largest ∪ 5 smallest signed errors."""
    from fairband.operators.ranking import extremes
    c = Ctx(spark, sf_dir)
    out = extremes(c.scored.select("player_pk", "prediction_error_pct"), "prediction_error_pct", "player_pk", 5)
    return out.select("player_pk", snap("prediction_error_pct", 6).alias("prediction_error_pct"), "side")


@register("sufficiency_gate", with_panel("""
, cur AS (SELECT player_pk, appearances AS current_apps FROM stats WHERE season = (SELECT max(season) FROM stats)),
hist AS (SELECT player_pk, sum(appearances) AS history_apps FROM stats GROUP BY 1),
g AS (SELECT p.player_pk, coalesce(c.current_apps, 0.0) AS cu, coalesce(h.history_apps, 0.0) AS hi, p.overall
      FROM panel p LEFT JOIN cur c ON p.player_pk = c.player_pk LEFT JOIN hist h ON p.player_pk = h.player_pk)
SELECT player_pk, CAST((cu < 20)::INT + (hi < 20)::INT AS INTEGER) AS n_warnings,
       CASE WHEN cu = 0 AND hi = 0 THEN 'no_activity' WHEN cu = 0 THEN 'no_current_activity'
            WHEN overall IS NULL THEN 'no_attributes' END AS error_code
FROM g"""))
def q_sufficiency(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    st = c.tables.stats
    cur = st.filter(F.col("season") == st.agg(F.max("season")).scalar()) \
        .select("player_pk", F.col("appearances").alias("current_apps"))
    hist = st.groupBy("player_pk").agg(F.sum("appearances").alias("history_apps"))
    g = c.panel.select("player_pk", "overall").join(cur, "player_pk", "left").join(hist, "player_pk", "left")
    return P.sufficiency_gate(g, "current_apps", "history_apps", "overall").select(
        "player_pk", F.size("warnings").alias("n_warnings"), "error_code")
