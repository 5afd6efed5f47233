"""Registered source/sink, payload, request-log, cache and explanation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fairband.functions.scalar import snap
from fairband.operators import refresh as RF
from fairband.plans.context import Ctx
from fairband.plans.oracle_sql import snap as S, with_panel
from fairband.plans.registry import register
from fairband.sources import io as IO
from fairband.sources.tables import SCHEMAS


@register("artifact_store", with_panel(f"""
SELECT player_pk, status, {S('predicted_low_eur', 4)} AS predicted_low_eur, {S('predicted_high_eur', 4)} AS predicted_high_eur FROM scored"""))
def q_artifact(spark, sf_dir):
    """Scored table -> parquet snapshot (partitioned by status) -> read back, row by row."""
    c = Ctx(spark, sf_dir)
    path = IO.save_snapshot(c.scored.select("player_pk", "status", "predicted_low_eur", "predicted_high_eur"),
                            "scored_" + sf_dir.strip("/").replace("/", "_"), ["status"])
    return IO.load_snapshot(spark, path).select("player_pk", "status", snap("predicted_low_eur", 4).alias("predicted_low_eur"),
                                                snap("predicted_high_eur", 4).alias("predicted_high_eur"))


@register("metrics_sink", with_panel(f"""
SELECT 'peer_range' AS model, 'within_30' AS metric,
       {S("avg(CASE WHEN abs(predicted_center_eur - gross_annual_eur) / gross_annual_eur <= 0.3 THEN 1.0 ELSE 0.0 END) * 100", 6)} AS value
FROM scored WHERE gross_annual_eur > 0"""))
def q_metrics_sink(spark, sf_dir):
    from fairband.operators.analytics import within_pct
    c = Ctx(spark, sf_dir)
    m = within_pct(c.scored, "predicted_center_eur", "gross_annual_eur").select(
        F.lit("peer_range").alias("model"), F.lit("within_30").alias("metric"),
        snap("within_pct", 6).alias("value"))
    return IO.metrics_sink(m, "metrics_" + sf_dir.strip("/").replace("/", "_"))


EXPORT_COLS = ["player_pk", "short_name", "position", "league_name", "club_name", "nationality",
               "age", "overall", "gross_annual_eur", "predicted_center_eur", "predicted_low_eur",
               "predicted_high_eur", "status"]


def _export(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    src = c.combined_status.select(*EXPORT_COLS)
    path, out = IO.export_csv(src, "export_" + sf_dir.strip("/").replace("/", "_"))
    back = IO.read_export(spark, path, out.schema)
    return src, back


@register("export_csv", with_panel("""
SELECT player_pk AS "Player Pk", short_name AS "Short Name", position AS "Position", league_name AS "League Name",
       club_name AS "Club Name", nationality AS "Nationality", status AS "Status",
       floor(gross_annual_eur) AS "Salary" FROM cstat"""))
def q_export(spark, sf_dir):
    _, back = _export(spark, sf_dir)
    return back.select("Player Pk", "Short Name", "Position", "League Name", "Club Name", "Nationality", "Status",
                       F.floor("Gross Annual Eur").alias("Salary"))


@register("roundtrip_consistency", with_panel("""
SELECT 100.0::DOUBLE AS pct_equal, count(*) AS n FROM cstat"""))
def q_roundtrip(spark, sf_dir):
    src, back = _export(spark, sf_dir)
    back = back.select(*[F.col(IO.title_case(c)).alias(c) for c in EXPORT_COLS])
    return IO.roundtrip_consistency(src, back, "player_pk")


_CAT_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns, "
    f"(SELECT count(*) FROM (DESCRIBE {t}) WHERE column_name NOT IN ({', '.join(repr(n) for n in s.fieldNames())})) AS n_undeclared, "
    f"{len(s.fields)} - (SELECT count(*) FROM (DESCRIBE {t}) WHERE column_name IN ({', '.join(repr(n) for n in s.fieldNames())})) AS n_missing, "
    f"(SELECT count(*) FROM (DESCRIBE {t}) WHERE regexp_matches(lower(column_name), '{'|'.join(IO.FORBIDDEN_TERMS)}')) AS n_forbidden FROM {t}"
    for t, s in SCHEMAS.items())


@register("catalog_audit", _CAT_SQL)
def q_catalog(spark, sf_dir):
    return IO.catalog_audit(spark, sf_dir)


@register("source_funnel", with_panel("""
SELECT 'attributes' AS source, count(*) AS n_rows, count(*) AS n_matched FROM attrs
UNION ALL SELECT 'salaries', count(*), count(*) FILTER (WHERE player_pk IN (SELECT player_pk FROM attrs)) FROM salaries
UNION ALL SELECT 'stats', count(*), count(*) FILTER (WHERE player_pk IN (SELECT player_pk FROM attrs)) FROM stats
UNION ALL SELECT 'market', count(*), count(*) FILTER (WHERE player_pk IN (SELECT player_pk FROM attrs)) FROM market
UNION ALL SELECT 'trained', count(*), count(*) FROM trained"""))
def q_funnel(spark, sf_dir):
    """Rows of every source and how many belong to a known entity: one pass over each file.

    Season statistics carry all that the other activity sources are made of, so one
    row per entity (from one aggregate) joined to the attributes counts all five.
    """
    c = Ctx(spark, sf_dir, persist_panel=False)
    t = c.tables
    both = t.attributes.select("player_pk", "league_name", F.lit(True).alias("_known")).join(t.activity, "player_pk", "full_outer")
    known, sold, priced = F.col("_known").isNotNull(), F.col("gross_annual_eur").isNotNull(), F.col("market_value_eur").isNotNull()
    n = F.coalesce("n_seasons", F.lit(0))
    kept = (F.col("gross_annual_eur") > 0) & (F.col("appearances") >= c.spec.min_activity) & F.col("league_name").isin(list(c.spec.leagues)) & known
    pairs = {"attributes": (F.count_if(known), F.count_if(known)), "salaries": (F.count_if(sold), F.count_if(sold & known)),
             "stats": (F.sum(n), F.coalesce(F.sum(F.when(known, n)), F.lit(0))), "market": (F.count_if(priced), F.count_if(priced & known)),
             "trained": (F.count_if(kept), F.count_if(kept))}
    one = both.agg(F.array(*[F.struct(F.lit(k).alias("source"), a.cast("long").alias("n_rows"), b.cast("long").alias("n_matched"))
                             for k, (a, b) in pairs.items()]).alias("rows"))
    return one.select(F.inline("rows"))


@register("json_payload_parse", with_panel("""
SELECT player_pk AS player_id, CAST(row_number() OVER (PARTITION BY player_pk ORDER BY season) - 1 AS INTEGER) AS block_no,
       CAST(appearances AS INTEGER) AS appearances, CAST(minutes AS INTEGER) AS minutes,
       CAST(goals AS INTEGER) AS goals, CAST(assists AS INTEGER) AS assists
FROM stats"""))
def q_payload(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    docs = IO.build_payloads(c.panel, c.tables.stats)
    return IO.json_payload_parse(docs).select("player_id", "block_no", "appearances", "minutes", "goals", "assists")


@register("events_props_parse", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def q_props(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    ev = c.table("events", ["event_id", "props"])
    return ev.select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@register("statblock_rollup", with_panel("""
, blocks AS (SELECT *, nullif(CAST(round(round_even(rating, 2) * 100) AS BIGINT), 0) AS h, CASE WHEN goals > assists THEN 'Attacker' WHEN minutes >= 60 THEN 'Defender'
                            WHEN minutes < 20 THEN 'Winger' END AS pos FROM stats)
SELECT player_pk AS player_id, CAST(sum(appearances) AS BIGINT) AS appearances, CAST(sum(minutes) AS BIGINT) AS minutes,
       CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists,
       coalesce((sum(h) // nullif(count(h), 0) + CASE WHEN 2 * (sum(h) % count(h)) > count(h)
                 OR (2 * (sum(h) % count(h)) = count(h) AND (sum(h) // count(h)) % 2 = 1) THEN 1 ELSE 0 END) / 100.0, 0.0) AS rating,
       CASE WHEN first(pos ORDER BY appearances DESC, season) IN ('Attacker', 'Defender') THEN first(pos ORDER BY appearances DESC, season)
            ELSE 'Midfielder' END AS position
FROM blocks GROUP BY 1"""))
def q_statblock(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    out = IO.statblock_rollup(IO.json_payload_parse(IO.build_payloads(c.panel, c.tables.stats)))
    return out.select("player_id", "appearances", "minutes", "goals", "assists",
                      "rating", "position")


@register("season_rollup", with_panel("""
, per AS (SELECT player_pk, season, sum(appearances) AS appearances, sum(minutes) AS minutes FROM stats GROUP BY 1, 2)
SELECT player_pk, season, appearances, minutes, row_number() OVER (PARTITION BY player_pk ORDER BY season DESC) AS season_no,
       count(*) OVER (PARTITION BY player_pk) AS n_seasons, sum(appearances) OVER (PARTITION BY player_pk) AS total_appearances,
       sum(minutes) OVER (PARTITION BY player_pk) AS total_minutes FROM per"""))
def q_season_rollup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return IO.season_rollup(c.tables.stats)


LOG_SQL = """log AS (
  SELECT event_type AS endpoint,
         CASE WHEN event_type = 'error' THEN (CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) >= 50 THEN 500 ELSE 404 END)
              WHEN CAST(json_extract(props, '$.k') AS INTEGER) = 0 THEN 0 ELSE 200 END AS status,
         value / 10 AS elapsed_s, ts FROM events)"""


@register("log_error_rollup", f"""WITH {LOG_SQL}
SELECT endpoint, count(*) AS n, count(*) FILTER (WHERE status >= 200 AND status < 300) AS n_success,
       count(*) FILTER (WHERE status >= 500 OR status = 0) AS n_server_error,
       count(*) FILTER (WHERE status >= 400 AND status < 500) AS n_client_error,
       {S('quantile_cont(elapsed_s * 1000, 0.5)', 6)} AS p50_ms, {S('quantile_cont(elapsed_s * 1000, 0.95)', 6)} AS p95_ms,
       {S('CASE WHEN count(*) - count(*) FILTER (WHERE status >= 400 AND status < 500) > 0 THEN count(*) FILTER (WHERE status >= 500 OR status = 0) / (count(*) - count(*) FILTER (WHERE status >= 400 AND status < 500)) * 100 ELSE 0.0 END', 6)} AS error_rate_pct
FROM (SELECT * FROM log UNION ALL SELECT NULL, status, elapsed_s, ts FROM log) GROUP BY 1""")
def q_log_rollup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    out = IO.log_error_rollup(IO.request_log(c.table("events")))
    return out.select(*[snap(x, 6).alias(x) if x in ("p50_ms", "p95_ms", "error_rate_pct") else F.col(x)
                        for x in out.columns])


@register("latency_summary", f"""WITH {LOG_SQL}
SELECT count(*) AS n, {S('avg(elapsed_s)', 9)} AS mean_s,
       {S('avg(CASE WHEN status >= 200 AND status < 300 THEN 1.0 ELSE 0.0 END) * 100', 6)} AS success_pct,
       {S('quantile_cont(elapsed_s, 0.95)', 9)} AS p95_s, {S('quantile_cont(elapsed_s, 0.99)', 9)} AS p99_s,
       {S('count(*) / (epoch(max(ts)) - epoch(min(ts)))', 9)} AS qps,
       quantile_cont(elapsed_s, 0.95) > 0.5 AS degraded
FROM log""")
def q_latency(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    out = IO.latency_summary(IO.request_log(c.table("events")))
    d = {"mean_s": 9, "success_pct": 6, "p95_s": 9, "p99_s": 9, "qps": 9}
    return out.select(*[snap(x, d[x]).alias(x) if x in d else F.col(x) for x in out.columns])


CACHE_SQL = """cache AS (
  SELECT s.player_pk, s.predicted_low_eur, s.predicted_high_eur, s.predicted_center_eur,
         CASE WHEN s.league_name = 'PROMO' THEN 'peer_range:v0' ELSE 'peer_range:v1' END AS model_version,
         CAST(d.last_ship AS TIMESTAMP) AS computed_at
  FROM scored s JOIN (SELECT l_partkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) d
    ON s.player_pk = d.l_partkey)"""


def _cache(c):
    li = c.table("lineitem", ["l_partkey", "l_shipdate"]).groupBy("l_partkey").agg(F.max("l_shipdate").alias("last_ship"))
    s = c.scored.select("player_pk", "league_name", "predicted_low_eur", "predicted_high_eur", "predicted_center_eur")
    return s.join(li, s.player_pk == li.l_partkey).select(
        "player_pk", "predicted_low_eur", "predicted_high_eur", "predicted_center_eur",
        F.when(F.col("league_name") == "PROMO", F.lit("peer_range:v0")).otherwise(F.lit("peer_range:v1")).alias("model_version"),
        F.col("last_ship").cast("timestamp").alias("computed_at"))


@register("cache_read", with_panel(f""", {CACHE_SQL}
SELECT player_pk, computed_at FROM cache WHERE model_version = 'peer_range:v1'
  AND computed_at > TIMESTAMP '2001-11-04' - INTERVAL 30 DAYS"""))
def q_cache_read(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    out = RF.cache_read(_cache(c), c.panel.select("player_pk"), "peer_range:v1", "2001-11-04", ttl_days=30)
    return out.select("player_pk", "computed_at")


@register("anti_cached", with_panel(f""", {CACHE_SQL}
SELECT player_pk FROM panel WHERE player_pk NOT IN (
  SELECT player_pk FROM cache WHERE model_version = 'peer_range:v1'
    AND computed_at > TIMESTAMP '2001-11-04' - INTERVAL 30 DAYS)"""))
def q_anti_cached(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    fresh = RF.cache_read(_cache(c), None, "peer_range:v1", "2001-11-04", ttl_days=30)
    return RF.anti_cached(c.panel.select("player_pk"), fresh)


@register("cache_upsert", with_panel(f""", {CACHE_SQL},
upd AS (SELECT player_pk, predicted_low_eur, predicted_high_eur, predicted_center_eur,
               'peer_range:v1' AS model_version, TIMESTAMP '2001-11-04' AS computed_at, 1 AS src
        FROM scored WHERE league_name = 'PROMO'),
u AS (SELECT *, 0 AS src FROM cache UNION ALL BY NAME SELECT * FROM upd)
SELECT model_version, count(*) AS n, CAST(max(computed_at) AS VARCHAR) AS newest FROM (
  SELECT *, row_number() OVER (PARTITION BY player_pk ORDER BY computed_at DESC, src DESC) AS rn FROM u) WHERE rn = 1
GROUP BY 1"""))
def q_cache_upsert(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    upd = c.scored.filter(F.col("league_name") == "PROMO").select(
        "player_pk", "predicted_low_eur", "predicted_high_eur", "predicted_center_eur",
        F.lit("peer_range:v1").alias("model_version"),
        F.lit("2001-11-04").cast("timestamp").alias("computed_at"))
    out = RF.cache_upsert(_cache(c), upd)
    return out.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("n"),
        F.date_format(F.max("computed_at"), "yyyy-MM-dd HH:mm:ss").alias("newest"))


EXPLAINED = ["overall", "minutes", "appearances", "goals", "assists", "rating", "age"]


def _explanation_sql() -> str:
    """Factors by |correlation| with the target, the percentile, the phrases, and the three nearest rows on the standardised factors."""
    from fairband.operators.explain import DISPLAY_NAMES
    names = ", ".join(f"'{f}'" for f in EXPLAINED)
    shown = "CASE f " + " ".join(f"WHEN '{f}' THEN '{DISPLAY_NAMES[f]}'" for f in EXPLAINED) + " END"
    apart = " + ".join(f"(a.z_{f} - b.z_{f}) * (a.z_{f} - b.z_{f})" for f in EXPLAINED)
    return with_panel(f"""
, stat AS (SELECT unnest([{names}]) AS f, unnest([{", ".join(f"avg({f})" for f in EXPLAINED)}]) AS mean,
           unnest([{", ".join(f"abs(corr({f}, gross_annual_eur))" for f in EXPLAINED)}]) AS weight FROM scored),
val AS (SELECT player_pk, unnest([{names}]) AS f, unnest([{", ".join(f"{f}::DOUBLE" for f in EXPLAINED)}]) AS value FROM scored),
ranked AS (SELECT v.*, mean, row_number() OVER (PARTITION BY player_pk ORDER BY weight DESC) AS place, {shown} AS shown FROM val v JOIN stat USING (f)),
factors AS (SELECT player_pk, string_agg(shown || CASE WHEN value >= mean THEN ': not below average (' ELSE ': below average (' END
              || format('{{:,.2f}}', value) || ' against ' || format('{{:,.2f}}', mean) || ')', chr(10) ORDER BY place) FILTER (WHERE place <= 5) AS lines,
              max(shown) FILTER (WHERE place = 1) AS strongest FROM ranked GROUP BY 1),
z AS (SELECT player_pk, {", ".join(f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS z_{f}" for f in EXPLAINED)} FROM scored),
near AS (SELECT a.player_pk, b.player_pk AS other, row_number() OVER (PARTITION BY a.player_pk ORDER BY round_even(sqrt({apart}), 9), b.player_pk) AS place
         FROM z a JOIN z b ON a.player_pk <> b.player_pk QUALIFY place <= 3),
alike AS (SELECT n.player_pk, string_agg(s.short_name || ' (' || s.position || ', rating ' || format('{{:,.1f}}', s.overall) || '): paid EUR '
            || format('{{:,.0f}}', s.gross_annual_eur), chr(10) ORDER BY place) AS lines FROM near n JOIN scored s ON s.player_pk = n.other GROUP BY 1),
pct AS (SELECT player_pk, round_even(cume_dist() OVER (ORDER BY gross_annual_eur) * 100, 1) AS p FROM scored)
SELECT s.player_pk,
  'Yearly pay range of ' || short_name || ', ' || club_name || ': EUR ' || format('{{:,.0f}}', predicted_low_eur) || ' - EUR ' || format('{{:,.0f}}', predicted_high_eur)
  || '; more than ' || CAST(p AS VARCHAR) || ' % of the rows. Strongest factor: ' || strongest || '. Profile: aged ' || CAST(CAST(age AS INTEGER) AS VARCHAR) || ' ('
  || CASE WHEN age <= 23 THEN 'learning the trade' WHEN age <= 26 THEN 'best seasons to come' WHEN age <= 30 THEN 'at full strength'
          WHEN age <= 33 THEN 'many seasons played' ELSE 'late career' END || '), '
  || CASE WHEN overall >= 85 THEN 'top-tier rating, ' WHEN overall >= 80 THEN 'strong rating, ' WHEN overall >= 75 THEN 'sound rating, ' ELSE '' END
  || CASE WHEN coalesce(international_reputation, 0) >= 5 THEN 'known worldwide' WHEN coalesce(international_reputation, 0) >= 4 THEN 'known abroad'
          WHEN coalesce(international_reputation, 0) >= 3 THEN 'known outside the home league' WHEN coalesce(international_reputation, 0) >= 2 THEN 'known at home'
          ELSE 'little known' END || '. Roles: ' || trim(split_part(player_positions, ',', 1)) || ' or ' || trim(split_part(player_positions, ',', 2))
  || '. Traits: ' || split_part(short_name, ' ', 1) || ' and ' || split_part(short_name, ' ', 2) || '. Tags: ' || lower(league_name) || ' and ' || lower(position) || '.' AS explanation,
  'Factors:' || chr(10) || factors.lines || chr(10) || 'Rows like it:' || chr(10) || alike.lines AS explanation_context
FROM scored s JOIN factors USING (player_pk) JOIN alike USING (player_pk) JOIN pct USING (player_pk)""")


@register("template_explanation", _explanation_sql())
def q_explanation(spark, sf_dir):
    """Statements for every trained row and the facts behind them: peer range, percentile, factors, and three rows like it with their pay."""
    from fairband.operators.analytics import feature_stats, percentile_rank
    from fairband.operators.explain import explanation_context, feature_contributions, similar_lines, template_explanation
    from fairband.operators.features import standard_scale
    from fairband.operators.neighbors import similar_entities
    c = Ctx(spark, sf_dir)
    key = c.spec.key
    stats = {r["feature"]: (r["mean"], r["std"]) for r in feature_stats(c.scored, EXPLAINED).collect()}
    corr = c.scored.agg(*[F.corr(f, "gross_annual_eur").alias(f) for f in EXPLAINED]).first()
    imps = sorted([(0, f, abs(corr[f] or 0.0)) for f in EXPLAINED], key=lambda t: -t[2])
    # the adapter's tables have neither traits nor tags: words of the name and two categories stand for them
    x = percentile_rank(c.scored, "gross_annual_eur").withColumns({
        "player_traits": F.concat_ws(", ", F.split("short_name", " ")[0], F.split("short_name", " ")[1]),
        "player_tags": F.concat(F.lit("#"), F.lower("league_name"), F.lit(", #"), F.lower("position"))})
    x = feature_contributions(x, imps, {f: m for f, (m, _) in stats.items()}, 5)
    x = template_explanation(x.withColumn("top_feature", F.col("contributions")[0]["feature"]), traits="player_traits", tags="player_tags")
    points = standard_scale(c.scored.select(key, *EXPLAINED), stats).select(key, F.array(*EXPLAINED).alias("v"))
    near = similar_entities(points, key, "v", 8)  # some more, so that equal distances are ordered by id alone
    by = Window.partitionBy("query_id").orderBy(F.bround("distance", 9), "neighbor_id")
    near = near.withColumn("rank", F.row_number().over(by)).filter("rank <= 3")
    x = x.join(similar_lines(near, c.scored, key), key, "left")
    return explanation_context(x, similar="similar").select(key, "explanation", "explanation_context")


@register("missing_keys", with_panel("""
SELECT w.player_pk FROM (SELECT unnest([1, 12, 30, 2000001, 2000002]) AS player_pk) w WHERE w.player_pk NOT IN (SELECT player_pk FROM combined)"""))
def q_missing_keys(spark, sf_dir):
    """The asked keys that no entity has: the not-found answer of a lookup."""
    from fairband.operators.filters import missing_keys
    c = Ctx(spark, sf_dir)
    asked = spark.createDataFrame([(1,), (12,), (30,), (2000001,), (2000002,)], "player_pk long")
    return missing_keys(c.combined, asked, c.spec.key)
