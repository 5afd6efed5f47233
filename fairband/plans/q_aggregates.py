"""Registered aggregation / distribution / metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairband.functions.scalar import per_90, snap
from fairband.operators import analytics as A
from fairband.operators.panel import numeric_columns
from fairband.plans.context import Ctx
from fairband.plans.oracle_sql import snap as S, with_panel
from fairband.plans.q_features import SPLIT_SQL
from fairband.plans.registry import register


def _snap_cols(df, digits: dict):
    return df.select(*[snap(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


@register("league_stats", with_panel(f"""
, tp AS (SELECT league_name, short_name AS top_paid_name, gross_annual_eur AS top_paid_salary FROM (
    SELECT league_name, short_name, gross_annual_eur,
           row_number() OVER (PARTITION BY league_name ORDER BY gross_annual_eur DESC, player_pk) AS rn
    FROM combined WHERE gross_annual_eur IS NOT NULL) WHERE rn = 1)
SELECT c.league_name, count(*) AS n_players, {S('avg(gross_annual_eur)', 4)} AS mean_salary,
       {S('min(gross_annual_eur)', 4)} AS min_salary, {S('max(gross_annual_eur)', 4)} AS max_salary,
       {S('stddev_samp(gross_annual_eur)', 4)} AS std_salary, {S('avg(overall)', 6)} AS mean_overall,
       {S("avg(CASE WHEN coalesce(range_accuracy_result AND gross_annual_eur IS NOT NULL, false) THEN 1.0 ELSE 0.0 END) * 100", 6)} AS range_accuracy_pct,
       count(gross_annual_eur) > 0 AS has_salary_data,
       {S('quantile_cont(gross_annual_eur, 0.5)', 4)} AS median_salary,
       any_value(tp.top_paid_name) AS top_paid_name, {S('any_value(tp.top_paid_salary)', 4)} AS top_paid_salary
FROM combined c LEFT JOIN tp ON c.league_name = tp.league_name GROUP BY c.league_name"""))
def q_league_stats(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    out = A.league_stats(c.combined, c.spec)
    return _snap_cols(out, {"mean_salary": 4, "min_salary": 4, "max_salary": 4, "std_salary": 4,
                            "mean_overall": 6, "range_accuracy_pct": 6, "median_salary": 4,
                            "top_paid_salary": 4})


@register("position_stats", with_panel(f"""
SELECT position, count(*) AS n_players, count(coalesce(gross_annual_eur, predicted_center_eur)) AS n_valued,
       {S('avg(coalesce(gross_annual_eur, predicted_center_eur))', 4)} AS mean_salary,
       {S('min(coalesce(gross_annual_eur, predicted_center_eur))', 4)} AS min_salary,
       {S('max(coalesce(gross_annual_eur, predicted_center_eur))', 4)} AS max_salary,
       {S("avg(CASE WHEN gross_annual_eur IS NOT NULL THEN (CASE WHEN coalesce(range_accuracy_result, false) THEN 1.0 ELSE 0.0 END) END) * 100", 6)} AS range_accuracy_pct,
       {S('avg(age)', 6)} AS mean_age,
       {S('quantile_cont(coalesce(gross_annual_eur, predicted_center_eur), 0.5)', 4)} AS median_salary
FROM combined GROUP BY position HAVING count(coalesce(gross_annual_eur, predicted_center_eur)) > 0"""))
def q_position_stats(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.position_stats(c.combined, c.spec),
                      {"mean_salary": 4, "min_salary": 4, "max_salary": 4, "range_accuracy_pct": 6,
                       "mean_age": 6, "median_salary": 4})


AGE_CASE = """CASE WHEN age >= 17 AND age < 21 THEN '17-20' WHEN age >= 21 AND age < 24 THEN '21-23'
  WHEN age >= 24 AND age < 27 THEN '24-26' WHEN age >= 27 AND age < 30 THEN '27-29'
  WHEN age >= 30 AND age < 33 THEN '30-32' WHEN age >= 33 AND age < 40 THEN '33-39' END"""


@register("age_buckets", with_panel(f"""
SELECT age_bucket, count(*) AS n_players, {S('avg(gross_annual_eur)', 4)} AS mean_salary,
       {S('quantile_cont(gross_annual_eur, 0.5)', 4)} AS median_salary
FROM (SELECT *, {AGE_CASE} AS age_bucket FROM scored) WHERE age_bucket IS NOT NULL GROUP BY 1"""))
def q_age_buckets(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.age_buckets(c.scored, c.spec), {"mean_salary": 4, "median_salary": 4})


@register("peak_age", with_panel(f"""
SELECT age, {S('avg(gross_annual_eur)', 4)} AS mean_salary FROM scored WHERE gross_annual_eur IS NOT NULL
GROUP BY age ORDER BY avg(gross_annual_eur) DESC, age LIMIT 1"""))
def q_peak_age(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.peak_age(c.scored, c.spec), {"mean_salary": 4})


@register("overview", with_panel(f"""
SELECT count(*) AS total, count(gross_annual_eur) AS n_salary,
       {S('avg(gross_annual_eur)', 4)} AS mean_salary, {S('min(gross_annual_eur)', 4)} AS min_salary,
       {S('max(gross_annual_eur)', 4)} AS max_salary,
       {S('CASE WHEN count(gross_annual_eur) > 1 THEN stddev_samp(gross_annual_eur) ELSE 0.0 END', 4)} AS std_salary,
       {S('avg(age)', 6)} AS mean_age, min(age) AS min_age, max(age) AS max_age,
       count(DISTINCT league_name) AS n_leagues, count(DISTINCT position) AS n_positions,
       {S('quantile_cont(gross_annual_eur, 0.5)', 4)} AS median_salary
FROM combined"""))
def q_overview(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.overview(c.combined, c.spec),
                      {"mean_salary": 4, "min_salary": 4, "max_salary": 4, "std_salary": 4,
                       "mean_age": 6, "median_salary": 4})


@register("overview_groups", with_panel(f"""
SELECT 'league' AS grouping, league_name AS name, count(*) AS n, {S('avg(gross_annual_eur)', 4)} AS mean_salary,
       {S('quantile_cont(gross_annual_eur, 0.5)', 4)} AS median_salary, {S('min(gross_annual_eur)', 4)} AS min_salary,
       {S('max(gross_annual_eur)', 4)} AS max_salary
FROM combined WHERE league_name IS NOT NULL GROUP BY league_name
UNION ALL
SELECT 'position', position, count(*), {S('avg(coalesce(gross_annual_eur, predicted_center_eur))', 4)},
       {S('quantile_cont(coalesce(gross_annual_eur, predicted_center_eur), 0.5)', 4)}, NULL, NULL
FROM combined WHERE position IS NOT NULL GROUP BY position"""))
def q_overview_groups(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.overview_groups(c.combined, c.spec),
                      {k: 4 for k in ("mean_salary", "median_salary", "min_salary", "max_salary")})


@register("describe", with_panel(f"""
SELECT count(gross_annual_eur) AS count, {S('avg(gross_annual_eur)', 4)} AS mean,
       {S('stddev_samp(gross_annual_eur)', 4)} AS std, {S('min(gross_annual_eur)', 4)} AS min,
       {S('max(gross_annual_eur)', 4)} AS max,
       {S('quantile_cont(gross_annual_eur, 0.25)', 4)} AS q25, {S('quantile_cont(gross_annual_eur, 0.5)', 4)} AS q50,
       {S('quantile_cont(gross_annual_eur, 0.75)', 4)} AS q75
FROM trained"""))
def q_describe(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.describe(c.trained, "gross_annual_eur"),
                      {k: 4 for k in ("mean", "std", "min", "max", "q25", "q50", "q75")})


@register("value_counts_top", with_panel("""
SELECT club_name, count(*) AS n FROM combined GROUP BY 1 ORDER BY n DESC, club_name LIMIT 5"""))
def q_value_counts(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return A.value_counts_top(c.combined, "club_name", 5)


@register("group_median_order", with_panel(f"""
SELECT league_name, {S('quantile_cont(gross_annual_eur, 0.5)', 4)} AS median FROM scored GROUP BY 1"""))
def q_group_medians(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.group_medians(c.scored, "league_name", "gross_annual_eur"), {"median": 4})


ATTRS = ["age", "overall", "rating", "minutes", "goals", "assists"]


@register("attr_means_by_group", with_panel(
    "SELECT position, count(*) AS n, " + ", ".join(f"{S(f'avg({a})', 6)} AS mean_{a}" for a in ATTRS)
    + " FROM scored GROUP BY position"))
def q_attr_means(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.attr_means_by_group(c.scored, "position", ATTRS), {f"mean_{a}": 6 for a in ATTRS})


@register("age_curve", with_panel(f"""
SELECT position, age, {S('avg(gross_annual_eur)', 4)} AS mean_salary FROM scored GROUP BY 1, 2"""))
def q_age_curve(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.age_curve(c.scored, c.spec), {"mean_salary": 4})


@register("rolling_mean_3", with_panel(f"""
, curve AS (SELECT position, age, avg(gross_annual_eur) AS mean_salary FROM scored GROUP BY 1, 2)
SELECT position, age, {S('mean_salary', 4)} AS mean_salary, {S('rolling_mean', 4)} AS rolling_mean FROM (
  SELECT *, avg(mean_salary) OVER (PARTITION BY position ORDER BY age ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS rolling_mean,
         count(*) OVER (PARTITION BY position) AS n FROM curve) WHERE n >= 3"""))
def q_rolling(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    curve = A.age_curve(c.scored, c.spec)
    return _snap_cols(A.rolling_mean_3(curve, "position", "age", "mean_salary"),
                      {"mean_salary": 4, "rolling_mean": 4})


@register("within_pct", with_panel(f"""
SELECT {S("avg(CASE WHEN abs(predicted_center_eur - gross_annual_eur) / gross_annual_eur <= 0.3 THEN 1.0 ELSE 0.0 END) * 100", 6)} AS within_pct,
       count(*) AS n FROM scored WHERE gross_annual_eur > 0"""))
def q_within(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.within_pct(c.scored, "predicted_center_eur", "gross_annual_eur"), {"within_pct": 6})


@register("range_accuracy", with_panel(f"""
SELECT {S("avg(CASE WHEN range_accuracy_result THEN 1.0 ELSE 0.0 END) * 100", 6)} AS range_accuracy_pct,
       count(*) AS n FROM scored WHERE gross_annual_eur IS NOT NULL AND predicted_low_eur IS NOT NULL"""))
def q_range_acc(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.range_accuracy(c.scored, c.spec), {"range_accuracy_pct": 6})


@register("range_check", with_panel("""
SELECT player_pk, range_accuracy_result AS range_ok,
       round_even(CASE WHEN gross_annual_eur <= 0 THEN 1.0
            WHEN gross_annual_eur >= predicted_low_eur AND gross_annual_eur <= predicted_high_eur THEN 0.0
            WHEN gross_annual_eur < predicted_low_eur THEN (predicted_low_eur - gross_annual_eur) / gross_annual_eur
            ELSE (gross_annual_eur - predicted_high_eur) / gross_annual_eur END * 100, 1) AS range_dist_pct
FROM scored"""))
def q_range_check(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return A.range_check(c.scored, c.spec).select("player_pk", "range_ok", "range_dist_pct")


@register("reg_metrics", with_panel(f"""
, yb AS (SELECT avg(ln(1 + gross_annual_eur)) AS ybar FROM scored)
SELECT {S("1.0 - sum(power(ln(1 + gross_annual_eur) - ln(1 + predicted_center_eur), 2)) / sum(power(ln(1 + gross_annual_eur) - ybar, 2))", 9)} AS r2_log,
       {S('avg(abs(predicted_center_eur - gross_annual_eur))', 4)} AS mae,
       {S('sqrt(avg(power(predicted_center_eur - gross_annual_eur, 2)))', 4)} AS rmse, count(*) AS n
FROM scored, yb"""))
def q_reg_metrics(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.reg_metrics(c.scored, "predicted_center_eur", "gross_annual_eur"),
                      {"r2_log": 9, "mae": 4, "rmse": 4})


@register("mape", with_panel(f"""
SELECT {S('avg(abs(predicted_center_eur - gross_annual_eur) / gross_annual_eur * 100)', 6)} AS mape, count(*) AS n,
       {S('quantile_cont(abs(predicted_center_eur - gross_annual_eur) / gross_annual_eur * 100, 0.5)', 6)} AS median_ape
FROM scored WHERE gross_annual_eur > 50000"""))
def q_mape(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.mape(c.scored, "predicted_center_eur", "gross_annual_eur", 50000),
                      {"mape": 6, "median_ape": 6})


@register("mape_by_split", with_panel(f"""
SELECT {SPLIT_SQL} AS split, {S('avg(abs(predicted_center_eur - gross_annual_eur) / gross_annual_eur * 100)', 6)} AS mape, count(*) AS n,
       {S('quantile_cont(abs(predicted_center_eur - gross_annual_eur) / gross_annual_eur * 100, 0.5)', 6)} AS median_ape
FROM scored WHERE gross_annual_eur > 50000 GROUP BY 1"""))
def q_mape_by_split(spark, sf_dir):
    from fairband.operators.features import train_test_split
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.mape(train_test_split(c.scored, "player_pk"), "predicted_center_eur", "gross_annual_eur", 50000, "split"),
                      {"mape": 6, "median_ape": 6})


@register("overpaid_reduction", with_panel(f"""
SELECT count(*) AS n_overpaid, {S('sum(gross_annual_eur)', 2)} AS sum_actual,
       {S('sum(predicted_center_eur)', 2)} AS sum_center,
       {S('CASE WHEN sum(gross_annual_eur) > 0 THEN (sum(gross_annual_eur) - sum(predicted_center_eur)) / sum(gross_annual_eur) ELSE 0.0 END * 100', 6)} AS total_reduction_pct,
       {S('quantile_cont((gross_annual_eur - predicted_center_eur) / gross_annual_eur * 100, 0.5)', 6)} AS median_reduction_pct
FROM scored WHERE gross_annual_eur > predicted_high_eur"""))
def q_overpaid_red(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.overpaid_reduction(c.scored, c.spec),
                      {"sum_actual": 2, "sum_center": 2, "total_reduction_pct": 6, "median_reduction_pct": 6})


@register("residual_std", with_panel(f"""
SELECT {S('stddev_pop(ln(1 + gross_annual_eur) - ln(1 + predicted_center_eur))', 9)} AS residual_std FROM scored"""))
def q_residual_std(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.residual_std(c.scored, "predicted_center_eur", "gross_annual_eur"), {"residual_std": 9})


@register("residuals", with_panel(f"""
SELECT league_name, {S('avg((predicted_center_eur - gross_annual_eur) / gross_annual_eur * 100)', 6)} AS mean_residual_pct,
       count(*) AS n FROM scored WHERE gross_annual_eur > 0 GROUP BY 1"""))
def q_residuals(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.residuals_by_group(c.scored, "league_name", "predicted_center_eur", "gross_annual_eur"),
                      {"mean_residual_pct": 6})


@register("percentile_rank", with_panel("""
SELECT player_pk, round_even(cume_dist() OVER (ORDER BY gross_annual_eur) * 100, 1) AS percentile_rank FROM scored"""))
def q_percentile_rank(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return A.percentile_rank(c.scored, "gross_annual_eur").select("player_pk", "percentile_rank")


@register("spearman", with_panel(f"""
SELECT {S('corr(rx, ry)', 9)} AS spearman, count(*) AS n FROM (
  SELECT rank() OVER (ORDER BY gross_annual_eur) + (count(*) OVER (PARTITION BY gross_annual_eur) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY minutes) + (count(*) OVER (PARTITION BY minutes) - 1) / 2.0 AS ry
  FROM scored WHERE gross_annual_eur IS NOT NULL AND minutes IS NOT NULL)"""))
def q_spearman(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.spearman(c.scored, "gross_annual_eur", "minutes"), {"spearman": 9})


NUMS = ["age", "overall", "international_reputation", "value_eur", "appearances", "minutes",
        "goals", "assists", "rating", "market_value_eur"]


# every numeric column of the modelling table but the target
NUMERIC = ["player_pk", "api_football_id", "age", "overall", "international_reputation", "value_eur", "season", "appearances",
           "minutes", "goals", "assists", "rating", "market_value_eur"]


@register("corr_to_target", with_panel(
    "SELECT feature, " + S("corr", 9) + " AS corr, " + S("abs(corr)", 9) + " AS abs_corr FROM (SELECT unnest(["
    + ", ".join(f"'{n}'" for n in NUMERIC) + "]) AS feature, unnest(["
    + ", ".join(f"corr({n}, gross_annual_eur)" for n in NUMERIC) + "]) AS corr FROM trained) WHERE corr IS NOT NULL AND NOT isnan(corr)"))
def q_corr_target(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    columns = [n for n in numeric_columns(c.trained) if n != "gross_annual_eur"]
    return _snap_cols(A.corr_to_target(c.trained, columns, "gross_annual_eur"), {"corr": 9, "abs_corr": 9})


# the target and every measure the domain view has; it lacks potential, wage, pace, shooting, passing, dribbling, defending and physique
KEYF = [*NUMS, "gross_annual_eur"]
_PAIRS = [(a, b) for i, a in enumerate(KEYF) for b in KEYF[i + 1:]]


@register("corr_matrix", with_panel(
    "SELECT feature_a, feature_b, " + S("corr", 9) + " AS corr FROM (SELECT unnest(["
    + ", ".join(f"'{a}'" for a, _ in _PAIRS) + "]) AS feature_a, unnest(["
    + ", ".join(f"'{b}'" for _, b in _PAIRS) + "]) AS feature_b, unnest(["
    + ", ".join(f"corr({a}, {b})" for a, b in _PAIRS) + "]) AS corr FROM scored)"))
def q_corr_matrix(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.corr_matrix(c.scored, KEYF), {"corr": 9})


@register("performance_index", with_panel(f"""
, b AS (SELECT player_pk, rating, overall,
        CASE WHEN minutes > 0 THEN goals / (minutes / 90.0) ELSE 0.0 END AS g90,
        CASE WHEN minutes > 0 THEN assists / (minutes / 90.0) ELSE 0.0 END AS a90 FROM scored),
m AS (SELECT min(rating) r0, max(rating) r1, min(overall) o0, max(overall) o1, min(g90) g0, max(g90) g1,
             min(a90) a0, max(a90) a1 FROM b)
SELECT player_pk, {S('''((CASE WHEN r1 > r0 THEN (rating - r0) / (r1 - r0) ELSE 0.0 END
    + CASE WHEN o1 > o0 THEN (overall - o0) / (o1 - o0) ELSE 0.0 END)
    + CASE WHEN g1 > g0 THEN (g90 - g0) / (g1 - g0) ELSE 0.0 END)
    + CASE WHEN a1 > a0 THEN (a90 - a0) / (a1 - a0) ELSE 0.0 END''', 9)} / 4 AS performance_index FROM b, m"""))
def q_performance_index(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    b = c.scored.select("player_pk", "rating", "overall", per_90("goals", "minutes").alias("g90"),
                        per_90("assists", "minutes").alias("a90"))
    out = A.performance_index(b, ["rating", "overall", "g90", "a90"])
    return out.select("player_pk", (snap(F.col("performance_index") * 4, 9) / 4).alias("performance_index"))


@register("feature_stats", with_panel(
    "SELECT feature, " + S("mean", 6) + " AS mean, " + S("CASE WHEN std = 0 THEN 1.0 ELSE std END", 6)
    + " AS std FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in NUMS) + "]) AS feature, unnest(["
    + ", ".join(f"avg({n})" for n in NUMS) + "]) AS mean, unnest(["
    + ", ".join(f"stddev_pop({n})" for n in NUMS) + "]) AS std FROM trained)"))
def q_feature_stats(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.feature_stats(c.trained, NUMS), {"mean": 6, "std": 6})


def _hist_sql(expr, bins, src):
    return with_panel(f"""
, hb AS (SELECT {expr} AS v FROM {src} WHERE {expr} IS NOT NULL),
mm AS (SELECT min(v) AS mn, max(v) AS mx FROM hb)
SELECT bin, count(*) AS n, {S('any_value(mn + (mx - mn) * (bin - 1) / ' + str(bins) + ')', 6)} AS lo,
       {S('any_value(mn + (mx - mn) * bin / ' + str(bins) + ')', 6)} AS hi
FROM (SELECT CASE WHEN mx > mn THEN least(CAST(floor((v - mn) / (mx - mn) * {bins}) AS BIGINT) + 1, {bins})
                  ELSE 1 END AS bin, mn, mx FROM hb, mm) GROUP BY bin""")


@register("histogram", _hist_sql("gross_annual_eur", 30, "trained"))
def q_histogram(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.histogram(c.trained, "gross_annual_eur", 30), {"lo": 6, "hi": 6})


@register("log_histogram", _hist_sql("ln(1 + gross_annual_eur)", 40, "trained"))
def q_log_histogram(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.histogram(c.trained, F.log1p("gross_annual_eur"), 40), {"lo": 6, "hi": 6})


@register("box_stats", with_panel(f"""
, q AS (SELECT position, quantile_cont(gross_annual_eur, 0.25) AS q1, quantile_cont(gross_annual_eur, 0.5) AS median,
               quantile_cont(gross_annual_eur, 0.75) AS q3 FROM scored WHERE gross_annual_eur IS NOT NULL GROUP BY 1)
SELECT s.position, {S('q.q1', 4)} AS q1, {S('q.median', 4)} AS median, {S('q.q3', 4)} AS q3,
       {S('min(CASE WHEN gross_annual_eur >= q1 - 1.5 * (q3 - q1) THEN gross_annual_eur END)', 4)} AS whisker_lo,
       {S('max(CASE WHEN gross_annual_eur <= q3 + 1.5 * (q3 - q1) THEN gross_annual_eur END)', 4)} AS whisker_hi,
       count(*) FILTER (WHERE gross_annual_eur < q1 - 1.5 * (q3 - q1) OR gross_annual_eur > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM scored s JOIN q ON s.position = q.position WHERE gross_annual_eur IS NOT NULL GROUP BY s.position, q.q1, q.median, q.q3"""))
def q_box(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.box_stats(c.scored, "position", "gross_annual_eur"),
                      {"q1": 4, "median": 4, "q3": 4, "whisker_lo": 4, "whisker_hi": 4})


@register("violin_density", with_panel(f"""
, base AS (SELECT position, gross_annual_eur AS v FROM scored WHERE gross_annual_eur IS NOT NULL),
g AS (SELECT min(v) AS mn, max(v) AS mx, stddev_samp(v) AS sd, count(*) AS n FROM base),
binned AS (SELECT position, least(floor((v - mn) / CASE WHEN (mx - mn) / 200 > 0 THEN (mx - mn) / 200 ELSE 1.0 END), 199) AS b,
                  count(*) AS c FROM base, g GROUP BY 1, 2),
pts AS (SELECT position, b, c, gi, mn + (mx - mn) * gi / 49 AS x, mn + (b + 0.5) * ((mx - mn) / 200) AS center,
               1.06 * sd * pow(n, -0.2) AS h FROM binned, g, range(0, 50) t(gi)),
dens AS (SELECT position, gi, x, sum(c * (exp(-0.5 * pow((x - center) / h, 2)) / (h * sqrt(2 * 3.141592653589793)))) AS s
         FROM pts GROUP BY 1, 2, 3),
tot AS (SELECT position, sum(c) AS t FROM binned GROUP BY 1)
SELECT d.position, CAST(gi AS INTEGER) AS grid_index, {S('x', 6)} AS x, {S('s / t', 15)} AS density
FROM dens d JOIN tot USING (position)"""))
def q_violin(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.violin_density(c.scored, "position", "gross_annual_eur"), {"x": 6, "density": 15})


@register("cumulative_accuracy", with_panel(f"""
, tot AS (SELECT count(*) AS n FROM scored WHERE prediction_error_pct IS NOT NULL)
SELECT t, {S('100.0 * (SELECT count(*) FROM scored WHERE abs(prediction_error_pct) <= t) / n', 6)} AS pct_within
FROM range(0, 101) r(t), tot"""))
def q_cum_acc(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.cumulative_accuracy(c.scored, "prediction_error_pct"), {"pct_within": 6})


@register("tolerance_curve", with_panel(f"""
, d AS (SELECT CASE WHEN gross_annual_eur <= 0 THEN 1.0
            WHEN gross_annual_eur >= predicted_low_eur AND gross_annual_eur <= predicted_high_eur THEN 0.0
            WHEN gross_annual_eur < predicted_low_eur THEN (predicted_low_eur - gross_annual_eur) / gross_annual_eur
            ELSE (gross_annual_eur - predicted_high_eur) / gross_annual_eur END AS d
        FROM scored WHERE gross_annual_eur IS NOT NULL AND predicted_low_eur IS NOT NULL)
SELECT {S('i * 0.05', 6)} AS tolerance, {S('100.0 * (SELECT count(*) FROM d WHERE d <= i * 0.05 + 1e-12) / (SELECT count(*) FROM d)', 6)} AS range_accuracy_pct
FROM range(0, 11) r(i)"""))
def q_tol_curve(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _snap_cols(A.tolerance_curve(c.scored, c.spec), {"tolerance": 6, "range_accuracy_pct": 6})


@register("systematic_sample", with_panel("""
, n AS (SELECT greatest(1, floor(count(*) / 80)) AS step FROM scored)
SELECT player_pk FROM (SELECT player_pk, row_number() OVER (ORDER BY gross_annual_eur, player_pk) - 1 AS rn FROM scored), n
WHERE rn % step = 0"""))
def q_sys_sample(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return A.systematic_sample(c.scored, "gross_annual_eur", "player_pk").select("player_pk")


@register("distinct_sorted", with_panel("""
SELECT DISTINCT league_name FROM combined WHERE league_name IS NOT NULL"""))
def q_distinct(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return A.distinct_sorted(c.combined, "league_name")


@register("missing_count", with_panel(
    "SELECT column_name, n_missing FROM (SELECT unnest([" + ", ".join(
        f"'{n}'" for n in ["player_pk", "api_football_id", "short_name", "nationality", "season",
                           "appearances", "market_value_eur", "gross_annual_eur", "preferred_foot"])
    + "]) AS column_name, unnest([" + ", ".join(
        f"count(*) FILTER (WHERE {n} IS NULL)" for n in
        ["player_pk", "api_football_id", "short_name", "nationality", "season", "appearances",
         "market_value_eur", "gross_annual_eur", "preferred_foot"]) + "]) AS n_missing FROM panel)"))
def q_missing(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    cols = ["player_pk", "api_football_id", "short_name", "nationality", "season", "appearances",
            "market_value_eur", "gross_annual_eur", "preferred_foot"]
    return A.missing_count(c.panel.select(*cols))


@register("avg_rank", with_panel("""
SELECT player_pk, rank() OVER (ORDER BY minutes) + (count(*) OVER (PARTITION BY minutes) - 1) / 2.0 AS minutes_rank
FROM trained WHERE minutes IS NOT NULL"""))
def q_avg_rank(spark, sf_dir):
    """``avg_rank``: ties share the average 1-based rank (distributed rank table)."""
    c = Ctx(spark, sf_dir)
    return A.average_rank(c.trained.filter(F.col("minutes").isNotNull()), "minutes", "minutes_rank") \
        .select("player_pk", "minutes_rank")


@register("first_best", with_panel("""
SELECT league_name, player_pk, overall FROM (
  SELECT league_name, player_pk, overall,
         row_number() OVER (PARTITION BY league_name ORDER BY overall DESC NULLS LAST, player_pk) AS rn
  FROM panel) WHERE rn = 1"""))
def q_first_best(spark, sf_dir):
    """``first_best``: per group the highest metric; the lowest ordinal (key) wins ties."""
    from fairband.operators.panel import first_best
    c = Ctx(spark, sf_dir)
    return first_best(c.panel, ["league_name"], "overall", "player_pk").select("league_name", "player_pk", "overall")


_NUMERIC = ["player_pk", "api_football_id", "age", "overall", "international_reputation", "value_eur",
            "season", "appearances", "minutes", "goals", "assists", "rating", "market_value_eur",
            "gross_annual_eur"]


@register("numeric_columns", with_panel(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n_values FROM panel" for c in _NUMERIC)))
def q_numeric_columns(spark, sf_dir):
    """``numeric_columns``: the numeric fields of the panel (chosen from the schema) with
    their non-null counts in one aggregate."""
    from fairband.operators.panel import numeric_columns
    c = Ctx(spark, sf_dir)
    cols = numeric_columns(c.panel)
    wide = c.panel.agg(*[F.count(x).alias(x) for x in cols])
    stack = ", ".join(f"'{x}', `{x}`" for x in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, n_values)")


@register("scalar_functions", with_panel(f"""
SELECT player_pk,
       'EUR ' || format('{{:,.0f}}', gross_annual_eur) AS salary_display,
       'EUR ' || format('{{:,.0f}}', predicted_low_eur) || ' - EUR ' || format('{{:,.0f}}', predicted_high_eur) AS range_display,
       CASE WHEN predicted_center_eur > 0
            THEN round_even((predicted_high_eur - predicted_low_eur) / predicted_center_eur * 100, 1) ELSE 0.0 END AS range_width_pct,
       round_even(1.0 / (1.0 + rating), 3) AS similarity_score,
       {S('least(greatest(prediction_error_pct, 0.0), 200.0)', 6)} AS clipped_error_pct,
       coalesce(CASE league_name WHEN 'PROMO' THEN 'PROMOTIONAL' END, league_name) AS league_alias,
       CASE upper(trim(split_part(player_positions, ',', 1)))
            WHEN 'GK' THEN 'Goalkeeper' WHEN 'CB' THEN 'Defender' WHEN 'LB' THEN 'Defender'
            WHEN 'CM' THEN 'Midfielder' WHEN 'CAM' THEN 'Midfielder' WHEN 'RW' THEN 'Attacker'
            WHEN 'ST' THEN 'Attacker' END AS mapped_position,
       trim(split_part(player_positions, ',', 1)) || ' and ' || trim(split_part(player_positions, ',', 2)) AS roles,
       'aged ' || CAST(CAST(age AS INTEGER) AS VARCHAR) || ' (' || CASE WHEN age <= 23 THEN 'learning the trade'
            WHEN age <= 26 THEN 'best seasons to come' WHEN age <= 30 THEN 'at full strength'
            WHEN age <= 33 THEN 'many seasons played' ELSE 'late career' END || ')' AS age_phrase,
       CASE WHEN rating * 10 >= 85 THEN 'top-tier rating' WHEN rating * 10 >= 80 THEN 'strong rating'
            WHEN rating * 10 >= 75 THEN 'sound rating' END AS overall_phrase,
       CASE WHEN coalesce(international_reputation, 0) >= 5 THEN 'known worldwide'
            WHEN coalesce(international_reputation, 0) >= 4 THEN 'known abroad'
            WHEN coalesce(international_reputation, 0) >= 3 THEN 'known outside the home league'
            WHEN coalesce(international_reputation, 0) >= 2 THEN 'known at home'
            ELSE 'little known' END AS reputation_phrase,
       trim(split_part(player_positions, ',', 1)) || ' or ' || trim(split_part(player_positions, ',', 2)) AS either_role,
       'a, b and c' AS three_traits, 'x and y' AS two_tags,
       'peer_range:36' AS model_version
FROM scored"""))
def q_scalar_functions(spark, sf_dir):
    """§2.8 scalar helpers evaluated over every scored row."""
    from fairband.functions import scalar as SC
    c = Ctx(spark, sf_dir)
    s = c.scored
    return s.select(
        "player_pk",
        SC.fmt_eur("gross_annual_eur").alias("salary_display"),
        SC.range_display("predicted_low_eur", "predicted_high_eur").alias("range_display"),
        SC.range_width_pct("predicted_low_eur", "predicted_high_eur", "predicted_center_eur").alias("range_width_pct"),
        SC.similarity_score("rating").alias("similarity_score"),
        snap(SC.clip("prediction_error_pct", 0.0, 200.0), 6).alias("clipped_error_pct"),
        SC.league_alias("league_name", {"PROMO": "PROMOTIONAL"}).alias("league_alias"),
        SC.map_position("player_positions").alias("mapped_position"),
        SC.list_phrase("player_positions").alias("roles"),
        SC.list_phrase("player_positions", last="or").alias("either_role"),
        SC.list_phrase(F.lit("a, b,c ,d"), limit=3).alias("three_traits"),
        SC.list_phrase(F.lit("#x, #y, #z"), limit=2, strip="#").alias("two_tags"),
        SC.age_phrase("age").alias("age_phrase"),
        SC.overall_phrase(F.col("rating") * 10).alias("overall_phrase"),
        SC.reputation_phrase("international_reputation").alias("reputation_phrase"),
        SC.model_version("peer_range", 36).alias("model_version"))


@register("cume_rank", with_panel("""
SELECT player_pk, round_even(cume_dist() OVER (ORDER BY market_value_eur) * 100, 1) AS market_cume_pct
FROM panel WHERE market_value_eur IS NOT NULL"""))
def q_cume_rank(spark, sf_dir):
    """``cume_rank``: share of rows at or below each value (distributed prefix sums)."""
    c = Ctx(spark, sf_dir)
    base = c.panel.filter(F.col("market_value_eur").isNotNull())
    return A.percentile_rank(base, "market_value_eur", "market_cume_pct").select("player_pk", "market_cume_pct")


@register("latest_per_key", with_panel(f"""
SELECT player_pk, season, {S('rating', 6)} AS rating FROM latest"""))
def q_latest_per_key(spark, sf_dir):
    """``latest_per_key``: newest season per entity (row_number = 1, NULL seasons last)."""
    from fairband.operators.panel import latest_per_key
    c = Ctx(spark, sf_dir)
    out = latest_per_key(c.tables.stats, "player_pk", "season")
    return out.select("player_pk", "season", snap("rating", 6).alias("rating"))


@register("scalar_transforms", with_panel(f"""
SELECT player_pk,
       {S('ln(1 + value_eur)', 6)} AS log_value,
       {S('exp(ln(1 + value_eur)) - 1', 4)} AS value_back,
       CASE WHEN overall > 0 THEN value_eur / overall ELSE 0.0 END AS value_per_overall,
       CASE WHEN minutes > 0 THEN goals / (minutes / 90.0) ELSE 0.0 END AS goals_per_90,
       age * age AS age_squared, overall * international_reputation AS overall_x_reputation,
       CASE WHEN market_value_eur IS NULL OR isnan(market_value_eur) OR abs(market_value_eur) = 'inf'::DOUBLE
            THEN 0.0 ELSE market_value_eur END AS market_filled,
       coalesce(nullif(international_reputation, 0), 1.0) AS level_or_one,
       {S('CASE WHEN gross_annual_eur > 0 THEN (predicted_center_eur - gross_annual_eur) / gross_annual_eur * 100 ELSE 0.0 END', 6)} AS signed_error_pct,
       {S('CASE WHEN gross_annual_eur > 0 THEN abs(gross_annual_eur - predicted_center_eur) / gross_annual_eur * 100 END', 6)} AS abs_error_pct,
       gross_annual_eur >= predicted_low_eur AND gross_annual_eur <= predicted_high_eur AS in_range,
       round_even(overall, 0) AS overall_rounded,
       CASE WHEN position = 'Attacker' THEN 'playing in attack' ELSE replace(lower(position) || '_role', '_', ' ') END AS position_label
FROM scored"""))
def q_scalar_transforms(spark, sf_dir):
    """§2.8 numeric helpers: log1p/expm1, safe ratio, per 90, square, product, inf/NaN -> 0,
    coalesce default, error percentages, in-range, banker's rounding, display names."""
    from fairband.functions import scalar as SC
    c = Ctx(spark, sf_dir)
    s = c.scored
    return s.select(
        "player_pk",
        snap(F.log1p("value_eur"), 6).alias("log_value"),
        snap(F.expm1(F.log1p("value_eur")), 4).alias("value_back"),
        SC.safe_ratio("value_eur", "overall").alias("value_per_overall"),
        SC.per_90("goals", "minutes").alias("goals_per_90"),
        (F.col("age") * F.col("age")).alias("age_squared"),
        (F.col("overall") * F.col("international_reputation")).alias("overall_x_reputation"),
        SC.inf_nan_to_zero("market_value_eur").alias("market_filled"),
        F.coalesce(F.nullif(F.col("international_reputation"), F.lit(0)), F.lit(1.0)).alias("level_or_one"),
        snap(SC.signed_error_pct("predicted_center_eur", "gross_annual_eur"), 6).alias("signed_error_pct"),
        snap(SC.abs_error_pct("gross_annual_eur", "predicted_center_eur"), 6).alias("abs_error_pct"),
        SC.in_range("gross_annual_eur", "predicted_low_eur", "predicted_high_eur").alias("in_range"),
        SC.round_half_even("overall", 0).alias("overall_rounded"),
        SC.humanize_name(F.concat(F.lower("position"), F.lit("_role")),
                         {"attacker_role": "playing in attack"}).alias("position_label"))
