"""DuckDB SQL twins of the registered queries (the correctness oracle).

The CTEs below restate the domain mapping of ``fairband.sources.domain`` in
SQL.  Money means come from exact integer-cent sums and every floating output is
snapped with ``floor(x * 10^d + 0.5) / 10^d`` exactly as on the Spark side.
"""

from __future__ import annotations


def snap(expr: str, d: int = 6) -> str:
    return f"(floor(({expr}) * 1e{d} + 4.99876543e-1) / 1e{d})"


CURRENT_FROM = "TIMESTAMP '2001-01-01'"
MARKET_FROM = "TIMESTAMP '2000-01-01'"
LEAGUES = "('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'STANDARD')"

POSITION_SQL = """coalesce(CASE upper(trim(split_part(player_positions, ',', 1)))
      WHEN 'GK' THEN 'Goalkeeper'
      WHEN 'CB' THEN 'Defender' WHEN 'LB' THEN 'Defender' WHEN 'RB' THEN 'Defender'
      WHEN 'LWB' THEN 'Defender' WHEN 'RWB' THEN 'Defender'
      WHEN 'CDM' THEN 'Midfielder' WHEN 'CM' THEN 'Midfielder' WHEN 'CAM' THEN 'Midfielder'
      WHEN 'LM' THEN 'Midfielder' WHEN 'RM' THEN 'Midfielder'
      WHEN 'LW' THEN 'Attacker' WHEN 'RW' THEN 'Attacker' WHEN 'CF' THEN 'Attacker'
      WHEN 'ST' THEN 'Attacker' END, 'Midfielder')"""

PANEL_CTES = f"""
seasons AS (
  SELECT l_partkey AS player_pk, CAST(year(l_shipdate) AS INTEGER) AS season,
         count(*) AS n_rows, sum(l_quantity) AS minutes,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_goals,
         count(*) FILTER (WHERE l_returnflag = 'A') AS n_assists,
         sum(CAST(floor(l_discount * 100.0 + 0.5) AS BIGINT)) AS discount_cents,
         sum(CASE WHEN l_shipdate >= {CURRENT_FROM} THEN CAST(floor(l_extendedprice * 100.0 + 0.5) AS BIGINT) END) AS pay_cents,
         count(*) FILTER (WHERE l_shipdate >= {CURRENT_FROM}) AS pay_n,
         max(CASE WHEN l_returnflag = 'R' AND l_shipdate >= {MARKET_FROM} THEN l_extendedprice END) AS market_max,
         min(l_suppkey) AS min_suppkey
  FROM lineitem GROUP BY 1, 2),
stats AS (
  SELECT player_pk, season, CAST(n_rows AS DOUBLE) AS appearances, minutes,
         CAST(n_goals AS DOUBLE) AS goals, CAST(n_assists AS DOUBLE) AS assists,
         CAST(discount_cents AS DOUBLE) / n_rows AS rating
  FROM seasons),
prollup AS (
  SELECT player_pk, sum(pay_cents) AS pay_cents, sum(pay_n) AS pay_n,
         max(market_max) AS market_value_eur, min(min_suppkey) AS api_football_id
  FROM seasons GROUP BY 1),
salaries AS (
  SELECT player_pk, CAST(pay_cents AS DOUBLE) / 100.0 / pay_n AS gross_annual_eur FROM prollup WHERE pay_n > 0),
market AS (SELECT player_pk, market_value_eur FROM prollup WHERE market_value_eur IS NOT NULL),
ident AS (
  SELECT r.player_pk, r.api_football_id, n.n_name AS nationality
  FROM prollup r LEFT JOIN supplier s ON r.api_football_id = s.s_suppkey
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey),
attrs AS (
  SELECT p_partkey AS player_pk, p_name AS short_name, p_name || ' ' || p_brand AS long_name,
         p_type AS league_name, p_brand AS club_name,
         (CASE string_split(p_name, ' ')[-1]
            WHEN 'anvil' THEN 'GK' WHEN 'bolt' THEN 'CB' WHEN 'gear' THEN 'CM' WHEN 'gizmo' THEN 'CAM'
            WHEN 'plate' THEN 'LB' WHEN 'ring' THEN 'ST' WHEN 'rod' THEN 'RW' WHEN 'widget' THEN 'WG'
            ELSE upper(string_split(p_name, ' ')[-1]) END) || ', ' || upper(split_part(p_name, ' ', 1))
           AS player_positions,
         CAST(p_size AS DOUBLE) AS age, p_retailprice AS overall,
         CAST(1 + floor((CAST(split_part(p_brand, '#', 2) AS INTEGER) - 1) / 5) AS DOUBLE)
           AS international_reputation,
         p_retailprice * CAST(1000 AS DOUBLE) AS value_eur,
         CASE WHEN p_retailprice >= 990 THEN NULL WHEN p_size <= 12 THEN 'Left' ELSE 'Right' END
           AS preferred_foot
  FROM part),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY player_pk ORDER BY season DESC NULLS LAST) AS rn
    FROM stats) WHERE rn = 1),
panel AS (
  SELECT a.player_pk, i.api_football_id, a.short_name, a.long_name, a.league_name, a.club_name,
         i.nationality, a.player_positions, {POSITION_SQL} AS position,
         a.age, a.overall, a.international_reputation, a.value_eur, a.preferred_foot,
         l.season, l.appearances, l.minutes, l.goals, l.assists, l.rating,
         m.market_value_eur, s.gross_annual_eur
  FROM attrs a
  LEFT JOIN ident i ON a.player_pk = i.player_pk
  LEFT JOIN salaries s ON a.player_pk = s.player_pk
  LEFT JOIN latest l ON a.player_pk = l.player_pk
  LEFT JOIN market m ON a.player_pk = m.player_pk),
trained AS (
  SELECT * FROM panel
  WHERE gross_annual_eur > 0 AND appearances >= 2 AND league_name IN {LEAGUES}),
peer AS (
  SELECT league_name, position,
         quantile_cont(gross_annual_eur, 0.25) AS predicted_low_eur,
         quantile_cont(gross_annual_eur, 0.75) AS predicted_high_eur,
         (exp(avg(ln(1 + gross_annual_eur))) - 1) AS predicted_center_eur
  FROM trained GROUP BY 1, 2),
scored AS (
  SELECT t.*, p.predicted_low_eur, p.predicted_high_eur, p.predicted_center_eur,
         CASE WHEN t.gross_annual_eur > 0
              THEN (p.predicted_center_eur - t.gross_annual_eur) / t.gross_annual_eur * 100
              ELSE 0.0 END AS prediction_error_pct,
         coalesce(t.gross_annual_eur >= p.predicted_low_eur AND t.gross_annual_eur <= p.predicted_high_eur, false)
           AS actual_in_range,
         coalesce(CASE WHEN t.gross_annual_eur >= p.predicted_low_eur AND t.gross_annual_eur <= p.predicted_high_eur THEN true
                       WHEN t.gross_annual_eur <= 0 THEN false
                       WHEN t.gross_annual_eur < p.predicted_low_eur
                         THEN (p.predicted_low_eur - t.gross_annual_eur) / t.gross_annual_eur <= 0.3
                       ELSE (t.gross_annual_eur - p.predicted_high_eur) / t.gross_annual_eur <= 0.3 END, false)
           AS range_accuracy_result,
         CASE WHEN p.predicted_low_eur IS NULL OR p.predicted_high_eur IS NULL THEN 'prediction_not_available'
              WHEN t.gross_annual_eur IS NULL THEN 'unknown'
              WHEN t.gross_annual_eur > p.predicted_high_eur THEN 'overpaid'
              WHEN t.gross_annual_eur < p.predicted_low_eur THEN 'underpaid'
              ELSE 'fair' END AS status,
         true AS prediction_available
  FROM trained t LEFT JOIN peer p USING (league_name, position)),
untrained AS (
  SELECT p.*, CAST(NULL AS DOUBLE) AS predicted_low_eur, CAST(NULL AS DOUBLE) AS predicted_high_eur,
         CAST(NULL AS DOUBLE) AS predicted_center_eur, false AS prediction_available
  FROM panel p WHERE p.player_pk NOT IN (SELECT player_pk FROM trained)),
combined AS (
  SELECT * FROM scored
  UNION ALL BY NAME
  SELECT * FROM untrained),
cstat AS (
  SELECT * EXCLUDE (status),
         CASE WHEN NOT coalesce(prediction_available, true) OR predicted_low_eur IS NULL
                   OR predicted_high_eur IS NULL THEN 'prediction_not_available'
              WHEN gross_annual_eur IS NULL THEN 'unknown'
              WHEN gross_annual_eur > predicted_high_eur THEN 'overpaid'
              WHEN gross_annual_eur < predicted_low_eur THEN 'underpaid'
              ELSE 'fair' END AS status
  FROM combined)
"""


def with_panel(body: str) -> str:
    return "WITH " + PANEL_CTES.strip() + "\n" + body
