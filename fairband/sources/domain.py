"""Domain view of the TPC-H-like test tables (entity = part).

One lineitem scan feeds every activity-derived table: a partial/final
aggregate per (part, season) with map-side combine, then small per-part
rollups over that result.  At 100 TB the only large shuffle is the
(part, season) aggregate, whose output is #parts x #seasons rows.

Role mapping (fixed values of this adapter):
  player_pk = p_partkey, short_name = p_name, long_name = p_name || ' ' || p_brand,
  club_name = p_brand, league_name = p_type, age = p_size, overall = p_retailprice,
  international_reputation = 1 + (brand number - 1) div 5, value_eur = p_retailprice * 1000,
  player_positions = '<code of the last name word>, <first name word upper-cased>',
  preferred_foot = NULL if p_retailprice >= 990, 'Left' if p_size <= 12, else 'Right',
  season stats = lineitem per (l_partkey, year(l_shipdate)): appearances = rows,
  minutes = sum(l_quantity), goals = rows with flag 'R', assists = rows with flag 'A',
  rating = 100 * mean(l_discount),
  salary (target) = mean l_extendedprice of lines shipped on/after CURRENT_FROM,
  market value = max l_extendedprice of 'R' lines shipped on/after MARKET_FROM,
  identity bridge = min(l_suppkey) -> supplier -> nation (nationality).
Means of money are computed from exact integer-cent sums (LONG, order
independent) so every engine gets the same double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairband.sources.tables import read_table

CURRENT_FROM = "2001-01-01"
MARKET_FROM = "2000-01-01"

# Fixed values of this adapter: last word of the part name -> position code.
NOUN_CODES = {
    "anvil": "GK", "bolt": "CB", "gear": "CM", "gizmo": "CAM",
    "plate": "LB", "ring": "ST", "rod": "RW", "widget": "WG",
}


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


def _cents(c: str):
    """Exact cents of a 2-decimal amount as LONG: floor(x * 100 + 0.5)."""
    return F.floor(F.col(c) * F.lit(100.0) + F.lit(0.5))


def _cent_mean(cents: str, n: str):
    return F.col(cents).cast("double") / F.lit(100.0) / F.col(n)


def lineitem_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (part, season) with every activity measure the domain needs."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                     "l_discount", "l_returnflag", "l_shipdate"])
    cur = F.col("l_shipdate") >= _ts(CURRENT_FROM)
    mkt = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= _ts(MARKET_FROM))
    return (li.groupBy(F.col("l_partkey").alias("player_pk"),
                       F.year("l_shipdate").alias("season"))
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum("l_quantity").alias("minutes"),
                 F.count_if(F.col("l_returnflag") == "R").alias("n_goals"),
                 F.count_if(F.col("l_returnflag") == "A").alias("n_assists"),
                 F.sum(_cents("l_discount")).alias("discount_cents"),
                 F.sum(F.when(cur, _cents("l_extendedprice"))).alias("pay_cents"),
                 F.count_if(cur).alias("pay_n"),
                 F.max(F.when(mkt, F.col("l_extendedprice"))).alias("market_max"),
                 F.min("l_suppkey").alias("min_suppkey")))


def player_stats(seasons: DataFrame) -> DataFrame:
    """``player_stats`` role: one row per entity x season."""
    return seasons.select(
        "player_pk", "season",
        F.col("n_rows").cast("double").alias("appearances"),
        F.col("minutes"),
        F.col("n_goals").cast("double").alias("goals"),
        F.col("n_assists").cast("double").alias("assists"),
        (F.col("discount_cents").cast("double") / F.col("n_rows")).alias("rating"),
    )


def part_rollup(seasons: DataFrame) -> DataFrame:
    """Per-entity rollup of the season table (salary, market value, identity bridge)."""
    g = seasons.groupBy("player_pk").agg(
        F.sum("pay_cents").alias("pay_cents"), F.sum("pay_n").alias("pay_n"),
        F.max("market_max").alias("market_value_eur"),
        F.min("min_suppkey").alias("api_football_id"))
    return g.select(
        "player_pk", "market_value_eur", "api_football_id",
        F.when(F.col("pay_n") > 0, _cent_mean("pay_cents", "pay_n")).alias("gross_annual_eur"))


def salaries(rollup: DataFrame) -> DataFrame:
    return rollup.filter(F.col("gross_annual_eur").isNotNull()).select("player_pk", "gross_annual_eur")


def market_values(rollup: DataFrame) -> DataFrame:
    return rollup.filter(F.col("market_value_eur").isNotNull()).select("player_pk", "market_value_eur")


def identity(spark: SparkSession, sf_dir: str, rollup: DataFrame) -> DataFrame:
    """``player_identity`` role: entity -> source id -> nationality (two small dims)."""
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    nat = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    return (rollup.select("player_pk", "api_football_id")
            .join(sup, F.col("api_football_id") == F.col("s_suppkey"), "left")
            .join(nat, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select("player_pk", "api_football_id", F.col("n_name").alias("nationality")))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sofifa_attributes`` role from ``part``."""
    p = read_table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    noun = F.element_at(words, -1)
    code = F.coalesce(F.try_element_at(_noun_map(), noun), F.upper(noun))
    brand_no = F.split("p_brand", "#").getItem(1).cast("int")
    return p.select(
        F.col("p_partkey").alias("player_pk"),
        F.col("p_name").alias("short_name"),
        F.concat_ws(" ", "p_name", "p_brand").alias("long_name"),
        F.col("p_type").alias("league_name"),
        F.col("p_brand").alias("club_name"),
        F.concat(code, F.lit(", "), F.upper(F.element_at(words, 1))).alias("player_positions"),
        F.col("p_size").cast("double").alias("age"),
        F.col("p_retailprice").alias("overall"),
        (F.lit(1) + F.floor((brand_no - 1) / 5)).cast("double").alias("international_reputation"),
        (F.col("p_retailprice") * F.lit(1000.0)).alias("value_eur"),
        F.when(F.col("p_retailprice") >= 990, F.lit(None).cast("string"))
         .when(F.col("p_size") <= 12, F.lit("Left")).otherwise(F.lit("Right")).alias("preferred_foot"),
    )


def _noun_map():
    from fairband.functions.scalar import map_literal
    return map_literal(NOUN_CODES)


def activity(seasons: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything the panel needs from activity in ONE aggregate per entity: salary,
    market value, identity bridge and the latest season's stats (``max_by`` on the
    season, which is unique per entity, so the pick is deterministic)."""
    stats = seasons.withColumns({
        "appearances": F.col("n_rows").cast("double"), "goals": F.col("n_goals").cast("double"),
        "assists": F.col("n_assists").cast("double"),
        "rating": F.col("discount_cents").cast("double") / F.col("n_rows")})
    latest = F.max_by(F.struct(*[F.col(c) for c in ("season", "appearances", "minutes", "goals",
                                                       "assists", "rating")]), F.col("season"))
    g = (stats.groupBy("player_pk").agg(
        F.sum("pay_cents").alias("pay_cents"), F.sum("pay_n").alias("pay_n"),
        F.max("market_max").alias("market_value_eur"), F.min("min_suppkey").alias("api_football_id"),
        latest.alias("_l"), F.count(F.lit(1)).alias("n_seasons")))
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    nat = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    return (g.join(sup, F.col("api_football_id") == F.col("s_suppkey"), "left")
            .join(nat, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select("player_pk", "api_football_id", F.col("n_name").alias("nationality"),
                    *[F.col(f"_l.{c}").alias(c) for c in ("season", "appearances", "minutes", "goals",
                                                           "assists", "rating")],
                    "market_value_eur", "n_seasons",
                    F.when(F.col("pay_n") > 0, _cent_mean("pay_cents", "pay_n")).alias("gross_annual_eur")))


class DomainTables:
    """The four source tables of the reference plus the identity bridge, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.seasons = lineitem_seasons(spark, sf_dir)
        self.rollup = part_rollup(self.seasons)
        self.attributes = attributes(spark, sf_dir)
        self.stats = player_stats(self.seasons)
        self.salaries = salaries(self.rollup)
        self.market = market_values(self.rollup)
        self.identity = identity(spark, sf_dir, self.rollup)
        self.activity = activity(self.seasons, spark, sf_dir)


