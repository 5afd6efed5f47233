"""Artifacts, exports, catalog audits and nested payload parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairband.session import scratch_path
from fairband.sources.tables import SCHEMAS, table_path

# Fixed values (must equal the reference): column-name terms that must not appear.
FORBIDDEN_TERMS = ("agent", "bonus", "image_right", "signing_fee", "loyalty")


def save_snapshot(df: DataFrame, name: str, partition_by=None) -> str:
    """``artifact_store`` (tables): write a parquet snapshot under the shared checkpoint dir."""
    path = scratch_path(df.sparkSession, f"snapshots/{name}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def metrics_sink(metrics: DataFrame, name: str) -> DataFrame:
    """Write a tidy ``(model, metric, value)`` table as JSON lines and read it back."""
    path = scratch_path(metrics.sparkSession, f"metrics/{name}")
    metrics.write.mode("overwrite").json(path)
    return metrics.sparkSession.read.schema(metrics.schema).json(path)


def title_case(name: str) -> str:
    return " ".join(w.capitalize() for w in name.split("_"))


def export_csv(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """``export_csv``: Title Case headers, CSV with header, one part file per task."""
    out = df.select(*[F.col(c).alias(title_case(c)) for c in df.columns])
    path = scratch_path(df.sparkSession, f"exports/{name}")
    out.write.mode("overwrite").option("header", True).csv(path)
    return path, out


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def roundtrip_consistency(original: DataFrame, reread: DataFrame, key: str, numeric_digits: int = 2) -> DataFrame:
    """% of rows whose every column equals after the round trip (numbers rounded, NULL-safe)."""
    cols = [c for c in original.columns if c != key]
    r = reread.select(key, *[F.col(c).alias(f"_r_{c}") for c in cols])
    j = original.join(r, key, "full_outer")
    eqs = []
    for f in original.schema.fields:
        if f.name == key:
            continue
        a, b = F.col(f.name), F.col(f"_r_{f.name}")
        if isinstance(f.dataType, T.NumericType):
            a, b = F.round(a.cast("double"), numeric_digits), F.round(b.cast("double"), numeric_digits)
        eqs.append(a.eqNullSafe(b))
    all_eq = eqs[0]
    for e in eqs[1:]:
        all_eq = all_eq & e
    return j.agg((F.avg(all_eq.cast("double")) * 100).alias("pct_equal"), F.count(F.lit(1)).alias("n"))


def catalog_audit(spark: SparkSession, sf_dir: str, tables=None) -> DataFrame:
    """Per table: rows, columns found in its files, columns that the declared schema lacks or
    that the files lack, and columns whose name holds a forbidden term."""
    from functools import reduce
    parts = []
    for t in tables or list(SCHEMAS):
        df = spark.read.parquet(table_path(sf_dir, t))  # the schema is that of the file footers
        found, declared = set(df.columns), set(SCHEMAS[t].fieldNames())
        bad = [n for n in found if any(term in n.lower() for term in FORBIDDEN_TERMS)]
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(t).alias("table_name"), "n_rows", F.lit(len(found)).alias("n_columns"),
            F.lit(len(found - declared)).alias("n_undeclared"), F.lit(len(declared - found)).alias("n_missing"),
            F.lit(len(bad)).alias("n_forbidden")))
    return reduce(lambda a, b: a.unionByName(b), parts)


PAYLOAD_SCHEMA = T.StructType([
    T.StructField("player", T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
        T.StructField("age", T.IntegerType()), T.StructField("nationality", T.StringType())])),
    T.StructField("statistics", T.ArrayType(T.StructType([
        T.StructField("games", T.StructType([
            T.StructField("appearances", T.IntegerType()), T.StructField("minutes", T.IntegerType()),
            T.StructField("rating", T.StringType()), T.StructField("position", T.StringType())])),
        T.StructField("goals", T.StructType([
            T.StructField("total", T.IntegerType()), T.StructField("assists", T.IntegerType())])),
        T.StructField("league", T.StructType([T.StructField("name", T.StringType())]))]))),
])


def build_payloads(panel: DataFrame, stats: DataFrame) -> DataFrame:
    """Nested JSON documents (player + one statistics block per season), built by Spark."""
    blocks = stats.groupBy("player_pk").agg(F.sort_array(F.collect_list(F.struct(
        F.col("season"),
        F.struct(F.col("appearances").cast("int").alias("appearances"),
                 F.col("minutes").cast("int").alias("minutes"),
                 F.format_number(F.col("rating"), 2).alias("rating"),
                 F.when(F.col("goals") > F.col("assists"), F.lit("Attacker"))
                 .when(F.col("minutes") >= 60, F.lit("Defender"))
                 .when(F.col("minutes") < 20, F.lit("Winger")).alias("position")).alias("games"),
        F.struct(F.col("goals").cast("int").alias("total"),
                 F.col("assists").cast("int").alias("assists")).alias("goals")))).alias("b"))
    doc = panel.select("player_pk", "short_name", "age", "nationality", "league_name").join(blocks, "player_pk")
    stat = F.transform("b", lambda s: F.struct(s["games"].alias("games"), s["goals"].alias("goals"),
                                                F.struct(F.col("league_name").alias("name")).alias("league")))
    return doc.select("player_pk", F.to_json(F.struct(
        F.struct(F.col("player_pk").alias("id"), F.col("short_name").alias("name"),
                 F.col("age").cast("int").alias("age"), F.col("nationality")).alias("player"),
        stat.alias("statistics"))).alias("payload"))


def json_payload_parse(docs: DataFrame, column: str = "payload") -> DataFrame:
    """``json_payload_parse``: from_json with a declared schema -> one row per block
    (``explode_outer`` keeps documents without blocks)."""
    p = docs.withColumn("_p", F.from_json(F.col(column), PAYLOAD_SCHEMA))
    return p.select(
        F.col("_p.player.id").alias("player_id"), F.col("_p.player.name").alias("name"),
        F.posexplode_outer("_p.statistics").alias("block_no", "_b")).select(
        "player_id", "name", "block_no",
        F.col("_b.games.appearances").alias("appearances"), F.col("_b.games.minutes").alias("minutes"),
        F.col("_b.games.rating").alias("rating"), F.col("_b.games.position").alias("position"),
        F.col("_b.goals.total").alias("goals"), F.col("_b.goals.assists").alias("assists"),
        F.col("_b.league.name").alias("league"))


# Fixed values (must equal the reference): positions that stay, all others become the default.
POSITIONS = ("Attacker", "Midfielder", "Defender", "Goalkeeper")


def statblock_rollup(blocks: DataFrame, default_position: str = "Midfielder", rating_digits: int = 2) -> DataFrame:
    """Per player: sums (NULL -> 0), unweighted mean of non-empty non-zero ratings rounded
    half-even to 2 (0.0 if none), appearances imputed as max(1, minutes/80 rounded half-even) when
    the sum is 0 but minutes > 0, position/league of the block with most appearances (first on
    ties; blocks without appearances do not count); an unknown position becomes the default."""
    # decimals: a mean that lies on a rounding step is rounded alike in every order of summation
    r = F.expr("try_cast(trim(rating) AS DECIMAL(18, 6))")
    good = F.when(r != 0, r)
    best = F.max_by(F.struct("position", "league"),
                    F.when(F.col("appearances") > 0, F.struct(F.col("appearances"), -F.col("block_no"))))
    g = blocks.groupBy("player_id").agg(
        F.sum(F.coalesce("appearances", F.lit(0))).alias("appearances"),
        F.sum(F.coalesce("minutes", F.lit(0))).alias("minutes"),
        F.sum(F.coalesce("goals", F.lit(0))).alias("goals"),
        F.sum(F.coalesce("assists", F.lit(0))).alias("assists"),
        (F.sum(good) / F.nullif(F.count(good), F.lit(0))).alias("_r"), best.alias("_best"))
    apps = F.when((F.col("appearances") == 0) & (F.col("minutes") > 0),
                  F.greatest(F.lit(1), F.bround(F.col("minutes") / 80.0).cast("long"))).otherwise(F.col("appearances"))
    return g.select("player_id", apps.alias("appearances"), "minutes", "goals", "assists",
                    F.coalesce(F.bround("_r", rating_digits).cast("double"), F.lit(0.0)).alias("rating"),
                    F.when(F.col("_best.position").isin(*POSITIONS), F.col("_best.position"))
                    .otherwise(F.lit(default_position)).alias("position"),
                    F.col("_best.league").alias("league"))


def season_rollup(stats: DataFrame, key: str = "player_pk") -> DataFrame:
    """Per entity: one row per season, newest first (``season_no`` from 1), with the season's
    appearances / minutes (NULL -> 0) and the entity's totals over all seasons."""
    from pyspark.sql import Window
    per = stats.groupBy(key, "season").agg(F.sum(F.coalesce("appearances", F.lit(0.0))).alias("appearances"),
                                           F.sum(F.coalesce("minutes", F.lit(0.0))).alias("minutes"))
    own = Window.partitionBy(key)  # an entity has one row per season
    return (per.withColumn("season_no", F.row_number().over(own.orderBy(F.col("season").desc_nulls_last())))
            .withColumn("n_seasons", F.count(F.lit(1)).over(own))
            .withColumn("total_appearances", F.sum("appearances").over(own))
            .withColumn("total_minutes", F.sum("minutes").over(own)))


# ---------------------------------------------------------------- request log (from events)

def request_log(events: DataFrame) -> DataFrame:
    """Request-log view of ``events``: endpoint = event_type, status from the payload's k,
    elapsed seconds = value / 10."""
    k = F.from_json(F.col("props"), "k INT")["k"]
    status = (F.when(F.col("event_type") == "error", F.when(k >= 50, F.lit(500)).otherwise(F.lit(404)))
              .when(k == 0, F.lit(0)).otherwise(F.lit(200)))
    return events.select(F.col("event_type").alias("endpoint"), status.alias("status"),
                         (F.col("value") / 10).alias("elapsed_s"), "ts")


def log_error_rollup(log: DataFrame) -> DataFrame:
    """Per endpoint and for all endpoints together (``endpoint`` NULL): count, 2xx, server errors
    (>= 500 or 0), client errors, exact p50/p95 ms, error rate over non-client requests."""
    from fairband.operators.quantiles import group_quantiles
    s = F.col("status")
    both = log.select(F.explode(F.array("endpoint", F.lit(None).cast("string"))).alias("endpoint"), "status",
                      (F.col("elapsed_s") * 1000).alias("_ms"))
    g = both.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((s >= 200) & (s < 300)).alias("n_success"),
        F.count_if((s >= 500) | (s == 0)).alias("n_server_error"),
        F.count_if((s >= 400) & (s < 500)).alias("n_client_error"))
    q = group_quantiles(both.withColumn("_all", F.col("endpoint").isNull())
                        .withColumn("_name", F.coalesce("endpoint", F.lit(""))), ["_all", "_name"], "_ms",
                        {"p50_ms": 0.5, "p95_ms": 0.95})
    out = g.join(q, (g["endpoint"].isNull() == q["_all"]) & (F.coalesce(g["endpoint"], F.lit("")) == q["_name"]), "left").drop("_all", "_name")
    den = F.col("n") - F.col("n_client_error")
    return out.withColumn("error_rate_pct", F.when(den > 0, F.col("n_server_error") / den * 100).otherwise(F.lit(0.0)))


def latency_summary(log: DataFrame, serial_s: float = 0.1) -> DataFrame:
    """Global mean / p95 / p99 latency, success rate, requests per second and a degraded flag."""
    from fairband.operators.quantiles import group_quantiles
    g = log.agg(F.count(F.lit(1)).alias("n"), F.avg("elapsed_s").alias("mean_s"),
                (F.avg(((F.col("status") >= 200) & (F.col("status") < 300)).cast("double")) * 100).alias("success_pct"),
                (F.unix_timestamp(F.max(F.col("ts").cast("timestamp")))
                 - F.unix_timestamp(F.min(F.col("ts").cast("timestamp")))).alias("_span"))
    q = group_quantiles(log, [], "elapsed_s", {"p95_s": 0.95, "p99_s": 0.99})
    from fairband.operators.analytics import attach_scalars
    out = attach_scalars(g, q)
    return (out.withColumn("qps", F.when(F.col("_span") > 0, F.col("n") / F.col("_span")))
            .withColumn("degraded", F.col("p95_s") > 5 * max(serial_s, 0.1)).drop("_span"))
