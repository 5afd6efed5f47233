"""Panel assembly: latest-per-key, left-join star, eligibility, trained/untrained views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from fairband.functions.scalar import (abs_error_pct, in_range, league_alias, nan_to_null,
                                       position_with_fallback, range_check_ok,
                                       signed_error_pct, status)
from fairband.spec import PanelSpec


def drop_admin(df: DataFrame, names) -> DataFrame:
    """``drop_admin``: drop columns if present (absent names are a no-op)."""
    return df.drop(*[n for n in names if n in df.columns])


def latest_per_key(df: DataFrame, key: str, order_col: str, tiebreak: str | None = None) -> DataFrame:
    """``latest_per_key``: newest row per key, NULL order values last.

    ``row_number() == 1`` lets Catalyst insert a WindowGroupLimit, so each
    partition keeps one row per key before the window sort finishes.  The
    partition is one key's history, which is small by construction.
    """
    order = [F.col(order_col).desc_nulls_last()]
    if tiebreak:
        order.append(F.col(tiebreak).asc_nulls_last())
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_best(df: DataFrame, group_cols, metric: str, ordinal: str) -> DataFrame:
    """``first_best``: per group, highest metric; ties keep the lowest ordinal."""
    w = Window.partitionBy(*group_cols).orderBy(F.col(metric).desc_nulls_last(), F.col(ordinal).asc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _suffix_clashes(df: DataFrame, taken: set, key: str, suffix: str) -> DataFrame:
    for c in df.columns:
        if c != key and c in taken:
            df = df.withColumnRenamed(c, c + suffix)
    return df


def panel_left_joins(base: DataFrame, others, key: str) -> DataFrame:
    """``panel_left_joins``: chained left equi-joins; clashing names get a suffix.

    ``others`` is a list of ``(DataFrame, suffix)``.  Rows with a NULL key on
    the right never match (pandas would match NaN to NaN).
    """
    out = base
    for df, suffix in others:
        df = _suffix_clashes(df.filter(F.col(key).isNotNull()), set(out.columns), key, suffix)
        out = out.join(df, on=key, how="left")
    return out


def build_panel(tables, spec: PanelSpec, latest_season: bool = True, aliases: dict | None = None,
                fused: bool = True) -> DataFrame:
    """attributes ⟕ identity ⟕ salaries ⟕ latest stats ⟕ market -> one row per entity.

    ``fused=True`` (default) joins one per-entity activity aggregate that already
    carries all four (one shuffle on the key instead of four joins);
    ``fused=False`` chains the separate tables like the reference does, and with
    ``latest_season=False`` keeps one row per season (the reference's fan-out).
    """
    if fused and latest_season and hasattr(tables, "activity"):
        panel = panel_left_joins(tables.attributes, [(tables.activity, "_activity")], spec.key)
    else:
        stats = tables.stats
        if latest_season:
            stats = latest_per_key(stats, spec.key, spec.season)
        panel = panel_left_joins(
            tables.attributes,
            [(tables.identity, "_identity"), (tables.salaries, "_salary"),
             (stats, "_stats"), (tables.market, "_market")],
            spec.key)
    return (panel
            .withColumn(spec.position, position_with_fallback(F.lit(None).cast("string"), "player_positions"))
            .withColumn(spec.league, league_alias(spec.league, aliases or {})))


def eligibility_filter(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``eligibility_filter``: target > 0 AND activity >= min AND league in list (NULL fails)."""
    return df.filter((F.col(spec.target) > 0)
                     & (F.col(spec.activity) >= F.lit(spec.min_activity))
                     & F.col(spec.league).isin(list(spec.leagues)))


BASE_COLUMNS = (
    "player_pk", "api_football_id", "short_name", "long_name", "league_name", "club_name",
    "nationality", "player_positions", "position", "age", "overall", "international_reputation",
    "value_eur", "preferred_foot", "season", "appearances", "minutes", "goals", "assists",
    "rating", "market_value_eur", "gross_annual_eur",
)


def base_projection(df: DataFrame, columns=BASE_COLUMNS) -> DataFrame:
    """``base_projection``: the modelling/serving column set (only those present); a NaN
    counts as missing from here on, as it does for the means and medians that fill it."""
    kinds = dict(df.dtypes)
    return df.select(*[nan_to_null(c).alias(c) if kinds[c] == "double" else F.col(c) for c in columns if c in kinds])


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """``numeric_columns``: names of numeric fields, in schema order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def anti_trained(df: DataFrame, trained: DataFrame, key: str) -> DataFrame:
    """``anti_trained`` / ``key_difference``: rows whose key is not in ``trained``."""
    return df.join(trained.select(key), on=key, how="left_anti")


def untrained_star(panel: DataFrame, trained: DataFrame, spec: PanelSpec) -> DataFrame:
    """``untrained_star``: every panel entity that is not in the trained set,
    with empty prediction columns and ``prediction_available = false``."""
    return (anti_trained(panel, trained, spec.key)
            .withColumn(spec.low, F.lit(None).cast("double"))
            .withColumn(spec.high, F.lit(None).cast("double"))
            .withColumn(spec.center, F.lit(None).cast("double"))
            .withColumn("prediction_available", F.lit(False)))


def combined_view(trained: DataFrame, untrained: DataFrame) -> DataFrame:
    """``combined_view``: trained ∪ untrained by name; missing columns are NULL, duplicates kept."""
    if "prediction_available" not in trained.columns:
        trained = trained.withColumn("prediction_available", F.lit(True))
    return trained.unionByName(untrained, allowMissingColumns=True)


def map_enrich(df: DataFrame, dim: DataFrame, key: str, columns, order_col: str | None = None) -> DataFrame:
    """``map_enrich``: attach dimension columns by key; a key seen twice keeps one row
    (the highest ``order_col`` when given, so the choice is deterministic)."""
    dim = dim.select(key, *columns, *([order_col] if order_col and order_col not in columns else []))
    if order_col:
        dim = latest_per_key(dim, key, order_col)
    else:
        dim = dim.dropDuplicates([key])
    dim = dim.select(key, *columns)
    base = df.drop(*[c for c in columns if c in df.columns])
    return base.join(dim, on=key, how="left")


def writeback_join(rows: DataFrame, predictions: DataFrame, spec: PanelSpec) -> DataFrame:
    """``writeback_join``: put (low, high, center) back on rows; flags only where actual > 0."""
    pred = predictions.select(spec.key, spec.low, spec.high, spec.center)
    out = rows.drop(spec.low, spec.high, spec.center).join(pred, spec.key, "left")
    a = F.col(spec.target)
    has = (a > 0) & F.col(spec.low).isNotNull()
    return (out
            .withColumn("actual_in_range", F.when(has, in_range(a, spec.low, spec.high)).otherwise(F.lit(False)))
            .withColumn("range_accuracy_result",
                        F.when(has, range_check_ok(a, spec.low, spec.high)).otherwise(F.lit(False)))
            .withColumn("abs_error_pct", F.when(has, abs_error_pct(a, spec.center)))
            .withColumn("prediction_available", F.col(spec.low).isNotNull()))


def score_columns(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``score_all`` tail: error %, in-range flags and status for rows with a range."""
    a = F.col(spec.target)
    return (df
            .withColumn("prediction_error_pct", signed_error_pct(spec.center, spec.target))
            .withColumn("actual_in_range", F.coalesce(in_range(a, spec.low, spec.high), F.lit(False)))
            .withColumn("range_accuracy_result",
                        F.coalesce(range_check_ok(a, spec.low, spec.high), F.lit(False)))
            .withColumn("status", status(a, spec.low, spec.high)))


def live_combine(stored: DataFrame, live: DataFrame, key: str, columns, age_col: str = "age") -> DataFrame:
    """``live_combine``: live values override stored ones where non-zero; age = live or stored."""
    live = live.select(key, *[F.col(c).alias(f"_live_{c}") for c in columns])
    out = stored.join(live, key, "left")
    for c in columns:
        lc = F.col(f"_live_{c}")
        if c == age_col:
            out = out.withColumn(c, F.coalesce(F.nullif(lc, F.lit(0)), F.col(c)))
        else:
            out = out.withColumn(c, F.coalesce(F.nullif(lc, F.lit(0)), F.col(c), F.lit(0.0)))
    return out.drop(*[f"_live_{c}" for c in columns])


def sufficiency_gate(df: DataFrame, current: str, historical: str, attr: str, min_n: float = 20) -> DataFrame:
    """``sufficiency_gate``: warning list (low current / low historical sample) and an error
    code (no activity at all, none in the current season, no attributes) per row, as columns."""
    cur, hist = F.coalesce(F.col(current), F.lit(0.0)), F.coalesce(F.col(historical), F.lit(0.0))
    warnings = F.array_compact(F.array(
        F.when(cur < min_n, F.lit("low_current_sample")), F.when(hist < min_n, F.lit("low_history_sample"))))
    err = (F.when((cur == 0) & (hist == 0), F.lit("no_activity"))
           .when(cur == 0, F.lit("no_current_activity"))
           .when(F.col(attr).isNull(), F.lit("no_attributes")))
    return df.withColumn("warnings", warnings).withColumn("error_code", err)
