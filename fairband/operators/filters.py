"""Predicates over the scored / combined view (all pushed into one Filter node)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairband.spec import PanelSpec


def _contains(col: str, text: str, regex: bool):
    c = F.lower(F.col(col))
    if regex:
        return F.coalesce(F.col(col).rlike("(?i)" + text), F.lit(False))
    return F.coalesce(c.contains(text.lower()), F.lit(False))


def filter_league(df: DataFrame, text: str, spec: PanelSpec, regex: bool = False) -> DataFrame:
    """Case-insensitive substring match (NULL never matches); ``regex=True`` matches a pattern."""
    return df.filter(_contains(spec.league, text, regex))


def filter_position(df: DataFrame, text: str, spec: PanelSpec, regex: bool = False) -> DataFrame:
    return df.filter(_contains(spec.position, text, regex))


def filter_q(df: DataFrame, text: str, spec: PanelSpec, regex: bool = False) -> DataFrame:
    """``filter_q``: OR of substring matches over name, long name and club."""
    cond = (_contains(spec.name, text, regex) | _contains(spec.long_name, text, regex)
            | _contains(spec.club, text, regex))
    return df.filter(cond)


def filter_exact(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def filter_max_salary(df: DataFrame, limit: float, spec: PanelSpec) -> DataFrame:
    """``coalesce(target, 0) <= limit``: rows without a target pass."""
    return df.filter(F.coalesce(F.col(spec.target), F.lit(0.0)) <= F.lit(float(limit)))


def status_predicate(name: str, spec: PanelSpec):
    a, lo, hi = F.col(spec.target), F.col(spec.low), F.col(spec.high)
    avail = F.coalesce(F.col("prediction_available"), F.lit(True)) & lo.isNotNull() & hi.isNotNull()
    preds = {"overpaid": a > hi, "underpaid": a < lo, "fair": (a >= lo) & (a <= hi)}
    if name not in preds:
        raise ValueError(f"unknown status {name!r}; expected one of {sorted(preds)}")
    return F.coalesce(avail & a.isNotNull() & preds[name], F.lit(False))


def filter_status(df: DataFrame, name: str, spec: PanelSpec) -> DataFrame:
    """``filter_status``: overpaid / underpaid / fair; any other value raises at build time."""
    return df.filter(status_predicate(name, spec))


def search_name(df: DataFrame, text: str, spec: PanelSpec, limit: int = 20) -> DataFrame:
    """``search_name``: substring over name / long name, first ``limit`` by key."""
    cond = _contains(spec.name, text, False) | _contains(spec.long_name, text, False)
    return df.filter(cond).orderBy(spec.key).limit(limit)


def lookup_ilike(df: DataFrame, text: str, spec: PanelSpec, id_col: str = "api_football_id",
                 limit: int = 20) -> DataFrame:
    """``lookup_ilike``: ``name ILIKE %text%`` (user % and _ stay wildcards) with an id."""
    return (df.filter(F.col(spec.name).ilike(f"%{text}%") & F.col(id_col).isNotNull())
            .orderBy(spec.key).limit(limit))


def point_lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``point_lookup`` as a keyed batch lookup: found rows (inner join on the key list)."""
    return df.join(keys.select(key).distinct(), key, "inner")


def missing_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keys of a lookup batch that have no row (the reference's 404s)."""
    return keys.select(key).distinct().join(df.select(key), key, "left_anti")


def outlier_3sigma(df: DataFrame, spec: PanelSpec, value: str) -> DataFrame:
    """Flag ``value`` outside [max(0, mean-3σ), mean+3σ] where mean/σ come from the actual target.

    The two global statistics are uncorrelated scalar subqueries (merged into
    one aggregate job by the optimizer), so no join with a one-row frame runs.
    """
    st = df.agg(F.avg(spec.target).alias("m"), F.stddev_samp(spec.target).alias("s"))
    m, s = st.select("m").scalar(), st.select("s").scalar()
    v = F.col(value)
    return df.withColumn(
        f"{value}_outlier",
        F.coalesce((v > m + 3 * s) | (v < F.greatest(F.lit(0.0), m - 3 * s)), F.lit(False)))


def sanity_bounds(df: DataFrame, column: str, upper: float = 1e9) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count_if(c < 0).alias("n_negative"), F.count_if(c > upper).alias("n_too_large"),
                  F.min(c).alias("min_value"), F.max(c).alias("max_value"))


def min_threshold_audit(df: DataFrame, column: str, threshold: float = 20) -> DataFrame:
    c = F.col(column)
    return df.agg(F.min(c).alias("min_value"), F.count_if(c < threshold).alias("n_below"))
