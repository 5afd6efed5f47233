"""Feature preparation as column expressions: encode, one-hot, impute, derive, scale, split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairband.functions.scalar import inf_nan_to_zero, per_90, safe_ratio
from fairband.operators.quantiles import group_quantiles
from fairband.spec import PanelSpec


def encode_foot(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Label-encode the foot with sorted labels (Left 0, Right 1); NULL / unseen -> Right."""
    f = F.coalesce(F.col(spec.foot), F.lit("Right"))
    return df.withColumn(spec.foot + "_code", F.when(f == "Left", F.lit(0.0)).otherwise(F.lit(1.0)))


def onehot_drop_first(df: DataFrame, column: str, categories, prefix: str = "pos") -> DataFrame:
    """Dummies for sorted(categories)[1:] (first dropped); NULL / unknown -> all zeros."""
    cols = {f"{prefix}_{c}": F.when(F.col(column) == F.lit(c), F.lit(1.0)).otherwise(F.lit(0.0))
            for c in sorted(categories)[1:]}
    return df.withColumns(cols)


def fit_medians(df: DataFrame, columns) -> dict:
    """Fit step of the median imputer: exact medians of the fit rows, one per column.

    Like any Spark ML ``fit`` this runs a job and returns a bounded model (one
    number per column), not data.  The columns are unpivoted so one
    ``group_quantiles`` pass serves them all.
    """
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {stack}) AS (feature, value)")
    rows = group_quantiles(long, ["feature"], "value", {"median": 0.5}).collect()
    got = {r["feature"]: r["median"] for r in rows}
    return {c: got.get(c) for c in columns}


def median_impute(df: DataFrame, medians: dict, columns=None) -> DataFrame:
    """``coalesce(col, median)`` with the fitted medians as literals."""
    cols = columns or list(medians)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c]).cast("double"))
                           for c in cols if medians.get(c) is not None})


def engineer_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Derived columns in ``spec.derived_features`` order, then +-inf / NaN / NULL -> 0."""
    d = {
        "log_value_eur": F.log1p("value_eur"),
        "log_market_value": F.log1p("market_value_eur"),
        "goals_per_90": per_90("goals", "minutes"),
        "assists_per_90": per_90("assists", "minutes"),
        "goal_contributions": F.col("goals") + F.col("assists"),
        "age_squared": F.col("age") * F.col("age"),
        "overall_x_reputation": F.col("overall") * F.col("international_reputation"),
        "value_per_overall": safe_ratio("value_eur", "overall"),
        "market_to_value_ratio": safe_ratio("market_value_eur", "value_eur"),
    }
    out = df.withColumns({k: d[k] for k in spec.derived_features})
    feats = spec.feature_columns
    return out.withColumns({c: inf_nan_to_zero(F.col(c).cast("double")) for c in feats})


def split_bucket(key) -> F.Column:
    """Deterministic 0..99 bucket of an integer key (multiplicative hash; no partition dependence).

    ``((key mod 2^31) * 2654435761 mod 2^32) div 2^16 mod 100`` stays inside
    64-bit arithmetic for every key.
    """
    k = F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(2147483648))
    h = F.pmod(k * F.lit(2654435761), F.lit(4294967296))
    return F.pmod(F.shiftright(h, 16), F.lit(100))


def train_test_split(df: DataFrame, key: str, train_pct: int = 80) -> DataFrame:
    return df.withColumn("split", F.when(split_bucket(key) < train_pct, F.lit("train")).otherwise(F.lit("test")))


def fit_scaler(df: DataFrame, columns) -> dict:
    """Fit step of the scaler: mean and population std per column (std 0 -> 1), one job."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    row = df.agg(*aggs).first()
    return {c: (row[f"{c}__mean"], 1.0 if not row[f"{c}__std"] else row[f"{c}__std"]) for c in columns}


def standard_scale(df: DataFrame, scaler: dict, columns=None, suffix: str = "") -> DataFrame:
    """(x - mean) / population std with the fitted statistics as literals."""
    cols = columns or list(scaler)
    return df.withColumns({c + suffix: (F.col(c) - F.lit(scaler[c][0])) / F.lit(scaler[c][1]) for c in cols})


def feature_table(df: DataFrame, spec: PanelSpec, fit_rows: DataFrame | None = None) -> DataFrame:
    """encode -> one-hot -> median impute (fit on ``fit_rows``, default: train split) -> derive."""
    x = onehot_drop_first(encode_foot(df, spec), spec.position, spec.position_categories)
    if "split" not in x.columns:
        x = train_test_split(x, spec.key)
    fit = fit_rows if fit_rows is not None else x.filter(F.col("split") == "train")
    nums = list(spec.base_features)
    med = fit_medians(fit, nums)
    return engineer_features(median_impute(x, med, nums), spec)
