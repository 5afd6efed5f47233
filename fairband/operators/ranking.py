"""Sorting, paging and top-k operators (deterministic: the key is the last tiebreak)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairband.spec import PanelSpec

# Fixed values (must equal the reference): sortable fields; unknown -> actual salary.
SORT_FIELDS = {
    "actual_salary": "gross_annual_eur",
    "overall": "overall",
    "age": "age",
    "prediction_error": "prediction_error_pct",
    "predicted_salary": "predicted_center_eur",
}


def paginate(df: DataFrame, spec: PanelSpec, sort_by: str = "actual_salary", order: str = "desc",
             page: int = 1, per_page: int = 50) -> DataFrame:
    """``paginate``: whitelisted sort (NULLs last both ways), page >= 1, 1 <= per_page <= 1000.

    Planned as ``TakeOrderedAndProject(limit=page*per_page, offset)``: each
    partition keeps its own top page*per_page rows, so no global sort runs.
    """
    if page < 1 or not (1 <= per_page <= 1000):
        raise ValueError("page must be >= 1 and per_page in 1..1000")
    col = SORT_FIELDS.get(sort_by, SORT_FIELDS["actual_salary"])
    c = F.col(col).asc_nulls_last() if order == "asc" else F.col(col).desc_nulls_last()
    return df.orderBy(c, F.col(spec.key).asc()).offset((page - 1) * per_page).limit(per_page)


def paginate_after(df: DataFrame, spec: PanelSpec, last_value: float | None, last_key: int, sort_by: str = "actual_salary",
                   order: str = "desc", per_page: int = 50) -> DataFrame:
    """The page that follows a row, given its sort value (None: it has none) and key.

    However deep it lies, every partition keeps ``per_page`` rows only; ``paginate``
    keeps page x per_page of them, so use it to enter and this to go on.
    """
    if not (1 <= per_page <= 1000):
        raise ValueError("per_page must be in 1..1000")
    c, key = F.col(SORT_FIELDS.get(sort_by, SORT_FIELDS["actual_salary"])), F.col(spec.key)
    if last_value is None:
        later = c.isNull() & (key > last_key)
    else:
        beyond = c > last_value if order == "asc" else c < last_value
        later = beyond | ((c == last_value) & (key > last_key)) | c.isNull()
    return df.filter(later).orderBy(c.asc_nulls_last() if order == "asc" else c.desc_nulls_last(), key.asc()).limit(per_page)


def page_count(df: DataFrame, per_page: int) -> DataFrame:
    """Total rows and ``ceil(total / per_page)`` as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / F.lit(per_page)).cast("long"))


def top_overpaid(df: DataFrame, spec: PanelSpec, limit: int = 20) -> DataFrame:
    """``top_overpaid``: rows with actual - high > 0, largest gap first (1 <= limit <= 100)."""
    if not (1 <= limit <= 100):
        raise ValueError("limit must be in 1..100")
    gap = F.col(spec.target) - F.col(spec.high)
    return (df.withColumn("overpaid_by", gap).filter(F.col("overpaid_by") > 0)
            .orderBy(F.col("overpaid_by").desc(), F.col(spec.key)).limit(limit))


def top_underpaid(df: DataFrame, spec: PanelSpec, limit: int = 20) -> DataFrame:
    """``top_underpaid``: rows with low - actual > 0, largest gap first."""
    if not (1 <= limit <= 100):
        raise ValueError("limit must be in 1..100")
    gap = F.col(spec.low) - F.col(spec.target)
    return (df.withColumn("underpaid_by", gap).filter(F.col("underpaid_by") > 0)
            .orderBy(F.col("underpaid_by").desc(), F.col(spec.key)).limit(limit))


def extremes(df: DataFrame, value: str, key: str, n: int = 5) -> DataFrame:
    """``extremes`` / ``concat_extremes``: n largest ∪ n smallest of ``value``."""
    hi = df.orderBy(F.col(value).desc(), F.col(key)).limit(n).withColumn("side", F.lit("largest"))
    lo = df.orderBy(F.col(value).asc(), F.col(key)).limit(n).withColumn("side", F.lit("smallest"))
    return hi.unionByName(lo)


def compare_side_by_side(spark: SparkSession, df: DataFrame, keys, spec: PanelSpec) -> DataFrame:
    """``compare_side_by_side``: 2..10 keys, request order kept, duplicates kept.

    The request list is bounded (<= 10 rows), so it is broadcast.  Unknown
    keys are reported lazily as rows with ``found = false`` (the reference
    answers them with an error), so building the plan needs no action.
    """
    keys = list(keys)
    if not (2 <= len(keys) <= 10):
        raise ValueError("compare needs 2..10 keys")
    req = spark.createDataFrame([(i, int(k)) for i, k in enumerate(keys)],
                                f"ordinal int, {spec.key} long")
    found = df.withColumn("found", F.lit(True))
    return (F.broadcast(req).join(found, spec.key, "left")
            .withColumn("found", F.coalesce(F.col("found"), F.lit(False)))
            .orderBy("ordinal"))
