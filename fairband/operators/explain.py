"""Per-row explanations: importance x direction contributions and template text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairband.functions.scalar import (age_phrase, fmt_eur, humanize_name, list_phrase, overall_phrase,
                                       range_display, reputation_phrase)

# Display names for features (our own wording; unknown names fall back to spaces).
DISPLAY_NAMES = {
    "overall": "rating", "age": "years of age", "international_reputation": "renown",
    "value_eur": "listed value", "market_value_eur": "market price",
    "appearances": "matches", "minutes": "time on the pitch", "goals": "scoring",
    "assists": "passes to a goal", "rating": "match marks", "log_value_eur": "listed value",
    "log_market_value": "market price", "goals_per_90": "scoring rate",
    "assists_per_90": "assist rate", "goal_contributions": "scoring and assists together",
    "age_squared": "years of age, squared", "overall_x_reputation": "rating times renown",
    "value_per_overall": "listed value per rating point", "market_to_value_ratio": "market price over listed value",
}


def feature_contributions(df: DataFrame, importances: list[tuple], means: dict, top: int = 10) -> DataFrame:
    """Per row: the ``top`` most important features with value, dataset mean and direction
    (value >= mean -> 'up').  ``importances`` is (rank, feature, importance) from the model;
    the array is built with column expressions and sorted with ``array_sort``."""
    items = [F.struct(F.lit(float(imp)).alias("importance"), F.lit(f).alias("feature"),
                      F.col(f).cast("double").alias("value"), F.lit(float(means[f])).alias("mean"),
                      F.when(F.col(f) >= F.lit(float(means[f])), F.lit("up")).otherwise(F.lit("down")).alias("direction"))
             for _, f, imp in importances]
    arr = F.array_sort(F.array(*items), lambda a, b: F.when(a["importance"] > b["importance"], -1)
                       .when(a["importance"] < b["importance"], 1).otherwise(0))
    return df.withColumn("contributions", F.slice(arr, 1, top))


def similar_lines(neighbors: DataFrame, about: DataFrame, key: str, n: int = 3, name="short_name", position="position",
                  overall="overall", pay="gross_annual_eur") -> DataFrame:
    """``(key, similar)``: the first ``n`` neighbours of every row as lines of name, position, rating and pay.

    ``neighbors`` has ``query_id``, ``neighbor_id``, ``rank``; at most ``n`` rows of a query are gathered.
    """
    line = F.concat(F.col(name), F.lit(" ("), F.col(position), F.lit(", rating "), F.format_number(F.col(overall).cast("double"), 1),
                    F.lit("): paid "), fmt_eur(pay))
    known = about.select(F.col(key).alias("neighbor_id"), line.alias("line"))
    return (neighbors.filter(F.col("rank") <= n).join(known, "neighbor_id").groupBy(F.col("query_id").alias(key))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r["line"]).alias("similar")))


def explanation_context(df: DataFrame, factors: str = "contributions", n: int = 5, similar: str | None = None) -> DataFrame:
    """All facts behind a row's estimate as one text block: its strongest factors with the
    row's value and the average of all rows, and under ``similar`` the lines of rows like it."""
    lines = F.transform(F.slice(F.col(factors), 1, n), lambda c: F.concat(
        humanize_name(c["feature"], DISPLAY_NAMES), F.when(c["direction"] == "up", F.lit(": not below average (")).otherwise(F.lit(": below average (")),
        F.format_number(c["value"], 2), F.lit(" against "), F.format_number(c["mean"], 2), F.lit(")")))
    text = F.concat(F.lit("Factors:\n"), F.array_join(lines, "\n"))
    if similar:
        text = F.concat(text, F.when(F.size(similar) > 0, F.concat(F.lit("\nRows like it:\n"), F.array_join(F.col(similar), "\n"))).otherwise(F.lit("")))
    return df.withColumn("explanation_context", text)


def template_explanation(df: DataFrame, name="short_name", club="club_name", low="predicted_low_eur",
                         high="predicted_high_eur", pct="percentile_rank", top_feature="top_feature",
                         age="age", overall="overall", positions="player_positions",
                         reputation="international_reputation", traits: str | None = None,
                         tags: str | None = None) -> DataFrame:
    """One text per row, a list of short statements; a statement without data is left out.

    ``traits`` (first three) and ``tags`` (first two, without '#') name optional comma lists."""
    who = F.concat_ws(", ", F.col(name), F.col(club))
    pay = F.concat(F.lit("Yearly pay range of "), who, F.lit(": "), range_display(low, high),
                   F.lit("; more than "), F.col(pct).cast("string"), F.lit(" % of the rows."))
    driver = F.concat(F.lit("Strongest factor: "), humanize_name(F.col(top_feature), DISPLAY_NAMES), F.lit("."))
    profile = F.concat(F.lit("Profile: "), F.concat_ws(", ", age_phrase(age), overall_phrase(overall), reputation_phrase(reputation)),
                       F.lit("."))
    roles = F.when(F.col(positions).contains(","), F.concat(F.lit("Roles: "), list_phrase(positions, last="or"), F.lit(".")))
    lists = [F.concat(F.lit(f"{label}: "), list_phrase(F.col(column), limit, strip), F.lit("."))
             for label, column, limit, strip in (("Traits", traits, 3, None), ("Tags", tags, 2, "#")) if column]
    return df.withColumn("explanation", F.concat_ws(" ", pay, driver, profile, roles, *lists))
