"""Group statistics, distributions, accuracy metrics and correlations.

Design rules: every report is one ``groupBy().agg`` (partial aggregation on the
map side); exact quantiles go through ``group_quantiles`` (no group gathered
into one task); global scalars are scalar subqueries, not joins; running sums
over bounded bucket tables replace one scan per threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairband.functions.scalar import range_check_ok, range_distance_pct, safe_ratio
from fairband.operators.quantiles import group_quantiles
from fairband.session import materialize
from fairband.spec import PanelSpec


def _join_groups(left: DataFrame, right: DataFrame, groups) -> DataFrame:
    """Attach per-group results; with no groups both sides are one row and the right
    side's columns become scalar subqueries (no join at all)."""
    if groups:
        return left.join(right, list(groups), "left")
    return attach_scalars(left, right)


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add every column of a one-row frame as an uncorrelated scalar subquery."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


# ---------------------------------------------------------------- group reports

def league_stats(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per league: n (all rows), salary mean/median/min/max/std (non-null), mean overall,
    top earner (highest salary, lowest key on ties), range accuracy over all rows
    (rows without a target count as misses), has_salary_data."""
    a = F.col(spec.target)
    top = F.max(F.when(a.isNotNull(), F.struct(a.alias("s"), (-F.col(spec.key)).alias("k"),
                                                F.col(spec.name).alias("n"))))
    g = df.groupBy(spec.league).agg(
        F.count(F.lit(1)).alias("n_players"),
        F.avg(a).alias("mean_salary"), F.min(a).alias("min_salary"), F.max(a).alias("max_salary"),
        F.stddev_samp(a).alias("std_salary"),
        F.avg(spec.overall).alias("mean_overall"),
        top.alias("_top"),
        (F.avg(F.coalesce(F.col("range_accuracy_result") & a.isNotNull(), F.lit(False)).cast("double"))
         * 100).alias("range_accuracy_pct"),
        (F.count(a) > 0).alias("has_salary_data"))
    med = group_quantiles(df, [spec.league], spec.target, {"median_salary": 0.5})
    out = _join_groups(g, med, [spec.league]).select(
        "*", F.col("_top.n").alias("top_paid_name"), F.col("_top.s").alias("top_paid_salary")).drop("_top")
    order = F.coalesce(F.when(F.col("median_salary") != 0, F.col("median_salary")), F.lit(-1.0))
    return out.orderBy(order.desc(), F.col(spec.league))


def position_stats(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per position on coalesce(actual, predicted center); groups without any value are
    skipped; accuracy only over rows with an actual target; mean age."""
    v = F.coalesce(F.col(spec.target), F.col(spec.center))
    base = df.withColumn("_v", v)
    g = base.groupBy(spec.position).agg(
        F.count(F.lit(1)).alias("n_players"), F.count("_v").alias("n_valued"),
        F.avg("_v").alias("mean_salary"), F.min("_v").alias("min_salary"),
        F.max("_v").alias("max_salary"),
        (F.avg(F.when(F.col(spec.target).isNotNull(),
                      F.coalesce(F.col("range_accuracy_result"), F.lit(False)).cast("double"))) * 100)
        .alias("range_accuracy_pct"),
        F.avg(spec.age).alias("mean_age"))
    med = group_quantiles(base, [spec.position], "_v", {"median_salary": 0.5})
    out = _join_groups(g.filter(F.col("n_valued") > 0), med, [spec.position])
    return out.orderBy(F.col("median_salary").desc_nulls_last(), F.col(spec.position))


# Fixed values (must equal the reference): half-open age buckets and labels.
AGE_BUCKETS = ((17, 21, "17-20"), (21, 24, "21-23"), (24, 27, "24-26"),
               (27, 30, "27-29"), (30, 33, "30-32"), (33, 40, "33-39"))


def age_bucket(age) -> Column:
    a = F.col(age) if isinstance(age, str) else age
    expr = None
    for lo, hi, label in AGE_BUCKETS:
        cond = (a >= lo) & (a < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def age_buckets(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows outside [17, 40) drop out; empty buckets are omitted."""
    b = df.withColumn("age_bucket", age_bucket(spec.age)).filter(F.col("age_bucket").isNotNull())
    g = b.groupBy("age_bucket").agg(F.count(F.lit(1)).alias("n_players"),
                                    F.avg(spec.target).alias("mean_salary"))
    med = group_quantiles(b, ["age_bucket"], spec.target, {"median_salary": 0.5})
    return _join_groups(g, med, ["age_bucket"]).orderBy("age_bucket")


def peak_age(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Age with the highest mean salary; the lowest age wins ties."""
    g = df.filter(F.col(spec.target).isNotNull()).groupBy(spec.age).agg(
        F.avg(spec.target).alias("mean_salary"))
    return g.orderBy(F.col("mean_salary").desc(), F.col(spec.age)).limit(1)


def overview(df: DataFrame, spec: PanelSpec) -> DataFrame:
    a = F.col(spec.target)
    g = df.agg(F.count(F.lit(1)).alias("total"), F.count(a).alias("n_salary"),
               F.avg(a).alias("mean_salary"), F.min(a).alias("min_salary"),
               F.max(a).alias("max_salary"),
               F.when(F.count(a) > 1, F.stddev_samp(a)).otherwise(F.lit(0.0)).alias("std_salary"),
               F.avg(spec.age).alias("mean_age"), F.min(spec.age).alias("min_age"),
               F.max(spec.age).alias("max_age"),
               F.countDistinct(spec.league).alias("n_leagues"),
               F.countDistinct(spec.position).alias("n_positions"))
    med = group_quantiles(df, [], spec.target, {"median_salary": 0.5})
    return attach_scalars(g, med)


def overview_groups(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """The per-league and per-position parts of the overview as tidy rows.

    Leagues report the target; positions fall back to the predicted center and
    report mean and median only."""
    parts = []
    for grouping, column, value in (("league", spec.league, F.col(spec.target)),
                                    ("position", spec.position, F.coalesce(F.col(spec.target), F.col(spec.center)))):
        base = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("name"), value.cast("double").alias("_v"))
        edge = lambda agg, own=grouping == "league": agg if own else F.lit(None).cast("double")
        g = base.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean_salary"),
                                     edge(F.min("_v")).alias("min_salary"), edge(F.max("_v")).alias("max_salary"))
        parts.append(_join_groups(g, group_quantiles(base, ["name"], "_v", {"median_salary": 0.5}), ["name"])
                     .select(F.lit(grouping).alias("grouping"), "name", "n", "mean_salary", "median_salary", "min_salary", "max_salary"))
    return parts[0].unionByName(parts[1])


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles (exact), max of one column."""
    c = F.col(column)
    g = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
               F.min(c).alias("min"), F.max(c).alias("max"))
    q = group_quantiles(df, [], column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return attach_scalars(g, q)


def value_counts_top(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(column)).limit(k))


def group_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    return group_quantiles(df, [group], value, {"median": 0.5}).orderBy(F.col("median").desc(), group)


def attr_means_by_group(df: DataFrame, group: str, attrs) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in attrs])


def age_curve(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.groupBy(spec.position, spec.age).agg(F.avg(spec.target).alias("mean_salary"))


def rolling_mean_3(curve: DataFrame, group: str, order: str, value: str, min_points: int = 3) -> DataFrame:
    """Centred 3-point mean (min 1 point) over existing ``order`` values, groups with >= 3 points.

    The curve is one row per (group, order value), so each window partition is
    bounded by the number of distinct order values.
    """
    w = Window.partitionBy(group).orderBy(order)
    return (curve.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group)))
            .filter(F.col("_n") >= min_points)
            .withColumn("rolling_mean", F.avg(value).over(w.rowsBetween(-1, 1))).drop("_n"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def missing_count(df: DataFrame) -> DataFrame:
    """Total NULL (or NaN) cells per column, as one tidy row per column."""
    exprs = []
    for f in df.schema.fields:
        c = F.col(f.name)
        miss = c.isNull()
        if f.dataType.typeName() in ("double", "float"):
            miss = miss | F.isnan(c)
        exprs.append(F.count_if(miss).alias(f.name))
    wide = df.agg(*exprs)
    stack = ", ".join(f"'{f.name}', `{f.name}`" for f in df.schema.fields)
    return wide.selectExpr(f"stack({len(df.schema.fields)}, {stack}) AS (column_name, n_missing)")


# ---------------------------------------------------------------- accuracy metrics

def within_pct(df: DataFrame, pred: str, actual: str, pct: float = 0.30) -> DataFrame:
    a = F.col(actual)
    ok = (F.abs(F.col(pred) - a) / a <= pct).cast("double")
    return df.filter(a > 0).agg((F.avg(ok) * 100).alias("within_pct"), F.count(F.lit(1)).alias("n"))


def range_accuracy(df: DataFrame, spec: PanelSpec, tol: float = 0.30) -> DataFrame:
    ok = range_check_ok(spec.target, spec.low, spec.high, tol)
    return df.filter(F.col(spec.target).isNotNull() & F.col(spec.low).isNotNull()).agg(
        (F.avg(ok.cast("double")) * 100).alias("range_accuracy_pct"), F.count(F.lit(1)).alias("n"))


def range_check(df: DataFrame, spec: PanelSpec, tol: float = 0.30) -> DataFrame:
    """Row level: (ok, distance %) with the distance rounded half-even to 1 decimal."""
    return df.withColumn("range_ok", range_check_ok(spec.target, spec.low, spec.high, tol)) \
             .withColumn("range_dist_pct", F.bround(range_distance_pct(spec.target, spec.low, spec.high) * 100, 1))


def reg_metrics(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """R² on the log1p scale, MAE and RMSE on the money scale, in one pass (+1 scalar)."""
    y, p = F.log1p(F.col(actual)), F.log1p(F.col(pred))
    ybar = df.agg(F.avg(F.log1p(F.col(actual)))).scalar()
    sst = F.sum((y - ybar) ** 2)
    return df.agg(
        (F.lit(1.0) - F.sum((y - p) ** 2) / F.nullif(sst, F.lit(0.0))).alias("r2_log"),
        F.avg(F.abs(F.col(pred) - F.col(actual))).alias("mae"),
        F.sqrt(F.avg((F.col(pred) - F.col(actual)) ** 2)).alias("rmse"),
        F.count(F.lit(1)).alias("n"))


def mape(df: DataFrame, pred: str, actual: str, threshold: float, split: str | None = None) -> DataFrame:
    """Mean and exact median absolute % error over rows with actual > threshold."""
    base = df.filter(F.col(actual) > threshold).withColumn(
        "_ape", F.abs(F.col(pred) - F.col(actual)) / F.col(actual) * 100)
    groups = [split] if split else []
    g = base.groupBy(*groups).agg(F.avg("_ape").alias("mape"), F.count(F.lit(1)).alias("n"))
    med = group_quantiles(base, groups, "_ape", {"median_ape": 0.5})
    return _join_groups(g, med, groups)


def overpaid_reduction(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows with actual > high: Σactual, Σcenter, total % reduction and median row reduction."""
    base = df.filter(F.col(spec.target) > F.col(spec.high)).withColumn(
        "_red", (F.col(spec.target) - F.col(spec.center)) / F.col(spec.target) * 100)
    g = base.agg(F.count(F.lit(1)).alias("n_overpaid"),
                 F.sum(spec.target).alias("sum_actual"), F.sum(spec.center).alias("sum_center"))
    g = g.withColumn("total_reduction_pct",
                     safe_ratio(F.col("sum_actual") - F.col("sum_center"), "sum_actual") * 100)
    return attach_scalars(g, group_quantiles(base, [], "_red", {"median_reduction_pct": 0.5}))


def residual_std(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """Population std of log residuals."""
    return df.agg(F.stddev_pop(F.log1p(F.col(actual)) - F.log1p(F.col(pred))).alias("residual_std"))


def residuals_by_group(df: DataFrame, group: str, pred: str, actual: str) -> DataFrame:
    r = (F.col(pred) - F.col(actual)) / F.col(actual) * 100
    return df.filter(F.col(actual) > 0).groupBy(group).agg(F.avg(r).alias("mean_residual_pct"),
                                                           F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- ranks and correlation

def varying(df: DataFrame, column: str) -> Column:
    """The column where it has any spread, else NULL.

    Spark's ``corr`` raises DIVIDE_BY_ZERO under ANSI mode when a column is
    constant (pandas returns NaN); feeding NULLs instead yields a NULL
    correlation.  The spread test is a scalar subquery (merged with its
    siblings into one aggregate)."""
    spread = df.agg(F.max(column) > F.min(column)).scalar()
    return F.when(spread, F.col(column))


def with_varying(df: DataFrame, columns) -> DataFrame:
    """Project every column through ``varying`` (in a projection, so inputs that are
    not deterministic, e.g. rank tables, are allowed) before aggregating."""
    return df.withColumns({c: varying(df, c) for c in dict.fromkeys(columns)})


def value_rank_table(df: DataFrame, value: str) -> DataFrame:
    """Per distinct value: count and rows at-or-below, as a distributed prefix sum.

    The distinct values are range-partitioned once and written, with the number
    of their range, to the shared folder; sums inside the ranges and the offsets of
    earlier ranges (one row each) both read that table, so they always agree,
    whatever is cached, merged or recomputed."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    ranged = materialize(counts.repartitionByRange(value).withColumn("_range", F.spark_partition_id()), "rank-ranges")
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("_range").agg(F.sum("_c").alias("_t"))
               .select("_range", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off")))
    return (ranged.withColumn("_inside", F.sum("_c").over(inside)).join(F.broadcast(offsets), "_range")
            .select(value, F.col("_c").alias("n_equal"), (F.col("_inside") + F.col("_off")).alias("n_at_or_below")))


def percentile_rank(df: DataFrame, value: str, out: str = "percentile_rank") -> DataFrame:
    """Share of rows with value <= x, in %, rounded half-even to 1 decimal (NULL for NULL x)."""
    ranks = value_rank_table(df, value)
    total = df.filter(F.col(value).isNotNull()).agg(F.count(F.lit(1))).scalar()
    r = ranks.select(value, (F.col("n_at_or_below") / total * 100).alias("_pr"))
    return df.join(r, value, "left").withColumn(out, F.bround("_pr", 1)).drop("_pr")


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank with ties sharing the average rank (1-based), via the distributed rank table."""
    ranks = value_rank_table(df, value).select(
        value, (F.col("n_at_or_below") - (F.col("n_equal") - 1) / 2.0).alias(out))
    return df.join(ranks, value, "left")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman rho = Pearson correlation of average ranks (pairs with both values).

    Average ranks always have mean (n + 1) / 2, so the correlation is computed
    in the same aggregate from Σ rx·ry, Σ rx², Σ ry² (ranks are half-integers:
    the products are exact); a constant column gives NULL instead of an error.
    """
    base = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(base, x, "_rx"), y, "_ry")
    g = ranked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_rx") * F.col("_ry")).alias("_sxy"),
                   F.sum(F.col("_rx") * F.col("_rx")).alias("_sxx"), F.sum(F.col("_ry") * F.col("_ry")).alias("_syy"))
    c = F.col("n") * ((F.col("n") + 1) / 2.0) * ((F.col("n") + 1) / 2.0)
    den = F.sqrt(F.nullif((F.col("_sxx") - c) * (F.col("_syy") - c), F.lit(0.0)))
    return g.select(((F.col("_sxy") - c) / den).alias("spearman"), "n")


def corr_to_target(df: DataFrame, columns, target: str, top: int = 20) -> DataFrame:
    """|Pearson| of every column against the target (pairwise complete), strongest first."""
    wide = with_varying(df, list(columns) + [target]).agg(*[F.corr(c, target).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = wide.selectExpr(f"stack({len(columns)}, {stack}) AS (feature, corr)")
    return (long.withColumn("abs_corr", F.abs("corr")).filter(F.col("corr").isNotNull())
            .orderBy(F.col("abs_corr").desc(), "feature").limit(top))


def corr_matrix(df: DataFrame, columns) -> DataFrame:
    """All pairwise Pearson correlations in one aggregate, as tidy (a, b, corr) rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = with_varying(df, columns).agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return wide.selectExpr(f"stack({len(pairs)}, {stack}) AS (feature_a, feature_b, corr)")


def performance_index(df: DataFrame, columns) -> DataFrame:
    """Mean of min-max scaled columns; a constant column scales to 0."""
    stats = df.agg(*[F.min(c).alias(f"_mn_{c}") for c in columns], *[F.max(c).alias(f"_mx_{c}") for c in columns])
    parts = []
    for c in columns:
        mn, mx = stats.select(f"_mn_{c}").scalar(), stats.select(f"_mx_{c}").scalar()
        parts.append(F.when(mx > mn, (F.col(c) - mn) / (mx - mn)).otherwise(F.lit(0.0)))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.withColumn("performance_index", total / len(columns))


def feature_stats(df: DataFrame, columns) -> DataFrame:
    """Mean and population std per feature (std 0 -> 1), tidy rows."""
    wide = df.agg(*[F.avg(c).alias(f"{c}__mean") for c in columns],
                  *[F.stddev_pop(c).alias(f"{c}__std") for c in columns])
    stack = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`" for c in columns)
    long = wide.selectExpr(f"stack({len(columns)}, {stack}) AS (feature, mean, std)")
    return long.withColumn("std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


# ---------------------------------------------------------------- distributions

def histogram(df: DataFrame, value, bins: int, name: str = "value") -> DataFrame:
    """Equal-width bins over [min, max]; the max lands in the last (closed) bin.

    bin = least(floor((v - min) / (max - min) * bins) + 1, bins); min and max
    are scalar subqueries.
    """
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(v.alias(name)).filter(F.col(name).isNotNull())
    mn = base.agg(F.min(name)).scalar()
    mx = base.agg(F.max(name)).scalar()
    b = F.when(mx > mn, F.least(F.floor((F.col(name) - mn) / (mx - mn) * bins) + 1, F.lit(bins))) \
         .otherwise(F.lit(1))
    return (base.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("lo", mn + (mx - mn) * (F.col("bin") - 1) / bins)
            .withColumn("hi", mn + (mx - mn) * F.col("bin") / bins))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """q1, median, q3 (exact), Tukey whiskers (extreme values inside 1.5 IQR) and outlier count."""
    q = group_quantiles(df, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    j = df.select(group, value).filter(F.col(value).isNotNull()).join(q, group)
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    v = F.col(value)
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(v >= lo_f, v)).alias("whisker_lo"),
        F.max(F.when(v <= hi_f, v)).alias("whisker_hi"),
        F.count_if((v < lo_f) | (v > hi_f)).alias("n_outliers"))


def violin_density(df: DataFrame, group: str, value: str, grid: int = 50, bins: int = 200,
                   bandwidth: float | None = None) -> DataFrame:
    """Binned Gaussian KDE per group on a fixed grid over the global [min, max].

    Values are first counted into ``bins`` equal-width bins per group (map-side
    partial aggregation); each non-empty bin then contributes to the ``grid``
    points through an ``explode`` of a fixed-size sequence, so the work is
    #groups x bins x grid regardless of the row count.
    """
    base = df.select(group, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    mn, mx = base.agg(F.min("_v")).scalar(), base.agg(F.max("_v")).scalar()
    sd = base.agg(F.stddev_samp("_v")).scalar()
    n_all = base.agg(F.count(F.lit(1))).scalar()
    h = F.lit(bandwidth) if bandwidth else 1.06 * sd * F.pow(n_all, F.lit(-0.2))
    width = (mx - mn) / bins
    b = F.least(F.floor((F.col("_v") - mn) / F.when(width > 0, width).otherwise(F.lit(1.0))), F.lit(bins - 1))
    binned = base.groupBy(group, b.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    center = mn + (F.col("_b") + 0.5) * width
    pts = binned.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))) \
                .withColumn("x", mn + (mx - mn) * F.col("_g") / (grid - 1))
    k = F.exp(-0.5 * ((F.col("x") - center) / h) ** 2) / (h * F.sqrt(F.lit(2 * 3.141592653589793)))
    dens = pts.groupBy(group, "_g", "x").agg(F.sum(F.col("_c") * k).alias("_s"), F.sum("_c").alias("_n"))
    tot = binned.groupBy(group).agg(F.sum("_c").alias("_tot"))
    return dens.join(tot, group).select(group, F.col("_g").alias("grid_index"), "x",
                                        (F.col("_s") / F.col("_tot")).alias("density"))


def cumulative_accuracy(df: DataFrame, err_pct: str, max_t: int = 100) -> DataFrame:
    """% of rows with |err| <= t for t = 0..max_t from one bucketed count + running sum."""
    total = df.filter(F.col(err_pct).isNotNull()).agg(F.count(F.lit(1))).scalar()
    e = F.abs(F.col(err_pct))
    b = df.filter(F.col(err_pct).isNotNull()).groupBy(F.ceil(e).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(0, max_t + 1).select(F.col("id").alias("t"))
    cum = grid.join(b, "t", "left").fillna(0, ["n"]).withColumn(
        "_cum", F.sum("n").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    return cum.select("t", (F.col("_cum") / total * 100).alias("pct_within"))


def tolerance_curve(df: DataFrame, spec: PanelSpec, steps: int = 10, step: float = 0.05) -> DataFrame:
    """Range accuracy for tol = 0, step, ..., steps*step from one pass over distances."""
    base = df.filter(F.col(spec.target).isNotNull() & F.col(spec.low).isNotNull())
    total = base.agg(F.count(F.lit(1))).scalar()
    d = range_distance_pct(spec.target, spec.low, spec.high)
    # the smallest grid index i with d <= i*step; > steps means never inside
    idx = F.when(d <= 0, F.lit(0)).otherwise(F.ceil(d / step - 1e-12))
    b = base.groupBy(idx.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(0, steps + 1).select(F.col("id").alias("i"))
    cum = grid.join(b, "i", "left").fillna(0, ["n"]).withColumn(
        "_cum", F.sum("n").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return cum.select((F.col("i") * step).alias("tolerance"), (F.col("_cum") / total * 100).alias("range_accuracy_pct"))


def systematic_sample(df: DataFrame, order: str, key: str, target_points: int = 80) -> DataFrame:
    """Every n-th row in (order, key) order, n = max(1, N // target_points).

    The global row number comes from the distributed prefix-sum rank table,
    so no single-partition window over the raw rows runs.
    """
    n_all = df.agg(F.count(F.lit(1))).scalar()
    step = F.greatest(F.lit(1), F.floor(n_all / target_points))
    ordered = df.withColumn("_ord", F.struct(F.col(order), F.col(key)))
    ranks = value_rank_table(ordered, "_ord")
    r = ordered.join(ranks, "_ord").withColumn("_rn", F.col("n_at_or_below") - 1)
    return r.filter(F.col("_rn") % step == 0).drop("_ord", "n_equal", "n_at_or_below", "_rn")
