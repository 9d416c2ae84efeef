"""Association of features with a target, per group: correlations, trends, evidence, mutual information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldgrain.functions.semantics import null_safe_join, ratio, share
from fieldgrain.operators.metrics import _join, kendall, rank_correlations
from fieldgrain.operators.order_stats import equal_count_bins, percentiles
from fieldgrain.session import cut_lineage


def long_features(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """One row per (row, feature) with columns keys, feature_name, x, y; pairs with a missing side are left out."""
    entries = F.array(
        *[F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias("x")) for f in features]
    )
    long = rows.select(*keys, F.col(target).cast("double").alias("y"), F.explode(entries).alias("_e"))
    return long.select(*keys, "_e.*", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull())


def association(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, *, minimum: int = 3,
                with_kendall: bool = True) -> DataFrame:
    """Ranges, Pearson, Spearman, Kendall and a linear fit for every group and feature.

    Coefficients are NULL where a group is too small or one side is constant.
    """
    by = [*keys, "feature_name"]
    long = long_features(rows, keys, features, target)
    base = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.min("x").alias("feature_min"),
        F.max("x").alias("feature_max"),
        F.avg("x").alias("feature_mean"),
        F.stddev_samp("x").alias("feature_std"),
        F.min("y").alias("q_min"),
        F.max("y").alias("q_max"),
        F.avg("y").alias("q_mean"),
        F.stddev_samp("y").alias("q_std"),
        F.corr("x", "y").alias("pearson_r"),
        F.regr_slope("y", "x").alias("linear_slope"),
        F.regr_intercept("y", "x").alias("linear_intercept"),
        F.regr_r2("y", "x").alias("linear_R2"),
        F.sqrt(F.greatest(F.regr_syy("y", "x") - F.regr_slope("y", "x") * F.regr_sxy("y", "x"), F.lit(0.0)) / F.count(F.lit(1))).alias("linear_RMSE"),
    )
    doubles = {f: F.col(f).cast("double") for f in features}
    parts = [base, rank_correlations(rows, keys, doubles, F.col(target).cast("double"), "spearman_rho")]
    if with_kendall:
        parts.append(kendall(long, by, "x", "y", "kendall_tau"))
    out = _join(parts, by)
    varied = (
        (F.col("n_valid") >= minimum) & (F.col("feature_max") > F.col("feature_min")) & (F.col("q_max") > F.col("q_min"))
    )
    tested = {"pearson_r", "spearman_rho", "kendall_tau", "linear_slope", "linear_intercept", "linear_R2", "linear_RMSE"}
    return out.select(*[F.when(varied, F.col(c)).alias(c) if c in tested else F.col(c) for c in out.columns])


def binned_trend(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, bins: int,
                 mode: str = "equal_count", tie: Sequence[str] = (), *, few_groups: bool = False) -> DataFrame:
    """Feature and target statistics in equal-count or equal-width feature bins.

    ``few_groups``: the caller bounds the number of groups, so that their limits reach the rows without a shuffle by group.
    """
    by = [*keys, "feature_name"]
    long = long_features(rows.select(*dict.fromkeys([*keys, *features, target, *tie])), [*keys, *tie], features, target)
    if mode == "equal_count":
        placed = equal_count_bins(long, by, "x", tie or ["y"], bins, "bin_number", few_groups=few_groups)
    elif mode == "equal_width":
        limits = long.groupBy(*by).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
        placed = null_safe_join(long, F.broadcast(limits) if few_groups else limits, by)
        width = F.col("_hi") - F.col("_lo")
        number = F.when(width <= 0, 1).otherwise(
            F.least(F.floor((F.col("x") - F.col("_lo")) / width * bins) + 1, F.lit(bins))
        )
        placed = placed.withColumn("bin_number", number.cast("int"))
    else:
        raise ValueError("mode must be equal_count or equal_width")
    cell = [*by, "bin_number"]
    base = placed.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_bin"),
        F.avg("x").alias("feature_mean"),
        F.min("x").alias("feature_min"),
        F.max("x").alias("feature_max"),
        F.avg("y").alias("q_mean"),
        F.stddev_samp("y").alias("q_std"),
        F.min("y").alias("q_min"),
        F.max("y").alias("q_max"),
    )
    medians = [percentiles(placed, cell, v, {n: 0.5}, few_groups=few_groups) for v, n in (("x", "feature_median"), ("y", "q_median"))]
    return _join([base, *medians], cell)


# Rank-correlation levels and the shares a decision needs.
LEVELS = {"weak": 0.30, "moderate": 0.50, "strong": 0.70}


def evidence(assoc: DataFrame, *, minimum_n: int = 6, minimum_groups: int = 4, levels: dict[str, float] = LEVELS) -> DataFrame:
    """Per feature: how strong, how consistent in sign, and a decision with its recommendation."""
    # A short table (one row per group and feature) that is read several times below.
    assoc = cut_lineage(assoc.select("feature_name", "n_valid", "spearman_rho", "linear_R2"))
    rho = F.col("spearman_rho")
    valid = assoc.withColumn("_ok", rho.isNotNull() & (F.col("n_valid") >= minimum_n))
    ok = valid.where("_ok")
    size = F.abs(rho)
    counts = valid.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n_total_groups"), F.count_if("_ok").alias("n_valid_groups")
    )
    shares = ok.groupBy("feature_name").agg(
        F.avg(rho).alias("mean_spearman"),
        F.avg(size).alias("mean_abs_spearman"),
        share(size >= levels["weak"]).alias("frac_weak_or_better"),
        share(size >= levels["moderate"]).alias("frac_moderate_or_better"),
        share(size >= levels["strong"]).alias("frac_strong"),
        share(rho > 0).alias("frac_positive"),
        share(rho < 0).alias("frac_negative"),
    )
    sized = ok.withColumn("_abs", size)
    medians = [
        percentiles(sized, ["feature_name"], c, {n: 0.5})
        for c, n in (("spearman_rho", "median_spearman"), ("_abs", "median_abs_spearman"), ("linear_R2", "median_linear_R2"))
    ]
    out = _join([counts, shares, *medians], ["feature_name"])
    positive, negative = F.col("frac_positive"), F.col("frac_negative")
    out = out.select(
        "*",
        F.greatest(positive, negative).alias("direction_consistency"),
        F.when(positive >= negative, "positive").when(negative > positive, "negative").otherwise("undefined").alias(
            "dominant_direction"
        ),
    )
    med, consistent = F.col("median_abs_spearman"), F.col("direction_consistency")
    decision = (
        F.when(F.col("n_valid_groups") == 0, "NO: insufficient valid groups")
        .when(F.col("n_valid_groups") < minimum_groups, "NO: insufficient groups")
        .when((med >= levels["strong"]) & (F.col("frac_strong") >= 0.5) & (consistent >= 0.8), "YES: strong consistent association")
        .when(
            (med >= levels["moderate"]) & (F.col("frac_moderate_or_better") >= 0.6) & (consistent >= 0.75),
            "YES: moderate consistent association",
        )
        .when((med >= levels["weak"]) & (F.col("frac_weak_or_better") >= 0.5), "MAYBE: weak or mixed association")
        .otherwise("NO: no consistent association")
    )
    return out.select(
        "*",
        (med * F.col("frac_moderate_or_better") * consistent).alias("evidence_score"),
        decision.alias("summary_decision"),
    )


def quantile_bin(rows: DataFrame, keys: Sequence[str], value: str, bins: int, out: str, *, few_groups: bool = False) -> DataFrame:
    """Bin of each row between exact quantile edges; the outer bins are open, repeated edges collapse.

    ``few_groups``: the caller bounds the number of groups, so that their edges reach the rows without a shuffle by group.
    """
    points = {f"_e{i}": i / bins for i in range(1, bins)}
    edges = percentiles(rows, keys, value, points, few_groups=few_groups)
    edges = edges.select(*keys, F.array_distinct(F.array(*points)).alias("_edges"))
    edges = F.broadcast(edges) if few_groups else edges
    joined = null_safe_join(rows, edges, keys, "left") if keys else rows.crossJoin(F.broadcast(edges))  # one row
    index = F.size(F.filter("_edges", lambda e: e <= F.col(value))) + 1
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), index)).drop("_edges")


def quantile_label(index: Column, bins: int) -> Column:
    """Q1..Qn for a quantile bin, ``unknown`` for a missing value."""
    return F.when(index.isNull(), "unknown").otherwise(F.concat(F.lit("Q"), F.least(index, F.lit(bins)).cast("string")))


def mutual_information(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, bins: int) -> DataFrame:
    """Discretised mutual information of each feature with the target over quantile bins."""
    by = [*keys, "feature_name"]
    long = long_features(rows, keys, features, target)
    few = not keys  # the groups are the features
    placed = quantile_bin(long, by, "x", bins, "_xb", few_groups=few)
    placed = quantile_bin(placed, by, "y", bins, "_yb", few_groups=few)
    joint = placed.groupBy(*by, "_xb", "_yb").agg(F.count(F.lit(1)).alias("_n"))
    px = joint.groupBy(*by, "_xb").agg(F.sum("_n").alias("_nx"))
    py = joint.groupBy(*by, "_yb").agg(F.sum("_n").alias("_ny"))
    total = joint.groupBy(*by).agg(F.sum("_n").alias("_t"))
    cells = null_safe_join(null_safe_join(null_safe_join(joint, px, [*by, "_xb"]), py, [*by, "_yb"]), total, by)
    term = F.col("_n") / F.col("_t") * F.log(F.col("_n") * F.col("_t") / (F.col("_nx") * F.col("_ny")))
    return cells.groupBy(*by).agg(F.sum(term).alias("mutual_information"), F.max("_t").alias("N"))


def feature_audit(rows: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Rank correlation, mutual information, missing share and distinct values of each feature."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias("x")) for f in features])
    every = rows.select(F.explode(entries).alias("_e")).select("_e.*")
    values = every.groupBy("feature_name", "x").agg(F.count(F.lit(1)).alias("_n"))
    base = values.groupBy("feature_name").agg(
        F.count("x").alias("distinct_values"),
        (F.lit(100.0) * ratio(F.sum(F.when(F.col("x").isNull(), F.col("_n")).otherwise(0)), F.sum("_n"))).alias("missing_pct"),
    )
    doubles = {f: F.col(f).cast("double") for f in features}
    rho = rank_correlations(rows, [], doubles, F.col(target).cast("double"), "spearman_rho")
    mi = mutual_information(rows, [], features, target, bins).drop("N")
    return _join([base, rho, mi], ["feature_name"])


def correlation_ranking(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features by absolute Pearson correlation with an error column."""
    long = long_features(rows, [], features, target)
    return long.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("N"), F.corr("x", "y").alias("pearson_r"), F.abs(F.corr("x", "y")).alias("abs_r")
    ).orderBy(F.desc("abs_r"))


def step_summary(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, median, spread and range of the target and every feature per condition and step."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        aggs += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
        ]
    parts = [rows.groupBy(*keys).agg(*aggs)]
    parts += [percentiles(rows, keys, c, {f"{c}_median": 0.5}) for c in columns]
    return _join(parts, keys)


def condition_summary(steps: DataFrame, keys: Sequence[str], x: str, columns: Sequence[str]) -> DataFrame:
    """Spread of the step means per condition and their regression on the step variable (NULL below two distinct x)."""
    aggs = [F.count(F.lit(1)).alias("n_steps")]
    for c in columns:
        m = f"{c}_mean"
        several = F.max(x) > F.min(x)
        aggs += [
            F.avg(m).alias(f"{c}_mean_over_steps"),
            F.stddev_samp(m).alias(f"{c}_std_over_steps"),
            F.when(several, F.regr_slope(m, x)).alias(f"{c}_slope"),
            F.when(several, F.regr_r2(m, x)).alias(f"{c}_r2"),
        ]
    return steps.groupBy(*keys).agg(*aggs)
