"""Grouped error metrics of quantile, speed and purity predictions.

All aggregates combine on the map side; percentiles come from
:mod:`fieldgrain.operators.order_stats`, so no group has to fit one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgrain.functions.semantics import EPS, finite, null_safe_join, percent, ratio, require_columns, share
from fieldgrain.operators.order_stats import (
    percentiles,
    row_positions,
    running_totals,
)

ABS_ERROR = "cs_absolute_error_percent"


def _join(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Join small per-group results; frames without keys have one row each."""
    if not keys:
        return reduce(lambda a, b: a.crossJoin(b), parts)  # one row by one row
    return reduce(lambda a, b: null_safe_join(a, b, keys, "left"), parts)


def mae(e: str | Column) -> Column:
    return F.avg(F.abs(e))


def rmse(e: str | Column) -> Column:
    c = F.col(e) if isinstance(e, str) else e
    return F.sqrt(F.avg(c * c))


def quantile_metrics(rows: DataFrame, keys: Sequence[str], truth: str = "q_true", pred: str = "q_pred") -> DataFrame:
    """Counts, MAE, RMSE, bias, median and maximum absolute error of a predicted quantile."""
    require_columns(rows, [*keys, truth, pred], "predictions")
    e = rows.withColumn("_e", finite(pred) - finite(truth)).withColumn("_ae", F.abs("_e"))
    base = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("_e").alias("valid_row_count"),
        F.avg("_ae").alias("q_mae"),
        rmse("_e").alias("q_rmse"),
        F.avg("_e").alias("q_bias"),
        F.max("_ae").alias("q_max_ae"),
    )
    return _join([base, percentiles(e, keys, "_ae", {"q_median_ae": 0.5})], keys)


def speed_columns() -> dict[str, Column]:
    """Mean-type speed metrics over already valid rows."""
    ape = F.col(ABS_ERROR)
    return {
        "sws_mae_m_s": mae("cs_error_m_s"),
        "sws_rmse_m_s": rmse("cs_error_m_s"),
        "sws_bias_m_s": F.avg("cs_error_m_s"),
        "sws_mape": F.avg(ape),
        "sws_bias_percent": F.avg("cs_error_percent"),
        "sws_error_gt5_pct": percent(ape > 5),
        "sws_error_gt10_pct": percent(ape > 10),
        "sws_error_gt20_pct": percent(ape > 20),
        "sws_underestimate_pct": percent(F.col("cs_error_percent") < 0),
    }


def speed_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All speed metrics by any group columns; invalid rows count as rows but not in the errors."""
    require_columns(rows, [*keys, "cs_error_m_s", "cs_error_percent", ABS_ERROR, "sws_valid"], "predictions")
    valid = rows.where("sws_valid")
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if("sws_valid").alias("valid_row_count")
    )
    errors = valid.groupBy(*keys).agg(
        *[c.alias(n) for n, c in speed_columns().items()], F.max(ABS_ERROR).alias("sws_max_ape")
    )
    ranks = percentiles(valid, keys, ABS_ERROR, {"sws_median_ape": 0.5, "sws_p90_ape": 0.9, "sws_p95_ape": 0.95})
    return _join([counts, errors, ranks], keys)


def run_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-run prediction level, spread (0 for one patch) and speed errors."""
    valid = rows.where("sws_valid")
    base = valid.groupBy(*keys).agg(
        F.count("cs_pred_m_s").alias("patch_count"),
        F.avg("cs_true_m_s").alias("cs_true_mean_m_s"),
        F.avg("cs_pred_m_s").alias("cs_pred_mean_m_s"),
        F.coalesce(F.stddev_samp("cs_pred_m_s"), F.lit(0.0)).alias("cs_pred_std_m_s"),
        F.min("cs_pred_m_s").alias("cs_pred_min_m_s"),
        F.max("cs_pred_m_s").alias("cs_pred_max_m_s"),
        mae("cs_error_m_s").alias("sws_mae_m_s"),
        rmse("cs_error_m_s").alias("sws_rmse_m_s"),
        F.avg("cs_error_m_s").alias("sws_bias_m_s"),
        F.avg(ABS_ERROR).alias("sws_mape"),
        F.avg("cs_error_percent").alias("sws_bias_percent"),
    )
    return _join([base, percentiles(valid, keys, "cs_pred_m_s", {"cs_pred_median_m_s": 0.5})], keys)


def purity_metrics(rows: DataFrame, keys: Sequence[str], truth: str, pred: str) -> DataFrame:
    e = rows.withColumn("_e", finite(pred) - finite(truth)).withColumn("_ae", F.abs("_e"))
    base = e.groupBy(*keys).agg(
        F.count("_e").alias("valid_row_count"),
        F.avg("_ae").alias("purity_mae"),
        rmse("_e").alias("purity_rmse"),
        F.avg("_e").alias("purity_bias"),
    )
    ranks = percentiles(e, keys, "_ae", {"purity_median_ae": 0.5, "purity_p90_ae": 0.9, "purity_p95_ae": 0.95})
    return _join([base, ranks], keys)


def grouping_rows(rows: DataFrame, groupings: Mapping[str, Sequence[str]], width: int) -> DataFrame:
    """One copy of a row per grouping, keyed by table name and text levels (the GROUPING SETS expansion)."""
    entries = []
    types = dict(rows.dtypes)
    for name, columns in groupings.items():
        levels = [F.col(c) if types[c] == "string" else F.col(c).cast("string") for c in columns] + [F.lit(None).cast("string")] * (width - len(columns))
        entries.append(
            F.struct(F.lit(name).alias("table_name"), *[v.alias(f"level_{i + 1}") for i, v in enumerate(levels)])
        )
    return rows.withColumn("_g", F.explode(F.array(*entries))).select("*", "_g.*").drop("_g")


def grouped_tables(
    rows: DataFrame, groupings: Mapping[str, Sequence[str]], extra: Sequence[str] = (), *, few_groups: bool = False
) -> DataFrame:
    """Sixteen quantile and speed measures for many one- and two-way groupings in one scan of the rows.

    ``few_groups``: the caller bounds the number of groups, so that no copy of a row is shuffled for its percentiles.
    """
    width = max(len(c) for c in groupings.values())
    keys = ["table_name", *extra, *[f"level_{i + 1}" for i in range(width)]]
    used = sorted({c for columns in groupings.values() for c in columns} | set(extra))
    # Group columns become text once per row, not once per grouping.
    valid = rows.where("sws_valid").select(
        *[F.col(c).cast("string").alias(c) for c in used],
        (F.col("q_pred") - F.col("q_true")).alias("q_error"),
        "cs_error_m_s",
        "cs_error_percent",
        ABS_ERROR,
    )
    long = grouping_rows(valid, groupings, width).withColumn("_aq", F.abs("q_error"))
    base = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg("_aq").alias("q_mae"),
        rmse("q_error").alias("q_rmse"),
        F.avg("q_error").alias("q_bias"),
        *[c.alias(n) for n, c in speed_columns().items()],
    )
    ranks = percentiles(long, keys, ABS_ERROR, {"sws_median_ape": 0.5, "sws_p90_ape": 0.9}, few_groups=few_groups)
    medians = percentiles(long, keys, "_aq", {"q_median_ae": 0.5}, few_groups=few_groups)
    return _join([base, medians, ranks], keys)


def external_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ten transfer measures over valid rows."""
    valid = rows.where("sws_valid").withColumn("q_error", F.col("q_pred") - F.col("q_true"))
    wanted = ("sws_mae_m_s", "sws_rmse_m_s", "sws_mape", "sws_bias_percent")
    base = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("patch_count"),
        mae("q_error").alias("q_mae"),
        rmse("q_error").alias("q_rmse"),
        F.avg("q_error").alias("q_bias"),
        *[c.alias(n) for n, c in speed_columns().items() if n in wanted],
    )
    ranks = percentiles(valid, keys, ABS_ERROR, {"sws_median_ape": 0.5, "sws_p90_ape": 0.9})
    return _join([base, ranks], keys)


def validity_fraction(rows: DataFrame, keys: Sequence[str], flag: str = "sws_valid") -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(flag).alias("valid_row_count"),
        share(F.col(flag)).alias("valid_fraction"),
    )


def weighted_mean(summary: DataFrame, keys: Sequence[str], metric: str, weight: str) -> DataFrame:
    """Mean of a per-group metric, weighted by the group's row count."""
    return summary.groupBy(*keys).agg(
        F.sum(weight).alias(weight), ratio(F.sum(F.col(metric) * F.col(weight)), F.sum(weight)).alias(metric)
    )


def worst_predictions(rows: DataFrame, n: int, columns: Sequence[str]) -> DataFrame:
    """The ``n`` largest absolute percentage errors; ties by example id."""
    return rows.where("sws_valid").orderBy(F.desc(ABS_ERROR), "example_id").limit(n).select(*columns)


def outlier_flags(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fixed-threshold and group-percentile outlier flags on every row."""
    limits = percentiles(rows, keys, ABS_ERROR, {"_p95": 0.95, "_p99": 0.99})
    ape = F.col(ABS_ERROR)
    return (
        null_safe_join(rows, limits, keys, "left")
        .select(
            "*",
            (ape > 10).alias("is_high_error_10"),
            (ape > 20).alias("is_high_error_20"),
            (ape >= F.col("_p95")).alias("is_top5_error"),
            (ape >= F.col("_p99")).alias("is_top1_error"),
        )
        .drop("_p95", "_p99")
    )


def outlier_rates(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    base = flagged.groupBy(*keys).agg(
        F.count(ABS_ERROR).alias("N"),
        F.avg(ABS_ERROR).alias("MAPE_pct"),
        percent(F.col("is_high_error_10")).alias("high_error_gt10_pct"),
        percent(F.col("is_high_error_20")).alias("high_error_gt20_pct"),
        percent(F.col("is_top5_error")).alias("top5_error_pct"),
        percent(F.col("is_top1_error")).alias("top1_error_pct"),
    )
    ranks = percentiles(flagged, keys, ABS_ERROR, {"median_abs_error_pct": 0.5, "p95_abs_error_pct": 0.95})
    return _join([base, ranks], keys)


def hotspots_and_controls(rows: DataFrame, fraction: float) -> DataFrame:
    """The worst ``ceil(fraction * n)`` rows, and as many controls spread evenly over the rows below the median.

    Rows count if ``sws_valid`` and their error is finite. Equal errors go by ``example_id``. Controls stand at
    ``round(linspace(1, pool, count))`` of the pool ordered by ``cx, cz, example_id``; one control is the pool's last row.
    A pool smaller than the number of hotspots is an error. Ranks are summed from counts per map column and position:
    a window holds the distinct columns, the positions of a column or the rows of a position, never all rows.
    """
    error = F.col(ABS_ERROR)
    valid = rows.where(F.col("sws_valid") & (F.abs(error) < float("inf")))
    # the value that holds the last hotspot, and the rows above it
    atoms = running_totals(valid.select(ABS_ERROR), [], ABS_ERROR, descending=True)
    wanted = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("n_total")))
    above = F.col("n_upto") - F.col("n")
    limits = atoms.where((above < wanted) & (wanted <= F.col("n_upto"))).select(wanted.alias("_hot"), error.alias("_cut"), above.alias("_above"))
    median = percentiles(valid, [], ABS_ERROR, {"_median": 0.5})
    facts = limits.crossJoin(median)  # one row each
    known = valid.crossJoin(F.broadcast(facts))
    tie = F.row_number().over(Window.partitionBy(ABS_ERROR).orderBy("example_id"))
    tied = known.where(error == F.col("_cut")).withColumn("_tie", tie).where(F.col("_tie") <= F.col("_hot") - F.col("_above"))
    hot = known.where(error > F.col("_cut")).unionByName(tied.drop("_tie"))

    pool = known.where(error < F.col("_median"))
    cells = pool.groupBy("cx", "cz").agg(F.count("*").alias("_n"))
    columns = cells.groupBy("cx").agg(F.sum("_n").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everything = Window.partitionBy(F.lit(0))
    columns = columns.select(F.col("cx").alias("_cx"), before(everything.orderBy("cx")).alias("_left"), F.sum("_n").over(everything).alias("_pool"))
    cells = cells.withColumn("_below", before(Window.partitionBy("cx").orderBy("cz")))
    cells = cells.join(columns, F.col("cx").eqNullSafe(F.col("_cx"))).select("_cx", F.col("cz").alias("_cz"), F.expr("_left + _below").alias("_start"), "_pool")
    inside = F.row_number().over(Window.partitionBy("cx", "cz").orderBy("example_id"))
    met = F.col("cx").eqNullSafe(F.col("_cx")) & F.col("cz").eqNullSafe(F.col("_cz"))
    ranked = pool.withColumn("_inside", inside).join(cells, met).withColumn("_at", F.expr("_start + _inside"))
    step = (F.col("_pool") - 1) / F.greatest(F.col("_hot") - 1, F.lit(1)).cast("double")
    # Steps are at least 1, so positions differ; position p is taken when a j near (p - 1) / step has round(1 + j*step) = p.
    near = F.floor((F.col("_at") - 1) / F.greatest(step, F.lit(1.0)))
    taken = F.lit(False)
    for shift in (-1, 0, 1, 2):
        j = near + shift
        taken = taken | ((j >= 0) & (j < F.col("_hot")) & (F.round(1 + j * step) == F.col("_at")))
    short = F.raise_error(F.lit("fewer rows below the median than hotspots")).cast("boolean")
    chosen = F.when(F.col("_pool") < F.col("_hot"), short).when(F.col("_hot") == 1, F.col("_at") == F.col("_pool")).otherwise(taken)
    group = lambda df, name: df.select(*rows.columns, F.lit(name).alias("selection_group"))
    return group(hot, "hotspot").unionByName(group(ranked.where(chosen), "control"))


def support_occupancy(rows: DataFrame, keys: Sequence[str], bin_column: str, split: str = "partition") -> DataFrame:
    """How much training data a bin holds, next to the test error in the same bin."""
    train = F.col(split) == "train"
    counts = rows.groupBy(*keys, bin_column).agg(
        F.count_if(train).alias("N_train"),
        F.count_if(~train).alias("N_test"),
        F.avg(F.when(~train, F.col(ABS_ERROR))).alias("test_MAPE_pct"),
        F.lit(100.0).__mul__(F.avg(F.when(~train, (F.col(ABS_ERROR) > 20).cast("double")))).alias("test_gt20_pct"),
    )
    totals = counts.groupBy(*keys).agg(F.sum("N_train").alias("_train"), F.sum("N_test").alias("_test"))
    return (
        _join([counts, totals], keys)
        .withColumn("train_fraction", ratio(F.col("N_train"), F.col("_train")))
        .withColumn("test_fraction", ratio(F.col("N_test"), F.col("_test")))
        .drop("_train", "_test")
    )


def gain_vs_baseline(summary: DataFrame, keys: Sequence[str], variant: str, baseline: str, metric: str) -> DataFrame:
    """Difference and relative gain of each variant's metric against the baseline variant of the same group."""
    base = summary.where(F.col(variant) == baseline).select(*keys, F.col(metric).alias("baseline_value"))
    joined = null_safe_join(summary, base, keys, "left") if keys else summary.crossJoin(F.broadcast(base))  # one row
    return joined.select(
        *keys,
        variant,
        F.col(metric),
        "baseline_value",
        (F.col(metric) - F.col("baseline_value")).alias("delta"),
        (F.lit(100.0) * ratio(F.col("baseline_value") - F.col(metric), F.col("baseline_value"))).alias("gain_pct"),
    )


def spearman(
    rows: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "spearman"
) -> DataFrame:
    """Rank correlation; tied values share their mean rank."""
    return _feature_correlations(rows, keys, {x: F.col(x)}, F.col(y), out).drop("_feature")


def rank_correlations(rows: DataFrame, keys: Sequence[str], features: Mapping[str, Column], target: Column, out: str) -> DataFrame:
    """Rank correlation of each feature with the target: columns keys, feature_name, ``out``.

    A feature counts the rows that have it and the target. Values of the target are ranked once for all features, by
    one count per feature. Rows then meet the ranks of their target and are summed by value of the feature.
    """
    return _feature_correlations(rows, keys, features, target, out).select(*keys, F.col("_feature").alias("feature_name"), out)


def _feature_correlations(rows: DataFrame, keys: Sequence[str], features: Mapping[str, Column], target: Column, out: str) -> DataFrame:
    """:func:`rank_correlations` with the feature in ``_feature``, so that a key may be called ``feature_name``."""
    by = list(keys) or ["_all"]
    x = {name: f"_x{i}" for i, name in enumerate(features)}
    base = rows.select(*(keys or [F.lit(0).alias("_all")]), *[c.alias(x[f]) for f, c in features.items()], target.alias("_y"))
    base = base.where(F.col("_y").isNotNull())
    counts = {f"_n{c}": F.count(c) for c in x.values()}

    def centred(n: str) -> Column:
        """The mean rank of a value less that of its group."""
        return F.col(f"{n}_upto") - (F.col(n) - 1) / 2.0 - (F.col(f"{n}_total") + 1) / 2.0

    ranks = running_totals(base, by, "_y", counts).select(*by, "_y", *[centred(f"_n{c}").alias(f"_d{c}") for c in x.values()])
    entries = [F.struct(F.lit(f).alias("_feature"), F.col(c).alias("_x"), F.col(f"_d{c}").alias("_d")) for f, c in x.items()]
    placed = null_safe_join(base, ranks, [*by, "_y"]).select(*by, F.explode(F.array(*entries)).alias("_e")).select(*by, "_e.*")
    by = [*by, "_feature"]
    d = F.col("_d")
    sums = placed.where(F.col("_x").isNotNull()).groupBy(*by, "_x").agg(F.sum(d).alias("_dy"), F.sum(d * d).alias("_dyy"))
    long = base.select(*by[:-1], F.explode(F.array(*[F.struct(F.lit(f).alias("_feature"), F.col(c).alias("_x")) for f, c in x.items()])).alias("_e"))
    places = running_totals(long.select(*by[:-1], "_e.*"), by, "_x", {"_n": F.count(F.lit(1))})
    dx = centred("_n")
    tested = null_safe_join(places, sums, [*by, "_x"]).groupBy(*by).agg(
        ratio(F.sum(dx * F.col("_dy")), F.sqrt(F.sum(F.col("_n") * dx * dx)) * F.sqrt(F.sum("_dyy"))).alias(out)
    )
    return tested.select(*keys, "_feature", out)


def kendall(
    rows: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "kendall"
) -> DataFrame:
    """Tau-b without comparing pairs of rows.

    Equal (x, y) are counted first. Dense ranks of x are then read bit by bit:
    two values first differ at exactly one bit, so for every bit a running
    count by y inside a block of equal higher bits finds the pairs that this
    bit orders. Work is (distinct cells) * log2(distinct x), spread by block.
    """
    keys = list(keys)
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    base = both if keys else both.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    cells = base.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_w"))
    dense = running_totals(cells.select(*by, x).distinct(), by, x).select(*by, x, (F.col("n_upto") - 1).alias("_rank"), F.col("n_total").alias("_levels"))
    placed = null_safe_join(cells, dense, [*by, x])
    bits = F.ceil(F.log2(F.greatest(F.col("_levels"), F.lit(2)).cast("double"))).cast("int")
    long = (
        placed.withColumn("_bit", F.explode(F.sequence(F.lit(0), bits)))
        .withColumn("_block", F.expr("shiftright(_rank, _bit + 1)"))
        .withColumn("_high", F.expr("shiftright(_rank, _bit) & 1"))
        .groupBy(*by, "_bit", "_block", y)
        .agg(
            F.sum(F.when(F.col("_high") == 1, F.col("_w")).otherwise(0)).alias("_hi"),
            F.sum(F.when(F.col("_high") == 0, F.col("_w")).otherwise(0)).alias("_lo"),
        )
        .where(F.col(y).isNotNull())
    )
    ordered = running_totals(long, [*by, "_bit", "_block"], y, {"hi": F.sum("_hi"), "lo": F.sum("_lo")})
    signed = ordered.groupBy(*by).agg(
        F.sum(F.col("hi") * (F.col("lo_upto") - F.col("lo"))).cast("double").alias("_c"),
        F.sum(F.col("lo") * (F.col("hi_upto") - F.col("hi"))).cast("double").alias("_d"),
    )

    def pairs(c: Column) -> Column:
        return (c.cast("double") * (c - 1).cast("double")) / 2.0

    tx = cells.groupBy(*by, x).agg(F.sum("_w").alias("_m")).groupBy(*by).agg(F.sum(pairs(F.col("_m"))).alias("_tx"))
    ty = cells.groupBy(*by, y).agg(F.sum("_w").alias("_m")).groupBy(*by).agg(F.sum(pairs(F.col("_m"))).alias("_ty"))
    n = cells.groupBy(*by).agg(pairs(F.sum("_w")).alias("_n0"))
    tau = ratio(
        F.col("_c") - F.col("_d"),
        F.sqrt(F.col("_n0") - F.col("_tx")) * F.sqrt(F.col("_n0") - F.col("_ty")),
    )
    return _join([signed, tx, ty, n], by).select(*keys, tau.alias(out))


def error_table(rows: DataFrame, keys: Sequence[str], truth: str, pred: str) -> DataFrame:
    """MAE, RMSE, bias, residual spread, p90, R2, Pearson, Spearman, shares over and under."""
    e = rows.select(*keys, finite(truth).alias("_t"), finite(pred).alias("_p")).where("_t is not null and _p is not null")
    e = e.withColumn("_e", F.col("_p") - F.col("_t")).withColumn("_ae", F.abs("_e"))
    base = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("N"),
        F.avg("_ae").alias("mae"),
        rmse("_e").alias("rmse"),
        F.avg("_e").alias("bias"),
        F.stddev_samp("_e").alias("residual_std"),
        (F.lit(1.0) - ratio(F.sum(F.col("_e") * F.col("_e")), F.var_pop("_t") * F.count(F.lit(1)))).alias("r2"),
        F.corr("_t", "_p").alias("pearson"),
        share(F.col("_e") > 0).alias("over_fraction"),
        share(F.col("_e") < 0).alias("under_fraction"),
    )
    return _join([base, percentiles(e, keys, "_ae", {"p90_abs_error": 0.9}), spearman(e, keys, "_t", "_p")], keys)


def method_errors(rows: DataFrame, keys: Sequence[str], truth: str, pred: str) -> DataFrame:
    """RMSE, MAE, Spearman and the distribution of absolute percentage error per method."""
    e = rows.select(*keys, finite(truth).alias("_t"), finite(pred).alias("_p")).where("_t is not null and _p is not null")
    e = e.withColumn("_e", F.col("_p") - F.col("_t")).withColumn(
        "_ape", F.lit(100.0) * F.abs(ratio(F.col("_e"), F.col("_t")))
    )
    base = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("N"),
        rmse("_e").alias("rmse"),
        mae("_e").alias("mae"),
        F.avg("_ape").alias("mean_ape"),
        F.max("_ape").alias("max_ape"),
    )
    ranks = percentiles(e, keys, "_ape", {"median_ape": 0.5, "p75_ape": 0.75, "p90_ape": 0.9})
    return _join([base, ranks, spearman(e, keys, "_t", "_p")], keys)


def roi_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Level, spread, coefficient of variation and errors per region of interest."""
    return rows.groupBy(*keys).agg(
        F.count("cs_pred_m_s").alias("N"),
        F.avg("cs_pred_m_s").alias("mean_m_s"),
        F.stddev_samp("cs_pred_m_s").alias("std_m_s"),
        ratio(F.lit(100.0) * F.stddev_samp("cs_pred_m_s"), F.avg("cs_pred_m_s")).alias("cv_pct"),
        F.avg("cs_error_m_s").alias("bias_m_s"),
        F.avg(ABS_ERROR).alias("mape"),
        percent(F.col(ABS_ERROR) > 20).alias("gt20_pct"),
    )


def high_error_rates(rows: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(ABS_ERROR).alias("N"), percent(F.col(ABS_ERROR) > threshold).alias("high_error_pct")
    )


def two_level_spread(rows: DataFrame, outer: Sequence[str], inner: str, value: str) -> DataFrame:
    """Spread between the means of the inner groups, and mean spread inside them."""
    means = rows.groupBy(*outer, inner).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return means.groupBy(*outer).agg(
        F.count(F.lit(1)).alias("group_count"),
        F.avg("_m").alias("mean_of_means"),
        F.stddev_samp("_m").alias("between_std"),
        F.avg("_s").alias("mean_within_std"),
        ratio(F.lit(100.0) * F.stddev_samp("_m"), F.avg("_m")).alias("between_cv_pct"),
    )


def weighted_median(rows: DataFrame, keys: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """First value whose cumulative weight reaches half the total; rows without positive weight are left out."""
    ok = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    cum = running_totals(ok, keys, value, {"w": F.sum(weight)})
    # The tiny slack makes an exact half independent of summation order.
    return cum.where(F.col("w_upto") >= (0.5 - 1e-12) * F.col("w_total")).groupBy(*keys).agg(F.min(value).alias(out))


def hotspot_statistics(rows: DataFrame, group: str, columns: Sequence[str], hot: str, control: str) -> DataFrame:
    """Median, quartile range and a robust effect size of each column, hotspots against controls."""
    long = rows.unpivot([group], list(columns), "variable_name", "value").where(F.col("value").isNotNull())
    stats = percentiles(long, ["variable_name", group], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    a = stats.where(F.col(group) == hot).select(
        "variable_name", F.col("median").alias("hotspot_median"), (F.col("q75") - F.col("q25")).alias("hotspot_iqr")
    )
    b = stats.where(F.col(group) == control).select(
        "variable_name", F.col("median").alias("control_median"), (F.col("q75") - F.col("q25")).alias("control_iqr")
    )
    diff = F.col("hotspot_median") - F.col("control_median")
    return a.join(b, "variable_name").select("*", (diff / (F.col("control_iqr") + EPS)).alias("robust_effect"))


def fold_spread(rows: DataFrame, keys: Sequence[str], fold: str, metric: Column) -> DataFrame:
    """Mean and spread over folds of one metric."""
    per_fold = rows.groupBy(*keys, fold).agg(metric.alias("_m"))
    return per_fold.groupBy(*keys).agg(
        F.count("_m").alias("fold_count"), F.avg("_m").alias("metric_mean"), F.stddev_samp("_m").alias("metric_std")
    )


def gates(summary: DataFrame, metric: str, limit: float, keys: Sequence[str]) -> DataFrame:
    return summary.select(
        *keys, metric, F.lit(float(limit)).alias("gate_limit"), (F.col(metric) <= limit).alias("gate_passed")
    )


def percentile_audit(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Five-point distribution summary of a value per stratum."""
    base = rows.groupBy(*keys).agg(F.count(value).alias("N"), F.avg(value).alias("mean"))
    points = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return _join([base, percentiles(rows, keys, value, points)], keys)


def band_normalised(rows: DataFrame, keys: Sequence[str], pure: Column, values: Sequence[str]) -> DataFrame:
    """Difference of each value from the median over the pure rows of the same group."""
    out = rows
    for v in values:
        base = percentiles(rows.where(pure), keys, v, {f"_b_{v}": 0.5})
        out = null_safe_join(out, base, keys, "left").withColumn(f"{v}_minus_baseline", F.col(v) - F.col(f"_b_{v}"))
        out = out.drop(f"_b_{v}")
    return out


# --- two-class scores -----------------------------------------------------------------------------


def curve_areas(rows: DataFrame, keys: Sequence[str], score: str, truth: str) -> DataFrame:
    """ROC and precision-recall areas by the trapezoid rule over distinct scores, highest first."""
    keys = list(keys)
    cum = running_totals(
        rows.where(F.col(truth).isNotNull()),
        keys,
        score,
        {"p": F.sum(F.col(truth)), "n": F.sum(1 - F.col(truth))},
        descending=True,
    )
    tp, fp = F.col("p_upto"), F.col("n_upto")
    before_tp, before_fp = tp - F.col("p"), fp - F.col("n")
    first = (before_tp + before_fp) == 0
    precision = tp / (tp + fp)
    before = F.when(first, F.lit(1.0)).otherwise(ratio(before_tp, before_tp + before_fp))
    return cum.groupBy(*keys).agg(
        F.sum("p").cast("long").alias("positives"),
        F.sum("n").cast("long").alias("negatives"),
        ratio(F.sum(F.col("n") * (tp + before_tp) / 2.0), F.max("p_total") * F.max("n_total")).alias("roc_auc"),
        ratio(F.sum(F.col("p") * (precision + before) / 2.0), F.max("p_total")).alias("pr_auc"),
    )


def detector_metrics(rows: DataFrame, keys: Sequence[str], score: str, truth: str) -> DataFrame:
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("N"),
        (F.lit(100.0) * F.avg(truth)).alias("positive_rate_pct"),
        F.avg((F.col(score) - F.col(truth)) * (F.col(score) - F.col(truth))).alias("brier_score"),
    )
    return _join([base, curve_areas(rows, keys, score, truth)], keys)


def calibration(rows: DataFrame, keys: Sequence[str], score: str, outcome: str, bins: int = 10) -> DataFrame:
    """Predicted level and observed rate in equal score bins, the last one closed."""
    index = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    inside = (F.col(score) >= 0) & (F.col(score) <= 1)
    return (
        rows.where(inside)
        .groupBy(*keys, index.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("N"),
            F.avg(score).alias("mean_predicted"),
            F.avg(outcome).alias("observed_rate"),
        )
        .withColumn("bin_center", (F.col("bin") + 0.5) / bins)
    )


def threshold_table(
    rows: DataFrame, keys: Sequence[str], risk: str, bad: str, thresholds: Sequence[float], measures: Mapping[str, str]
) -> DataFrame:
    """Effect of rejecting rows at or above each risk threshold."""
    t = F.col("risk_threshold")
    long = rows.withColumn("risk_threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    reject = F.col(risk) >= t
    flag = F.col(bad).cast("double")
    return long.groupBy(*keys, "risk_threshold").agg(
        F.count(F.lit(1)).alias("N"),
        percent(reject).alias("rejected_pct"),
        percent(~reject).alias("coverage_pct"),
        *[F.avg(F.when(~reject, F.col(c))).alias(f"{n}_kept") for n, c in measures.items()],
        *[F.avg(F.when(reject, F.col(c))).alias(f"{n}_rejected") for n, c in measures.items()],
        (F.lit(100.0) * F.sum(F.when(reject, flag).otherwise(0.0)) / F.greatest(F.sum(flag), F.lit(EPS))).alias(
            "recall_pct"
        ),
        (
            F.lit(100.0)
            * F.sum(F.when(reject, flag).otherwise(0.0))
            / F.greatest(F.sum(reject.cast("double")), F.lit(EPS))
        ).alias("precision_pct"),
    )


def accuracy_coverage(
    rows: DataFrame,
    keys: Sequence[str],
    risk: str,
    tie: Sequence[str],
    fractions: Sequence[float],
    measures: Mapping[str, str],
) -> DataFrame:
    """Mean of each measure over the least risky fraction of rows, for several fractions in one aggregation."""
    ranked = row_positions(rows, keys, risk, tie)
    long = ranked.withColumn("coverage_fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    kept = F.greatest(F.lit(1), F.round(F.col("coverage_fraction") * F.col("group_size")))
    return (
        long.where(F.col("position") <= kept)
        .groupBy(*keys, "coverage_fraction")
        .agg(F.count(F.lit(1)).alias("N_kept"), *[F.avg(c).alias(n) for n, c in measures.items()])
    )
