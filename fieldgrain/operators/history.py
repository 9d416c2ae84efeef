"""Coverage over iterations: history, difficulty ranking, progress, audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgrain.functions.semantics import null_safe_join, ratio, require_columns
from fieldgrain.operators.coverage import BINS, LABELS, distinct_counts
from fieldgrain.operators.order_stats import percentiles

# The cell pattern inside a requested condition's identifier.
CELL_PATTERN = r"(s\d+_f\d+_p\d+_d\d+_g\d+)"
REQUEST_COLUMNS = [
    "requested_condition_count", "requested_patch_count", "requested_cell_patch_count", "requested_cell_hit_count",
]


def request_statistics(requests: DataFrame) -> DataFrame:
    """Requests per iteration and cell; the cell is read from the condition identifier."""
    cell = F.regexp_extract("condition_id", CELL_PATTERN, 1)
    return (
        requests.withColumn("cell_key", cell)
        .groupBy("iteration_index", "cell_key")
        .agg(
            F.count(F.lit(1)).alias("requested_condition_count"),
            F.sum("patch_count").alias("requested_patch_count"),
            F.sum("requested_cell_patch_count").alias("requested_cell_patch_count"),
            F.sum(F.col("requested_cell_hit").cast("long")).alias("requested_cell_hit_count"),
        )
    )


def coverage_history(per_iteration: DataFrame, requests: DataFrame) -> DataFrame:
    """Coverage of every iteration with its request counts (zero where nothing was requested)."""
    joined = per_iteration.join(request_statistics(requests), ["iteration_index", "cell_key"], "left")
    return joined.fillna(0, REQUEST_COLUMNS)


def cumulative_coverage(assigned: DataFrame, cells: DataFrame, iterations: DataFrame, iteration: str = "iteration_index") -> DataFrame:
    """Accumulated example count of every cell after every iteration.

    ``cells`` (the grid) and ``iterations`` are design tables; the running sum
    has one short group per cell.
    """
    new = assigned.where("coverage_valid").groupBy(F.col("coverage_cell_key").alias("cell_key"), iteration).agg(
        F.count(F.lit(1)).alias("_new")
    )
    steps = cells.select("cell_key", *BINS, *LABELS).crossJoin(F.broadcast(iterations.select(iteration).distinct()))
    w = Window.partitionBy("cell_key").orderBy(iteration)
    return (
        steps.join(new, ["cell_key", iteration], "left")
        .withColumn("example_count", F.coalesce(F.sum("_new").over(w), F.lit(0)))
        .drop("_new")
    )


def difficulty(history: DataFrame, deficits: DataFrame, *, recent_window: int = 3) -> DataFrame:
    """Why each deficient cell is hard: stagnation, missed or absent requests, and a score; hardest first."""
    require_columns(history, ["cell_key", "iteration_index", "example_count", *REQUEST_COLUMNS], "history")
    w = Window.partitionBy("cell_key").orderBy("iteration_index")
    final = history.agg(F.max("iteration_index").alias("final_iteration"))
    steps = history.withColumn(
        "_gain", F.col("example_count") - F.coalesce(F.lag("example_count").over(w), F.lit(0))
    ).crossJoin(F.broadcast(final))  # one row
    it, n = F.col("iteration_index"), F.col("example_count")
    start = F.greatest(F.lit(1), F.col("final_iteration") - recent_window)
    per_cell = steps.groupBy("cell_key").agg(
        F.max("final_iteration").alias("final_iteration"),
        F.min(F.when(n > 0, it)).alias("first_observed_iteration"),
        F.max(F.when(F.col("_gain") > 0, it)).alias("last_improvement_iteration"),
        F.max_by(n, it).alias("_last"),
        F.min_by(n, it).alias("_first"),
        F.max_by(F.when(it <= start, n), F.when(it <= start, it)).alias("_prior"),
        *[F.sum(c).alias(f"total_{c.removesuffix('_count') + 's'}" if c == "requested_condition_count" else f"_{c}") for c in REQUEST_COLUMNS],
    )
    per_cell = per_cell.select(
        "cell_key",
        "final_iteration",
        "first_observed_iteration",
        "last_improvement_iteration",
        (F.col("final_iteration") - F.coalesce("last_improvement_iteration", F.lit(0))).alias("iterations_since_improvement"),
        (F.col("_last") - F.col("_first")).alias("total_example_gain"),
        (F.col("_last") - F.coalesce("_prior", "_first")).alias("recent_example_gain"),
        "total_requested_conditions",
        F.col("_requested_patch_count").alias("total_requested_patches"),
        F.col("_requested_cell_patch_count").alias("total_requested_cell_patches"),
        F.col("_requested_cell_hit_count").alias("total_requested_cell_hits"),
    )
    out = deficits.join(per_cell, "cell_key").withColumn(
        "request_hit_rate", ratio(F.col("total_requested_cell_hits"), F.col("total_requested_conditions"))
    )
    asked, hits, rate = F.col("total_requested_conditions"), F.col("total_requested_cell_hits"), F.col("request_hit_rate")
    reasons = F.concat_ws(
        "|",
        F.when(F.col("example_count") == 0, "never_observed").when(F.col("recent_example_gain") == 0, "stagnant"),
        F.when(asked == 0, "not_requested").when(hits == 0, "requests_miss_target").when(rate < 0.25, "low_request_hit_rate"),
        F.when(F.col("example_deficit") > 0, "insufficient_examples"),
        F.when(F.col("independent_run_deficit") > 0, "insufficient_independent_runs"),
        F.when(F.col("independent_condition_deficit") > 0, "insufficient_independent_conditions"),
    )
    score = (
        F.col("deficit_score")
        + F.when(F.col("example_count") == 0, 5.0).otherwise(0.0)
        + F.least(F.col("iterations_since_improvement") / F.lit(float(max(recent_window, 1))), F.lit(5.0))
        + F.when(asked == 0, 2.0).otherwise(F.lit(3.0) * (1 - rate))
    )
    return out.select("*", reasons.alias("difficulty_reason"), score.alias("difficulty_score")).orderBy(
        F.desc("difficulty_score"), F.desc("iterations_since_improvement"), F.desc("deficit_score"), "cell_key"
    )


def newly_reached(history: DataFrame, minimum_examples: int) -> DataFrame:
    """Cells observed, and complete, for the first time since the previous iteration."""
    w = Window.partitionBy("cell_key").orderBy("iteration_index")
    seen = F.col("example_count") > 0
    full = F.col("example_count") >= minimum_examples
    flags = history.select("iteration_index", "cell_key", seen.alias("_s"), full.alias("_f")).select(
        "iteration_index",
        (F.col("_s") & ~F.coalesce(F.lag("_s").over(w), F.lit(False))).alias("_new"),
        (F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))).alias("_done"),
        "_s",
        "_f",
    )
    return flags.groupBy("iteration_index").agg(
        F.count_if("_s").alias("observed_coverage_cell_count"),
        F.count_if(~F.col("_f")).alias("deficient_cell_count"),
        F.count_if("_new").alias("newly_observed_cell_count"),
        F.count_if("_done").alias("newly_complete_cell_count"),
    )


def request_progress(requests: DataFrame) -> DataFrame:
    """Per iteration: requests, hits, patches and the error of the predicted purity."""
    error = F.col("purity_median") - F.col("predicted_discrete_purity")
    rows = requests.withColumn("_e", error).withColumn("_ae", F.abs(error))
    base = rows.groupBy("iteration_index").agg(
        F.count(F.lit(1)).alias("requested_condition_count"),
        F.count_if("requested_cell_hit").alias("requested_cell_hit_count"),
        F.avg(F.col("requested_cell_hit").cast("double")).alias("requested_cell_hit_rate"),
        F.count_if(F.col("patch_count") > 0).alias("condition_with_patch_count"),
        F.count_if(F.col("valid_patch_count") > 0).alias("condition_with_valid_patch_count"),
        F.count_if(F.col("patch_count") == 0).alias("zero_patch_condition_count"),
        F.sum("patch_count").alias("patch_count"),
        F.sum("requested_cell_patch_count").alias("requested_cell_patch_count"),
        F.max("_ae").alias("maximum_absolute_predicted_purity_error"),
    )
    by = ["iteration_index"]
    signed = percentiles(rows, by, "_e", {"median_signed_predicted_purity_error": 0.5})
    absolute = percentiles(rows, by, "_ae", {"median_absolute_predicted_purity_error": 0.5})
    return reduce(lambda a, b: null_safe_join(a, b, by, "left"), [base, signed, absolute])


def compare_progress(left: DataFrame, right: DataFrame, columns: Sequence[str], names: tuple[str, str] = ("v3", "v4")) -> DataFrame:
    """Two progress tables side by side with differences, matched on the iteration."""
    a = left.select("iteration_index", *[F.col(c).alias(f"{names[0]}_{c}") for c in columns])
    b = right.select("iteration_index", *[F.col(c).alias(f"{names[1]}_{c}") for c in columns])
    return a.join(b, "iteration_index").select(
        "*", *[(F.col(f"{names[1]}_{c}") - F.col(f"{names[0]}_{c}")).alias(f"difference_{c}") for c in columns]
    )


def difficulty_by_dimension(difficult: DataFrame) -> DataFrame:
    """Four single-axis roll-ups in one pass."""
    axes = {"sws": "sws", "frequency": "frequency", "purity": "purity", "nominal_angular_coverage": "diffusivity"}
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("dimension_name"), F.col(f"{a}_bin").alias("dimension_bin"), F.col(f"{a}_label").alias("dimension_label")
            )
            for n, a in axes.items()
        ]
    )
    long = difficult.withColumn("_d", F.explode(entries)).select("*", "_d.*").drop("_d")
    by = ["dimension_name", "dimension_bin", "dimension_label"]
    base = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("difficult_cell_count"),
        F.count_if(F.col("example_count") == 0).alias("never_observed_cell_count"),
        F.count_if(F.col("recent_example_gain") == 0).alias("stagnant_cell_count"),
        F.count_if((F.col("total_requested_conditions") > 0) & (F.col("total_requested_cell_hits") == 0)).alias("request_miss_cell_count"),
        F.avg("difficulty_score").alias("mean_difficulty_score"),
        F.median("difficulty_score").alias("median_difficulty_score"),  # at most one value per grid cell
        F.sum("example_deficit").alias("total_example_deficit"),
        F.sum("independent_run_deficit").alias("total_run_deficit"),
        F.sum("independent_condition_deficit").alias("total_condition_deficit"),
    )
    return base


def rejection_totals(rows: DataFrame, prefix: str = "rejected_") -> DataFrame:
    """Wide rejection counters to one row per reason."""
    columns = [c for c in rows.columns if c.startswith(prefix)]
    sums = rows.agg(*[F.sum(c).alias(c) for c in columns])
    return sums.unpivot([], columns, "rejection_reason", "rejected_count").withColumn(
        "rejection_reason", F.regexp_replace("rejection_reason", f"^{prefix}", "")
    )


def independence_audit(assigned: DataFrame, summary: DataFrame, run: str = "campaign_run_id", condition: str = "campaign_condition_id") -> DataFrame:
    """Recount distinct runs and conditions per cell and compare them with a stored summary."""
    columns = {"audited_run_count": run, "audited_condition_count": condition}
    rows = assigned.where("coverage_valid").select(F.col("coverage_cell_key").alias("cell_key"), run, condition)
    audited = distinct_counts(rows, ["cell_key"], columns, "audited_example_count")
    both = summary.select("cell_key", "example_count", "independent_run_count", "independent_condition_count").join(
        audited, "cell_key", "full"
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.count_if(zero("example_count") != zero("audited_example_count")).alias("example_mismatch_count"),
        F.count_if(zero("independent_run_count") != zero("audited_run_count")).alias("run_mismatch_count"),
        F.count_if(zero("independent_condition_count") != zero("audited_condition_count")).alias("condition_mismatch_count"),
    )


def purity_angular_table(summary: DataFrame, purity_bins: int) -> DataFrame:
    """Heat-map source: angular bins down, purity bins across, example counts inside."""
    named = summary.withColumn("_p", F.format_string("purity_%02d", "purity_bin"))
    return named.groupBy("diffusivity_bin").pivot("_p", [f"purity_{i:02d}" for i in range(1, purity_bins + 1)]).agg(
        F.sum("example_count")
    ).fillna(0)


def geometry_efficiency(requests: DataFrame, family: str = "geometry_family") -> DataFrame:
    return requests.groupBy(family).agg(
        F.count(F.lit(1)).alias("condition_count"),
        F.avg(F.col("requested_cell_hit").cast("double")).alias("hit_rate"),
        F.sum("patch_count").alias("patch_count"),
    )


def key_sets(previous: DataFrame, current: DataFrame, deficient: DataFrame, key: str = "cell_key") -> DataFrame:
    """Set arithmetic on cell keys: complete = observed minus deficient; kept = in all three sets."""
    p, c, d = previous.select(key).distinct(), current.select(key).distinct(), deficient.select(key).distinct()
    sets = {
        "complete": c.exceptAll(d),
        "new": c.exceptAll(p),
        "still_deficient": p.intersect(c).intersect(d),
    }
    parts = [s.withColumn("set_name", F.lit(n)) for n, s in sets.items()]
    return reduce(DataFrame.unionByName, parts)


def distinct_pairs(assigned: DataFrame, left: str, right: str, condition: Column | None = None) -> DataFrame:
    rows = assigned if condition is None else assigned.where(condition)
    return rows.select(left, right).distinct()
