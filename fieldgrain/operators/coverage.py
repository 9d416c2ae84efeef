"""Coverage of the patch table over a five-axis bin grid: assignment, counts, grid, deficits, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldgrain.functions.geometry import nominal_angular_coverage
from fieldgrain.functions.semantics import (
    OUT_OF_RANGE,
    bin_index,
    bin_label,
    check_edges,
    named,
    pair_index,
    pair_label,
    require_columns,
)
from fieldgrain.operators.order_stats import percentiles

AXES = ("sws", "frequency", "purity", "diffusivity", "discretization")
BINS = [f"{a}_bin" for a in AXES]
LABELS = [f"{a}_label" for a in AXES]
CELL_FORMAT = "s%02d_f%02d_p%02d_d%02d_g%02d"


@dataclass(frozen=True)
class CoverageGrid:
    """Edges of the four numeric axes, the spacing pairs, and the columns they apply to."""

    sws_edges: Sequence[float]
    frequency_edges: Sequence[float]
    purity_edges: Sequence[float]
    diffusivity_edges: Sequence[float]
    pairs_m: Sequence[tuple[float, float]]
    pair_tolerance: float = 1e-12
    field_mode: str = "measured_entropy"
    sws_column: str = "truth_cs_center_m_s"
    frequency_column: str = "campaign_frequency_hz"
    purity_column: str = "truth_material_purity"
    diffusivity_column: str = "campaign_angular_entropy"
    dx_column: str = "GRID_dx_m"
    dz_column: str = "GRID_dz_m"
    maximum_directions: int = 128
    _checked: bool = field(default=False, repr=False)

    def __post_init__(self) -> None:
        for axis in AXES[:4]:
            check_edges(self.edges(axis), axis)
        if self.field_mode not in ("nominal", "measured_entropy"):
            raise ValueError("field_mode must be 'nominal' or 'measured_entropy'")
        if not self.pairs_m or any(p <= 0 for pair in self.pairs_m for p in pair):
            raise ValueError("pairs_m must hold positive (dx, dz) pairs")
        if len(set(map(tuple, self.pairs_m))) != len(self.pairs_m):
            raise ValueError("pairs_m must not repeat a pair")

    def edges(self, axis: str) -> Sequence[float]:
        return getattr(self, f"{axis}_edges")

    def bin_count(self, axis: str) -> int:
        return len(self.pairs_m) if axis == "discretization" else len(self.edges(axis)) - 1

    def label(self, axis: str, index: Column) -> Column:
        return pair_label(index, self.pairs_m) if axis == "discretization" else bin_label(index, self.edges(axis))


def cell_key(bins: Sequence[Column | str]) -> Column:
    return F.format_string(CELL_FORMAT, *bins)


def assign_coverage(examples: DataFrame, grid: CoverageGrid) -> DataFrame:
    """Five bins, their labels, a validity flag and the cell key, as one projection (no shuffle)."""
    needed = [grid.sws_column, grid.frequency_column, grid.purity_column, grid.dx_column, grid.dz_column]
    nominal = grid.field_mode == "nominal"
    needed += ["campaign_direction_count", "campaign_solid_angle_sr"] if nominal else [grid.diffusivity_column]
    require_columns(examples, needed, "example table")
    if nominal:
        examples = examples.withColumn(
            "nominal_angular_coverage",
            nominal_angular_coverage("campaign_direction_count", "campaign_solid_angle_sr", grid.maximum_directions),
        )
    field_column = "nominal_angular_coverage" if nominal else grid.diffusivity_column
    binned = examples.select(
        "*",
        bin_index(grid.sws_column, grid.sws_edges).alias("coverage_sws_bin"),
        bin_index(grid.frequency_column, grid.frequency_edges).alias("coverage_frequency_bin"),
        bin_index(grid.purity_column, grid.purity_edges).alias("coverage_purity_bin"),
        bin_index(field_column, grid.diffusivity_edges).alias("coverage_diffusivity_bin"),
        pair_index(grid.dx_column, grid.dz_column, grid.pairs_m, grid.pair_tolerance).alias(
            "coverage_discretization_bin"
        ),
    )
    bins = [F.col(f"coverage_{b}") for b in BINS]
    valid = reduce(lambda a, b: a & b, [b > 0 for b in bins])
    return binned.select(
        "*",
        *[grid.label(a, F.col(f"coverage_{a}_bin")).alias(f"coverage_{a}_label") for a in AXES],
        valid.alias("coverage_valid"),
        F.when(valid, cell_key(bins)).otherwise(F.lit(OUT_OF_RANGE)).alias("coverage_cell_key"),
    )


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: dict[str, str], rows: str) -> DataFrame:
    """Row count and exact distinct counts per key, each by a pre-aggregation on (key, value).

    A hot key is spread over tasks by its values, and no row is expanded as
    several ``countDistinct`` in one aggregate would do.
    """
    out = None
    for i, (name, column) in enumerate(columns.items()):
        text = dict(df.dtypes)[column] == "string"
        seen = (named(F.col(column)) if text else F.col(column)).alias("_v")
        pairs = df.select(*keys, seen).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
        counted = pairs.groupBy(*keys).agg(
            *([F.sum("_n").alias(rows)] if i == 0 else []), F.count("_v").alias(name)
        )
        out = counted if out is None else out.join(counted, list(keys))
    return out


def summarize_coverage(
    assigned: DataFrame,
    grid: CoverageGrid,
    *,
    run_column: str = "campaign_run_id",
    condition_column: str | None = "campaign_condition_id",
    seed_column: str | None = None,
) -> DataFrame:
    """Observed cells: example count and distinct runs, conditions and geometry seeds."""
    columns = {"independent_run_count": run_column}
    if condition_column:
        columns["independent_condition_count"] = condition_column
    if seed_column:
        columns["geometry_seed_count"] = seed_column
    require_columns(assigned, [*columns.values(), "coverage_valid"], "assigned examples")
    valid = assigned.where("coverage_valid").select(
        *[F.col(f"coverage_{b}").alias(b) for b in BINS], *dict.fromkeys(columns.values())
    )
    counts = distinct_counts(valid, BINS, columns, "example_count")
    return counts.select(
        *BINS,
        cell_key(BINS).alias("cell_key"),
        *[grid.label(a, F.col(f"{a}_bin")).alias(f"{a}_label") for a in AXES],
        "example_count",
        *columns,
    )


def coverage_cells(spark: SparkSession, grid: CoverageGrid) -> DataFrame:
    """All cells of the grid; its size is fixed by the edges, not by the data."""
    cells = spark.range(1)
    for axis in AXES:
        cells = cells.withColumn(f"{axis}_bin", F.explode(F.sequence(F.lit(1), F.lit(grid.bin_count(axis)))))
    return cells.select(
        *BINS,
        cell_key(BINS).alias("cell_key"),
        *[grid.label(a, F.col(f"{a}_bin")).alias(f"{a}_label") for a in AXES],
    )


def complete_grid(summary: DataFrame, grid: CoverageGrid) -> DataFrame:
    """Every cell of the grid with zeros where nothing was observed."""
    counts = [c for c in summary.columns if c.endswith("_count")]
    cells = coverage_cells(summary.sparkSession, grid)
    return cells.join(summary.select(*BINS, *counts), BINS, "left").fillna(0, counts)


def coverage_deficits(
    summary: DataFrame,
    *,
    minimum_examples: int = 0,
    minimum_runs: int = 0,
    minimum_conditions: int = 0,
    minimum_seeds: int = 0,
    include_complete: bool = False,
) -> DataFrame:
    """What each cell still lacks, and a score summing the missing fractions; most deficient first."""
    wanted = [
        ("example", "example_count", minimum_examples),
        ("independent_run", "independent_run_count", minimum_runs),
        ("independent_condition", "independent_condition_count", minimum_conditions),
        ("geometry_seed", "geometry_seed_count", minimum_seeds),
    ]
    if any(m < 0 or m != int(m) for _, _, m in wanted):
        raise ValueError("coverage requirements must be nonnegative integers")
    require_columns(summary, [*BINS, "cell_key", *[c for _, c, m in wanted if m > 0]], "coverage summary")
    missing, score = {}, F.lit(0.0)
    for name, column, minimum in wanted:
        lack = F.greatest(F.lit(minimum) - F.col(column), F.lit(0)) if minimum > 0 else F.lit(0)
        missing[f"{name}_deficit"] = lack.cast("long")
        if minimum > 0:
            score = score + lack / F.lit(float(minimum))
    complete = reduce(lambda a, b: a & b, [c == 0 for c in missing.values()])
    out = summary.select(
        "*",
        *[F.lit(m).cast("long").alias(f"required_{c}") for _, c, m in wanted[:3]],
        *[c.alias(n) for n, c in missing.items()],
        complete.alias("coverage_complete"),
        score.alias("deficit_score"),
    )
    if not include_complete:
        out = out.where(~F.col("coverage_complete"))
    return out.orderBy(F.desc("deficit_score"), *BINS)


def coverage_report(
    examples: DataFrame,
    grid: CoverageGrid,
    minima: dict[str, int],
    *,
    condition_column: str | None = "campaign_condition_id",
) -> dict[str, DataFrame]:
    """Assigned rows, observed cells, full grid, deficits and one row of totals, as lazy frames."""
    assigned = assign_coverage(examples, grid)
    summary = summarize_coverage(assigned, grid, condition_column=condition_column)
    complete = complete_grid(summary, grid)
    deficits = coverage_deficits(complete, include_complete=True, **minima)
    totals = deficits.agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.count_if(F.col("example_count") > 0).alias("observed_cell_count"),
        F.count_if("coverage_complete").alias("complete_cell_count"),
        F.count_if(~F.col("coverage_complete")).alias("deficient_cell_count"),
        F.sum("example_count").alias("valid_example_count"),
        F.sum("example_deficit").alias("missing_example_count"),
    )
    rows = assigned.agg(
        F.count(F.lit(1)).alias("example_count"),
        F.count_if(~F.col("coverage_valid")).alias("out_of_range_count"),
    )
    return {
        "assigned": assigned,
        "summary": summary,
        "complete": complete,
        "deficits": deficits.where(~F.col("coverage_complete")),
        "totals": rows.crossJoin(totals),  # one row by one row
    }


def requested_vs_achieved(
    plan: DataFrame, assigned: DataFrame, *, condition: str = "campaign_condition_id"
) -> DataFrame:
    """Per requested condition: patches, hits in the requested cell, achieved bins, dominant cell, value ranges.

    Rows are first counted per (condition, cell); only those counts are
    compared with the plan, so no condition's rows meet in one task.
    """
    rows = assigned.withColumnRenamed(condition, "condition_id")
    four = ["sws", "frequency", "purity", "diffusivity"]
    cell = [f"coverage_{a}_bin" for a in four]
    measures = rows.groupBy("condition_id").agg(
        F.count(F.lit(1)).alias("patch_count"),
        F.count_if("coverage_valid").alias("valid_patch_count"),
        *[
            f(F.when(F.col("coverage_valid"), F.col(c))).alias(f"{n}_{s}")
            for n, c in (("purity", "truth_material_purity"), ("diffusivity", "campaign_angular_entropy"))
            for s, f in (("min", F.min), ("max", F.max))
        ],
    )
    valid = rows.where("coverage_valid")
    cells = valid.groupBy("condition_id", *cell).agg(F.count(F.lit(1)).alias("_n"))
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    achieved = cells.groupBy("condition_id").agg(
        text("coverage_purity_bin").alias("achieved_purity_bins"),
        text("coverage_diffusivity_bin").alias("achieved_diffusivity_bins"),
        text(F.format_string("s%02d_f%02d_p%02d_d%02d", *cell)).alias("achieved_cells"),
    )
    pairs = cells.groupBy("condition_id", "coverage_purity_bin", "coverage_diffusivity_bin").agg(
        F.sum("_n").alias("_n")
    )
    best = F.min(F.struct(-F.col("_n"), "coverage_purity_bin", "coverage_diffusivity_bin"))
    dominant = (
        pairs.groupBy("condition_id")
        .agg(best.alias("_b"), F.sum("_n").alias("_t"))
        .select(
            "condition_id",
            F.col("_b.coverage_purity_bin").alias("dominant_purity_bin"),
            F.col("_b.coverage_diffusivity_bin").alias("dominant_diffusivity_bin"),
            (-F.col("_b.col1") / F.col("_t")).alias("dominant_cell_fraction"),
        )
    )
    medians = percentiles(valid, ["condition_id"], "truth_material_purity", {"purity_median": 0.5}).join(
        percentiles(valid, ["condition_id"], "campaign_angular_entropy", {"diffusivity_median": 0.5}), "condition_id"
    )
    wanted = plan.select("condition_id", *[F.col(f"requested_{a}_bin").alias(f"coverage_{a}_bin") for a in four])
    hits = wanted.join(cells, ["condition_id", *cell]).select(
        "condition_id", F.col("_n").alias("requested_cell_patch_count")
    )
    out = plan
    for part in (measures, achieved, dominant, medians, hits):
        out = out.join(part, "condition_id", "left")
    out = out.fillna(0, ["patch_count", "valid_patch_count", "requested_cell_patch_count"])
    out = out.withColumn("requested_cell_hit", F.col("requested_cell_patch_count") > 0)
    if "predicted_discrete_purity" in plan.columns:
        out = out.withColumn(
            "predicted_vs_achieved_purity_error", F.col("purity_median") - F.col("predicted_discrete_purity")
        )
    return out
