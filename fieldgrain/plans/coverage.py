"""Coverage queries on the examples frame."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldgrain.functions.geometry import effective_window, nominal_angular_coverage, nominal_field_class, patch_geometry
from fieldgrain.operators import coverage as cov
from fieldgrain.operators import history as hist
from fieldgrain.plans.catalog import query, r, rounded
from fieldgrain.plans.frames import EXAMPLES_SQL, examples

GRID = cov.CoverageGrid(
    sws_edges=(900, 25000, 50000, 75000, 105000),
    frequency_edges=(1, 11, 21, 31, 41, 50),
    purity_edges=(0, 0.03, 0.06, 0.1),
    diffusivity_edges=(0, 0.03, 0.06, 0.08),
    pairs_m=((1e-4, 1e-4), (2e-4, 2e-4), (3e-4, 3e-4)),
)
MINIMA = {"minimum_examples": 40, "minimum_runs": 40, "minimum_conditions": 30}


def _sql_bin(column: str, edges) -> str:
    tests = []
    for i in range(len(edges) - 1):
        op = "<=" if i == len(edges) - 2 else "<"
        tests.append(f"WHEN {column} >= {edges[i]}::DOUBLE AND {column} {op} {edges[i + 1]}::DOUBLE THEN {i + 1}")
    return f"CASE {' '.join(tests)} ELSE 0 END"


def _sql_label(column: str, edges) -> str:
    last = len(edges) - 2
    tests = [
        f"WHEN {i + 1} THEN '[{edges[i]:g},{edges[i + 1]:g}{']' if i == last else ')'}'" for i in range(last + 1)
    ]
    return f"CASE {column} {' '.join(tests)} ELSE 'out_of_range' END"


_KEY = "printf('s%02d_f%02d_p%02d_d%02d_g%02d', sws_bin, frequency_bin, purity_bin, diffusivity_bin, discretization_bin)"
_PAIR_LABEL = (
    "CASE discretization_bin WHEN 1 THEN 'dx=0.0001,dz=0.0001' WHEN 2 THEN 'dx=0.0002,dz=0.0002' "
    "WHEN 3 THEN 'dx=0.0003,dz=0.0003' ELSE 'out_of_range' END"
)
_LABELS = f"""{_sql_label('sws_bin', GRID.sws_edges)} AS sws_label,
    {_sql_label('frequency_bin', GRID.frequency_edges)} AS frequency_label,
    {_sql_label('purity_bin', GRID.purity_edges)} AS purity_label,
    {_sql_label('diffusivity_bin', GRID.diffusivity_edges)} AS diffusivity_label,
    {_PAIR_LABEL} AS discretization_label"""

ASSIGNED_SQL = f"""{EXAMPLES_SQL},
assigned AS (
  SELECT *, sws_bin > 0 AND frequency_bin > 0 AND purity_bin > 0 AND diffusivity_bin > 0 AND discretization_bin > 0
         AS coverage_valid
  FROM (SELECT *, {_sql_bin('truth_cs_center_m_s', GRID.sws_edges)} AS sws_bin,
        {_sql_bin('campaign_frequency_hz', GRID.frequency_edges)} AS frequency_bin,
        {_sql_bin('truth_material_purity', GRID.purity_edges)} AS purity_bin,
        {_sql_bin('campaign_angular_entropy', GRID.diffusivity_edges)} AS diffusivity_bin,
        CASE WHEN patch_idx <= 3 THEN patch_idx ELSE 0 END AS discretization_bin FROM examples))"""

_CELLS = "sws_bin, frequency_bin, purity_bin, diffusivity_bin, discretization_bin"

SUMMARY_SQL = f"""{ASSIGNED_SQL},
summary AS (
  SELECT {_CELLS}, CAST(count(*) AS BIGINT) AS example_count,
         CAST(count(DISTINCT campaign_run_id) AS BIGINT) AS independent_run_count,
         CAST(count(DISTINCT campaign_condition_id) AS BIGINT) AS independent_condition_count
  FROM assigned WHERE coverage_valid GROUP BY {_CELLS})"""

GRID_SQL = f"""{SUMMARY_SQL},
grid AS (
  SELECT a AS sws_bin, b AS frequency_bin, c AS purity_bin, d AS diffusivity_bin, e AS discretization_bin
  FROM range(1, 5) t1(a), range(1, 6) t2(b), range(1, 4) t3(c), range(1, 4) t4(d), range(1, 4) t5(e)),
complete AS (
  SELECT {_CELLS}, coalesce(example_count, 0) AS example_count,
         coalesce(independent_run_count, 0) AS independent_run_count,
         coalesce(independent_condition_count, 0) AS independent_condition_count
  FROM grid LEFT JOIN summary USING ({_CELLS}))"""

DEFICITS_SQL = f"""{GRID_SQL},
deficits0 AS (
  SELECT *, CAST(greatest(40 - example_count, 0) AS BIGINT) AS example_deficit,
         CAST(greatest(40 - independent_run_count, 0) AS BIGINT) AS independent_run_deficit,
         CAST(greatest(30 - independent_condition_count, 0) AS BIGINT) AS independent_condition_deficit
  FROM complete),
deficits AS (
  SELECT *, {_KEY} AS cell_key, CAST(0 AS BIGINT) AS geometry_seed_deficit,
         example_deficit + independent_run_deficit + independent_condition_deficit = 0 AS coverage_complete,
         example_deficit / 40.0::DOUBLE + independent_run_deficit / 40.0::DOUBLE
           + independent_condition_deficit / 30.0::DOUBLE AS deficit_score
  FROM deficits0)"""


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.assign_coverage(examples(spark, sf_dir), GRID)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.summarize_coverage(assigned(spark, sf_dir), GRID)


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.complete_grid(summary(spark, sf_dir), GRID)


def deficits(spark: SparkSession, sf_dir: str, include_complete: bool = True) -> DataFrame:
    return cov.coverage_deficits(complete(spark, sf_dir), include_complete=include_complete, **MINIMA)


@query(
    "coverage_assign",
    "P1 P2 N2 A4",
    f"""WITH {ASSIGNED_SQL}
    SELECT example_id, {', '.join(f'{b} AS coverage_{b}' for b in cov.BINS)},
      {_LABELS.replace(' AS ', ' AS coverage_')}, coverage_valid,
      CASE WHEN coverage_valid THEN {_KEY} ELSE 'out_of_range' END AS coverage_cell_key FROM assigned""",
)
def coverage_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select(
        "example_id",
        *[f"coverage_{b}" for b in cov.BINS],
        *[f"coverage_{x}" for x in cov.LABELS],
        "coverage_valid",
        "coverage_cell_key",
    )


@query(
    "coverage_summary",
    "G1 N8",
    f"WITH {SUMMARY_SQL} SELECT {_CELLS}, {_KEY} AS cell_key, {_LABELS}, example_count, independent_run_count, "
    "independent_condition_count FROM summary",
)
def coverage_summary(spark, sf_dir):
    return summary(spark, sf_dir)


@query(
    "coverage_grid",
    "G2 J1 A7",
    f"WITH {GRID_SQL} SELECT {_CELLS}, {_KEY} AS cell_key, {_LABELS}, example_count, independent_run_count, "
    "independent_condition_count FROM complete",
)
def coverage_grid(spark, sf_dir):
    return complete(spark, sf_dir)


@query(
    "coverage_deficits",
    "G3",
    f"""WITH {DEFICITS_SQL}
    SELECT {_CELLS}, cell_key, example_count, independent_run_count, independent_condition_count, example_deficit,
      independent_run_deficit, independent_condition_deficit, coverage_complete, round(deficit_score, 6) AS deficit_score
    FROM deficits""",
)
def coverage_deficits(spark, sf_dir):
    return deficits(spark, sf_dir).select(
        *cov.BINS,
        "cell_key",
        "example_count",
        "independent_run_count",
        "independent_condition_count",
        "example_deficit",
        "independent_run_deficit",
        "independent_condition_deficit",
        "coverage_complete",
        r("deficit_score").alias("deficit_score"),
    )


@query(
    "coverage_report_counts",
    "G4",
    f"""WITH {DEFICITS_SQL}
    SELECT * FROM (SELECT CAST(count(*) AS BIGINT) AS example_count,
        CAST(count(*) FILTER (WHERE NOT coverage_valid) AS BIGINT) AS out_of_range_count FROM assigned),
      (SELECT CAST(count(*) AS BIGINT) AS cell_count,
        CAST(count(*) FILTER (WHERE example_count > 0) AS BIGINT) AS observed_cell_count,
        CAST(count(*) FILTER (WHERE coverage_complete) AS BIGINT) AS complete_cell_count,
        CAST(count(*) FILTER (WHERE NOT coverage_complete) AS BIGINT) AS deficient_cell_count,
        CAST(sum(example_count) AS BIGINT) AS valid_example_count,
        CAST(sum(example_deficit) AS BIGINT) AS missing_example_count FROM deficits)""",
)
def coverage_report_counts(spark, sf_dir):
    return cov.coverage_report(examples(spark, sf_dir), GRID, MINIMA)["totals"]


@query(
    "nominal_angular",
    "P3",
    f"""WITH {EXAMPLES_SQL}
    SELECT example_id, round(CASE WHEN campaign_direction_count BETWEEN 1 AND 36
        AND campaign_solid_angle_sr <= {4 * math.pi!r}::DOUBLE + 1e-10::DOUBLE
      THEN campaign_direction_count / 36.0::DOUBLE * (campaign_solid_angle_sr / {4 * math.pi!r}::DOUBLE) END, 6)
      AS nominal_angular_coverage FROM examples""",
)
def nominal_angular(spark, sf_dir):
    value = nominal_angular_coverage("campaign_direction_count", "campaign_solid_angle_sr", 36)
    return examples(spark, sf_dir).select("example_id", r(value).alias("nominal_angular_coverage"))


@query(
    "field_class",
    "P4",
    f"""WITH {EXAMPLES_SQL}
    SELECT CAST(CASE WHEN campaign_direction_count >= 32 AND campaign_solid_angle_sr >= {2 * math.pi!r}::DOUBLE THEN 3
      WHEN campaign_direction_count <= 1 AND campaign_solid_angle_sr <= 0.1::DOUBLE THEN 1 ELSE 2 END AS INTEGER)
      AS field_class, CAST(count(*) AS BIGINT) AS example_count FROM examples GROUP BY 1""",
)
def field_class(spark, sf_dir):
    value = nominal_field_class("campaign_direction_count", "campaign_solid_angle_sr")
    return examples(spark, sf_dir).groupBy(value.alias("field_class")).agg(F.count(F.lit(1)).alias("example_count"))


@query(
    "patch_geometry",
    "P11 P12",
    f"""WITH {EXAMPLES_SQL}, w AS (
      SELECT example_id, GRID_dx_m AS dx, campaign_frequency_hz AS f, truth_cs_center_m_s / 100.0::DOUBLE AS c,
        CAST(greatest(3, floor(round(2.0::DOUBLE * (3.0::DOUBLE / campaign_frequency_hz) / GRID_dx_m) / 2) * 2 + 1)
          AS INTEGER) AS patch_width_px FROM examples),
    s AS (SELECT *, CAST(greatest(4, ceil(0.5::DOUBLE * patch_width_px)) AS INTEGER) AS stride_px FROM w)
    SELECT example_id, patch_width_px, stride_px, patch_width_px + 9 * stride_px AS domain_points,
      round((patch_width_px + 9 * stride_px - 1) * dx, 6) AS domain_m, 100 AS available_patch_count,
      round(greatest(0.0::DOUBLE, CAST(patch_width_px - stride_px AS DOUBLE) / patch_width_px), 6)
        AS linear_overlap_fraction,
      round(3.0::DOUBLE / f, 10) AS wavelength_guess_m, round(c / f, 10) AS wavelength_true_m,
      round(2.0::DOUBLE * 3.0::DOUBLE / c, 6) AS M_effective FROM s""",
)
def patch_geometry_query(spark, sf_dir):
    rows = examples(spark, sf_dir).withColumn("c", F.col("truth_cs_center_m_s") / 100.0)
    shape = patch_geometry(F.lit(2.0), F.lit(3.0), "campaign_frequency_hz", "GRID_dx_m")
    waves = effective_window(F.lit(2.0), F.lit(3.0), "c", "campaign_frequency_hz")
    out = rows.select("example_id", *[c.alias(n) for n, c in {**shape, **waves}.items()])
    return rounded(out, wavelength_guess_m=10, wavelength_true_m=10)
