"""Design and request tables: Cartesian designs, deficits to requests, family choice, placement search."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fieldgrain.functions.geometry import nominal_angular_coverage, patch_geometry
from fieldgrain.operators.coverage import BINS, CELL_FORMAT, CoverageGrid


def level_table(spark: SparkSession, levels: Mapping[str, Sequence]) -> DataFrame:
    """Cartesian product of design levels, built by exploding level arrays (the design decides its size)."""
    out = spark.range(1)
    for name, values in levels.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("id")


def cartesian_design(levels: DataFrame, order: Sequence[str], *, realizations: int, base_seed: int, stride: int,
                     m_values: Sequence[float], speed_guess: float, prefix: str = "condition") -> DataFrame:
    """Runs of every condition with seeds and window geometry.

    The condition number is a rank over the design table, which is small by nature.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    conditions = levels.withColumn("condition_index", F.row_number().over(w)).withColumn(
        "condition_id", F.format_string(f"{prefix}_%05d", "condition_index")
    )
    runs = conditions.withColumn("realization_id", F.explode(F.sequence(F.lit(1), F.lit(realizations)))).withColumn(
        "seed", (F.lit(base_seed) + (F.col("condition_index") - 1) * stride + F.col("realization_id")).cast("long")
    )
    out = runs.withColumn("run_id", F.format_string("%s_r%02d", "condition_id", "realization_id"))
    for m in m_values:
        shape = patch_geometry(F.lit(float(m)), F.lit(float(speed_guess)), "frequency_hz", "dx_m")
        out = out.withColumns({f"{n}_M{m:g}": c for n, c in shape.items() if n in ("patch_width_px", "stride_px", "domain_points")})
    return out


# The seven angular levels as (name, share of the sphere, directions, in-plane directions).
ANGULAR_LEVELS = [
    ("level_1_near_single", 0.01 / (4 * math.pi), 1, 1),
    ("level_2_narrow", 0.01, 3, 1),
    ("level_3_directional", 0.04, 6, 2),
    ("level_4_low_intermediate", 0.125, 10, 3),
    ("level_5_intermediate", 0.25, 16, 4),
    ("level_6_broad", 0.5, 24, 6),
    ("level_7_diffuse", 1.0, 32, 8),
]


def angular_family(spark: SparkSession, levels: Sequence[tuple[str, float, int, int]] = ANGULAR_LEVELS) -> DataFrame:
    """Angular design levels with solid angle, nominal coverage, direction density and in-plane share."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("angular_level"), F.lit(n).alias("name"), F.lit(float(s)).alias("angular_support_fraction"),
                F.lit(d).alias("direction_count"), F.lit(q).alias("in_plane_count"),
            )
            for i, (n, s, d, q) in enumerate(levels)
        ]
    )
    rows = spark.range(1).select(F.explode(entries).alias("e")).select("e.*")
    rows = rows.withColumn("solid_angle_sr", F.lit(4 * math.pi) * F.col("angular_support_fraction"))
    return rows.select(
        "*",
        nominal_angular_coverage("direction_count", "solid_angle_sr").alias("nominal_angular_coverage"),
        (F.col("direction_count") / F.col("solid_angle_sr")).alias("direction_density_per_sr"),
        (F.col("in_plane_count") / F.col("direction_count")).alias("requested_in_plane_fraction"),
    )


def edge_lookup(grid: CoverageGrid, axis: str, side: int) -> Column:
    """Lower (0) or upper (1) edge of the row's bin on an axis."""
    return F.get(F.array(*[F.lit(float(e)) for e in grid.edges(axis)]), F.col(f"{axis}_bin") - 1 + side)


def deficit_requests(deficits: DataFrame, grid: CoverageGrid, existing: DataFrame, *, limit: int, prefix: str,
                     base_realizations: int, examples_per_run: int) -> DataFrame:
    """The most urgent deficits as request rows with bin ranges and the residual action.

    ``existing`` has one row per cell already requested: ``cell_key``,
    ``existing_condition_id`` and ``last_realization_id``.
    """
    from fieldgrain.operators.sampling import first_requests

    r = first_requests(deficits, limit)
    for axis in ("sws", "frequency", "purity", "diffusivity"):
        r = r.withColumns({f"{axis}_lower": edge_lookup(grid, axis, 0), f"{axis}_upper": edge_lookup(grid, axis, 1)})
    pairs = F.array(*[F.lit(float(dx)) for dx, _ in grid.pairs_m])
    r = r.withColumn("target_dx_m", F.get(pairs, F.col("discretization_bin") - 1))
    r = r.withColumn("new_condition_id", F.format_string(f"{prefix}_{CELL_FORMAT}_%03d", *BINS, "request_index"))
    r = r.join(existing, "cell_key", "left")
    e, n, c = (F.col(f"{x}_deficit") for x in ("example", "independent_run", "independent_condition"))
    known = F.col("existing_condition_id").isNotNull()
    needs_new = (c > 0) | ~known
    by_examples = F.ceil(e / F.lit(float(examples_per_run)))
    action = (
        F.when(needs_new & ((e > 0) | (n > 0)), "combined")
        .when(needs_new, "new_condition")
        .when((n > 0) & (e > 0), "combined")
        .when(n > 0, "additional_realization")
        .otherwise("opportunistic_examples")
    )
    count = (
        F.when(needs_new, F.greatest(F.lit(base_realizations), F.greatest(F.lit(1), n)))
        .when(n > 0, F.greatest(n, by_examples))
        .otherwise(F.greatest(F.lit(1), by_examples))
    )
    r = r.select(
        "*",
        F.when(needs_new, F.col("new_condition_id")).otherwise(F.col("existing_condition_id")).alias("condition_id"),
        action.alias("planned_action"),
        count.cast("long").alias("planned_realization_count"),
        needs_new.cast("int").alias("planned_new_condition_count"),
        F.when(needs_new, 1).otherwise(F.col("last_realization_id") + 1).cast("long").alias("realization_start_index"),
    )
    planned = F.col("planned_realization_count")
    return r.select(
        "*",
        F.least(e, planned * examples_per_run).alias("expected_example_contribution"),
        F.least(n, planned).alias("expected_independent_run_contribution"),
        F.least(c, F.col("planned_new_condition_count").cast("long")).alias("expected_independent_condition_contribution"),
    )


def choose_families(requests: DataFrame, assigned: DataFrame, pure_families: Sequence[str], mixed_families: Sequence[str],
                    *, pure_from: float = 0.98, family: str = "campaign_geometry_family", run: str = "campaign_run_id",
                    seed: int = 0) -> DataFrame:
    """Least-used family per request by distinct historical runs in its cell; ties rotate with the request index."""
    history = (
        assigned.where("coverage_valid")
        .select(F.col("coverage_cell_key").alias("cell_key"), F.col(family).alias("_family"), run)
        .distinct()
        .groupBy("cell_key", "_family")
        .agg(F.count(run).alias("_runs"))
    )
    def names(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    options = requests.select(
        "request_index",
        "cell_key",
        F.posexplode(
            F.when(F.col("purity_lower") >= pure_from, names(pure_families)).otherwise(names(mixed_families))
        ).alias("_pos", "_family"),
    )
    counted = options.join(history, ["cell_key", "_family"], "left").fillna(0, ["_runs"])
    least = counted.groupBy("request_index", "cell_key").agg(
        F.array_sort(F.collect_list(F.struct("_runs", "_pos", "_family"))).alias("_all")  # one entry per family
    )
    tied = F.filter("_all", lambda x: x["_runs"] == F.get("_all", F.lit(0))["_runs"])
    turn = F.pmod(F.col("request_index") + F.lit(seed - 2), F.size(tied))
    return least.select(
        "request_index",
        "cell_key",
        F.get(tied, turn.cast("int"))["_family"].alias("geometry_family"),
        F.get("_all", F.lit(0))["_runs"].alias("historical_run_count"),
        F.size(tied).alias("tied_family_count"),
    )


def bootstrap_requests(spark: SparkSession, grid: CoverageGrid, *, purity_stride: int, diffusivity_stride: int,
                       families: Sequence[str], realizations: int, prefix: str) -> DataFrame:
    """One request per (speed, frequency, spacing) with purity, diffusivity and family cycling along."""
    ns, nf, ng = (grid.bin_count(a) for a in ("sws", "frequency", "discretization"))
    ordinal = F.col("id") + 1
    base = spark.range(ns * nf * ng).select(
        ordinal.alias("priority_rank"),
        (F.floor(F.col("id") / (nf * ng)) + 1).cast("int").alias("sws_bin"),
        (F.floor(F.col("id") / ng) % nf + 1).cast("int").alias("frequency_bin"),
        (F.col("id") % ng + 1).cast("int").alias("discretization_bin"),
        (F.col("id") * purity_stride % grid.bin_count("purity") + 1).cast("int").alias("purity_bin"),
        (F.col("id") * diffusivity_stride % grid.bin_count("diffusivity") + 1).cast("int").alias("diffusivity_bin"),
        F.get(F.array(*[F.lit(f) for f in families]), (F.col("id") % len(families)).cast("int")).alias("geometry_family"),
    )
    return base.select(
        "*",
        F.format_string(CELL_FORMAT, *BINS).alias("cell_key"),
        F.format_string(f"{prefix}_{CELL_FORMAT}_%03d", *BINS, "priority_rank").alias("condition_id"),
        F.lit(realizations).alias("planned_realization_count"),
    )


def interface_placement(requests: DataFrame, *, window: int, points: int, spacing_m: float, margin: int = 0) -> DataFrame:
    """Grid position of a straight interface that gives each request's purity in the window.

    One row per request: ``purity_lower``, ``purity_upper``, ``center_index``
    (1-based) and ``dominant_side``. Each lists its candidate positions (the
    domain is a fixed number of points); the window's purity has a closed form,
    and the best candidate by purity error, distance and index is kept.
    """
    half = window // 2
    low, high = F.col("center_index") - half, F.col("center_index") + half
    negative = F.col("dominant_side") == "negative"
    exact_one = (F.col("purity_lower") == 1) & (F.col("purity_upper") == 1)
    base = requests.withColumn("target_purity", (F.col("purity_lower") + F.col("purity_upper")) / 2.0)
    cand = base.withColumn("interface_index", F.explode(F.sequence(F.lit(1 + margin), F.lit(points - margin))))
    # Columns at or below the interface belong to the negative side (the positive side is strict).
    below = F.greatest(F.lit(0), F.least(F.lit(window), F.col("interface_index") - low + 1))
    share = below / F.lit(float(window))
    purity = F.greatest(share, 1 - share)
    side = F.when(negative, share).otherwise(1 - share)
    outside = F.when(negative, F.col("interface_index") > high).otherwise(F.col("interface_index") < low)
    cand = cand.select("*", purity.alias("discrete_purity"), side.alias("_side"), outside.alias("_outside"))
    p = F.col("discrete_purity")
    upper = (p < F.col("purity_upper")) | ((F.col("purity_upper") == 1) & (p == 1) & F.col("_outside"))
    ok = F.when(exact_one, (p == 1) & (F.col("_side") == 1) & F.col("_outside")).otherwise(
        (p >= F.col("purity_lower")) & upper & (F.col("_side") >= 0.5)
    )
    distance = (F.col("target_purity") - 0.5) * (window * spacing_m)
    position = (F.col("center_index") - 1) * spacing_m + F.when(negative, distance).otherwise(-distance)
    rounded = F.round(position / spacing_m) + 1
    rank = F.struct(
        F.abs(p - F.col("target_purity")), F.abs(F.col("interface_index") - rounded), F.col("interface_index").alias("i"), p.alias("p")
    )
    keys = requests.columns
    best = cand.groupBy(*keys, "target_purity").agg(
        F.min(F.when(ok, rank)).alias("_b"), F.count_if(ok).alias("feasible_candidate_count")
    )
    return best.select(
        *keys,
        "target_purity",
        "feasible_candidate_count",
        F.col("_b.i").alias("interface_grid_index"),
        F.col("_b.p").alias("predicted_discrete_purity"),
        (F.col("_b.i") - F.col("center_index")).alias("interface_offset_pixels"),
        ((F.col("_b.i") - F.col("center_index")) * spacing_m).alias("interface_offset_m"),
    )


def deficit_actions(runs: DataFrame, *, quota: int, maximum_supplementary: int) -> DataFrame:
    """Actions for incomplete conditions: a larger domain for every run that cannot hold its quota, or,
    when no run of the condition is short of room, supplementary realizations.

    ``runs`` has condition_id, run_id, realization_id, available_patch_count,
    selected_patch_count, deficit_patch_count, patch_width_px, stride_px, dx_m.
    """
    short = F.col("available_patch_count") < quota
    per_condition = runs.groupBy("condition_id").agg(
        F.max(short.cast("int")).alias("_short"),
        F.sum("deficit_patch_count").alias("_lack"),
        F.max("realization_id").alias("_last"),
    )
    incomplete = per_condition.where(F.col("_lack") > 0)
    placements = F.greatest(
        F.lit(12), F.round(F.sqrt(F.greatest(F.lit(1), F.col("available_patch_count")).cast("double"))).cast("int") + 2
    )
    larger = (
        runs.where(short)
        .join(incomplete, "condition_id")
        .select(
            "condition_id",
            F.lit("larger_domain").alias("action"),
            F.col("realization_id").cast("long").alias("realization_id"),
            ((F.col("patch_width_px") + (placements - 1) * F.col("stride_px") - 1) * F.col("dx_m")).alias("domain_m"),
            F.col("run_id").alias("replaces_run_id"),
            F.col("deficit_patch_count").alias("expected_patch_contribution"),
        )
    )
    needed = F.least(F.lit(maximum_supplementary), F.ceil(F.col("_lack") / F.lit(float(quota)))).cast("int")
    extra = incomplete.where("_short = 0").withColumn("_j", F.explode(F.sequence(F.lit(1), needed)))
    supplementary = extra.select(
        "condition_id",
        F.lit("supplementary_realization").alias("action"),
        (F.col("_last") + F.col("_j")).cast("long").alias("realization_id"),
        F.lit(None).cast("double").alias("domain_m"),
        F.lit("").alias("replaces_run_id"),
        F.greatest(F.lit(0), F.least(F.lit(quota), F.col("_lack") - (F.col("_j") - 1) * quota)).cast("long").alias(
            "expected_patch_contribution"
        ),
    )
    return larger.unionByName(supplementary)


def plan_coverage(plan: DataFrame, extracted: DataFrame, m_values: Sequence[int], *, quota: int) -> DataFrame:
    """Planned runs for every window size against extracted patches, with the missing ones as rows."""
    wanted = plan.withColumn("window_M", F.explode(F.array(*[F.lit(m) for m in m_values])))
    found = extracted.groupBy("run_id", "window_M").agg(F.count(F.lit(1)).alias("available_patch_count"))
    joined = wanted.join(found, ["run_id", "window_M"], "left").fillna(0, ["available_patch_count"])
    selected = F.least(F.col("available_patch_count"), F.lit(quota))
    status = F.when(F.col("available_patch_count") == 0, "missing").when(
        F.col("available_patch_count") < quota, "deficient"
    ).otherwise("complete")
    return joined.select(
        "*", selected.alias("selected_patch_count"), (F.lit(quota) - selected).alias("deficit_patch_count"), status.alias("status")
    )


def condition_coverage(runs: DataFrame) -> DataFrame:
    """Roll run coverage up to conditions and window sizes."""
    return runs.groupBy("condition_id", "window_M").agg(
        F.count(F.lit(1)).alias("planned_run_count"),
        F.count_if(F.col("status") == "complete").alias("complete_run_count"),
        F.count_if(F.col("status") == "missing").alias("missing_run_count"),
        F.sum("selected_patch_count").alias("selected_patch_count"),
        F.sum("deficit_patch_count").alias("deficit_patch_count"),
        F.min((F.col("status") == "complete").cast("int")).cast("boolean").alias("complete"),
    )


def phantom_feasibility(designs: DataFrame, *, geometry: str, angle_rad: float = 0.0) -> DataFrame:
    """How many windows of each design are pure in one material, and how many straddle the boundary.

    A design row has design_id, points, window_px, stride_px and, for the
    ``inclusion`` geometry, radius_px. The nearest and farthest pixel of a
    window decide its class in closed form, so no pixel table is needed.
    """
    half = F.floor(F.col("window_px") / 2).cast("int")
    last = (F.col("points") - 1 - half).cast("int")
    axis = F.when(last >= half, F.sequence(half, last, F.col("stride_px").cast("int"))).otherwise(F.array().cast("array<int>"))
    centers = designs.withColumn("cz", F.explode(axis)).withColumn("cx", F.explode(axis))
    mid = (F.col("points") - 1) / 2.0
    dx, dz = F.col("cx") - mid, F.col("cz") - mid
    if geometry == "inclusion":
        r = F.col("radius_px")
        gap = F.pmod(mid, F.lit(1.0))
        near = F.hypot(F.greatest(F.abs(dx) - half, gap), F.greatest(F.abs(dz) - half, gap))
        far = F.hypot(F.abs(dx) + half, F.abs(dz) + half)
        label = F.when(far <= r, "inclusion_core").when(near > r, "background_far").otherwise("interface_band")
    elif geometry == "bilayer":
        nx, nz = math.cos(angle_rad), math.sin(angle_rad)
        middle, reach = dx * nx + dz * nz, half * (abs(nx) + abs(nz))
        label = F.when(middle - reach >= 0, "layer2_core").when(middle + reach < 0, "layer1_core").otherwise("interface_band")
    else:
        raise ValueError("geometry must be inclusion or bilayer")
    return centers.withColumn("roi", label).groupBy("design_id", "roi").agg(F.count(F.lit(1)).alias("patch_count"))
