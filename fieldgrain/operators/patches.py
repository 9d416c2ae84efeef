"""Windows over long pixel tables: membership, truth statistics, purity, local mean and RMS.

A window is a row key ``(sample_id, cz, cx)``. Pixels find their windows by
arithmetic (each pixel lists the few grid centres that contain it), so the
containment join is never a range join, and one large sample spreads over
tasks by window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldgrain.functions.arrays import total
from fieldgrain.functions.semantics import require_columns
from fieldgrain.operators.sampling import lowest_hash

PATCH = ["sample_id", "cz", "cx"]


def grid_centers(samples: DataFrame, window: int, stride: int | None = None) -> DataFrame:
    """Centres of all windows that lie inside each sample, on a stride grid (half a window by default)."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    half = window // 2
    step = stride or max(1, half)

    def axis(n: str) -> Column:
        last = F.col(n) - 1 - half
        return F.when(last >= half, F.sequence(F.lit(half), last.cast("int"), F.lit(step))).otherwise(
            F.array().cast("array<int>")
        )

    return samples.select("sample_id", F.explode(axis("nz")).alias("cz"), axis("nx").alias("_x")).select(
        "sample_id", "cz", F.explode("_x").alias("cx")
    )


def center_layout(
    samples: DataFrame, window: int, layout: str, *, stride: int | None = None, count: int = 1, seed: int = 1,
    manual: DataFrame | None = None,
) -> DataFrame:
    """Window centres by layout: the middle, a grid, a seeded random subset of the grid, or given ones."""
    half = window // 2
    if layout == "center":
        fits = (F.col("nz") >= window) & (F.col("nx") >= window)
        return samples.where(fits).select(
            "sample_id", F.floor(F.col("nz") / 2).cast("int").alias("cz"), F.floor(F.col("nx") / 2).cast("int").alias("cx")
        )
    if layout == "grid":
        return grid_centers(samples, window, stride)
    if layout == "random":
        return lowest_hash(grid_centers(samples, window, stride), ["sample_id"], ["cz", "cx"], count, seed, "_r").drop("_r")
    if layout == "manual":
        inside = (
            (F.col("cz") >= half) & (F.col("cx") >= half)
            & (F.col("cz") < F.col("nz") - half) & (F.col("cx") < F.col("nx") - half)
        )
        return manual.join(samples.select("sample_id", "nz", "nx"), "sample_id").where(inside).select(*PATCH)
    raise ValueError(f"unknown window layout {layout!r}")


def grid_members(pixels: DataFrame, samples: DataFrame, window: int, stride: int | None = None) -> DataFrame:
    """Every (pixel, window) pair of a stride grid: at most ceil(window/stride)^2 rows per pixel."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    half = window // 2
    step = stride or max(1, half)

    def centers(i: str, n: str) -> Column:
        count = F.floor((F.col(n) - window) / step) + 1
        low = F.greatest(F.lit(0), F.ceil((F.col(i) - 2 * half) / step))
        high = F.least(count - 1, F.floor(F.col(i) / step))
        index = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(index, lambda j: (j * step + half).cast("int"))

    header = samples.select("sample_id", "nz", "nx", "dx_m", "dz_m")
    joined = pixels.join(header, "sample_id")
    with_z = joined.withColumn("cz", F.explode(centers("iz", "nz")))
    return with_z.withColumn("cx", F.explode(centers("ix", "nx"))).drop("nz", "nx")


def center_members(pixels: DataFrame, centers: DataFrame, window: int) -> DataFrame:
    """(pixel, window) pairs for explicit centres. Positions fall into tiles as wide as a window: each centre lists the
    four tiles at most that its window touches, meets their pixels by equality and keeps those inside.

    Pixels stream past a hash table of their task's centres. Spark does not see how far listed rows grow, so the size
    of this side must not decide on a broadcast.
    """
    half = window // 2
    width = 2 * half + 1

    def touched(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - half) / width), F.floor((F.col(c) + half) / width)))

    wanted = centers.withColumn("_tz", touched("cz")).withColumn("_tx", touched("cx"))
    placed = pixels.withColumn("_tz", F.floor(F.col("iz") / width)).withColumn("_tx", F.floor(F.col("ix") / width))
    inside = (F.abs(F.col("iz") - F.col("cz")) <= half) & (F.abs(F.col("ix") - F.col("cx")) <= half)
    met = wanted.hint("shuffle_hash").join(placed, ["sample_id", "_tz", "_tx"]).where(inside)
    keys = ["sample_id", "iz", "ix"]
    return met.select(*keys, *[c for c in [*centers.columns, *pixels.columns] if c not in keys])


def hann_weight(window: int, gamma: float = 1.0, dx: Column | str = "dx_m", dz: Column | str = "dz_m") -> Column:
    """Circular raised-cosine weight of a pixel in its window; zero outside the circle."""
    half = window // 2
    sx, sz = (F.col(c) if isinstance(c, str) else c for c in (dx, dz))
    distance = F.hypot((F.col("ix") - F.col("cx")) * sx, (F.col("iz") - F.col("cz")) * sz)
    radius = F.least(sx, sz) * (half * gamma)
    return F.when(distance <= radius, F.lit(0.5) * (1 + F.cos(F.lit(3.141592653589793) * distance / radius))).otherwise(0.0)


def patch_purity(members: DataFrame) -> DataFrame:
    """Share of the dominant material among valid pixels of each window; ties go to the smallest id."""
    counts = members.where("valid").groupBy(*PATCH, "material_id").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct(-F.col("_n"), F.col("material_id").alias("m")))
    return counts.groupBy(*PATCH).agg(best.alias("_b"), F.sum("_n").alias("_t")).select(
        *PATCH,
        F.col("_b.m").alias("truth_material_id_dominant"),
        (-F.col("_b.col1") / F.col("_t")).alias("truth_material_purity"),
    )


def patch_truth(members: DataFrame) -> DataFrame:
    """Speed at the centre and its statistics over valid pixels of the window (a window is a bounded group)."""
    center = (F.col("iz") == F.col("cz")) & (F.col("ix") == F.col("cx"))
    speed = F.when(F.col("valid"), F.col("cs_true"))
    return members.groupBy(*PATCH).agg(
        F.max(F.when(center, F.col("cs_true"))).alias("truth_cs_center_m_s"),
        F.max(F.when(center, F.col("material_id"))).alias("truth_material_id_center"),
        F.avg(speed).alias("truth_cs_mean_m_s"),
        F.median(speed).alias("truth_cs_median_m_s"),
        F.when(F.count(speed) > 1, F.stddev_samp(speed)).when(F.count(speed) == 1, 0.0).alias("truth_cs_std_m_s"),
        F.min(speed).alias("truth_cs_min_m_s"),
        F.max(speed).alias("truth_cs_max_m_s"),
        F.avg(F.col("valid").cast("double")).alias("truth_valid_fraction"),
    )


def patch_arrays(members: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per window with its pixels as arrays in row-major order; invalid pixels are NULL."""
    ok = F.col("valid")
    cell = F.struct(
        (F.col("iz") - F.col("cz")).alias("z"),
        (F.col("ix") - F.col("cx")).alias("x"),
        F.when(ok, F.col("re")).alias("re"),
        F.when(ok, F.col("im")).alias("im"),
    )
    grouped = members.groupBy(*PATCH).agg(
        F.array_sort(F.collect_list(cell)).alias("_c"),
        F.first("dx_m").alias("dx_m"),
        F.first("dz_m").alias("dz_m"),
        *[F.first(c).alias(c) for c in extra],
    )
    return grouped.select(
        *PATCH,
        "dx_m",
        "dz_m",
        *extra,
        F.transform("_c", lambda c: c["re"]).alias("re"),
        F.transform("_c", lambda c: c["im"]).alias("im"),
    )


def preprocess_statistics(members: DataFrame, window: int, *, minimum_valid: float = 0.0) -> DataFrame:
    """Window-weighted complex mean, RMS after mean removal and windowing, and validity with its reason.

    Computed from weighted moments around the centre value, in one aggregation
    with map-side combine: subtracting the centre first keeps the moments
    well-conditioned.
    """
    center = (F.col("iz") == F.col("cz")) & (F.col("ix") == F.col("cx"))
    ok = F.col("valid") & F.col("re").isNotNull() & F.col("im").isNotNull()
    rows = members.select(
        *PATCH,
        F.when(ok, hann_weight(window)).otherwise(0.0).alias("_w"),
        F.when(ok, F.col("re")).alias("_a"),
        F.when(ok, F.col("im")).alias("_b"),
        ok.alias("_ok"),
        center.alias("_c"),
    )
    cells = rows.groupBy(*PATCH).agg(
        F.collect_list(F.when(F.col("_ok"), F.struct("_w", "_a", "_b"))).alias("_p"),
        F.sum("_w").alias("weight_sum"),
        F.avg(F.col("_ok").cast("double")).alias("valid_fraction"),
        F.max(F.col("_c") & F.col("_ok")).alias("center_valid"),
        F.sum(F.col("_w") * F.col("_a")).alias("_wa"),
        F.sum(F.col("_w") * F.col("_b")).alias("_wb"),
        F.count(F.lit(1)).alias("_n"),
    )
    cells = cells.withColumn("mean_re", F.col("_wa") / F.nullif(F.col("weight_sum"), F.lit(0.0))).withColumn(
        "mean_im", F.col("_wb") / F.nullif(F.col("weight_sum"), F.lit(0.0))
    )
    power = F.transform(
        "_p",
        lambda p: p["_w"] * p["_w"] * (
            (p["_a"] - F.col("mean_re")) * (p["_a"] - F.col("mean_re"))
            + (p["_b"] - F.col("mean_im")) * (p["_b"] - F.col("mean_im"))
        ),
    )
    cells = cells.withColumn("rms", F.sqrt(total(power) / F.col("_n")))
    reason = (
        F.when(~F.col("center_valid"), "invalid_center")
        .when(F.col("valid_fraction") < minimum_valid, "too_few_valid_pixels")
        .when(F.col("weight_sum") <= 0, "no_window_weight")
        .when(F.col("rms") <= 2.220446049250313e-16, "no_energy")
        .otherwise("ok")
    )
    return cells.select(
        *PATCH, "valid_fraction", "weight_sum", "mean_re", "mean_im", "rms", reason.alias("reason")
    )


def example_id(sample: Column | str = "sample_id") -> Column:
    s = F.col(sample) if isinstance(sample, str) else sample
    return F.concat(s.cast("string"), F.format_string("__z%05d_x%05d", F.col("cz"), F.col("cx")))


def readiness(pixels: DataFrame, samples: DataFrame, *, speed_guess: float, wavelengths: float, placements: int = 5) -> DataFrame:
    """Six checks per sample: finite, nonzero energy, window fits and enough placements along both axes."""
    require_columns(samples, ["sample_id", "nz", "nx", "dx_m", "dz_m", "frequency_hz"], "samples")
    energy = pixels.groupBy("sample_id").agg(
        F.min((F.col("re").isNotNull() & F.col("im").isNotNull()).cast("int")).alias("_finite"),
        F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("_energy"),
    )
    length = F.lit(wavelengths) * (F.lit(speed_guess) / F.col("frequency_hz"))
    base = samples.join(energy, "sample_id", "left").select(
        "*",
        (F.ceil(length / F.col("dx_m")) + 1).alias("_wx"),
        (F.ceil(length / F.col("dz_m")) + 1).alias("_wz"),
    )
    px = F.greatest(F.col("nx") - F.col("_wx") + 1, F.lit(0))
    pz = F.greatest(F.col("nz") - F.col("_wz") + 1, F.lit(0))
    d = lambda c: c.cast("double")
    checks = [
        ("finite_wavefield", F.coalesce(F.col("_finite") == 1, F.lit(False)), d(F.col("_finite")), F.lit(1.0)),
        ("nonzero_wavefield_energy", F.coalesce(F.col("_energy") > 0, F.lit(False)), F.col("_energy"), F.lit(0.0)),
        ("x_window_fits", F.col("nx") >= F.col("_wx"), d(F.col("nx")), d(F.col("_wx"))),
        ("z_window_fits", F.col("nz") >= F.col("_wz"), d(F.col("nz")), d(F.col("_wz"))),
        ("minimum_x_placements", px >= placements, d(px), F.lit(float(placements))),
        ("minimum_z_placements", pz >= placements, d(pz), F.lit(float(placements))),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("check_name"), ok.alias("passed"), v.alias("value"), want.alias("expected"))
            for n, ok, v, want in checks
        ]
    )
    return base.select("sample_id", F.explode(rows).alias("_c")).select("sample_id", "_c.*")
