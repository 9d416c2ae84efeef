"""Figures of every window of a pixel map, from tiles with a rim: each pixel travels once per tile that needs it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldgrain.operators.coverage import CoverageGrid, assign_coverage


def with_tiles(pixels: DataFrame, half: int, tile: int) -> DataFrame:
    """Every pixel once for each tile whose windows reach it: the tile it lies in, and those whose rim it stands in."""
    if tile <= 2 * half:
        raise ValueError("tiles must be larger than the window")
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / tile), F.floor((F.col(c) + half) / tile)))
    return pixels.withColumn("tile_z", near("iz")).withColumn("tile_x", near("ix"))


def box_sums(mask: np.ndarray, size: int) -> np.ndarray:
    """Sums of a mask over every size x size window, by four lookups in its summed-area table."""
    table = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), np.int64)
    table[1:, 1:] = mask.cumsum(0).cumsum(1)
    return table[size:, size:] - table[:-size, size:] - table[size:, :-size] + table[:-size, :-size]


def window_truth(pixels: DataFrame, window: int, *, step: int = 1, tile: int = 128, sample: str = "sample_id") -> DataFrame:
    """sample, cz, cx, truth_cs_center_m_s, truth_valid_fraction, truth_material_purity of every candidate window.

    ``pixels``: sample, iz, ix, cs_true, material_id, valid; absent pixels count as invalid. Candidates are the centres,
    ``step`` apart from the first corner on, whose window lies inside the sample's bounds. Purity is the share of the
    most frequent material among the valid pixels, null without any. A task holds one tile and its rim.
    """
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    half, kind = window // 2, dict(pixels.dtypes)[sample]
    bounds = pixels.groupBy(sample).agg(*[f(c).alias(f"{n}_{c}") for c in ("iz", "ix") for n, f in (("low", F.min), ("high", F.max))])
    placed = with_tiles(pixels.select(sample, "iz", "ix", "cs_true", "material_id", "valid"), half, tile).join(bounds, sample)

    def measure(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()
        one = {c: table.column(c)[0].as_py() for c in (sample, "tile_z", "tile_x", "low_iz", "high_iz", "low_ix", "high_ix")}
        top, left, side = one["tile_z"] * tile - half, one["tile_x"] * tile - half, tile + 2 * half
        z, x = get("iz") - top, get("ix") - left
        valid, speed, material = np.zeros((side, side), bool), np.full((side, side), np.nan), np.zeros((side, side), np.int64)
        valid[z, x] = table.column("valid").fill_null(False).to_numpy()
        speed[z, x] = table.column("cs_true").cast(pa.float64()).fill_null(np.nan).to_numpy()
        names, at = np.unique(get("material_id"), return_inverse=True)
        material[z, x] = at
        count = box_sums(valid, window)
        most = np.zeros_like(count)
        for i in range(len(names)):
            most = np.maximum(most, box_sums(valid & (material == i), window))
        axis = lambda first, low, high: [c for c in range(first, first + tile) if low + half <= c <= high - half and (c - low - half) % step == 0]
        cz, cx = axis(one["tile_z"] * tile, one["low_iz"], one["high_iz"]), axis(one["tile_x"] * tile, one["low_ix"], one["high_ix"])
        gz, gx = [g.ravel() for g in np.meshgrid(cz, cx, indexing="ij")]
        gz, gx = gz.astype(int), gx.astype(int)
        n = count[gz - one["tile_z"] * tile, gx - one["tile_x"] * tile]
        m = most[gz - one["tile_z"] * tile, gx - one["tile_x"] * tile]
        centre = speed[gz - top, gx - left]
        purity = pa.array(m / np.maximum(n, 1), mask=n == 0)
        columns = [pa.array([one[sample]] * len(gz), table.schema.field(sample).type), pa.array(gz, pa.int32()), pa.array(gx, pa.int32()), pa.array(centre, mask=np.isnan(centre)), pa.array(n / window**2), purity]
        return pa.table(columns, [sample, "cz", "cx", "truth_cs_center_m_s", "truth_valid_fraction", "truth_material_purity"])

    schema = f"{sample} {kind}, cz int, cx int, truth_cs_center_m_s double, truth_valid_fraction double, truth_material_purity double"
    return placed.groupBy(sample, "tile_z", "tile_x").applyInArrow(measure, schema)


def center_candidates(windows: DataFrame, grid: CoverageGrid, *, minimum_valid: float = 1.0) -> DataFrame:
    """Candidates with their coverage cell and what becomes of them (``outcome``): eligible, too few valid pixels, or no
    cell. ``windows`` also has the columns that the grid's other axes name."""
    assigned = assign_coverage(windows, grid)
    outcome = F.when(~F.col("coverage_valid"), "out_of_range").when(F.col("truth_valid_fraction") < minimum_valid, "too_few_valid").otherwise("eligible")
    return assigned.withColumn("outcome", outcome)
