"""Window and field geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from fieldgrain.functions.semantics import clip, col, finite

TOLERANCE = 1e-10
FULL_SPHERE_SR = 4 * math.pi


def nominal_angular_coverage(
    directions: Column | str,
    solid_angle_sr: Column | str,
    maximum_directions: int = 128,
    maximum_solid_angle_sr: float = FULL_SPHERE_SR,
) -> Column:
    """Share of directions times share of the sphere; NULL outside the admissible window."""
    if maximum_directions < 1 or not 0 < maximum_solid_angle_sr <= FULL_SPHERE_SR:
        raise ValueError("the maxima must be positive and the solid angle at most a full sphere")
    n, angle = finite(directions), finite(solid_angle_sr)
    valid = (
        (n >= 1)
        & (n <= maximum_directions + TOLERANCE)
        & (F.abs(n - F.round(n)) <= TOLERANCE)
        & (angle >= -TOLERANCE)
        & (angle <= maximum_solid_angle_sr + TOLERANCE)
    )
    value = (clip(F.round(n), 1, maximum_directions) / F.lit(float(maximum_directions))) * (
        clip(angle, 0, maximum_solid_angle_sr) / F.lit(float(maximum_solid_angle_sr))
    )
    return F.when(valid, clip(value, 0, 1))


def nominal_field_class(
    directions: Column | str,
    solid_angle_sr: Column | str,
    *,
    directional_directions: float = 1,
    directional_solid_angle_sr: float = 0.1,
    broad_directions: float = 32,
    broad_solid_angle_sr: float = 2 * math.pi,
) -> Column:
    """0 invalid, 1 directional, 2 intermediate, 3 broad (broad wins when both match)."""
    n, angle = finite(directions), finite(solid_angle_sr)
    valid = (n >= 1) & (angle >= 0)
    broad = valid & (n >= broad_directions) & (angle >= broad_solid_angle_sr)
    directional = valid & (n <= directional_directions) & (angle <= directional_solid_angle_sr)
    return F.when(broad, 3).when(directional, 1).when(valid, 2).otherwise(0)


def odd_window(length_pixels: Column, minimum: int = 3) -> Column:
    """Nearest odd pixel count, at least ``minimum``."""
    half = F.floor(F.round(length_pixels) / 2)
    return F.greatest(F.lit(minimum), (half * 2 + 1)).cast("int")


def patch_geometry(
    m: Column | str,
    speed: Column | str,
    frequency_hz: Column | str,
    spacing_m: Column | str,
    *,
    placements: int = 10,
    minimum_stride: int = 4,
    stride_fraction: float = 0.5,
) -> dict[str, Column]:
    """Window of M guessed wavelengths, its stride, and the domain that holds ``placements`` windows per axis."""
    width = odd_window(col(m) * (col(speed) / col(frequency_hz)) / col(spacing_m))
    stride = F.greatest(F.lit(minimum_stride), F.ceil(F.lit(stride_fraction) * width)).cast("int")
    points = width + F.lit(placements - 1) * stride
    return {
        "patch_width_px": width,
        "stride_px": stride,
        "domain_points": points,
        "domain_m": (points - 1) * col(spacing_m),
        "available_patch_count": F.lit(placements * placements),
        "linear_overlap_fraction": F.greatest(F.lit(0.0), (width - stride) / width),
    }


def effective_window(m: Column | str, guess: Column | str, truth: Column | str, frequency_hz: Column | str) -> dict[str, Column]:
    """Guessed and true wavelength, and the window length in true wavelengths when it was sized with a guess."""
    speed = F.when(col(truth) > 0, col(truth))
    return {
        "wavelength_guess_m": col(guess) / col(frequency_hz),
        "wavelength_true_m": speed / col(frequency_hz),
        "M_effective": col(m) * col(guess) / speed,
    }
