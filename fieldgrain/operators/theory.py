"""Discrete theory quantiles for idealised fields, as a parameter sweep over distinct configurations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fieldgrain.functions.semantics import EPS, null_safe_join
from fieldgrain.operators.spectrum import frequency_grid, hann, smooth

FIELDS = ("SingleWave", "Diffuse2D", "Diffuse3D", "PartialDiffuse3D")


def ideal_power(field: str, n: int, dx: float, dz: float, k0: float) -> np.ndarray:
    """Ideal power of a field class on a centred n x n wavenumber grid."""
    i = np.arange(n) - n // 2
    kx, kz = i * (2 * math.pi / (n * dx)), i * (2 * math.pi / (n * dz))
    dk = min(kx[1] - kx[0], kz[1] - kz[0])
    kr = np.hypot(kx[None, :], kz[:, None])
    if field == "SingleWave":
        power = np.zeros((n, n))
        for target in (k0, -k0):
            power[np.abs(kz).argmin(), np.abs(kx - target).argmin()] = 1
        return power
    if field == "Diffuse2D":
        return (kx[None, :] / (kr + EPS)) ** 2 * (np.abs(kr - k0) <= 0.5 * dk)
    depth = np.sqrt(np.maximum(k0**2 - kr**2, max(dk**2, 1e-12)))
    return np.where(kr < k0, (1 - kz[:, None] ** 2 / k0**2) / depth, 0.0)


def spread_power(power: np.ndarray, window_power: np.ndarray) -> np.ndarray:
    """Centred same-size linear convolution of two square spectra."""
    n = power.shape[0]
    size = 2 * n
    full = np.fft.irfft2(np.fft.rfft2(power, (size, size)) * np.fft.rfft2(window_power, (size, size)), (size, size))
    start = n // 2
    return full[start : start + n, start : start + n]


def theory_value(field: str, dx: float, dz: float, frequency: float, speed: float, m: float, mode: str = "S2D",
                 pad: float = 1.0, sigma: float = 1.0, gamma: float = 1.0) -> float:
    """Quantile at the true wavenumber of an ideal field seen through the analysis window."""
    if field == "PartialDiffuse3D":
        parts = [theory_value(f, dx, dz, frequency, speed, m, mode, pad, sigma, gamma) for f in ("SingleWave", "Diffuse3D")]
        return float(np.mean(parts))
    k0 = 2 * math.pi * frequency / speed
    window = max(3, int(math.floor(m * speed / frequency / dx + 0.5)))
    window += window % 2 == 0
    side = window + 2 * int(math.floor(pad * window + 0.5))
    grid = frequency_grid(side, dx, dz)
    shown = np.abs(np.fft.fftshift(np.fft.fft2(hann(window, dx, dz, gamma), (side, side)))) ** 2
    shown /= shown.sum() + EPS
    count = grid["count"][:-1]

    def radial(p: np.ndarray) -> np.ndarray:
        return np.bincount(grid["bins"], p.ravel(), grid["nbins"] + 1)[:-1]

    if mode == "S2D":
        power = np.maximum(np.nan_to_num(ideal_power(field, side, dx, dz, k0)), 0)
        seen = spread_power(power / (power.sum() + EPS), shown)
        seen[side // 2, side // 2] = 0
        srad = radial(np.maximum(smooth(seen, sigma), 0)) / count
    else:
        k = grid["k_cent"]
        dk = 2 * math.pi / (side * max(dx, dz))
        if field == "Diffuse3D":
            depth = np.sqrt(np.maximum(k0**2 - k**2, max(dk**2, 1e-12)))
            shape = np.where(k < k0, (2 * k0**2 - k**2) / depth, 0.0)
        else:
            shape = (np.arange(len(k)) == np.abs(k - k0).argmin()).astype(float)
        kernel = radial(shown)
        srad = np.maximum(np.convolve(shape, kernel / (kernel.sum() + EPS))[len(k) // 2 : len(k) // 2 + len(k)], 0)
    total = srad.sum()
    if total <= EPS:
        return float("nan")
    curve, k = np.cumsum(srad) / total, grid["k_cent"]
    j = int(np.clip(np.searchsorted(k, k0) - 1, 0, len(k) - 2))
    return float(curve[j] + (k0 - k[j]) / (k[j + 1] - k[j]) * (curve[j + 1] - curve[j]))


CONFIG = ["dx_m", "dz_m", "frequency_hz", "speed_m_s", "window_M"]


def theory_table(configs: DataFrame, fields: tuple[str, ...] = FIELDS, mode: str = "S2D") -> DataFrame:
    """Theory value of every distinct configuration and field class, each computed once, spread over tasks."""
    @F.pandas_udf("double")
    def value(field: pd.Series, dx: pd.Series, dz: pd.Series, f: pd.Series, c: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([theory_value(*args, mode=mode) for args in zip(field, dx, dz, f, c, m)])

    value = value.asNondeterministic()
    wanted = configs.select(*CONFIG).distinct().withColumn("field_type", F.explode(F.array(*[F.lit(x) for x in fields])))
    # Few but expensive rows: a fixed partition count keeps them from being coalesced into one task.
    tasks = int(configs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = wanted.repartition(tasks, *CONFIG, "field_type")
    out = spread.withColumn("q_theory", value("field_type", *CONFIG))
    ok = (F.col("q_theory") >= 0) & (F.col("q_theory") <= 1) & ~F.isnan("q_theory")
    return out.withColumn("q_theory_valid", ok)


def attach_theory(rows: DataFrame, field_column: str, mode: str = "S2D") -> DataFrame:
    """Every row with the theory value of its configuration and field class."""
    table = theory_table(rows, mode=mode).withColumnRenamed("field_type", field_column)
    return null_safe_join(rows, table, [*CONFIG, field_column], "left")
