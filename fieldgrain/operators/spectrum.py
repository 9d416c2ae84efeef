"""From windows to spectra and features.

The two-dimensional FFT is the one step SQL cannot express well: it runs as an
Arrow-batched function over window arrays, many windows per call. It returns
short arrays (radial power, power by distinct wavenumber); everything after
that is column expressions and grouped sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fieldgrain.functions import arrays as A
from fieldgrain.functions.semantics import EPS
from fieldgrain.operators.curves import radial_features, shape_features, with_ecum
from fieldgrain.operators.patches import PATCH

ANGLE_BINS = 72
#: Cells of transforms that a task holds at once (4 MB as complex numbers).
BATCH_CELLS = 2**18
SPECTRUM_TYPE = (
    "struct<valid:boolean,nbins:int,k_cent:array<double>,srad:array<double>,"
    "k_shell:array<double>,w_shell:array<double>,power:array<double>>"
)


@lru_cache(maxsize=64)
def frequency_grid(n: int, dx: float, dz: float) -> dict:
    """Wavenumber magnitude, radial bins and distinct-wavenumber shells of a centred n x n transform."""
    i = np.arange(n) - n // 2
    dkx, dkz = 2 * math.pi / (n * dx), 2 * math.pi / (n * dz)
    kr = np.hypot(i[None, :] * dkx, i[:, None] * dkz)
    kmax = min(np.abs(i).max() * dkx, np.abs(i).max() * dkz)
    nbins = max(16, int(math.floor(kmax / min(dkx, dkz) + 0.5)))
    # Nudged so that a cell on the closing edge stays in the last bin.
    bins = np.minimum(np.floor(kr / kmax * nbins + 1e-9).astype(int), nbins - 1)
    bins[kr > kmax * (1 + 1e-12)] = nbins
    shell_k, shell = np.unique(np.round(kr / min(dkx, dkz), 9), return_inverse=True)
    return {
        "kr": kr,
        "nbins": nbins,
        "k_cent": (np.arange(nbins) + 0.5) * kmax / nbins,
        "bins": bins.ravel(),
        "count": np.maximum(np.bincount(bins.ravel(), minlength=nbins + 1), 1),
        "shell_k": shell_k * min(dkx, dkz),
        "shell": shell.ravel(),
    }


@lru_cache(maxsize=64)
def angle_slots(n: int, dx: float, dz: float) -> np.ndarray:
    """Angle bin of every cell of a centred n x n transform."""
    i = np.arange(n) - n // 2
    angle = np.arctan2(i[:, None] / dz, i[None, :] / dx).ravel() % (2 * math.pi)
    return np.floor(angle * (ANGLE_BINS / (2 * math.pi)) + 1e-9).astype(int) % ANGLE_BINS


def smooth(power: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian over the last two axes, 2*ceil(2*sigma)+1 taps, edges repeated."""
    if sigma <= 0:
        return power
    radius = math.ceil(2 * sigma)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps /= taps.sum()
    for axis in (-2, -1):
        pad = [(0, 0)] * power.ndim
        pad[axis] = (radius, radius)
        wide = np.pad(power, pad, mode="edge")
        n = power.shape[axis]
        power = sum(t * np.take(wide, range(j, j + n), axis=axis) for j, t in enumerate(taps))
    return power


def hann(window: int, dx: float, dz: float, gamma: float) -> np.ndarray:
    i = np.arange(window) - window // 2
    r = np.hypot(i[None, :] * dx, i[:, None] * dz)
    radius = gamma * min(dx, dz) * (window // 2)
    return np.where(r <= radius, 0.5 * (1 + np.cos(np.pi * r / radius)), 0.0)


def prepare(field: np.ndarray, weight: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean removal, windowing and normalisation of a batch of windows; the flag marks usable ones."""
    half = field.shape[-1] // 2
    ok = np.isfinite(field)
    filled = np.where(ok, field, 0)
    if method == "plain":
        shaped = (filled - filled.mean((1, 2), keepdims=True)) * weight
        size = shaped[0].size
        spread = np.sqrt((np.abs(shaped - shaped.mean((1, 2), keepdims=True)) ** 2).sum((1, 2)) / (size - 1))
        return shaped / (spread + EPS)[:, None, None], ok.all((1, 2))
    w = np.where(ok, weight, 0.0)
    total = w.sum((1, 2))
    mean = (filled * w).sum((1, 2)) / np.where(total > 0, total, 1)
    shaped = (filled - mean[:, None, None]) * w
    rms = np.sqrt((np.abs(shaped) ** 2).mean((1, 2)))
    usable = ok[:, half, half] & (total > 0) & (rms > EPS)
    return shaped / np.where(usable, rms, 1)[:, None, None], usable


def pass_band(kr: np.ndarray, low: np.ndarray, high: np.ndarray, taper: float) -> np.ndarray:
    """Annular gain per window: one inside, raised-cosine flanks, zero outside."""
    low, high = low[:, None, None], high[:, None, None]
    width = np.maximum(taper * (high - low), EPS)
    rise = 0.5 * (1 - np.cos(np.pi * np.clip((kr - low) / width, 0, 1)))
    fall = 0.5 * (1 - np.cos(np.pi * np.clip((high - kr) / width, 0, 1)))
    return np.where((kr >= low) & (kr <= high), np.minimum(rise, fall), 0.0)


def spectrum_function(
    window: int, *, pad: float = 1.0, sigma: float = 1.0, gamma: float = 1.0, keep_power: bool = False,
    method: str = "weighted", band_speeds: tuple[float, float] | None = None, band_taper: float = 0.06,
):
    """Arrow-batched power spectrum of windows of one width; see :data:`SPECTRUM_TYPE` for the result."""
    side = window + 2 * round(pad * window)
    step = max(1, BATCH_CELLS // side**2)

    def spectra(re: pd.Series, im: pd.Series, dx: pd.Series, dz: pd.Series, f0: pd.Series) -> pd.DataFrame:
        def stack(s: pd.Series) -> np.ndarray:
            return np.stack([np.asarray(v, dtype=float) for v in s]).reshape(-1, window, window)

        rows: list = [None] * len(re)
        spacing = list(zip(dx, dz))
        for d in set(spacing):
            picked = [i for i, s in enumerate(spacing) if s == d]
            grid = frequency_grid(side, *d)
            field = stack(re.iloc[picked]) + 1j * stack(im.iloc[picked])
            shaped, usable = prepare(field, hann(window, *d, gamma), method)
            spectrum_2d = np.fft.fftshift(np.fft.fft2(shaped, s=(side, side)), axes=(1, 2))
            if band_speeds:
                f = 2 * math.pi * f0.iloc[picked].to_numpy(float)
                gain = pass_band(grid["kr"], f / max(band_speeds), f / min(band_speeds), band_taper)
                spectrum_2d = spectrum_2d * gain
            power = np.abs(spectrum_2d) ** 2
            power[:, side // 2, side // 2] = 0
            power = smooth(power, sigma)
            if method == "plain":
                power = power / (power.sum((1, 2), keepdims=True) + EPS)
            for i, p, good in zip(picked, power.reshape(len(picked), -1), usable):
                radial = np.bincount(grid["bins"], p, grid["nbins"] + 1)[:-1] / grid["count"][:-1]
                shells = np.bincount(grid["shell"], p)
                rows[i] = (
                    bool(good), grid["nbins"], grid["k_cent"], radial if good else None,
                    grid["shell_k"] if good else None, shells if good else None, p if keep_power and good else None,
                )
        names = ["valid", "nbins", "k_cent", "srad", "k_shell", "w_shell", "power"]
        return pd.DataFrame(rows, columns=names)

    # An Arrow batch has ten thousand windows, whose transforms are far larger than their pixels: each is worked off and
    # handed back in parts.
    @F.pandas_udf(SPECTRUM_TYPE)
    def spectrum(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch[0]), step):
                yield spectra(*[s.iloc[start : start + step] for s in batch])

    # Marked so that the optimizer never copies the call below a later filter and runs the FFT twice.
    return spectrum.asNondeterministic()


def patch_spectra(patches: DataFrame, window: int, frequency: str = "frequency_hz", **options) -> DataFrame:
    """Radial and shell power of every window row of :func:`fieldgrain.operators.patches.patch_arrays`."""
    function = spectrum_function(window, **options)
    whole = (F.size("re") == window * window)
    out = patches.where(whole).withColumn("_s", function("re", "im", "dx_m", "dz_m", F.col(frequency)))
    return out.drop("re", "im").select("*", "_s.*").drop("_s")


def angular_energy(spectra: DataFrame, window: int, pad: float = 1.0, *, band_iqr: float = 1.0) -> DataFrame:
    """Ring energy in 72 angle bins per window, from the kept power cells.

    The ring is the median wavenumber plus or minus its quartile range. Cells
    of one window leave one task, so the sum is combined before the shuffle.
    """
    side = window + 2 * round(pad * window)
    half = F.greatest(F.col("iqr_k") * band_iqr, F.lit(EPS))
    ring = spectra.where("valid").select(
        *PATCH,
        F.greatest(F.lit(0.0), F.col("k_q50") - half).alias("_lo"),
        (F.col("k_q50") + half).alias("_hi"),
        (F.lit(2 * math.pi / side) / F.col("dx_m")).alias("_dkx"),
        (F.lit(2 * math.pi / side) / F.col("dz_m")).alias("_dkz"),
        "power",
    )
    # A second projection, so that the ring limits are computed per window and not per exploded cell.
    ring = ring.select(*PATCH, "_lo", "_hi", "_dkx", "_dkz", F.posexplode("power").alias("_i", "_p"))
    kx = (F.col("_i") % side - side // 2) * F.col("_dkx")
    kz = (F.floor(F.col("_i") / side) - side // 2) * F.col("_dkz")
    cells = ring.select(*PATCH, "_lo", "_hi", "_p", kx.alias("_kx"), kz.alias("_kz"))
    # A conditional sum, not a filter: a filter on the limits would be pushed below the arrays and repeat their work.
    k = F.hypot("_kx", "_kz")
    inside = F.when((k >= F.col("_lo")) & (k <= F.col("_hi")), F.col("_p"))
    theta = F.atan2("_kz", "_kx")
    theta = F.when(theta < 0, theta + 2 * math.pi).otherwise(theta)
    # The nudge keeps exact multiples of the bin width in the bin they open.
    slot = F.floor(theta * (ANGLE_BINS / (2 * math.pi)) + 1e-9).cast("int") % ANGLE_BINS
    return cells.groupBy(*PATCH, slot.alias("angle_bin")).agg(F.coalesce(F.sum(inside), F.lit(0.0)).alias("energy"))


def ring_histogram(spectra: DataFrame, window: int, pad: float = 1.0, *, band_iqr: float = 1.0, out: str = "pang") -> DataFrame:
    """Same ring energy as :func:`angular_energy`, as a 72-element array on the row, without a shuffle."""
    side = window + 2 * round(pad * window)

    @F.pandas_udf("array<double>")
    def ring(power: pd.Series, low: pd.Series, high: pd.Series, dx: pd.Series, dz: pd.Series) -> pd.Series:
        def histogram(p, lo, hi, sx, sz):
            if p is None or lo is None or lo != lo:
                return None
            kr, slot = frequency_grid(side, sx, sz)["kr"].ravel(), angle_slots(side, sx, sz)
            inside = (kr >= lo) & (kr <= hi)
            return np.bincount(slot[inside], np.asarray(p)[inside], ANGLE_BINS)

        return pd.Series([histogram(*row) for row in zip(power, low, high, dx, dz)])

    half = F.greatest(F.col("iqr_k") * band_iqr, F.lit(EPS))
    low = F.greatest(F.lit(0.0), F.col("k_q50") - half)
    return spectra.withColumn(out, ring.asNondeterministic()("power", low, F.col("k_q50") + half, "dx_m", "dz_m"))


def angular_histogram(energy: DataFrame) -> DataFrame:
    """Dense array of ring energy by angle bin (missing bins are zero)."""
    pairs = energy.groupBy(*PATCH).agg(F.map_from_entries(F.collect_list(F.struct("angle_bin", "energy"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(ANGLE_BINS - 1)), lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0.0)))
    return pairs.select(*PATCH, dense.alias("pang"))


def separated_peaks(values: str, suppression: int, count: int):
    """Greedy maxima of a circular array: take the highest bin, silence its neighbours, repeat."""
    low = F.lit(float("-inf"))
    empty_v, empty_i = F.array().cast("array<double>"), F.array().cast("array<int>")
    start = F.struct(F.col(values).alias("left"), empty_v.alias("values"), empty_i.alias("bins"))

    def take(state, _):
        def mark(top):
            def silence(at):
                size = F.size(state["left"])
                return F.struct(
                    F.transform(
                        state["left"],
                        lambda x, i: F.when(F.pmod(i - at + suppression, size) <= 2 * suppression, low).otherwise(x),
                    ).alias("left"),
                    F.concat(state["values"], F.array(top)).alias("values"),
                    F.concat(state["bins"], F.array(at)).alias("bins"),
                )

            found = A.let(F.array_position(state["left"], top).cast("int") - 1, silence)
            return F.when(top > low, found).otherwise(state)

        return A.let(F.array_max(state["left"]), mark)

    return F.aggregate(F.sequence(F.lit(1), F.lit(count)), start, take)


def angular_features(histogram: DataFrame, *, smooth_bins: int = 3, window_deg: float = 20.0,
                     suppression_deg: float = 30.0, peaks: int = 8, peak_ratio: float = 0.35) -> DataFrame:
    """Fourteen rotation-invariant features of the angular ring energy."""
    n, step = ANGLE_BINS, 360.0 / ANGLE_BINS
    window = max(1, round(window_deg / step))
    suppression = max(window, round(suppression_deg / step))
    left = (smooth_bins - 1) // 2
    filled = F.when(A.total("pang") > 0, F.col("pang"))
    base = histogram.withColumn("_p", A.scaled(filled, A.total("pang") + EPS))
    base = base.withColumn("_p", A.moving_mean("_p", left, left))
    base = base.withColumn("_p", A.scaled("_p", A.total("_p") + EPS))
    base = base.withColumn("_win", A.circular_sum("_p", window))

    def moment(order: int):
        # The bin angles are the same on every row, so their cosines and sines are literal arrays.
        angles = [order * (i + 0.5) * (2 * math.pi / n) for i in range(n)]
        cosines, sines = (F.array(*[F.lit(f(a)) for a in angles]) for f in (math.cos, math.sin))
        return F.hypot(A.dot("_p", cosines), A.dot("_p", sines))

    base = base.withColumns({f"_m{order}": moment(order) for order in (1, 2, 4)})
    # The shape features see the histogram normalised once more, which only shifts the last digit.
    base = base.withColumn("_k", separated_peaks("_win", suppression, peaks))
    base = base.withColumn("_v", F.col("_k.values")).withColumn("_b", F.col("_k.bins"))
    top = lambda i: F.coalesce(F.get("_v", F.lit(i)), F.lit(0.0))
    gap = F.abs(F.get("_b", F.lit(0)) - F.get("_b", F.lit(1))) * step
    features = {
        "ang_entropy": A.entropy("_p", F.lit(n)),
        "circ_var": F.lit(1.0) - F.col("_m1"),
        "dom_dir_frac": F.array_max("_p"),
        "window_max_frac": F.array_max("_win"),
        "window_cf": F.array_max("_win") / (min(1.0, window_deg / 360.0) + EPS),
        "ang_moment_1": F.col("_m1"),
        "ang_moment_2": F.col("_m2"),
        "ang_moment_4": F.col("_m4"),
        "ang_peak_count_rel": F.size(F.filter("_v", lambda v: v >= F.get("_v", F.lit(0)) * peak_ratio)).cast("double"),
        "ang_top1_window_frac": top(0),
        "ang_top2_window_frac": top(0) + top(1),
        "ang_top3_window_frac": top(0) + top(1) + top(2),
        "ang_top2_to_top1": top(1) / (top(0) + EPS),
        "ang_peak_separation_deg": F.coalesce(F.least(gap, F.lit(360.0) - gap), F.lit(0.0)),
    }
    return base.select(*histogram.columns, *[F.when(F.col("_p").isNotNull(), c).alias(f) for f, c in features.items()])


RADIAL_FEATURES = [
    "radial_entropy", "width_75_25_rel", "width_90_50_rel", "width_90_10_rel",
    "lowk_frac_rel", "midband_frac_rel", "highk_frac_rel",
]


def patch_features(patches: DataFrame, window: int, frequency: str = "frequency_hz", **options) -> DataFrame:
    """All features of every window: cumulative mapping, radial, angular and curve-shape columns.

    An unusable window stays a row with NULL features.
    """
    spectra = patch_spectra(patches, window, frequency, keep_power=True, **options)
    radial = radial_features(spectra, "k_shell", "w_shell")
    ring = ring_histogram(radial, window, options.get("pad", 1.0)).drop("power", "k_shell", "w_shell")
    return shape_features(with_ecum(angular_features(ring).drop("pang")))
