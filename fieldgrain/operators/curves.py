"""Radial power curves: cumulative mapping, quantile lookups, shape features, band filter, peaks.

All operators read array columns ``k_cent`` and ``srad`` (or ``ecum``) of one
row and add columns: narrow projections without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from fieldgrain.functions import arrays as A
from fieldgrain.functions.semantics import EPS, clip, ratio


def with_ecum(rows: DataFrame, srad: str = "srad", out: str = "ecum") -> DataFrame:
    """Cumulative radial power over its total; elements are NULL for an empty spectrum."""
    nonneg = F.transform(srad, lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
    return rows.withColumn("_cum", A.running_sum(nonneg)).withColumn(
        out, A.scaled("_cum", F.element_at("_cum", -1))
    ).drop("_cum")


def with_mapping(rows: DataFrame, precision: str = "float") -> DataFrame:
    """Compact mapping struct (curve, wavenumbers, frequency, bin count) in single or double precision."""
    kind = f"array<{precision}>"
    return rows.withColumn(
        "mapping",
        F.struct(
            F.col("k_cent").cast(kind).alias("k_cent"),
            F.col("ecum").cast(kind).alias("ecum"),
            F.col("f0").alias("f0"),
            F.size("k_cent").alias("nbins"),
        ),
    )


def quantile_to_wavenumber(q: Column, ecum: Column | str = "ecum", k: Column | str = "k_cent") -> Column:
    return A.inverse_lookup(ecum, k, q)


def wavenumber_to_quantile(k_target: Column, k: Column | str = "k_cent", ecum: Column | str = "ecum") -> Column:
    return A.forward_lookup(k, ecum, k_target)


def quantile_mode(mode: str, *, local: Column, fixed: float | None = None, theory: Column | None = None,
                  provided: Column | None = None) -> Column:
    """Which quantile reads the curve: the local truth, a constant, a theory value or a given one."""
    choices = {"local": local, "fixed": F.lit(fixed), "theory": theory, "provided": provided}
    if mode not in choices or choices[mode] is None:
        raise ValueError(f"quantile mode {mode!r} is unknown or lacks its value")
    return clip(choices[mode], 0.0, 1.0)


def with_speed(rows: DataFrame, q_pred: Column, truth: Column, f0: str = "f0") -> DataFrame:
    """Predicted wavenumber and speed with error columns and a validity flag."""
    out = rows.withColumn("k_pred_rad_m", quantile_to_wavenumber(q_pred)).withColumn("cs_true_m_s", truth)
    out = out.withColumn(
        "cs_pred_m_s",
        F.when(F.col("k_pred_rad_m") > 0, F.lit(2 * math.pi) * F.col(f0) / F.col("k_pred_rad_m")),
    )
    error = F.col("cs_pred_m_s") - F.col("cs_true_m_s")
    percent = F.when(F.col("cs_true_m_s") > 0, F.lit(100.0) * error / F.col("cs_true_m_s"))
    return out.select(
        "*",
        error.alias("cs_error_m_s"),
        percent.alias("cs_error_percent"),
        F.abs(percent).alias("cs_absolute_error_percent"),
        (F.col("cs_pred_m_s").isNotNull() & (F.col("cs_true_m_s") > 0)).alias("sws_valid"),
    )


LEVELS = {"k10": 0.10, "k25": 0.25, "k50": 0.50, "k75": 0.75, "k90": 0.90}


def shape_features(rows: DataFrame, k: str = "k_cent", ecum: str = "ecum") -> DataFrame:
    """Nineteen shape features of the cumulative curve and eight of its increments."""
    base = rows.withColumn("_k", F.filter(k, lambda x: x > 0))
    base = base.withColumn("_m", A.running_max(ecum))
    usable = (F.size("_m") >= 3) & (F.array_max("_m") > F.array_min("_m"))
    limits = F.struct(F.array_min("_m").alias("low"), F.array_max("_m").alias("high"))
    unit = A.let(limits, lambda t: F.transform("_m", lambda x: (x - t["low"]) / (t["high"] - t["low"])))
    base = base.withColumn("_E", F.when(usable, unit))
    base = base.select("*", *[A.inverse_lookup("_E", "_k", q).alias(f"_{n}") for n, q in LEVELS.items()])
    base = base.withColumn("_x", A.scaled("_k", F.array_max("_k")))
    base = base.withColumn("_dE", F.transform(A.differences("_E"), lambda d: F.greatest(d, F.lit(0.0))))
    base = base.withColumn("_p", A.scaled("_dE", A.total("_dE"))).withColumn(
        "_slope", F.zip_with("_dE", A.differences("_x"), lambda a, b: a / b)
    )
    base = base.withColumn("_c", A.midpoints("_x"))
    base = base.withColumn("_mu", A.dot("_p", "_c"))
    mu = F.col("_mu")

    def moment(n: int) -> Column:
        def power(c: Column, m: Column) -> Column:
            d = c - m
            out = d
            for _ in range(n - 1):
                out = out * d
            return out

        return A.let(mu, lambda m: A.dot("_p", F.transform("_c", lambda c: power(c, m))))

    base = base.withColumn("_sd", F.sqrt(moment(2)))
    sd = F.greatest(F.col("_sd"), F.lit(EPS))
    k10, k25, k50, k75, k90 = (F.col(f"_{n}") for n in LEVELS)
    safe = F.greatest(k50, F.lit(EPS))
    width50, width80 = F.greatest(k75 - k25, F.lit(EPS)), F.greatest(k90 - k10, F.lit(EPS))
    peak = A.at("_c", A.argmax("_p"))

    def side(test) -> Column:
        return A.let(mu, lambda m: A.total(F.zip_with("_p", "_c", lambda p, c: F.when(test(c, m), p).otherwise(0.0))))

    x_range = F.greatest(F.array_max("_x") - F.array_min("_x"), F.lit(EPS))
    features = {
        "ecum_k10_norm_k50": k10 / safe,
        "ecum_k25_norm_k50": k25 / safe,
        "ecum_k75_norm_k50": k75 / safe,
        "ecum_k90_norm_k50": k90 / safe,
        "ecum_width_50_rel": (k75 - k25) / safe,
        "ecum_width_80_rel": (k90 - k10) / safe,
        "ecum_lower_tail_rel": (k50 - k10) / safe,
        "ecum_upper_tail_rel": (k90 - k50) / safe,
        "ecum_asymmetry_10_90": (k90 + k10 - 2 * k50) / width80,
        "ecum_asymmetry_25_75": (k75 + k25 - 2 * k50) / width50,
        "ecum_width_ratio_80_50": width80 / width50,
        "ecum_lower_upper_width_ratio": F.greatest(k50 - k25, F.lit(EPS)) / F.greatest(k75 - k50, F.lit(EPS)),
        "ecum_auc_norm": A.trapezoid("_x", "_E") / x_range,
        "ecum_increment_entropy": A.entropy("_p", F.size("_p")),
        "ecum_increment_peak_frac": F.array_max("_p"),
        "ecum_increment_gini": F.lit(1.0) - A.dot("_p", "_p"),
        "ecum_slope_max": F.array_max("_slope"),
        "ecum_slope_peak_to_mean": F.array_max("_slope") / (A.total("_slope") / F.size("_slope") + EPS),
        "ecum_slope_iqr_to_median": (A.array_percentile("_slope", 0.75) - A.array_percentile("_slope", 0.25))
        / (A.array_percentile("_slope", 0.5) + EPS),
        "srad_proxy_centroid_k_norm": mu,
        "srad_proxy_std_k_norm": F.col("_sd"),
        "srad_proxy_skewness": moment(3) / (sd * sd * sd),
        "srad_proxy_kurtosis": moment(4) / (sd * sd * sd * sd),
        "srad_proxy_peak_k_norm": peak,
        "srad_proxy_peak_to_centroid": peak / F.greatest(mu, F.lit(EPS)),
        "srad_proxy_low_side_frac": side(lambda c, m: c < m),
        "srad_proxy_high_side_frac": side(lambda c, m: c >= m),
    }
    return base.select(*rows.columns, *[c.alias(n) for n, c in features.items()])


def band_limits(
    f0: Column | None = None, speeds: tuple[float, float] | None = None,
    prior_k: Column | None = None, relative: tuple[float, float] = (0.7, 1.3),
) -> tuple[Column, Column]:
    """Wavenumber limits: a physical speed range, a range around a prior, or the intersection of both."""
    lows, highs = [], []
    if speeds is not None:
        lows.append(F.lit(2 * math.pi) * f0 / max(speeds))
        highs.append(F.lit(2 * math.pi) * f0 / min(speeds))
    if prior_k is not None:
        lows.append(prior_k * min(relative))
        highs.append(prior_k * max(relative))
    if not lows:
        raise ValueError("a band needs a speed range or a prior")
    return (F.greatest(*lows), F.least(*highs)) if len(lows) > 1 else (lows[0], highs[0])


def band_filter(rows: DataFrame, low: Column, high: Column, taper: float = 0.05) -> DataFrame:
    """Keep the power between two wavenumbers with sine tapers.

    A band that is empty or holds no power falls back to the whole curve and is flagged.
    """
    def weight(k: Column, lo: Column, hi: Column) -> Column:
        outside = (k < lo) | (k > hi)
        if taper <= 0:
            return F.when(outside, F.lit(0.0)).otherwise(F.lit(1.0))
        rise = F.sin(F.lit(math.pi / 2) * (k - lo) / F.greatest(lo * taper, F.lit(EPS)))
        fall = F.sin(F.lit(math.pi / 2) * (hi - k) / F.greatest(hi * taper, F.lit(EPS)))
        up = F.when((lo > 0) & (k < lo + lo * taper), rise).otherwise(F.lit(1.0))
        return F.when(outside, F.lit(0.0)).when(k > hi - hi * taper, F.least(up, fall)).otherwise(up)

    base = rows.withColumn("_s", F.transform("srad", lambda s: F.greatest(F.coalesce(s, F.lit(0.0)), F.lit(0.0))))
    weights = A.let(
        F.struct(low.alias("lo"), high.alias("hi")),
        lambda t: F.transform("k_cent", lambda k: weight(k, t["lo"], t["hi"])),
    )
    base = base.withColumn("_w", weights)
    base = base.withColumn(
        "_f", F.zip_with("_s", F.zip_with("_w", "_w", lambda a, b: a * b), lambda s, w: s * w)
    ).withColumn("used_fallback", A.total("_f") <= EPS)
    base = base.withColumn("srad_filtered", F.when(F.col("used_fallback"), F.col("_s")).otherwise(F.col("_f")))
    base = base.withColumn(
        "retained_energy_fraction", A.total("srad_filtered") / (A.total("_s") + EPS)
    )
    return with_ecum(base, "srad_filtered", "ecum_filtered").drop("_s", "_w", "_f")


def two_components(
    rows: DataFrame,
    *,
    smooth: int = 3,
    peak_ratio: float = 0.10,
    separation: float = 0.12,
    valley: float = 0.82,
    component: float = 0.08,
) -> DataFrame:
    """Detect two separated radial components from peaks and the valley between them.

    Peak pairs live inside one short array per row, so nothing is joined.
    """
    base = rows.withColumn("_s", A.scaled("srad", A.total("srad")))
    left = (smooth - 1) // 2 if smooth % 2 else smooth // 2
    base = base.withColumn("_ss", A.moving_mean("_s", left, (smooth - 1) // 2))
    top = F.array_max("_ss")
    ss = F.col("_ss")

    def is_peak(i: Column) -> Column:
        return (A.at(ss, i) >= A.at(ss, i - 1)) & (A.at(ss, i) > A.at(ss, i + 1))

    inner = F.filter(F.sequence(F.lit(1), F.size("_ss") - 2), is_peak)
    base = base.withColumn("_inner", inner).withColumn("_top", top)
    base = base.withColumn(
        "_loc",
        F.filter(
            F.when(F.size("_inner") > 0, F.col("_inner")).otherwise(F.array(A.argmax("_ss"))),
            lambda i: A.at(ss, i) >= F.lit(peak_ratio) * F.col("_top"),
        ),
    )

    base = base.withColumn("_cum", A.running_sum("_s"))
    total_power = F.element_at("_cum", -1)

    def finish(t: Column) -> Column:
        depth = t["floor"] / F.greatest(t["weaker"], F.lit(EPS))
        weak = t["weaker"] / F.greatest(F.col("_top"), F.lit(EPS))
        balance = F.lit(2.0) * F.least(t["low"], t["high"]) / F.greatest(t["low"] + t["high"], F.lit(EPS))
        score = weak * F.greatest(F.lit(1.0) - depth, F.lit(0.0)) * balance * t["gap"]
        return F.struct(
            score.alias("score"), (-t["a"]).alias("na"), (-t["b"]).alias("nb"), t["cut"].alias("cut"),
            t["gap"].alias("gap"), depth.alias("depth"), t["low"].alias("low"), t["high"].alias("high"),
            weak.alias("weak"), balance.alias("balance"),
        )

    def pair(a: Column, b: Column) -> Column:
        ka, kb = F.get("k_cent", a), F.get("k_cent", b)
        gap = (kb - ka) / F.greatest(F.lit(0.5) * (kb + ka), F.lit(EPS))

        def with_cut(span: Column) -> Column:
            cut = a + F.array_position(span, F.array_min(span)).cast("int") - 1
            return A.let(
                cut,
                lambda c: F.struct(
                    a.alias("a"), b.alias("b"), c.alias("cut"), gap.alias("gap"), F.get(ss, c).alias("floor"),
                    F.least(F.get(ss, a), F.get(ss, b)).alias("weaker"), F.get("_cum", c).alias("low"),
                    (total_power - F.get("_cum", c)).alias("high"),
                ),
            )

        return A.let(A.let(F.slice(ss, a + 1, b - a + 1), with_cut), finish)

    pairs = F.flatten(
        F.transform("_loc", lambda a: F.transform(F.filter("_loc", lambda b: b > a), lambda b: pair(a, b)))
    )
    base = base.withColumn("_best", F.array_max(F.filter(pairs, lambda p: p["gap"] >= separation)))
    best = F.col("_best")
    base = with_ecum(base, "_s", "_E")
    detected = (best["depth"] <= valley) & (F.least(best["low"], best["high"]) >= component)
    return base.select(
        *rows.columns,
        A.at("k_cent", A.argmax("_ss")).alias("dominant_k"),
        F.size("_loc").alias("num_candidate_peaks"),
        (A.inverse_lookup("_E", "k_cent", 0.9) - A.inverse_lookup("_E", "k_cent", 0.1)).alias("radial_width_10_90"),
        A.at("k_cent", -best["na"]).alias("low_k"),
        A.at("k_cent", -best["nb"]).alias("high_k"),
        A.at("k_cent", best["cut"]).alias("valley_k"),
        best["gap"].alias("separation_fraction"),
        best["depth"].alias("valley_ratio"),
        best["low"].alias("low_component_weight"),
        best["high"].alias("high_component_weight"),
        best["weak"].alias("weak_peak_height_ratio"),
        best["balance"].alias("component_balance"),
        F.coalesce(F.greatest(best["score"], F.lit(0.0)), F.lit(0.0)).alias("two_component_score"),
        F.coalesce(detected, F.lit(False)).alias("two_component_detected"),
    )


def band_energy(rows: DataFrame, k_hard: Column, k_soft: Column) -> DataFrame:
    """Power near two expected wavenumbers, their mixture index, and whether each has its own peak."""
    base = rows.withColumn("_s", A.scaled("srad", A.total("srad"))).withColumn("k_hard", k_hard).withColumn("k_soft", k_soft)
    gap = F.abs(F.col("k_soft") - F.col("k_hard"))
    step = A.array_percentile(A.differences("k_cent"), 0.5)
    base = base.withColumn("band_half_width", F.least(gap * 0.45, F.greatest(gap * 0.10, step * 1.5)))
    half = F.col("band_half_width")

    def energy(center: str) -> Column:
        return A.total(
            F.zip_with("_s", "k_cent", lambda s, k: F.when(F.abs(k - F.col(center)) <= half, s).otherwise(0.0))
        )

    s = F.col("_s")
    peaks = F.filter(
        F.sequence(F.lit(1), F.size("_s") - 2),
        lambda i: (A.at(s, i) >= A.at(s, i - 1))
        & (A.at(s, i) > A.at(s, i + 1))
        & (A.at(s, i) >= F.lit(0.08) * F.array_max(s)),
    )
    base = base.withColumn("_peaks", peaks)

    def near(center: str) -> Column:
        return F.filter("_peaks", lambda i: F.abs(A.at("k_cent", i) - F.col(center)) <= half)

    def best_k(center: str) -> Column:
        best = F.array_max(F.transform(near(center), lambda i: F.struct(A.at(s, i).alias("s"), (-i).alias("i"))))
        return A.at("k_cent", -best["i"])

    base = base.select("*", energy("k_hard").alias("hard_band_energy"), energy("k_soft").alias("soft_band_energy"))
    hard, soft = F.col("hard_band_energy"), F.col("soft_band_energy")
    return base.select(
        *rows.columns,
        "k_hard",
        "k_soft",
        "band_half_width",
        hard,
        soft,
        (F.lit(2.0) * F.least(hard, soft) / (hard + soft + EPS)).alias("spectral_mixture_index"),
        (F.size(near("k_hard")) > 0).alias("has_hard_radius_peak"),
        (F.size(near("k_soft")) > 0).alias("has_soft_radius_peak"),
        ((F.size(near("k_hard")) > 0) & (F.size(near("k_soft")) > 0)).alias("two_radius_detected"),
        F.size("_peaks").alias("num_radial_peaks"),
        best_k("k_hard").alias("hard_peak_k"),
        best_k("k_soft").alias("soft_peak_k"),
    )


def weighted_quantile(k: Column | str, cdf: Column | str, q: float) -> Column:
    """First wavenumber whose cumulative share reaches q, interpolated inside its step."""
    kk, f = (F.col(c) if isinstance(c, str) else c for c in (k, cdf))
    i = F.size(F.filter(f, lambda x: x < q))
    f1, f2, k1, k2 = A.at(f, i - 1), A.at(f, i), A.at(kk, i - 1), A.at(kk, i)
    inside = F.when(f2 <= f1, k2).otherwise(k1 + (F.lit(float(q)) - f1) / (f2 - f1) * (k2 - k1))
    return F.when(i >= F.size(f), F.element_at(kk, -1)).when(i == 0, A.at(kk, F.lit(0))).otherwise(inside)


def radial_features(
    rows: DataFrame,
    k: str,
    w: str,
    *,
    low_alpha: float = 0.5,
    high_alpha: float = 1.5,
    mid_iqr: float = 1.0,
    bins: int = 64,
    top_quantile: float = 0.995,
) -> DataFrame:
    """Weighted wavenumber quantiles, relative widths, band fractions and entropy of power by distinct wavenumber.

    ``k`` holds ascending distinct wavenumbers, ``w`` the power summed at each.
    """
    base = rows.withColumn("_w", A.scaled(w, A.total(w) + EPS))
    base = base.withColumn("_c", A.running_sum("_w")).withColumn("_F", A.scaled("_c", F.element_at("_c", -1)))
    names = {"k_q10": 0.10, "k_q25": 0.25, "k_q50": 0.50, "k_q75": 0.75, "k_q90": 0.90, "k_q995": top_quantile}
    base = base.select("*", *[weighted_quantile(k, "_F", q).alias(n) for n, q in names.items()])
    q10, q25, q50, q75, q90, q995 = (F.col(n) for n in names)
    base = base.withColumn("iqr_k", F.greatest(q75 - q25, F.lit(EPS)))
    iqr = F.col("iqr_k")
    safe = F.greatest(q50, F.lit(EPS))

    def part(test) -> Column:
        return A.total(F.zip_with("_w", k, lambda x, kk: F.when(test(kk), x).otherwise(0.0)))

    half = F.greatest(iqr * mid_iqr, F.lit(EPS))
    top = F.greatest(q995, q90 + 2 * iqr, q50 + 3 * iqr)
    base = base.withColumn("k_plot_hi", top)
    # One histogram slot per bin up to the top, the last bin closed, plus one overflow slot.
    slot = F.transform(
        k,
        lambda x: F.when(x > F.col("k_plot_hi"), F.lit(bins).cast("bigint")).otherwise(
            F.least(F.floor(x / F.col("k_plot_hi") * bins), F.lit(bins - 1).cast("bigint"))
        ),
    )
    base = base.withColumn("_slot", slot)
    # Slots ascend with k, so one pass closes each slot when the next begins; empty slots add no entropy.
    empty = F.array().cast("array<double>")
    start = F.struct(F.lit(-1).cast("bigint").alias("slot"), F.lit(0.0).alias("sum"), empty.alias("done"))

    def gather(acc: Column, cell: Column) -> Column:
        same = cell["_slot"] == acc["slot"]
        return F.struct(
            cell["_slot"].alias("slot"),
            F.when(same, acc["sum"] + cell["_w"]).otherwise(cell["_w"]).alias("sum"),
            F.when(same, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["sum"]))).alias("done"),
        )

    hist = F.aggregate(F.arrays_zip("_w", "_slot"), start, gather, lambda acc: F.concat(acc["done"], F.array(acc["sum"])))
    base = base.withColumn("_h", hist)
    base = base.withColumn("_h", A.scaled("_h", A.total("_h") + EPS))
    return base.select(
        *rows.columns,
        *names,
        "iqr_k",
        A.entropy("_h", F.lit(bins + 1)).alias("radial_entropy"),
        ((q75 - q25) / safe).alias("width_75_25_rel"),
        ((q90 - q50) / safe).alias("width_90_50_rel"),
        ((q90 - q10) / safe).alias("width_90_10_rel"),
        part(lambda x: x <= safe * low_alpha).alias("lowk_frac_rel"),
        part(lambda x: F.abs(x - q50) <= half).alias("midband_frac_rel"),
        part(lambda x: x >= safe * high_alpha).alias("highk_frac_rel"),
    )


def truth_quantile(rows: DataFrame, f0: Column, speed: Column) -> DataFrame:
    """Training target: the curve's value at the true centre wavenumber, and whether it exists."""
    out = rows.withColumn("k_target_rad_m", F.lit(2 * math.pi) * f0 / F.when(speed > 0, speed))
    out = out.withColumn("target_q", wavenumber_to_quantile(F.col("k_target_rad_m")))
    return out.withColumn("target_valid", F.col("target_q").isNotNull())


def corrected_speed(f0: Column, k: Column, delta: Column, gate: Column, low: float = 0.2, high: float = 20.0) -> Column:
    """Speed after a gated shift of the log wavenumber, clipped to a physical range."""
    return clip(ratio(F.lit(2 * math.pi) * f0, F.exp(F.log(k) + gate * delta)), low, high)
