"""Curve queries on the spectra frame."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldgrain.operators import curves as cv
from fieldgrain.plans.catalog import query, r, rounded
from fieldgrain.plans.frames import SPECTRA_SQL, spectra

S = SPECTRA_SQL
TWO_PI = f"{2 * math.pi!r}::DOUBLE"
EPS = "2.220446049250313e-16::DOUBLE"


def _curves(spark, sf_dir):
    return cv.with_ecum(spectra(spark, sf_dir))


def inverse_sql(curve: str, name: str, q: str, keys: str = "example_id") -> str:
    """Inverse lookup on long rows (key, k, e): bracket of the clamped level among distinct levels."""
    return f"""{name} AS (
      SELECT t.{keys}, t.q, CASE WHEN any_value(u.e) IS NULL THEN NULL ELSE
        coalesce(max(u.k) FILTER (u.e = t.qc),
          max(l.k) + (max(t.qc) - max(l.e)) / (min(u.e) - max(l.e)) * (min(u.k) - max(l.k))) END AS k
      FROM (SELECT a.{keys}, q, greatest(min(e), least(max(e), q)) AS qc FROM {curve} a, {q} GROUP BY a.{keys}, q) t
      JOIN (SELECT {keys}, e, min(k) AS k, lag(e) OVER (PARTITION BY {keys} ORDER BY e) AS pe FROM {curve}
            GROUP BY {keys}, e) u ON u.{keys} = t.{keys} AND u.e >= t.qc AND (u.pe IS NULL OR u.pe < t.qc)
      LEFT JOIN (SELECT {keys}, e, min(k) AS k FROM {curve} GROUP BY {keys}, e) l
        ON l.{keys} = t.{keys} AND l.e = u.pe
      GROUP BY t.{keys}, t.q)"""


@query(
    "ecum_curve",
    "W1 K8 K10",
    f"WITH {S} SELECT example_id, bin, round(k, 6) AS k, round(ecum, 6) AS ecum FROM ecum",
)
def ecum_curve(spark, sf_dir):
    rows = _curves(spark, sf_dir).select("example_id", F.posexplode(F.arrays_zip("k_cent", "ecum")).alias("bin", "p"))
    return rounded(rows.select("example_id", "bin", F.col("p.k_cent").alias("k"), F.col("p.ecum").alias("ecum")))


_QS = "(SELECT unnest([0.001, 0.1, 0.5, 0.9, 0.999]::DOUBLE[]) AS q) qs"


@query(
    "quantile_to_k",
    "A1 N5 N6",
    f"""WITH {S}, c AS (SELECT example_id, k, ecum AS e FROM ecum), {inverse_sql('c', 'inv', _QS)}
    SELECT example_id, q, round(k, 6) AS k_rad_m FROM inv""",
)
def quantile_to_k(spark, sf_dir):
    rows = _curves(spark, sf_dir).withColumn(
        "q", F.explode(F.array(*[F.lit(x) for x in (0.001, 0.1, 0.5, 0.9, 0.999)]))
    )
    return rows.select("example_id", "q", r(cv.quantile_to_wavenumber(F.col("q"))).alias("k_rad_m"))


@query(
    "k_to_quantile",
    "A2 N7 K18",
    f"""WITH {S}, t AS (SELECT DISTINCT example_id, label, x FROM spectra, (SELECT unnest([-1.0, 0.2, 3.3, 31.7, 63.4, 70.0]::DOUBLE[]) AS x)),
    b AS (SELECT t.example_id, x, greatest(0, least(62, count(*) FILTER (k < x) - 1)) AS j
      FROM t JOIN ecum e USING (example_id) GROUP BY ALL)
    SELECT b.example_id, x AS k_target, round(greatest(0, least(1,
        l.ecum + (x - l.k) / (h.k - l.k) * (h.ecum - l.ecum))), 6) AS q
    FROM b JOIN ecum l ON l.example_id = b.example_id AND l.bin = b.j
      JOIN ecum h ON h.example_id = b.example_id AND h.bin = b.j + 1""",
)
def k_to_quantile(spark, sf_dir):
    rows = _curves(spark, sf_dir).withColumn(
        "k_target", F.explode(F.array(*[F.lit(x) for x in (-1.0, 0.2, 3.3, 31.7, 63.4, 70.0)]))
    )
    return rows.select("example_id", "k_target", r(cv.wavenumber_to_quantile(F.col("k_target"))).alias("q"))


@query(
    "quantile_speed",
    "P5 A1 K19",
    f"""WITH {S}, c AS (SELECT example_id, k, ecum AS e FROM ecum),
    qp AS (SELECT DISTINCT 0.2::DOUBLE + 0.06::DOUBLE * label AS q FROM spectra),
    {inverse_sql('c', 'inv', 'qp')},
    one AS (SELECT DISTINCT example_id, label, f0, 0.2::DOUBLE + 0.06::DOUBLE * label AS q FROM spectra),
    s AS (SELECT example_id, k, {TWO_PI} * f0 / k AS p, 40.0::DOUBLE + label AS t FROM one JOIN inv USING (example_id, q))
    SELECT example_id, round(k, 6) AS k_pred_rad_m, round(p, 6) AS cs_pred_m_s, round(p - t, 6) AS cs_error_m_s,
      round(100 * (p - t) / t, 6) AS cs_error_percent, round(abs(100 * (p - t) / t), 6) AS cs_absolute_error_percent,
      true AS sws_valid FROM s""",
)
def quantile_speed(spark, sf_dir):
    label = F.col("label")
    q = cv.quantile_mode("provided", local=F.lit(None), provided=F.lit(0.2) + F.lit(0.06) * label)
    rows = cv.with_speed(_curves(spark, sf_dir), q, F.lit(40.0) + label)
    columns = ["k_pred_rad_m", "cs_pred_m_s", "cs_error_m_s", "cs_error_percent", "cs_absolute_error_percent", "sws_valid"]
    return rounded(rows.select("example_id", *columns))


@query(
    "mapping_struct",
    "K10",
    f"""WITH {S} SELECT example_id, any_value(f0) AS f0, CAST(count(*) AS INTEGER) AS nbins,
      round(sum(CAST(CAST(k AS FLOAT) AS DOUBLE)), 4) AS k_sum, round(sum(ecum), 4) AS e_sum
    FROM ecum GROUP BY example_id""",
)
def mapping_struct(spark, sf_dir):
    rows = cv.with_mapping(_curves(spark, sf_dir), "double")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "example_id",
        F.col("mapping.f0").alias("f0"),
        F.col("mapping.nbins").alias("nbins"),
        r(add(F.col("mapping.k_cent")), 4).alias("k_sum"),
        r(add(F.col("mapping.ecum")), 4).alias("e_sum"),
    )


_LEVELS_SQL = "(SELECT unnest([0.10, 0.25, 0.50, 0.75, 0.90]::DOUBLE[]) AS q) lv"

SHAPE_SQL = f"""WITH {S},
  m AS (SELECT example_id, bin, k, max(ecum) OVER (PARTITION BY example_id ORDER BY bin) AS m FROM ecum),
  c AS (SELECT example_id, bin, k, (m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w) AS e,
        k / max(k) OVER w AS x FROM m WINDOW w AS (PARTITION BY example_id)),
  {inverse_sql('c', 'inv', _LEVELS_SQL)},
  lv AS (SELECT example_id, max(k) FILTER (q = 0.10::DOUBLE) AS k10, max(k) FILTER (q = 0.25::DOUBLE) AS k25,
         max(k) FILTER (q = 0.50::DOUBLE) AS k50, max(k) FILTER (q = 0.75::DOUBLE) AS k75,
         max(k) FILTER (q = 0.90::DOUBLE) AS k90 FROM inv GROUP BY example_id),
  d0 AS (SELECT example_id, bin, greatest(e - lag(e) OVER w, 0) AS de, x - lag(x) OVER w AS dx,
         (e + lag(e) OVER w) / 2 AS me, (x + lag(x) OVER w) / 2 AS xc FROM c WINDOW w AS (PARTITION BY example_id ORDER BY bin)),
  d AS (SELECT *, de / sum(de) OVER (PARTITION BY example_id) AS p, de / dx AS sl,
         row_number() OVER (PARTITION BY example_id ORDER BY de DESC, bin) AS pk,
         row_number() OVER (PARTITION BY example_id ORDER BY de / dx) AS rn, count(*) OVER (PARTITION BY example_id) AS n
       FROM d0 WHERE dx IS NOT NULL),
  mu AS (SELECT example_id, sum(p * xc) AS mu FROM d GROUP BY 1),
  sd AS (SELECT example_id, any_value(mu) AS mu, sqrt(sum(p * (xc - mu) * (xc - mu))) AS sd FROM d JOIN mu USING (example_id) GROUP BY 1),
  ag AS (SELECT example_id, sum(me * dx) AS auc, -sum(p * ln(p + {EPS})) / ln(count(*)) AS ent, max(p) AS pmax,
         1 - sum(p * p) AS gini, max(sl) AS smax, avg(sl) AS smean,
         max(xc) FILTER (pk = 1) AS peak, any_value(mu) AS mu, any_value(sd) AS sd,
         sum(p * (xc - mu) ** 3) AS m3, sum(p * (xc - mu) ** 4) AS m4,
         coalesce(sum(p) FILTER (xc < mu), 0) AS lowside, coalesce(sum(p) FILTER (xc >= mu), 0) AS highside,
         max(sl) FILTER (rn = floor(n * 0.25::DOUBLE + 0.5)) AS s25a, max(sl) FILTER (rn = ceil(n * 0.25::DOUBLE + 0.5)) AS s25b,
         any_value(n * 0.25::DOUBLE + 0.5 - floor(n * 0.25::DOUBLE + 0.5)) AS w25,
         max(sl) FILTER (rn = floor(n * 0.75::DOUBLE + 0.5)) AS s75a, max(sl) FILTER (rn = ceil(n * 0.75::DOUBLE + 0.5)) AS s75b,
         any_value(n * 0.75::DOUBLE + 0.5 - floor(n * 0.75::DOUBLE + 0.5)) AS w75, median(sl) AS s50
       FROM d JOIN sd USING (example_id) GROUP BY example_id)
SELECT example_id, {', '.join(f'round({e}, 6) AS {n}' for n, e in {
    'ecum_k10_norm_k50': 'k10 / k50', 'ecum_k25_norm_k50': 'k25 / k50', 'ecum_k75_norm_k50': 'k75 / k50',
    'ecum_k90_norm_k50': 'k90 / k50', 'ecum_width_50_rel': '(k75 - k25) / k50', 'ecum_width_80_rel': '(k90 - k10) / k50',
    'ecum_lower_tail_rel': '(k50 - k10) / k50', 'ecum_upper_tail_rel': '(k90 - k50) / k50',
    'ecum_asymmetry_10_90': '(k90 + k10 - 2 * k50) / (k90 - k10)',
    'ecum_asymmetry_25_75': '(k75 + k25 - 2 * k50) / (k75 - k25)',
    'ecum_width_ratio_80_50': '(k90 - k10) / (k75 - k25)', 'ecum_lower_upper_width_ratio': '(k50 - k25) / (k75 - k50)',
    'ecum_auc_norm': 'auc / (1 - 0.5::DOUBLE / 63.5)', 'ecum_increment_entropy': 'ent', 'ecum_increment_peak_frac': 'pmax',
    'ecum_increment_gini': 'gini', 'ecum_slope_max': 'smax', 'ecum_slope_peak_to_mean': f'smax / (smean + {EPS})',
    'ecum_slope_iqr_to_median': f'((s75a + w75 * (s75b - s75a)) - (s25a + w25 * (s25b - s25a))) / (s50 + {EPS})',
    'srad_proxy_centroid_k_norm': 'mu', 'srad_proxy_std_k_norm': 'sd', 'srad_proxy_skewness': 'm3 / (sd * sd * sd)',
    'srad_proxy_kurtosis': 'm4 / (sd * sd * sd * sd)', 'srad_proxy_peak_k_norm': 'peak',
    'srad_proxy_peak_to_centroid': 'peak / mu', 'srad_proxy_low_side_frac': 'lowside',
    'srad_proxy_high_side_frac': 'highside'}.items())}
FROM lv JOIN ag USING (example_id)"""


@query("ecum_shape", "K14 W2 W3 A5 N10 N12", SHAPE_SQL)
def ecum_shape(spark, sf_dir):
    rows = cv.shape_features(_curves(spark, sf_dir))
    return rounded(rows.select("example_id", *[c for c in rows.columns if c.startswith(("ecum_", "srad_proxy"))]))


@query(
    "spectrum_band_filter",
    "K17 K5",
    f"""WITH {S}, b AS (SELECT *, greatest({TWO_PI} * f0 / 60.0::DOUBLE, 0.5::DOUBLE * (20 + label)) AS lo,
        least({TWO_PI} * f0 / 20.0::DOUBLE, 1.5::DOUBLE * (20 + label)) AS hi FROM spectra),
    w AS (SELECT *, least(CASE WHEN k < lo OR k > hi THEN 0.0::DOUBLE
          WHEN k < lo * 1.05::DOUBLE THEN sin({math.pi / 2!r}::DOUBLE * (k - lo) / (lo * 0.05::DOUBLE)) ELSE 1 END,
        CASE WHEN k <= hi AND k > hi * 0.95::DOUBLE THEN sin({math.pi / 2!r}::DOUBLE * (hi - k) / (hi * 0.05::DOUBLE))
          ELSE 1 END) AS wt FROM b),
    f AS (SELECT *, srad * wt * wt AS sf, sum(srad * wt * wt) OVER (PARTITION BY example_id) <= {EPS} AS fb FROM w),
    g AS (SELECT *, CASE WHEN fb THEN srad ELSE sf END AS s2 FROM f)
    SELECT example_id, bin, fb AS used_fallback, round(sum(s2) OVER (PARTITION BY example_id)
        / (sum(srad) OVER (PARTITION BY example_id) + {EPS}), 6) AS retained_energy_fraction,
      round(sum(s2) OVER (PARTITION BY example_id ORDER BY bin) / sum(s2) OVER (PARTITION BY example_id), 6) AS ecum
    FROM g""",
)
def spectrum_band_filter(spark, sf_dir):
    low, high = cv.band_limits(F.col("f0"), (20.0, 60.0), F.col("label") + F.lit(20.0), (0.5, 1.5))
    rows = cv.band_filter(spectra(spark, sf_dir), low, high)
    long = rows.select(
        "example_id", "used_fallback", "retained_energy_fraction", F.posexplode("ecum_filtered").alias("bin", "ecum")
    )
    return rounded(long)


PEAKS_SQL = f"""WITH {S}, n AS (SELECT example_id, bin, k, srad / sum(srad) OVER (PARTITION BY example_id) AS s FROM spectra),
  ss AS (SELECT *, avg(s) OVER (PARTITION BY example_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ss FROM n),
  nb AS (SELECT *, lag(ss) OVER w AS pv, lead(ss) OVER w AS nx, max(ss) OVER (PARTITION BY example_id) AS top
         FROM ss WINDOW w AS (PARTITION BY example_id ORDER BY bin)),
  loc AS (SELECT * FROM nb WHERE ss >= pv AND ss > nx AND ss >= 0.10::DOUBLE * top),
  pr AS (SELECT a.example_id, a.bin AS a, b.bin AS b, a.k AS ka, b.k AS kb, least(a.ss, b.ss) AS wk, a.top,
         (b.k - a.k) / (0.5::DOUBLE * (b.k + a.k)) AS gap FROM loc a JOIN loc b ON a.example_id = b.example_id AND a.bin < b.bin
         WHERE (b.k - a.k) / (0.5::DOUBLE * (b.k + a.k)) >= 0.12::DOUBLE),
  va AS (SELECT pr.example_id, pr.a, pr.b, arg_min(s.bin, s.ss) AS cut0, min(s.ss) AS v FROM pr JOIN ss s
         ON s.example_id = pr.example_id AND s.bin BETWEEN pr.a AND pr.b GROUP BY 1, 2, 3),
  vb AS (SELECT va.example_id, va.a, va.b, va.v, min(s.bin) AS cut FROM va JOIN ss s ON s.example_id = va.example_id
         AND s.bin BETWEEN va.a AND va.b AND s.ss = va.v GROUP BY ALL),
  cs AS (SELECT example_id, bin, sum(s) OVER (PARTITION BY example_id ORDER BY bin) AS cum FROM n),
  sc AS (SELECT pr.*, vb.cut, vb.v / wk AS depth, wk / top AS weak, cum AS low, 1 - cum AS high,
         2 * least(cum, 1 - cum) AS bal FROM pr JOIN vb USING (example_id, a, b)
         JOIN cs ON cs.example_id = pr.example_id AND cs.bin = vb.cut),
  rk AS (SELECT *, weak * greatest(1 - depth, 0) * bal * gap AS score, row_number() OVER (PARTITION BY example_id
         ORDER BY weak * greatest(1 - depth, 0) * bal * gap DESC, a, b) AS rn FROM sc)
SELECT e.example_id, e.dominant_k, CAST(coalesce(c.cnt, 1) AS INTEGER) AS num_candidate_peaks, ka AS low_k, kb AS high_k,
  cut + 0.5::DOUBLE AS valley_k, round(gap, 6) AS separation_fraction, round(depth, 6) AS valley_ratio,
  round(low, 6) AS low_component_weight, round(high, 6) AS high_component_weight,
  round(weak, 6) AS weak_peak_height_ratio, round(bal, 6) AS component_balance,
  round(coalesce(score, 0), 6) AS two_component_score,
  coalesce(depth <= 0.82::DOUBLE AND least(low, high) >= 0.08::DOUBLE, false) AS two_component_detected
FROM (SELECT example_id, min(k) FILTER (ss = top) AS dominant_k FROM nb GROUP BY 1) e
LEFT JOIN (SELECT example_id, count(*) AS cnt FROM loc GROUP BY 1) c USING (example_id)
LEFT JOIN rk ON rk.example_id = e.example_id AND rn = 1"""


@query("peaks_two_component", "W14 W6", PEAKS_SQL)
def peaks_two_component(spark, sf_dir):
    rows = cv.two_components(spectra(spark, sf_dir))
    return rounded(rows.drop("label", "f0", "k_cent", "srad", "radial_width_10_90"))


@query(
    "band_energy",
    "K30",
    f"""WITH {S}, n AS (SELECT example_id, bin, k, srad / sum(srad) OVER (PARTITION BY example_id) AS s,
        12.0::DOUBLE + label AS kh, 30.0::DOUBLE + label AS ks FROM spectra),
    p AS (SELECT *, lag(s) OVER w AS pv, lead(s) OVER w AS nx, max(s) OVER (PARTITION BY example_id) AS top
      FROM n WINDOW w AS (PARTITION BY example_id ORDER BY bin)),
    f AS (SELECT *, s >= pv AND s > nx AND s >= 0.08::DOUBLE * top AS pk, least(18 * 0.45::DOUBLE, greatest(1.8::DOUBLE, 1.5::DOUBLE)) AS h FROM p),
    g AS (SELECT example_id, any_value(kh) AS k_hard, any_value(ks) AS k_soft, any_value(h) AS band_half_width,
      coalesce(sum(s) FILTER (abs(k - kh) <= h), 0) AS eh, coalesce(sum(s) FILTER (abs(k - ks) <= h), 0) AS es,
      count(*) FILTER (pk) AS np, count(*) FILTER (pk AND abs(k - kh) <= h) AS nh, count(*) FILTER (pk AND abs(k - ks) <= h) AS ns,
      arg_max(k, s) FILTER (pk AND abs(k - kh) <= h) AS hk, arg_max(k, s) FILTER (pk AND abs(k - ks) <= h) AS sk
      FROM f GROUP BY example_id)
    SELECT example_id, k_hard, k_soft, round(band_half_width, 6) AS band_half_width, round(eh, 6) AS hard_band_energy,
      round(es, 6) AS soft_band_energy, round(2 * least(eh, es) / (eh + es + {EPS}), 6) AS spectral_mixture_index,
      nh > 0 AS has_hard_radius_peak, ns > 0 AS has_soft_radius_peak, nh > 0 AND ns > 0 AS two_radius_detected,
      CAST(np AS INTEGER) AS num_radial_peaks, hk AS hard_peak_k, sk AS soft_peak_k FROM g""",
)
def band_energy(spark, sf_dir):
    label = F.col("label")
    rows = cv.band_energy(spectra(spark, sf_dir), F.lit(12.0) + label, F.lit(30.0) + label)
    return rounded(rows.drop("label", "f0", "k_cent", "srad"))


_W = "sum(srad) OVER (PARTITION BY example_id)"


def _wq(name: str, q: float) -> str:
    return (
        f"max(CASE WHEN F >= {q}::DOUBLE AND (pf IS NULL OR pf < {q}::DOUBLE) THEN CASE WHEN pf IS NULL THEN k "
        f"ELSE pk + ({q}::DOUBLE - pf) / (F - pf) * (k - pk) END END) AS {name}"
    )


@query(
    "radial_features",
    "K11",
    f"""WITH {S}, c AS (SELECT example_id, bin, k, srad / {_W} AS w, ecum AS F, lag(ecum) OVER o AS pf, lag(k) OVER o AS pk
      FROM ecum WINDOW o AS (PARTITION BY example_id ORDER BY bin)),
    q AS (SELECT example_id, {', '.join(_wq(n, v) for n, v in
        {'q10': .1, 'q25': .25, 'q50': .5, 'q75': .75, 'q90': .9, 'q995': .995}.items())} FROM c GROUP BY 1),
    h AS (SELECT *, greatest(q995, q90 + 2 * (q75 - q25), q50 + 3 * (q75 - q25)) AS hi FROM q),
    s AS (SELECT example_id, CASE WHEN k > hi THEN 64 ELSE least(floor(k / hi * 64), 63) END AS slot, sum(w) AS p
      FROM c JOIN h USING (example_id) GROUP BY 1, 2),
    e AS (SELECT example_id, -sum(p * ln(p + {EPS})) / ln(65.0::DOUBLE) AS ent FROM s GROUP BY 1)
    SELECT example_id, round(q10, 6) AS k_q10, round(q25, 6) AS k_q25, round(q50, 6) AS k_q50, round(q75, 6) AS k_q75,
      round(q90, 6) AS k_q90, round(any_value(ent), 6) AS radial_entropy, round((q75 - q25) / q50, 6) AS width_75_25_rel,
      round((q90 - q50) / q50, 6) AS width_90_50_rel, round((q90 - q10) / q50, 6) AS width_90_10_rel,
      round(coalesce(sum(w) FILTER (k <= 0.5::DOUBLE * q50), 0), 6) AS lowk_frac_rel,
      round(coalesce(sum(w) FILTER (abs(k - q50) <= q75 - q25), 0), 6) AS midband_frac_rel,
      round(coalesce(sum(w) FILTER (k >= 1.5::DOUBLE * q50), 0), 6) AS highk_frac_rel
    FROM c JOIN h USING (example_id) JOIN e USING (example_id) GROUP BY example_id, q10, q25, q50, q75, q90""",
)
def radial_features(spark, sf_dir):
    rows = cv.radial_features(spectra(spark, sf_dir), "k_cent", "srad")
    return rounded(rows.drop("label", "f0", "k_cent", "srad", "k_q995", "iqr_k"))


@query(
    "truth_quantile",
    "K18 K8",
    f"""WITH {S}, t AS (SELECT DISTINCT example_id, {TWO_PI} * f0 / (50.0::DOUBLE + label) AS x FROM spectra),
    b AS (SELECT t.example_id, x, greatest(0, least(62, count(*) FILTER (k < x) - 1)) AS j
      FROM t JOIN ecum e USING (example_id) GROUP BY ALL)
    SELECT b.example_id, round(x, 6) AS k_target_rad_m, round(greatest(0, least(1,
        l.ecum + (x - l.k) / (h.k - l.k) * (h.ecum - l.ecum))), 6) AS target_q, true AS target_valid
    FROM b JOIN ecum l ON l.example_id = b.example_id AND l.bin = b.j
      JOIN ecum h ON h.example_id = b.example_id AND h.bin = b.j + 1""",
)
def truth_quantile(spark, sf_dir):
    rows = cv.truth_quantile(_curves(spark, sf_dir), F.col("f0"), F.lit(50.0) + F.col("label"))
    return rounded(rows.select("example_id", "k_target_rad_m", "target_q", "target_valid"))


@query(
    "logk_correction",
    "P21 A3",
    f"""WITH {S} SELECT example_id, round(greatest(0.2::DOUBLE, least(20.0::DOUBLE, {TWO_PI} * f0
        / exp(ln(k) + 0.5::DOUBLE * (ecum - 0.5::DOUBLE)))), 6) AS cs_corrected_m_s, bin FROM ecum""",
)
def logk_correction(spark, sf_dir):
    long = _curves(spark, sf_dir).select(
        "example_id", "f0", F.posexplode(F.arrays_zip("k_cent", "ecum")).alias("bin", "p")
    )
    speed = cv.corrected_speed(F.col("f0"), F.col("p.k_cent"), F.col("p.ecum") - 0.5, F.lit(0.5))
    return rounded(long.select("example_id", "bin", speed.alias("cs_corrected_m_s")))
