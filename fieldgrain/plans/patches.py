"""Window, spectrum and feature queries on the pixels frame (window 9, stride 4)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldgrain.operators import patches as pt, spectrum as spx
from fieldgrain.operators.curves import radial_features, with_ecum
from fieldgrain.plans.catalog import query, r, rounded
from fieldgrain.plans.frames import PIXELS_SQL, pixels, samples

WINDOW, STRIDE, SIDE, BINS = 9, 4, 27, 16
PI = f"{math.pi!r}::DOUBLE"

MEMBERS_SQL = f"""{PIXELS_SQL},
  centers AS (SELECT sample_id, CAST(a * 4 + 4 AS INTEGER) AS cz, CAST(b * 4 + 4 AS INTEGER) AS cx
    FROM samples, range(4) x(a), range(4) y(b)),
  members AS (SELECT p.*, c.cz, c.cx, p.iz - c.cz AS oz, p.ix - c.cx AS ox FROM centers c JOIN pixels p
    ON p.sample_id = c.sample_id AND p.iz BETWEEN c.cz - 4 AND c.cz + 4 AND p.ix BETWEEN c.cx - 4 AND c.cx + 4)"""

PREPARED_SQL = f"""{MEMBERS_SQL},
  weighted AS (SELECT *, CASE WHEN valid AND ox * ox + oz * oz <= 16
      THEN 0.5::DOUBLE * (1 + cos({PI} * sqrt(CAST(ox * ox + oz * oz AS DOUBLE)) / 4)) ELSE 0.0::DOUBLE END AS w FROM members),
  means AS (SELECT sample_id, cz, cx, sum(w) AS weight_sum, sum(w * re) / sum(w) AS mean_re, sum(w * im) / sum(w) AS mean_im,
      avg(CASE WHEN valid THEN 1.0::DOUBLE ELSE 0 END) AS valid_fraction,
      bool_or(valid AND ox = 0 AND oz = 0) AS center_valid FROM weighted GROUP BY 1, 2, 3),
  shaped0 AS (SELECT sample_id, cz, cx, oz, ox, (re - mean_re) * w AS a, (im - mean_im) * w AS b
    FROM weighted JOIN means USING (sample_id, cz, cx)),
  norms AS (SELECT sample_id, cz, cx, sqrt(avg(a * a + b * b)) AS rms FROM shaped0 GROUP BY 1, 2, 3),
  shaped AS (SELECT sample_id, cz, cx, oz, ox, a / rms AS a, b / rms AS b FROM shaped0
    JOIN norms USING (sample_id, cz, cx) JOIN means USING (sample_id, cz, cx) WHERE center_valid)"""

# Separable discrete Fourier transform by joining pixels to a table of 27 roots of unity.
POWER_SQL = f"""{PREPARED_SQL},
  roots AS (SELECT t, cos(2 * {PI} * t / 27) AS c, sin(2 * {PI} * t / 27) AS s FROM range(27) x(t)),
  freq AS (SELECT CAST(f - 13 AS INTEGER) AS f FROM range(27) x(f)),
  px AS (SELECT f, o, c, s FROM freq, (SELECT CAST(o - 4 AS INTEGER) AS o FROM range(9) x(o)),
    roots WHERE t = ((f * o) % 27 + 27) % 27),
  half AS (SELECT sample_id, cz, cx, oz, f AS fx, sum(a * c + b * s) AS a, sum(b * c - a * s) AS b
    FROM shaped JOIN px ON px.o = ox GROUP BY 1, 2, 3, 4, 5),
  full2 AS (SELECT sample_id, cz, cx, f AS fz, fx, sum(a * c + b * s) AS a, sum(b * c - a * s) AS b
    FROM half JOIN px ON px.o = oz GROUP BY 1, 2, 3, 4, 5),
  power AS (SELECT sample_id, cz, cx, fz, fx, CASE WHEN fz = 0 AND fx = 0 THEN 0 ELSE a * a + b * b END AS p FROM full2)"""

SMOOTH_SQL = f"""{POWER_SQL},
  taps AS (SELECT CAST(o - 2 AS INTEGER) AS o, exp(-0.5::DOUBLE * (o - 2) * (o - 2)) / sum(exp(-0.5::DOUBLE * (o - 2) * (o - 2))) OVER () AS g
    FROM range(5) x(o)),
  reach AS (SELECT f, o, g, greatest(-13, least(13, f + o)) AS src FROM freq, taps),
  smz AS (SELECT sample_id, cz, cx, r.f AS fz, fx, sum(g * p) AS p FROM power JOIN reach r ON r.src = fz GROUP BY 1, 2, 3, 4, 5),
  smoothed AS (SELECT sample_id, cz, cx, fz, r.f AS fx, sum(g * p) AS p FROM smz JOIN reach r ON r.src = fx GROUP BY 1, 2, 3, 4, 5)"""


def radial_sql(source: str) -> str:
    return f"""cells AS (SELECT sample_id, cz, cx, fz, fx, p, sqrt(CAST(fz * fz + fx * fx AS DOUBLE)) AS rr FROM {source}),
  radial AS (SELECT sample_id, cz, cx, CAST(least(floor(rr / 13 * 16 + 1e-9), 15) AS INTEGER) AS bin, avg(p) AS srad
    FROM cells WHERE rr <= 13 GROUP BY 1, 2, 3, 4)"""


def _members(spark, sf_dir):
    return pt.grid_members(pixels(spark, sf_dir), samples(spark, sf_dir), WINDOW, STRIDE)


def _patches(spark, sf_dir):
    return pt.patch_arrays(_members(spark, sf_dir), ["frequency_hz"])


@query(
    "patch_centers",
    "K1 K32 P14",
    f"""WITH {MEMBERS_SQL} SELECT sample_id, cz, cx, sample_id || printf('__z%05d_x%05d', cz, cx) AS example_id FROM centers""",
)
def patch_centers(spark, sf_dir):
    return pt.grid_centers(samples(spark, sf_dir), WINDOW, STRIDE).withColumn("example_id", pt.example_id())


@query(
    "patch_layouts",
    "K32",
    f"""WITH {MEMBERS_SQL} SELECT 'center' AS layout, sample_id, 10 AS cz, 10 AS cx FROM samples
    UNION ALL SELECT 'random', sample_id, cz, cx FROM (SELECT *, row_number() OVER (PARTITION BY sample_id
      ORDER BY md5('1:' || cz || ':' || cx), cz, cx) AS rn FROM centers) WHERE rn <= 3
    UNION ALL SELECT 'manual', sample_id, 6, CAST(sample_id % 21 AS INTEGER) FROM samples
      WHERE sample_id % 21 BETWEEN 4 AND 16""",
)
def patch_layouts(spark, sf_dir):
    header = samples(spark, sf_dir)
    manual = header.select("sample_id", F.lit(6).alias("cz"), (F.col("sample_id") % 21).cast("int").alias("cx"))
    parts = [
        pt.center_layout(header, WINDOW, "center"),
        pt.center_layout(header, WINDOW, "random", stride=STRIDE, count=3, seed=1),
        pt.center_layout(header, WINDOW, "manual", manual=manual),
    ]
    names = ("center", "random", "manual")
    out = None
    for name, part in zip(names, parts):
        part = part.select(F.lit(name).alias("layout"), *pt.PATCH)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "patch_members",
    "J9 K3",
    f"""WITH {PREPARED_SQL} SELECT sample_id, cz, cx, CAST(count(*) AS BIGINT) AS pixel_count,
      CAST(count(*) FILTER (valid) AS BIGINT) AS valid_count, round(sum(w), 6) AS weight_sum FROM weighted GROUP BY 1, 2, 3""",
)
def patch_members(spark, sf_dir):
    weight = F.when(F.col("valid"), pt.hann_weight(WINDOW)).otherwise(0.0)
    return rounded(
        _members(spark, sf_dir)
        .groupBy(*pt.PATCH)
        .agg(
            F.count(F.lit(1)).alias("pixel_count"),
            F.count_if("valid").alias("valid_count"),
            F.sum(weight).alias("weight_sum"),
        )
    )


@query(
    "explicit_center_members",
    "J9 J7 K1",
    f"""WITH {MEMBERS_SQL} SELECT sample_id, 6 AS cz, 7 AS cx, CAST(count(*) AS BIGINT) AS pixel_count,
      round(sum(re), 6) AS re_sum FROM pixels WHERE iz BETWEEN 2 AND 10 AND ix BETWEEN 3 AND 11 GROUP BY 1""",
)
def explicit_center_members(spark, sf_dir):
    centers = samples(spark, sf_dir).select("sample_id", F.lit(6).alias("cz"), F.lit(7).alias("cx"))
    rows = pt.center_members(pixels(spark, sf_dir), centers, WINDOW)
    return rounded(rows.groupBy(*pt.PATCH).agg(F.count(F.lit(1)).alias("pixel_count"), F.sum("re").alias("re_sum")))


@query(
    "patch_purity",
    "G18 J9",
    f"""WITH {MEMBERS_SQL}, n AS (SELECT sample_id, cz, cx, material_id, count(*) AS n FROM members WHERE valid GROUP BY ALL)
    SELECT sample_id, cz, cx, CAST(material_id AS INTEGER) AS truth_material_id_dominant,
      round(n / CAST(t AS DOUBLE), 6) AS truth_material_purity
    FROM (SELECT *, sum(n) OVER (PARTITION BY sample_id, cz, cx) AS t,
      row_number() OVER (PARTITION BY sample_id, cz, cx ORDER BY n DESC, material_id) AS rn FROM n) WHERE rn = 1""",
)
def patch_purity(spark, sf_dir):
    return rounded(pt.patch_purity(_members(spark, sf_dir)))


@query(
    "patch_truth",
    "G19",
    f"""WITH {MEMBERS_SQL} SELECT sample_id, cz, cx, max(cs_true) FILTER (ox = 0 AND oz = 0) AS truth_cs_center_m_s,
      CAST(max(material_id) FILTER (ox = 0 AND oz = 0) AS INTEGER) AS truth_material_id_center,
      round(avg(cs_true) FILTER (valid), 6) AS truth_cs_mean_m_s, round(median(cs_true) FILTER (valid), 6) AS truth_cs_median_m_s,
      round(stddev_samp(cs_true) FILTER (valid), 6) AS truth_cs_std_m_s, min(cs_true) FILTER (valid) AS truth_cs_min_m_s,
      max(cs_true) FILTER (valid) AS truth_cs_max_m_s,
      round(avg(CASE WHEN valid THEN 1.0::DOUBLE ELSE 0 END), 6) AS truth_valid_fraction FROM members GROUP BY 1, 2, 3""",
)
def patch_truth(spark, sf_dir):
    return rounded(pt.patch_truth(_members(spark, sf_dir)))


@query(
    "patch_preprocess",
    "K2 K3",
    f"""WITH {PREPARED_SQL} SELECT sample_id, cz, cx, round(valid_fraction, 6) AS valid_fraction,
      round(weight_sum, 6) AS weight_sum, round(mean_re, 6) AS mean_re, round(mean_im, 6) AS mean_im, round(rms, 6) AS rms,
      CASE WHEN center_valid THEN 'ok' ELSE 'invalid_center' END AS reason
    FROM means JOIN norms USING (sample_id, cz, cx)""",
)
def patch_preprocess(spark, sf_dir):
    return rounded(pt.preprocess_statistics(_members(spark, sf_dir), WINDOW))


@query(
    "dft_power",
    "K4",
    f"""WITH {POWER_SQL} SELECT sample_id, cz, cx, round(sum(p) / 59049, 6) AS total_power,
      round(max(p) / sum(p), 6) AS peak_share, round(sum(p * fx * fx) / sum(p), 6) AS spread_x,
      round(sum(p * fz * fz) / sum(p), 6) AS spread_z, round(sum(p * fx * fz) / sum(p), 6) AS spread_xz
    FROM power GROUP BY 1, 2, 3""",
)
def dft_power(spark, sf_dir):
    spectra = spx.patch_spectra(_patches(spark, sf_dir), WINDOW, sigma=0.0, keep_power=True).where("valid")
    cells = spectra.select(*pt.PATCH, F.posexplode("power").alias("i", "p"))
    fx, fz = F.col("i") % SIDE - SIDE // 2, F.floor(F.col("i") / SIDE) - SIDE // 2
    p, total = F.col("p"), F.sum("p")
    return rounded(
        cells.groupBy(*pt.PATCH).agg(
            (total / 59049).alias("total_power"),
            (F.max(p) / total).alias("peak_share"),
            (F.sum(p * fx * fx) / total).alias("spread_x"),
            (F.sum(p * fz * fz) / total).alias("spread_z"),
            (F.sum(p * fx * fz) / total).alias("spread_xz"),
        )
    )


@query(
    "radial_power",
    "K7 K6 K8 N2",
    f"""WITH {SMOOTH_SQL}, {radial_sql('smoothed')}
    SELECT sample_id, cz, cx, bin, round(srad / sum(srad) OVER w, 6) AS srad_share,
      round(sum(srad) OVER (PARTITION BY sample_id, cz, cx ORDER BY bin) / sum(srad) OVER w, 6) AS ecum
    FROM radial WINDOW w AS (PARTITION BY sample_id, cz, cx)""",
)
def radial_power(spark, sf_dir):
    spectra = with_ecum(spx.patch_spectra(_patches(spark, sf_dir), WINDOW).where("valid"))
    whole = F.aggregate("srad", F.lit(0.0), lambda a, x: a + x)
    spectra = spectra.withColumn("_t", whole)
    long = spectra.select(*pt.PATCH, "_t", F.posexplode(F.arrays_zip("srad", "ecum")).alias("bin", "v"))
    return rounded(
        long.select(*pt.PATCH, "bin", (F.col("v.srad") / F.col("_t")).alias("srad_share"), F.col("v.ecum").alias("ecum"))
    )


def _shell_quantile(name: str, q: float) -> str:
    return (
        f"max(CASE WHEN cdf >= {q}::DOUBLE AND (pf IS NULL OR pf < {q}::DOUBLE) THEN CASE WHEN pf IS NULL THEN k ELSE "
        f"pk + ({q}::DOUBLE - pf) / (cdf - pf) * (k - pk) END END) AS {name}"
    )


_SHELLS = f"""{SMOOTH_SQL},
  shells AS (SELECT sample_id, cz, cx, fz * fz + fx * fx AS r2, sum(p) AS w FROM smoothed GROUP BY 1, 2, 3, 4),
  cdf AS (SELECT *, sqrt(CAST(r2 AS DOUBLE)) AS k, sum(w) OVER (PARTITION BY sample_id, cz, cx ORDER BY r2)
     / sum(w) OVER (PARTITION BY sample_id, cz, cx) AS cdf FROM shells),
  steps AS (SELECT *, lag(cdf) OVER o AS pf, lag(k) OVER o AS pk FROM cdf WINDOW o AS (PARTITION BY sample_id, cz, cx ORDER BY r2)),
  quart AS (SELECT sample_id, cz, cx, {_shell_quantile('q25', .25)}, {_shell_quantile('q50', .5)},
     {_shell_quantile('q75', .75)} FROM steps GROUP BY 1, 2, 3),
  ang AS (SELECT sample_id, cz, cx, CAST(floor(CASE WHEN atan2(fz, fx) < 0 THEN atan2(fz, fx) + 2 * {PI}
       ELSE atan2(fz, fx) END * (72 / (2 * {PI})) + 1e-9) AS INTEGER) % 72 AS angle_bin, sum(p) AS energy
     FROM smoothed JOIN quart USING (sample_id, cz, cx)
     WHERE sqrt(CAST(fz * fz + fx * fx AS DOUBLE)) BETWEEN q50 - (q75 - q25) AND q50 + (q75 - q25) GROUP BY 1, 2, 3, 4)"""


def _radial(spark, sf_dir):
    spectra = spx.patch_spectra(_patches(spark, sf_dir), WINDOW, keep_power=True).where("valid")
    return radial_features(spectra, "k_shell", "w_shell")


@query(
    "angular_energy",
    "K12",
    f"""WITH {_SHELLS} SELECT sample_id, cz, cx, angle_bin,
      round(energy / sum(energy) OVER (PARTITION BY sample_id, cz, cx), 6) AS energy_share FROM ang""",
)
def angular_energy(spark, sf_dir):
    energy = spx.angular_energy(_radial(spark, sf_dir), WINDOW)
    histogram = spx.angular_histogram(energy)
    total = F.aggregate("pang", F.lit(0.0), lambda a, x: a + x)
    long = histogram.withColumn("_t", total).select(*pt.PATCH, "_t", F.posexplode("pang").alias("angle_bin", "e"))
    return rounded(
        long.where("e > 0").select(*pt.PATCH, "angle_bin", (F.col("e") / F.col("_t")).alias("energy_share"))
    )


@query(
    "angular_features",
    "K12 W4 W6 K13",
    f"""WITH {_SHELLS},
    dense AS (SELECT sample_id, cz, cx, CAST(b AS INTEGER) AS b, coalesce(energy, 0) AS e
      FROM (SELECT DISTINCT sample_id, cz, cx FROM ang), range(72) t(b) LEFT JOIN ang USING (sample_id, cz, cx)
      WHERE false),
    keys AS (SELECT DISTINCT sample_id, cz, cx FROM ang),
    full72 AS (SELECT k.sample_id, k.cz, k.cx, CAST(t.b AS INTEGER) AS b, coalesce(energy, 0) AS e FROM keys k
      CROSS JOIN range(72) t(b) LEFT JOIN ang a ON a.sample_id = k.sample_id AND a.cz = k.cz AND a.cx = k.cx AND a.angle_bin = t.b),
    mm AS (SELECT sample_id, cz, cx, b, avg(e) OVER (PARTITION BY sample_id, cz, cx ORDER BY b ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e FROM full72),
    p AS (SELECT *, e / sum(e) OVER (PARTITION BY sample_id, cz, cx) AS p, (b + 0.5::DOUBLE) * (2 * {PI} / 72) AS t FROM mm),
    win AS (SELECT a.sample_id, a.cz, a.cx, a.b, sum(c.p) AS w FROM p a JOIN range(-1, 3) o(o) ON true
      JOIN p c ON c.sample_id = a.sample_id AND c.cz = a.cz AND c.cx = a.cx AND c.b = (a.b + o + 72) % 72 GROUP BY 1, 2, 3, 4),
    wm AS (SELECT sample_id, cz, cx, max(w) AS w FROM win GROUP BY 1, 2, 3)
    SELECT sample_id, cz, cx, round(-sum(p * ln(p + 2.220446049250313e-16::DOUBLE)) / ln(72.0::DOUBLE), 6) AS ang_entropy,
      round(1 - sqrt(pow(sum(p * cos(t)), 2) + pow(sum(p * sin(t)), 2)), 6) AS circ_var, round(max(p), 6) AS dom_dir_frac,
      round(any_value(w), 6) AS window_max_frac, round(any_value(w) * 18, 6) AS window_cf,
      round(sqrt(pow(sum(p * cos(2 * t)), 2) + pow(sum(p * sin(2 * t)), 2)), 6) AS ang_moment_2,
      round(sqrt(pow(sum(p * cos(4 * t)), 2) + pow(sum(p * sin(4 * t)), 2)), 6) AS ang_moment_4
    FROM p JOIN wm USING (sample_id, cz, cx) GROUP BY 1, 2, 3""",
)
def angular_features(spark, sf_dir):
    rows = spx.angular_features(spx.ring_histogram(_radial(spark, sf_dir), WINDOW))
    columns = [
        "ang_entropy", "circ_var", "dom_dir_frac", "window_max_frac", "window_cf", "ang_moment_2", "ang_moment_4",
    ]
    return rounded(rows.select(*pt.PATCH, *columns))


@query("angular_peaks", "W15 K13")
def angular_peaks(spark, sf_dir):
    rows = spx.angular_features(spx.ring_histogram(_radial(spark, sf_dir), WINDOW))
    return rounded(rows.select(*pt.PATCH, *[c for c in rows.columns if c.startswith(("ang_top", "ang_peak"))]))


@query("patch_features", "K4 K7 K11 K12 K13 K14 K15")
def patch_features(spark, sf_dir):
    rows = spx.patch_features(_patches(spark, sf_dir), WINDOW)
    return rounded(rows.drop("k_cent", "srad", "ecum"))


@query("global_spectrum", "K16 K8")
def global_spectrum(spark, sf_dir):
    header = samples(spark, sf_dir)
    members = pt.grid_members(pixels(spark, sf_dir), header, 21, 21)
    spectra = with_ecum(spx.patch_spectra(pt.patch_arrays(members, ["frequency_hz"]), 21).where("valid"))
    long = spectra.select("sample_id", F.posexplode(F.arrays_zip("k_cent", "ecum")).alias("bin", "v"))
    return long.select("sample_id", "bin", r("v.k_cent").alias("k"), r("v.ecum").alias("ecum"))


@query("plain_spectrum", "K31")
def plain_spectrum(spark, sf_dir):
    spectra = spx.patch_spectra(_patches(spark, sf_dir), WINDOW, method="plain").where("valid")
    rows = radial_features(spectra, "k_shell", "w_shell")
    return rounded(rows.select(*pt.PATCH, *spx.RADIAL_FEATURES))


@query("band_pass_spectrum", "K5")
def band_pass_spectrum(spark, sf_dir):
    spectra = spx.patch_spectra(_patches(spark, sf_dir), WINDOW, band_speeds=(1.0, 5.0)).where("valid")
    long = with_ecum(spectra).select(*pt.PATCH, F.posexplode("ecum").alias("bin", "ecum"))
    return rounded(long)


@query(
    "readiness",
    "G46",
    f"""WITH {PIXELS_SQL}, e AS (SELECT sample_id, sum(re * re + im * im) AS energy FROM pixels GROUP BY 1),
    s AS (SELECT samples.*, energy, CAST(ceil(2.0::DOUBLE * (3.0::DOUBLE / frequency_hz) / dx_m) + 1 AS BIGINT) AS w
      FROM samples JOIN e USING (sample_id))
    SELECT sample_id, 'finite_wavefield' AS check_name, true AS passed, 1.0::DOUBLE AS value, 1.0::DOUBLE AS expected FROM s
    UNION ALL SELECT sample_id, 'nonzero_wavefield_energy', true, round(energy, 6), 0 FROM s
    UNION ALL SELECT sample_id, 'x_window_fits', nx >= w, nx, w FROM s
    UNION ALL SELECT sample_id, 'z_window_fits', nz >= w, nz, w FROM s
    UNION ALL SELECT sample_id, 'minimum_x_placements', greatest(nx - w + 1, 0) >= 5, greatest(nx - w + 1, 0), 5 FROM s
    UNION ALL SELECT sample_id, 'minimum_z_placements', greatest(nz - w + 1, 0) >= 5, greatest(nz - w + 1, 0), 5 FROM s""",
)
def readiness(spark, sf_dir):
    return rounded(pt.readiness(pixels(spark, sf_dir), samples(spark, sf_dir), speed_guess=3.0, wavelengths=2.0))
