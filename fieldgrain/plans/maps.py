"""Map queries on the events grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgrain.operators import maps as mp, metrics as m
from fieldgrain.plans.catalog import query, r, rounded
from fieldgrain.plans.frames import MAP_SQL, PREDICTIONS_SQL, predictions, value_map
from fieldgrain.plans.sqltext import spearman_cte

M = MAP_SQL
# A confidence and a region for every cell, in both engines.
_CONF = f"""{M}, cells AS (SELECT *, ((iz * 7 + ix * 11 + map_id) % 10) / 10.0::DOUBLE AS confidence,
  CASE WHEN ix < 15 THEN 1 ELSE 2 END AS region, value * 0.9::DOUBLE + 1 AS theory FROM map)"""


def cells(spark, sf_dir):
    base = value_map(spark, sf_dir)
    return base.select(
        "*",
        (((F.col("iz") * 7 + F.col("ix") * 11 + F.col("map_id")) % 10) / 10.0).alias("confidence"),
        F.when(F.col("ix") < 15, 1).otherwise(2).alias("region"),
        (F.col("value") * 0.9 + 1).alias("theory"),
    )


_FULL = f"""{M}, box AS (SELECT map_id, min(iz) AS z0, max(iz) AS z1, min(ix) AS x0, max(ix) AS x1, median(value) AS med FROM map GROUP BY 1),
  gridc AS (SELECT map_id, z.i AS iz, x.i AS ix, med FROM box, range(0, 25) z(i), range(0, 32) x(i) WHERE z.i BETWEEN z0 AND z1 AND x.i BETWEEN x0 AND x1),
  fullg AS (SELECT g.map_id, g.iz, g.ix, coalesce(value, med) AS v, value IS NOT NULL AS present FROM gridc g LEFT JOIN map USING (map_id, iz, ix))"""
_GRAD = f"""{_FULL}, nb AS (SELECT *, lag(v) OVER rx AS l, lead(v) OVER rx AS rr, lag(v) OVER rz AS u, lead(v) OVER rz AS d FROM fullg
    WINDOW rx AS (PARTITION BY map_id, iz ORDER BY ix), rz AS (PARTITION BY map_id, ix ORDER BY iz)),
  grad AS (SELECT map_id, iz, ix, v, sqrt(pow(CASE WHEN l IS NULL THEN rr - v WHEN rr IS NULL THEN v - l ELSE (rr - l) / 2 END, 2)
    + pow(CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END, 2)) AS g FROM nb WHERE present)"""


@query("map_gradient", "W12 P32", f"WITH {_GRAD} SELECT map_id, iz, ix, round(g, 6) AS gradient FROM grad")
def map_gradient(spark, sf_dir):
    return rounded(mp.gradient(value_map(spark, sf_dir)))


@query(
    "map_local_std",
    "W13",
    f"""WITH {M} SELECT a.map_id, a.iz, a.ix, CAST(count(*) AS BIGINT) AS neighbour_count, round(stddev_pop(b.value), 6) AS local_std,
      round(max(b.value) - min(b.value), 6) AS local_range FROM map a JOIN map b ON a.map_id = b.map_id AND abs(a.iz - b.iz) <= 1
      AND abs(a.ix - b.ix) <= 1 GROUP BY 1, 2, 3""",
)
def map_local_std(spark, sf_dir):
    return rounded(mp.local_spread(value_map(spark, sf_dir)))


_BOUND = f"""{M}, bd AS (SELECT a.map_id, a.iz, a.ix, a.material_id, bool_or(b.material_id <> a.material_id) AS is_boundary FROM map a JOIN map b
  ON a.map_id = b.map_id AND abs(a.iz - b.iz) + abs(a.ix - b.ix) <= 1 GROUP BY ALL)"""


@query("map_boundary", "W16", f"WITH {_BOUND} SELECT * FROM bd")
def map_boundary(spark, sf_dir):
    return mp.boundary(value_map(spark, sf_dir))


_DIST = f"""{M}, isl AS (SELECT map_id, iz, ix, CASE WHEN (iz - 12) * (iz - 12) + (ix - 12) * (ix - 12) <= 30 THEN 2 ELSE 1 END AS mat FROM map),
  bnd AS (SELECT a.map_id, a.iz, a.ix FROM isl a JOIN isl b ON a.map_id = b.map_id AND abs(a.iz - b.iz) + abs(a.ix - b.ix) = 1 AND a.mat <> b.mat GROUP BY ALL),
  dist AS (SELECT i.map_id, i.iz, i.ix, sqrt(min((i.iz - b.iz) * (i.iz - b.iz) + (i.ix - b.ix) * (i.ix - b.ix))::DOUBLE) * 0.5::DOUBLE AS distance_mm
    FROM isl i LEFT JOIN bnd b USING (map_id) GROUP BY i.map_id, i.iz, i.ix)"""
_DIST = _DIST.replace("FROM isl i LEFT JOIN bnd b USING (map_id)", "FROM isl i LEFT JOIN bnd b ON b.map_id = i.map_id")


def _island(spark, sf_dir):
    z, x = F.col("iz") - 12, F.col("ix") - 12
    return value_map(spark, sf_dir).withColumn("material_id", F.when(z * z + x * x <= 30, 2).otherwise(1))


@query("boundary_distance", "W16 J8", f"WITH {_DIST} SELECT map_id, iz, ix, round(distance_mm, 6) AS distance_mm FROM dist")
def boundary_distance(spark, sf_dir):
    return rounded(mp.boundary_distance(_island(spark, sf_dir), spacing_mm=0.5))


@query(
    "error_gradient_rank",
    "G59",
    f"""WITH {_GRAD}, e AS (SELECT map_id, abs(v - 50) AS err, g FROM grad), {spearman_cte('sp', 'e', ['map_id'], 'g', 'err')}
    SELECT map_id, round(spearman, 6) AS spearman FROM sp""",
)
def error_gradient_rank(spark, sf_dir):
    grid = value_map(spark, sf_dir)
    rows = grid.join(mp.gradient(grid), mp.CELL).withColumn("err", F.abs(F.col("value") - 50))
    return rounded(m.spearman(rows, ["map_id"], "gradient", "err"))


@query(
    "map_fill",
    "K22 J8",
    f"""WITH {_CONF}, t AS (SELECT *, confidence >= 0.6::DOUBLE AS hi FROM cells),
    nn AS (SELECT a.map_id, a.iz, a.ix, b.value AS v, (a.iz - b.iz) * (a.iz - b.iz) + (a.ix - b.ix) * (a.ix - b.ix) AS d2,
      row_number() OVER (PARTITION BY a.map_id, a.iz, a.ix ORDER BY (a.iz - b.iz) * (a.iz - b.iz) + (a.ix - b.ix) * (a.ix - b.ix), b.iz, b.ix) AS rn
      FROM t a JOIN t b ON a.map_id = b.map_id AND a.region = b.region AND b.hi AND NOT a.hi)
    SELECT t.map_id, t.iz, t.ix, round(CASE WHEN hi THEN value ELSE v END, 6) AS filled,
      CASE WHEN hi THEN 'kept_high_conf' ELSE 'nearest_same_region_high_conf' END AS fill_source, round(sqrt(d2::DOUBLE), 6) AS fill_distance
    FROM t LEFT JOIN (SELECT * FROM nn WHERE rn = 1) n ON n.map_id = t.map_id AND n.iz = t.iz AND n.ix = t.ix""",
)
def map_fill(spark, sf_dir):
    return rounded(
        mp.fill_low_confidence(
            cells(spark, sf_dir), value="value", confidence="confidence", region="region", fallback="theory", threshold=0.6
        )
    )


@query(
    "pseudo_regions",
    "K23",
    f"""WITH {_CONF}, s AS (SELECT map_id, count(*) AS n, max(value) - min(value) AS rg, median(value) AS thr FROM cells WHERE confidence >= 0.5::DOUBLE GROUP BY 1)
    SELECT c.map_id, iz, ix, CASE WHEN n >= 20 AND rg >= 0.35::DOUBLE AND value > thr THEN 2 ELSE 1 END AS pseudo_region
    FROM cells c LEFT JOIN s USING (map_id)""",
)
def pseudo_regions(spark, sf_dir):
    rows = mp.pseudo_regions(cells(spark, sf_dir), "value", F.col("confidence") >= 0.5)
    return rows.select(*mp.CELL, "pseudo_region")


@query(
    "action_support",
    "K25",
    f"""WITH {M}, a AS (SELECT map_id, iz, ix, material_id AS act FROM map)
    SELECT a.map_id, a.iz, a.ix, CASE WHEN a.act <> 0 AND count(*) FILTER (b.act = a.act) < 8 THEN 0 ELSE a.act END AS action
    FROM a JOIN a b ON a.map_id = b.map_id AND abs(a.iz - b.iz) <= 2 AND abs(a.ix - b.ix) <= 2 GROUP BY a.map_id, a.iz, a.ix, a.act""",
)
def action_support(spark, sf_dir):
    rows = value_map(spark, sf_dir).withColumnRenamed("material_id", "act")
    return mp.supported_actions(rows, "act", radius=2, minimum=8)


def _edge_sql(radii=(1, 2, 4), minimum=3) -> str:
    parts, taken = [], "SELECT NULL::BIGINT AS map_id, NULL::BIGINT AS iz, NULL::BIGINT AS ix WHERE false"
    ctes = []
    for rad in radii:
        ctes.append(f"""f{rad} AS (SELECT a.map_id, a.iz, a.ix, b.value AS v, 1 / (sqrt(((a.iz - b.iz) * (a.iz - b.iz) + (a.ix - b.ix) * (a.ix - b.ix))::DOUBLE) + 0.5::DOUBLE) AS w
          FROM low a JOIN sure b ON a.map_id = b.map_id AND a.region = b.region AND abs(a.iz - b.iz) <= {rad} AND abs(a.ix - b.ix) <= {rad}
          WHERE (a.map_id, a.iz, a.ix) NOT IN ({taken})),
        g{rad} AS (SELECT map_id, iz, ix, v, sum(w) OVER (PARTITION BY map_id, iz, ix ORDER BY v) AS c, sum(w) OVER (PARTITION BY map_id, iz, ix) AS t,
          count(*) OVER (PARTITION BY map_id, iz, ix) AS n FROM f{rad}),
        h{rad} AS (SELECT map_id, iz, ix, min(v) AS v, {rad} AS r FROM g{rad} WHERE n >= {minimum} AND c >= t * (0.5::DOUBLE - 1e-12::DOUBLE) GROUP BY 1, 2, 3)""")
        parts.append(f"SELECT * FROM h{rad}")
        taken = " UNION ALL ".join(f"SELECT map_id, iz, ix FROM h{x}" for x in radii[: radii.index(rad) + 1])
    return f"""WITH {_CONF}, low AS (SELECT * FROM cells WHERE confidence < 0.7::DOUBLE), sure AS (SELECT * FROM cells WHERE confidence >= 0.7::DOUBLE),
      {', '.join(ctes)}, allh AS ({' UNION ALL '.join(parts)})
      SELECT c.map_id, c.iz, c.ix, round(coalesce(v, theory), 6) AS corrected, v IS NOT NULL AS used, CAST(r AS INTEGER) AS used_radius
      FROM cells c LEFT JOIN allh h ON h.map_id = c.map_id AND h.iz = c.iz AND h.ix = c.ix"""


@query("map_edge_aware", "K26 G36", _edge_sql())
def map_edge_aware(spark, sf_dir):
    return rounded(
        mp.edge_aware(
            cells(spark, sf_dir), baseline="theory", source="value", confidence="confidence", region="region", threshold=0.7
        )
    )


@query(
    "region_levels",
    "K28 G36",
    f"""WITH {_CONF}, s AS (SELECT *, greatest(confidence, 0.05::DOUBLE) AS w, value - theory AS rs FROM cells WHERE confidence >= 0.5::DOUBLE),
    a AS (SELECT map_id, region, value, sum(w) OVER (PARTITION BY map_id, region ORDER BY value) AS c, sum(w) OVER (PARTITION BY map_id, region) AS t FROM s),
    b AS (SELECT map_id, region, rs, sum(w) OVER (PARTITION BY map_id, region ORDER BY rs) AS c, sum(w) OVER (PARTITION BY map_id, region) AS t FROM s),
    la AS (SELECT map_id, region, min(value) AS lv FROM a WHERE c >= t * (0.5::DOUBLE - 1e-12::DOUBLE) GROUP BY 1, 2),
    lb AS (SELECT map_id, region, min(rs) AS sh FROM b WHERE c >= t * (0.5::DOUBLE - 1e-12::DOUBLE) GROUP BY 1, 2)
    SELECT map_id, iz, ix, region, round(lv, 6) AS region_level, round(theory + coalesce(sh, 0), 6) AS theory_calibrated
    FROM cells LEFT JOIN la USING (map_id, region) LEFT JOIN lb USING (map_id, region)""",
)
def region_levels(spark, sf_dir):
    return rounded(
        mp.region_levels(
            cells(spark, sf_dir), value="value", theory="theory", confidence="confidence", region="region", seed=F.col("confidence") >= 0.5
        )
    )


@query(
    "label_agreement",
    "K29",
    f"""WITH {_CONF}, l AS (SELECT map_id, region, 1 + material_id % 2 AS truth FROM cells)
    SELECT map_id, round(greatest(avg((region = truth)::INT), avg((3 - region = truth)::INT)), 6) AS label_agreement FROM l GROUP BY 1""",
)
def label_agreement(spark, sf_dir):
    rows = cells(spark, sf_dir).withColumn("truth", F.col("material_id") % 2 + 1)
    return rounded(mp.label_agreement(rows, "region", "truth"))


@query(
    "map_upsample",
    "K21",
    f"""WITH {M}, q AS (SELECT map_id, iz * 4 + a.i AS qz, ix * 4 + b.i AS qx, iz, ix, a.i / 4.0::DOUBLE AS wz, b.i / 4.0::DOUBLE AS wx FROM map, range(4) a(i), range(4) b(i)),
    j AS (SELECT q.*, m0.value AS a, m1.value AS b, m2.value AS c, m3.value AS d FROM q JOIN map m0 ON m0.map_id = q.map_id AND m0.iz = q.iz AND m0.ix = q.ix
      LEFT JOIN map m1 ON m1.map_id = q.map_id AND m1.iz = q.iz AND m1.ix = q.ix + 1 LEFT JOIN map m2 ON m2.map_id = q.map_id AND m2.iz = q.iz + 1 AND m2.ix = q.ix
      LEFT JOIN map m3 ON m3.map_id = q.map_id AND m3.iz = q.iz + 1 AND m3.ix = q.ix + 1)
    SELECT map_id, qz, qx, round(a * (1 - wx) * (1 - wz) + coalesce(b, 0) * wx * (1 - wz) + coalesce(c, 0) * (1 - wx) * wz + coalesce(d, 0) * wx * wz, 9) AS value
    FROM j WHERE (wx = 0 OR b IS NOT NULL) AND (wz = 0 OR c IS NOT NULL) AND (wx = 0 OR wz = 0 OR d IS NOT NULL)""",
)
def map_upsample(spark, sf_dir):
    return rounded(mp.upsample(value_map(spark, sf_dir), 4), 9)


_POINTS = f"""{M}, pts AS (SELECT map_id, 0.002::DOUBLE + ix * 0.0005::DOUBLE AS x_m, 0.004::DOUBLE + iz * 0.0005::DOUBLE AS z_m, value FROM map),
  idx AS (SELECT *, dense_rank() OVER (PARTITION BY map_id ORDER BY x_m) AS map_ix, dense_rank() OVER (PARTITION BY map_id ORDER BY z_m) AS map_iz FROM pts)"""


def _indexed(spark, sf_dir):
    pts = value_map(spark, sf_dir).select(
        "map_id", (F.lit(0.002) + F.col("ix") * F.lit(0.0005)).alias("x_m"), (F.lit(0.004) + F.col("iz") * F.lit(0.0005)).alias("z_m"), "value"
    )
    return mp.map_grid(pts, ["map_id"], "x_m", "z_m")


@query(
    "map_grid",
    "K20",
    f"WITH {_POINTS} SELECT map_id, CAST(map_iz AS INTEGER) AS map_iz, CAST(map_ix AS INTEGER) AS map_ix, round(value, 6) AS value FROM idx",
)
def map_grid(spark, sf_dir):
    return rounded(_indexed(spark, sf_dir).select("map_id", "map_iz", "map_ix", "value"))


@query(
    "map_grid_checks",
    "K20",
    f"""WITH {_POINTS} SELECT map_id, CAST(count(*) AS BIGINT) AS row_count, CAST(max(map_iz) * max(map_ix) AS BIGINT) AS grid_size,
      CAST(0 AS BIGINT) AS duplicate_cells, count(*) = max(map_iz) * max(map_ix) AS complete FROM idx GROUP BY 1""",
)
def map_grid_checks(spark, sf_dir):
    return mp.grid_checks(_indexed(spark, sf_dir), ["map_id"])


@query(
    "nearest_window_join",
    "J8",
    f"""WITH {M}, a AS (SELECT map_id, iz, ix, 1.3::DOUBLE * ix AS x, 1.3::DOUBLE * iz AS z FROM map WHERE material_id = 1),
    b AS (SELECT map_id, 1.7::DOUBLE * ix AS x, 1.7::DOUBLE * iz AS z, value FROM map WHERE material_id = 2),
    j AS (SELECT a.*, b.value AS v, sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)) AS d, row_number() OVER (PARTITION BY a.map_id, a.iz, a.ix
      ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)), b.z, b.x) AS rn FROM a JOIN b ON a.map_id = b.map_id AND abs(a.x - b.x) <= 0.9::DOUBLE AND abs(a.z - b.z) <= 0.9::DOUBLE)
    SELECT map_id, iz, ix, round(d, 6) AS distance, round(v, 6) AS near_value FROM j WHERE rn = 1""",
)
def nearest_window_join(spark, sf_dir):
    rows = value_map(spark, sf_dir)
    left = rows.where("material_id = 1").select("map_id", "iz", "ix", (F.lit(1.3) * F.col("ix")).alias("x"), (F.lit(1.3) * F.col("iz")).alias("z"))
    right = rows.where("material_id = 2").select("map_id", (F.lit(1.7) * F.col("ix")).alias("x"), (F.lit(1.7) * F.col("iz")).alias("z"), "value")
    near = mp.tolerance_join(left, right, ["map_id"], ["value"], 0.9)
    return rounded(near.select("map_id", "iz", "ix", "distance", "near_value"))


BOXES = [("left", 0.0, 8.0, 0.0, 24.0), ("middle", 6.0, 20.0, 5.0, 15.0), ("right", 22.0, 31.0, 0.0, 24.0)]


@query(
    "roi_range_join",
    "P8 G62",
    f"""WITH {M}, b(roi, x0, x1, z0, z1) AS (VALUES ('left', 0, 8, 0, 24), ('middle', 6, 20, 5, 15), ('right', 22, 31, 0, 24))
    SELECT map_id, roi, CAST(count(*) AS BIGINT) AS N, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS std_value
    FROM map JOIN b ON ix BETWEEN x0 AND x1 AND iz BETWEEN z0 AND z1 GROUP BY 1, 2""",
)
def roi_range_join(spark, sf_dir):
    points = value_map(spark, sf_dir).withColumn("x", F.col("ix").cast("double")).withColumn("z", F.col("iz").cast("double"))
    rows = mp.box_regions(points, BOXES)
    return rounded(
        rows.groupBy("map_id", "roi").agg(
            F.count(F.lit(1)).alias("N"), F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("std_value")
        )
    )


@query(
    "circle_roi",
    "P7",
    f"""WITH {M}, d AS (SELECT *, sqrt(pow(ix - 15, 2) + pow(iz - 12, 2)) AS d FROM map)
    SELECT map_id, CASE WHEN d <= 8 - 2 THEN 'inclusion_core' WHEN d >= 8 + 2 THEN 'background' ELSE 'excluded' END AS roi,
      CAST(count(*) AS BIGINT) AS N, round(avg(value), 6) AS mean_value FROM d GROUP BY 1, 2""",
)
def circle_roi(spark, sf_dir):
    label = mp.circle_roi(F.col("ix"), F.col("iz"), 15.0, 12.0, 8.0)
    return rounded(
        value_map(spark, sf_dir).groupBy("map_id", label.alias("roi")).agg(F.count(F.lit(1)).alias("N"), F.avg("value").alias("mean_value"))
    )


@query(
    "roi_class",
    "P6",
    f"""WITH {PREDICTIONS_SQL}, p AS (SELECT example_id, campaign_brand, CASE campaign_size % 3 WHEN 0 THEN 'inclusion' WHEN 1 THEN 'bilayer' ELSE 'plain' END AS g,
      campaign_direction_count AS mat, CASE WHEN truth_material_purity >= 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0.9::DOUBLE + truth_material_purity END AS pu FROM predictions)
    SELECT example_id, CASE WHEN pu < 1 - 1e-12::DOUBLE THEN 'interface_band' WHEN g = 'inclusion' AND mat = m THEN 'background_far'
      WHEN g = 'inclusion' THEN 'inclusion_core' WHEN g = 'bilayer' AND mat = m THEN 'layer_1_core' WHEN g = 'bilayer' THEN 'layer_2_core' ELSE 'homogeneous' END AS roi
    FROM p JOIN (SELECT campaign_brand, min(mat) AS m FROM p GROUP BY 1) USING (campaign_brand)""",
)
def roi_class(spark, sf_dir):
    kind = F.col("campaign_size") % 3
    rows = predictions(spark, sf_dir).select(
        "example_id", "campaign_brand", F.when(kind == 0, "inclusion").when(kind == 1, "bilayer").otherwise("plain").alias("geometry"),
        F.col("campaign_direction_count").alias("material_id"),
        F.when(F.col("truth_material_purity") >= 0.05, 1.0).otherwise(F.lit(0.9) + F.col("truth_material_purity")).alias("purity"),
    )
    return mp.roi_class(rows, ["campaign_brand"]).select("example_id", "roi")


@query(
    "ring_metrics",
    "G58",
    f"""WITH {_DIST}, c AS (SELECT m.map_id, m.value AS p, 50.0::DOUBLE AS t, CASE mat WHEN 2 THEN 'hard' ELSE 'soft' END AS side, distance_mm * 4 AS d
      FROM map m JOIN isl USING (map_id, iz, ix) JOIN dist USING (map_id, iz, ix))
    SELECT map_id, CAST(count(*) FILTER (side = 'soft' AND d <= 2) AS BIGINT) AS N_ring, round(avg(p) FILTER (side = 'soft' AND d <= 2), 6) AS mean_soft_ring,
      round(avg(p) FILTER (side = 'soft' AND d > 8), 6) AS mean_soft_far,
      round(avg(p) FILTER (side = 'soft' AND d > 8) - avg(p) FILTER (side = 'soft' AND d <= 2), 6) AS soft_ring_drop,
      round(avg(p) FILTER (side = 'hard' AND d > 4), 6) AS mean_hard_core, round(avg(100 * (p - t) / t) FILTER (side = 'hard' AND d > 4), 6) AS core_signed_error,
      round(avg(abs(100 * (p - t) / t)) FILTER (d <= 2), 6) AS edge_MAPE,
      round(avg(p) FILTER (side = 'hard' AND d > 4) - avg(p) FILTER (side = 'soft' AND d > 8), 6) AS inclusion_contrast FROM c GROUP BY 1""",
)
def ring_metrics(spark, sf_dir):
    island = _island(spark, sf_dir)
    rows = island.join(mp.boundary_distance(island, spacing_mm=2.0), mp.CELL).select(
        "map_id", F.col("value").alias("p"), F.lit(50.0).alias("t"), F.when(F.col("material_id") == 2, "hard").otherwise("soft").alias("side"), "distance_mm"
    )
    return rounded(mp.ring_metrics(rows, ["map_id"], pred="p", truth="t", side="side", distance="distance_mm"))


@query(
    "correction_acceptance",
    "G60",
    f"""WITH {_CONF} SELECT map_id, region, CAST(count(*) AS BIGINT) AS N, round(avg((confidence >= 0.7::DOUBLE)::INT), 6) AS acceptance_rate
    FROM cells GROUP BY 1, 2""",
)
def correction_acceptance(spark, sf_dir):
    return rounded(
        cells(spark, sf_dir).groupBy("map_id", "region").agg(
            F.count(F.lit(1)).alias("N"), m.share(F.col("confidence") >= 0.7).alias("acceptance_rate")
        )
    )


@query("two_centre_labels", "K27")
def two_centre_labels(spark, sf_dir):
    rows = cells(spark, sf_dir)
    return mp.profile_labels(rows, mp.two_centres(rows))


@query("graph_smoothing", "K24")
def graph_smoothing(spark, sf_dir):
    rows = cells(spark, sf_dir).withColumn("v", F.col("value") / 10.0).withColumn("s", F.col("theory") / 10.0)
    return rounded(mp.graph_smooth(rows, value="v", confidence="confidence", seed="s"), 5)
