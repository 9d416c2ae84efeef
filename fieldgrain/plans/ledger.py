"""Ledger, registry, union and dataset-summary queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldgrain.operators import planning as pl, registry as rg
from fieldgrain.plans.catalog import query, r, rounded
from fieldgrain.plans.frames import EXAMPLES_SQL, PIXELS_SQL, PREDICTIONS_SQL, RUNS_SQL, examples, pixels, predictions, runs, samples, table
from fieldgrain.sources import datasets as ds, ledger as lg, wavefields as wf

R, E = RUNS_SQL, EXAMPLES_SQL
_OK = "status IN ('completed', 'skipped_completed') AND outcome_status = 'completed_valid' AND valid = 1 AND backend = '1-URGENT'"


@query(
    "run_inventory",
    "IO1",
    f"WITH {R} SELECT run_id, ordinal, backend, {_OK} AS usable FROM runs",
)
def run_inventory(spark, sf_dir):
    kept, rejected = lg.inventory(runs(spark, sf_dir), backend="1-URGENT")
    columns = ["run_id", "ordinal", "backend"]
    return kept.select(*columns, F.lit(True).alias("usable")).unionByName(rejected.select(*columns, F.lit(False).alias("usable")))


@query("first_usable_runs", "IO1", f"WITH {R} SELECT run_id, ordinal FROM runs WHERE {_OK} ORDER BY ordinal LIMIT 100")
def first_usable_runs(spark, sf_dir):
    return lg.inventory(runs(spark, sf_dir), backend="1-URGENT", limit=100)[0].select("run_id", "ordinal")


@query(
    "ledger_uniqueness",
    "IO2",
    f"""WITH {R}, d AS (SELECT * FROM runs UNION ALL SELECT * FROM runs WHERE iteration_index = 2)
    SELECT c AS column_name, v AS value, CAST(count(*) AS BIGINT) AS row_count FROM (SELECT 'run_id' AS c, run_id AS v FROM d
      UNION ALL SELECT 'hash_sha256', hash_sha256 FROM d UNION ALL SELECT 'wavefield_sample_path', wavefield_sample_path FROM d) GROUP BY 1, 2 HAVING count(*) > 1""",
)
def ledger_uniqueness(spark, sf_dir):
    base = runs(spark, sf_dir)
    return lg.duplicates(base.unionByName(base.where("iteration_index = 2")))


_TWO = f"""{R}, a AS (SELECT run_id, condition_id, frequency_hz FROM runs WHERE iteration_index <= 4),
  b AS (SELECT run_id, condition_id, CASE WHEN ordinal % 50 = 0 THEN frequency_hz + 1 ELSE frequency_hz END AS frequency_hz FROM runs WHERE iteration_index >= 3),
  s AS (SELECT * FROM a UNION ALL SELECT * FROM b), u AS (SELECT DISTINCT * FROM s)"""


def _merged(spark, sf_dir):
    base = runs(spark, sf_dir)
    columns = ["run_id", "condition_id", "frequency_hz"]
    a = base.where("iteration_index <= 4").select(*columns)
    changed = F.when(F.col("ordinal") % 50 == 0, F.col("frequency_hz") + 1).otherwise(F.col("frequency_hz"))
    b = base.where("iteration_index >= 3").select("run_id", "condition_id", changed.alias("frequency_hz"))
    return lg.merge([a, b])


@query(
    "ledger_merge",
    "IO3",
    f"""WITH {_TWO} SELECT CAST((SELECT count(*) FROM s) AS BIGINT) AS input_row_count, CAST(count(*) AS BIGINT) AS output_row_count,
      CAST(count(DISTINCT run_id) AS BIGINT) AS run_count, CAST(count(DISTINCT condition_id) AS BIGINT) AS condition_count,
      CAST((SELECT count(*) FROM s) - count(*) AS BIGINT) AS duplicate_row_count FROM u""",
)
def ledger_merge(spark, sf_dir):
    return _merged(spark, sf_dir)[2]


@query(
    "ledger_conflicts",
    "IO3",
    f"WITH {_TWO} SELECT run_id, CAST(count(*) AS BIGINT) AS version_count FROM u GROUP BY 1 HAVING count(*) > 1",
)
def ledger_conflicts(spark, sf_dir):
    return _merged(spark, sf_dir)[1]


@query(
    "incremental_new_runs",
    "J6 D16",
    f"WITH {R}, {E} SELECT run_id, condition_id FROM runs WHERE run_id NOT IN (SELECT campaign_run_id FROM examples)",
)
def incremental_new_runs(spark, sf_dir):
    processed = examples(spark, sf_dir).select(F.col("campaign_run_id").alias("run_id"))
    return lg.new_runs(runs(spark, sf_dir), processed).select("run_id", "condition_id")


@query(
    "metadata_attach",
    "P15 J4 J7",
    f"""WITH {R}, {E} SELECT example_id, e.campaign_run_id, r.backend AS campaign_backend, r.hash_sha256 AS campaign_hash_sha256,
      r.wavefield_sample_path AS campaign_sample_file, r.ordinal AS campaign_ordinal FROM examples e LEFT JOIN runs r ON r.run_id = e.campaign_run_id""",
)
def metadata_attach(spark, sf_dir):
    patches = examples(spark, sf_dir).select("example_id", "campaign_run_id", "campaign_frequency_hz")
    out = lg.attach_metadata(patches, runs(spark, sf_dir))
    return out.select("example_id", "campaign_run_id", "campaign_backend", "campaign_hash_sha256", "campaign_sample_file", "campaign_ordinal")


@query(
    "campaign_manifest",
    "IO10",
    f"""WITH {R}, x AS (SELECT condition_id AS campaign_name, CAST(count(*) FILTER (status <> 'failed' AND valid = 1) + CASE WHEN condition_id LIKE '%F%' THEN 0 ELSE 1 END AS BIGINT) AS expected_runs FROM runs GROUP BY 1
      UNION ALL SELECT 'never_started', 10),
    l AS (SELECT condition_id AS campaign_name, count(*) FILTER (status <> 'failed') AS c, count(*) FILTER (status <> 'failed' AND valid = 1) AS i FROM runs GROUP BY 1)
    SELECT campaign_name, expected_runs, CASE WHEN c IS NULL THEN 'missing_ledger' WHEN i = 0 THEN 'no_valid_completed_runs' WHEN i = expected_runs THEN 'complete' ELSE 'partial' END AS state,
      coalesce(c, 0) AS completed_runs, coalesce(i, 0) AS included_runs FROM x LEFT JOIN l USING (campaign_name)""",
)
def campaign_manifest(spark, sf_dir):
    ledger = runs(spark, sf_dir).withColumnRenamed("condition_id", "campaign_name")
    good = F.count_if((F.col("status") != "failed") & (F.col("valid") == 1))
    expected = ledger.groupBy("campaign_name").agg(good.alias("_g")).select(
        "campaign_name", (F.col("_g") + F.when(F.col("campaign_name").contains("F"), 0).otherwise(1)).alias("expected_runs")
    )
    extra = spark.range(1).select(F.lit("never_started").alias("campaign_name"), F.lit(10).cast("long").alias("expected_runs"))
    return lg.campaign_manifest(expected.unionByName(extra), ledger)


@query(
    "field_regime",
    "IO10 A4",
    f"""WITH {R} SELECT CASE WHEN condition_id LIKE '%\\_1996' ESCAPE '\\' THEN '1996' WHEN condition_id LIKE '%\\_1997' ESCAPE '\\' THEN '1997' END AS field_regime,
      CAST(count(*) AS BIGINT) AS run_count FROM runs GROUP BY 1""",
)
def field_regime(spark, sf_dir):
    regime = lg.field_regime(F.col("condition_id"), ["1996", "1997"])
    return runs(spark, sf_dir).groupBy(regime.alias("field_regime")).agg(F.count(F.lit(1)).alias("run_count"))


@query(
    "theory_class",
    "P17",
    f"""WITH {E} SELECT CASE campaign_direction_count WHEN 1 THEN 'SingleWave' WHEN 4 THEN 'PartialDiffuse3D' WHEN 9 THEN 'PartialDiffuse3D' WHEN 16 THEN 'Diffuse3D' END AS theory_field_class,
      CAST(count(*) AS BIGINT) AS example_count FROM examples GROUP BY 1""",
)
def theory_class(spark, sf_dir):
    mapping = {1: "SingleWave", 4: "PartialDiffuse3D", 9: "PartialDiffuse3D", 16: "Diffuse3D"}
    labelled, _ = lg.theory_class(examples(spark, sf_dir), mapping)
    return labelled.groupBy("theory_field_class").agg(F.count(F.lit(1)).alias("example_count"))


@query(
    "wavefield_checks",
    "IO4",
    f"""WITH {PIXELS_SQL}, k AS (SELECT p.*, kt * (1 + CASE WHEN sample_id % 10 = 3 THEN 1e-3::DOUBLE ELSE 0 END) AS k_true,
        CASE WHEN sample_id % 10 = 5 AND ix = 4 THEN NULL ELSE re END AS re2 FROM pixels p)
    SELECT sample_id, CAST(count(*) AS BIGINT) AS pixel_count, CAST(441 AS BIGINT) AS expected_pixel_count,
      CAST(count(*) FILTER (re2 IS NULL) AS BIGINT) AS nonfinite_count, round(max(abs(k_true - kt) / kt), 9) AS wavenumber_error,
      count(*) FILTER (re2 IS NULL) = 0 AND max(abs(k_true - kt) / kt) <= 1e-5::DOUBLE AS passed FROM k GROUP BY 1""",
)
def wavefield_checks(spark, sf_dir):
    bad_k = F.when(F.col("sample_id") % 10 == 3, 1e-3).otherwise(0.0)
    rows = pixels(spark, sf_dir).withColumn("k_true", F.col("kt") * (1 + bad_k))
    rows = rows.withColumn("re", F.when(~((F.col("sample_id") % 10 == 5) & (F.col("ix") == 4)), F.col("re")))
    out = wf.sample_checks(rows.drop("frequency_hz"), samples(spark, sf_dir))
    return rounded(out.drop("axis_error_x", "axis_error_z"), 9)


# --- registry and summaries -----------------------------------------------------------------------------

_NUMERIC = ["truth_cs_center_m_s", "campaign_frequency_hz", "truth_material_purity", "campaign_direction_count", "GRID_dx_m"]


@query(
    "dataset_summary",
    "G17",
    f"""WITH {E}, u AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _NUMERIC)} FROM examples) ON {', '.join(_NUMERIC)} INTO NAME variable_name VALUE v)
    SELECT variable_name, CAST(count(v) AS BIGINT) AS finite_count, 1.0::DOUBLE AS finite_fraction, CAST(count(DISTINCT v) AS BIGINT) AS unique_finite_count,
      min(v) AS minimum, max(v) AS maximum, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS standard_deviation, max(v) - min(v) <= 1e-12::DOUBLE AS is_constant FROM u GROUP BY 1""",
)
def dataset_summary(spark, sf_dir):
    out = rg.variable_summary(examples(spark, sf_dir), _NUMERIC)
    return rounded(out, 5, minimum=12, maximum=12)


@query(
    "dataset_level_counts",
    "G17",
    f"""WITH {E} SELECT 'campaign_frequency_hz' AS column_name, printf('%.1f', campaign_frequency_hz) AS level, CAST(count(*) AS BIGINT) AS row_count FROM examples GROUP BY 2
    UNION ALL SELECT 'model_id', model_id, count(*) FROM examples GROUP BY 2""",
)
def dataset_level_counts(spark, sf_dir):
    return rg.level_counts(examples(spark, sf_dir), ["campaign_frequency_hz", "model_id"])


@query(
    "dataset_checks",
    "G16",
    f"""WITH {E}, c AS (SELECT count(DISTINCT campaign_condition_id) AS a, count(DISTINCT campaign_run_id) AS b, count(DISTINCT example_id) AS d, count(*) AS n FROM examples)
    SELECT 'condition_count' AS check_name, a::DOUBLE AS value, 105.0::DOUBLE AS expected, a = 105 AS passed FROM c
    UNION ALL SELECT 'run_count', b, 15000, b = 15000 FROM c UNION ALL SELECT 'unique_example_ids', d, n, d = n FROM c
    UNION ALL SELECT 'target_valid', 0, 0, true UNION ALL SELECT 'square_pixels', 0, 0, true""",
)
def dataset_checks(spark, sf_dir):
    return rg.dataset_checks(examples(spark, sf_dir), expected_conditions=105, expected_runs=15000, target="truth_cs_center_m_s")


@query(
    "missing_counts",
    "G61",
    f"""WITH {PREDICTIONS_SQL}, f AS (SELECT nullif(q_true, 0.1::DOUBLE) AS q_true, nullif(campaign_size, 7) AS campaign_size FROM predictions)
    SELECT 'q_true' AS variable_name, CAST(count(*) FILTER (q_true IS NULL) AS BIGINT) AS null_count, CAST(0 AS BIGINT) AS nonfinite_count FROM f
    UNION ALL SELECT 'campaign_size', count(*) FILTER (campaign_size IS NULL), 0 FROM f""",
)
def missing_counts(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(
        F.nullif(F.col("q_true"), F.lit(0.1)).alias("q_true"), F.nullif(F.col("campaign_size"), F.lit(7)).alias("campaign_size")
    )
    return rg.missing_counts(rows, ["q_true", "campaign_size"])


_ROLES = """(VALUES ('example_id', 'identifier', 'identity', false), ('campaign_run_id', 'identifier', 'identity', false),
      ('campaign_condition_id', 'metadata', 'campaign', false), ('campaign_geometry_family', 'metadata', 'campaign', false),
      ('campaign_geometry_seed', 'metadata', 'campaign', false), ('truth_cs_center_m_s', 'truth', 'sws_truth', false),
      ('campaign_frequency_hz', 'metadata', 'operational_context', true), ('truth_material_purity', 'truth', 'material_truth', false),
      ('campaign_angular_entropy', 'metadata', 'campaign', false), ('campaign_direction_count', 'metadata', 'campaign', false),
      ('campaign_solid_angle_sr', 'metadata', 'campaign', false), ('GRID_dx_m', 'metadata', 'operational_context', true),
      ('GRID_dz_m', 'metadata', 'operational_context', true), ('patch_idx', 'coordinate', 'location', false),
      ('model_id', 'unregistered', 'unknown', false), ('iteration_index', 'feature', 'other_feature', true),
      ('part_id', 'feature', 'other_feature', true)) t(variable_name, role, "group", trainable)"""
_ALL_NUMERIC = [
    "campaign_geometry_seed", "truth_cs_center_m_s", "campaign_frequency_hz", "truth_material_purity", "campaign_angular_entropy",
    "campaign_direction_count", "campaign_solid_angle_sr", "GRID_dx_m", "GRID_dz_m", "patch_idx", "iteration_index", "part_id",
]


@query(
    "variable_registry",
    "P23 P24 G17",
    f"""WITH {E}, u AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _ALL_NUMERIC)} FROM examples)
        ON {', '.join(_ALL_NUMERIC)} INTO NAME variable_name VALUE v),
    c AS (SELECT variable_name, count(v) AS n, count(DISTINCT v) AS d FROM u GROUP BY 1)
    SELECT variable_name, role, "group", trainable, CAST(n AS BIGINT) AS finite_count, CAST(d AS BIGINT) AS unique_finite_count
    FROM {_ROLES} LEFT JOIN c USING (variable_name)""",
)
def variable_registry(spark, sf_dir):
    rows = examples(spark, sf_dir)
    registry = rg.variable_registry(rows)
    numeric = [c for c, t in rows.dtypes if t in rg.NUMERIC]
    counts = rg.variable_summary(rows, numeric).select("variable_name", "finite_count", "unique_finite_count")
    return registry.join(counts, "variable_name", "left").select(
        "variable_name", "role", "group", "trainable", "finite_count", "unique_finite_count"
    )


@query(
    "predictor_contract",
    "P25 M11 P26",
    f"""WITH {PREDICTIONS_SQL}, c AS (SELECT CAST(count(*) FILTER (campaign_size = 7) AS BIGINT) AS n FROM predictions)
    SELECT 'campaign_frequency_hz' AS predictor, false AS duplicated, false AS missing, false AS nonnumeric, false AS forbidden, CAST(0 AS BIGINT) AS nonfinite_count, true AS accepted
    UNION ALL SELECT 'campaign_size', false, false, false, false, n, n = 0 FROM c UNION ALL SELECT 'truth_material_purity', true, false, false, true, 0, false
    UNION ALL SELECT 'model_id', false, false, true, true, 0, false UNION ALL SELECT 'absent', false, true, false, false, 0, false""",
)
def predictor_contract(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("campaign_size", F.nullif(F.col("campaign_size"), F.lit(7)))
    asked = ["campaign_frequency_hz", "campaign_size", "truth_material_purity", "truth_material_purity", "model_id", "absent"]
    return rg.predictor_contract(rows, asked)


# --- unions and joins ---------------------------------------------------------------------------------------


@query(
    "strict_union",
    "S1",
    f"WITH {E} SELECT iteration_index, CAST(count(*) AS BIGINT) AS row_count FROM examples GROUP BY 1",
)
def strict_union(spark, sf_dir):
    rows = examples(spark, sf_dir)
    out = ds.check_union([rows.where("iteration_index <= 3"), rows.where("iteration_index > 3")])
    return out.groupBy("iteration_index").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "filled_union",
    "S2",
    f"""WITH {E} SELECT model_id, CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) FILTER (iteration_index > 3) AS BIGINT) AS missing_purity FROM examples GROUP BY 1""",
)
def filled_union(spark, sf_dir):
    rows = examples(spark, sf_dir)
    late = rows.where("iteration_index > 3").drop("truth_material_purity")
    out = ds.check_union([rows.where("iteration_index <= 3"), late], fill_missing=True)
    return out.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("truth_material_purity").isNull()).alias("missing_purity")
    )


@query(
    "dual_configuration",
    "S7",
    f"""WITH {E}, s AS (SELECT example_id || '__M2' AS example_id, campaign_run_id, 2 AS m FROM examples UNION ALL
      SELECT example_id || '__M3', campaign_run_id, 3 FROM examples WHERE patch_idx <= 6)
    SELECT campaign_run_id, CAST(count(*) FILTER (m = 2) AS BIGINT) AS count_M2, CAST(count(*) FILTER (m = 3) AS BIGINT) AS count_M3 FROM s
    GROUP BY 1 HAVING count(*) FILTER (m = 2) <> count(*) FILTER (m = 3)""",
)
def dual_configuration(spark, sf_dir):
    rows = examples(spark, sf_dir)
    return ds.dual_configuration({2: rows, 3: rows.where("patch_idx <= 6")})[1]


@query(
    "matched_support",
    "S8",
    f"""WITH {E}, a AS (SELECT * FROM examples WHERE iteration_index <= 3 AND campaign_frequency_hz < 30), b AS (SELECT * FROM examples WHERE iteration_index > 3 AND campaign_frequency_hz > 10),
    a1 AS (SELECT * FROM a WHERE campaign_frequency_hz IN (SELECT campaign_frequency_hz FROM b)), b1 AS (SELECT * FROM b WHERE campaign_frequency_hz IN (SELECT campaign_frequency_hz FROM a)),
    a2 AS (SELECT * FROM a1 WHERE part_id IN (SELECT part_id FROM b1)), b2 AS (SELECT * FROM b1 WHERE part_id IN (SELECT part_id FROM a1))
    SELECT 'left' AS side, CAST(count(*) AS BIGINT) AS row_count FROM a2 UNION ALL SELECT 'right', count(*) FROM b2""",
)
def matched_support(spark, sf_dir):
    rows = examples(spark, sf_dir)
    left, right = ds.matched_support(
        rows.where("iteration_index <= 3 and campaign_frequency_hz < 30"),
        rows.where("iteration_index > 3 and campaign_frequency_hz > 10"),
        ["campaign_frequency_hz", "part_id"],
    )
    count = lambda d, s: d.agg(F.count(F.lit(1)).alias("row_count")).withColumn("side", F.lit(s))
    return count(left, "left").unionByName(count(right, "right"))


@query(
    "keyed_reference_join",
    "J13 J4",
    f"""WITH {E}, k AS (SELECT campaign_condition_id || '|' || patch_idx || '|' || model_id AS row_key, truth_cs_center_m_s AS v FROM examples),
    ref AS (SELECT row_key, avg(v) AS m FROM k GROUP BY 1)
    SELECT row_key, CAST(count(*) AS BIGINT) AS row_count, round(max(v - m), 7) AS largest_excess FROM k JOIN ref USING (row_key) GROUP BY 1""",
)
def keyed_reference_join(spark, sf_dir):
    rows = examples(spark, sf_dir).select(
        ds.bar_key("campaign_condition_id", "patch_idx", "model_id").alias("row_key"), F.col("truth_cs_center_m_s").alias("v")
    )
    reference = rows.groupBy("row_key").agg(F.avg("v").alias("m"))
    joined = rows.join(reference, "row_key")
    return rounded(joined.groupBy("row_key").agg(F.count(F.lit(1)).alias("row_count"), F.max(F.col("v") - F.col("m")).alias("largest_excess")), 7)


@query(
    "unknown_keys",
    "J4",
    f"WITH {R}, {E} SELECT DISTINCT campaign_run_id FROM examples WHERE campaign_run_id NOT IN (SELECT run_id FROM runs WHERE status <> 'failed')",
)
def unknown_keys(spark, sf_dir):
    known = runs(spark, sf_dir).where("status <> 'failed'").select(F.col("run_id").alias("campaign_run_id"))
    return ds.unmatched(examples(spark, sf_dir), known, "campaign_run_id")


@query(
    "config_json",
    "A6",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""",
)
def config_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    return ds.decode_config(rows, "props", "k int").select("event_id", F.col("config.k").alias("k"))


@query(
    "direction_vectors",
    "G56",
    """WITH v AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
    u AS (SELECT label, abs(y / sqrt(x * x + y * y + z * z)) AS a FROM v)
    SELECT label, CAST(count(*) AS BIGINT) AS N, round(min(a), 6) AS min_abs_uy, round(median(a), 6) AS median_abs_uy, CAST(count(*) FILTER (a <= 0.1::DOUBLE) AS BIGINT) AS in_plane_count FROM u GROUP BY 1""",
)
def direction_vectors(spark, sf_dir):
    from fieldgrain.operators.order_stats import percentiles

    part = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    norm = F.sqrt(part[0] * part[0] + part[1] * part[1] + part[2] * part[2])
    rows = table(spark, sf_dir, "embeddings").select("label", F.abs(part[1] / norm).alias("a"))
    base = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("N"), F.min("a").alias("min_abs_uy"), F.count_if(F.col("a") <= 0.1).alias("in_plane_count")
    )
    return rounded(base.join(percentiles(rows, ["label"], "a", {"median_abs_uy": 0.5}), "label"))


@query(
    "angular_family_match",
    "D10 P3",
    f"""WITH {E}, f(lv, d, s) AS (VALUES ('level_1_near_single', 1, 0.01::DOUBLE / (4 * {math.pi!r}::DOUBLE)), ('level_2_narrow', 3, 0.01::DOUBLE), ('level_3_directional', 6, 0.04::DOUBLE),
      ('level_4_low_intermediate', 10, 0.125::DOUBLE), ('level_5_intermediate', 16, 0.25::DOUBLE), ('level_6_broad', 24, 0.5::DOUBLE), ('level_7_diffuse', 32, 1.0::DOUBLE))
    SELECT lv AS name, d AS direction_count, round(4 * {math.pi!r}::DOUBLE * s, 6) AS solid_angle_sr, round(d / 128.0::DOUBLE * s, 8) AS nominal_angular_coverage,
      CAST(count(e.example_id) AS BIGINT) AS example_count FROM f LEFT JOIN examples e ON e.campaign_direction_count = d GROUP BY ALL""",
)
def angular_family_match(spark, sf_dir):
    family = pl.angular_family(spark)
    counts = examples(spark, sf_dir).groupBy(F.col("campaign_direction_count").alias("direction_count")).agg(
        F.count(F.lit(1)).alias("example_count")
    )
    out = family.join(counts, "direction_count", "left").fillna(0, ["example_count"])
    return out.select(
        "name", "direction_count", r("solid_angle_sr").alias("solid_angle_sr"), r("nominal_angular_coverage", 8).alias("nominal_angular_coverage"), "example_count"
    )


@query(
    "bootstrap_request_match",
    "D14",
    f"""WITH {E}, b AS (SELECT i + 1 AS rk, i // 15 + 1 AS s, (i // 3) % 5 + 1 AS f, i % 3 + 1 AS g, (i * 2) % 3 + 1 AS p, (i * 1) % 3 + 1 AS d, i % 3 AS fam FROM range(60) t(i)),
    h AS (SELECT campaign_geometry_family AS fam, count(*) AS n FROM examples GROUP BY 1)
    SELECT rk AS priority_rank, printf('s%02d_f%02d_p%02d_d%02d_g%02d', s, f, p, d, g) AS cell_key, CAST(b.fam AS VARCHAR) AS geometry_family,
      printf('boot_s%02d_f%02d_p%02d_d%02d_g%02d_%03d', s, f, p, d, g, rk) AS condition_id, CAST(n AS BIGINT) AS family_example_count FROM b JOIN h ON h.fam = CAST(b.fam AS VARCHAR)""",
)
def bootstrap_request_match(spark, sf_dir):
    from fieldgrain.plans.coverage import GRID

    requests = pl.bootstrap_requests(
        spark, GRID, purity_stride=2, diffusivity_stride=1, families=["0", "1", "2"], realizations=3, prefix="boot"
    )
    used = examples(spark, sf_dir).groupBy(F.col("campaign_geometry_family").alias("geometry_family")).agg(
        F.count(F.lit(1)).alias("family_example_count")
    )
    return requests.join(used, "geometry_family").select(
        "priority_rank", "cell_key", "geometry_family", "condition_id", "family_example_count"
    )
