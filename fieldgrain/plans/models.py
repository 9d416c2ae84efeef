"""Baselines, fits, strategies, theory, centre selection and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from fieldgrain.operators import centers as ct, estimate, forests as fo, metrics as m, models as md, splits as sp, theory as th
from fieldgrain.operators.registry import SPECTRAL_FEATURES
from fieldgrain.plans.catalog import query, rounded
from fieldgrain.plans.coverage import assigned, deficits
from fieldgrain.plans.frames import PREDICTIONS_SQL, pixels, predictions, samples
from fieldgrain.session import cut_lineage, ensure_checkpoint_dir, stored
from fieldgrain.streaming import incremental as inc

P = PREDICTIONS_SQL
X = ["campaign_frequency_hz", "campaign_size"]


@query(
    "fixed_quantile_baseline",
    "P19",
    f"""WITH {P}, v AS (SELECT greatest(0.001::DOUBLE, least(0.999::DOUBLE, median(q_true))) AS q FROM predictions WHERE partition = 'train')
    SELECT partition, CAST(count(*) AS BIGINT) AS N, round(any_value(q), 6) AS q_pred, round(avg(abs(q - q_true)), 6) AS q_mae FROM predictions, v GROUP BY 1""",
)
def fixed_quantile_baseline(spark, sf_dir):
    rows = md.fixed_quantile(predictions(spark, sf_dir), "q_true")
    return rounded(
        rows.groupBy("partition").agg(
            F.count(F.lit(1)).alias("N"), F.max("q_pred").alias("q_pred"), F.avg(F.abs(F.col("q_pred") - F.col("q_true"))).alias("q_mae")
        )
    )


@query(
    "theory_baseline",
    "P20 P28",
    f"""WITH {P}, t AS (SELECT partition, q_true, CASE WHEN campaign_size = 13 THEN 1.5::DOUBLE ELSE campaign_size / 50.0::DOUBLE END AS th FROM predictions),
    q AS (SELECT *, th BETWEEN 0 AND 1 AS ok, CASE WHEN th BETWEEN 0 AND 1 THEN greatest(0.001::DOUBLE, least(0.999::DOUBLE, th)) END AS p FROM t)
    SELECT partition, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS invalid_count, round(avg(abs(p - q_true)), 6) AS q_mae,
      round(avg(q_true - p), 6) AS residual_mean, round(avg(CASE WHEN ok THEN greatest(0.001::DOUBLE, least(0.999::DOUBLE, p + 0.1::DOUBLE)) END), 6) AS corrected_mean FROM q GROUP BY 1""",
)
def theory_baseline(spark, sf_dir):
    rows = predictions(spark, sf_dir).drop("q_pred").withColumn(
        "theory", F.when(F.col("campaign_size") == 13, 1.5).otherwise(F.col("campaign_size") / 50.0)
    )
    rows = md.residual_target(md.theory_quantile_baseline(rows, "theory"), "q_true", "q_pred")
    return rounded(
        rows.groupBy("partition").agg(
            F.count_if(~F.col("theory_valid")).alias("invalid_count"),
            F.avg(F.abs(F.col("q_pred") - F.col("q_true"))).alias("q_mae"),
            F.avg("target_residual").alias("residual_mean"),
            F.avg(md.prior_plus_residual(F.col("q_pred"), F.lit(0.1))).alias("corrected_mean"),
        )
    )


@query(
    "guess_expansion",
    "P18",
    f"""WITH {P} SELECT g AS user_field_guess, CAST(count(*) AS BIGINT) AS N, round(avg(CASE g WHEN 'directional' THEN q_true WHEN 'diffuse' THEN q_pred
      WHEN 'partial' THEN truth_material_purity ELSE 0.5::DOUBLE END), 6) AS mean_prior FROM predictions, (SELECT unnest(['directional', 'partial', 'diffuse', 'unknown']) AS g) GROUP BY 1""",
)
def guess_expansion(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("half", F.lit(0.5))
    priors = {"directional": "q_true", "partial": "truth_material_purity", "diffuse": "q_pred", "unknown": "half"}
    long = md.guess_expansion(rows, priors)
    return rounded(long.groupBy("user_field_guess").agg(F.count(F.lit(1)).alias("N"), F.avg("q_prior_guess").alias("mean_prior")))


@query(
    "standardisation",
    "M2",
    f"""WITH {P}, t AS (SELECT * FROM predictions WHERE partition = 'train')
    SELECT 'campaign_frequency_hz' AS predictor, round(avg(campaign_frequency_hz), 6) AS mu, round(stddev_samp(campaign_frequency_hz), 6) AS sigma, false AS constant FROM t
    UNION ALL SELECT 'campaign_size', round(avg(campaign_size), 6), round(stddev_samp(campaign_size), 6), false FROM t
    UNION ALL SELECT 'flat', 3, 1, true""",
)
def standardisation(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("partition = 'train'").withColumn("flat", F.lit(3.0))
    return rounded(md.standardisation(rows, [*X, "flat"]))


@query(
    "ood_distance",
    "M16",
    f"""WITH {P}, s AS (SELECT avg(campaign_frequency_hz) AS m1, stddev_samp(campaign_frequency_hz) AS s1, avg(campaign_size) AS m2, stddev_samp(campaign_size) AS s2 FROM predictions WHERE partition = 'train')
    SELECT example_id, round(sqrt((pow((campaign_frequency_hz - m1) / s1, 2) + pow((campaign_size - m2) / s2, 2)) / 2), 6) AS ood_distance FROM predictions, s WHERE partition = 'test'""",
)
def ood_distance(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    out = md.ood_distance(rows.where("partition = 'test'"), rows.where("partition = 'train'"), X)
    return rounded(out.select("example_id", "ood_distance"))


# Ridge with two standardised predictors has a closed form: the normal equations of centred columns.
@query(
    "ridge",
    "M3 M5",
    f"""WITH {P}, t AS (SELECT * FROM predictions WHERE partition = 'train'),
    s AS (SELECT avg(campaign_frequency_hz) AS m1, stddev_samp(campaign_frequency_hz) AS s1, avg(campaign_size) AS m2, stddev_samp(campaign_size) AS s2, avg(q_pred) AS my FROM t),
    z AS (SELECT (campaign_frequency_hz - m1) / s1 AS a, (campaign_size - m2) / s2 AS b, q_pred AS y FROM t, s),
    g AS (SELECT sum(a * a) + 10 AS aa, sum(a * b) AS ab, sum(b * b) + 10 AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM z),
    k AS (SELECT (ay * bb - ab * byy) / (aa * bb - ab * ab) AS ca, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS cb FROM g)
    SELECT campaign_frequency_hz, campaign_size, CAST(count(*) AS BIGINT) AS N, round(any_value(greatest(0.001::DOUBLE, least(0.999::DOUBLE,
      my + ca * (campaign_frequency_hz - m1) / s1 + cb * (campaign_size - m2) / s2))), 6) AS q_ridge FROM predictions, s, k WHERE partition <> 'train' GROUP BY 1, 2""",
)
def ridge(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    model = md.fit(rows.where("partition = 'train'"), "ridge", X, "q_pred", penalty=10.0)
    scored = md.score(rows.where("partition <> 'train'"), model, "q_ridge")
    return rounded(scored.groupBy(*X).agg(F.count(F.lit(1)).alias("N"), F.max("q_ridge").alias("q_ridge")))


@query(
    "oracle_choice",
    "M14",
    f"""WITH {P}, c AS (SELECT example_id, cs_true_m_s AS t, cs_pred_m_s AS a, cs_pred_m_s * 0.8::DOUBLE AS b, cs_true_m_s * 1.1::DOUBLE + campaign_size AS d FROM predictions)
    SELECT example_id, CASE WHEN abs(a - t) <= abs(b - t) AND abs(a - t) <= abs(d - t) THEN 'M2' WHEN abs(b - t) <= abs(d - t) THEN 'M3' ELSE 'residual' END AS oracle_source FROM c""",
)
def oracle_choice(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(
        "example_id", "cs_true_m_s", F.col("cs_pred_m_s").alias("a"), (F.col("cs_pred_m_s") * 0.8).alias("b"),
        (F.col("cs_true_m_s") * 1.1 + F.col("campaign_size")).alias("d"),
    )
    return md.best_candidate(rows, {"M2": "a", "M3": "b", "residual": "d"}, "cs_true_m_s").select("example_id", "oracle_source")


_WINDOWS = f"""{P}, w AS (SELECT campaign_run_id AS place, campaign_direction_count AS wm, avg(cs_pred_m_s) AS s, max(truth_material_purity) AS pm,
    max(campaign_frequency_hz) AS pu, max(campaign_size) / 10 AS ef FROM predictions GROUP BY 1, 2),
  n AS (SELECT place, avg(s) AS mean, median(s) AS med, count(*) AS c FROM w GROUP BY 1 HAVING count(*) >= 2)"""


def _windows(spark, sf_dir):
    return (
        predictions(spark, sf_dir)
        .groupBy(F.col("campaign_run_id").alias("place"), F.col("campaign_direction_count").alias("wm"))
        .agg(
            F.avg("cs_pred_m_s").alias("s"), F.max("truth_material_purity").alias("pm"), F.max("campaign_frequency_hz").alias("pu"),
            (F.max("campaign_size") / 10).alias("ef"),
        )
    )


@query(
    "window_strategies",
    "P29",
    f"""WITH {_WINDOWS}, k AS (SELECT w.*, row_number() OVER (PARTITION BY place ORDER BY pm, wm) AS r1, row_number() OVER (PARTITION BY place ORDER BY pu DESC, wm) AS r2,
      row_number() OVER (PARTITION BY place ORDER BY abs(ef - 2.5::DOUBLE), wm) AS r3 FROM w JOIN n USING (place))
    SELECT place, 'mean' AS strategy_name, round(mean, 6) AS cs_strategy_m_s, NULL::DOUBLE AS source_window FROM n UNION ALL SELECT place, 'median', round(med, 6), NULL FROM n
    UNION ALL SELECT place, 'lowest_predicted_mixedness', round(s, 6), wm FROM k WHERE r1 = 1 UNION ALL SELECT place, 'highest_predicted_purity', round(s, 6), wm FROM k WHERE r2 = 1
    UNION ALL SELECT place, 'nearest_effective_window', round(s, 6), wm FROM k WHERE r3 = 1""",
)
def window_strategies(spark, sf_dir):
    out = md.window_strategies(
        _windows(spark, sf_dir), ["place"], speed="s", window="wm", mixed="pm", purity="pu", effective="ef", target=2.5
    )
    return rounded(out)


_STRATS = f"""{P}, st AS (SELECT 'base' AS strategy_name, cs_true_m_s AS t, cs_pred_m_s AS b, cs_pred_m_s AS v, false AS ch FROM predictions
  UNION ALL SELECT 'shrink', cs_true_m_s, cs_pred_m_s, CASE WHEN campaign_size > 25 AND truth_material_purity < 0.05::DOUBLE THEN (cs_pred_m_s + 1500) / 2 ELSE cs_pred_m_s END, campaign_size > 25 AND truth_material_purity < 0.05::DOUBLE FROM predictions
  UNION ALL SELECT 'scale', cs_true_m_s, cs_pred_m_s, CASE WHEN campaign_size > 10 AND truth_material_purity < 0.09::DOUBLE THEN cs_pred_m_s * 0.7::DOUBLE ELSE cs_pred_m_s END, campaign_size > 10 AND truth_material_purity < 0.09::DOUBLE FROM predictions),
  e AS (SELECT strategy_name, 100 * abs(v - t) / t AS a, 100 * abs(b - t) / t AS c, ch FROM st),
  su AS (SELECT strategy_name, count(*) AS n, avg(a) AS mape, 100.0::DOUBLE * count(*) FILTER (a > 20) / count(*) AS h, 100.0::DOUBLE * count(*) FILTER (ch) / count(*) AS cp,
    100.0::DOUBLE * count(*) FILTER (ch AND a + 0.5::DOUBLE < c) / nullif(count(*) FILTER (ch), 0) AS ip, 100.0::DOUBLE * count(*) FILTER (ch AND a > c + 0.5::DOUBLE) / nullif(count(*) FILTER (ch), 0) AS hp FROM e GROUP BY 1)"""


def _strategies(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    gain, harm = F.col("campaign_size").cast("double"), F.col("truth_material_purity")
    base = F.col("cs_pred_m_s")
    parts = [
        ("base", md.gated(rows, gain, harm, base, base, minimum_gain=1e9, maximum_harm=0.0)),
        ("shrink", md.gated(rows, gain, harm, base, (base + 1500) / 2, minimum_gain=25.0, maximum_harm=0.05)),
        ("scale", md.gated(rows, gain, harm, base, base * 0.7, minimum_gain=10.0, maximum_harm=0.09)),
    ]
    out = None
    for name, part in parts:
        part = part.select(F.lit(name).alias("strategy_name"), "cs_true_m_s", "cs_pred_m_s", "cs_strategy_m_s", "was_corrected")
        out = part if out is None else out.unionByName(part)
    return md.strategy_summary(
        out, ["strategy_name"], value="cs_strategy_m_s", base="cs_pred_m_s", truth="cs_true_m_s", changed="was_corrected"
    )


@query(
    "strategy_summary",
    "G50 M12",
    f"""WITH {_STRATS} SELECT strategy_name, CAST(n AS BIGINT) AS N, round(mape, 6) AS MAPE_pct, round(h, 6) AS high_error20_pct, round(cp, 6) AS corrected_pct,
      round(ip, 6) AS improved_pct, round(hp, 6) AS harmed_pct FROM su""",
)
def strategy_summary(spark, sf_dir):
    return rounded(_strategies(spark, sf_dir))


@query(
    "strategy_success",
    "G50 T14",
    f"""WITH {_STRATS} SELECT strategy_name, round(100 * (b.mape - su.mape) / b.mape, 6) AS gain_pct, round(su.h - b.h, 6) AS delta_high20_pct,
      su.mape < b.mape AND su.h <= b.h AND coalesce(su.hp, 0) <= 60 AS passed FROM su, (SELECT mape, h FROM su WHERE strategy_name = 'base') b WHERE strategy_name <> 'base'""",
)
def strategy_success(spark, sf_dir):
    return rounded(md.success_table(_strategies(spark, sf_dir), [], "base", maximum_harm=60.0))


@query(
    "best_strategies",
    "T14",
    f"""WITH {_STRATS}, c AS (SELECT 'lowest_mape' AS criterion, strategy_name, mape AS v FROM su UNION ALL SELECT 'lowest_high_error', strategy_name, h FROM su
      UNION ALL SELECT 'penalised', strategy_name, mape + 0.5::DOUBLE * coalesce(hp, 0) FROM su)
    SELECT criterion, strategy_name, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY v, strategy_name) AS rn FROM c) WHERE rn = 1""",
)
def best_strategies(spark, sf_dir):
    return rounded(md.best_strategies(_strategies(spark, sf_dir)))


# --- fits without SQL counterpart ---------------------------------------------------------------------------

PREDICTORS = ["campaign_frequency_hz", "campaign_size", "cs_pred_m_s"]


def _training(spark, sf_dir):
    """What the fits read of the predictions, written once."""
    return stored(predictions(spark, sf_dir).select("model_id", "partition", *PREDICTORS, "q_true", "truth_material_purity"))


def _folded(spark, sf_dir):
    """Rows with folds; the run is the condition here, so no run is in two folds."""
    rows = predictions(spark, sf_dir).select("partition", F.col("campaign_run_id").alias("campaign_condition_id"), *PREDICTORS, "q_true")
    return stored(sp.grouped_folds(rows, 5, seed=7))


@query("bagged_trees", "M4 M1 M5")
def bagged_trees(spark, sf_dir):
    rows = _training(spark, sf_dir)
    scored = fo.forest_quantile(rows.select("partition", *PREDICTORS, "q_true"), rows.where("partition = 'train'"), PREDICTORS, "q_true", trees=20, depth=8)
    return rounded(m.quantile_metrics(stored(scored.select("partition", "q_true", "q_pred")), ["partition"]), 4)


@query("out_of_fold", "M6")
def out_of_fold(spark, sf_dir):
    scored, _ = md.out_of_fold(_folded(spark, sf_dir), "ridge", PREDICTORS, "q_true", 5, penalty=1.0)
    return rounded(
        scored.groupBy("partition", "prediction_source").agg(
            F.count(F.lit(1)).alias("row_count"), F.avg(F.abs(F.col("q_pred") - F.col("q_true"))).alias("q_mae")
        )
    )


@query("model_families", "M9 M10 M21")
def model_families(spark, sf_dir):
    rows = _training(spark, sf_dir)
    train, rest = rows.where("partition = 'train'"), rows.where("partition <> 'train'")
    fits = {
        "ridge_context": md.fit(train, "ridge", PREDICTORS[:2], "q_true"),
        "ridge_full": md.fit(train, "ridge", PREDICTORS, "q_true"),
        "linear": md.fit(train, "linear", PREDICTORS, "q_true", categorical=["model_id"]),
        "quadratic": md.fit(train, "quadratic", PREDICTORS, "q_true"),
    }
    boosted = fo.forest_quantile(rest, train, PREDICTORS, "q_true", kind="boosted_trees", trees=200).withColumn("model_id", F.lit("boosted"))
    scored = md.score_many(rest, fits).unionByName(boosted).select("model_id", "partition", "q_true", "q_pred")
    return rounded(m.quantile_metrics(stored(scored), ["model_id", "partition"]), 4)


@query("nearest_neighbour_regression", "M10")
def nearest_neighbour_regression(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    scored = md.nearest_neighbours(rows.where("partition = 'test'"), rows.where("partition = 'train'"), X, "q_true", 15, "example_id")
    return rounded(scored.groupBy(*X).agg(F.count(F.lit(1)).alias("N"), F.max("prediction").alias("q_knn")))


@query("composition", "M8 M22")
def composition(spark, sf_dir):
    rows = _training(spark, sf_dir).withColumn("purity", F.lit(0.5) + F.col("truth_material_purity") * 5)
    out = fo.composition(rows.where("partition = 'test'"), rows.where("partition = 'train'"), PREDICTORS, "purity", trees=10)
    return rounded(
        out.groupBy("model_id").agg(
            F.count(F.lit(1)).alias("N"), *[F.avg(c).alias(c) for c in ("predicted_purity", "p_mixed", "p_strong_mixed")]
        ),
        4,
    )


@query("drop_one_ablation", "M15 D17")
def drop_one_ablation(spark, sf_dir):
    rows = _training(spark, sf_dir)
    return rounded(md.drop_one(rows.where("partition = 'train'"), rows.where("partition = 'test'"), "ridge", PREDICTORS[:3], "q_true"))


def _features(spark, sf_dir):
    features = estimate.window_features(pixels(spark, sf_dir), samples(spark, sf_dir), 9, 4)
    split = F.when(F.col("sample_id") % 10 < 7, "train").when(F.col("sample_id") % 10 < 8, "validation").otherwise("test")
    return cut_lineage(estimate.with_target(features).withColumn("partition", split))


@query("predicted_speed_maps", "M18 M7 K20")
def predicted_speed_maps(spark, sf_dir):
    rows = _features(spark, sf_dir)
    model = md.fit(rows.where("partition = 'train'"), "ridge", SPECTRAL_FEATURES, "target_q", penalty=1.0)
    maps = estimate.predict_maps(rows, model, truth=F.col("truth_cs_center_m_s"))
    return rounded(maps.select("sample_id", "map_z", "map_x", "prediction_valid", "q_pred", "cs_pred_m_s", "cs_true_m_s", "sws_valid"), 4)


@query("transfer_study", "M19 M20")
def transfer_study(spark, sf_dir):
    rows = _features(spark, sf_dir)
    model = md.fit(rows.where("partition = 'train'"), "ridge", SPECTRAL_FEATURES, "target_q", penalty=1.0)
    maps = estimate.predict_maps(rows, model, truth=F.col("truth_cs_center_m_s"))
    both = maps.withColumn("sampling_mode", F.lit("dense")).unionByName(
        maps.where("map_z % 8 = 4 and map_x % 8 = 4").withColumn("sampling_mode", F.lit("stride_matched"))
    )
    return rounded(m.external_metrics(both.withColumn("side", (F.col("map_x") > 10).cast("int")), ["sampling_mode", "side"]), 4)


@query("theory_quantile", "K9 P16")
def theory_quantile(spark, sf_dir):
    kind = F.col("sample_id") % 4
    rows = samples(spark, sf_dir).select(
        "sample_id", "dx_m", "dz_m", "frequency_hz", F.col("cs_left").alias("speed_m_s"), F.lit(2.0).alias("window_M"),
        F.when(kind == 0, "SingleWave").when(kind == 1, "Diffuse2D").when(kind == 2, "Diffuse3D").otherwise("PartialDiffuse3D").alias("field_type"),
    )
    return rounded(th.attach_theory(rows, "field_type").select("sample_id", "field_type", "q_theory", "q_theory_valid"))


def _candidates(spark, sf_dir):
    """Grid candidates per run (a part): every valid row at a position of its own, with the row's coverage cell.

    Positions fill rows of eight in the order of the examples; a part's rows do not grow with the table.
    """
    rows = assigned(spark, sf_dir).where("coverage_valid")
    order = Window.partitionBy("part_id").orderBy("example_id", "coverage_cell_key")
    at = F.col("_at")
    return rows.withColumn("_at", F.row_number().over(order) - 1).select(
        F.concat(F.lit("run_"), F.col("part_id").cast("string")).alias("run_id"),
        (at % 8 * 4).cast("int").alias("cx"),
        (F.floor(at / 8) * 4).cast("int").alias("cz"),
        F.col("coverage_cell_key").alias("cell_key"),
    )


@query("directed_centers", "T7")
def directed_centers(spark, sf_dir):
    wanted = deficits(spark, sf_dir, include_complete=False)
    needs = cut_lineage(wanted.select("cell_key", "deficit_score", F.col("example_deficit").alias("needed")))
    requests = needs.withColumn("ordinal", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("cell_key")))
    return ct.directed_centers(cut_lineage(_candidates(spark, sf_dir)), requests, per_cell=2, distance=12.0, step=4)


@query("deficit_aware_centers", "T8 T9")
def deficit_aware_centers(spark, sf_dir):
    pool = cut_lineage(_candidates(spark, sf_dir))
    first = pool.groupBy("run_id").agg(F.min(F.struct("cz", "cx", "cell_key")).alias("f")).select("run_id", "f.cx", "f.cz", "f.cell_key")
    state = cut_lineage(deficits(spark, sf_dir))
    return ct.deficit_centers(
        pool, state, first, per_run=4, per_cell=2, window=25, realizations=3, policy="relationship_aware"
    )


@query("stream_coverage", "ST1 ST2")
def stream_coverage(spark, sf_dir):
    """Coverage counts of the patch table delivered as a stream, equal to the batch counts."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    assigned(spark, sf_dir).select("example_id", "campaign_run_id", "coverage_valid", "coverage_cell_key").write.parquet(f"{folder}/rows")
    schema = "example_id string, campaign_run_id string, coverage_valid boolean, coverage_cell_key string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/rows")
    counts = inc.coverage_stream(stream)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    done = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    seen = spark.read.parquet(f"{folder}/counts")
    latest = seen.groupBy("cell_key").agg(F.max_by("example_count", "batch").alias("example_count"))
    return inc.remaining_deficits(latest, 40)
