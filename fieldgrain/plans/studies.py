"""Held-out studies on a target that the predictors explain, and deliveries in several parts as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from fieldgrain.operators import coverage as cov, risk as rk, studies as st, tiles as tl
from fieldgrain.plans.catalog import query, rounded
from fieldgrain.plans.coverage import DEFICITS_SQL, GRID, MINIMA, assigned
from fieldgrain.plans.frames import PREDICTIONS_SQL, predictions, table
from fieldgrain.session import ensure_checkpoint_dir, stored
from fieldgrain.streaming import incremental as inc

PREDICTORS = ["campaign_frequency_hz", "campaign_size"]

#: The target follows two predictors; the tax of the line, which no predictor knows, is its noise.
SIGNAL_SQL = f"""{PREDICTIONS_SQL},
signal AS (SELECT *, 0.15::DOUBLE + 0.009::DOUBLE * campaign_frequency_hz + 0.003::DOUBLE * campaign_size + (q_pred - q_true) AS q_target FROM predictions)"""


def signal(spark, sf_dir) -> DataFrame:
    rows = predictions(spark, sf_dir)
    noise = F.col("q_pred") - F.col("q_true")
    return rows.withColumn("q_target", F.lit(0.15) + F.lit(0.009) * F.col("campaign_frequency_hz") + F.lit(0.003) * F.col("campaign_size") + noise)



@query(
    "heldout_levels",
    "D17",
    f"""WITH {SIGNAL_SQL}, a AS (
      SELECT 'frequency_band' AS axis, CAST(CAST(floor(campaign_frequency_hz / 10) AS BIGINT) AS VARCHAR) AS level, campaign_frequency_hz AS x1, CAST(campaign_size AS DOUBLE) AS x2, q_target AS y FROM signal
      UNION ALL SELECT 'campaign_brand', campaign_brand, campaign_frequency_hz, CAST(campaign_size AS DOUBLE), q_target FROM signal),
    l AS (SELECT DISTINCT axis, level FROM a),
    s AS (SELECT l.axis, l.level, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_samp(x1) AS d1, stddev_samp(x2) AS d2,
        corr(x1, x2) AS r, covar_samp(x1, y) AS c1, covar_samp(x2, y) AS c2
      FROM l JOIN a ON a.axis = l.axis AND a.level <> l.level GROUP BY 1, 2),
    -- the two standardised slopes by Cramer's rule, with a penalty of 1
    f AS (SELECT *, n - 1 + 1.0::DOUBLE AS p, (n - 1) * r AS o, (n - 1) * c1 / d1 AS b1, (n - 1) * c2 / d2 AS b2 FROM s),
    g AS (SELECT *, (b1 * p - b2 * o) / (p * p - o * o) / d1 AS s1, (b2 * p - b1 * o) / (p * p - o * o) / d2 AS s2 FROM f),
    e AS (SELECT a.axis, a.level, g.n, greatest(0.001::DOUBLE, least(0.999::DOUBLE, my + s1 * (x1 - m1) + s2 * (x2 - m2))) - y AS e, abs(my - y) AS b
      FROM a JOIN g ON a.axis = g.axis AND a.level = g.level)
    SELECT axis, level, CAST(n AS BIGINT) AS train_count, CAST(count(*) AS BIGINT) AS test_count, round(avg(abs(e)), 6) AS q_mae, round(sqrt(avg(e * e)), 6) AS q_rmse,
      round(avg(e), 6) AS q_bias, round(avg(b), 6) AS fixed_mae FROM e GROUP BY 1, 2, 3""",
)
def heldout_levels(spark, sf_dir):
    """Leave one level out, for every frequency band and every brand: all fits from one pass of moments."""
    axes = {"frequency_band": F.floor(F.col("campaign_frequency_hz") / 10), "campaign_brand": F.col("campaign_brand")}
    return rounded(st.holdout_study(signal(spark, sf_dir), axes, PREDICTORS, "q_target"))


# --- deliveries as streams ------------------------------------------------------------------------------------


def _scratch(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(
    "stream_deficits",
    "ST2 ST1",
    f"""WITH {DEFICITS_SQL}
    SELECT cell_key, example_count, independent_run_count, independent_condition_count, example_deficit, independent_run_deficit,
      independent_condition_deficit, coverage_complete, round(deficit_score, 6) AS deficit_score FROM deficits""",
)
def stream_deficits(spark, sf_dir):
    """The patch table in three deliveries, the third with all rows of the first again, each to a restarted stream."""
    folder = _scratch(spark, "deliveries")
    columns = ["campaign_run_id", "campaign_condition_id", "coverage_valid", "coverage_cell_key"]
    # the example ids of the given table repeat, so a row gets a key of its own, once
    rows = assigned(spark, sf_dir).select(F.monotonically_increasing_id().alias("example_key"), *columns)
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    part = F.pmod(F.xxhash64("example_key"), F.lit(3))
    for wanted in ([0], [1], [2, 0]):
        rows.where(part.isin(wanted)).write.mode("append").parquet(f"{folder}/arrived")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/arrived")
        items = {"example": "example_key", "independent_run": "campaign_run_id", "independent_condition": "campaign_condition_id"}
        inc.write_batches(inc.coverage_counts_stream(stream, items), f"{folder}/counts", f"{folder}/state").awaitTermination()
    counts = inc.latest_counts(spark.read.parquet(f"{folder}/counts"))
    return rounded(inc.deficits_of_counts(counts, GRID, **MINIMA).drop(*cov.BINS, *[c for c in cov.LABELS]).select(
        "cell_key", "example_count", "independent_run_count", "independent_condition_count", "example_deficit", "independent_run_deficit",
        "independent_condition_deficit", "coverage_complete", "deficit_score",
    ))


@query(
    "stream_ledger",
    "ST1",
    """SELECT o_orderstatus AS status, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS run_count, CAST(count(DISTINCT o_custkey) AS BIGINT) AS condition_count
    FROM orders GROUP BY 1""",
)
def stream_ledger(spark, sf_dir):
    """A run ledger in two deliveries with all runs of the first again: every run is taken once."""
    folder = _scratch(spark, "ledger")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("condition_id"), F.col("o_orderstatus").alias("status"))
    for wanted in ("run_id % 2 = 0", "true"):
        runs.where(wanted).write.mode("append").parquet(f"{folder}/arrived")
        stream = spark.readStream.schema(runs.schema).parquet(f"{folder}/arrived")
        inc.write_batches(inc.ledger_once(stream), f"{folder}/ledger", f"{folder}/state", mode="append").awaitTermination()
    taken = spark.read.parquet(f"{folder}/ledger")
    return cov.distinct_counts(taken, ["status"], {"condition_count": "condition_id"}, "run_count")


# --- risk mask and gates --------------------------------------------------------------------------------------

_FOLDED_SQL = f"""{PREDICTIONS_SQL},
rows_ AS (SELECT *, CASE WHEN partition = 'train' THEN CAST(campaign_run_id AS BIGINT) % 5 END AS cv_fold,
    CAST(floor(ln(cs_pred_m_s) * 4) AS BIGINT) AS speed_band, CAST(floor(campaign_frequency_hz / 10) AS BIGINT) AS frequency_band,
    row_number() OVER () AS row_key FROM predictions WHERE cs_pred_m_s > 0)"""


def _folded(spark, sf_dir) -> DataFrame:
    """Predictions with the training rows' fold (by run, so that no run is in two) and two feature bands."""
    rows = predictions(spark, sf_dir).where("cs_pred_m_s > 0")
    return rows.withColumns({
        "cv_fold": F.when(F.col("partition") == "train", F.col("campaign_run_id").cast("long") % 5),
        "speed_band": F.floor(F.log("cs_pred_m_s") * 4),
        "frequency_band": F.floor(F.col("campaign_frequency_hz") / 10),
    })


_RISK_SQL = f"""{_FOLDED_SQL},
h AS (SELECT *, CAST(cs_absolute_error_percent > 20 AS INTEGER) AS high FROM rows_),
c AS (SELECT speed_band, frequency_band, sum(high) AS s, count(*) AS n FROM h WHERE cv_fold IS NOT NULL GROUP BY ALL),
f AS (SELECT speed_band, frequency_band, cv_fold, sum(high) AS fs, count(*) AS fn FROM h WHERE cv_fold IS NOT NULL GROUP BY ALL),
t AS (SELECT sum(s) / CAST(sum(n) AS DOUBLE) AS m FROM c),
risk AS (SELECT partition, cs_absolute_error_percent AS err, high,
    (coalesce(s, 0) - coalesce(fs, 0) + 20.0::DOUBLE * m) / (coalesce(n, 0) - coalesce(fn, 0) + 20.0::DOUBLE) AS risk
  FROM h LEFT JOIN c USING (speed_band, frequency_band) LEFT JOIN f USING (speed_band, frequency_band, cv_fold), t)"""

THRESHOLDS = [0.2, 0.5, 0.8]
EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def _risk(spark, sf_dir) -> DataFrame:
    rows = _folded(spark, sf_dir).withColumn("high", (F.col("cs_absolute_error_percent") > 20).cast("int"))
    return rk.cell_means(rows, ["speed_band", "frequency_band"], {"risk": "high"})


@query(
    "risk_thresholds",
    "M22",
    f"""WITH {_RISK_SQL}, x AS (SELECT *, risk >= risk_threshold AS low FROM risk, (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) AS v(risk_threshold))
    SELECT partition, risk_threshold, CAST(count(*) AS BIGINT) AS "N", round(100.0::DOUBLE * avg(CAST(low AS INTEGER)), 6) AS low_confidence_pct,
      round(avg(err) FILTER (NOT low), 6) AS MAPE_high_confidence, round(avg(err) FILTER (low), 6) AS MAPE_low_confidence,
      round(100.0::DOUBLE * avg(high) FILTER (NOT low), 6) AS high20_rate_high_confidence, round(100.0::DOUBLE * avg(high) FILTER (low), 6) AS precision_high20_pct,
      round(100.0::DOUBLE * sum(high) FILTER (low) / sum(high), 6) AS recall_high20_pct FROM x GROUP BY 1, 2""",
)
def risk_thresholds(spark, sf_dir):
    counts = rk.risk_counts(_risk(spark, sf_dir), "partition", "risk", "cs_absolute_error_percent")
    return rounded(rk.risk_thresholds(counts, "partition", "risk", THRESHOLDS))


@query(
    "risk_calibration",
    "M22",
    f"""WITH {_RISK_SQL} SELECT partition, CASE WHEN risk >= 0.8 THEN 0.8::DOUBLE WHEN risk >= 0.6 THEN 0.6::DOUBLE WHEN risk >= 0.4 THEN 0.4::DOUBLE
        WHEN risk >= 0.2 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS risk_bin_low, CAST(count(*) AS BIGINT) AS "N", round(avg(risk), 6) AS mean_predicted_risk,
      round(100.0::DOUBLE * avg(high), 6) AS observed_high20_rate_pct, round(avg(err), 6) AS MAPE_pct FROM risk GROUP BY 1, 2""",
)
def risk_calibration(spark, sf_dir):
    counts = rk.risk_counts(_risk(spark, sf_dir), "partition", "risk", "cs_absolute_error_percent")
    return rounded(rk.risk_calibration(counts, "partition", "risk", EDGES))


@query(
    "risk_areas",
    "M22",
    f"""WITH {_RISK_SQL}, r AS (SELECT partition, high, rank() OVER (PARTITION BY partition ORDER BY risk) + (count(*) OVER (PARTITION BY partition, risk) - 1) / 2.0::DOUBLE AS k FROM risk)
    SELECT partition, CAST(sum(high) AS BIGINT) AS positives, CAST(sum(1 - high) AS BIGINT) AS negatives,
      round((sum(k) FILTER (high = 1) - sum(high) * (sum(high) + 1) / 2.0::DOUBLE) / (CAST(sum(high) AS DOUBLE) * sum(1 - high)), 6) AS roc_auc FROM r GROUP BY 1""",
)
def risk_areas(spark, sf_dir):
    return rounded(rk.risk_areas(_risk(spark, sf_dir), "partition", "risk", "cs_absolute_error_percent").select("partition", "positives", "negatives", "roc_auc"))


GAINS, HARMS = [0.0, 1.0, 2.0, 5.0], [0.1, 0.2, 0.35, 0.5]

_GATE_SQL = f"""{_FOLDED_SQL},
e AS (SELECT *, 100.0::DOUBLE * abs(cs_pred_m_s - cs_true_m_s) / cs_true_m_s AS base_error FROM rows_),
k AS (SELECT *, 'lift' AS candidate, 100.0::DOUBLE * abs(1.25::DOUBLE * cs_pred_m_s - cs_true_m_s) / cs_true_m_s AS candidate_error FROM e
  UNION ALL SELECT *, 'lower', 100.0::DOUBLE * abs(0.8::DOUBLE * cs_pred_m_s - cs_true_m_s) / cs_true_m_s FROM e),
g AS (SELECT *, base_error - candidate_error AS gain, CAST(candidate_error > base_error + 0.5::DOUBLE AS INTEGER) AS harm FROM k),
c AS (SELECT candidate, speed_band, frequency_band, sum(gain) AS gs, sum(harm) AS hs, count(*) AS n FROM g WHERE cv_fold IS NOT NULL GROUP BY ALL),
f AS (SELECT candidate, speed_band, frequency_band, cv_fold, sum(gain) AS fgs, sum(harm) AS fhs, count(*) AS fn FROM g WHERE cv_fold IS NOT NULL GROUP BY ALL),
t AS (SELECT sum(gs) / sum(n) AS gm, sum(hs) / CAST(sum(n) AS DOUBLE) AS hm FROM c),
scored AS (SELECT g.*, (coalesce(gs, 0) - coalesce(fgs, 0) + 20.0::DOUBLE * gm) / (coalesce(n, 0) - coalesce(fn, 0) + 20.0::DOUBLE) AS eg,
    (coalesce(hs, 0) - coalesce(fhs, 0) + 20.0::DOUBLE * hm) / (coalesce(n, 0) - coalesce(fn, 0) + 20.0::DOUBLE) AS hp
  FROM g LEFT JOIN c USING (candidate, speed_band, frequency_band) LEFT JOIN f USING (candidate, speed_band, frequency_band, cv_fold), t),
tried AS (SELECT candidate, min_gain, max_harm, count(*) AS accepted, sum(gain) AS total_gain, 100.0::DOUBLE * sum(harm) / count(*) AS harm_pct
  FROM scored, (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE)) AS a(min_gain), (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.35::DOUBLE), (0.5::DOUBLE)) AS b(max_harm)
  WHERE cv_fold IS NOT NULL AND eg >= min_gain AND hp <= max_harm GROUP BY ALL HAVING 100.0::DOUBLE * sum(harm) / count(*) <= 25),
choice AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY round(total_gain, 6) DESC, min_gain DESC, max_harm) = 1)"""


def _scored_candidates(spark, sf_dir) -> DataFrame:
    # rows get a key once: the table's example ids repeat
    used = ["partition", "cv_fold", "speed_band", "frequency_band", "cs_true_m_s", "cs_pred_m_s"]
    rows = stored(_folded(spark, sf_dir).select(*used, F.monotonically_increasing_id().alias("row_key")))
    speed = F.col("cs_pred_m_s")
    pool = rk.candidate_rows(rows, {"lift": 1.25 * speed, "lower": 0.8 * speed}, "cs_true_m_s", "cs_pred_m_s", harm_margin=0.5)
    return stored(rk.cell_means(pool, ["candidate", "speed_band", "frequency_band"], {"expected_gain": "gain", "harm_probability": "harm"}))


@query(
    "gate_thresholds",
    "M12",
    f"""WITH {_GATE_SQL} SELECT candidate, min_gain, max_harm, CAST(accepted AS BIGINT) AS accepted, round(total_gain, 3) AS total_gain, round(harm_pct, 6) AS harm_pct FROM choice""",
)
def gate_thresholds(spark, sf_dir):
    """Thresholds on learned gain and harm, chosen on the joint counts of out-of-fold scores under a harm limit."""
    return rounded(rk.gate_choice(_scored_candidates(spark, sf_dir), GAINS, HARMS, most_harm_pct=25.0), total_gain=3)


@query(
    "gated_corrections",
    "M12 G50",
    f"""WITH {_GATE_SQL}, b AS (SELECT row_key, partition, any_value(base_error) AS base_error,
        max({{'score': eg - 10.0::DOUBLE * hp, 'candidate': s.candidate, 'e': candidate_error, 'h': harm}}) FILTER (eg >= min_gain AND hp <= max_harm) AS best
      FROM scored s LEFT JOIN choice c ON s.candidate = c.candidate GROUP BY 1, 2)
    SELECT partition, coalesce(best.candidate, 'base') AS chosen, CAST(count(*) AS BIGINT) AS "N", round(avg(base_error), 6) AS base_mape,
      round(avg(coalesce(best.e, base_error)), 6) AS gated_mape, round(100.0::DOUBLE * avg(coalesce(best.h, 0)), 6) AS harmed_pct FROM b GROUP BY 1, 2""",
)
def gated_corrections(spark, sf_dir):
    scored = _scored_candidates(spark, sf_dir)
    choice = rk.gate_choice(scored, GAINS, HARMS, most_harm_pct=25.0)
    out = rk.gated(scored, choice, ["row_key", "partition"], harm_penalty=10.0)
    return rounded(out.groupBy("partition", "chosen").agg(
        F.count(F.lit(1)).alias("N"), F.avg("base_error").alias("base_mape"), F.avg("chosen_error").alias("gated_mape"), (100 * F.avg("harmed")).alias("harmed_pct"),
    ))


# --- centres from pixels --------------------------------------------------------------------------------------

WINDOW, STEP = 7, 2
_MAP_GRID = cov.CoverageGrid(
    sws_edges=(1.5, 2.5, 3.5, 4.5), frequency_edges=(100, 300, 600), purity_edges=(0.5, 0.6, 0.7, 1.0), diffusivity_edges=(0, 1), pairs_m=((5e-4, 5e-4),),
)

#: Maps of 64 columns, a vector a row: the sign of a component is the material, its size the speed.
_MAP_SQL = """image AS (SELECT CAST(vec_id // 64 AS BIGINT) AS sample_id, CAST(vec_id % 64 AS INTEGER) AS iz, CAST(i - 1 AS INTEGER) AS ix,
    embedding[i]::DOUBLE AS v, label FROM embeddings, range(1, 65) t(i)),
pixels AS (SELECT sample_id, iz, ix, 1.5::DOUBLE + 3.0::DOUBLE * (1 - exp(-abs(v))) AS cs_true, CASE WHEN v > 0 THEN 1 ELSE 2 END AS material_id, abs(v) > 0.004::DOUBLE AS valid FROM image),
bounds AS (SELECT sample_id, min(iz) AS z0, max(iz) AS z1, min(ix) AS x0, max(ix) AS x1 FROM pixels GROUP BY 1),
centres AS (SELECT sample_id, iz AS cz, ix AS cx, cs_true FROM pixels JOIN bounds USING (sample_id)
  WHERE iz BETWEEN z0 + 3 AND z1 - 3 AND ix BETWEEN x0 + 3 AND x1 - 3 AND (iz - z0 - 3) % 2 = 0 AND (ix - x0 - 3) % 2 = 0),
near AS (SELECT c.sample_id, c.cz, c.cx, any_value(c.cs_true) AS cs, count(*) FILTER (p.valid) AS n, count(*) FILTER (p.valid AND material_id = 1) AS a
  FROM centres c JOIN pixels p ON p.sample_id = c.sample_id AND p.iz BETWEEN c.cz - 3 AND c.cz + 3 AND p.ix BETWEEN c.cx - 3 AND c.cx + 3 GROUP BY ALL),
windows AS (SELECT *, n / 49.0::DOUBLE AS valid_fraction, CASE WHEN n > 0 THEN greatest(a, n - a) / CAST(n AS DOUBLE) END AS purity FROM near)"""


def map_pixels(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    cells = rows.select(F.floor(F.col("vec_id") / 64).alias("sample_id"), (F.col("vec_id") % 64).cast("int").alias("iz"), F.posexplode("embedding").alias("ix", "v"))
    v = F.col("v").cast("double")
    return cells.select(
        "sample_id", "iz", "ix", (F.lit(1.5) + F.lit(3.0) * (1 - F.exp(-F.abs(v)))).alias("cs_true"),
        F.when(v > 0, 1).otherwise(2).alias("material_id"), (F.abs(v) > 0.004).alias("valid"),
    )


@query(
    "window_truth",
    "T7 K2",
    f"""WITH {_MAP_SQL} SELECT sample_id, cz, cx, round(cs, 6) AS truth_cs_center_m_s, round(valid_fraction, 6) AS truth_valid_fraction,
      round(purity, 6) AS truth_material_purity FROM windows""",
)
def window_truth(spark, sf_dir):
    """Speed, valid fraction and purity of every candidate window, from summed-area tables on tiles with a rim."""
    return rounded(tl.window_truth(map_pixels(spark, sf_dir), WINDOW, step=STEP, tile=24))


@query(
    "center_outcomes",
    "T7 T8",
    f"""WITH {_MAP_SQL}, o AS (SELECT sample_id, CASE WHEN NOT (cs BETWEEN 1.5 AND 4.5 AND purity BETWEEN 0.5 AND 1.0) OR purity IS NULL THEN 'out_of_range'
        WHEN valid_fraction < 0.95::DOUBLE THEN 'too_few_valid' ELSE 'eligible' END AS outcome,
        CASE WHEN cs < 2.5 THEN 1 WHEN cs < 3.5 THEN 2 ELSE 3 END AS s, CASE WHEN purity < 0.6::DOUBLE THEN 1 WHEN purity < 0.7::DOUBLE THEN 2 ELSE 3 END AS p FROM windows)
    SELECT sample_id, outcome, CASE WHEN outcome <> 'out_of_range' THEN format('s{{:02d}}_f01_p{{:02d}}_d01_g01', s, p) ELSE 'out_of_range' END AS cell_key,
      CAST(count(*) AS BIGINT) AS candidate_count FROM o GROUP BY ALL""",
)
def center_outcomes(spark, sf_dir):
    """What becomes of the candidates of every map, by coverage cell; the counts add up to the candidates."""
    windows = tl.window_truth(map_pixels(spark, sf_dir), WINDOW, step=STEP, tile=24)
    constant = {"campaign_frequency_hz": 200.0, "campaign_angular_entropy": 0.5, "GRID_dx_m": 5e-4, "GRID_dz_m": 5e-4}
    windows = windows.withColumns({c: F.lit(v) for c, v in constant.items()})
    found = tl.center_candidates(windows, _MAP_GRID, minimum_valid=0.95)
    return found.groupBy("sample_id", "outcome", F.col("coverage_cell_key").alias("cell_key")).agg(F.count(F.lit(1)).alias("candidate_count"))
