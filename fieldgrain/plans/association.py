"""Association, trend and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgrain.operators import association as ac, metrics as m
from fieldgrain.plans.catalog import query, r, rounded
from fieldgrain.plans.frames import EXAMPLES_SQL, PREDICTIONS_SQL, SCORES_SQL, examples, predictions, scores
from fieldgrain.plans.sqltext import pct_cte, rnd, spearman_cte

P, E, SC = PREDICTIONS_SQL, EXAMPLES_SQL, SCORES_SQL
FEATURES = ["campaign_frequency_hz", "campaign_direction_count", "campaign_size"]
_LONG = f"""long AS (UNPIVOT (SELECT model_id, partition, q_pred AS y, campaign_frequency_hz::DOUBLE AS campaign_frequency_hz,
    campaign_direction_count::DOUBLE AS campaign_direction_count, campaign_size::DOUBLE AS campaign_size FROM predictions)
  ON {', '.join(FEATURES)} INTO NAME feature_name VALUE x)"""
_BY = ["model_id", "partition", "feature_name"]

_KENDALL = """kt AS (SELECT a.model_id, a.partition, a.feature_name,
    sum(CAST(sign((a.x - b.x)) * sign(a.y - b.y) AS DOUBLE) * a.n * b.n) / 2 AS s
  FROM cells a JOIN cells b ON a.model_id = b.model_id AND a.partition = b.partition AND a.feature_name = b.feature_name
  GROUP BY 1, 2, 3),
 tx AS (SELECT model_id, partition, feature_name, sum(c * (c - 1) / 2.0::DOUBLE) AS tx FROM
   (SELECT model_id, partition, feature_name, x, sum(n) AS c FROM cells GROUP BY ALL) GROUP BY ALL),
 ty AS (SELECT model_id, partition, feature_name, sum(c * (c - 1) / 2.0::DOUBLE) AS ty, sum(c) AS n FROM
   (SELECT model_id, partition, feature_name, y, sum(n) AS c FROM cells GROUP BY ALL) GROUP BY ALL)"""


@query(
    "association",
    "G25 W5",
    f"""WITH {P}, {_LONG}, {spearman_cte('sp', 'long', _BY, 'x', 'y')},
    cells AS (SELECT model_id, partition, feature_name, x, y, count(*) AS n FROM long GROUP BY ALL), {_KENDALL},
    b AS (SELECT model_id, partition, feature_name, CAST(count(*) AS BIGINT) AS n_valid, min(x) AS feature_min, max(x) AS feature_max,
      round(avg(x), 6) AS feature_mean, round(stddev_samp(x), 6) AS feature_std, round(min(y), 6) AS q_min,
      round(max(y), 6) AS q_max, round(avg(y), 6) AS q_mean, round(stddev_samp(y), 6) AS q_std,
      round(corr(x, y), 8) AS pearson_r, round(regr_slope(y, x), 8) AS linear_slope,
      round(regr_intercept(y, x), 8) AS linear_intercept, round(regr_r2(y, x), 8) AS linear_R2,
      round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*)), 8) AS linear_RMSE FROM long GROUP BY ALL)
    SELECT b.*, round(spearman, 8) AS spearman_rho, round(s / (sqrt(n * (n - 1) / 2.0::DOUBLE - tx) * sqrt(n * (n - 1) / 2.0::DOUBLE - ty)), 8) AS kendall_tau
    FROM b JOIN sp USING (model_id, partition, feature_name) JOIN kt USING (model_id, partition, feature_name)
      JOIN tx USING (model_id, partition, feature_name) JOIN ty USING (model_id, partition, feature_name)""",
)
def association(spark, sf_dir):
    out = ac.association(predictions(spark, sf_dir), ["model_id", "partition"], FEATURES, "q_pred")
    fine = ("pearson_r", "linear_slope", "linear_intercept", "linear_R2", "linear_RMSE", "spearman_rho", "kendall_tau")
    return rounded(out, **{c: 8 for c in fine})


@query(
    "binned_trend",
    "G26",
    f"""WITH {P}, l AS (UNPIVOT (SELECT model_id, example_id, q_pred AS y, campaign_frequency_hz::DOUBLE AS campaign_frequency_hz,
      campaign_size::DOUBLE AS campaign_size FROM predictions) ON campaign_frequency_hz, campaign_size INTO NAME feature_name VALUE x),
    b AS (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY model_id, feature_name ORDER BY x, md5('0:' || example_id)) * 10
      / CAST(count(*) OVER (PARTITION BY model_id, feature_name) AS DOUBLE)) AS INTEGER) AS bin_number FROM l)
    SELECT model_id, feature_name, bin_number, CAST(count(*) AS BIGINT) AS n_bin, round(avg(x), 6) AS feature_mean,
      min(x) AS feature_min, max(x) AS feature_max, round(avg(y), 6) AS q_mean, round(stddev_samp(y), 6) AS q_std,
      round(min(y), 6) AS q_min, round(max(y), 6) AS q_max, round(median(x), 6) AS feature_median, round(median(y), 6) AS q_median
    FROM b GROUP BY 1, 2, 3""",
)
def binned_trend(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    features = ["campaign_frequency_hz", "campaign_size"]
    return rounded(ac.binned_trend(rows, ["model_id"], features, "q_pred", 10, tie=["example_id"], few_groups=True))  # few models


@query(
    "binned_trend_width",
    "G26",
    f"""WITH {P}, g AS (SELECT *, min(cs_pred_m_s) OVER (PARTITION BY model_id) AS lo, max(cs_pred_m_s) OVER (PARTITION BY model_id) AS hi FROM predictions),
    b AS (SELECT model_id, cs_pred_m_s AS x, q_pred AS y, CAST(least(floor((cs_pred_m_s - lo) / (hi - lo) * 8) + 1, 8) AS INTEGER) AS bin_number FROM g)
    SELECT model_id, 'cs_pred_m_s' AS feature_name, bin_number, CAST(count(*) AS BIGINT) AS n_bin, round(avg(x), 5) AS feature_mean,
      round(min(x), 5) AS feature_min, round(max(x), 5) AS feature_max, round(avg(y), 5) AS q_mean, round(stddev_samp(y), 5) AS q_std,
      round(min(y), 5) AS q_min, round(max(y), 5) AS q_max, round(median(x), 5) AS feature_median, round(median(y), 5) AS q_median
    FROM b GROUP BY 1, 2, 3""",
)
def binned_trend_width(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rounded(ac.binned_trend(rows, ["model_id"], ["cs_pred_m_s"], "q_pred", 8, "equal_width", few_groups=True), 5)  # few models


@query(
    "evidence",
    "G27",
    f"""WITH {P}, long AS (UNPIVOT (SELECT campaign_brand, cs_pred_m_s AS y, campaign_frequency_hz::DOUBLE AS campaign_frequency_hz,
      cs_true_m_s, truth_material_purity FROM predictions) ON campaign_frequency_hz, cs_true_m_s, truth_material_purity INTO NAME feature_name VALUE x),
    {spearman_cte('sp', 'long', ['campaign_brand', 'feature_name'], 'x', 'y')},
    r2 AS (SELECT campaign_brand, feature_name, regr_r2(y, x) AS r2 FROM long GROUP BY 1, 2),
    g AS (SELECT feature_name, CAST(count(*) AS BIGINT) AS n_groups, median(spearman) AS ms, median(abs(spearman)) AS ma, avg(spearman) AS av,
      avg(abs(spearman)) AS aa, median(r2) AS mr,
      avg((abs(spearman) >= 0.3::DOUBLE)::INT::DOUBLE) AS fw, avg((abs(spearman) >= 0.5::DOUBLE)::INT::DOUBLE) AS fm,
      avg((abs(spearman) >= 0.7::DOUBLE)::INT::DOUBLE) AS fs, avg((spearman > 0)::INT::DOUBLE) AS fp, avg((spearman < 0)::INT::DOUBLE) AS fn
      FROM sp JOIN r2 USING (campaign_brand, feature_name) GROUP BY 1)
    SELECT feature_name, n_groups AS n_total_groups, n_groups AS n_valid_groups, round(ms, 6) AS median_spearman,
      round(ma, 6) AS median_abs_spearman, round(av, 6) AS mean_spearman, round(aa, 6) AS mean_abs_spearman, round(mr, 6) AS median_linear_R2,
      round(fw, 6) AS frac_weak_or_better, round(fm, 6) AS frac_moderate_or_better, round(fs, 6) AS frac_strong,
      round(fp, 6) AS frac_positive, round(fn, 6) AS frac_negative, round(greatest(fp, fn), 6) AS direction_consistency,
      CASE WHEN fp >= fn THEN 'positive' ELSE 'negative' END AS dominant_direction,
      round(ma * fm * greatest(fp, fn), 6) AS evidence_score,
      CASE WHEN n_groups < 4 THEN 'NO: insufficient groups'
        WHEN ma >= 0.7::DOUBLE AND fs >= 0.5::DOUBLE AND greatest(fp, fn) >= 0.8::DOUBLE THEN 'YES: strong consistent association'
        WHEN ma >= 0.5::DOUBLE AND fm >= 0.6::DOUBLE AND greatest(fp, fn) >= 0.75::DOUBLE THEN 'YES: moderate consistent association'
        WHEN ma >= 0.3::DOUBLE AND fw >= 0.5::DOUBLE THEN 'MAYBE: weak or mixed association'
        ELSE 'NO: no consistent association' END AS summary_decision FROM g""",
)
def evidence(spark, sf_dir):
    features = ["campaign_frequency_hz", "cs_true_m_s", "truth_material_purity"]
    assoc = ac.association(predictions(spark, sf_dir), ["campaign_brand"], features, "cs_pred_m_s", with_kendall=False)
    return rounded(ac.evidence(assoc))


def _mi_sql(source: str, feature: str, extra: str) -> str:
    points = {f"e{i}": i / 8 for i in range(1, 8)}
    edge = lambda v, p: " + ".join(f"CASE WHEN {v} >= {p}.e{i} AND ({p}.e{i} IS DISTINCT FROM {p}.e{i - 1 if i > 1 else 'none'}) THEN 1 ELSE 0 END" for i in range(1, 8))
    return f"""{pct_cte('ex', source, [], feature, points)}, {pct_cte('ey', source, [], 'cs_pred_m_s', points)},
      j AS (SELECT {edge(feature, 'ex')} AS xb, {edge('cs_pred_m_s', 'ey')} AS yb, count(*) AS n FROM {source}
        CROSS JOIN (SELECT *, NULL::DOUBLE AS enone FROM ex) ex CROSS JOIN (SELECT *, NULL::DOUBLE AS enone FROM ey) ey GROUP BY 1, 2),
      t AS (SELECT *, sum(n) OVER (PARTITION BY xb) AS nx, sum(n) OVER (PARTITION BY yb) AS ny, sum(n) OVER () AS tt FROM j)
      SELECT {extra} CAST(any_value(tt) AS BIGINT) AS N, round(sum(n / tt * ln(n * tt / (nx * ny)::DOUBLE)), 6) AS mutual_information FROM t"""


@query(
    "mutual_information",
    "G28 P31",
    f"WITH {P}, {_mi_sql('predictions', 'campaign_frequency_hz', chr(39) + 'campaign_frequency_hz' + chr(39) + ' AS feature_name,')}",
)
def mutual_information(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rounded(ac.mutual_information(rows, [], ["campaign_frequency_hz"], "cs_pred_m_s", 8))


_VALID_SPEED = "(SELECT * FROM predictions WHERE sws_valid)"


@query(
    "quantile_labels",
    "P31 P27",
    f"""WITH {P}, {pct_cte('edges', _VALID_SPEED, [], 'cs_pred_m_s', {'ea': .25, 'eb': .5, 'ec': .75})}
    SELECT CASE WHEN NOT sws_valid THEN 'unknown' WHEN cs_pred_m_s < ea THEN 'Q1' WHEN cs_pred_m_s < eb THEN 'Q2'
        WHEN cs_pred_m_s < ec THEN 'Q3' ELSE 'Q4' END AS speed_label, CAST(count(*) AS BIGINT) AS N
    FROM predictions, edges GROUP BY 1""",
)
def quantile_labels(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(F.when(F.col("sws_valid"), F.col("cs_pred_m_s")).alias("v"))
    placed = ac.quantile_bin(rows, [], "v", 4, "_b")
    return placed.groupBy(ac.quantile_label(F.col("_b"), 4).alias("speed_label")).agg(F.count(F.lit(1)).alias("N"))


@query(
    "feature_audit",
    "G51 G61",
    f"""WITH {P}, f AS (SELECT nullif(campaign_frequency_hz, 7)::DOUBLE AS x, cs_pred_m_s FROM predictions),
    {spearman_cte('sp', 'f', [], 'x', 'cs_pred_m_s')}, ok AS (SELECT x AS fx, cs_pred_m_s FROM f WHERE x IS NOT NULL),
    mi AS (WITH {_mi_sql('ok', 'fx', '')})
    SELECT 'feature' AS feature_name, CAST(count(DISTINCT x) AS BIGINT) AS distinct_values,
      round(100.0::DOUBLE * count(*) FILTER (x IS NULL) / count(*), 6) AS missing_pct,
      round(any_value(spearman), 6) AS spearman_rho, round(any_value(mutual_information), 6) AS mutual_information FROM f, sp, mi""",
)
def feature_audit(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(
        F.nullif(F.col("campaign_frequency_hz"), F.lit(7.0)).alias("feature"), "cs_pred_m_s"
    )
    return rounded(ac.feature_audit(rows, ["feature"], "cs_pred_m_s", 8))


@query(
    "correlation_rank",
    "G53",
    f"""WITH {P}, l AS (UNPIVOT (SELECT cs_absolute_error_percent AS y, campaign_frequency_hz::DOUBLE AS campaign_frequency_hz,
        campaign_size::DOUBLE AS campaign_size, cs_true_m_s, truth_material_purity FROM predictions)
      ON campaign_frequency_hz, campaign_size, cs_true_m_s, truth_material_purity INTO NAME feature_name VALUE x)
    SELECT feature_name, CAST(count(*) AS BIGINT) AS N, round(corr(x, y), 8) AS pearson_r, round(abs(corr(x, y)), 8) AS abs_r
    FROM l GROUP BY 1""",
)
def correlation_rank(spark, sf_dir):
    features = ["campaign_frequency_hz", "campaign_size", "cs_true_m_s", "truth_material_purity"]
    return rounded(ac.correlation_ranking(predictions(spark, sf_dir), features, "cs_absolute_error_percent"), 8)


_STEP = f"""WITH {E}, sx AS (SELECT *, truth_cs_center_m_s * 0.7320508075688772::DOUBLE AS speed FROM examples), {pct_cte('pa', 'sx', ['campaign_condition_id', 'patch_idx'], 'speed', {'med': .5})},
  st AS (SELECT campaign_condition_id, patch_idx, count(*) AS n, avg(speed) AS mean, stddev_samp(speed) AS std,
    min(speed) AS lo, max(speed) AS hi FROM sx GROUP BY 1, 2)"""


def _speeds(spark, sf_dir):
    return examples(spark, sf_dir).withColumn("speed", F.col("truth_cs_center_m_s") * F.lit(0.7320508075688772))


@query(
    "step_summary",
    "G21 G23",
    f"""{_STEP} SELECT campaign_condition_id, patch_idx, CAST(n AS BIGINT) AS n_rows, round(mean, 4) AS speed_mean,
      round(CASE WHEN n > 1 THEN std END, 4) AS speed_std, round(lo, 4) AS speed_min, round(hi, 4) AS speed_max,
      round(med, 4) AS speed_median FROM st JOIN pa USING (campaign_condition_id, patch_idx)""",
)
def step_summary(spark, sf_dir):
    keys = ["campaign_condition_id", "patch_idx"]
    return rounded(ac.step_summary(_speeds(spark, sf_dir), keys, ["speed"]), 4)


@query(
    "condition_summary",
    "G22",
    f"""{_STEP} SELECT campaign_condition_id, CAST(count(*) AS BIGINT) AS n_steps, round(avg(mean), 4) AS speed_mean_over_steps,
      round(CASE WHEN count(*) > 1 THEN stddev_samp(mean) END, 4) AS speed_std_over_steps,
      round(CASE WHEN count(*) > 1 THEN regr_slope(mean, patch_idx) END, 4) AS speed_slope,
      round(CASE WHEN count(*) > 1 THEN regr_r2(mean, patch_idx) END, 6) AS speed_r2 FROM st GROUP BY 1""",
)
def condition_summary(spark, sf_dir):
    columns = ["speed"]
    steps = ac.step_summary(_speeds(spark, sf_dir), ["campaign_condition_id", "patch_idx"], columns)
    out = ac.condition_summary(steps, ["campaign_condition_id"], "patch_idx", columns)
    return rounded(out, 4, speed_r2=6)


# --- scores ----------------------------------------------------------------------------------------

_CUM = """cum AS (SELECT group_id, score, sum(p) OVER o AS tp, sum(f) OVER o AS fp, p, f, sum(p) OVER g AS pt, sum(f) OVER g AS ft
  FROM (SELECT group_id, score, sum(truth) AS p, sum(1 - truth) AS f FROM scores GROUP BY 1, 2)
  WINDOW o AS (PARTITION BY group_id ORDER BY score DESC), g AS (PARTITION BY group_id))"""
_AREAS = f"""{_CUM}, areas AS (SELECT group_id, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(f) AS BIGINT) AS negatives,
    sum(f / ft * (tp + tp - p) / (2 * pt)) AS roc_auc,
    sum(p / pt * (tp / (tp + fp) + CASE WHEN tp + fp = p + f THEN 1 ELSE (tp - p) / (tp - p + fp - f) END) / 2) AS pr_auc
  FROM (SELECT group_id, p::DOUBLE AS p, f::DOUBLE AS f, tp::DOUBLE AS tp, fp::DOUBLE AS fp, pt::DOUBLE AS pt, ft::DOUBLE AS ft FROM cum) GROUP BY 1)"""


@query(
    "roc_pr_auc",
    "W11",
    f"WITH {SC}, {_AREAS} SELECT group_id, positives, negatives, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM areas",
)
def roc_pr_auc(spark, sf_dir):
    return rounded(m.curve_areas(scores(spark, sf_dir), ["group_id"], "score", "truth"))


@query(
    "detector_metrics",
    "G49",
    f"""WITH {SC}, {_AREAS} SELECT group_id, CAST(count(*) AS BIGINT) AS N, round(100.0::DOUBLE * avg(truth), 6) AS positive_rate_pct,
      round(avg((score - truth) * (score - truth)), 6) AS brier_score, any_value(positives) AS positives, any_value(negatives) AS negatives,
      round(any_value(roc_auc), 6) AS roc_auc, round(any_value(pr_auc), 6) AS pr_auc FROM scores JOIN areas USING (group_id) GROUP BY 1""",
)
def detector_metrics(spark, sf_dir):
    return rounded(m.detector_metrics(scores(spark, sf_dir), ["group_id"], "score", "truth"))


@query(
    "calibration",
    "G33",
    f"""WITH {SC} SELECT group_id, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS N,
      round(avg(score), 6) AS mean_predicted, round(avg(truth), 6) AS observed_rate,
      round((least(floor(score * 10), 9) + 0.5::DOUBLE) / 10, 6) AS bin_center FROM scores GROUP BY 1, 2, 6""",
)
def calibration(spark, sf_dir):
    return rounded(m.calibration(scores(spark, sf_dir), ["group_id"], "score", "truth"))


@query(
    "threshold_table",
    "G34",
    f"""WITH {SC}, t AS (SELECT unnest([0.2, 0.5, 0.8]::DOUBLE[]) AS risk_threshold)
    SELECT group_id, risk_threshold, CAST(count(*) AS BIGINT) AS N,
      round(100.0::DOUBLE * count(*) FILTER (score >= risk_threshold) / count(*), 6) AS rejected_pct,
      round(100.0::DOUBLE * count(*) FILTER (score < risk_threshold) / count(*), 6) AS coverage_pct,
      round(avg(harm) FILTER (score < risk_threshold), 6) AS harm_rate_kept, round(avg(harm) FILTER (score >= risk_threshold), 6) AS harm_rate_rejected,
      round(100.0::DOUBLE * count(*) FILTER (score >= risk_threshold AND truth = 1) / greatest(sum(truth), 2.220446049250313e-16::DOUBLE), 6) AS recall_pct,
      round(100.0::DOUBLE * count(*) FILTER (score >= risk_threshold AND truth = 1)
        / greatest(count(*) FILTER (score >= risk_threshold), 2.220446049250313e-16::DOUBLE), 6) AS precision_pct
    FROM scores, t GROUP BY 1, 2""",
)
def threshold_table(spark, sf_dir):
    return rounded(
        m.threshold_table(scores(spark, sf_dir), ["group_id"], "score", "truth", (0.2, 0.5, 0.8), {"harm_rate": "harm"})
    )


@query(
    "accuracy_coverage",
    "W10",
    f"""WITH {SC}, rk AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score, md5('0:' || doc_id)) AS rn,
        count(*) OVER (PARTITION BY group_id) AS n FROM scores),
    t AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 1.0]::DOUBLE[]) AS coverage_fraction)
    SELECT group_id, coverage_fraction, CAST(count(*) AS BIGINT) AS N_kept, round(avg(truth), 6) AS truth_rate, round(avg(harm), 6) AS harm_rate,
      round(avg(score), 6) AS mean_risk FROM rk, t WHERE rn <= greatest(1, round(coverage_fraction * n)) GROUP BY 1, 2""",
)
def accuracy_coverage(spark, sf_dir):
    measures = {"truth_rate": "truth", "harm_rate": "harm", "mean_risk": "score"}
    fractions = (0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    return rounded(m.accuracy_coverage(scores(spark, sf_dir), ["group_id"], "score", ["doc_id"], fractions, measures))


@query(
    "class_balance",
    "M13",
    f"""WITH {SC}, g AS (SELECT group_id, avg(truth) AS p FROM scores GROUP BY 1)
    SELECT group_id, truth, CAST(count(*) AS BIGINT) AS N, round(any_value(CASE WHEN p <= 0 OR p >= 1 THEN 1.0::DOUBLE
      WHEN truth = 1 THEN 0.5::DOUBLE / p ELSE 0.5::DOUBLE / (1 - p) END), 6) AS weight FROM scores JOIN g USING (group_id) GROUP BY 1, 2""",
)
def class_balance(spark, sf_dir):
    from fieldgrain.operators.models import class_weights

    rows = class_weights(scores(spark, sf_dir), ["group_id"], "truth", "weight")
    return rounded(rows.groupBy("group_id", "truth").agg(F.count(F.lit(1)).alias("N"), F.max("weight").alias("weight")))
