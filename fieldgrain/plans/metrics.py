"""Prediction-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgrain.functions.semantics import bin_index
from fieldgrain.operators import metrics as m
from fieldgrain.plans.catalog import query, r, rounded
from fieldgrain.plans.frames import PREDICTIONS_SQL, predictions
from fieldgrain.plans.sqltext import pct_cte, rnd, spearman_cte

P = PREDICTIONS_SQL
APE = "cs_absolute_error_percent"
VALID = "valid_rows AS (SELECT *, q_pred - q_true AS q_error, abs(q_pred - q_true) AS q_ae FROM predictions WHERE sws_valid)"

SPEED_SQL = f"""round(avg(abs(cs_error_m_s)), 6) AS sws_mae_m_s,
  round(sqrt(avg(cs_error_m_s * cs_error_m_s)), 6) AS sws_rmse_m_s, round(avg(cs_error_m_s), 6) AS sws_bias_m_s,
  round(avg({APE}), 6) AS sws_mape, round(avg(cs_error_percent), 6) AS sws_bias_percent,
  round(100 * avg(CASE WHEN {APE} > 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS sws_error_gt5_pct,
  round(100 * avg(CASE WHEN {APE} > 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS sws_error_gt10_pct,
  round(100 * avg(CASE WHEN {APE} > 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS sws_error_gt20_pct,
  round(100 * avg(CASE WHEN cs_error_percent < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS sws_underestimate_pct"""
Q_SQL = """round(avg(q_ae), 6) AS q_mae, round(sqrt(avg(q_error * q_error)), 6) AS q_rmse,
  round(avg(q_error), 6) AS q_bias"""


def _speed_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""WITH {P}, {VALID},
    {pct_cte('pc', 'valid_rows', keys, APE, {'sws_median_ape': .5, 'sws_p90_ape': .9, 'sws_p95_ape': .95})},
    c AS (SELECT {k}, CAST(count(*) AS BIGINT) AS row_count,
      CAST(count(*) FILTER (WHERE sws_valid) AS BIGINT) AS valid_row_count FROM predictions GROUP BY {k}),
    e AS (SELECT {k}, {SPEED_SQL}, round(max({APE}), 6) AS sws_max_ape FROM valid_rows GROUP BY {k})
    SELECT c.*, e.* EXCLUDE ({k}), {rnd(['sws_median_ape', 'sws_p90_ape', 'sws_p95_ape'])}
    FROM c LEFT JOIN e USING ({k}) LEFT JOIN pc USING ({k})"""


@query(
    "metrics_quantile",
    "G6 N3",
    f"""WITH {P}, e AS (SELECT *, q_pred - q_true AS er, abs(q_pred - q_true) AS ae FROM predictions),
    {pct_cte('pc', 'e', ['model_id', 'partition'], 'ae', {'q_median_ae': .5})}
    SELECT model_id, partition, CAST(count(*) AS BIGINT) AS row_count, CAST(count(er) AS BIGINT) AS valid_row_count,
      round(avg(ae), 6) AS q_mae, round(sqrt(avg(er * er)), 6) AS q_rmse, round(avg(er), 6) AS q_bias,
      round(max(ae), 6) AS q_max_ae, round(any_value(q_median_ae), 6) AS q_median_ae
    FROM e JOIN pc USING (model_id, partition) GROUP BY model_id, partition""",
)
def metrics_quantile(spark, sf_dir):
    return rounded(m.quantile_metrics(predictions(spark, sf_dir), ["model_id", "partition"]))


@query("metrics_partition", "G7 N3 N1", _speed_sql(["model_id", "partition"]))
def metrics_partition(spark, sf_dir):
    return rounded(m.speed_metrics(predictions(spark, sf_dir), ["model_id", "partition"]))


@query("metrics_group", "G8", _speed_sql(["campaign_brand"]))
def metrics_group(spark, sf_dir):
    return rounded(m.speed_metrics(predictions(spark, sf_dir), ["campaign_brand"]).orderBy(F.desc("sws_mape")))


@query(
    "metrics_run",
    "G9 N4",
    f"""WITH {P}, {VALID}, {pct_cte('pc', 'valid_rows', ['campaign_run_id'], 'cs_pred_m_s', {'med': .5})}
    SELECT campaign_run_id, CAST(count(*) AS BIGINT) AS patch_count, round(avg(cs_true_m_s), 5) AS cs_true_mean_m_s,
      round(avg(cs_pred_m_s), 5) AS cs_pred_mean_m_s, round(coalesce(stddev_samp(cs_pred_m_s), 0), 5) AS cs_pred_std_m_s,
      round(min(cs_pred_m_s), 5) AS cs_pred_min_m_s, round(max(cs_pred_m_s), 5) AS cs_pred_max_m_s,
      round(avg(abs(cs_error_m_s)), 5) AS sws_mae_m_s, round(sqrt(avg(cs_error_m_s * cs_error_m_s)), 5) AS sws_rmse_m_s,
      round(avg(cs_error_m_s), 5) AS sws_bias_m_s, round(avg({APE}), 5) AS sws_mape,
      round(avg(cs_error_percent), 5) AS sws_bias_percent, round(any_value(med), 5) AS cs_pred_median_m_s
    FROM valid_rows JOIN pc USING (campaign_run_id) GROUP BY campaign_run_id""",
)
def metrics_run(spark, sf_dir):
    return rounded(m.run_summary(predictions(spark, sf_dir), ["campaign_run_id"]), 5)


@query(
    "metrics_purity",
    "G10",
    f"""WITH {P}, e AS (SELECT *, q_pred / 2 - q_true AS er, abs(q_pred / 2 - q_true) AS ae FROM predictions),
    {pct_cte('pc', 'e', ['partition'], 'ae', {'m': .5, 'a': .9, 'b': .95})}
    SELECT partition, CAST(count(er) AS BIGINT) AS valid_row_count, round(avg(ae), 6) AS purity_mae,
      round(sqrt(avg(er * er)), 6) AS purity_rmse, round(avg(er), 6) AS purity_bias,
      round(any_value(m), 6) AS purity_median_ae, round(any_value(a), 6) AS purity_p90_ae,
      round(any_value(b), 6) AS purity_p95_ae FROM e JOIN pc USING (partition) GROUP BY partition""",
)
def metrics_purity(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("purity_pred", F.col("q_pred") / 2)
    return rounded(m.purity_metrics(rows, ["partition"], "q_true", "purity_pred"))


GROUPINGS = {
    "by_frequency": ["campaign_frequency_hz"],
    "by_size": ["campaign_size"],
    "by_brand": ["campaign_brand"],
    "by_direction": ["campaign_direction_count"],
    "by_purity": ["truth_material_purity"],
    "by_model": ["model_id"],
    "frequency_direction": ["campaign_frequency_hz", "campaign_direction_count"],
    "frequency_purity": ["campaign_frequency_hz", "truth_material_purity"],
    "direction_purity": ["campaign_direction_count", "truth_material_purity"],
    "model_frequency": ["model_id", "campaign_frequency_hz"],
    "model_direction": ["model_id", "campaign_direction_count"],
    "brand_model": ["campaign_brand", "model_id"],
}


def _sets_sql() -> str:
    def text(c: str) -> str:
        return f"CAST({c} AS VARCHAR)"

    parts = []
    for name, columns in GROUPINGS.items():
        levels = [text(c) for c in columns] + ["NULL"] * (2 - len(columns))
        parts.append(
            f"SELECT '{name}' AS table_name, partition, {levels[0]} AS level_1, {levels[1]} AS level_2, q_ae, q_error, "
            f"cs_error_m_s, cs_error_percent, {APE} FROM valid_rows"
        )
    keys = ["table_name", "partition", "level_1", "level_2"]
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in keys)
    on2 = " AND ".join(f"a.{c} IS NOT DISTINCT FROM d.{c}" for c in keys)
    return f"""WITH {P}, {VALID}, long AS ({' UNION ALL '.join(parts)}),
    {pct_cte('pa', 'long', keys, APE, {'sws_median_ape': .5, 'sws_p90_ape': .9})},
    {pct_cte('pq', 'long', keys, 'q_ae', {'q_median_ae': .5})},
    base AS (SELECT {k}, CAST(count(*) AS BIGINT) AS row_count, {Q_SQL}, {SPEED_SQL} FROM long GROUP BY {k})
    SELECT a.*, round(d.q_median_ae, 6) AS q_median_ae, round(b.sws_median_ape, 6) AS sws_median_ape,
      round(b.sws_p90_ape, 6) AS sws_p90_ape
    FROM base a JOIN pa b ON {on} JOIN pq d ON {on2}"""


@query("metrics_sets", "G11", _sets_sql())
def metrics_sets(spark, sf_dir):
    return rounded(m.grouped_tables(predictions(spark, sf_dir), GROUPINGS, ["partition"], few_groups=True))  # levels of brands, sizes, ...


@query(
    "external_metrics",
    "G12",
    f"""WITH {P}, {VALID},
    {pct_cte('pc', 'valid_rows', ['campaign_size'], APE, {'sws_median_ape': .5, 'sws_p90_ape': .9})},
    e AS (SELECT campaign_size, CAST(count(*) AS BIGINT) AS patch_count, {Q_SQL}, {SPEED_SQL}
          FROM valid_rows GROUP BY campaign_size)
    SELECT campaign_size, patch_count, q_mae, q_rmse, q_bias, sws_mae_m_s, sws_rmse_m_s, sws_mape, sws_bias_percent,
      {rnd(['sws_median_ape', 'sws_p90_ape'])} FROM e JOIN pc USING (campaign_size)""",
)
def external_metrics(spark, sf_dir):
    return rounded(m.external_metrics(predictions(spark, sf_dir), ["campaign_size"]))


@query(
    "validity_fraction",
    "G13",
    f"""WITH {P} SELECT campaign_brand, CAST(count(*) AS BIGINT) AS row_count,
      CAST(count(*) FILTER (WHERE sws_valid) AS BIGINT) AS valid_row_count,
      round(avg(CASE WHEN sws_valid THEN 1.0::DOUBLE ELSE 0 END), 6) AS valid_fraction
    FROM predictions GROUP BY campaign_brand""",
)
def validity_fraction(spark, sf_dir):
    return rounded(m.validity_fraction(predictions(spark, sf_dir), ["campaign_brand"]))


@query(
    "weighted_metric",
    "G14",
    f"""WITH {P}, s AS (SELECT partition, campaign_brand, count(*) AS n, avg({APE}) AS mape FROM predictions
      WHERE sws_valid GROUP BY ALL)
    SELECT partition, CAST(sum(n) AS BIGINT) AS patch_count, round(sum(mape * n) / sum(n), 6) AS mape
    FROM s GROUP BY partition""",
)
def weighted_metric(spark, sf_dir):
    per_case = (
        predictions(spark, sf_dir)
        .where("sws_valid")
        .groupBy("partition", "campaign_brand")
        .agg(F.count(F.lit(1)).alias("patch_count"), F.avg(APE).alias("mape"))
    )
    return rounded(m.weighted_mean(per_case, ["partition"], "mape", "patch_count"))


@query(
    "worst_predictions",
    "T1",
    f"""WITH {P} SELECT example_id, model_id, campaign_run_id, round(cs_true_m_s, 5) AS cs_true_m_s,
      round(cs_pred_m_s, 5) AS cs_pred_m_s, round({APE}, 5) AS {APE} FROM predictions
    WHERE sws_valid AND model_id = 'R' AND partition = 'test'
    ORDER BY predictions.{APE} DESC, example_id LIMIT 25""",
)
def worst_predictions(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("model_id = 'R' and partition = 'test'")
    columns = ["example_id", "model_id", "campaign_run_id", "cs_true_m_s", "cs_pred_m_s", APE]
    return rounded(m.worst_predictions(rows, 25, columns), 5)


@query(
    "hotspot_controls",
    "T3",
    f"""WITH {P}, v AS (SELECT *, campaign_size AS cx, campaign_frequency_hz AS cz FROM predictions WHERE sws_valid),
    n AS (SELECT CAST(ceil(0.01::DOUBLE * count(*)) AS BIGINT) AS hot FROM v),
    md AS (SELECT median({APE}) AS med FROM v),
    hot AS (SELECT example_id, row_number() OVER (ORDER BY {APE} DESC, example_id) AS rn FROM v),
    pool AS (SELECT example_id, row_number() OVER (ORDER BY cx, cz, example_id) AS rn,
      count(*) OVER () AS total FROM v, md WHERE {APE} < med),
    pos AS (SELECT DISTINCT CAST(round(1 + j * ((total - 1) / (hot - 1)::DOUBLE)) AS BIGINT) AS rn
      FROM (SELECT DISTINCT total FROM pool), n, range((SELECT hot FROM n)) t(j))
    SELECT example_id, 'hotspot' AS selection_group FROM hot, n WHERE rn <= hot
    UNION ALL SELECT example_id, 'control' FROM pool JOIN pos USING (rn)""",
)
def hotspot_controls(spark, sf_dir):
    placed = predictions(spark, sf_dir).withColumn("cx", F.col("campaign_size")).withColumn("cz", F.col("campaign_frequency_hz"))
    picked = m.hotspots_and_controls(placed, 0.01)
    return picked.select("example_id", "selection_group")


_FLAGS = f"""{pct_cte('lim', 'predictions', ['model_id', 'partition'], APE, {'p95': .95, 'p99': .99})},
  flagged AS (SELECT p.*, {APE} > 10 AS h10, {APE} > 20 AS h20, {APE} >= p95 AS t5, {APE} >= p99 AS t1
    FROM predictions p JOIN lim USING (model_id, partition))"""


@query(
    "outlier_flags",
    "P22",
    f"""WITH {P}, {_FLAGS} SELECT example_id, h10 AS is_high_error_10, h20 AS is_high_error_20, t5 AS is_top5_error,
      t1 AS is_top1_error FROM flagged""",
)
def outlier_flags(spark, sf_dir):
    flagged = m.outlier_flags(predictions(spark, sf_dir), ["model_id", "partition"])
    return flagged.select("example_id", "is_high_error_10", "is_high_error_20", "is_top5_error", "is_top1_error")


@query(
    "outlier_rates",
    "G47 P22",
    f"""WITH {P}, {_FLAGS}, {pct_cte('pc', 'flagged', ['campaign_size'], APE, {'a': .5, 'b': .95})}
    SELECT campaign_size, CAST(count(*) AS BIGINT) AS N, round(avg({APE}), 6) AS MAPE_pct,
      round(100.0::DOUBLE * count(*) FILTER (h10) / count(*), 6) AS high_error_gt10_pct,
      round(100.0::DOUBLE * count(*) FILTER (h20) / count(*), 6) AS high_error_gt20_pct,
      round(100.0::DOUBLE * count(*) FILTER (t5) / count(*), 6) AS top5_error_pct,
      round(100.0::DOUBLE * count(*) FILTER (t1) / count(*), 6) AS top1_error_pct,
      round(any_value(a), 6) AS median_abs_error_pct, round(any_value(b), 6) AS p95_abs_error_pct
    FROM flagged JOIN pc USING (campaign_size) GROUP BY campaign_size""",
)
def outlier_rates(spark, sf_dir):
    flagged = m.outlier_flags(predictions(spark, sf_dir), ["model_id", "partition"])
    return rounded(m.outlier_rates(flagged, ["campaign_size"]))


@query(
    "support_occupancy",
    "G48",
    f"""WITH {P}, c AS (SELECT model_id, campaign_frequency_hz,
        count(*) FILTER (partition = 'train') AS a, count(*) FILTER (partition <> 'train') AS b,
        avg({APE}) FILTER (partition <> 'train') AS e,
        avg(CASE WHEN {APE} > 20 THEN 100.0::DOUBLE ELSE 0 END) FILTER (partition <> 'train') AS h
      FROM predictions GROUP BY ALL)
    SELECT model_id, campaign_frequency_hz, CAST(a AS BIGINT) AS N_train, CAST(b AS BIGINT) AS N_test,
      round(e, 6) AS test_MAPE_pct, round(h, 6) AS test_gt20_pct,
      round(a / CAST(sum(a) OVER (PARTITION BY model_id) AS DOUBLE), 6) AS train_fraction,
      round(b / CAST(sum(b) OVER (PARTITION BY model_id) AS DOUBLE), 6) AS test_fraction FROM c""",
)
def support_occupancy(spark, sf_dir):
    return rounded(m.support_occupancy(predictions(spark, sf_dir), ["model_id"], "campaign_frequency_hz"))


@query(
    "gain_vs_baseline",
    "G35 J10",
    f"""WITH {P}, s AS (SELECT partition, model_id, avg({APE}) AS mape FROM predictions WHERE sws_valid GROUP BY ALL)
    SELECT partition, model_id, round(mape, 6) AS mape, round(b, 6) AS baseline_value, round(mape - b, 6) AS delta,
      round(100 * (b - mape) / b, 6) AS gain_pct
    FROM s JOIN (SELECT partition, mape AS b FROM s WHERE model_id = 'A') USING (partition)""",
)
def gain_vs_baseline(spark, sf_dir):
    summary = predictions(spark, sf_dir).where("sws_valid").groupBy("partition", "model_id").agg(F.avg(APE).alias("mape"))
    return rounded(m.gain_vs_baseline(summary, ["partition"], "model_id", "A", "mape"))


@query(
    "high_error_rates",
    "G31",
    f"""WITH {P} SELECT campaign_brand, campaign_direction_count, CAST(count(*) AS BIGINT) AS N,
      round(100.0::DOUBLE * count(*) FILTER ({APE} > 50) / count(*), 6) AS high_error_pct
    FROM predictions GROUP BY ALL""",
)
def high_error_rates(spark, sf_dir):
    keys = ["campaign_brand", "campaign_direction_count"]
    return rounded(m.high_error_rates(predictions(spark, sf_dir), keys, 50.0))


_ERR = """e AS (SELECT model_id, partition, q_true AS t, q_pred AS p, q_pred - q_true AS er, abs(q_pred - q_true) AS ae
  FROM predictions)"""


@query(
    "errors_by_group",
    "G24 W5",
    f"""WITH {P}, {_ERR}, {pct_cte('pc', 'e', ['model_id', 'partition'], 'ae', {'p90': .9})},
    {spearman_cte('sp', 'e', ['model_id', 'partition'], 't', 'p')}
    SELECT model_id, partition, CAST(count(*) AS BIGINT) AS N, round(avg(ae), 6) AS mae,
      round(sqrt(avg(er * er)), 6) AS rmse, round(avg(er), 6) AS bias, round(stddev_samp(er), 6) AS residual_std,
      round(1 - sum(er * er) / (var_pop(t) * count(*)), 6) AS r2, round(corr(t, p), 6) AS pearson,
      round(avg(CASE WHEN er > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS over_fraction,
      round(avg(CASE WHEN er < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS under_fraction,
      round(any_value(p90), 6) AS p90_abs_error, round(any_value(spearman), 6) AS spearman
    FROM e JOIN pc USING (model_id, partition) JOIN sp USING (model_id, partition) GROUP BY ALL""",
)
def errors_by_group(spark, sf_dir):
    return rounded(m.error_table(predictions(spark, sf_dir), ["model_id", "partition"], "q_true", "q_pred"))


@query(
    "method_errors",
    "G29",
    f"""WITH {P}, e AS (SELECT campaign_brand, cs_true_m_s AS t, cs_pred_m_s AS p, cs_error_m_s AS er,
        {APE} AS ape FROM predictions),
    {pct_cte('pc', 'e', ['campaign_brand'], 'ape', {'a': .5, 'b': .75, 'c': .9})},
    {spearman_cte('sp', 'e', ['campaign_brand'], 't', 'p')}
    SELECT campaign_brand, CAST(count(*) AS BIGINT) AS N, round(sqrt(avg(er * er)), 5) AS rmse,
      round(avg(abs(er)), 5) AS mae, round(avg(ape), 5) AS mean_ape, round(max(ape), 5) AS max_ape,
      round(any_value(a), 5) AS median_ape, round(any_value(b), 5) AS p75_ape, round(any_value(c), 5) AS p90_ape,
      round(any_value(spearman), 5) AS spearman
    FROM e JOIN pc USING (campaign_brand) JOIN sp USING (campaign_brand) GROUP BY campaign_brand""",
)
def method_errors(spark, sf_dir):
    return rounded(m.method_errors(predictions(spark, sf_dir), ["campaign_brand"], "cs_true_m_s", "cs_pred_m_s"), 5)


@query(
    "roi_metrics",
    "G30 G62",
    f"""WITH {P} SELECT campaign_size, campaign_frequency_hz, CAST(count(*) AS BIGINT) AS N,
      round(avg(cs_pred_m_s), 5) AS mean_m_s,
      round(CASE WHEN count(*) > 1 THEN stddev_samp(cs_pred_m_s) END, 5) AS std_m_s,
      round(CASE WHEN count(*) > 1 THEN 100 * stddev_samp(cs_pred_m_s) / avg(cs_pred_m_s) END, 5) AS cv_pct,
      round(avg(cs_error_m_s), 5) AS bias_m_s, round(avg({APE}), 5) AS mape,
      round(100.0::DOUBLE * count(*) FILTER ({APE} > 20) / count(*), 5) AS gt20_pct FROM predictions GROUP BY ALL""",
)
def roi_metrics(spark, sf_dir):
    return rounded(m.roi_metrics(predictions(spark, sf_dir), ["campaign_size", "campaign_frequency_hz"]), 5)


@query(
    "seed_variability",
    "G32 G57",
    f"""WITH {P}, i AS (SELECT campaign_size, campaign_run_id, avg(cs_pred_m_s) AS mu,
        CASE WHEN count(*) > 1 THEN stddev_samp(cs_pred_m_s) END AS s FROM predictions GROUP BY ALL)
    SELECT campaign_size, CAST(count(*) AS BIGINT) AS group_count, round(avg(mu), 5) AS mean_of_means,
      round(stddev_samp(mu), 5) AS between_std, round(avg(s), 5) AS mean_within_std,
      round(100 * stddev_samp(mu) / avg(mu), 5) AS between_cv_pct FROM i GROUP BY campaign_size""",
)
def seed_variability(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rounded(m.two_level_spread(rows, ["campaign_size"], "campaign_run_id", "cs_pred_m_s"), 5)


@query(
    "fold_metric_spread",
    "G57",
    f"""WITH {P}, f AS (SELECT model_id, campaign_brand, avg({APE}) AS v FROM predictions WHERE sws_valid GROUP BY ALL)
    SELECT model_id, CAST(count(v) AS BIGINT) AS fold_count, round(avg(v), 6) AS metric_mean,
      round(stddev_samp(v), 6) AS metric_std FROM f GROUP BY model_id""",
)
def fold_metric_spread(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("sws_valid")
    return rounded(m.fold_spread(rows, ["model_id"], "campaign_brand", F.avg(APE)))


@query(
    "weighted_median",
    "G36",
    f"""WITH {P}, c AS (SELECT campaign_brand, cs_pred_m_s AS v,
        sum(campaign_direction_count) OVER (PARTITION BY campaign_brand ORDER BY cs_pred_m_s) AS cum,
        sum(campaign_direction_count) OVER (PARTITION BY campaign_brand) AS total
      FROM predictions)
    SELECT campaign_brand, round(min(v), 6) AS weighted_median_m_s FROM c WHERE cum >= 0.5::DOUBLE * total
    GROUP BY campaign_brand""",
)
def weighted_median(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rounded(m.weighted_median(rows, ["campaign_brand"], "cs_pred_m_s", "campaign_direction_count", "weighted_median_m_s"))


@query(
    "hotspot_statistics",
    "G43",
    f"""WITH {P}, g AS (SELECT CASE WHEN {APE} > 200 THEN 'hotspot' ELSE 'control' END AS grp, campaign_frequency_hz,
        q_true, cs_true_m_s FROM predictions),
    u AS (UNPIVOT g ON campaign_frequency_hz, q_true, cs_true_m_s INTO NAME variable_name VALUE val),
    {pct_cte('pc', 'u', ['variable_name', 'grp'], 'val', {'a': .25, 'b': .5, 'c': .75})}
    SELECT h.variable_name, round(h.b, 6) AS hotspot_median, round(h.c - h.a, 6) AS hotspot_iqr,
      round(k.b, 6) AS control_median, round(k.c - k.a, 6) AS control_iqr,
      round((h.b - k.b) / (k.c - k.a + 2.220446049250313e-16::DOUBLE), 6) AS robust_effect
    FROM pc h JOIN pc k ON h.variable_name = k.variable_name AND h.grp = 'hotspot' AND k.grp = 'control'""",
)
def hotspot_statistics(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(
        F.when(F.col(APE) > 200, "hotspot").otherwise("control").alias("selection_group"),
        "campaign_frequency_hz",
        "q_true",
        "cs_true_m_s",
    )
    columns = ["campaign_frequency_hz", "q_true", "cs_true_m_s"]
    return rounded(m.hotspot_statistics(rows, "selection_group", columns, "hotspot", "control"))


@query(
    "metric_gates",
    "G45",
    f"""WITH {P}, s AS (SELECT partition, model_id, avg({APE}) AS mape FROM predictions WHERE sws_valid GROUP BY ALL)
    SELECT partition, model_id, round(mape, 6) AS mape, 250.0::DOUBLE AS gate_limit, mape <= 250 AS gate_passed FROM s""",
)
def metric_gates(spark, sf_dir):
    summary = predictions(spark, sf_dir).where("sws_valid").groupBy("partition", "model_id").agg(F.avg(APE).alias("mape"))
    return rounded(m.gates(summary, "mape", 250.0, ["partition", "model_id"]))


_FIVE = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query(
    "stratified_audit",
    "G42 G44",
    f"""WITH {P}, {pct_cte('pc', 'predictions', ['campaign_size', 'campaign_direction_count'], 'cs_pred_m_s', _FIVE)}
    SELECT campaign_size, campaign_direction_count, CAST(count(*) AS BIGINT) AS N, round(avg(cs_pred_m_s), 5) AS mean,
      {', '.join(f'round(any_value({p}), 5) AS {p}' for p in _FIVE)}
    FROM predictions JOIN pc USING (campaign_size, campaign_direction_count) GROUP BY ALL""",
)
def stratified_audit(spark, sf_dir):
    keys = ["campaign_size", "campaign_direction_count"]
    return rounded(m.percentile_audit(predictions(spark, sf_dir), keys, "cs_pred_m_s"), 5)


@query(
    "matched_baseline",
    "G54",
    f"""WITH {P}, {pct_cte('b', "(SELECT * FROM predictions WHERE truth_material_purity = 0)", ['campaign_frequency_hz'],
                           'cs_pred_m_s', {'base': .5})},
    d AS (SELECT campaign_frequency_hz, truth_material_purity, cs_pred_m_s - base AS diff FROM predictions
      JOIN b USING (campaign_frequency_hz) WHERE truth_material_purity > 0)
    SELECT truth_material_purity, CAST(count(*) AS BIGINT) AS N, round(avg(diff), 5) AS mean_shift,
      round(stddev_samp(diff), 5) AS std_shift FROM d GROUP BY truth_material_purity""",
)
def matched_baseline(spark, sf_dir):
    rows = m.band_normalised(
        predictions(spark, sf_dir), ["campaign_frequency_hz"], F.col("truth_material_purity") == 0, ["cs_pred_m_s"]
    )
    shift = "cs_pred_m_s_minus_baseline"
    return rounded(
        rows.where("truth_material_purity > 0")
        .groupBy("truth_material_purity")
        .agg(F.count(shift).alias("N"), F.avg(shift).alias("mean_shift"), F.stddev_samp(shift).alias("std_shift")),
        5,
    )


@query(
    "contamination_summary",
    "G55 G37 P9 P10",
    f"""WITH {P} SELECT CAST(CASE WHEN truth_material_purity < 0.02::DOUBLE THEN 1 WHEN truth_material_purity < 0.05::DOUBLE
        THEN 2 ELSE 3 END AS INTEGER) AS purity_class,
      CAST(CASE WHEN d < 1 THEN 1 WHEN d < 2 THEN 2 WHEN d < 4 THEN 3 WHEN d <= 8 THEN 4 ELSE 0 END AS INTEGER)
        AS distance_bin,
      CAST(count(*) AS BIGINT) AS N, round(avg({APE}), 6) AS MAPE_pct, round(avg(cs_error_percent), 6) AS bias_pct,
      round(100.0::DOUBLE * count(*) FILTER ({APE} > 20) / count(*), 6) AS gt20_pct
    FROM (SELECT *, campaign_size / 5.0::DOUBLE AS d FROM predictions) GROUP BY 1, 2""",
)
def contamination_summary(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("distance_mm", F.col("campaign_size") / 5.0)
    purity_class = bin_index("truth_material_purity", (0.0, 0.02, 0.05, 1.0))
    return rounded(
        rows.groupBy(purity_class.alias("purity_class"), bin_index("distance_mm", (0, 1, 2, 4, 8)).alias("distance_bin")).agg(
            F.count(F.lit(1)).alias("N"),
            F.avg(APE).alias("MAPE_pct"),
            F.avg("cs_error_percent").alias("bias_pct"),
            m.percent(F.col(APE) > 20).alias("gt20_pct"),
        )
    )
