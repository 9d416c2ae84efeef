"""The training study on a target that the predictors explain."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgrain.operators.training import training_study
from fieldgrain.plans.catalog import query, rounded
from fieldgrain.plans.studies import PREDICTORS, SIGNAL_SQL, signal

FOLDS = 5

#: Level columns of the tables, in Spark and DuckDB alike.
LEVELS = {
    "brand": "campaign_brand",
    "frequency_band": "CAST(floor(campaign_frequency_hz / 10) AS BIGINT)",
    "size_band": "CAST(floor(campaign_size / 10) AS BIGINT)",
    "directions": "campaign_direction_count",
    "purity": "CAST(round(truth_material_purity * 100) AS BIGINT)",
    "speed_valid": "CAST(sws_valid AS INT)",
    "source": "model_id",
}
GROUPINGS = {
    **{f"by_{c}": [c] for c in LEVELS},
    "brand_frequency": ["brand", "frequency_band"],
    "brand_directions": ["brand", "directions"],
    "frequency_size": ["frequency_band", "size_band"],
    "purity_directions": ["purity", "directions"],
    "valid_source": ["speed_valid", "source"],
}

_TABLES = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, partition, prediction_source, CAST({c[0]} AS VARCHAR) AS level_1, {f'CAST({c[1]} AS VARCHAR)' if len(c) > 1 else 'NULL'} AS level_2, e FROM e"
    for name, c in GROUPINGS.items()
)


@query(
    "training_study",
    "M19 M6 M11 P25",
    f"""WITH {SIGNAL_SQL}, a AS (SELECT partition, CAST(campaign_run_id AS BIGINT) % {FOLDS} + 1 AS fold, campaign_frequency_hz AS x1, CAST(campaign_size AS DOUBLE) AS x2,
      q_target AS y, {', '.join(f'{text} AS {name}' for name, text in LEVELS.items())} FROM signal),
    -- fit 0 is the final one; the others leave their fold out
    s AS (SELECT v, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_samp(x1) AS d1, stddev_samp(x2) AS d2,
        corr(x1, x2) AS r, covar_samp(x1, y) AS c1, covar_samp(x2, y) AS c2 FROM range({FOLDS + 1}) l(v) JOIN a ON a.partition = 'train' AND a.fold <> v GROUP BY 1),
    f AS (SELECT *, n - 1 + 1.0::DOUBLE AS p, (n - 1) * r AS o, (n - 1) * c1 / d1 AS b1, (n - 1) * c2 / d2 AS b2 FROM s),
    k AS (SELECT *, (b1 * p - b2 * o) / (p * p - o * o) / d1 AS s1, (b2 * p - b1 * o) / (p * p - o * o) / d2 AS s2 FROM f),
    e AS (SELECT a.*, CASE WHEN partition = 'train' THEN 'out_of_fold' ELSE 'final_train_model' END AS prediction_source,
        greatest(0.001::DOUBLE, least(0.999::DOUBLE, my + s1 * (x1 - m1) + s2 * (x2 - m2))) - y AS e
      FROM a JOIN k ON v = CASE WHEN partition = 'train' THEN fold ELSE 0 END),
    t AS ({_TABLES})
    SELECT table_name, partition, prediction_source, level_1, level_2, CAST(count(*) AS BIGINT) AS row_count, round(avg(abs(e)), 6) AS q_mae, round(sqrt(avg(e * e)), 6) AS q_rmse,
      round(avg(e), 6) AS q_bias FROM t GROUP BY 1, 2, 3, 4, 5""",
)
def training_study_tables(spark, sf_dir):
    """Five folds of whole runs, ridge, and twelve tables of errors."""
    fold = (F.col("campaign_run_id").cast("long") % FOLDS + 1).alias("cv_fold")
    levels = [F.expr(text).alias(name) for name, text in LEVELS.items()]
    rows = signal(spark, sf_dir).select("partition", fold, *PREDICTORS, "q_target", *levels)
    return rounded(training_study(rows, "ridge", PREDICTORS, "q_target", GROUPINGS, FOLDS, penalty=1.0)[2])
