"""Split, fold, hold-out and selection queries on the examples frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgrain.operators import sampling as smp, splits as sp
from fieldgrain.plans.catalog import query, rounded
from fieldgrain.plans.coverage import ASSIGNED_SQL, DEFICITS_SQL, GRID, _KEY, assigned, deficits
from fieldgrain.plans.frames import EXAMPLES_SQL, MAP_SQL, PREDICTIONS_SQL, examples, predictions, value_map

E = EXAMPLES_SQL


def _split_cte(seed: int = 4101) -> str:
    return f"""{E}, cond AS (SELECT c, row_number() OVER (ORDER BY md5('{seed}:' || c)) AS rn, count(*) OVER () AS n
      FROM (SELECT DISTINCT campaign_condition_id AS c FROM examples)),
    parts AS (SELECT c AS campaign_condition_id, CASE WHEN rn <= floor(n * 0.7::DOUBLE + 1e-9) THEN 'train'
      WHEN rn <= floor(n * 0.7::DOUBLE + 1e-9) + floor(n * 0.15::DOUBLE + 1e-9) THEN 'validation' ELSE 'test' END AS partition
      FROM cond),
    split AS (SELECT * FROM examples JOIN parts USING (campaign_condition_id))"""


_FOLDS = f"""{_split_cte()}, fold AS (
      SELECT campaign_condition_id, CAST((row_number() OVER (ORDER BY md5('fold:7:' || campaign_condition_id)) - 1) % 5 + 1
        AS INTEGER) AS cv_fold FROM parts WHERE partition = 'train'),
    folds AS (SELECT s.*, coalesce(cv_fold, 0) AS cv_fold FROM split s LEFT JOIN fold USING (campaign_condition_id))"""


def _split(spark, sf_dir):
    return sp.grouped_split(examples(spark, sf_dir), seed=4101)


def _folds(spark, sf_dir):
    return sp.grouped_folds(_split(spark, sf_dir), 5, seed=7)


@query("split_grouped", "D1 N9", f"WITH {_split_cte()} SELECT example_id, campaign_condition_id, partition FROM split")
def split_grouped(spark, sf_dir):
    return _split(spark, sf_dir).select("example_id", "campaign_condition_id", "partition")


@query("split_folds", "D2", f"WITH {_FOLDS} SELECT example_id, partition, cv_fold FROM folds")
def split_folds(spark, sf_dir):
    return _folds(spark, sf_dir).select("example_id", "partition", "cv_fold")


@query(
    "split_integrity",
    "D3 D18",
    f"""WITH {_split_cte()}, t AS (SELECT count(*) FILTER (partition IS NULL) AS u,
        count(*) FILTER (partition = 'train') AS a, count(*) FILTER (partition = 'validation') AS b,
        count(*) FILTER (partition = 'test') AS c FROM split),
    rl AS (SELECT count(*) AS x FROM (SELECT campaign_run_id FROM split GROUP BY 1 HAVING count(DISTINCT partition) > 1)),
    cl AS (SELECT count(*) AS y FROM (SELECT campaign_condition_id FROM split GROUP BY 1
      HAVING count(DISTINCT partition) > 1))
    SELECT 'complete_assignment' AS check_name, CAST(u AS BIGINT) AS value, u = 0 AS passed FROM t
    UNION ALL SELECT 'runs_in_one_partition', CAST(x AS BIGINT), x = 0 FROM rl
    UNION ALL SELECT 'conditions_in_one_partition', CAST(y AS BIGINT), y = 0 FROM cl
    UNION ALL SELECT 'train_not_empty', CAST(a AS BIGINT), a > 0 FROM t
    UNION ALL SELECT 'validation_not_empty', CAST(b AS BIGINT), b > 0 FROM t
    UNION ALL SELECT 'test_not_empty', CAST(c AS BIGINT), c > 0 FROM t""",
)
def split_integrity(spark, sf_dir):
    return sp.split_checks(_split(spark, sf_dir))


@query(
    "fold_integrity",
    "D4 D5",
    f"""WITH {_FOLDS}, tr AS (SELECT * FROM folds WHERE partition = 'train')
    SELECT 'train_rows_have_fold' AS check_name, CAST(count(*) AS BIGINT) AS value, count(*) = 0 AS passed
      FROM tr WHERE cv_fold NOT BETWEEN 1 AND 5
    UNION ALL SELECT 'other_rows_have_none', CAST(count(*) AS BIGINT), count(*) = 0 FROM folds
      WHERE partition <> 'train' AND cv_fold <> 0
    UNION ALL SELECT 'conditions_in_one_fold', CAST(count(*) AS BIGINT), count(*) = 0 FROM
      (SELECT campaign_condition_id FROM tr GROUP BY 1 HAVING count(DISTINCT cv_fold) > 1)
    UNION ALL SELECT 'folds_not_empty', CAST(count(DISTINCT cv_fold) AS BIGINT), count(DISTINCT cv_fold) = 5 FROM tr""",
)
def fold_integrity(spark, sf_dir):
    return sp.fold_checks(_folds(spark, sf_dir), 5)


@query(
    "split_summary",
    "G20",
    f"""WITH {_FOLDS} SELECT partition, cv_fold, CAST(count(*) AS BIGINT) AS row_count,
      CAST(count(DISTINCT campaign_run_id) AS BIGINT) AS run_count,
      CAST(count(DISTINCT campaign_condition_id) AS BIGINT) AS condition_count FROM folds GROUP BY ALL""",
)
def split_summary(spark, sf_dir):
    return sp.split_summary(_folds(spark, sf_dir), ["partition", "cv_fold"])


@query(
    "holdout_level",
    "D6 D7",
    f"""WITH {E}, marks AS (SELECT campaign_condition_id AS c, max(CASE WHEN iteration_index = 3 THEN 1 ELSE 0 END) AS held
      FROM examples GROUP BY 1),
    rest AS (SELECT c, row_number() OVER (ORDER BY md5('11:' || c)) AS rn, count(*) OVER () AS n FROM marks WHERE held = 0)
    SELECT e.example_id, CASE WHEN held = 1 THEN 'test'
      WHEN rn <= greatest(1, round(n * 0.15::DOUBLE)) THEN 'validation' ELSE 'train' END AS partition
    FROM examples e JOIN marks m ON e.campaign_condition_id = m.c LEFT JOIN rest r ON r.c = m.c""",
)
def holdout_level(spark, sf_dir):
    rows = examples(spark, sf_dir)
    return sp.holdout_split(rows, F.col("iteration_index") == 3, seed=11).select("example_id", "partition")


@query(
    "holdout_specs",
    "D8",
    f"""WITH {E} SELECT DISTINCT 'iteration_index' AS axis, CAST(iteration_index AS VARCHAR) AS level,
      'iteration_index=' || iteration_index AS holdout_id FROM examples
    UNION ALL SELECT DISTINCT 'model_id', model_id, 'model_id=' || model_id FROM examples
    UNION ALL SELECT 'joint', 'iteration_index=3&model_id=A', 'iteration_index=3&model_id=A'""",
)
def holdout_specs(spark, sf_dir):
    return sp.holdout_specifications(
        examples(spark, sf_dir), ["iteration_index", "model_id"], {"iteration_index": "3", "model_id": "A"}
    )


@query(
    "alternating_levels",
    "D7 S6",
    f"""WITH {E}, lv AS (SELECT f, row_number() OVER (ORDER BY f) AS rn FROM
      (SELECT DISTINCT campaign_frequency_hz AS f FROM examples))
    SELECT CASE WHEN rn % 2 = 0 THEN 'test' ELSE 'train' END AS partition, f AS campaign_frequency_hz,
      CAST(count(*) AS BIGINT) AS row_count FROM examples JOIN lv ON f = campaign_frequency_hz GROUP BY ALL""",
)
def alternating_levels(spark, sf_dir):
    split = sp.alternating_levels(examples(spark, sf_dir), "campaign_frequency_hz")
    return split.groupBy("partition", "campaign_frequency_hz").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "support_disjoint",
    "S6",
    f"""WITH {E}, lv AS (SELECT f, row_number() OVER (ORDER BY f) AS rn FROM
      (SELECT DISTINCT campaign_frequency_hz AS f FROM examples))
    SELECT CAST(count(*) FILTER (rn % 2 = 1) AS BIGINT) AS train_levels,
      CAST(count(*) FILTER (rn % 2 = 0) AS BIGINT) AS test_levels, CAST(0 AS BIGINT) AS shared_levels,
      CAST(0 AS BIGINT) AS uncovered_levels FROM lv""",
)
def support_disjoint(spark, sf_dir):
    split = sp.alternating_levels(examples(spark, sf_dir), "campaign_frequency_hz")
    return sp.support_disjoint(split, "campaign_frequency_hz")


def _repeat_sql(seeds: list[int]) -> str:
    parts = [
        f"""SELECT 'seed_{s}' AS fold_name, c, row_number() OVER (ORDER BY md5('{s}:' || c)) AS rn, count(*) OVER () AS n
        FROM d"""
        for s in seeds
    ]
    return f"""WITH {E}, d AS (SELECT DISTINCT campaign_condition_id AS c FROM examples), r AS ({' UNION ALL '.join(parts)})
    SELECT fold_name, c AS campaign_condition_id, CASE WHEN rn <= floor(n * 0.7::DOUBLE + 1e-9) THEN 'train'
      WHEN rn <= floor(n * 0.7::DOUBLE + 1e-9) + floor(n * 0.15::DOUBLE + 1e-9) THEN 'validation' ELSE 'test' END AS partition
    FROM r"""


@query("repeated_splits", "D20", _repeat_sql([1, 2, 3]))
def repeated_splits(spark, sf_dir):
    return sp.repeated_splits(examples(spark, sf_dir), [1, 2, 3])


@query(
    "domain_transfer",
    "D20 D7",
    f"""WITH {E} SELECT fold_name, partition, CAST(count(*) AS BIGINT) AS row_count FROM (
      SELECT 'A_to_R' AS fold_name, CASE model_id WHEN 'A' THEN 'train' WHEN 'R' THEN 'test' END AS partition FROM examples
      UNION ALL SELECT 'R_to_N', CASE model_id WHEN 'R' THEN 'train' WHEN 'N' THEN 'test' END FROM examples)
    WHERE partition IS NOT NULL GROUP BY ALL""",
)
def domain_transfer(spark, sf_dir):
    rows = sp.domain_transfer_splits(examples(spark, sf_dir), "model_id", [("A", "R"), ("R", "N")])
    return rows.groupBy("fold_name", "partition").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "condition_key",
    "P13 A4",
    f"""WITH {E} SELECT DISTINCT 'campaign_condition_id=' || replace(replace(campaign_condition_id, '__', '_'), '=', '-')
      || '__model_id=' || model_id || '__campaign_direction_count=' || campaign_direction_count AS condition_key
    FROM examples""",
)
def condition_key(spark, sf_dir):
    key = sp.condition_id(["campaign_condition_id", "model_id", "campaign_direction_count"])
    return examples(spark, sf_dir).select(key.alias("condition_key")).distinct()


@query(
    "frozen_split_check",
    "IO7",
    f"""WITH {_split_cte()}, fr AS (SELECT example_id, count(*) AS n, max(campaign_condition_id) AS c,
        max(CASE WHEN iteration_index = 2 THEN 'moved' ELSE campaign_run_id END) AS r
      FROM split WHERE model_id <> 'N' GROUP BY 1),
    cur AS (SELECT example_id, count(*) AS n, max(campaign_condition_id) AS c, max(campaign_run_id) AS r FROM examples GROUP BY 1)
    SELECT CAST(count(*) FILTER (cur.n > 1) AS BIGINT) AS duplicate_current_ids,
      CAST(count(*) FILTER (fr.n > 1) AS BIGINT) AS duplicate_frozen_ids,
      CAST(count(*) FILTER (cur.n IS NULL) AS BIGINT) AS missing_in_current,
      CAST(count(*) FILTER (fr.n IS NULL) AS BIGINT) AS missing_in_frozen,
      CAST(count(*) FILTER (fr.c <> cur.c) AS BIGINT) AS changed_campaign_condition_id,
      CAST(count(*) FILTER (fr.r <> cur.r) AS BIGINT) AS changed_campaign_run_id
    FROM cur FULL JOIN fr ON cur.example_id = fr.example_id""",
)
def frozen_split_check(spark, sf_dir):
    frozen = (
        _split(spark, sf_dir)
        .where("model_id <> 'N'")
        .withColumn("campaign_run_id", F.when(F.col("iteration_index") == 2, "moved").otherwise(F.col("campaign_run_id")))
        .select("example_id", "campaign_condition_id", "campaign_run_id", "partition")
    )
    return sp.compare_frozen(examples(spark, sf_dir), frozen)


# --- selection ------------------------------------------------------------------------------------

A = ASSIGNED_SQL + f", keyed AS (SELECT *, {_KEY} AS cell FROM assigned WHERE coverage_valid)"
CAPS = {"conditions_per_cell": 10, "runs_per_condition": 2, "patches_per_run": 1}

_SELECTED = f"""{A},
  c1 AS (SELECT cell, campaign_condition_id FROM (SELECT cell, campaign_condition_id,
      row_number() OVER (PARTITION BY cell ORDER BY md5('5:' || campaign_condition_id)) AS rn
    FROM (SELECT DISTINCT cell, campaign_condition_id FROM keyed)) WHERE rn <= 10),
  c2 AS (SELECT cell, campaign_condition_id, campaign_run_id FROM (SELECT *,
      row_number() OVER (PARTITION BY cell, campaign_condition_id ORDER BY md5('5:' || campaign_run_id)) AS rn
    FROM (SELECT DISTINCT cell, campaign_condition_id, campaign_run_id FROM keyed
          JOIN c1 USING (cell, campaign_condition_id))) WHERE rn <= 2),
  selected AS (SELECT * FROM (SELECT keyed.*, row_number() OVER (PARTITION BY cell, campaign_condition_id, campaign_run_id
      ORDER BY md5('5:' || example_id)) AS rn FROM keyed JOIN c2 USING (cell, campaign_condition_id, campaign_run_id))
    WHERE rn <= 1)"""


def _selected(spark, sf_dir):
    return smp.balanced_selection(assigned(spark, sf_dir), seed=5, **CAPS)


@query(
    "balanced_selection",
    "T4",
    f"WITH {_SELECTED} SELECT cell AS coverage_cell_key, campaign_condition_id, campaign_run_id, example_id FROM selected",
)
def balanced_selection(spark, sf_dir):
    return _selected(spark, sf_dir).select(
        "coverage_cell_key", "campaign_condition_id", "campaign_run_id", "example_id"
    )


@query(
    "balanced_weights",
    "T5",
    f"""WITH {_SELECTED}, w AS (SELECT example_id, 1.0::DOUBLE / ((SELECT count(DISTINCT cell) FROM selected)
        * (SELECT count(DISTINCT b.campaign_condition_id) FROM selected b WHERE b.cell = a.cell)
        * (SELECT count(DISTINCT b.campaign_run_id) FROM selected b WHERE b.cell = a.cell
             AND b.campaign_condition_id = a.campaign_condition_id)
        * count(*) OVER (PARTITION BY cell, campaign_condition_id, campaign_run_id)) AS w FROM selected a)
    SELECT example_id, round(w / avg(w) OVER (), 6) AS training_weight FROM w""",
)
def balanced_weights(spark, sf_dir):
    return rounded(smp.balanced_weights(_selected(spark, sf_dir)).select("example_id", "training_weight"))


def _balance_sql(source_key: str, out: str) -> str:
    return f"""WITH {_SELECTED},
    a AS (SELECT {source_key} AS g, count(*) AS n, count(DISTINCT campaign_run_id) AS r,
      count(DISTINCT campaign_condition_id) AS c FROM keyed GROUP BY 1),
    s AS (SELECT {source_key} AS g, count(*) AS n, count(DISTINCT campaign_run_id) AS r,
      count(DISTINCT campaign_condition_id) AS c FROM selected GROUP BY 1)
    SELECT a.g AS {out}, a.n AS available_example_count, a.r AS available_run_count, a.c AS available_condition_count,
      coalesce(s.n, 0) AS selected_example_count, coalesce(s.r, 0) AS selected_run_count,
      coalesce(s.c, 0) AS selected_condition_count, round(coalesce(s.n, 0) / CAST(a.n AS DOUBLE), 6) AS selected_fraction
    FROM a LEFT JOIN s ON a.g = s.g"""


@query("balance_by_cell", "T6", _balance_sql("cell", "coverage_cell_key"))
def balance_by_cell(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    return rounded(smp.balance_summary(rows, _selected(spark, sf_dir), ["coverage_cell_key"]))


@query("balance_by_frequency", "T6", _balance_sql("frequency_bin", "coverage_frequency_bin"))
def balance_by_frequency(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    return rounded(smp.balance_summary(rows, _selected(spark, sf_dir), ["coverage_frequency_bin"]))


@query("balance_by_condition", "T6", _balance_sql("campaign_condition_id", "campaign_condition_id"))
def balance_by_condition(spark, sf_dir):
    rows = assigned(spark, sf_dir).withColumnRenamed("campaign_condition_id", "c").withColumn("campaign_condition_id", F.col("c"))
    return rounded(smp.balance_summary(rows, _selected(spark, sf_dir).withColumn("c", F.col("campaign_condition_id")), ["c"])).withColumnRenamed("c", "campaign_condition_id")


@query(
    "patch_quota",
    "T2",
    f"""WITH {E} SELECT * FROM (SELECT campaign_run_id, example_id, CAST(row_number() OVER (PARTITION BY campaign_run_id
      ORDER BY md5('9:' || example_id)) AS INTEGER) AS quota_selection_rank FROM examples) WHERE quota_selection_rank <= 3""",
)
def patch_quota(spark, sf_dir):
    return smp.patch_quota(examples(spark, sf_dir), 3, seed=9).select(
        "campaign_run_id", "example_id", "quota_selection_rank"
    )


@query(
    "quota_diagnostics",
    "T2",
    f"""WITH {E} SELECT campaign_run_id, n AS available_patch_count, least(n, 3) AS selected_patch_count,
      greatest(3 - n, 0) AS deficit_patch_count, n >= 3 AS complete, n > 3 AS subsampled
    FROM (SELECT campaign_run_id, CAST(count(*) AS BIGINT) AS n FROM examples GROUP BY 1)""",
)
def quota_diagnostics(spark, sf_dir):
    return smp.quota_diagnostics(examples(spark, sf_dir), 3)


@query(
    "stratified_sample",
    "T11",
    f"""WITH {E} SELECT campaign_condition_id, example_id FROM (SELECT *, row_number() OVER
      (PARTITION BY campaign_condition_id ORDER BY md5('3:' || example_id)) AS rn FROM examples) WHERE rn <= 20""",
)
def stratified_sample(spark, sf_dir):
    picked = smp.lowest_hash(examples(spark, sf_dir), ["campaign_condition_id"], ["example_id"], 20, 3, "_r")
    return picked.select("campaign_condition_id", "example_id")


@query(
    "tie_key",
    "T9",
    f"""WITH {MAP_SQL} SELECT map_id, iz, ix, (ix * 73856093 + iz * 19349663 + 17 * 83492791) % 2147483647 AS tie_key
    FROM map""",
)
def tie_key(spark, sf_dir):
    return value_map(spark, sf_dir).select("map_id", "iz", "ix", smp.tie_key("ix", "iz", 17).alias("tie_key"))


@query(
    "spatial_subsample",
    "T12",
    f"WITH {MAP_SQL} SELECT map_id, iz, ix, round(value, 6) AS value FROM map WHERE ix % 4 = 0 AND iz % 4 = 0",
)
def spatial_subsample(spark, sf_dir):
    return rounded(
        smp.spatial_subsample(value_map(spark, sf_dir), "ix", "iz", 4).select("map_id", "iz", "ix", "value")
    )


@query(
    "worst_conditions",
    "T10",
    f"""WITH {PREDICTIONS_SQL}, s AS (SELECT model_id, campaign_brand, avg(cs_absolute_error_percent) AS mape
      FROM predictions GROUP BY ALL)
    SELECT model_id, campaign_brand, round(mape, 6) AS mape, rank FROM (SELECT *, CAST(row_number() OVER
      (PARTITION BY model_id ORDER BY mape DESC, campaign_brand) AS INTEGER) AS rank FROM s) WHERE rank <= 5""",
)
def worst_conditions(spark, sf_dir):
    summary = (
        predictions(spark, sf_dir)
        .groupBy("model_id", "campaign_brand")
        .agg(F.avg("cs_absolute_error_percent").alias("mape"))
    )
    return rounded(smp.top_per_group(summary, ["model_id"], [F.desc("mape"), "campaign_brand"], 5))


@query(
    "request_priority",
    "T13",
    f"""WITH {DEFICITS_SQL} SELECT cell_key, request_index, round(deficit_score, 6) AS deficit_score FROM (SELECT *,
      CAST(row_number() OVER (ORDER BY deficit_score DESC, sws_bin, frequency_bin, purity_bin, diffusivity_bin,
        discretization_bin) AS INTEGER) AS request_index FROM deficits WHERE NOT coverage_complete) WHERE request_index <= 50""",
)
def request_priority(spark, sf_dir):
    urgent = smp.first_requests(deficits(spark, sf_dir, include_complete=False), 50)
    return rounded(urgent.select("cell_key", "request_index", "deficit_score"))
