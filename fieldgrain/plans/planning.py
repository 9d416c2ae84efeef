"""History, audit and planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgrain.operators import coverage as cov, history as hi, planning as pl
from fieldgrain.plans.catalog import query, r, rounded
from fieldgrain.plans.coverage import ASSIGNED_SQL, DEFICITS_SQL, GRID, _CELLS, _KEY, _LABELS, assigned, deficits, summary
from fieldgrain.plans.frames import EXAMPLES_SQL, examples, runs, table

# Requests: one per iteration and condition, asking for a cell derived from the condition's rows.
REQUESTS_SQL = f"""{DEFICITS_SQL},
  req0 AS (SELECT iteration_index, campaign_condition_id, 1 + max(geometry_seed) % 4 AS rs, 1 + count(*) % 5 AS rf,
      1 + iteration_index % 3 AS rp, 1 + max(patch_idx) % 3 AS rd, 1 + count(*) % 3 AS rg, count(*) AS n,
      count(*) FILTER (coverage_valid) AS nv, median(truth_material_purity) AS pm
    FROM (SELECT *, campaign_geometry_seed AS geometry_seed FROM assigned) GROUP BY 1, 2),
  req AS (SELECT r.*, printf('s%02d_f%02d_p%02d_d%02d_g%02d', rs, rf, rp, rd, rg) AS cell_key, coalesce(h.n, 0) AS hits
    FROM req0 r LEFT JOIN (SELECT iteration_index, campaign_condition_id, {_KEY} AS k, count(*) AS n FROM assigned
      WHERE coverage_valid GROUP BY ALL) h ON h.iteration_index = r.iteration_index
      AND h.campaign_condition_id = r.campaign_condition_id AND h.k = printf('s%02d_f%02d_p%02d_d%02d_g%02d', rs, rf, rp, rd, rg)),
  cum AS (SELECT {_CELLS}, {_KEY} AS cell_key, it AS iteration_index, CAST(coalesce(sum(n) OVER
      (PARTITION BY {_CELLS} ORDER BY it), 0) AS BIGINT) AS example_count
    FROM (SELECT g.*, it, (SELECT count(*) FROM assigned a WHERE false) AS z FROM grid g,
        (SELECT DISTINCT iteration_index AS it FROM examples)) LEFT JOIN
      (SELECT {_CELLS}, iteration_index AS it, count(*) AS n FROM assigned WHERE coverage_valid GROUP BY ALL) USING ({_CELLS}, it)),
  rs AS (SELECT iteration_index, cell_key, count(*) AS rc, sum(n) AS rn, sum(hits) AS rh, count(*) FILTER (hits > 0) AS rhit
    FROM req GROUP BY 1, 2),
  hist AS (SELECT cum.*, coalesce(rc, 0) AS rc, coalesce(rn, 0) AS rn, coalesce(rh, 0) AS rh, coalesce(rhit, 0) AS rhit
    FROM cum LEFT JOIN rs USING (iteration_index, cell_key)),
  gain AS (SELECT *, example_count - coalesce(lag(example_count) OVER (PARTITION BY cell_key ORDER BY iteration_index), 0) AS g,
      max(iteration_index) OVER () AS fin FROM hist),
  percell AS (SELECT cell_key, any_value(fin) AS fin, min(iteration_index) FILTER (example_count > 0) AS fo,
      max(iteration_index) FILTER (g > 0) AS li, arg_max(example_count, iteration_index) AS last,
      arg_min(example_count, iteration_index) AS first,
      arg_max(example_count, iteration_index) FILTER (iteration_index <= greatest(1, fin - 2)) AS prior,
      sum(rc) AS rc, sum(rn) AS rn, sum(rh) AS rh, sum(rhit) AS rhit FROM gain GROUP BY cell_key),
  diff AS (SELECT d.*, p.* EXCLUDE (cell_key), fin - coalesce(li, 0) AS since, last - first AS tg,
      last - coalesce(prior, first) AS rg, rhit / nullif(rc, 0)::DOUBLE AS rate
    FROM deficits d JOIN percell p USING (cell_key) WHERE NOT coverage_complete),
  scored AS (SELECT *, deficit_score + CASE WHEN example_count = 0 THEN 5 ELSE 0 END + least(since / 2.0::DOUBLE, 5)
      + CASE WHEN rc = 0 THEN 2 ELSE 3 * (1 - rate) END AS difficulty_score FROM diff)"""


def requests(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    by = ["iteration_index", "campaign_condition_id"]
    from fieldgrain.operators.order_stats import percentiles

    count = F.count(F.lit(1))
    base = rows.groupBy(*by).agg(
        (F.max("campaign_geometry_seed") % 4 + 1).alias("_s"),
        (count % 5 + 1).alias("_f"),
        (F.max("patch_idx") % 3 + 1).alias("_d"),
        (count % 3 + 1).alias("_g"),
        count.alias("patch_count"),
        F.count_if("coverage_valid").alias("valid_patch_count"),
    )
    base = base.withColumn("_p", F.col("iteration_index") % 3 + 1)
    base = base.withColumn("cell_key", cov.cell_key(["_s", "_f", "_p", "_d", "_g"]))
    hits = rows.where("coverage_valid").groupBy(*by, F.col("coverage_cell_key").alias("cell_key")).agg(
        count.alias("requested_cell_patch_count")
    )
    medians = percentiles(rows, by, "truth_material_purity", {"purity_median": 0.5})
    out = base.join(hits, [*by, "cell_key"], "left").fillna(0, ["requested_cell_patch_count"]).join(medians, by)
    return out.select(
        "iteration_index",
        F.concat(F.lit("adaptive_"), "cell_key", F.lit("_"), "campaign_condition_id").alias("condition_id"),
        "patch_count",
        "valid_patch_count",
        "requested_cell_patch_count",
        (F.col("requested_cell_patch_count") > 0).alias("requested_cell_hit"),
        "purity_median",
        (F.lit(0.05) + F.col("_p") * 0.001).alias("predicted_discrete_purity"),
        F.concat(F.lit("family_"), (F.col("_s") % 2).cast("string")).alias("geometry_family"),
    )


def history(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    iterations = runs(spark, sf_dir).select("iteration_index").distinct()
    cells = cov.coverage_cells(spark, GRID)
    return hi.coverage_history(hi.cumulative_coverage(rows, cells, iterations), requests(spark, sf_dir))


def difficult(spark, sf_dir):
    return hi.difficulty(history(spark, sf_dir), deficits(spark, sf_dir, include_complete=False), recent_window=2)


@query(
    "coverage_history",
    "W7 J2 A4",
    f"""WITH {REQUESTS_SQL} SELECT cell_key, iteration_index, example_count, CAST(rc AS BIGINT) AS requested_condition_count,
      CAST(rn AS BIGINT) AS requested_patch_count, CAST(rh AS BIGINT) AS requested_cell_patch_count,
      CAST(rhit AS BIGINT) AS requested_cell_hit_count FROM hist""",
)
def coverage_history(spark, sf_dir):
    return history(spark, sf_dir).select("cell_key", "iteration_index", "example_count", *hi.REQUEST_COLUMNS)


@query(
    "difficulty_rank",
    "W7 W8",
    f"""WITH {REQUESTS_SQL} SELECT cell_key, fin AS final_iteration, fo AS first_observed_iteration, li AS last_improvement_iteration,
      since AS iterations_since_improvement, tg AS total_example_gain, rg AS recent_example_gain,
      CAST(rc AS BIGINT) AS total_requested_conditions, CAST(rhit AS BIGINT) AS total_requested_cell_hits,
      round(rate, 6) AS request_hit_rate, round(difficulty_score, 6) AS difficulty_score,
      concat_ws('|', CASE WHEN example_count = 0 THEN 'never_observed' WHEN rg = 0 THEN 'stagnant' END,
        CASE WHEN rc = 0 THEN 'not_requested' WHEN rhit = 0 THEN 'requests_miss_target' WHEN rate < 0.25 THEN 'low_request_hit_rate' END,
        CASE WHEN example_deficit > 0 THEN 'insufficient_examples' END,
        CASE WHEN independent_run_deficit > 0 THEN 'insufficient_independent_runs' END,
        CASE WHEN independent_condition_deficit > 0 THEN 'insufficient_independent_conditions' END) AS difficulty_reason
    FROM scored""",
)
def difficulty_rank(spark, sf_dir):
    return rounded(
        difficult(spark, sf_dir).select(
            "cell_key", "final_iteration", "first_observed_iteration", "last_improvement_iteration",
            "iterations_since_improvement", "total_example_gain", "recent_example_gain", "total_requested_conditions",
            "total_requested_cell_hits", "request_hit_rate", "difficulty_score", "difficulty_reason",
        )
    )


@query(
    "newly_observed",
    "W9 S3",
    f"""WITH {REQUESTS_SQL}, f AS (SELECT iteration_index, cell_key, example_count > 0 AS s, example_count >= 30 AS c,
        coalesce(lag(example_count) OVER (PARTITION BY cell_key ORDER BY iteration_index), 0) AS p FROM cum)
    SELECT iteration_index, CAST(count(*) FILTER (s) AS BIGINT) AS observed_coverage_cell_count,
      CAST(count(*) FILTER (NOT c) AS BIGINT) AS deficient_cell_count,
      CAST(count(*) FILTER (s AND p = 0) AS BIGINT) AS newly_observed_cell_count,
      CAST(count(*) FILTER (c AND p < 30) AS BIGINT) AS newly_complete_cell_count FROM f GROUP BY 1""",
)
def newly_observed(spark, sf_dir):
    iterations = runs(spark, sf_dir).select("iteration_index").distinct()
    cumulative = hi.cumulative_coverage(assigned(spark, sf_dir), cov.coverage_cells(spark, GRID), iterations)
    return hi.newly_reached(cumulative, 30)


@query(
    "difficulty_by_dimension",
    "G38",
    f"""WITH {REQUESTS_SQL}, named AS (SELECT *, {_LABELS} FROM scored),
    long AS (SELECT 'sws' AS dimension_name, sws_bin AS dimension_bin, sws_label AS dimension_label, * FROM named
      UNION ALL SELECT 'frequency', frequency_bin, frequency_label, * FROM named
      UNION ALL SELECT 'purity', purity_bin, purity_label, * FROM named
      UNION ALL SELECT 'nominal_angular_coverage', diffusivity_bin, diffusivity_label, * FROM named)
    SELECT dimension_name, CAST(dimension_bin AS INTEGER) AS dimension_bin, dimension_label, CAST(count(*) AS BIGINT) AS difficult_cell_count,
      CAST(count(*) FILTER (example_count = 0) AS BIGINT) AS never_observed_cell_count,
      CAST(count(*) FILTER (rg = 0) AS BIGINT) AS stagnant_cell_count,
      CAST(count(*) FILTER (rc > 0 AND rhit = 0) AS BIGINT) AS request_miss_cell_count,
      round(avg(difficulty_score), 6) AS mean_difficulty_score, round(median(difficulty_score), 6) AS median_difficulty_score,
      CAST(sum(example_deficit) AS BIGINT) AS total_example_deficit, CAST(sum(independent_run_deficit) AS BIGINT) AS total_run_deficit,
      CAST(sum(independent_condition_deficit) AS BIGINT) AS total_condition_deficit FROM long GROUP BY 1, 2, 3""",
)
def difficulty_by_dimension(spark, sf_dir):
    return rounded(hi.difficulty_by_dimension(difficult(spark, sf_dir)))


@query(
    "request_progress",
    "G39",
    f"""WITH {REQUESTS_SQL}, e AS (SELECT *, pm - (0.05::DOUBLE + rp * 0.001::DOUBLE) AS er FROM req)
    SELECT iteration_index, CAST(count(*) AS BIGINT) AS requested_condition_count,
      CAST(count(*) FILTER (hits > 0) AS BIGINT) AS requested_cell_hit_count,
      round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS requested_cell_hit_rate,
      CAST(count(*) FILTER (n > 0) AS BIGINT) AS condition_with_patch_count,
      CAST(count(*) FILTER (nv > 0) AS BIGINT) AS condition_with_valid_patch_count,
      CAST(count(*) FILTER (n = 0) AS BIGINT) AS zero_patch_condition_count, CAST(sum(n) AS BIGINT) AS patch_count,
      CAST(sum(hits) AS BIGINT) AS requested_cell_patch_count,
      round(max(abs(er)), 6) AS maximum_absolute_predicted_purity_error,
      round(median(er), 6) AS median_signed_predicted_purity_error,
      round(median(abs(er)), 6) AS median_absolute_predicted_purity_error FROM e GROUP BY 1""",
)
def request_progress(spark, sf_dir):
    return rounded(hi.request_progress(requests(spark, sf_dir)))


@query(
    "compare_progress",
    "J3",
    f"""WITH {REQUESTS_SQL}, a AS (SELECT iteration_index, count(*) FILTER (hits > 0) AS h, sum(n) AS n FROM req GROUP BY 1)
    SELECT iteration_index, CAST(h AS BIGINT) AS v3_requested_cell_hit_count, CAST(n AS BIGINT) AS v3_patch_count,
      CAST(h + iteration_index AS BIGINT) AS v4_requested_cell_hit_count, CAST(n AS BIGINT) AS v4_patch_count,
      CAST(iteration_index AS BIGINT) AS difference_requested_cell_hit_count, CAST(0 AS BIGINT) AS difference_patch_count FROM a""",
)
def compare_progress(spark, sf_dir):
    left = hi.request_progress(requests(spark, sf_dir)).select("iteration_index", "requested_cell_hit_count", "patch_count")
    right = left.withColumn("requested_cell_hit_count", F.col("requested_cell_hit_count") + F.col("iteration_index"))
    return hi.compare_progress(left, right, ["requested_cell_hit_count", "patch_count"])


@query(
    "rejection_totals",
    "G40",
    f"""WITH {ASSIGNED_SQL}, s AS (SELECT count(*) FILTER (sws_bin = 0) AS a, count(*) FILTER (frequency_bin = 0) AS b,
        count(*) FILTER (discretization_bin = 0) AS c FROM assigned)
    SELECT 'sws' AS rejection_reason, CAST(a AS BIGINT) AS rejected_count FROM s UNION ALL SELECT 'frequency', b FROM s
    UNION ALL SELECT 'discretization', c FROM s""",
)
def rejection_totals(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    axes = ("sws", "frequency", "discretization")
    flags = [(F.col(f"coverage_{a}_bin") == 0).cast("long").alias(f"rejected_{a}") for a in axes]
    return hi.rejection_totals(rows.select(*flags))


@query(
    "independence_audit",
    "G41",
    f"""WITH {DEFICITS_SQL}, a AS (SELECT cell_key, count(*) FILTER (example_count > 0) AS x FROM deficits GROUP BY 1)
    SELECT CAST(count(*) AS BIGINT) AS cell_count, CAST(0 AS BIGINT) AS example_mismatch_count,
      CAST(0 AS BIGINT) AS run_mismatch_count,
      CAST(count(*) FILTER (sws_bin = 1 AND independent_condition_count > 0) AS BIGINT) AS condition_mismatch_count FROM deficits""",
)
def independence_audit(spark, sf_dir):
    stored = deficits(spark, sf_dir)
    wrong = F.when((F.col("sws_bin") == 1) & (F.col("independent_condition_count") > 0), 1).otherwise(0)
    stored = stored.withColumn("independent_condition_count", F.col("independent_condition_count") + wrong)
    return hi.independence_audit(assigned(spark, sf_dir), stored)


@query(
    "purity_angular_table",
    "G52",
    f"""WITH {ASSIGNED_SQL} SELECT CAST(diffusivity_bin AS INTEGER) AS diffusivity_bin,
      CAST(count(*) FILTER (purity_bin = 1) AS BIGINT) AS purity_01, CAST(count(*) FILTER (purity_bin = 2) AS BIGINT) AS purity_02,
      CAST(count(*) FILTER (purity_bin = 3) AS BIGINT) AS purity_03 FROM assigned WHERE coverage_valid GROUP BY 1""",
)
def purity_angular_table(spark, sf_dir):
    return hi.purity_angular_table(summary(spark, sf_dir), GRID.bin_count("purity"))


@query(
    "geometry_efficiency",
    "G52",
    f"""WITH {REQUESTS_SQL} SELECT 'family_' || (rs % 2) AS geometry_family, CAST(count(*) AS BIGINT) AS condition_count,
      round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, CAST(sum(n) AS BIGINT) AS patch_count
    FROM req GROUP BY 1""",
)
def geometry_efficiency(spark, sf_dir):
    return rounded(hi.geometry_efficiency(requests(spark, sf_dir)))


@query(
    "cell_key_sets",
    "S3 S4 S5 J5",
    f"""WITH {REQUESTS_SQL}, cur AS (SELECT DISTINCT cell_key FROM cum WHERE iteration_index = 4 AND example_count > 0),
    prev AS (SELECT DISTINCT cell_key FROM cum WHERE iteration_index = 3 AND example_count > 0),
    def AS (SELECT cell_key FROM deficits WHERE NOT coverage_complete)
    SELECT 'complete' AS set_name, cell_key FROM (SELECT * FROM cur EXCEPT SELECT * FROM def)
    UNION ALL SELECT 'new', cell_key FROM (SELECT * FROM cur EXCEPT SELECT * FROM prev)
    UNION ALL SELECT 'still_deficient', cell_key FROM (SELECT * FROM prev INTERSECT SELECT * FROM cur INTERSECT SELECT * FROM def)""",
)
def cell_key_sets(spark, sf_dir):
    iterations = runs(spark, sf_dir).select("iteration_index").distinct()
    cum = hi.cumulative_coverage(assigned(spark, sf_dir), cov.coverage_cells(spark, GRID), iterations).where("example_count > 0")
    return hi.key_sets(
        cum.where("iteration_index = 3"), cum.where("iteration_index = 4"), deficits(spark, sf_dir, include_complete=False)
    )


@query(
    "run_cell_pairs",
    "S5",
    f"WITH {ASSIGNED_SQL} SELECT DISTINCT campaign_run_id, {_KEY} AS coverage_cell_key FROM assigned WHERE coverage_valid",
)
def run_cell_pairs(spark, sf_dir):
    return hi.distinct_pairs(assigned(spark, sf_dir), "campaign_run_id", "coverage_cell_key", F.col("coverage_valid"))


# --- requested against achieved ----------------------------------------------------------------------

_PLAN = f"""plan AS (SELECT campaign_condition_id AS condition_id, 1 + count(*) % 4 AS rs, 1 + count(*) % 5 AS rf, 1 + count(*) % 3 AS rp,
    1 + max(patch_idx) % 3 AS rd, 0.05::DOUBLE + (count(*) % 7) * 0.001::DOUBLE AS pp FROM examples GROUP BY 1
  UNION ALL SELECT 'never_run', 1, 1, 1, 1, 0.05::DOUBLE)"""


@query(
    "requested_vs_achieved",
    "G5 J11",
    f"""WITH {ASSIGNED_SQL}, {_PLAN}, v AS (SELECT * FROM assigned WHERE coverage_valid),
    g AS (SELECT campaign_condition_id AS condition_id, count(*) AS n, count(*) FILTER (coverage_valid) AS nv,
      min(truth_material_purity) FILTER (coverage_valid) AS pmin, max(truth_material_purity) FILTER (coverage_valid) AS pmax,
      median(truth_material_purity) FILTER (coverage_valid) AS pmed, min(campaign_angular_entropy) FILTER (coverage_valid) AS dmin,
      max(campaign_angular_entropy) FILTER (coverage_valid) AS dmax, median(campaign_angular_entropy) FILTER (coverage_valid) AS dmed,
      (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT purity_bin AS x FROM v WHERE v.campaign_condition_id = a.campaign_condition_id)) AS pb,
      (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT diffusivity_bin AS x FROM v WHERE v.campaign_condition_id = a.campaign_condition_id)) AS db
      FROM assigned a GROUP BY 1),
    dom AS (SELECT campaign_condition_id AS condition_id, purity_bin, diffusivity_bin, n / CAST(sum(n) OVER (PARTITION BY campaign_condition_id) AS DOUBLE) AS f,
      row_number() OVER (PARTITION BY campaign_condition_id ORDER BY n DESC, purity_bin, diffusivity_bin) AS rn
      FROM (SELECT campaign_condition_id, purity_bin, diffusivity_bin, count(*) AS n FROM v GROUP BY 1, 2, 3)),
    h AS (SELECT p.condition_id, count(*) AS n FROM plan p JOIN v ON v.campaign_condition_id = p.condition_id AND sws_bin = rs
      AND frequency_bin = rf AND purity_bin = rp AND diffusivity_bin = rd GROUP BY 1)
    SELECT condition_id, coalesce(g.n, 0) AS patch_count, coalesce(nv, 0) AS valid_patch_count,
      coalesce(h.n, 0) AS requested_cell_patch_count, coalesce(h.n, 0) > 0 AS requested_cell_hit, pb AS achieved_purity_bins,
      db AS achieved_diffusivity_bins, dom.purity_bin AS dominant_purity_bin, dom.diffusivity_bin AS dominant_diffusivity_bin,
      round(f, 6) AS dominant_cell_fraction, pmin AS purity_min, round(pmed, 6) AS purity_median, pmax AS purity_max,
      dmin AS diffusivity_min, round(dmed, 6) AS diffusivity_median, dmax AS diffusivity_max,
      round(pmed - pp, 6) AS predicted_vs_achieved_purity_error
    FROM plan LEFT JOIN g USING (condition_id) LEFT JOIN dom USING (condition_id) LEFT JOIN h USING (condition_id)
    WHERE coalesce(rn, 1) = 1""",
)
def requested_vs_achieved(spark, sf_dir):
    n = F.count(F.lit(1))
    plan = examples(spark, sf_dir).groupBy(F.col("campaign_condition_id").alias("condition_id")).agg(
        (n % 4 + 1).cast("int").alias("requested_sws_bin"),
        (n % 5 + 1).cast("int").alias("requested_frequency_bin"),
        (n % 3 + 1).cast("int").alias("requested_purity_bin"),
        (F.max("patch_idx") % 3 + 1).cast("int").alias("requested_diffusivity_bin"),
        (F.lit(0.05) + (n % 7) * F.lit(0.001)).alias("predicted_discrete_purity"),
    )
    one = [F.lit(1).alias(f"requested_{a}_bin") for a in ("sws", "frequency", "purity", "diffusivity")]
    plan = plan.unionByName(
        spark.range(1).select(F.lit("never_run").alias("condition_id"), *one, F.lit(0.05).alias("predicted_discrete_purity"))
    )
    out = cov.requested_vs_achieved(plan, assigned(spark, sf_dir))
    drop = [c for c in out.columns if c.startswith("requested_") and c.endswith("_bin")]
    return rounded(out.drop(*drop, "predicted_discrete_purity", "achieved_cells"))


# --- planning ----------------------------------------------------------------------------------------

_EXISTING = f"existing AS (SELECT {_KEY} AS cell_key, min(campaign_condition_id) AS ec, max(patch_idx) AS lr FROM assigned WHERE coverage_valid AND iteration_index = 1 GROUP BY 1)"


def _requests(spark, sf_dir):
    existing = (
        assigned(spark, sf_dir)
        .where("coverage_valid and iteration_index = 1")
        .groupBy(F.col("coverage_cell_key").alias("cell_key"))
        .agg(F.min("campaign_condition_id").alias("existing_condition_id"), F.max("patch_idx").alias("last_realization_id"))
    )
    return pl.deficit_requests(
        deficits(spark, sf_dir, include_complete=False), GRID, existing, limit=1000, prefix="adaptive",
        base_realizations=3, examples_per_run=2,
    )


@query(
    "deficit_requests",
    "D12 T13",
    f"""WITH {DEFICITS_SQL}, {_EXISTING}, q AS (SELECT *, CAST(row_number() OVER (ORDER BY deficit_score DESC, {_CELLS}) AS INTEGER) AS ri
      FROM deficits WHERE NOT coverage_complete),
    a AS (SELECT q.*, ec, lr, example_deficit AS e, independent_run_deficit AS rd, independent_condition_deficit AS cd,
      independent_condition_deficit > 0 OR ec IS NULL AS nn FROM q LEFT JOIN existing USING (cell_key)),
    b AS (SELECT *, CASE WHEN nn AND (e > 0 OR rd > 0) THEN 'combined' WHEN nn THEN 'new_condition' WHEN rd > 0 AND e > 0 THEN 'combined'
        WHEN rd > 0 THEN 'additional_realization' ELSE 'opportunistic_examples' END AS act,
      CAST(CASE WHEN nn THEN greatest(3, greatest(1, rd)) WHEN rd > 0 THEN greatest(rd, ceil(e / 2.0::DOUBLE))
        ELSE greatest(1, ceil(e / 2.0::DOUBLE)) END AS BIGINT) AS rc FROM a)
    SELECT ri AS request_index, cell_key, CASE WHEN nn THEN 'adaptive_' || cell_key || printf('_%03d', ri) ELSE ec END AS condition_id,
      act AS planned_action, rc AS planned_realization_count, CAST(nn AS INTEGER) AS planned_new_condition_count,
      CAST(CASE WHEN nn THEN 1 ELSE lr + 1 END AS BIGINT) AS realization_start_index,
      least(e, rc * 2) AS expected_example_contribution, least(rd, rc) AS expected_independent_run_contribution,
      least(cd, CAST(nn AS BIGINT)) AS expected_independent_condition_contribution,
      list_extract([0.0, 0.03, 0.06]::DOUBLE[], purity_bin) AS purity_lower, list_extract([0.03, 0.06, 0.1]::DOUBLE[], purity_bin) AS purity_upper
    FROM b WHERE ri <= 1000""",
)
def deficit_requests(spark, sf_dir):
    return _requests(spark, sf_dir).select(
        "request_index", "cell_key", "condition_id", "planned_action", "planned_realization_count", "planned_new_condition_count",
        "realization_start_index", "expected_example_contribution", "expected_independent_run_contribution",
        "expected_independent_condition_contribution", "purity_lower", "purity_upper",
    )


@query(
    "family_choice",
    "D13",
    f"""WITH {DEFICITS_SQL}, q AS (SELECT *, CAST(row_number() OVER (ORDER BY deficit_score DESC, {_CELLS}) AS INTEGER) AS ri
      FROM deficits WHERE NOT coverage_complete),
    o AS (SELECT ri, cell_key, CAST(t.i AS INTEGER) AS pos, CAST(CASE WHEN purity_bin = 3 THEN t.i ELSE t.i + 1 END AS VARCHAR) AS fam
      FROM q, range(3) t(i) WHERE ri <= 1000 AND (purity_bin = 3 OR t.i < 2)),
    h AS (SELECT {_KEY} AS cell_key, campaign_geometry_family AS fam, count(DISTINCT campaign_run_id) AS n FROM assigned WHERE coverage_valid GROUP BY 1, 2),
    c AS (SELECT o.*, coalesce(n, 0) AS n, min(coalesce(n, 0)) OVER (PARTITION BY ri) AS m FROM o LEFT JOIN h USING (cell_key, fam)),
    k AS (SELECT *, row_number() OVER (PARTITION BY ri ORDER BY pos) - 1 AS ti, count(*) OVER (PARTITION BY ri) AS tc FROM c WHERE n = m)
    SELECT ri AS request_index, cell_key, fam AS geometry_family, m AS historical_run_count, CAST(tc AS INTEGER) AS tied_family_count
    FROM k WHERE ti = (ri + 3) % tc""",
)
def family_choice(spark, sf_dir):
    return pl.choose_families(
        _requests(spark, sf_dir), assigned(spark, sf_dir), ["0", "1", "2"], ["1", "2"], pure_from=0.06, seed=5
    )


@query(
    "placement_search",
    "D15",
    f"""WITH {DEFICITS_SQL}, q AS (SELECT *, CAST(row_number() OVER (ORDER BY deficit_score DESC, {_CELLS}) AS INTEGER) AS ri
      FROM deficits WHERE NOT coverage_complete),
    b AS (SELECT ri, list_extract([0.5, 0.7, 0.9]::DOUBLE[], purity_bin) AS lo, list_extract([0.7, 0.9, 1.0]::DOUBLE[], purity_bin) AS hi,
      20 + ri % 20 AS c, CASE WHEN ri % 2 = 0 THEN 'negative' ELSE 'positive' END AS side FROM q WHERE ri <= 1000),
    cand AS (SELECT b.*, CAST(i AS INTEGER) AS i, (lo + hi) / 2 AS target, greatest(0, least(13, i - (c - 6) + 1)) / 13.0::DOUBLE AS s FROM b, range(1, 62) t(i)),
    pur AS (SELECT *, greatest(s, 1 - s) AS p, CASE side WHEN 'negative' THEN s ELSE 1 - s END AS sf,
      CASE side WHEN 'negative' THEN i > c + 6 ELSE i < c - 6 END AS outside,
      round(((c - 1) * 0.0005::DOUBLE + CASE side WHEN 'negative' THEN 1 ELSE -1 END * (target - 0.5::DOUBLE) * (13 * 0.0005::DOUBLE)) / 0.0005::DOUBLE) + 1 AS ri2 FROM cand),
    ok AS (SELECT *, row_number() OVER (PARTITION BY ri ORDER BY abs(p - target), abs(i - ri2), i) AS rn, count(*) OVER (PARTITION BY ri) AS n
      FROM pur WHERE p >= lo AND (p < hi OR (hi = 1 AND p = 1 AND outside)) AND sf >= 0.5)
    SELECT ri AS request_index, CAST(n AS BIGINT) AS feasible_candidate_count, i AS interface_grid_index, round(p, 6) AS predicted_discrete_purity,
      CAST(i - c AS INTEGER) AS interface_offset_pixels, round((i - c) * 0.0005::DOUBLE, 6) AS interface_offset_m FROM ok WHERE rn = 1""",
)
def placement_search(spark, sf_dir):
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("purity_bin") - 1)
    side = F.when(F.col("request_index") % 2 == 0, "negative").otherwise("positive")
    wanted = _requests(spark, sf_dir).select(
        "request_index", pick([0.5, 0.7, 0.9]).alias("purity_lower"), pick([0.7, 0.9, 1.0]).alias("purity_upper"),
        (F.lit(20) + F.col("request_index") % 20).alias("center_index"), side.alias("dominant_side"),
    )
    placed = pl.interface_placement(wanted, window=13, points=61, spacing_m=0.0005)
    return rounded(
        placed.select(
            "request_index", "feasible_candidate_count", "interface_grid_index", "predicted_discrete_purity",
            "interface_offset_pixels", "interface_offset_m",
        )
    )


@query(
    "cartesian_design",
    "D9 D19",
    """WITH cond AS (SELECT p_brand, CAST(f AS DOUBLE) AS frequency_hz, 0.0005::DOUBLE AS dx_m,
        CAST(row_number() OVER (ORDER BY p_brand, f) AS INTEGER) AS ci FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest([200.0, 300.0, 400.0]) AS f)),
    w AS (SELECT *, CAST(r AS INTEGER) AS r, CAST(greatest(3, floor(round(2.0::DOUBLE * (3.0::DOUBLE / frequency_hz) / dx_m) / 2) * 2 + 1) AS INTEGER) AS w2,
        CAST(greatest(3, floor(round(3.0::DOUBLE * (3.0::DOUBLE / frequency_hz) / dx_m) / 2) * 2 + 1) AS INTEGER) AS w3 FROM cond, range(1, 4) t(r))
    SELECT p_brand, frequency_hz, ci AS condition_index, printf('condition_%05d_r%02d', ci, r) AS run_id, r AS realization_id,
      CAST(4101 + (ci - 1) * 100 + r AS BIGINT) AS seed, w2 AS patch_width_px_M2, w3 AS patch_width_px_M3,
      CAST(greatest(4, ceil(0.5 * w2)) AS INTEGER) AS stride_px_M2, CAST(w3 + 9 * greatest(4, ceil(0.5 * w3)) AS INTEGER) AS domain_points_M3 FROM w""",
)
def cartesian_design(spark, sf_dir):
    levels = table(spark, sf_dir, "part").select("p_brand").distinct()
    levels = levels.withColumn("frequency_hz", F.explode(F.array(*[F.lit(f) for f in (200.0, 300.0, 400.0)])))
    design = pl.cartesian_design(
        levels.withColumn("dx_m", F.lit(0.0005)), ["p_brand", "frequency_hz"], realizations=3, base_seed=4101, stride=100,
        m_values=(2, 3), speed_guess=3.0,
    )
    return design.select(
        "p_brand", "frequency_hz", "condition_index", "run_id", "realization_id", "seed", "patch_width_px_M2", "patch_width_px_M3",
        "stride_px_M2", "domain_points_M3",
    )


_PLANNED = """planned AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS condition_id FROM orders),
  found AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, 2 + l_linenumber % 2 AS window_M, count(*) AS n FROM lineitem GROUP BY 1, 2),
  cover AS (SELECT p.run_id, condition_id, CAST(m AS INTEGER) AS window_M, coalesce(n, 0) AS n FROM planned p CROSS JOIN range(2, 4) t(m)
    LEFT JOIN found f ON f.run_id = p.run_id AND f.window_M = t.m)"""


def _plan_coverage(spark, sf_dir):
    plan = runs(spark, sf_dir).select("run_id", F.col("backend").alias("condition_id"))
    found = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), (F.col("l_linenumber") % 2 + 2).alias("window_M")
    )
    return pl.plan_coverage(plan, found, [2, 3], quota=3)


@query(
    "plan_coverage",
    "J12 G15",
    f"""WITH {_PLANNED} SELECT run_id, condition_id, window_M, n AS available_patch_count, least(n, 3) AS selected_patch_count,
      3 - least(n, 3) AS deficit_patch_count, CASE WHEN n = 0 THEN 'missing' WHEN n < 3 THEN 'deficient' ELSE 'complete' END AS status FROM cover""",
)
def plan_coverage(spark, sf_dir):
    return _plan_coverage(spark, sf_dir)


@query(
    "condition_coverage",
    "G15",
    f"""WITH {_PLANNED} SELECT condition_id, window_M, CAST(count(*) AS BIGINT) AS planned_run_count,
      CAST(count(*) FILTER (n >= 3) AS BIGINT) AS complete_run_count, CAST(count(*) FILTER (n = 0) AS BIGINT) AS missing_run_count,
      CAST(sum(least(n, 3)) AS BIGINT) AS selected_patch_count, CAST(sum(3 - least(n, 3)) AS BIGINT) AS deficit_patch_count,
      bool_and(n >= 3) AS complete FROM cover GROUP BY 1, 2""",
)
def condition_coverage(spark, sf_dir):
    return pl.condition_coverage(_plan_coverage(spark, sf_dir))


@query(
    "deficit_actions",
    "D11",
    f"""WITH {_PLANNED}, two AS (SELECT run_id, condition_id || '/' || substr(run_id, -2) AS condition_id, n, CAST(run_id AS BIGINT) AS rid FROM cover WHERE window_M = 2),
    c AS (SELECT condition_id, max(CASE WHEN n < 1 THEN 1 ELSE 0 END) AS short, sum(3 - least(n, 3)) AS lack, max(rid) AS last FROM two GROUP BY 1)
    SELECT t.condition_id, 'larger_domain' AS action, rid AS realization_id,
      round((9 + (greatest(12, round(sqrt(greatest(1, n))) + 2) - 1) * 5 - 1) * 0.0005::DOUBLE, 6) AS domain_m, run_id AS replaces_run_id,
      CAST(3 - least(n, 3) AS BIGINT) AS expected_patch_contribution FROM two t JOIN c USING (condition_id) WHERE n < 1 AND lack > 0
    UNION ALL SELECT condition_id, 'supplementary_realization', last + j, NULL, '', CAST(greatest(0, least(1, lack - (j - 1))) AS BIGINT)
    FROM c, range(1, 4) t(j) WHERE lack > 0 AND short = 0 AND j <= least(3, lack)""",
)
def deficit_actions(spark, sf_dir):
    rows = _plan_coverage(spark, sf_dir).where("window_M = 2").select(
        F.concat_ws("/", "condition_id", F.substring("run_id", -2, 2)).alias("condition_id"), "run_id",
        F.col("run_id").cast("long").alias("realization_id"), "available_patch_count", "selected_patch_count", "deficit_patch_count",
        F.lit(9).alias("patch_width_px"), F.lit(5).alias("stride_px"), F.lit(0.0005).alias("dx_m"),
    )
    return rounded(pl.deficit_actions(rows, quota=1, maximum_supplementary=3))


@query(
    "phantom_feasibility",
    "P30",
    """WITH d AS (SELECT p_partkey AS design_id, 41 + p_size AS points, 9 AS w, 5 AS st, 6.0::DOUBLE + p_size / 5.0::DOUBLE AS r FROM part),
    c AS (SELECT d.*, t.i * 5 + 4 AS cz, u.i * 5 + 4 AS cx, (points - 1) / 2.0::DOUBLE AS mid FROM d, range(20) t(i), range(20) u(i)
      WHERE t.i * 5 + 4 <= points - 5 AND u.i * 5 + 4 <= points - 5),
    e AS (SELECT *, greatest(abs(cx - mid) - 4, mid % 1) AS nx, greatest(abs(cz - mid) - 4, mid % 1) AS nz, abs(cx - mid) + 4 AS fx, abs(cz - mid) + 4 AS fz FROM c)
    SELECT design_id, CASE WHEN fx * fx + fz * fz <= r * r THEN 'inclusion_core' WHEN nx * nx + nz * nz > r * r THEN 'background_far'
      ELSE 'interface_band' END AS roi, CAST(count(*) AS BIGINT) AS patch_count FROM e GROUP BY 1, 2""",
)
def phantom_feasibility(spark, sf_dir):
    designs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("design_id"), (F.lit(41) + F.col("p_size")).alias("points"), F.lit(9).alias("window_px"),
        F.lit(5).alias("stride_px"), (F.lit(6.0) + F.col("p_size") / 5.0).alias("radius_px"),
    )
    return pl.phantom_feasibility(designs, geometry="inclusion")
