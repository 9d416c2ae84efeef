"""Patch-shaped frames derived from the given tables, in Spark and as SQL text for the check.

Each frame is a projection (plus key joins) over whole tables, so every query
built on it grows with the data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldgrain.functions.semantics import ratio


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- examples: one row per analysis window -------------------------------------------------------

EXAMPLES_SQL = """examples AS (
  SELECT concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS example_id,
         CAST(l_orderkey AS VARCHAR) AS campaign_run_id,
         concat_ws('__', o_orderpriority, o_orderstatus, year(o_orderdate)) AS campaign_condition_id,
         CAST(l_suppkey % 3 AS VARCHAR) AS campaign_geometry_family,
         l_suppkey AS campaign_geometry_seed,
         l_extendedprice AS truth_cs_center_m_s,
         l_quantity AS campaign_frequency_hz,
         l_discount AS truth_material_purity,
         l_tax AS campaign_angular_entropy,
         l_linenumber * l_linenumber AS campaign_direction_count,
         l_tax * 150.0::DOUBLE AS campaign_solid_angle_sr,
         l_linenumber * 1e-4::DOUBLE AS GRID_dx_m,
         l_linenumber * 1e-4::DOUBLE AS GRID_dz_m,
         l_linenumber AS patch_idx,
         l_returnflag AS model_id,
         year(o_orderdate) - 1994 AS iteration_index,
         l_partkey AS part_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def examples(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """All examples, or those of the given ``o_orderkey``: these meet the orders before any line does.

    Lines stream past a hash table of their task's orders: sorting both sides took some ten times the bytes read.
    """
    line = table(spark, sf_dir, "lineitem")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    if orders is not None:
        order = order.join(orders, "o_orderkey", "left_semi")
    n = F.col("l_linenumber")
    return line.join(order.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("example_id"),
        F.col("l_orderkey").cast("string").alias("campaign_run_id"),
        F.concat_ws("__", "o_orderpriority", "o_orderstatus", F.year("o_orderdate")).alias("campaign_condition_id"),
        (F.col("l_suppkey") % 3).cast("string").alias("campaign_geometry_family"),
        F.col("l_suppkey").alias("campaign_geometry_seed"),
        F.col("l_extendedprice").alias("truth_cs_center_m_s"),
        F.col("l_quantity").alias("campaign_frequency_hz"),
        F.col("l_discount").alias("truth_material_purity"),
        F.col("l_tax").alias("campaign_angular_entropy"),
        (n * n).alias("campaign_direction_count"),
        (F.col("l_tax") * 150.0).alias("campaign_solid_angle_sr"),
        (n * F.lit(1e-4)).alias("GRID_dx_m"),
        (n * F.lit(1e-4)).alias("GRID_dz_m"),
        n.alias("patch_idx"),
        F.col("l_returnflag").alias("model_id"),
        (F.year("o_orderdate") - 1994).alias("iteration_index"),
        F.col("l_partkey").alias("part_id"),
    )


# --- predictions: one row per model and window ---------------------------------------------------

PREDICTIONS_SQL = """predictions_raw AS (
  SELECT concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS example_id,
         l_returnflag AS model_id,
         CASE WHEN l_orderkey % 20 < 14 THEN 'train' WHEN l_orderkey % 20 < 17 THEN 'validation' ELSE 'test' END
           AS partition,
         CAST(l_orderkey AS VARCHAR) AS campaign_run_id,
         l_quantity AS campaign_frequency_hz,
         p_size AS campaign_size,
         p_brand AS campaign_brand,
         l_linenumber AS campaign_direction_count,
         l_discount AS truth_material_purity,
         0.1::DOUBLE + 8.0::DOUBLE * l_discount AS q_true,
         0.1::DOUBLE + 8.0::DOUBLE * l_discount + 0.7320508075688772::DOUBLE * (l_tax - 0.04::DOUBLE) AS q_pred,
         p_retailprice AS cs_true_m_s,
         l_extendedprice / (2.718281828459045::DOUBLE * l_quantity) AS cs_pred_m_s,
         l_discount > 0.0::DOUBLE AS sws_valid
  FROM lineitem JOIN part ON l_partkey = p_partkey),
predictions AS (
  SELECT *, cs_pred_m_s - cs_true_m_s AS cs_error_m_s,
         100.0::DOUBLE * (cs_pred_m_s - cs_true_m_s) / cs_true_m_s AS cs_error_percent,
         abs(100.0::DOUBLE * (cs_pred_m_s - cs_true_m_s) / cs_true_m_s) AS cs_absolute_error_percent
  FROM predictions_raw)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    fold = F.col("l_orderkey") % 20
    raw = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("example_id"),
        F.col("l_returnflag").alias("model_id"),
        F.when(fold < 14, "train").when(fold < 17, "validation").otherwise("test").alias("partition"),
        F.col("l_orderkey").cast("string").alias("campaign_run_id"),
        F.col("l_quantity").alias("campaign_frequency_hz"),
        F.col("p_size").alias("campaign_size"),
        F.col("p_brand").alias("campaign_brand"),
        F.col("l_linenumber").alias("campaign_direction_count"),
        F.col("l_discount").alias("truth_material_purity"),
        (F.lit(0.1) + F.lit(8.0) * F.col("l_discount")).alias("q_true"),
        (F.lit(0.1) + F.lit(8.0) * F.col("l_discount") + F.lit(0.7320508075688772) * (F.col("l_tax") - F.lit(0.04))).alias(
            "q_pred"
        ),
        F.col("p_retailprice").alias("cs_true_m_s"),
        (F.col("l_extendedprice") / (F.lit(2.718281828459045) * F.col("l_quantity"))).alias("cs_pred_m_s"),
        (F.col("l_discount") > 0.0).alias("sws_valid"),
    )
    error = F.col("cs_pred_m_s") - F.col("cs_true_m_s")
    pct = F.lit(100.0) * error / F.col("cs_true_m_s")
    return raw.select(
        "*", error.alias("cs_error_m_s"), pct.alias("cs_error_percent"), F.abs(pct).alias("cs_absolute_error_percent")
    )


# --- spectra: radial power per window, as arrays (Spark) and long rows (SQL) -----------------------

SPECTRA_SQL = """spectra AS (
  SELECT vec_id AS example_id, label, CAST(bin AS INTEGER) AS bin, bin + 0.5::DOUBLE AS k,
         CAST(e AS DOUBLE) * CAST(e AS DOUBLE) AS srad, 100.0::DOUBLE * (label + 2) AS f0
  FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS bin FROM embeddings)),
ecum AS (
  SELECT *, sum(srad) OVER (PARTITION BY example_id ORDER BY bin) / sum(srad) OVER (PARTITION BY example_id) AS ecum
  FROM spectra)"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("example_id"),
        "label",
        (F.lit(100.0) * (F.col("label") + 2)).alias("f0"),
        F.transform(e, lambda x, i: i + F.lit(0.5)).alias("k_cent"),
        F.transform(e, lambda x: x * x).alias("srad"),
    )


# --- runs: the ledger ------------------------------------------------------------------------------

RUNS_SQL = """runs AS (
  SELECT o_orderkey AS ordinal, CAST(o_orderkey AS VARCHAR) AS run_id,
         md5(CAST(o_orderkey AS VARCHAR)) AS hash_sha256,
         concat_ws('__', o_orderpriority, o_orderstatus, year(o_orderdate)) AS condition_id,
         o_orderpriority AS backend,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'skipped_completed' ELSE 'failed' END AS status,
         CASE WHEN o_totalprice > 50000 THEN 'completed_valid' ELSE 'completed_invalid' END AS outcome_status,
         CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE 1 END AS valid,
         o_totalprice AS frequency_hz,
         'runs/' || CAST(o_orderkey AS VARCHAR) AS wavefield_sample_path,
         year(o_orderdate) - 1994 AS iteration_index
  FROM orders)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ordinal"),
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.md5(F.col("o_orderkey").cast("string")).alias("hash_sha256"),
        F.concat_ws("__", "o_orderpriority", "o_orderstatus", F.year("o_orderdate")).alias("condition_id"),
        F.col("o_orderpriority").alias("backend"),
        F.when(status == "F", "completed").when(status == "O", "skipped_completed").otherwise("failed").alias("status"),
        F.when(F.col("o_totalprice") > 50000, "completed_valid")
        .otherwise("completed_invalid")
        .alias("outcome_status"),
        F.when(F.col("o_custkey") % 10 == 0, 0).otherwise(1).alias("valid"),
        F.col("o_totalprice").alias("frequency_hz"),
        F.concat(F.lit("runs/"), F.col("o_orderkey").cast("string")).alias("wavefield_sample_path"),
        (F.year("o_orderdate") - 1994).alias("iteration_index"),
    )


# --- map: dense-ish grids, 25 rows (user) by 32 columns (day) each ---------------------------------

MAP_SQL = """map AS (
  SELECT (user_id // 25) * 1000 + (day // 32) AS map_id, user_id % 25 AS iz, day % 32 AS ix,
         avg(value) AS value, max(material) AS material_id, CAST(count(*) AS BIGINT) AS weight
  FROM (SELECT user_id, value, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day,
               CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS material FROM events)
  GROUP BY user_id, day)"""


def value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day. Means of doubles differ in their last digit with the order in which they are summed, which
    decides whether cells that tie with a median lie above it; they are summed in the order of the events, as the SQL reads
    them. A cell's events are sorted in one task (the sort spills)."""
    events = table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        "value",
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"),
        (F.get_json_object("props", "$.k").cast("long") % 3).alias("material"),
    )
    order = Window.partitionBy("user_id", "day").orderBy("event_id", "value")
    upto = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = events.select("*", upto.alias("_sum"), F.row_number().over(order).alias("_at")).groupBy("user_id", "day").agg(
        ratio(F.max_by("_sum", "_at"), F.count("value")).alias("value"), F.max("material").alias("material_id"), F.count(F.lit(1)).alias("weight")
    )
    return cells.select(
        (F.floor(F.col("user_id") / 25) * 1000 + F.floor(F.col("day") / 32)).alias("map_id"),
        (F.col("user_id") % 25).alias("iz"),
        (F.col("day") % 32).alias("ix"),
        "value",
        "material_id",
        "weight",
    )


# --- scores: a graded score with a two-class truth --------------------------------------------------

SCORES_SQL = """scores AS (
  SELECT d.doc_id, lang AS group_id, CAST(n_chars AS DOUBLE) / (1000.0::DOUBLE + n_chars) AS score,
         CAST(quality AS INTEGER) AS truth, CAST(toxic AS INTEGER) AS harm
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.col("lang").alias("group_id"),
        (F.col("n_chars").cast("double") / (F.lit(1000.0) + F.col("n_chars"))).alias("score"),
        F.col("quality").cast("int").alias("truth"),
        F.col("toxic").cast("int").alias("harm"),
    )


# --- pixels: a two-wave field on a 21 x 21 grid per supplier -----------------------------------------

GRID = 21
SPACING_M = 0.5e-3

PIXELS_SQL = f"""samples AS (
  SELECT s_suppkey AS sample_id, 200.0::DOUBLE + 20.0::DOUBLE * s_nationkey AS frequency_hz,
         1.5::DOUBLE + (s_suppkey % 4) * 0.5::DOUBLE AS cs_left, 2.5::DOUBLE + (s_suppkey % 3) * 0.5::DOUBLE AS cs_right,
         8 + s_suppkey % 6 AS edge_ix, {GRID} AS nz, {GRID} AS nx, {SPACING_M}::DOUBLE AS dx_m, {SPACING_M}::DOUBLE AS dz_m
  FROM supplier),
pixels0 AS (
  SELECT sample_id, frequency_hz, CAST(z AS INTEGER) AS iz, CAST(x AS INTEGER) AS ix, x * {SPACING_M}::DOUBLE AS x_m,
         z * {SPACING_M}::DOUBLE AS z_m,
         CASE WHEN x < edge_ix THEN cs_left ELSE cs_right END AS cs_true,
         CAST(CASE WHEN x < edge_ix THEN 1 ELSE 2 END AS INTEGER) AS material_id,
         (z * 31 + x * 17 + sample_id) % 97 <> 0 AS valid
  FROM samples, range({GRID}) a(z), range({GRID}) b(x)),
pixels AS (
  SELECT *, sin(kt * (0.8::DOUBLE * x_m + 0.6::DOUBLE * z_m))
            + 0.35::DOUBLE * cos(kt * (-0.4::DOUBLE * x_m + 0.9::DOUBLE * z_m) + 0.2::DOUBLE) AS re,
         0.5::DOUBLE * cos(kt * (0.8::DOUBLE * x_m + 0.6::DOUBLE * z_m)) AS im
  FROM (SELECT *, {2 * math.pi!r}::DOUBLE * frequency_hz / cs_true AS kt FROM pixels0))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("sample_id"),
        (F.lit(200.0) + F.lit(20.0) * F.col("s_nationkey")).alias("frequency_hz"),
        (F.lit(1.5) + (key % 4) * F.lit(0.5)).alias("cs_left"),
        (F.lit(2.5) + (key % 3) * F.lit(0.5)).alias("cs_right"),
        (F.lit(8) + key % 6).alias("edge_ix"),
        F.lit(GRID).alias("nz"),
        F.lit(GRID).alias("nx"),
        F.lit(SPACING_M).alias("dx_m"),
        F.lit(SPACING_M).alias("dz_m"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each short row grows into a whole grid, so the rows are spread over all tasks first.
    grid = (
        samples(spark, sf_dir)
        .repartition(spark.sparkContext.defaultParallelism, "sample_id")
        .withColumn("iz", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
        .withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    )
    left = F.col("ix") < F.col("edge_ix")
    base = grid.select(
        "sample_id",
        "frequency_hz",
        "iz",
        "ix",
        (F.col("ix") * F.lit(SPACING_M)).alias("x_m"),
        (F.col("iz") * F.lit(SPACING_M)).alias("z_m"),
        F.when(left, F.col("cs_left")).otherwise(F.col("cs_right")).alias("cs_true"),
        F.when(left, 1).otherwise(2).alias("material_id"),
        ((F.col("iz") * 31 + F.col("ix") * 17 + F.col("sample_id")) % 97 != 0).alias("valid"),
    ).withColumn("kt", F.lit(2 * math.pi) * F.col("frequency_hz") / F.col("cs_true"))
    first = F.col("kt") * (F.lit(0.8) * F.col("x_m") + F.lit(0.6) * F.col("z_m"))
    second = F.col("kt") * (F.lit(-0.4) * F.col("x_m") + F.lit(0.9) * F.col("z_m")) + F.lit(0.2)
    return base.select(
        "*",
        (F.sin(first) + F.lit(0.35) * F.cos(second)).alias("re"),
        (F.lit(0.5) * F.cos(first)).alias("im"),
    )
