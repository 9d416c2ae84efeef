"""Builds in several deliveries and registered models, written and read back below the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from fieldgrain.operators import model_store as ms
from fieldgrain.operators.models import RidgeModel
from fieldgrain.plans.catalog import query, rounded
from fieldgrain.plans.frames import EXAMPLES_SQL, RUNS_SQL, examples, runs
from fieldgrain.plans.studies import PREDICTORS, SIGNAL_SQL, signal
from fieldgrain.session import ensure_checkpoint_dir
from fieldgrain.sources import builds as bd

COLUMNS = ["example_id", "campaign_run_id", "campaign_condition_id", "patch_idx", "part_id"]


def _folder(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _extract(spark, sf_dir):
    def extract(todo: DataFrame) -> DataFrame:
        # a run is an order: by its key, orders, runs and lines are dealt out once, and no text is
        wanted = todo.select(F.col("run_id").try_cast("long").alias("o_orderkey"))
        return examples(spark, sf_dir, wanted).select(*COLUMNS)

    return extract


#: A run's delivery, 0 to 2, by its campaign year.
DELIVERY = "pmod(iteration_index, 3)"

#: An example as text: each value after its length.
ROW_TEXT_SQL = " || ".join(f"coalesce(length(CAST(e.{c} AS VARCHAR)) || ':' || CAST(e.{c} AS VARCHAR), '-')" for c in COLUMNS)

DELIVERED_SQL = f"""{RUNS_SQL}, {EXAMPLES_SQL},
    d AS (SELECT run_id, ((iteration_index % 3) + 3) % 3 AS delivery FROM runs),
    x AS (SELECT d.delivery, e.campaign_condition_id, e.campaign_run_id, {ROW_TEXT_SQL} AS t FROM examples e JOIN d ON d.run_id = e.campaign_run_id)"""


@query(
    "incremental_build",
    "D16 IO5",
    f"""WITH {DELIVERED_SQL},
    steps(step, status, version, upto) AS (VALUES (1, 'published', 1, 0), (2, 'published', 2, 1), (3, 'unchanged', 2, 1), (4, 'refused', 2, 1), (5, 'refused', 2, 1), (6, 'published', 3, 2)),
    r AS (SELECT delivery, count(*) AS n FROM d GROUP BY 1),
    c AS (SELECT delivery, count(*) AS n, sum(CAST('0x' || substr(md5(t), 1, 15) AS BIGINT)) AS content FROM x GROUP BY 1)
    SELECT step, status, version, CAST((SELECT sum(n) FROM r WHERE delivery <= upto) AS BIGINT) AS run_count,
      CAST((SELECT sum(n) FROM c WHERE delivery <= upto) AS BIGINT) AS example_count,
      CAST((SELECT sum(content) FROM c WHERE delivery <= upto) AS VARCHAR) AS content FROM steps""",
)
def incremental_build(spark, sf_dir):
    """A first build, an append, its replay, other settings, another source of known runs, and the rest of the runs."""
    folder, ledger, extract = _folder(spark, "dataset"), runs(spark, sf_dir), _extract(spark, sf_dir)
    settings = {"dataset_id": "first", "window": 9}
    moved = ledger.withColumn("hash_sha256", F.md5("hash_sha256"))
    steps = [
        (ledger.where(f"{DELIVERY} = 0"), settings),
        (ledger.where(f"{DELIVERY} <= 1"), {**settings, "dataset_id": "second"}),
        (ledger.where(f"{DELIVERY} <= 1"), settings),
        (ledger, {**settings, "window": 11}),
        (moved, settings),
        (ledger, settings),
    ]
    rows, last = [], None
    for step, (delivered, config) in enumerate(steps, 1):
        try:
            after = bd.build_dataset(delivered, folder, extract, config)
            status = "unchanged" if last and after["version"] == last["version"] else "published"
            last = after
        except bd.BuildRefused:
            status = "refused"
        rows.append((step, status, last["version"], last["run_count"], last["example_count"], last["content"]))
    return spark.createDataFrame(rows, "step int, status string, version int, run_count long, example_count long, content string")


@query(
    "built_dataset_parts",
    "D16 IO5 J6",
    f"""WITH {DELIVERED_SQL}
    SELECT delivery + 1 AS part, campaign_condition_id, CAST(count(DISTINCT campaign_run_id) AS BIGINT) AS run_count, CAST(count(*) AS BIGINT) AS example_count FROM x GROUP BY 1, 2""",
)
def built_dataset_parts(spark, sf_dir):
    """A dataset built in three deliveries, read back through its newest version."""
    folder, ledger, extract = _folder(spark, "dataset"), runs(spark, sf_dir), _extract(spark, sf_dir)
    for upto in range(3):
        bd.build_dataset(ledger.where(f"{DELIVERY} <= {upto}"), folder, extract, {"window": 9})
    # (run) counts first, so that a large condition is spread by its runs
    per_run = bd.read_examples(spark, folder).groupBy("part", "campaign_condition_id", "campaign_run_id").agg(F.count("*").alias("n"))
    return per_run.groupBy("part", "campaign_condition_id").agg(F.count("*").alias("run_count"), F.sum("n").alias("example_count"))


@query(
    "registered_model_versions",
    "M17 IO8",
    f"""WITH {SIGNAL_SQL}, a AS (SELECT campaign_direction_count % 3 AS g, campaign_frequency_hz AS x1, CAST(campaign_size AS DOUBLE) AS x2, q_target AS y FROM signal),
    s AS (SELECT v, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_samp(x1) AS d1, stddev_samp(x2) AS d2,
        corr(x1, x2) AS r, covar_samp(x1, y) AS c1, covar_samp(x2, y) AS c2 FROM (VALUES (1), (2), (3)) l(v) JOIN a ON a.g < v GROUP BY 1),
    -- the two standardised slopes by Cramer's rule, with a penalty of 1
    f AS (SELECT *, n - 1 + 1.0::DOUBLE AS p, (n - 1) * r AS o, (n - 1) * c1 / d1 AS b1, (n - 1) * c2 / d2 AS b2 FROM s),
    k AS (SELECT *, (b1 * p - b2 * o) / (p * p - o * o) / d1 AS s1, (b2 * p - b1 * o) / (p * p - o * o) / d2 AS s2 FROM f)
    SELECT v AS version, CAST(any_value(n) AS BIGINT) AS train_count, v = 3 AS newest, CAST(count(*) AS BIGINT) AS scored,
      round(avg(abs(my + s1 * (x1 - m1) + s2 * (x2 - m2) - y)), 6) AS q_mae, round(avg(my + s1 * (x1 - m1) + s2 * (x2 - m2) - y), 6) AS q_bias
    FROM k, a GROUP BY v""",
)
def registered_model_versions(spark, sf_dir):
    """Three fits on growing training rows, appended under one name; each is loaded by its number and scores all rows."""
    folder, rows = _folder(spark, "models"), signal(spark, sf_dir)
    group = F.col("campaign_direction_count") % 3
    for version in (1, 2, 3):
        train = rows.where(group < version)
        model = RidgeModel.fit(train, PREDICTORS, "q_target", 1.0)
        ms.register_model(model, folder, "quantile", train, PREDICTORS, "q_target", train_count=train.count())
    newest = ms.load_registered(folder, "quantile", rows)[1]["version"]
    errors = []
    for version in (1, 2, 3):
        model, _ = ms.load_registered(folder, "quantile", rows, version)
        errors.append((model.column() - F.col("q_target")).alias(f"e{version}"))
    # all versions score in one scan of the rows
    figures = [F.struct(F.lit(v).alias("version"), F.count("*").alias("scored"), F.avg(F.abs(f"e{v}")).alias("q_mae"), F.avg(f"e{v}").alias("q_bias")) for v in (1, 2, 3)]
    scored = rows.select(*errors).agg(F.array(*figures).alias("f")).select(F.inline("f"))
    known = ms.registered_models(spark, folder).select(F.col("version").cast("int").alias("version"), F.col("metadata")["train_count"].cast("long").alias("train_count"))
    out = known.join(scored, "version").withColumn("newest", F.col("version") == newest)
    return rounded(out.select("version", "train_count", "newest", "scored", "q_mae", "q_bias"))
