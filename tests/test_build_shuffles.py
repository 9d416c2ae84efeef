"""Runs are met by the order key before lines are joined: examples are not dealt out by their run's text."""

from fieldgrain.plans.builds import _extract
from fieldgrain.plans.frames import runs


def test_extraction_deals_out_by_the_order_key_only(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _extract(spark, sf_dir)(runs(spark, sf_dir).select("run_id", "hash_sha256").where("ordinal % 3 = 0"))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(campaign_run_id" not in plan and plan.count("Exchange hashpartitioning") == 3
