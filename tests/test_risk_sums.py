"""Sums of cells are small tables that Spark knows to be small."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldgrain.functions.semantics import steady_sum
from fieldgrain.operators import risk as rk


def test_risk_sums_do_not_deal_out_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 4).alias("c"), (F.col("id") % 3).cast("int").alias("cv_fold"), (F.col("id") % 2).alias("v"))
    plan = rk.cell_means(rows, ["c"], {"p": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_gates_that_accept_the_same_rows_tie(spark):
    """Equal sets of rows have equal gains in any order of the rows, so the tie goes to the larger gain threshold."""
    rng = np.random.default_rng(12)
    n = 20000
    gain = rng.normal(40, 1, n) * 10.0 ** rng.integers(0, 6, n)
    pdf = pd.DataFrame({"candidate": "a", "cv_fold": 0, "expected_gain": 6.0, "harm_probability": rng.choice([0.05, 0.15, 0.3, 0.45], n), "gain": gain, "harm": 0})
    rows = spark.createDataFrame(pdf)
    orders = [rows.coalesce(1), rows.repartition(7), rows.orderBy("gain").coalesce(1), rows.orderBy("harm_probability", F.desc("gain")).repartition(3)]
    found = {tuple(rk.gate_choice(r, [0.0, 1.0, 2.0, 5.0], [0.1, 0.2, 0.35, 0.5], most_harm_pct=25.0).first()) for r in orders}
    assert len(found) == 1
    ((_, min_gain, max_harm, accepted, total, harmed),) = found
    assert (min_gain, max_harm, accepted, harmed) == (5.0, 0.5, n, 0.0)
    assert abs(total - math.fsum(gain)) <= 2 * np.spacing(total)


def test_steady_sum_of_odd_values(spark):
    odd = [(1, float("inf")), (1, 2.0), (2, None), (3, -4.25), (3, None), (4, 1e300), (4, 1.0), (5, float("nan")), (6, 0.1), (6, -0.1), (7, -(2.0**-50)), (8, 2.0**37), (8, 2.0**-16)]
    rows = spark.createDataFrame(odd, "k int, v double")
    got = {r[0]: r[1] for r in rows.groupBy("k").agg(steady_sum("v")).collect()}
    assert math.isnan(got.pop(5))
    assert got == {1: float("inf"), 2: None, 3: -4.25, 4: 1e300, 6: 0.0, 7: -(2.0**-50), 8: 2.0**37 + 2.0**-16}
    many = spark.range(300).select(F.lit(2.0**37).alias("v"))  # beyond the integers
    assert many.agg(steady_sum("v")).first()[0] == 300 * 2.0**37
