"""Forests on cells: independent of the layout of the rows, draws of whole cells, the leaf rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrain.operators import forests as fo


def rows_of(spark, n=3000):
    i = F.col("id")
    return spark.range(n).select((i % 7).cast("double").alias("a"), ((i * 37) % 101).cast("double").alias("b"), ((i * 13) % 5 / 10 + (i % 7) / 20).alias("y"))


def test_forest_does_not_depend_on_where_rows_lie(spark):
    df = rows_of(spark)
    options = {"trees": 3, "depth": 4, "leaf": 8}
    one = fo.forest_quantile(df.repartition(1), df.repartition(1), ["a", "b"], "y", **options).toPandas()
    many = fo.forest_quantile(df, df.orderBy(F.desc("b")).repartition(5), ["a", "b"], "y", **options).toPandas()
    order = ["a", "b", "y"]
    one, many = (d.sort_values([*order, "q_pred"])[[*order, "q_pred"]].to_numpy() for d in (one, many))
    assert one.shape == many.shape == (3000, 4)
    assert np.abs(one - many).max() < 1e-9


def test_draws_are_those_of_all_rows(spark):
    df = rows_of(spark)
    limits = fo.bin_limits(df, ["a", "b"])
    cells = fo.cell_counts(df, limits, ["y"], 40).toPandas()
    assert cells["_n"].sum() == 3000
    drawn = np.array(cells["_drawn"].tolist())
    # each tree draws Poisson(3000) rows: mean 3000, spread 55
    assert abs(drawn.sum(axis=0).mean() - 3000) < 50 and 25 < drawn.sum(axis=0).std() < 90


def test_leaves_hold_enough_drawn_rows(spark):
    df = rows_of(spark, 200)
    cells = fo.cell_counts(df, fo.bin_limits(df, ["a", "b"]), ["y"], 2)
    (model, _) = fo.bagged(cells, ["a", "b"], "y", trees=2, leaf=30, depth=6)
    leaves = model.transform(cells.withColumn("w", F.get("_drawn", F.lit(0)))).groupBy("_p0").agg(F.sum("w").alias("w")).collect()
    assert len(leaves) > 1 and min(r["w"] for r in leaves) >= 30


def test_missing_and_leaking_predictors(spark):
    df = rows_of(spark, 300)
    got = fo.forest_quantile(df.unionByName(df.limit(1).withColumn("a", F.lit(None).cast("double"))), df, ["a", "b"], "y", trees=2, depth=3)
    assert got.count() == 301
    with pytest.raises(ValueError):
        fo.bin_limits(df.withColumn("truth_q", F.col("a")), ["truth_q"])


def test_boosting_on_combinations_of_bins_equals_boosting_on_rows(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    df = rows_of(spark).withColumn("y", F.col("y") + F.sin(F.col("b") / 9) / 5)
    limits = fo.bin_limits(df, ["a", "b"])
    cells = fo.cell_counts(df, limits, ["y"], 0)
    (model,) = fo.boosted(cells, ["a", "b"], "y", trees=12)
    placed = fo.binned(df, limits).coalesce(1)
    x = VectorAssembler(inputCols=["_b_a", "_b_b"], outputCol="_x")
    plain = GBTRegressor(maxIter=12, stepSize=0.05, maxDepth=5, maxBins=32, seed=1, featuresCol="_x", labelCol="y", predictionCol="p").fit(x.transform(placed))
    assert model.stages[-1].getNumTrees == plain.getNumTrees == 12
    both = plain.transform(model.transform(placed)).select("_p0", "p").toPandas()
    assert np.abs(both["_p0"] - both["p"]).max() < 1e-9 and both["p"].nunique() > 20


def test_leaves_of_boosted_trees_hold_enough_rows(spark):
    df = rows_of(spark, 200)
    cells = fo.cell_counts(df, fo.bin_limits(df, ["a", "b"]), ["y"], 0)
    (model,) = fo.boosted(cells, ["a", "b"], "y", trees=1, leaf=30)
    leaves = model.transform(cells).groupBy("_p0").agg(F.sum("_n").alias("n")).collect()
    assert len(leaves) > 1 and min(r["n"] for r in leaves) >= 30


def test_the_compared_boosting_has_all_its_rounds(spark, sf_dir, monkeypatch):
    """200 rounds, as in the reference's train_q_model_from_predictors.m."""
    from fieldgrain.plans import load_queries

    asked = []

    class Stop(Exception):
        pass

    def boosted(*args, **options):
        asked.append(options)
        raise Stop

    monkeypatch.setattr(fo, "boosted", boosted)
    with pytest.raises(Stop):
        load_queries()["model_families"].build(spark, sf_dir)
    assert asked[0]["trees"] == 200 and asked[0]["leaf"] == 8
