"""Forests on cells: trees look at predictors by bins, so rows equal in bins and target are fitted and scored once.

Spark's trees cut every predictor into at most 32 bins as well, by a sample of the rows; here the limits are exact
percentiles of all training rows. Rows are then counted by (bins, targets), and a tree is fitted on the counts as weights:
the draw of a row with replacement is Poisson(1), so that of n equal rows is Poisson(n). The number of cells is bounded by
32^predictors times the distinct targets, however many rows there are, so this pays for few predictors and targets with
few values; for others ``models.fit`` fits the rows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from fieldgrain.functions.semantics import clip
from fieldgrain.operators.models import CLIP_RANGE, usable
from fieldgrain.operators.order_stats import percentiles
from fieldgrain.operators.registry import leaking_predictors
from fieldgrain.session import stored

BINS = 32
#: Trees that are fitted at a time; each is a chain of short jobs on the cells.
AT_A_TIME = 4


def bin_limits(train: DataFrame, predictors: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Lower limits of every predictor's bins but the first: exact percentiles of the training rows, each once."""
    leaking = leaking_predictors(predictors)
    if leaking:
        raise ValueError(f"predictors that leak the truth: {', '.join(leaking)}")
    good = train.where(usable(predictors))
    limits = {}
    for p in predictors:
        row = percentiles(good, [], p, {f"_q{i}": i / bins for i in range(1, bins)}).first()  # bins - 1 numbers
        limits[p] = sorted(set(row or ()))
    return limits


def binned(rows: DataFrame, limits: Mapping[str, Sequence[float]]) -> DataFrame:
    """The rows with ``_b_<predictor>``: how many limits the value reaches; missing values share a bin above all others."""
    splits = [[float("-inf"), *map(float, edges), float("inf")] for edges in limits.values()]
    out = Bucketizer(splitsArray=splits, inputCols=list(limits), outputCols=[f"_b_{p}" for p in limits], handleInvalid="keep").transform(rows)
    return out.withColumns({f"_b_{p}": F.coalesce(f"_b_{p}", F.lit(len(edges) + 1.0)) for p, edges in limits.items()})


def cell_counts(train: DataFrame, limits: Mapping[str, Sequence[float]], targets: Sequence[str], trees: int, seed: int = 1) -> DataFrame:
    """One row per (bins, targets): its training rows ``_n`` and, for every tree, how many of them it draws (``_drawn``).

    Draws depend on the cell and the seed alone, not on where the rows lie.
    """
    bins = [f"_b_{p}" for p in limits]
    good = train.where(usable([*limits, *targets]))
    counts = binned(good.select(*limits, *targets), limits).groupBy(*bins, *targets).agg(F.count(F.lit(1)).alias("_n"))
    keyed = counts.select("*", F.xxhash64(F.lit(seed), *bins, *targets).alias("_seed"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = [np.random.default_rng(int(s) & (2**64 - 1)).poisson(n, trees).tolist() for s, n in zip(batch["_seed"], batch["_n"])]
            yield batch.drop(columns="_seed").assign(_drawn=drawn)

    return stored(keyed.mapInPandas(draw, counts.select("*", F.lit(None).cast("array<long>").alias("_drawn")).schema))


def bagged(cells: DataFrame, predictors: Sequence[str], target: str, *, trees: int, leaf: int = 1, depth: int = 8, seed: int = 1,
           classes: bool = False) -> list[PipelineModel]:
    """Trees fitted on the rows that each drew. A leaf holds at least ``leaf`` drawn rows. Classifiers try sqrt(predictors) a node."""
    x = VectorAssembler(inputCols=[f"_b_{p}" for p in predictors], outputCol="_x")
    weight = lambda t: F.get("_drawn", F.lit(t)).cast("double")
    totals = cells.agg(*[F.sum(weight(t)).alias(f"_{t}") for t in range(trees)]).first()  # a number a tree

    def one(t: int) -> PipelineModel:
        rows = x.transform(cells.withColumn("_w", weight(t)).where("_w > 0"))
        # draws are whole numbers, so half a row less does not admit a smaller leaf
        share = min((leaf - 0.5) / max(totals[t] or 1.0, 1.0), 0.499)
        common = {"featuresCol": "_x", "labelCol": target, "weightCol": "_w", "numTrees": 1, "bootstrap": False, "maxDepth": depth, "maxBins": BINS,
                  "minWeightFractionPerNode": share, "seed": seed + t, "predictionCol": f"_p{t}"}
        if classes:
            return RandomForestClassifier(featureSubsetStrategy="sqrt", probabilityCol=f"_c{t}", rawPredictionCol=f"_r{t}", **common).fit(rows)
        return RandomForestRegressor(featureSubsetStrategy="all", **common).fit(rows)

    with ThreadPool(AT_A_TIME) as pool:
        return [PipelineModel([x, m]) for m in pool.map(one, range(trees))]


def boosted(cells: DataFrame, predictors: Sequence[str], target: str, *, trees: int = 200, leaf: int = 1, rate: float = 0.05, depth: int = 5,
            seed: int = 1) -> list[PipelineModel]:
    """Boosted trees, one model, on all training rows. A leaf holds at least ``leaf`` rows.

    A least-squares tree reads no more of rows that share all bins than their number and mean target, so every round runs on
    one row per combination of bins.
    """
    bins = [f"_b_{p}" for p in predictors]
    x = VectorAssembler(inputCols=bins, outputCol="_x")
    weight = F.sum("_n").cast("double")
    rows = stored(cells.groupBy(*bins).agg(weight.alias("_w"), (F.sum(F.col(target) * F.col("_n")) / weight).alias(target)))
    total = rows.agg(F.sum("_w")).first()[0] or 1.0
    share = min((leaf - 0.5) / max(total, 1.0), 0.499)
    fitted = GBTRegressor(maxIter=trees, stepSize=rate, maxDepth=depth, maxBins=BINS, seed=seed, minWeightFractionPerNode=share, featuresCol="_x",
                          labelCol=target, weightCol="_w", predictionCol="_p0").fit(x.transform(rows))
    return [PipelineModel([x, fitted])]


def mean_of_trees(cells: DataFrame, models: Sequence[PipelineModel], classes: bool = False) -> tuple[DataFrame, Column]:
    """The cells with every tree's answer, and their mean: a value, or the probability of class 1."""
    out = cells
    for m in models:
        out = m.transform(out).drop("_x")
    answers = [F.get(vector_to_array(f"_c{t}"), F.lit(1)) if classes else F.col(f"_p{t}") for t in range(len(models))]
    return out, reduce(lambda a, b: a + b, answers) / len(models)


def score_cells(rows: DataFrame, limits: Mapping[str, Sequence[float]], forests: Mapping[str, tuple[Sequence[PipelineModel], bool, tuple[float, float]]]) -> DataFrame:
    """The rows with one column per forest (trees, classes or not, range of the answer); every cell is scored once."""
    bins = [f"_b_{p}" for p in limits]
    placed = binned(rows, limits)
    cells = stored(placed.select(*bins).distinct())
    for out, (models, classes, ends) in forests.items():
        found, value = mean_of_trees(cells, models, classes)
        cells = stored(found.select(*cells.columns, clip(value, *ends).alias(out)))
    keep = [c for c in rows.columns if c not in forests]
    return placed.join(cells, bins, "left").select(*keep, *forests)


def composition(rows: DataFrame, train: DataFrame, predictors: Sequence[str], purity: str, *, mixed_below: float = 0.9,
                strong_below: float = 0.7, trees: int = 60, seed: int = 1) -> DataFrame:
    """Predicted purity and probabilities of a mixed and a strongly mixed window; all three forests share the cells."""
    limits = bin_limits(train, predictors)
    cells = cell_counts(train, limits, [purity], trees, seed)
    marks = {"p_mixed": mixed_below, "p_strong_mixed": strong_below}
    cells = cells.withColumns({f"_{k}": (F.col(purity) < v).cast("double") for k, v in marks.items()})
    forests = {"predicted_purity": (bagged(cells, predictors, purity, trees=trees, leaf=8, depth=12, seed=seed), False, (0.0, 1.0))}
    for k in marks:
        forests[k] = (bagged(cells, predictors, f"_{k}", trees=trees, seed=seed, classes=True), True, (0.0, 1.0))
    return score_cells(rows, limits, forests)


def forest_quantile(rows: DataFrame, train: DataFrame, predictors: Sequence[str], target: str, *, kind: str = "bagged_trees", trees: int = 160,
                    leaf: int = 8, depth: int = 12, seed: int = 1, out: str = "q_pred") -> DataFrame:
    """The rows with the forest's clipped prediction of the target.

    ``trees`` counts the rounds of boosted trees; they have their own depth, ``depth`` is that of bagged trees.
    """
    limits = bin_limits(train, predictors)
    # boosted trees take all rows and draw none
    cells = cell_counts(train, limits, [target], trees if kind == "bagged_trees" else 0, seed)
    if kind == "bagged_trees":
        models = bagged(cells, predictors, target, trees=trees, leaf=leaf, depth=depth, seed=seed)
    elif kind == "boosted_trees":
        models = boosted(cells, predictors, target, trees=trees, leaf=leaf, seed=seed)
    else:
        raise ValueError(f"unknown forest {kind!r}")
    return score_cells(rows, limits, {out: (models, False, CLIP_RANGE)})
