"""Held-out studies: one fit for every level of every axis, all from one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fieldgrain.functions.semantics import clip
from fieldgrain.operators.models import CLIP_RANGE, standardisation, usable
from fieldgrain.operators.registry import leaking_predictors
from fieldgrain.session import cut_lineage, stored


def _products(columns: Sequence[Column]) -> list[Column]:
    """Sums of the products of all pairs of columns, upper triangle by rows."""
    return [F.sum(a * b) for i, a in enumerate(columns) for b in columns[i:]]


def level_moments(rows: DataFrame, axes: Mapping[str, Column], values: Sequence[Column]) -> DataFrame:
    """axis, level, moments: the moment matrix of ``values`` over the rows of every level of every axis.

    Rows are summed once, by the combinations of levels; the combinations are then summed by axis. So the work does not
    grow with the number of axes, and a level that holds most rows is summed by all tasks.
    """
    names = list(axes)
    cells = rows.select(*[c.cast("string").alias(n) for n, c in axes.items()], *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    sums = _products([F.col(f"_v{i}") for i in range(len(values))])
    cells = cells.groupBy(*names).agg(F.array(*sums).alias("moments"))
    entries = F.array(*[F.struct(F.lit(n).alias("axis"), F.col(n).alias("level")) for n in names])
    long = cells.select(F.explode(entries).alias("e"), "moments").select("e.axis", "e.level", F.posexplode("moments").alias("at", "m"))
    parts = long.groupBy("axis", "level", "at").agg(F.sum("m").alias("m"))
    ordered = parts.groupBy("axis", "level").agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("s"))
    return ordered.select("axis", "level", F.transform("s", lambda x: x["m"]).alias("moments"))


def ridge_from_moments(moments: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and slopes of a ridge fit on predictors standardised over the rows behind the moments.

    ``moments``: of (1, predictors, target). A predictor that does not vary gets scale 1 and so slope 0.
    """
    n = moments[0, 0]
    mean = moments[0, 1:] / n
    centred = moments[1:, 1:] - n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(centred)[:-1], 0) / max(n - 1, 1))
    flat = spread <= np.maximum(np.abs(mean[:-1]), 1) * 1e-12
    scale = np.where(flat, 1.0, spread)
    z = centred[:-1, :-1] / np.outer(scale, scale)
    slopes = np.linalg.solve(z + np.eye(len(z)) * max(penalty, 1e-300), centred[:-1, -1] / scale) / scale
    slopes[flat] = 0
    return np.concatenate([[mean[-1] - slopes @ mean[:-1]], slopes])


def holdout_fits(rows: DataFrame, axes: Mapping[str, Column], predictors: Sequence[str], target: str, penalty: float = 1.0) -> DataFrame:
    """axis, level, train_count, baseline (mean target of the training rows), coefficients of every leave-one-level-out fit.

    The moments of a fit are those of all rows less those of its level. Values are centred and scaled over all rows
    first, so that the difference does not lose digits. A level that holds all rows has no training rows and no fit.
    """
    leaking = leaking_predictors(predictors)
    if leaking:
        raise ValueError(f"predictors that leak the truth: {', '.join(leaking)}")
    names = [*predictors, target]
    stats = {r["predictor"]: r for r in standardisation(rows, names).collect()}  # one row per predictor
    shift, scale = [np.array([stats[c][k] or 0.0 for c in names]) for k in ("mu", "sigma")]
    values = [F.lit(1.0), *[(F.col(c) - float(a)) / float(b) for c, a, b in zip(names, shift, scale)]]
    moments = cut_lineage(level_moments(rows, axes, values))
    first = next(iter(axes))
    total = moments.where(F.col("axis") == first).select(F.posexplode("moments").alias("at", "m")).groupBy("at").agg(F.sum("m").alias("m"))
    total = total.agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("s")).select(F.transform("s", lambda x: x["m"]).alias("total"))
    size = len(names) + 1

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(size)
        for batch in batches:
            out = []
            for axis, level, own, whole in batch[["axis", "level", "moments", "total"]].itertuples(index=False):
                m = np.zeros((size, size))
                m[upper] = np.array(whole) - np.array(own)
                m = m + np.triu(m, 1).T
                if m[0, 0] < 0.5:
                    out.append((axis, level, 0, None, None))
                    continue
                c = ridge_from_moments(m, penalty)
                slopes = c[1:] * scale[-1] / scale[:-1]
                start = c[0] * scale[-1] + shift[-1] - slopes @ shift[:-1]
                out.append((axis, level, int(round(m[0, 0])), float(m[0, -1] / m[0, 0] * scale[-1] + shift[-1]), [float(start), *map(float, slopes)]))
            yield pd.DataFrame(out, columns=["axis", "level", "train_count", "baseline", "coefficients"])

    joined = moments.crossJoin(F.broadcast(total))  # one row
    return joined.mapInPandas(solve, "axis string, level string, train_count long, baseline double, coefficients array<double>")


def holdout_study(rows: DataFrame, axes: Mapping[str, Column], predictors: Sequence[str], target: str, penalty: float = 1.0) -> DataFrame:
    """One row per level of every axis: how well the fit without it predicts it, beside the training rows' mean.

    Columns: axis, level, train_count, test_count, q_mae, q_rmse, q_bias, fixed_mae. Rows with an unusable predictor or
    target take no part; a null level is a level.
    """
    good = rows.where(usable([*predictors, target]))
    # written, so that Spark knows how small the fits are: rows are not dealt out by their few levels
    fits = stored(holdout_fits(good, axes, predictors, target, penalty))
    entries = F.array(*[F.struct(F.lit(n).alias("axis"), c.cast("string").alias("level")) for n, c in axes.items()])
    long = good.select(*predictors, F.col(target).alias("_y"), F.explode(entries).alias("e")).select("*", "e.axis", "e.level").drop("e")
    fitted = fits.withColumnsRenamed({"axis": "_axis", "level": "_level"})
    met = long.join(fitted, (F.col("axis") == F.col("_axis")) & F.col("level").eqNullSafe(F.col("_level")))
    value = F.get("coefficients", F.lit(0))
    for i, p in enumerate(predictors):
        value = value + F.get("coefficients", F.lit(i + 1)) * F.col(p)
    e = clip(value, *CLIP_RANGE) - F.col("_y")
    return met.groupBy("axis", "level", "train_count").agg(
        F.count(F.lit(1)).alias("test_count"), F.avg(F.abs(e)).alias("q_mae"), F.sqrt(F.avg(e * e)).alias("q_rmse"), F.avg(e).alias("q_bias"),
        F.avg(F.abs(F.col("baseline") - F.col("_y"))).alias("fixed_mae"),
    )
