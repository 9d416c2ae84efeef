"""Fitting and scoring on distributed tables: standardisation, ridge, trees, folds, gates, audits."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, PolynomialExpansion, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgrain.functions.semantics import clip, finite, null_safe_join, ratio, require_columns
from fieldgrain.operators.order_stats import percentiles
from fieldgrain.operators.registry import leaking_predictors

CLIP_RANGE = (0.001, 0.999)


# --- baselines and projections ------------------------------------------------------------------


def fixed_quantile(rows: DataFrame, target: str, estimator: str = "median") -> DataFrame:
    """Every row gets the training median or mean of the target, clipped."""
    train = rows.where((F.col("partition") == "train") & F.col(target).isNotNull())
    if estimator == "median":
        value = percentiles(train, [], target, {"_v": 0.5})
    elif estimator == "mean":
        value = train.agg(F.avg(target).alias("_v"))
    else:
        raise ValueError("estimator must be median or mean")
    joined = rows.crossJoin(F.broadcast(value))  # one row
    return joined.withColumn("q_pred", clip("_v", *CLIP_RANGE)).drop("_v")


def theory_quantile_baseline(rows: DataFrame, theory: str) -> DataFrame:
    """Theory value as prediction; rows without a usable value are flagged, not dropped."""
    value = finite(theory)
    usable = value.isNotNull() & (value >= 0) & (value <= 1)
    return rows.select("*", F.when(usable, clip(value, *CLIP_RANGE)).alias("q_pred"), usable.alias("theory_valid"))


def residual_target(rows: DataFrame, target: str, prior: str) -> DataFrame:
    return rows.withColumn("target_residual", F.col(target) - F.col(prior))


def prior_plus_residual(prior: Column, delta: Column) -> Column:
    return clip(prior + delta, *CLIP_RANGE)


def guess_expansion(rows: DataFrame, guesses: Mapping[str, str]) -> DataFrame:
    """Each row once per user guess of the field type, with the prior of that guess."""
    entries = F.array(
        *[F.struct(F.lit(g).alias("user_field_guess"), F.col(c).alias("q_prior_guess")) for g, c in guesses.items()]
    )
    return rows.select("*", F.explode(entries).alias("_g")).select("*", "_g.*").drop("_g")


# --- standardisation, distance, ridge --------------------------------------------------------------


def standardisation(train: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """One row per predictor: training mean and N-1 spread (1 for a constant predictor)."""
    aggs = []
    for p in predictors:
        aggs += [F.avg(p).alias(f"m_{p}"), F.stddev_samp(p).alias(f"s_{p}")]
    stats = train.agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("predictor"), F.col(f"m_{p}").alias("mu"), F.col(f"s_{p}").alias("_s"))
            for p in predictors
        ]
    )
    floor = F.greatest(F.abs(F.col("mu")), F.lit(1.0)) * 2.220446049250313e-16
    flat = F.col("_s").isNull() | (F.col("_s") <= floor)
    return stats.select(F.explode(rows).alias("_r")).select("_r.*").select(
        "predictor", "mu", F.when(flat, 1.0).otherwise(F.col("_s")).alias("sigma"), flat.alias("constant")
    )


def ood_distance(rows: DataFrame, train: DataFrame, predictors: Sequence[str], out: str = "ood_distance") -> DataFrame:
    """Root mean square of standardised predictors."""
    stats = standardisation(train, predictors).groupBy().agg(
        *[F.max(F.when(F.col("predictor") == p, F.col("mu"))).alias(f"_m_{p}") for p in predictors],
        *[F.max(F.when(F.col("predictor") == p, F.col("sigma"))).alias(f"_s_{p}") for p in predictors],
    )
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    z2 = [((F.col(p) - F.col(f"_m_{p}")) / F.col(f"_s_{p}")) ** 2 for p in predictors]
    return joined.select(*rows.columns, F.sqrt(reduce(lambda a, b: a + b, z2) / len(predictors)).alias(out))


def moment_matrix(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """X'X with a leading one: each task sums its own small matrix, and the matrices are summed."""
    size = len(columns) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((size, size))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), batch.to_numpy(float)])
            acc += x.T @ x
        i, j = np.indices(acc.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": acc.ravel()})

    doubles = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    cells = doubles.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for r in cells.collect():  # (predictors + 2)^2 numbers
        out[r["i"], r["j"]] = r["v"]
    return out


class RidgeModel:
    """Ridge on standardised predictors with an unpenalised intercept."""

    def __init__(self, predictors: Sequence[str], mu, sigma, coefficients, penalty: float):
        self.predictors, self.penalty = list(predictors), penalty
        self.mu, self.sigma, self.coefficients = map(lambda v: [float(x) for x in v], (mu, sigma, coefficients))

    @classmethod
    def fit(cls, train: DataFrame, predictors: Sequence[str], target: str, penalty: float) -> RidgeModel:
        if penalty < 0:
            raise ValueError("the ridge penalty must not be negative")
        stats = {r["predictor"]: r for r in standardisation(train, predictors).collect()}  # one row per predictor
        mu = np.array([stats[p]["mu"] for p in predictors])
        sigma = np.array([stats[p]["sigma"] for p in predictors])
        # Standardise before summing products, so the matrix stays well-conditioned.
        z = train.select(*[((F.col(p) - float(m)) / float(s)).alias(p) for p, m, s in zip(predictors, mu, sigma)], target)
        moments = moment_matrix(z, [*predictors, target])
        n = len(predictors) + 1
        ridge = np.eye(n) * penalty
        ridge[0, 0] = 0
        coefficients = np.linalg.solve(moments[:n, :n] + ridge, moments[:n, n])
        return cls(predictors, mu, sigma, coefficients, penalty)

    def column(self) -> Column:
        value = F.lit(self.coefficients[0])
        for p, m, s, c in zip(self.predictors, self.mu, self.sigma, self.coefficients[1:]):
            value = value + (F.col(p) - m) / s * c
        return value

    def transform(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        return rows.withColumn(out, self.column())

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> RidgeModel:
        d = json.loads(text)
        return cls(d["predictors"], d["mu"], d["sigma"], d["coefficients"], d["penalty"])


# --- model families on Spark ML ---------------------------------------------------------------------


def regression_pipeline(kind: str, predictors: Sequence[str], target: str, *, categorical: Sequence[str] = (),
                        trees: int = 160, leaf: int = 8, depth: int = 12, seed: int = 1, rate: float = 0.05) -> Pipeline:
    """Assembler plus one estimator: bagged or boosted trees, linear or quadratic regression."""
    stages: list = []
    inputs = list(predictors)
    for c in categorical:
        stages += [
            StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep"),
            OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_o_{c}", handleInvalid="keep"),
        ]
        inputs.append(f"_o_{c}")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_x", handleInvalid="error"))
    features = "_x"
    if kind == "quadratic":
        stages.append(PolynomialExpansion(degree=2, inputCol="_x", outputCol="_x2"))
        features = "_x2"
    common = {"featuresCol": features, "labelCol": target, "predictionCol": "prediction"}
    estimators = {
        "bagged_trees": lambda: RandomForestRegressor(
            numTrees=trees, minInstancesPerNode=leaf, maxDepth=depth, featureSubsetStrategy="all", bootstrap=True, seed=seed,
            **common,
        ),
        "boosted_trees": lambda: GBTRegressor(maxIter=trees, stepSize=rate, maxDepth=5, seed=seed, **common),
        "linear": lambda: LinearRegression(**common),
        "quadratic": lambda: LinearRegression(**common),
    }
    if kind not in estimators:
        raise ValueError(f"unknown regression kind {kind!r}")
    return Pipeline(stages=[*stages, estimators[kind]()])


def usable(predictors: Sequence[str]) -> Column:
    """Row validity: every predictor present and finite."""
    return reduce(lambda a, b: a & b, [finite(p).isNotNull() for p in predictors])


def fit(rows: DataFrame, kind: str, predictors: Sequence[str], target: str, *, penalty: float = 1.0, **options):
    """Fit on the usable rows. Predictors that would leak the truth stop the fit before any job runs."""
    leaking = leaking_predictors(predictors)
    if leaking:
        raise ValueError(f"predictors that leak the truth: {', '.join(leaking)}")
    train = rows.where(usable([*predictors, target]))
    if kind == "ridge":
        return RidgeModel.fit(train, predictors, target, penalty)
    return regression_pipeline(kind, predictors, target, **options).fit(train)


def score(rows: DataFrame, model, out: str = "q_pred", limits: tuple[float, float] = CLIP_RANGE) -> DataFrame:
    """Clipped prediction; rows are assumed valid."""
    scored = model.transform(rows)
    keep = [c for c in rows.columns if c != out]
    return scored.select(*keep, clip("prediction", *limits).alias(out))


def score_valid(rows: DataFrame, model, predictors: Sequence[str], out: str = "q_pred") -> DataFrame:
    """Score every row in place; those with an unusable predictor get NULL and ``prediction_valid`` false."""
    good = usable(predictors)
    kept = {p: F.col(p).alias(f"_kept_{p}") for p in predictors}
    # the model sees zeros for what is missing, and its answer for such a row is dropped
    filled = rows.select(*rows.columns, *kept.values(), good.alias("_good")).withColumns({p: F.coalesce(finite(p), F.lit(0.0)) for p in predictors})
    scored = score(filled, model, out).withColumn(out, F.when(F.col("_good"), F.col(out)))
    back = [F.col(f"_kept_{c}").alias(c) if c in kept else F.col(c) for c in rows.columns if c != out]
    return scored.select(*back, out, F.col("_good").alias("prediction_valid"))


def out_of_fold(rows: DataFrame, kind: str, predictors: Sequence[str], target: str, folds: int, *, seed: int = 1, **options):
    """Fold models for training rows, one final model for the rest.

    ``rows`` carries ``partition`` and ``cv_fold``. Each row is scored once by
    the model that did not see it; the union keeps every row exactly once.
    """
    require_columns(rows, ["partition", "cv_fold", *predictors, target], "training rows")
    extra = {} if kind == "ridge" else {"seed": seed}
    train = rows.where("partition = 'train'")
    parts = []
    for k in range(1, folds + 1):
        if extra:
            extra = {"seed": seed + k}
        model = fit(train.where(F.col("cv_fold") != k), kind, predictors, target, **extra, **options)
        parts.append(score(train.where(F.col("cv_fold") == k), model).withColumn("prediction_source", F.lit("out_of_fold")))
    if extra:
        extra = {"seed": seed}
    final = fit(train, kind, predictors, target, **extra, **options)
    parts.append(
        score(rows.where("partition <> 'train'"), final).withColumn("prediction_source", F.lit("final_train_model"))
    )
    return reduce(DataFrame.unionByName, parts), final


def fold_summary(scored: DataFrame, target: str) -> DataFrame:
    e = F.col("q_pred") - F.col(target)
    train = scored.where("partition = 'train'")
    return train.groupBy("cv_fold").agg(
        F.count(F.lit(1)).alias("validation_row_count"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")
    )


def fit_classifier(rows: DataFrame, predictors: Sequence[str], label: str, *, weight: str | None = None, trees: int = 60,
                   seed: int = 1) -> PipelineModel:
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=8, seed=seed, **({"weightCol": weight} if weight else {})
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(predictors), outputCol="_x", handleInvalid="error"), forest]).fit(rows)


def positive_probability(rows: DataFrame, model: PipelineModel, out: str) -> DataFrame:
    scored = model.transform(rows)
    return scored.select(*rows.columns, clip(F.get(vector_to_array("probability"), F.lit(1)), 0.0, 1.0).alias(out))


def score_many(rows: DataFrame, models: Mapping[str, object]) -> DataFrame:
    """Long table of several models' predictions."""
    return reduce(
        DataFrame.unionByName, [score(rows, m).withColumn("model_id", F.lit(name)) for name, m in models.items()]
    )


def importance(model: PipelineModel, predictors: Sequence[str], spark) -> DataFrame:
    """Tree importance per predictor, largest first (one short row per predictor)."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(predictors, values)), "feature_name string, importance double").orderBy(
        F.desc("importance")
    )


def drop_one(train: DataFrame, test: DataFrame, kind: str, predictors: Sequence[str], target: str, **options) -> DataFrame:
    """Test error of the full predictor set and of each set with one predictor left out."""
    parts = []
    for left_out in [None, *predictors]:
        used = [p for p in predictors if p != left_out]
        e = F.col("q_pred") - F.col(target)
        scored = score(test, fit(train, kind, used, target, **options))
        parts.append(
            scored.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")).withColumn(
                "left_out", F.lit(left_out or "none")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def nearest_neighbours(rows: DataFrame, train: DataFrame, predictors: Sequence[str], target: str, k: int, key: str) -> DataFrame:
    """Mean target of the k training rows nearest in standardised space, exactly and without a cross join.

    Equal predictor vectors are counted once on each side. Training vectors are
    spread over a grid of the first two predictors; a query asks growing rings
    of cells, and stops being asked once its k-th neighbour is closer than the
    nearest cell it has not seen.
    """
    stats = {r["predictor"]: r for r in standardisation(train, predictors).collect()}  # one row per predictor
    z = [((F.col(p) - float(stats[p]["mu"])) / float(stats[p]["sigma"])).alias(f"_z{i}") for i, p in enumerate(predictors)]
    names = [f"_z{i}" for i in range(len(predictors))]
    points = train.select(*z, F.col(target).alias("_y")).groupBy(*names).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_m")
    )
    wanted = rows.select(*z).distinct()
    width, axes = 0.5, names[:2]
    cell = [F.floor(F.col(a) / width).cast("int").alias(f"_c{i}") for i, a in enumerate(axes)]
    points = points.select("*", *cell)
    pending = wanted.select("*", *cell)
    limits = points.agg(*[f(f"_c{i}").alias(f"{n}{i}") for i in range(len(axes)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    radius, done, top = 1, [], pending.agg(*[F.min(f"_c{i}").alias(f"a{i}") for i in range(len(axes))],
                                           *[F.max(f"_c{i}").alias(f"b{i}") for i in range(len(axes))]).first()
    reach = max(
        max(abs(limits[f"hi{i}"] - top[f"a{i}"]), abs(top[f"b{i}"] - limits[f"lo{i}"])) for i in range(len(axes))
    )
    while True:
        asked = pending
        for i in range(len(axes)):
            asked = asked.withColumn(f"_q{i}", F.explode(F.sequence(F.col(f"_c{i}") - radius, F.col(f"_c{i}") + radius)))
        right = points.select(*[F.col(n).alias(f"{n}t") for n in names], *[F.col(f"_c{i}").alias(f"_q{i}") for i in range(len(axes))], "_n", "_m")
        pairs = asked.join(right, [f"_q{i}" for i in range(len(axes))])
        distance = F.sqrt(reduce(lambda a, b: a + b, [(F.col(n) - F.col(f"{n}t")) ** 2 for n in names]))
        w = Window.partitionBy(*names).orderBy("_d", *[f"{n}t" for n in names])
        near = pairs.withColumn("_d", distance).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
        run = Window.partitionBy(*names).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        near = near.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
        take = F.greatest(F.lit(0), F.least(F.col("_n"), F.lit(k) - F.col("_before")))
        found = near.groupBy(*names).agg(
            F.sum(take).alias("_k"), (F.sum(take * F.col("_m")) / F.sum(take)).alias("prediction"),
            F.max(F.when(take > 0, F.col("_d"))).alias("_far"),
        )
        from fieldgrain.session import cut_lineage

        last = radius >= reach + 1
        settled = (F.col("_k") >= k) & (F.col("_far") <= radius * width) if not last else F.lit(True)
        found = cut_lineage(found.withColumn("_ok", settled))
        done.append(found.where("_ok").select(*names, "prediction"))
        pending = pending.join(found.where("_ok").select(*names), names, "left_anti")
        if last or pending.isEmpty():
            break
        pending = cut_lineage(pending)
        radius = min(radius * 2, reach + 1)
    answers = reduce(DataFrame.unionByName, done)
    return rows.select("*", *z).join(answers, names, "left").select(*rows.columns, F.col("prediction"))


# --- strategies and gates -----------------------------------------------------------------------------


def class_weights(rows: DataFrame, keys: Sequence[str], label: str, out: str) -> DataFrame:
    """Weights giving both classes half the mass; 1 everywhere when only one class occurs."""
    shares = rows.groupBy(*keys).agg(F.avg(label).alias("_p"))
    joined = null_safe_join(rows, shares, keys, "left") if keys else rows.crossJoin(F.broadcast(shares))  # one row
    p = F.col("_p")
    weight = F.when((p <= 0) | (p >= 1), 1.0).when(F.col(label) == 1, 0.5 / p).otherwise(0.5 / (1 - p))
    return joined.withColumn(out, weight).drop("_p")


def best_candidate(rows: DataFrame, candidates: Mapping[str, str], truth: str) -> DataFrame:
    """Per row, the candidate column closest to the truth (first wins a tie): the upper bound for any selector."""
    entries = F.array(
        *[
            F.struct(F.abs(F.col(c) - F.col(truth)).alias("e"), F.lit(i).alias("i"), F.col(c).alias("v"), F.lit(n).alias("n"))
            for i, (n, c) in enumerate(candidates.items())
        ]
    )
    best = F.array_min(F.filter(entries, lambda x: x["e"].isNotNull()))
    return rows.withColumn("_b", best).select(
        *rows.columns, F.col("_b.v").alias("oracle_value"), F.col("_b.n").alias("oracle_source")
    )


def window_strategies(rows: DataFrame, keys: Sequence[str], *, speed: str, window: str, mixed: str, purity: str,
                      effective: str, target: float) -> DataFrame:
    """Combine predictions of several window sizes at one place: mean, median, and three pick rules.

    Only places with at least two sizes count; ties go to the smaller window.
    """
    pick = lambda order: F.min_by(F.struct(F.col(speed).alias("v"), F.col(window).alias("w")), F.struct(order, F.col(window)))
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(speed).alias("_mean"),
        F.median(speed).alias("_median"),  # one value per window size
        pick(F.col(mixed)).alias("_mix"),
        pick(-F.col(purity)).alias("_pure"),
        pick(F.abs(F.col(effective) - target)).alias("_eff"),
    )
    none = F.lit(None).cast("double")
    w = lambda c: F.col(f"{c}.w").cast("double")
    entries = [
        ("mean", F.col("_mean"), none),
        ("median", F.col("_median"), none),
        ("lowest_predicted_mixedness", F.col("_mix.v"), w("_mix")),
        ("highest_predicted_purity", F.col("_pure.v"), w("_pure")),
        ("nearest_effective_window", F.col("_eff.v"), w("_eff")),
    ]
    long = F.array(
        *[F.struct(F.lit(n).alias("strategy_name"), v.alias("cs_strategy_m_s"), m.alias("source_window")) for n, v, m in entries]
    )
    return groups.where("_n >= 2").select(*keys, F.explode(long).alias("_s")).select(*keys, "_s.*")


def gated(rows: DataFrame, gain: Column, harm: Column, base: Column, candidate: Column, *, minimum_gain: float,
          maximum_harm: float) -> DataFrame:
    """Accept the candidate where the predicted gain is high enough and the predicted harm low enough."""
    accept = F.coalesce((gain > minimum_gain) & (harm < maximum_harm), F.lit(False))
    return rows.select("*", accept.alias("was_corrected"), F.when(accept, candidate).otherwise(base).alias("cs_strategy_m_s"))


def strategy_summary(rows: DataFrame, keys: Sequence[str], *, value: str, base: str, truth: str, changed: str,
                     margin: float = 0.5) -> DataFrame:
    """Errors of each strategy and how often its corrections helped or harmed by more than ``margin`` points."""
    ape = F.lit(100.0) * F.abs(F.col(value) - F.col(truth)) / F.col(truth)
    base_ape = F.lit(100.0) * F.abs(F.col(base) - F.col(truth)) / F.col(truth)
    e = rows.select(*keys, ape.alias("_a"), base_ape.alias("_b"), F.col(changed).cast("double").alias("_c"))
    return e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("N"),
        F.avg("_a").alias("MAPE_pct"),
        (F.lit(100.0) * F.avg((F.col("_a") > 20).cast("double"))).alias("high_error20_pct"),
        (F.lit(100.0) * F.avg("_c")).alias("corrected_pct"),
        (F.lit(100.0) * ratio(F.sum(F.when(F.col("_a") + margin < F.col("_b"), F.col("_c")).otherwise(0.0)), F.sum("_c"))).alias("improved_pct"),
        (F.lit(100.0) * ratio(F.sum(F.when(F.col("_a") > F.col("_b") + margin, F.col("_c")).otherwise(0.0)), F.sum("_c"))).alias("harmed_pct"),
    )


def success_table(summary: DataFrame, keys: Sequence[str], baseline: str, *, maximum_harm: float) -> DataFrame:
    """Pass or fail of each strategy against the baseline: lower error, no more large errors, little harm."""
    base = summary.where(F.col("strategy_name") == baseline).select(
        *keys, F.col("MAPE_pct").alias("_m"), F.col("high_error20_pct").alias("_h")
    )
    joined = null_safe_join(summary, base, keys, "left") if keys else summary.crossJoin(F.broadcast(base))  # one row
    other = joined.where(F.col("strategy_name") != baseline)
    gain = F.lit(100.0) * ratio(F.col("_m") - F.col("MAPE_pct"), F.col("_m"))
    passed = (F.col("MAPE_pct") < F.col("_m")) & (F.col("high_error20_pct") <= F.col("_h")) & (
        F.coalesce(F.col("harmed_pct"), F.lit(0.0)) <= maximum_harm
    )
    return other.select(*keys, "strategy_name", gain.alias("gain_pct"), (F.col("high_error20_pct") - F.col("_h")).alias("delta_high20_pct"), passed.alias("passed"))


def best_strategies(summary: DataFrame, harm_weight: float = 0.5) -> DataFrame:
    """Best strategy overall, by large errors, and by a harm-penalised trade-off."""
    criteria = {
        "lowest_mape": F.col("MAPE_pct"),
        "lowest_high_error": F.col("high_error20_pct"),
        "penalised": F.col("MAPE_pct") + harm_weight * F.coalesce(F.col("harmed_pct"), F.lit(0.0)),
    }
    picks = [
        F.struct(
            F.lit(n).alias("criterion"),
            F.min_by("strategy_name", F.struct(c, F.col("strategy_name"))).alias("strategy_name"),
            F.min(c).alias("value"),
        )
        for n, c in criteria.items()
    ]
    return summary.agg(F.array(*picks).alias("_p")).select(F.explode("_p").alias("_c")).select("_c.*")


# --- bundles ------------------------------------------------------------------------------------------


def save_model(model, folder: str, model_id: str, spark, **metadata) -> None:
    """Model and a metadata row in one folder; ``folder`` must be shared storage on a cluster."""
    if isinstance(model, RidgeModel):
        row = [(model_id, "ridge", model.to_json(), json.dumps(metadata))]
    else:
        model.write().overwrite().save(f"{folder}/{model_id}/pipeline")
        row = [(model_id, "pipeline", None, json.dumps(metadata))]
    frame = spark.createDataFrame(row, "model_id string, kind string, body string, metadata string")
    frame.coalesce(1).write.mode("overwrite").json(f"{folder}/{model_id}/manifest")


def load_model(folder: str, model_id: str, spark):
    row = spark.read.schema("model_id string, kind string, body string, metadata string").json(f"{folder}/{model_id}/manifest").first()
    if row is None or row["model_id"] != model_id:
        raise ValueError(f"no model {model_id!r} in {folder}")
    model = RidgeModel.from_json(row["body"]) if row["kind"] == "ridge" else PipelineModel.load(f"{folder}/{model_id}/pipeline")
    return model, json.loads(row["metadata"] or "{}")


def model_registry(folder: str, spark) -> DataFrame:
    """All manifests of a model folder as one table."""
    schema = "model_id string, kind string, body string, metadata string"
    return spark.read.schema(schema).json(f"{folder}/*/manifest").select("model_id", "kind", "metadata")
