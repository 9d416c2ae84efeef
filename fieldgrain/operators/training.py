"""Training study: a predictor contract that stops the fit, out-of-fold scores for every row, error tables by group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldgrain.operators.models import out_of_fold
from fieldgrain.operators.registry import predictor_contract

FAULTS = ("duplicated", "missing", "nonnumeric", "forbidden")


class ContractBroken(ValueError):
    """A predictor may not be used; no model was fitted."""


def require_contract(rows: DataFrame, predictors: Sequence[str]) -> None:
    """Raise with every predictor that is repeated, absent, not numeric, leaking, or not finite in some row."""
    if not predictors:
        raise ContractBroken("no predictors")
    broken = predictor_contract(rows, predictors).where(~F.col("accepted")).orderBy("predictor").collect()  # one row per predictor
    said = []
    for row in broken:
        why = [f for f in FAULTS if row[f]] + ([f"{row['nonfinite_count']} values not finite"] if row["nonfinite_count"] else [])
        said.append(f"{row['predictor']} ({', '.join(why)})")
    if said:
        raise ContractBroken(f"predictors break the contract: {'; '.join(said)}")


def error_tables(scored: DataFrame, error: Column, groupings: Mapping[str, Sequence[str]], keys: Sequence[str] = ("partition",)) -> DataFrame:
    """Row count, MAE, RMSE and bias for many groupings: table_name, keys, level_1.., in one pass over the rows.

    Rows are first summed by all grouping columns together. Only these sums are dealt out to the groupings, so what is
    copied is bounded by the number of level combinations and not by the rows. Rows without an error are left out; a
    null level is a level.
    """
    width = max(len(c) for c in groupings.values())
    used = list(dict.fromkeys(c for columns in groupings.values() for c in columns))
    rows = scored.select(*keys, *[F.col(c).cast("string").alias(c) for c in used], error.cast("double").alias("_e")).where(F.col("_e").isNotNull())
    sums = rows.groupBy(*keys, *used).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.abs("_e")).alias("_a"), F.sum(F.col("_e") * F.col("_e")).alias("_s"), F.sum("_e").alias("_b")
    )
    none = F.lit(None).cast("string")
    tables = [
        F.struct(F.lit(name).alias("table_name"), *[(F.col(columns[i]) if i < len(columns) else none).alias(f"level_{i + 1}") for i in range(width)])
        for name, columns in groupings.items()
    ]
    levels = [f"level_{i + 1}" for i in range(width)]
    dealt = sums.select(*keys, "_n", "_a", "_s", "_b", F.explode(F.array(*tables)).alias("_t")).select(*keys, "_n", "_a", "_s", "_b", "_t.*")
    total = dealt.groupBy("table_name", *keys, *levels).agg(*[F.sum(c).alias(c) for c in ("_n", "_a", "_s", "_b")])
    n = F.col("_n")
    return total.select(
        "table_name", *keys, *levels, n.alias("row_count"), (F.col("_a") / n).alias("q_mae"), F.sqrt(F.col("_s") / n).alias("q_rmse"), (F.col("_b") / n).alias("q_bias")
    )


def training_study(rows: DataFrame, kind: str, predictors: Sequence[str], target: str, groupings: Mapping[str, Sequence[str]], folds: int, **options):
    """Contract, out-of-fold scores and error tables: returns the scored rows, the final model and the tables.

    ``rows`` carries ``partition`` and ``cv_fold``. A training row is scored by the model of its fold, which has not seen
    it, every other row by the final model.
    """
    require_contract(rows, predictors)
    scored, model = out_of_fold(rows, kind, predictors, target, folds, **options)
    return scored, model, error_tables(scored, F.col("q_pred") - F.col(target), groupings, ("partition", "prediction_source"))
