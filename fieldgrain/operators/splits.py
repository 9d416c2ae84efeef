"""Leakage-free splits by condition, folds, hold-outs, and their integrity checks.

Random order is the order of a seeded md5 of the identifier: the same on any
partitioning. Only distinct conditions are ranked, never rows, and the rank
itself is computed in hash ranges rather than in one sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fieldgrain.functions.semantics import require_columns
from fieldgrain.operators.order_stats import hash_positions

PARTITIONS = ("train", "validation", "test")


def condition_id(columns: Sequence[str]) -> Column:
    """Stable text key ``name=value__name=value``; separators inside values are replaced."""
    parts = []
    for c in columns:
        text = F.coalesce(F.col(c).cast("string"), F.lit("NaN"))
        text = F.replace(F.replace(text, F.lit("__"), F.lit("_")), F.lit("="), F.lit("-"))
        parts.append(F.concat(F.lit(f"{c}="), text))
    return F.concat_ws("__", *parts)


def assign_partitions(
    conditions: DataFrame, condition: str, *, train: float = 0.7, validation: float = 0.15, seed: int = 1
) -> DataFrame:
    """Partition of every distinct condition: floor counts for train and validation, the rest is test."""
    if train <= 0 or validation <= 0 or train + validation >= 1:
        raise ValueError("train and validation shares must be positive and leave room for test")
    ranked = hash_positions(conditions.select(condition).distinct(), [], [condition], seed)
    # The small nudge keeps exact products such as 0.7 * 10 from flooring one too low.
    n_train = F.floor(F.col("group_size") * train + 1e-9)
    n_validation = F.floor(F.col("group_size") * validation + 1e-9)
    return ranked.select(
        condition,
        F.when(F.col("position") <= n_train, "train")
        .when(F.col("position") <= n_train + n_validation, "validation")
        .otherwise("test")
        .alias("partition"),
    )


def grouped_split(rows: DataFrame, condition: str = "campaign_condition_id", **options) -> DataFrame:
    """Every row with the partition of its condition."""
    require_columns(rows, [condition], "example table")
    return rows.join(assign_partitions(rows, condition, **options), condition)


def grouped_folds(split: DataFrame, k: int, condition: str = "campaign_condition_id", *, seed: int = 1) -> DataFrame:
    """Round-robin fold of each training condition; other rows get fold 0."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    train = split.where(F.col("partition") == "train").select(condition).distinct()
    folds = hash_positions(train, [], [condition], f"fold:{seed}").select(
        condition, (F.pmod(F.col("position") - 1, F.lit(k)) + 1).cast("int").alias("cv_fold")
    )
    return split.join(folds, condition, "left").fillna(0, ["cv_fold"])


def split_violations(split: DataFrame, identifiers: Sequence[str], label: str = "partition") -> DataFrame:
    """Identifiers that occur under more than one label (none in a sound split)."""
    parts = [
        split.select(F.lit(i).alias("identifier"), F.col(i).cast("string").alias("value"), F.col(label).alias("label"))
        for i in identifiers
    ]
    pairs = reduce(DataFrame.unionByName, parts).distinct()
    return pairs.groupBy("identifier", "value").agg(F.count(F.lit(1)).alias("label_count")).where("label_count > 1")


def split_checks(split: DataFrame, run: str = "campaign_run_id", condition: str = "campaign_condition_id") -> DataFrame:
    """One row per integrity check: complete labels, no leaking run or condition, all partitions present."""
    leaks = split_violations(split, [run, condition]).agg(
        F.count_if(F.col("identifier") == run).alias("run_leaks"),
        F.count_if(F.col("identifier") == condition).alias("condition_leaks"),
    )
    totals = split.agg(
        F.count_if(F.col("partition").isNull() | ~F.col("partition").isin(*PARTITIONS)).alias("unassigned"),
        *[F.count_if(F.col("partition") == p).alias(p) for p in PARTITIONS],
    )
    one = totals.crossJoin(leaks)  # one row by one row
    checks = [
        ("complete_assignment", F.col("unassigned"), F.col("unassigned") == 0),
        ("runs_in_one_partition", F.col("run_leaks"), F.col("run_leaks") == 0),
        ("conditions_in_one_partition", F.col("condition_leaks"), F.col("condition_leaks") == 0),
        *[(f"{p}_not_empty", F.col(p), F.col(p) > 0) for p in PARTITIONS],
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), v.alias("value"), ok.alias("passed")) for n, v, ok in checks])
    return one.select(F.explode(rows).alias("c")).select("c.*")


def fold_checks(folds: DataFrame, k: int, condition: str = "campaign_condition_id") -> DataFrame:
    """Fold integrity: every training row in 1..k, none elsewhere, no condition in two folds, no empty fold."""
    train = F.col("partition") == "train"
    totals = folds.agg(
        F.count_if(train & ~F.col("cv_fold").between(1, k)).alias("bad_train"),
        F.count_if(~train & (F.col("cv_fold") != 0)).alias("bad_other"),
        F.count_distinct(F.when(train, F.col("cv_fold"))).alias("used"),
    )
    leaks = split_violations(folds.where(train), [condition], "cv_fold").agg(F.count(F.lit(1)).alias("leaks"))
    one = totals.crossJoin(leaks)  # one row by one row
    checks = [
        ("train_rows_have_fold", F.col("bad_train"), F.col("bad_train") == 0),
        ("other_rows_have_none", F.col("bad_other"), F.col("bad_other") == 0),
        ("conditions_in_one_fold", F.col("leaks"), F.col("leaks") == 0),
        ("folds_not_empty", F.col("used"), F.col("used") == k),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), v.alias("value"), ok.alias("passed")) for n, v, ok in checks])
    return one.select(F.explode(rows).alias("c")).select("c.*")


def split_summary(
    split: DataFrame, by: Sequence[str], run: str = "campaign_run_id", condition: str = "campaign_condition_id"
) -> DataFrame:
    """Distinct conditions, distinct runs and rows per partition or fold, via one (label, run, condition) pre-count."""
    pairs = split.groupBy(*by, run, condition).agg(F.count(F.lit(1)).alias("_n"))
    runs = pairs.groupBy(*by, run).agg(F.sum("_n").alias("_n"))
    conditions = pairs.groupBy(*by, condition).agg(F.lit(1).alias("_one"))
    return (
        runs.groupBy(*by)
        .agg(F.sum("_n").alias("row_count"), F.count(F.lit(1)).alias("run_count"))
        .join(conditions.groupBy(*by).agg(F.count(F.lit(1)).alias("condition_count")), list(by))
    )


def holdout_split(
    rows: DataFrame,
    held_out: Column,
    condition: str = "campaign_condition_id",
    *,
    validation: float = 0.15,
    seed: int = 1,
) -> DataFrame:
    """Held-out conditions are test; a hashed share of the other conditions is validation, the rest train.

    A condition is held out when any of its rows matches, so none is split.
    """
    marks = rows.groupBy(condition).agg(F.max(held_out.cast("int")).alias("_held"))
    rest = hash_positions(marks.where("_held = 0").select(condition), [], [condition], seed)
    n_validation = F.greatest(F.lit(1), F.round(F.col("group_size") * validation))
    labels = rest.select(
        condition, F.when(F.col("position") <= n_validation, "validation").otherwise("train").alias("partition")
    ).unionByName(marks.where("_held = 1").select(condition, F.lit("test").alias("partition")))
    return rows.join(labels, condition)


def holdout_specifications(conditions: DataFrame, axes: Sequence[str], joint: Mapping[str, str] | None = None) -> DataFrame:
    """One hold-out per level of each axis, plus one joint specification."""
    parts = [
        conditions.select(
            F.lit(a).alias("axis"),
            F.col(a).cast("string").alias("level"),
            F.concat(F.lit(f"{a}="), F.col(a).cast("string")).alias("holdout_id"),
        ).distinct()
        for a in axes
    ]
    out = reduce(DataFrame.unionByName, parts)
    if joint:
        text = "&".join(f"{k}={v}" for k, v in joint.items())
        one = conditions.sparkSession.range(1).select(
            F.lit("joint").alias("axis"), F.lit(text).alias("level"), F.lit(text).alias("holdout_id")
        )
        out = out.unionByName(one)
    return out


def alternating_levels(rows: DataFrame, axis: str) -> DataFrame:
    """Every second level of an axis is test, by dense rank of the distinct levels (a design-sized table)."""
    from fieldgrain.operators.order_stats import running_totals

    levels = running_totals(rows.select(axis).distinct(), [], axis, {"n": F.count(F.lit(1))}).select(
        axis, F.when(F.col("n_upto") % 2 == 0, "test").otherwise("train").alias("partition")
    )
    return rows.join(levels, axis)


def support_disjoint(split: DataFrame, axis: str) -> DataFrame:
    """Train and test levels of an axis: how many, how many shared, and whether together they cover the axis."""
    sides = split.groupBy(axis).agg(
        F.max((F.col("partition") == "train").cast("int")).alias("_a"),
        F.max((F.col("partition") == "test").cast("int")).alias("_b"),
    )
    return sides.agg(
        F.sum("_a").alias("train_levels"),
        F.sum("_b").alias("test_levels"),
        F.sum(F.col("_a") * F.col("_b")).alias("shared_levels"),
        F.sum(((F.col("_a") + F.col("_b")) == 0).cast("int")).alias("uncovered_levels"),
    )


def repeated_splits(rows: DataFrame, seeds: Sequence[int], condition: str = "campaign_condition_id", **options) -> DataFrame:
    """Condition partitions under several seeds, stacked with a fold name (conditions only, join to rows on use)."""
    conditions = rows.select(condition).distinct()
    parts = [
        assign_partitions(conditions, condition, seed=s, **options).withColumn("fold_name", F.lit(f"seed_{s}"))
        for s in seeds
    ]
    return reduce(DataFrame.unionByName, parts)


def domain_transfer_splits(rows: DataFrame, axis: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """For each (train level, test level) pair, the conditions of either side."""
    level = F.col(axis).cast("string")
    entries = [
        F.struct(
            F.lit(f"{a}_to_{b}").alias("fold_name"),
            F.when(level == a, "train").when(level == b, "test").alias("partition"),
        )
        for a, b in pairs
    ]
    return rows.select("*", F.explode(F.array(*entries)).alias("_s")).select("*", "_s.*").drop("_s").where(
        F.col("partition").isNotNull()
    )


def compare_frozen(current: DataFrame, frozen: DataFrame, key: str = "example_id") -> DataFrame:
    """Counts of every way a frozen split can disagree with the current rows."""
    carried = [c for c in ("campaign_condition_id", "campaign_run_id") if c in frozen.columns and c in current.columns]
    a = current.groupBy(key).agg(F.count(F.lit(1)).alias("_ca"), *[F.max(c).alias(f"_a_{c}") for c in carried])
    b = frozen.groupBy(key).agg(F.count(F.lit(1)).alias("_cb"), *[F.max(c).alias(f"_b_{c}") for c in carried])
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("_ca") > 1).alias("duplicate_current_ids"),
        F.count_if(F.col("_cb") > 1).alias("duplicate_frozen_ids"),
        F.count_if(F.col("_ca").isNull()).alias("missing_in_current"),
        F.count_if(F.col("_cb").isNull()).alias("missing_in_frozen"),
        *[
            F.count_if(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) & F.col("_ca").isNotNull() & F.col("_cb").isNotNull()).alias(
                f"changed_{c}"
            )
            for c in carried
        ],
    )


