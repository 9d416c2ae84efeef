"""Quota, balanced and stratified selection.

Rank filters of the form ``row_number() <= k`` let Spark drop rows per map
task before the shuffle (group limit), so an oversized group costs at most k
rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgrain.functions.semantics import bin_index, hash_text, null_safe_join, require_columns
from fieldgrain.operators.coverage import distinct_counts


def lowest_hash(rows: DataFrame, keys: Sequence[str], item: Sequence[str], k: int, seed: int | str, rank: str) -> DataFrame:
    """Seeded sample without replacement: the k smallest hashes of each group, with their rank."""
    if k < 1:
        raise ValueError("the quota must be positive")
    order = Window.partitionBy(*keys).orderBy(hash_text(seed, *item), *item)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def patch_quota(rows: DataFrame, quota: int, *, run: str = "campaign_run_id", seed: int = 1) -> DataFrame:
    """At most ``quota`` patches of each run, with ``quota_selection_rank``."""
    require_columns(rows, [run, "example_id"], "patch candidates")
    return lowest_hash(rows, [run], ["example_id"], quota, seed, "quota_selection_rank")


def quota_diagnostics(rows: DataFrame, quota: int, run: str = "campaign_run_id") -> DataFrame:
    available = F.col("available_patch_count")
    return (
        rows.groupBy(run)
        .agg(F.count(F.lit(1)).alias("available_patch_count"))
        .select(
            run,
            available,
            F.least(available, F.lit(quota)).alias("selected_patch_count"),
            F.greatest(F.lit(quota) - available, F.lit(0)).alias("deficit_patch_count"),
            (available >= quota).alias("complete"),
            (available > quota).alias("subsampled"),
        )
    )


def balanced_selection(
    assigned: DataFrame,
    *,
    conditions_per_cell: int,
    runs_per_condition: int,
    patches_per_run: int,
    seed: int = 1,
    cell: str = "coverage_cell_key",
    condition: str = "campaign_condition_id",
    run: str = "campaign_run_id",
) -> DataFrame:
    """Three nested caps: conditions in a cell, runs of a condition in that cell, patches of a run in that cell."""
    valid = assigned.where("coverage_valid")
    conditions = lowest_hash(valid.select(cell, condition).distinct(), [cell], [condition], conditions_per_cell, seed, "_r")
    runs = valid.select(cell, condition, run).distinct().join(conditions.drop("_r"), [cell, condition])
    runs = lowest_hash(runs, [cell, condition], [run], runs_per_condition, seed, "_r")
    rows = valid.join(runs.drop("_r"), [cell, condition, run])
    return lowest_hash(rows, [cell, condition, run], ["example_id"], patches_per_run, seed, "_r").drop("_r")


def balanced_weights(
    selected: DataFrame,
    *,
    cell: str = "coverage_cell_key",
    condition: str = "campaign_condition_id",
    run: str = "campaign_run_id",
) -> DataFrame:
    """Equal total weight per cell, per condition in it, per run in that, per patch in that; mean weight 1.

    The raw weights sum to one, so scaling to mean 1 multiplies by the number of rows.
    """
    by_run = selected.groupBy(cell, condition, run).agg(F.count(F.lit(1)).alias("_patches"))
    by_condition = by_run.groupBy(cell, condition).agg(F.count(F.lit(1)).alias("_runs"), F.sum("_patches").alias("_p"))
    by_cell = by_condition.groupBy(cell).agg(F.count(F.lit(1)).alias("_conditions"), F.sum("_p").alias("_p"))
    total = by_cell.agg(F.count(F.lit(1)).alias("_cells"), F.sum("_p").alias("_rows"))
    shares = (
        by_run.join(by_condition.drop("_p"), [cell, condition])
        .join(by_cell.drop("_p"), cell)
        .crossJoin(F.broadcast(total))  # one row
    )
    weight = F.col("_rows") / (F.col("_cells") * F.col("_conditions") * F.col("_runs") * F.col("_patches"))
    return selected.join(shares.select(cell, condition, run, weight.alias("training_weight")), [cell, condition, run])


def balance_summary(assigned: DataFrame, selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Available against selected rows, runs and conditions per group."""
    columns = {"run_count": "campaign_run_id", "condition_count": "campaign_condition_id"}

    def side(rows: DataFrame, name: str) -> DataFrame:
        counts = distinct_counts(rows.select(*keys, *columns.values()), keys, columns, "example_count")
        return counts.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("example_count", *columns)])

    out = null_safe_join(side(assigned.where("coverage_valid"), "available"), side(selected, "selected"), keys, "left")
    filled = [c for c in out.columns if c.startswith("selected_")]
    out = out.fillna(0, filled)
    return out.withColumn("selected_fraction", F.col("selected_example_count") / F.col("available_example_count"))


def with_numeric_bin(rows: DataFrame, column: str, edges: Sequence[float], out: str) -> DataFrame:
    return rows.withColumn(out, bin_index(column, edges))


def tie_key(cx: Column | str, cz: Column | str, seed: int) -> Column:
    """Deterministic pseudo-random order key of a grid position."""
    # The three multipliers and the modulus that define the key.
    x = (F.col(cx) if isinstance(cx, str) else cx).cast("long") * F.lit(73856093).cast("long")
    z = (F.col(cz) if isinstance(cz, str) else cz).cast("long") * F.lit(19349663).cast("long")
    return F.pmod(x + z + F.lit(seed).cast("long") * F.lit(83492791).cast("long"), F.lit(2147483647).cast("long"))


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def spatial_subsample(rows: DataFrame, x: str, z: str, step: int) -> DataFrame:
    """Keep grid positions on every ``step``-th row and column of each map."""
    return rows.where((F.col(x) % step == 0) & (F.col(z) % step == 0))


def first_requests(deficits: DataFrame, n: int) -> DataFrame:
    """The n most urgent deficits, numbered; input order columns are the deficit order."""
    from fieldgrain.operators.coverage import BINS

    order = [F.desc("deficit_score"), *BINS]
    urgent = deficits.orderBy(*order).limit(n)
    # At most n rows are left, so one small window numbers them.
    return urgent.withColumn("_one", F.lit(1)).withColumn(
        "request_index", F.row_number().over(Window.partitionBy("_one").orderBy(*order))
    ).drop("_one")
