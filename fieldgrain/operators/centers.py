"""Spatially separated window centres, chosen for what the coverage grid still lacks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fieldgrain.functions.semantics import hash_text
from fieldgrain.operators.sampling import tie_key
from fieldgrain.session import cut_lineage

CHOSEN = "array<struct<cx:int,cz:int,cell:string>>"


def directed_centers(candidates: DataFrame, requests: DataFrame, *, per_cell: int, distance: float, step: int, seed: int = 1) -> DataFrame:
    """For each run, centres of the requested cells in request order and hashed order inside a cell,
    skipping centres nearer than ``distance`` to one already taken, up to each cell's quota.

    ``candidates``: run_id, cx, cz, cell_key on a grid of spacing ``step``.
    ``requests``: cell_key, ordinal, needed.

    Taking one centre rules out at most the grid points within ``distance``.
    With all quotas adding up to Q, a cell can therefore be served from its
    first Q * (points within distance) + quota candidates, so that exact rank
    filter bounds what one task has to walk through.
    """
    quota = F.least(F.col("needed"), F.lit(per_cell))
    wanted = requests.select("cell_key", "ordinal", quota.alias("quota")).where("quota > 0")
    total = wanted.agg(F.sum("quota").alias("total_quota"))
    blocked = (2 * math.floor(distance / step) + 1) ** 2
    joined = candidates.join(wanted, "cell_key").crossJoin(F.broadcast(total))  # one row
    joined = joined.withColumn("_h", hash_text(seed, "run_id", "cx", "cz"))
    w = Window.partitionBy("run_id", "cell_key").orderBy("_h", "cz", "cx")
    near = joined.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("total_quota") * blocked + F.col("quota"))

    def walk(batch: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, int]] = []
        kept: list[int] = []
        counts: dict[int, int] = {}
        for row in batch.sort_values(["ordinal", "_r"]).itertuples():
            if counts.get(row.ordinal, 0) >= row.quota:
                continue
            if any(math.hypot(row.cx - x, row.cz - z) < distance for x, z in taken):
                continue
            taken.append((row.cx, row.cz))
            counts[row.ordinal] = counts.get(row.ordinal, 0) + 1
            kept.append(row.Index)
        out = batch.loc[kept, ["run_id", "cx", "cz", "cell_key", "ordinal"]].copy()
        out["center_rank"] = range(1, len(out) + 1)
        return out

    types = dict(candidates.dtypes)
    schema = f"run_id {types['run_id']}, cx {types['cx']}, cz {types['cz']}, cell_key string, ordinal int, center_rank int"
    needed = near.select("run_id", "cx", "cz", "cell_key", F.col("ordinal").cast("int").alias("ordinal"), "quota", "_r")
    return needed.groupBy("run_id").applyInPandas(walk, schema)


def deficit_centers(candidates: DataFrame, state: DataFrame, targets: DataFrame, *, per_run: int, per_cell: int, window: int,
                    realizations: int, policy: str = "uniform", fraction: float = 0.5, target_fraction: float = 0.5,
                    different_fraction: float = 0.25, same_fraction: float = 0.5, seed: int = 1) -> DataFrame:
    """Starting from each run's target centre, repeatedly add the candidate whose cell lacks most.

    Order: run deficit, condition deficit, example deficit, score, never
    observed, distance to the nearest chosen centre, tie key. One round is one
    grouped maximum over the candidates with map-side combine, so a run of any
    size is never held by one task; ``per_run`` rounds are needed.

    ``candidates``: run_id, cx, cz, cell_key. ``targets``: run_id, cx, cz, cell_key (the first centre of a run).
    ``state``: cell_key, coverage_complete, example_count and the three deficits, deficit_score.
    """
    if policy not in ("uniform", "relationship_aware"):
        raise ValueError("policy must be uniform or relationship_aware")
    e, r, c = F.col("example_deficit"), F.col("independent_run_deficit"), F.col("independent_condition_deficit")
    needed = F.greatest(F.ceil(e / F.lit(float(realizations))), (r > 0).cast("long"), (c > 0).cast("long"))
    open_cells = state.where(~F.col("coverage_complete")).select(
        "cell_key", r.alias("_r"), c.alias("_c"), e.alias("_e"), F.col("deficit_score").alias("_s"),
        (F.col("example_count") == 0).cast("int").alias("_never"),
        F.least(F.lit(per_cell), F.greatest(F.lit(1), needed)).alias("_quota"),
    )
    pool = cut_lineage(candidates.join(open_cells, "cell_key").withColumn("_tie", tie_key("cx", "cz", seed)))
    first = F.array(F.struct(F.col("cx").cast("int").alias("cx"), F.col("cz").cast("int").alias("cz"), F.col("cell_key").alias("cell")))
    chosen = cut_lineage(targets.select("run_id", first.cast(CHOSEN).alias("chosen")))
    for _ in range(per_run - 1):
        joined = pool.join(chosen, "run_id")

        def gap(p):
            return F.hypot(p["cx"] - F.col("cx"), p["cz"] - F.col("cz"))

        def required(p, i):
            if policy == "uniform":
                return F.lit(fraction * window)
            same = F.when(p["cell"] == F.col("cell_key"), same_fraction * window).otherwise(different_fraction * window)
            return F.when(i == 0, F.lit(target_fraction * window)).otherwise(same)

        spaced = F.size(F.filter("chosen", lambda p, i: (gap(p) < required(p, i)) | (gap(p) == 0))) == 0
        room = F.size(F.filter("chosen", lambda p: p["cell"] == F.col("cell_key"))) < F.col("_quota")
        rank = F.struct(
            "_r", "_c", "_e", "_s", "_never", F.array_min(F.transform("chosen", gap)).alias("_gap"), (-F.col("_tie")).alias("_t"),
            F.col("cx").cast("int").alias("cx"), F.col("cz").cast("int").alias("cz"), F.col("cell_key").alias("cell"),
        )
        best = joined.groupBy("run_id").agg(F.max(F.when(spaced & room, rank)).alias("_b")).where("_b is not null")
        grown = chosen.join(best, "run_id", "left").select(
            "run_id",
            F.when(F.col("_b").isNull(), F.col("chosen"))
            .otherwise(F.concat("chosen", F.array(F.struct("_b.cx", "_b.cz", "_b.cell")).cast(CHOSEN)))
            .alias("chosen"),
            F.col("_b").isNotNull().alias("_grew"),
        )
        grown = cut_lineage(grown)
        chosen = grown.drop("_grew")
        if grown.where("_grew").isEmpty():
            break
    return chosen.select("run_id", F.posexplode("chosen").alias("_i", "_p")).select(
        "run_id",
        (F.col("_i") + 1).alias("center_rank"),
        F.col("_p.cx").alias("cx"),
        F.col("_p.cz").alias("cz"),
        F.col("_p.cell").alias("cell_key"),
        F.when(F.col("_i") == 0, "analytic_target").otherwise("opportunistic_deficit_fill").alias("center_selection_role"),
    )
