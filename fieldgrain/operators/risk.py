"""Risk of a large error and gates on corrections, learned as rates of feature cells and read off their counts.

A model here is a table of cells (combinations of binned features). Its out-of-fold values need one pass: the sums of a
cell over all training rows less those of the row's own fold, so no fold is fitted by itself. Rows of the other
partitions get the sums over all training rows. A rate is drawn towards the rate of all cells by ``prior`` rows, so cells
without rows have a value too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgrain.functions.semantics import ratio, steady_sum
from fieldgrain.operators.metrics import curve_areas
from fieldgrain.session import stored


def cell_means(rows: DataFrame, cells: Sequence[str], values: Mapping[str, str], *, fold: str = "cv_fold", prior: float = 20.0) -> DataFrame:
    """The rows with a predicted mean of each value (``values``: new column -> value), out of fold for training rows.

    ``fold`` is null for the rows outside training; they do not teach. Sums by (cell, fold) are made once.
    """
    n = {out: F.count(c) for out, c in values.items()}
    s = {out: F.sum(c) for out, c in values.items()}
    # written once: Spark then knows how small the sums are and does not deal out the rows to meet them
    taught = stored(rows.where(F.col(fold).isNotNull()).groupBy(*cells, fold).agg(
        *[c.alias(f"_n_{o}") for o, c in n.items()], *[c.alias(f"_s_{o}") for o, c in s.items()]
    ))
    names = [f"_{k}_{o}" for o in values for k in ("n", "s")]
    whole = taught.groupBy(*cells).agg(*[F.sum(c).alias(f"{c}_cell") for c in names])
    every = taught.agg(*[F.sum(c).alias(f"{c}_all") for c in names])
    own = taught.withColumnsRenamed({c: f"_c_{c}" for c in [*cells, fold]})
    cell_sums = whole.withColumnsRenamed({c: f"_w_{c}" for c in cells})
    same = lambda mark, columns: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{mark}{c}")) for c in columns])
    met = rows.join(cell_sums, same("_w_", cells), "left").join(own, same("_c_", cells) & (F.col(fold) == F.col(f"_c_{fold}")), "left")
    met = met.crossJoin(F.broadcast(every))  # one row
    out = {}
    for o in values:
        left = {k: F.coalesce(F.col(f"_{k}_{o}_cell"), F.lit(0)) - F.coalesce(F.col(f"_{k}_{o}"), F.lit(0)) for k in ("n", "s")}
        mean = ratio(F.col(f"_s_{o}_all"), F.col(f"_n_{o}_all"))
        out[o] = (left["s"] + prior * mean) / (left["n"] + prior)
    return met.select(*[F.col(c) for c in rows.columns], *[c.alias(o) for o, c in out.items()])


# --- risk mask ------------------------------------------------------------------------------------------------


def risk_counts(rows: DataFrame, group: str, risk: str, error: str, *, limits: Sequence[int] = (10, 20)) -> DataFrame:
    """Counts by (group, risk): rows, summed error, rows beyond each limit. All tables below read only these."""
    high = {k: (F.col(error) > k).cast("long") for k in limits}
    return rows.groupBy(group, risk).agg(
        F.count(F.lit(1)).alias("n"), F.sum(error).alias("error_sum"), *[F.sum(h).alias(f"high{k}") for k, h in high.items()]
    )


def risk_thresholds(counts: DataFrame, group: str, risk: str, thresholds: Sequence[float]) -> DataFrame:
    """Per group and threshold: share and errors of the rows at or above it, and how well it finds large errors."""
    cut = counts.withColumn("risk_threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    low = F.col(risk) >= F.col("risk_threshold")
    pick = lambda c, here: F.sum(F.when(here, F.col(c)).otherwise(0))
    return cut.groupBy(group, "risk_threshold").agg(
        F.sum("n").alias("N"),
        (100 * pick("n", low) / F.sum("n")).alias("low_confidence_pct"),
        ratio(pick("error_sum", ~low), pick("n", ~low)).alias("MAPE_high_confidence"),
        ratio(pick("error_sum", low), pick("n", low)).alias("MAPE_low_confidence"),
        (100 * ratio(pick("high20", ~low), pick("n", ~low))).alias("high20_rate_high_confidence"),
        (100 * ratio(pick("high20", low), pick("n", low))).alias("precision_high20_pct"),
        (100 * ratio(pick("high20", low), F.sum("high20"))).alias("recall_high20_pct"),
    )


def risk_calibration(counts: DataFrame, group: str, risk: str, edges: Sequence[float]) -> DataFrame:
    """Per group and risk bin: predicted and observed rate of large errors. The last bin is closed above."""
    at = sum((F.col(risk) >= e).cast("int") for e in edges[1:-1])
    low = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), at + 1)
    inside = counts.where((F.col(risk) >= edges[0]) & (F.col(risk) <= edges[-1])).withColumn("risk_bin_low", low)
    return inside.groupBy(group, "risk_bin_low").agg(
        F.sum("n").alias("N"),
        (F.sum(F.col(risk) * F.col("n")) / F.sum("n")).alias("mean_predicted_risk"),
        (100 * F.sum("high20") / F.sum("n")).alias("observed_high20_rate_pct"),
        (F.sum("error_sum") / F.sum("n")).alias("MAPE_pct"),
    )


def risk_areas(rows: DataFrame, group: str, risk: str, error: str, limit: float = 20) -> DataFrame:
    """ROC and PR areas of the risk as a score for errors beyond the limit."""
    scored = rows.select(group, F.col(risk).alias("_score"), (F.col(error) > limit).cast("int").alias("_truth"))
    return curve_areas(scored, [group], "_score", "_truth")


# --- gain and harm gates --------------------------------------------------------------------------------------


def candidate_rows(rows: DataFrame, candidates: Mapping[str, Column], truth: str, base: str, *, harm_margin: float) -> DataFrame:
    """One row per row and candidate: its error, the gain over the base error and whether it harms (``harm``, 0 or 1)."""
    error = lambda c: 100 * F.abs(c - F.col(truth)) / F.col(truth)
    entries = F.array(*[F.struct(F.lit(n).alias("candidate"), error(c).alias("candidate_error")) for n, c in candidates.items()])
    out = rows.withColumn("base_error", error(F.col(base))).select("*", F.explode(entries).alias("_e")).select("*", "_e.*").drop("_e")
    gain = F.col("base_error") - F.col("candidate_error")
    harm = (F.col("candidate_error") > F.col("base_error") + harm_margin).cast("int")
    return out.withColumns({"gain": gain, "harm": harm})


def gate_choice(scored: DataFrame, gains: Sequence[float], harms: Sequence[float], *, most_harm_pct: float) -> DataFrame:
    """One row per candidate: the pair of thresholds with the largest total gain whose accepted rows are harmed no more
    often than allowed; ties go to the larger gain threshold, then the smaller harm threshold.

    Training rows are counted by how many thresholds they pass, so the pairs are tried on a small joint table. Pairs that
    accept the same rows must tie, so gains are summed the same in any order.
    """
    passed_gain = sum((F.col("expected_gain") >= g).cast("int") for g in gains)
    passed_harm = sum((F.col("harm_probability") <= h).cast("int") for h in harms)
    counts = scored.where(F.col("cv_fold").isNotNull()).groupBy("candidate", passed_gain.alias("_g"), passed_harm.alias("_h")).agg(
        F.count(F.lit(1)).alias("_n"), steady_sum("gain").alias("_gain"), F.sum("harm").alias("_harm")
    )
    # thresholds in the order in which a row passes them: gains ascending, harms descending
    pairs = [F.struct(F.lit(i + 1).alias("i"), F.lit(float(g)).alias("min_gain"), F.lit(j + 1).alias("j"), F.lit(float(h)).alias("max_harm"))
             for i, g in enumerate(sorted(gains)) for j, h in enumerate(sorted(harms, reverse=True))]
    tried = counts.withColumn("_p", F.explode(F.array(*pairs))).where((F.col("_g") >= F.col("_p.i")) & (F.col("_h") >= F.col("_p.j")))
    totals = tried.groupBy("candidate", "_p.min_gain", "_p.max_harm").agg(
        F.sum("_n").alias("accepted"), steady_sum("_gain").alias("total_gain"), (100 * F.sum("_harm") / F.sum("_n")).alias("harm_pct")
    ).where(F.col("harm_pct") <= most_harm_pct)
    best = Window.partitionBy("candidate").orderBy(F.round("total_gain", 6).desc(), F.desc("min_gain"), "max_harm")
    return totals.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def gated(scored: DataFrame, choice: DataFrame, keys: Sequence[str], *, harm_penalty: float) -> DataFrame:
    """One row per ``keys``: the accepted candidate of the best score, or the base, and the error that results."""
    limits = choice.select("candidate", "min_gain", "max_harm")  # one row per candidate
    met = scored.join(F.broadcast(limits), "candidate", "left")
    fine = (F.col("expected_gain") >= F.col("min_gain")) & (F.col("harm_probability") <= F.col("max_harm"))
    score = F.col("expected_gain") - harm_penalty * F.col("harm_probability")
    best = F.max(F.when(fine, F.struct(score.alias("score"), "candidate", "candidate_error", "harm"))).alias("_b")
    out = met.groupBy(*keys).agg(F.first("base_error").alias("base_error"), best)
    return out.select(
        *keys, "base_error", F.coalesce("_b.candidate", F.lit("base")).alias("chosen"),
        F.coalesce("_b.candidate_error", "base_error").alias("chosen_error"), F.coalesce("_b.harm", F.lit(0)).alias("harmed"),
    )
