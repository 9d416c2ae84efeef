"""Run ledgers: scan with an explicit schema, filter, uniqueness, merge, manifest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fieldgrain.functions.semantics import require_columns

# The columns a run ledger must have, with their types.
LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("backend", T.StringType()),
        T.StructField("hash_sha256", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("outcome_status", T.StringType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("frequency_hz", T.DoubleType()),
        T.StructField("background_cs_m_s", T.DoubleType()),
        T.StructField("direction_count", T.IntegerType()),
        T.StructField("valid", T.IntegerType()),
        T.StructField("run_directory", T.StringType()),
        T.StructField("resolved_config_path", T.StringType()),
        T.StructField("wavefield_sample_path", T.StringType()),
        T.StructField("summary_path", T.StringType()),
        T.StructField("validation_report_path", T.StringType()),
    ]
)
DONE = ("completed", "skipped_completed")
IDENTIFIERS = ("run_id", "hash_sha256", "wavefield_sample_path")


def read_ledger(spark: SparkSession, path: str | list[str], extra: Sequence[T.StructField] = ()) -> DataFrame:
    """CSV ledgers with the fixed schema; missing columns fail before any job."""
    # With enforceSchema off, Spark compares the header with the schema instead of trusting positions.
    schema = T.StructType([*LEDGER_SCHEMA.fields, *extra])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def usable(backend: str | None = None) -> Column:
    ok = F.col("status").isin(*DONE) & (F.col("outcome_status") == "completed_valid") & (F.col("valid") == 1)
    if backend:
        ok = ok & (F.col("backend") == backend)
    return F.coalesce(ok, F.lit(False))


def inventory(ledger: DataFrame, *, backend: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Usable runs in ledger order (optionally the first few) and the rejected rest."""
    require_columns(ledger, ["ordinal", "status", "outcome_status", "valid", *IDENTIFIERS], "run ledger")
    if limit is not None and limit < 1:
        raise ValueError("the sample limit must be a positive integer")
    kept = ledger.where(usable(backend)).orderBy("ordinal", "run_id")
    return (kept.limit(limit) if limit else kept), ledger.where(~usable(backend))


def duplicates(rows: DataFrame, columns: Sequence[str] = IDENTIFIERS) -> DataFrame:
    """Values of identifying columns that occur more than once."""
    parts = [
        rows.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1").select(
            F.lit(c).alias("column_name"), "value", "row_count"
        )
        for c in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def merge(ledgers: Sequence[DataFrame], key: str = "run_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Union of same-schema ledgers without identical copies, the conflicting runs, and one row of counts."""
    names = ledgers[0].columns
    for other in ledgers[1:]:
        if sorted(other.columns) != sorted(names):
            raise ValueError("ledgers must share one schema")
    stacked = reduce(DataFrame.unionByName, ledgers)
    unique = stacked.dropDuplicates()
    conflicts = unique.groupBy(key).agg(F.count(F.lit(1)).alias("version_count")).where("version_count > 1")
    before = stacked.agg(F.count(F.lit(1)).alias("input_row_count"))
    after = unique.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("condition_id").alias("_c")) if "condition_id" in names else unique.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.lit(None).alias("_c"))
    counts = before.crossJoin(  # one row by one row
        after.agg(
            F.sum("_n").alias("output_row_count"), F.count(F.lit(1)).alias("run_count"), F.count_distinct("_c").alias("condition_count")
        )
    ).withColumn("duplicate_row_count", F.col("input_row_count") - F.col("output_row_count"))
    return unique, conflicts, counts


def new_runs(ledger: DataFrame, processed: DataFrame, key: str = "run_id") -> DataFrame:
    """Runs not processed before."""
    return ledger.join(processed.select(key).distinct(), key, "left_anti")


# Ledger columns that describe bookkeeping, not the run; all others travel with the patches.
NOT_CARRIED = {"status", "outcome_status", "valid", "run_directory", "resolved_config_path", "summary_path", "validation_report_path"}


def attach_metadata(patches: DataFrame, ledger: DataFrame, key: str = "campaign_run_id") -> DataFrame:
    """Ledger columns of the patch's run, named ``campaign_*`` (the sample path becomes ``campaign_sample_file``).

    The ledger has one row per run and may grow with the data: Spark's size check picks the join.
    """
    renamed = {c: "campaign_sample_file" if c == "wavefield_sample_path" else f"campaign_{c}" for c in ledger.columns if c not in NOT_CARRIED}
    carried = ledger.select(*[F.col(c).alias(n) for c, n in renamed.items() if n == key or n not in patches.columns])
    return patches.join(carried, key, "left")


def campaign_manifest(expected: DataFrame, ledger: DataFrame) -> DataFrame:
    """State of every expected campaign: complete, partial, no valid runs, or no ledger at all.

    ``expected`` has campaign_name and expected_runs.
    """
    done = F.col("status").isin(*DONE)
    counts = ledger.groupBy("campaign_name").agg(
        F.count_if(done).alias("completed_runs"), F.count_if(done & (F.col("valid") == 1)).alias("included_runs")
    )
    joined = expected.join(counts, "campaign_name", "left")
    state = (
        F.when(F.col("completed_runs").isNull(), "missing_ledger")
        .when(F.col("included_runs") == 0, "no_valid_completed_runs")
        .when(F.col("included_runs") == F.col("expected_runs"), "complete")
        .otherwise("partial")
    )
    return joined.select(*expected.columns, state.alias("state"), "completed_runs", "included_runs").fillna(
        0, ["completed_runs", "included_runs"]
    )


def field_regime(design_id: Column, suffixes: Sequence[str]) -> Column:
    """Field regime named by the end of a design identifier."""
    out = F.lit(None).cast("string")
    for s in suffixes:
        out = F.when(F.endswith(design_id, F.lit(f"_{s}")), s).otherwise(out)
    return out


def theory_class(runs: DataFrame, mapping: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """Theory class by direction count, and the runs whose count has no class."""
    known = {"SingleWave", "PartialDiffuse3D", "Diffuse3D"}
    if not set(mapping.values()) <= known:
        raise ValueError("unsupported theory class in the mapping")
    out = F.lit(None).cast("string")
    for count, name in mapping.items():
        out = F.when(F.col("campaign_direction_count") == count, name).otherwise(out)
    labelled = runs.withColumn("theory_field_class", out)
    return labelled, labelled.where(F.col("theory_field_class").isNull())
