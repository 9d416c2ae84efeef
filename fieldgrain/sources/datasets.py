"""Dataset, split, prediction and report files; frozen splits; older result folders; incremental builds."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldgrain.functions.semantics import require_columns
from fieldgrain.sources.ledger import new_runs


def write_dataset(examples: DataFrame, folder: str, *, summary: DataFrame | None = None, registry: DataFrame | None = None,
                  manifest: Mapping | None = None, partition: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Patch table as parquet, its summaries as CSV, its manifest as one JSON row.

    Pass a low-cardinality ``partition`` column (a dataset or window size):
    partitioning by run would make one directory per run.
    """
    writer = examples.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{folder}/examples")
    for name, frame in (("summary", summary), ("registry", registry)):
        if frame is not None:
            write_csv(frame, f"{folder}/{name}")
    if manifest is not None:
        write_manifest(examples.sparkSession, manifest, f"{folder}/manifest")


def write_csv(frame: DataFrame, folder: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(folder)


def write_manifest(spark: SparkSession, manifest: Mapping, folder: str) -> None:
    """One nested JSON document."""
    rows = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(folder)


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(folder).first()["value"])


def decode_config(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text column to a typed struct, and back to canonical JSON."""
    decoded = rows.withColumn("config", F.from_json(column, schema))
    return decoded.withColumn("config_json", F.to_json("config"))


def write_split(split: DataFrame, folder: str, manifest: Mapping) -> None:
    """Assignment by example id, with its conditions and runs, plus the manifest."""
    require_columns(split, ["example_id", "campaign_condition_id", "campaign_run_id", "partition"], "split")
    keep = [c for c in ("example_id", "campaign_condition_id", "campaign_run_id", "partition", "cv_fold") if c in split.columns]
    split.select(*keep).write.mode("overwrite").parquet(f"{folder}/assignment")
    write_manifest(split.sparkSession, manifest, f"{folder}/manifest")


def read_split(spark: SparkSession, folder: str, examples: DataFrame) -> DataFrame:
    """Frozen labels joined to the current rows by id (never by position)."""
    frozen = spark.read.parquet(f"{folder}/assignment")
    labels = [c for c in ("partition", "cv_fold") if c in frozen.columns]
    return examples.join(frozen.select("example_id", *labels), "example_id")


def first_column(frame: DataFrame, candidates: Sequence[str]) -> str:
    """First candidate name the frame has, without regard to case."""
    lower = {c.lower(): c for c in frame.columns}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    raise ValueError(f"none of the columns {', '.join(candidates)} is present")


def read_results(spark: SparkSession, pattern: str, roles: Mapping[str, Sequence[str]], schema: str) -> DataFrame:
    """Rows of the newest run folder under ``pattern`` (folder names sort by time), columns renamed to their roles."""
    rows = spark.read.schema(schema).option("header", True).csv(pattern).withColumn("_file", F.input_file_name())
    run = F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1)
    newest = rows.select(run.alias("_run")).agg(F.max("_run").alias("_newest"))
    picked = rows.withColumn("_run", run).join(F.broadcast(newest), F.col("_run") == F.col("_newest"))  # one row
    return picked.select(*[F.col(first_column(rows, names)).alias(role) for role, names in roles.items()])


def check_union(frames: Sequence[DataFrame], *, fill_missing: bool = False) -> DataFrame:
    """Union of tables by column name: strict by default, or filling missing columns with NULL."""
    first = frames[0]
    out = first
    for other in frames[1:]:
        if not fill_missing and dict(first.dtypes) != dict(other.dtypes):
            raise ValueError("tables to append must have the same columns and types")
        out = out.unionByName(other, allowMissingColumns=fill_missing)
    return out


def dual_configuration(parts: Mapping[int, DataFrame], key: str = "example_id", run: str = "campaign_run_id") -> tuple[DataFrame, DataFrame]:
    """Tables of several window sizes stacked with ids suffixed ``__M<size>``, and the runs whose sizes are unbalanced."""
    stacked = None
    for m, part in parts.items():
        named = part.withColumn(key, F.concat(F.col(key), F.lit(f"__M{m}"))).withColumn("window_M", F.lit(m))
        stacked = named if stacked is None else stacked.unionByName(named)
    counts = stacked.groupBy(run).agg(*[F.count_if(F.col("window_M") == m).alias(f"count_M{m}") for m in parts])
    names = [f"count_M{m}" for m in parts]
    unbalanced = counts.where(F.greatest(*names) != F.least(*names))
    return stacked, unbalanced


def matched_support(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Keep only rows whose value of every shared column occurs in both tables."""
    for c in columns:
        both = left.select(c).distinct().intersect(right.select(c).distinct())
        left, right = left.join(both, c, "left_semi"), right.join(both, c, "left_semi")
    return left, right


def extend_dataset(previous: DataFrame, ledger: DataFrame, extract: Callable[[DataFrame], DataFrame], *, config_hash: str,
                   run: str = "campaign_run_id") -> DataFrame:
    """Previous rows plus rows of runs not seen before; the configuration must not have changed."""
    changed = previous.where(F.col("config_hash") != config_hash).limit(1)
    if not changed.isEmpty():
        raise ValueError("the previous dataset was built with another configuration")
    todo = new_runs(ledger, previous.select(F.col(run).alias("run_id")))
    fresh = extract(todo).withColumn("config_hash", F.lit(config_hash))
    return check_union([previous, fresh.select(*previous.columns)])


def unmatched(rows: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Keys without a partner in the reference table."""
    return rows.select(key).distinct().join(reference.select(key).distinct(), key, "left_anti")


def bar_key(*columns: str) -> Column:
    """Row key of several columns joined by a bar."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
