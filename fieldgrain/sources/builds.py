"""Incremental dataset builds: new runs are extracted and appended, everything else is reused.

A dataset folder holds parts, one for each build that found new runs, and versions, each a list of parts. A build first
writes its part and then publishes a version that names it, so a build that dies leaves files that no version names and
that no reader sees; its repetition starts anew. Earlier parts are never rewritten or read again, but for their keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldgrain.sources.versions import publish, read_version

#: Settings that do not change how a run is extracted.
FREE_SETTINGS = ("dataset_id", "max_samples", "use_sample_parfor", "use_window_parfor")


class BuildRefused(ValueError):
    """The build does not fit the published dataset, which stays as it is."""


def row_text(columns: Sequence[str]) -> Column:
    """A row as text: each value after its length, ``-`` for null, so that no two rows share a text."""
    value = lambda c: F.col(c).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in columns])


def content_sum(columns: Sequence[str]) -> Column:
    """Aggregate that does not depend on row order and adds up over parts: the sum of 60 bits of each row's md5."""
    number = F.conv(F.substring(F.md5(row_text(columns)), 1, 15), 16, 10).cast("decimal(20,0)")
    return F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)")


def extraction_settings(config: Mapping) -> str:
    """The settings that decide what a run yields, as canonical JSON."""
    return json.dumps({k: v for k, v in config.items() if k not in FREE_SETTINGS}, sort_keys=True)


def build_dataset(ledger: DataFrame, folder: str, extract: Callable[[DataFrame], DataFrame], config: Mapping, *,
                  run: str = "run_id", source: str = "hash_sha256") -> dict:
    """Extract the runs of ``ledger`` that the dataset lacks and publish a version with them; returns that version.

    ``extract`` maps runs (``run`` and ``source``) to examples. Without a new run nothing is written and the newest
    version is returned. A changed setting, a changed source of a known run, or examples with other columns are refused.
    Runs that yield no example count as done. Repeated ledger rows count once; two sources of one run are refused; a null
    run is ignored.
    """
    spark = ledger.sparkSession
    before = read_version(spark, f"{folder}/versions")
    settings = extraction_settings(config)
    if before and before["settings"] != settings:
        raise BuildRefused("the dataset was built with other settings")
    some = F.count(source)
    mixed = ~F.min(source).eqNullSafe(F.max(source)) | ((some > 0) & (some < F.count("*")))
    # one row per run, so that the ledger is dealt out once, by run, for its faults and for the join
    asked = ledger.where(F.col(run).isNotNull()).groupBy(run).agg(F.min(source).alias(source), mixed.alias("_double"))
    if before:
        known = spark.read.parquet(*[p["runs"] for p in before["parts"]]).select(run, F.col(source).alias("_known"), F.lit(True).alias("_done"))
        asked = asked.join(known, run, "left")
    else:
        asked = asked.withColumn("_known", F.lit(None).cast("string")).withColumn("_done", F.lit(None).cast("boolean"))
    part = f"{folder}/parts/{uuid.uuid4().hex}"
    paths = {"runs": f"{part}/runs", "examples": f"{part}/examples"}
    moved = F.col("_done") & (F.col("_double") | ~F.col("_known").eqNullSafe(F.col(source)))
    row = asked.agg(F.count_if(moved).alias("moved"), F.count_if("_double").alias("double"), F.count_if(F.col("_done").isNull()).alias("new")).first()
    if row["double"] or row["moved"]:
        raise BuildRefused(f"{row['double']} runs have several sources, {row['moved']} known runs have another source")
    if not row["new"] and before:
        return before
    asked.where(F.col("_done").isNull()).select(run, source).write.parquet(paths["runs"])
    runs = spark.read.parquet(paths["runs"])
    examples = extract(runs)
    schema = [list(c) for c in examples.dtypes]
    if before and before["schema"] != schema:
        raise BuildRefused("the new examples have other columns or types")
    examples.write.parquet(paths["examples"])
    made = spark.read.schema(examples.schema).parquet(paths["examples"])
    counts = made.agg(F.count("*").alias("n"), content_sum(examples.columns).alias("content")).first()
    new = {**paths, "run_count": row["new"], "example_count": counts["n"], "content": str(counts["content"])}
    parts = [*(before["parts"] if before else []), new]
    after = {
        "settings": settings, "schema": schema, "parts": parts,
        "run_count": sum(p["run_count"] for p in parts), "example_count": sum(p["example_count"] for p in parts),
        "content": str(sum(int(p["content"]) for p in parts)),
    }
    version = before["version"] + 1 if before else 1
    publish(spark, f"{folder}/versions", version, after)
    return {**after, "version": version}


def read_examples(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The examples of the newest or the given version, with ``part``, their build's place from 1."""
    found = read_version(spark, f"{folder}/versions", version)
    if found is None:
        raise ValueError(f"nothing is published in {folder}")
    schema = ", ".join(f"`{c}` {t}" for c, t in found["schema"])
    out = None
    for i, p in enumerate(found["parts"], 1):
        rows = spark.read.schema(schema).parquet(p["examples"]).withColumn("part", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out
