"""The incremental parts of a campaign as streams: ledger, coverage counts, featurisation of new runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldgrain.operators.coverage import CoverageGrid, coverage_cells, coverage_deficits


def ledger_stream(spark: SparkSession, folder: str, schema, *, time: str = "finished_at", delay: str = "1 day", fmt: str = "parquet") -> DataFrame:
    """Runs as they arrive, each run once; state older than the watermark is dropped."""
    rows = spark.readStream.schema(schema).format(fmt).load(folder)
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["run_id"])


def coverage_stream(assigned: DataFrame) -> DataFrame:
    """Running example count per coverage cell (update mode); exact under repeated delivery when the source is.

    Distinct runs per cell are counted by :func:`cell_run_stream`, a second
    stateful step with one state row per (cell, run).
    """
    return assigned.where("coverage_valid").groupBy(F.col("coverage_cell_key").alias("cell_key")).agg(
        F.count(F.lit(1)).alias("example_count")
    )


def cell_run_stream(assigned: DataFrame, run: str = "campaign_run_id") -> DataFrame:
    """Each (cell, run) pair once, for exact distinct counts downstream."""
    return assigned.where("coverage_valid").select(F.col("coverage_cell_key").alias("cell_key"), run).dropDuplicates(["cell_key", run])


def run_count_stream(assigned: DataFrame, run: str = "campaign_run_id") -> DataFrame:
    """Exact distinct runs per cell: duplicate removal, then a running count."""
    return cell_run_stream(assigned, run).groupBy("cell_key").agg(F.count(F.lit(1)).alias("independent_run_count"))


def observed_items_stream(assigned: DataFrame, items: Mapping[str, str]) -> DataFrame:
    """cell_key, kind, item: every example, run, condition of a cell once, however often it is delivered.

    ``items`` names the column of each kind. The state is keyed by all three columns, so a cell with most of the rows
    is spread like any other; it holds one key per distinct item and lives as long as the stream.
    """
    entries = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("item")) for kind, c in items.items()])
    long = assigned.where("coverage_valid").select(F.col("coverage_cell_key").alias("cell_key"), F.explode(entries).alias("e"))
    return long.select("cell_key", "e.kind", "e.item").where("item is not null").dropDuplicates(["cell_key", "kind", "item"])


def coverage_counts_stream(assigned: DataFrame, items: Mapping[str, str]) -> DataFrame:
    """Distinct items of each kind per cell, as ``<kind>_count``: a second stateful step behind the first (update mode)."""
    seen = observed_items_stream(assigned, items)
    return seen.groupBy("cell_key").agg(*[F.count_if(F.col("kind") == kind).alias(f"{kind}_count") for kind in items])


def ledger_once(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """Every run's first delivered row, for deliveries in any order: unlike ledger_stream() no run is forgotten."""
    return rows.dropDuplicates([run])


def write_batches(rows: DataFrame, output: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process what has arrived; a micro-batch is written under its number with overwrite, so a replay replaces it."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(batches: DataFrame) -> DataFrame:
    """The newest counts of every cell among the written batches."""
    counts = [c for c in batches.columns if c.endswith("_count")]
    newest = batches.groupBy("cell_key").agg(F.max_by(F.struct(*counts), "batch").alias("_c"))
    return newest.select("cell_key", "_c.*")


def deficits_of_counts(counts: DataFrame, grid: CoverageGrid, **minima: int) -> DataFrame:
    """Deficits of all cells of the grid, those never observed included, from counts by cell key."""
    names = [c for c in counts.columns if c != "cell_key"]
    cells = coverage_cells(counts.sparkSession, grid).join(counts, "cell_key", "left").fillna(0, names)
    return coverage_deficits(cells, include_complete=True, **minima)


def remaining_deficits(counts: DataFrame, minimum_examples: int) -> DataFrame:
    """Deficit columns on (streaming or batch) counts."""
    lack = F.greatest(F.lit(minimum_examples) - F.col("example_count"), F.lit(0))
    return counts.select("*", lack.alias("example_deficit"), (lack == 0).alias("coverage_complete"))


def featurise_new_runs(rows: DataFrame, output: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], *,
                       key: Sequence[str] = ("run_id",)) -> StreamingQuery:
    """Run the batch extraction on the rows of every micro-batch that were not delivered before.

    ``key`` names what tells rows apart, for pixel rows the run and the position; it is kept as state, so the output is
    never read again. A run's rows must arrive in one delivery. A batch is written under its own number with overwrite,
    so a batch that is replayed after a failure replaces its first attempt instead of adding rows.
    """

    def process(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    fresh = rows.dropDuplicates([key] if isinstance(key, str) else list(key))
    return fresh.writeStream.outputMode("append").foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
