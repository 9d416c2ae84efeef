"""Shared pieces of the training-data operators: the documents view, written tables, let-bindings, running starts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fieldgrain.session import ensure_checkpoint_dir

#: Fixed value: the word separators of the contracts, space and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back: lineage ends there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path, compression=compression)
    _HELPERS.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of the tables that written() made and sweep() has not deleted.
_HELPERS: list[str] = []


#: Texts handed to Python at once; whole texts are long, and a batch stands in memory on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most so many rows: this bounds memory for texts, not what is read."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffle files of each query run inside as soon as the query has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sweep(docs: DataFrame) -> None:
    """Delete the helper tables that earlier stages wrote, but for those that ``docs`` still reads.

    For a caller that has written each stage's result before the next one starts, as the pipeline does.
    """
    spark = docs.sparkSession
    read = {f"/{part}/" for file in docs.inputFiles() for part in file.split("/")[-2:-1]}
    for path in list(_HELPERS):
        if f"/{path.rsplit('/', 1)[1]}/" not in read:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
            _HELPERS.remove(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between white space, in order."""
    return F.array_remove(F.split(text, SPACES), "")


def order_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A non-null long that orders documents: the id, or for a null id a hash of the text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)))


#: Rows that one window sorts hold keys equal in all but so many low bits.
WINDOW_BITS = 12


def running_starts(df: DataFrame, group: list[str], key: str, tie: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group with a smaller (key, tie).

    ``df`` is read several times and should be a written table. No window holds a whole group: keys are cut into
    blocks of 2^12 values, block totals get their own starts the same way, and a row adds its start in its block.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.withColumn(out, F.lit(0).cast("long"))
    bits = max(1, (int(high) - int(low)).bit_length())

    def starts(t: DataFrame, bits: int, order: list[str]) -> DataFrame:
        before = lambda cols: Window.partitionBy(*cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        total = lambda cols: F.coalesce(F.sum(value).over(before(cols)), F.lit(0).cast("long"))
        if bits <= WINDOW_BITS:
            return t.withColumn(out, total(group))
        t = t.withColumn("_block", F.shiftright(F.col("_key"), WINDOW_BITS))
        blocks = t.groupBy(*group, "_block").agg(F.sum(value).alias(value)).withColumnRenamed("_block", "_key")
        above = starts(blocks, bits - WINDOW_BITS, ["_key"]).select(*group, F.col("_key").alias("_block"), F.col(out).alias("_above"))
        inside = t.withColumn(out, total([*group, "_block"]))
        return inside.join(above, [*group, "_block"]).withColumn(out, F.col(out) + F.col("_above")).drop("_block", "_above")

    # the subtraction is done in decimals, since a span of ids can exceed a long's positive half
    span = (F.col(key).cast("decimal(20,0)") - F.lit(int(low)).cast("decimal(20,0)")).cast("decimal(20,0)")
    if bits > 63:
        span = F.floor(span / 2).cast("decimal(20,0)")
    return starts(df.withColumn("_key", span.cast("long")), min(bits, 63), ["_key", key, tie]).drop("_key")


def numbered(rows: DataFrame, group: list[str], order: list[str], out: str, name: str) -> DataFrame:
    """Write the rows with ``out``, a row's place (long, from 0) in its group, and ``n``, the group's number of rows.

    No window or task holds a group: rows are dealt out in ranges of (group, order), sorted, and written; a place is the
    place inside a range plus the group's rows in earlier ranges. ``order`` may leave equal rows in any order, nulls
    come first. Only (range, group) counts meet in a window.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    found = written(at, name)
    parts = found.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    mark = [F.col(c).alias(f"_{c}") for c in group]
    starts = starts.select(*mark, F.col("_part").alias("_range"), "_first", "_before", "n")
    on = [found["_part"] == F.col("_range"), *[found[c].eqNullSafe(F.col(f"_{c}")) for c in group]]
    place = (F.col("_at") - F.col("_first") + F.col("_before")).cast("long")
    return found.join(starts, on).select(*[found[c] for c in rows.columns], place.alias(out), F.col("n").cast("long").alias("n"))
