"""Training-order materialisation: fixed-stride shards of token sequences in a keyed pseudorandom order.

A document's ids are cut into sequences of ``length`` ids, the last padded. Sequences are numbered by ascending id, and
a keyed Feistel permutation of the next even power of two, walked along its cycle until it falls below their number,
gives each its slot. Shard k holds the slots from k * shard_slots on, in order; each record is two bytes an id and one
line feed, so that slot s is at byte (s mod shard_slots) * stride of its shard and reading can resume anywhere.

Documents are dealt out in ranges of their ids before they are encoded, so a sequence's number is the count of all
sequences in earlier ranges and its place in its own: records are shuffled once, to their shards.

Spark's text writer puts the records' bytes as they are. A shard is one task's output, since its size is fixed.
Records are dealt out in a few passes over ranges of shards, so that of the shuffled records only one pass's stand on
disk beside the encoded table and the shards.

Defined cases: null and empty texts have no sequences; rows with equal ids are ordered by a hash of the text; an empty
table gives no shards and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgrain.llm.byte_bpe import coder
from fieldgrain.llm.common import BATCH_ROWS, documents, order_key, shuffles_freed, text_of, written
from fieldgrain.session import ensure_checkpoint_dir

LENGTH = 512
SHARD_SLOTS = 4096
ROUNDS = 4
PASSES = 3


def stride(length: int) -> int:
    return 2 * length + 1


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Keyed permutation of 0 .. n-1 applied to ``index``."""
    half = max(1, (int(max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(ROUNDS):
            mixed = (right + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn + 1) * np.uint64(0xD1B54A32D192ED03)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]  # outside: walk on along the cycle
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int, vocabulary: str) -> DataFrame:
    """doc_id, part, n_tokens, record, record_sha256, range, place: a row for each sequence, its task and place in it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # rows equal in id and text are interchangeable: the salt spreads them over ranges
    rows = docs.select("doc_id", order_key().alias("key"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("salt"), text_of().alias("text"))
    order = ["key", "tie", "salt"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    names = ["doc_id", "part", "n_tokens", "record", "record_sha256", "range", "place"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        range_, place = TaskContext.get().partitionId(), 0
        for batch in (b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS)):
            owner, part, count, record = [], [], [], []
            for i, ids in enumerate(bpe.encode(batch.column("text").to_pylist())):
                for p in range(0, len(ids), length):
                    piece = ids[p : p + length].astype("<u2")
                    owner.append(i)
                    part.append(p // length)
                    count.append(len(piece))
                    record.append(piece.tobytes())
            n = len(owner)
            numbers = [pa.array(np.full(n, range_, np.int32)), pa.array(np.arange(place, place + n, dtype=np.int64))]
            place += n
            digests = pa.array([hashlib.sha256(r.ljust(2 * length, b"\0")).digest() for r in record], pa.binary())
            arrays = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(part, pa.int64()), pa.array(count, pa.int64()), pa.array(record, pa.binary()), digests, *numbers]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return ranged.mapInArrow(cut, f"doc_id {kind}, part long, n_tokens long, record binary, record_sha256 binary, range int, place long")


def materialise(docs: DataFrame, path: str, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: int = 11, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Write the shards below ``path`` and return doc_id, part, n_tokens, slot, shard, offset, record_sha256."""
    spark = docs.sparkSession
    cut = written(sequences(docs, length, vocabulary), "sequences", compression="zstd")
    # one row per task of the first pass: ranges ascend, so a range starts where the ones before it end
    counts = cut.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect()
    ends = list(accumulate((r["n"] for r in counts), initial=0))
    total = ends[-1]
    starts = spark.createDataFrame([(r["range"], s) for r, s in zip(counts, ends)], "range int, start long")
    numbered = cut.join(F.broadcast(starts), "range").withColumn("index", F.col("start") + F.col("place"))

    @F.pandas_udf("long")
    def slot(index):
        import pandas as pd

        return pd.Series(feistel(index.to_numpy(), total, key))

    placed = numbered.withColumn("slot", slot("index")).withColumn("shard", F.expr(f"slot div {shard_slots}"))
    parts = max(1, -(-total // shard_slots))
    # a shard goes to one task; records are padded as they are written
    line = F.rpad("record", F.lit(2 * length), F.lit(b"\0")).cast("string").alias("value")
    for low in range(0, parts, -(-parts // PASSES)):
        high = min(parts, low + -(-parts // PASSES))
        tasks = min(high - low, 100_000)
        part = placed.select("shard", "slot", "record").where(F.col("shard").between(low, high - 1))
        dealt = part.repartitionById(tasks, F.expr(f"int((shard - {low}) % {tasks})")).sortWithinPartitions("shard", "slot")
        with shuffles_freed(spark):
            dealt.select("shard", line).write.mode("append" if low else "error").partitionBy("shard").option("lineSep", "\n").text(path)
    # the digests come from the first pass: records are neither read nor dealt out for the result
    return placed.select("doc_id", "part", "n_tokens", "slot", "shard", (F.expr(f"slot % {shard_slots}") * stride(length)).alias("offset"), F.lower(F.hex("record_sha256")).alias("record_sha256"))


def read_from(spark: SparkSession, path: str, slot: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """slot and ids of every record from ``slot`` on: whole shards before it are not read."""
    files = spark.read.format("binaryFile").option("basePath", path).load(path).where(F.col("shard") >= slot // shard_slots).select("shard", "content")
    step = stride(length)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, step)
                slots = shard * shard_slots + np.arange(len(data))
                on = slots >= slot
                ids = np.ascontiguousarray(data[on, :-1]).view("<u2").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(slots[on]), pa.array(list(ids), pa.list_(pa.int32()))], ["slot", "ids"])

    return files.mapInArrow(split, "slot long, ids array<int>")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return materialise(documents(spark, sf_dir), f"{spark.sparkContext.getCheckpointDir()}/shards-{uuid.uuid4().hex}")
