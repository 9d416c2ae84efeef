"""Mixing sources to target weights: blocks of words, multinomial slots per shard, permuted block indexes.

Documents of a source, by ascending id, form one stream of words that is cut into blocks of ``block_words``. The mix
is a list of slots, each of which takes one block. The number of a source's slots follows from its target; every slot
falls into an output shard by a uniform draw, so the counts of the sources in a shard are a multinomial draw, given the
totals. Slot j of a source takes block perm(j mod n) of its n blocks, so that no block is taken once more before all
were taken. Documents and slots meet by (source, block index).

Defined cases: a null text has no words; a null source is a source of its own, the last; a null id orders by a hash of
the text; rows with equal ids are ordered by a hash of the text; documents without words are kept with taken = 0; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fieldgrain.llm.common import documents, let, order_key, running_starts, text_of, words_of, written

#: Multipliers of the index permutations, primes: the first that does not divide the number of blocks is used.
MULTIPLIERS = (15485863, 32452843, 49979687, 67867967)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row per source: rank, source, source_size, target.

    ``share`` of all words is dealt by weight (repeating, in the order of the sources, null last); a target stops at
    ``cap`` times the source's size and the excess goes to the others by weight. That is min(cap * size, level *
    weight) for the one level that spends the whole budget, found from running sums over the sources by cap * size /
    weight. One row per source: this table is small beside the documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", cycle).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (share * F.sum("source_size").over(everything) - spent("most")) / (F.sum("weight").over(everything) - spent("weight"))
    leveled = ranked.withColumn("level", level).withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level")))
    found = F.min("fits").over(everything)["level"]
    return leveled.withColumn("target", F.least(F.col("most"), F.coalesce(found * F.col("weight"), F.col("most")))).select("rank", "source", "source_size", "target")


def _permuted(slot: Column, n: Column, rank: Column, seed: int) -> Column:
    """Index permutation of 0 .. n-1: multiply by a number without common factor, then rotate."""
    pick = F.coalesce(*[F.when(n % m != 0, F.lit(m)) for m in MULTIPLIERS])
    pick = F.when(n == 1, F.lit(1)).otherwise(pick).cast("long")
    turn = F.pmod(F.xxhash64(F.lit(seed), rank), n)
    return ((pick % n) * (slot % n) + turn) % n


def draw_slots(plan: DataFrame, shard_slots: int, seed: int, chunk: int = 16384) -> DataFrame:
    """One row per slot of the mix: rank, slot, shard, block. ``plan``: rank, blocks, slots per source."""
    shards = F.greatest(F.lit(1), F.ceil(F.sum("slots").over(Window.partitionBy()) / shard_slots))
    cut = plan.withColumn("shards", shards).where("slots > 0").withColumn("chunk", F.explode(F.expr(f"sequence(0L, slots - 1, {chunk}L)")))
    cut = cut.repartition("rank", "chunk")
    rows = cut.select("rank", "blocks", "shards", F.explode(F.expr(f"sequence(chunk, least(chunk + {chunk}L, slots) - 1)")).alias("slot"))
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "rank", "slot"), F.col("shards"))
    return rows.select("rank", "slot", shard.alias("shard"), _permuted(F.col("slot"), F.col("blocks"), F.col("rank"), seed).alias("block"))


def shard_counts(slots: DataFrame) -> DataFrame:
    """The drawn number of blocks of each source in each output shard."""
    return slots.groupBy("shard", "rank").agg(F.count("*").alias("blocks"))


def mix_blocks(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, block_words: int = 64, shard_slots: int = 8192, seed: int = 20) -> DataFrame:
    """One row per document with words and block it is in: its place, the block's overlap with it and ``times`` taken.

    Columns: doc_id, source, tie, size, source_size, target, start, block, first, words, times. A document without
    words has one row with null block, first 0 and words 0.
    """
    measured = docs.select("doc_id", "source", order_key().alias("key"), F.xxhash64("text").alias("tie"), F.size(words_of(text_of())).cast("long").alias("size"))
    sizes = written(measured, "mix-sizes")
    known = written(targets(sizes, weights, share, cap), "mix-targets")
    plan = known.withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    wanted = F.when(F.col("blocks") == 0, 0).otherwise(F.round(F.col("target") * F.col("blocks") / F.col("source_size")))
    plan = plan.withColumn("slots", F.least(cap * F.col("blocks"), wanted.cast("long")))
    times = draw_slots(plan, shard_slots, seed).groupBy("rank", "block").agg(F.count("*").alias("times"))
    # sources are few, so this joins by Spark's own choice of side
    placed = sizes.join(known, sizes["source"].eqNullSafe(known["source"])).drop(known["source"])
    full = running_starts(placed.where("size > 0"), ["rank"], "key", "tie", "size", "start")
    span = F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")
    keep = ["doc_id", "source", "tie", "size", "source_size", "target"]
    cut = full.select(*keep, "rank", "start", F.explode(span).alias("block"))
    low, high = F.greatest("start", F.col("block") * block_words), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    cut = cut.withColumn("first", low - F.col("start")).withColumn("words", high - low)
    # the number of slots follows the input though few rows make them, so the join must not be planned as a broadcast
    met = cut.join(times.hint("merge"), ["rank", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))
    columns = [*keep, "start", "block", "first", "words", "times"]
    zero = F.lit(0).cast("long")
    none = placed.where("size = 0").select(*keep, zero.alias("start"), F.lit(None).cast("long").alias("block"), zero.alias("first"), zero.alias("words"), zero.alias("times"))
    return met.select(*columns).unionByName(none)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words the mix takes)."""
    rows = mix_blocks(docs, **options)
    keep = ["doc_id", "source", "size", "source_size", "target", "start"]
    full = rows.where("block is not null").groupBy(*keep).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    none = rows.where("block is null").select(*keep, F.lit(0).cast("long").alias("taken"))
    return full.unionByName(none).drop("start")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row per document and pass that takes words of it, with the text of those words.

    White space stays with the word before it; a second pass over a document holds the blocks that were taken twice.
    The other columns are those of the input, ``n_chars`` counted anew where there is one.
    """
    rows = mix_blocks(docs, **options).where("times > 0")
    passes = rows.withColumn("pass", F.explode(F.expr("sequence(1L, times)")))
    runs = passes.groupBy("doc_id", "source", "tie", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("_runs"))
    # rows equal in id, source and text are numbered on both sides, so that each meets its own share
    same = lambda c: F.row_number().over(Window.partitionBy("doc_id", "source", "tie").orderBy(c))
    shares = runs.groupBy("doc_id", "source", "tie", "start").agg(F.collect_list("_runs").alias("_passes")).withColumn("_copy", same("start"))
    # the caller's columns travel in a struct, out of reach of the names used here
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")
    left = docs.select(whole, "doc_id", "source", F.xxhash64("text").alias("tie"))
    every = F.xxhash64(*[F.col(f"_whole.`{c}`") for c in docs.columns])
    left = left.withColumn("_copy", same(every))
    on = [left[c].eqNullSafe(shares[c]) for c in ("doc_id", "source", "tie", "_copy")]
    met = left.join(shares, on).select("_whole", F.col("_whole.text").alias("text"), shares["_passes"])
    units = F.filter(F.split(F.regexp_replace("text", "^[\\x20\\x09-\\x0D]+", ""), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])"), lambda w: w != "")
    # a text is split once, not for each of its passes and runs
    taken = lambda u, runs: F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(u, (r["first"] + 1).cast("int"), r["words"].cast("int")))), "")
    texts = let(units, lambda u: F.transform("_passes", lambda runs: taken(u, runs)))
    out = met.select("_whole", F.explode(texts).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"_whole.`{c}`")).alias(c) for c in docs.columns])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "text", "source")).drop("source")
