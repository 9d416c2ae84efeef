"""Source divergence audit: how far the term shares of the sources of a language lie apart, in exact arithmetic.

A source's smoothed share of a term depends on the term's count there alone, so the distance of two sources follows
from their joint table: how many terms have count a in one and count b in the other. The columns of a 0/1 matrix stand
for (source, count level), its rows for the kept terms; the product of its transpose with itself holds the joint tables
of all pairs at once. The product is made in blocks: ``block_terms`` rows by the levels of two sets of ``block_groups``
sources, each in one Arrow call; entries are whole numbers below 2^53, so floating-point products are exact. A block's
entries are priced by the difference of the two levels' shares, which is linear, so the prices of the blocks of a pair
add up to its distance. Terms are summed per task before they are shuffled; no task holds a language or a source.

Defined cases: null text, lang and source count as empty; a source without terms takes part with zero counts; a language
without kept terms has pairs of value 0; rows that repeat count each time; ids are not read, so null and equal ids do
not matter; an empty table gives an empty result; extra columns, whatever their names, are ignored; a text is cut into
terms whole, whatever its length.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fieldgrain.llm.common import documents, numbered, written

#: A kept term's least number of documents, scale and smoothing of shares, ranks of terms reported.
LEAST_DOCUMENTS = 30
SCALE = 1_000_000_000
SMOOTHING = 5
TERM_RANKS = 50

#: Bytes of a term: ASCII letters, lower-cased, and all of any character beyond ASCII; others separate terms.
LETTERS = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalpha() else b if b > 127 else 32 for b in range(256))
HELD_TERMS = 500_000


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, documents (of the group that hold the term), and one row a group with a null term."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    names = ["lang", "source", "term", "count", "documents"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = defaultdict(Counter)
        found: dict[tuple, Counter] = defaultdict(Counter)

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in counts.items():
                own = found[lang, source]
                words = [*terms, None]
                columns = [[lang] * len(words), [source] * len(words), [w and w.decode() for w in words], [*terms.values(), 0], [*[own[w] for w in terms], 0]]
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            counts.clear()
            found.clear()

        for batch in batches:
            for lang, source, text in zip(*[batch.column(c) for c in ("lang", "source", "text")]):
                words = Counter(terms_of(text.as_py()))
                key = lang.as_py(), source.as_py()
                counts[key].update(words)
                found[key].update(words.keys())
            if sum(map(len, counts.values())) > HELD_TERMS:  # a bound on memory: sums go on after the shuffle
                yield from emit()
        yield from emit()

    parts = rows.mapInArrow(count, "lang string, source string, term string, count long, documents long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def share(count: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * V)), in decimals, since a long would overflow."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + SMOOTHING)
    below = F.col("total").cast("decimal(19,0)") + SMOOTHING * F.col("v").cast("decimal(17,0)")
    # what is left after the remainder divides without a fraction
    return ((above - above % below) / below).cast("decimal(19,0)").cast("long") + 1


def one_hot_price(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sums of |p - q| over the rows for every pair of columns of two tables of shares, by a product of indicators.

    Each column of a table becomes one indicator column per level (different value) that it holds.
    """

    def levels(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marks, values, owner = [], [], []
        for i, column in enumerate(table.T):
            found, at = np.unique(column, return_inverse=True)
            mark = np.zeros((len(column), len(found)))
            mark[np.arange(len(column)), at] = 1
            marks.append(mark)
            values.append(found)
            owner.append(len(found))
        return np.hstack(marks), np.concatenate(values), np.concatenate([[0], np.cumsum(owner)[:-1]])

    left, p, left_starts = levels(one)
    right, q, right_starts = levels(other)
    out = np.zeros((one.shape[1], other.shape[1]), np.int64)
    stops = [*left_starts[1:], len(p)]
    for i, (a, b) in enumerate(zip(left_starts, stops)):
        joint = (left[:, a:b].T @ right).astype(np.int64)
        out[i] = np.add.reduceat((joint * np.abs(p[a:b, None] - q[None, :])).sum(0), right_starts)
    return out


def pair_values(tiles: DataFrame, block_groups: int) -> DataFrame:
    """lang, one, other (numbers of two groups, one < other), value. ``tiles``: lang, number, tile, rows, zero, cells
    (array of (at, share)): a group's shares of one block of terms."""
    block = F.floor(F.col("number") / block_groups).cast("long")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("groups") - 1) / block_groups).cast("long")))
    sides = tiles.withColumn("block", block).withColumn("with", others)
    sides = sides.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})

    def price(table: pa.Table) -> pa.Table:
        rows = table.column("rows")[0].as_py()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        sets: dict[int, list] = {low: [], high: []}
        numbers: dict[int, list] = {low: [], high: []}
        for number, own, zero, cells in zip(*[table.column(c) for c in ("number", "block", "zero", "cells")]):
            column = np.full(rows, zero.as_py(), np.int64)
            if cells.is_valid and len(cells):
                flat = cells.values
                column[flat.field("at").to_numpy()] = flat.field("share").to_numpy()
            sets[own.as_py()].append(column)
            numbers[own.as_py()].append(number.as_py())
        values = one_hot_price(np.array(sets[low]).T, np.array(sets[high]).T)
        one, other = np.array(numbers[low])[:, None], np.array(numbers[high])[None, :]
        at = np.nonzero(np.broadcast_to(one < other if low == high else one != other, values.shape))
        columns = [pa.array([table.column("lang")[0].as_py()] * len(at[0]), pa.string()), pa.array(one[at[0], 0], pa.int64()), pa.array(other[0, at[1]], pa.int64()), pa.array(values[at], pa.int64())]
        return pa.table(columns, ["lang", "one", "other", "value"])

    parts = sides.groupBy("lang", "tile", "low", "high").applyInArrow(price, "lang string, one long, other long, value long")
    return parts.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, block_terms: int = 128, block_groups: int = 32) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources, and the terms that a source favours."""
    counts = written(term_counts(docs), "term-counts")
    used = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("count").alias("all"))
    # terms of like frequency stand together, so that a block of them has few levels
    kept = numbered(used.where(F.col("documents") >= LEAST_DOCUMENTS).select("lang", "term", "all"), ["lang"], ["all", "term"], "at", "kept-terms")
    kept = kept.withColumnRenamed("n", "v")
    held = written(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "at", "count", "all"), "kept-counts")
    sizes = kept.groupBy("lang").agg(F.max("v").alias("v"), F.sum("all").alias("lang_total"))
    groups = counts.select("lang", "source").distinct()
    groups = numbered(groups, ["lang"], ["source"], "number", "groups").withColumnRenamed("n", "groups")
    totals = held.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = written(groups, "group-sizes")  # lang, source, number, groups, total, v, lang_total

    # part `pair`: tiles of shares, one per group and block of terms, also where the group has none of the terms
    filled = groups.where("v > 0 and groups > 1").select("lang", "source", "number", "groups", "total", "v")
    tile = F.floor(F.col("at") / block_terms).cast("long")
    mine = held.join(filled, ["lang", "source"]).select("lang", "source", tile.alias("tile"), (F.col("at") % block_terms).cast("int").alias("at"), share(F.col("count")).alias("share"))
    cells = mine.groupBy("lang", "source", "tile").agg(F.collect_list(F.struct("at", "share")).alias("cells"))
    every = filled.withColumn("zero", share(F.lit(0))).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / block_terms).cast("long"))))
    rows = F.least(F.lit(block_terms), F.col("v") - F.col("tile") * block_terms).cast("int")
    tiles = every.withColumn("rows", rows).join(cells, ["lang", "source", "tile"], "left").select("lang", "number", "groups", "tile", "rows", "zero", "cells")
    priced = written(pair_values(tiles, block_groups), "pair-values")
    both = priced.unionByName(priced.select("lang", F.col("other").alias("one"), F.col("one").alias("other"), "value"))
    name = groups.select("lang", "source", "number")
    ends = lambda c, out: name.select("lang", F.col("source").alias(out), F.col("number").alias(c))
    pairs = both.join(ends("one", "source"), ["lang", "one"]).join(ends("other", "item"), ["lang", "other"]).select("lang", "source", "item", "value")
    # without kept terms all sources are equally far: one row per pair, which the contract asks for
    bare = groups.where("v = 0").select("lang", "source")
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.unionByName(none).withColumn("part", F.lit("pair"))

    # part `term`
    own = held.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
    p = share(F.col("count"))
    own = own.withColumn("p", p).withColumn("total", F.col("lang_total")).withColumn("q", share(F.col("all")))
    favoured = own.where("count > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    first = favoured.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TERM_RANKS)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(order)).select(*columns).unionByName(first.select(*columns))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))
