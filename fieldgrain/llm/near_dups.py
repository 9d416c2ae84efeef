"""MinHash near-dedup with ProbMinHash: signatures, bands, verified links, classes.

A document's elements are its distinct shingles of five words (all its words if fewer). Each element is a Poisson
process with the element's weight as its rate; an arrival goes to a uniform slot, and a slot keeps the element that
arrives there first. An element stops once its next arrival is later than every slot's. Slots of two documents agree
with the probability Jaccard of their weights; with the default, equal weights, that is the Jaccard similarity.

34 bands of 6 slots find a pair of similarity 0.8 but for 3 in a hundred thousand. Documents with the same shingles are
one node. A node is verified against the leading node of its two largest buckets, then against the leading nodes of its
other buckets (another in each band) that are not yet in its component. Last, nodes of a bucket that are in different
components are verified against each other; nodes of large buckets first meet on their rarest shingles, which is exact
(prefix_pairs). Verification compares the whole shingle sets. Pairs inside a component are never listed.

Defined cases: null counts as empty; documents without words are alike only if their texts are equal; rows with null or
repeated ids belong to the class of their text; a class is named by its smallest id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldgrain.llm.common import documents, text_of, written

WORDS = 5
BANDS, ROWS = 34, 6
SIMILARITY = 0.8
#: Members of a bucket beyond which they meet on their rarest shingles.
LARGE = 16
GROUP_BYTES = 2_000_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of every shingle, repeats included, in document order."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up = powers(BASE, len(data))
    sums = np.concatenate([[U(0)], np.cumsum(BYTE_VALUES[data] * up[1:], dtype=np.uint64)])
    word = mix((sums[end] - sums[start]) * powers(UNBASE, len(data))[start] + (end - start).astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(stops, start, side="right")
    n = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    many = np.maximum(n - words + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(texts)), many)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    value = np.zeros(len(owner), np.uint64)
    for k in range(words):
        there = k < n[owner]
        value = np.where(there, mix(value * U(BASE) + word[np.minimum(at + k, len(word) - 1)] + U(k + 1)), value)
    return owner, value


def signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """docs x slots: the element that arrives first in each slot. Elements are distinct within a document."""
    first = np.full(docs * slots, np.inf)
    name = np.zeros(docs * slots, np.uint64)
    total = np.bincount(owner, weights=weight, minlength=docs)
    # a horizon by which all slots are very likely taken; documents with an empty slot are done again with a later one
    horizon = slots * (np.log(slots) + 4) / np.maximum(total, 1e-300)
    todo = np.unique(owner)
    mine = np.arange(len(owner))
    while len(todo):
        at, element, time = mine, value[mine], np.zeros(len(mine))
        limit = horizon.copy()
        turn = 0
        while len(at):
            draw = mix(element + U(turn * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((draw >> U(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight[at]
            on = time <= limit[owner[at]]
            at, element, time, draw = at[on], element[on], time[on], draw[on]
            slot = owner[at] * slots + (mix(draw) % U(slots)).astype(np.int64)
            wins = np.flatnonzero(time < first[slot])
            wins = wins[np.argsort(-time[wins], kind="stable")]  # of several for a slot the earliest is written last
            first[slot[wins]] = time[wins]
            name[slot[wins]] = element[wins]
            limit = np.minimum(limit, first.reshape(docs, slots).max(1))
            turn += 1
        open_ = np.isinf(first.reshape(docs, slots)[todo]).any(1)
        todo = todo[open_]
        horizon[todo] *= 2
        if len(todo):
            again = np.zeros(docs, bool)
            again[todo] = True
            mine = np.flatnonzero(again[owner])
    return name.reshape(docs, slots)


def signed(texts: list[bytes], bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> list[tuple[int, int, list[int] | None, bytes]]:
    """node, number of shingles, band values and the sorted shingles (four bytes each) of every text."""
    owner, value = shingles(texts)
    by = np.lexsort((value, owner))
    owner, value = owner[by], value[by]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(owner)))
    owner, value = owner[new], value[new]
    weight = times.astype(float) if counted else np.ones(len(owner))
    slots = signatures(owner, value, weight, len(texts), bands * rows).reshape(len(texts), bands, rows)
    band = np.zeros((len(texts), bands), np.uint64)
    for r in range(rows):
        band = mix(band * U(BASE) + slots[:, :, r] + U(r + 1))
    band = band.astype(np.int64)
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        mine = value[ends[i] : ends[i + 1]]
        if not len(mine):
            raw = np.frombuffer(text, np.uint8).astype(np.uint64)
            node = int(mix(np.array([len(text) + 1], np.uint64) * U(BASE) + (raw * powers(BASE, len(raw))[1:]).sum(dtype=np.uint64)).astype(np.int64)[0])
            out.append((node, 0, None, b""))
            continue
        node = int(mix(np.array([mix(mine * U(BASE) + U(7)).sum(dtype=np.uint64) + U(len(mine))], np.uint64)).astype(np.int64)[0])
        short = np.unique((mine >> U(32)).astype(np.uint32))
        out.append((node, len(mine), band[i].tolist(), short.tobytes()))
    return out


def signature_table(docs: DataFrame, bands: int, rows: int, counted: bool, carried: list[str]) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, group, size = [], [], 0
            for text in batch.column("text"):
                group.append(text.as_py().encode())
                size += len(group[-1])
                if size > GROUP_BYTES:
                    made += signed(group, bands, rows, counted)
                    group, size = [], 0
            made += signed(group, bands, rows, counted) if group else []
            node, n, band, short = zip(*made) if made else ((), (), (), ())
            arrays = [*[batch.column(c) for c in names], pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "node", "n", "bands", "shingles"])

    names = ["doc_id", *carried]
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in names)
    rows_ = docs.select(*names, text_of().alias("text"))
    return rows_.mapInArrow(sign, f"{kinds}node long, n long, bands array<long>, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, part: the smallest node of each connected component. Labels go along edges and to labels' labels, by rounds."""
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("part")), "labels")
    while True:
        heard = both.join(labels, both["v"] == labels["node"]).groupBy(both["u"].alias("node")).agg(F.min("part").alias("heard"))
        jump = labels.select(F.col("node").alias("part"), F.col("part").alias("far"))
        told = labels.join(heard, "node").join(jump, "part", "left")
        new = written(told.select("node", F.least("part", "heard", F.coalesce("far", "part")).alias("new"), F.col("part").alias("old")), "labels")
        labels = new.select("node", F.col("new").alias("part"))
        if not new.where("new <> old").limit(1).count():
            return labels


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, part) in different parts that can be similar enough; none that is so is left out.

    A set is ranked with its rarest shingles first. Two sets meet at their first common shingle; from there on they
    share at most what follows in the shorter rest, so it must stand early in both, earliest in the smaller set. Sets
    that vary one frequent original in different ways have their own shingles at these ranks, and do not meet.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, part, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "part", "shingles"))):
                each = np.frombuffer(raw, np.uint32).astype(np.int64)
                same = lambda x, k=len(each): pa.array(np.full(k, x, np.int64))
                yield pa.RecordBatch.from_arrays([same(node), same(part), same(len(each)), pa.array(each)], ["node", "part", "n", "shingle"])

    rows = written(sets.join(nodes, "node").select("node", "part", "shingles").mapInArrow(listed, "node long, part long, n long, shingle long"), "shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
    after = F.col("n") - F.col("rank") + 1
    ranked = rows.join(often, "shingle").withColumn("rank", rank)
    early = written(ranked.where((after >= similarity * F.col("n") - 1e-6) & (F.col("often") > 1)).withColumn("after", after).drop("rank", "often"), "early")
    # the smaller set of a pair, by (n, node), is met in the shorter list
    lesser = early.where((1 + similarity) * F.col("after") >= 2 * similarity * F.col("n") - 1e-6)
    lesser = lesser.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("node", "part", "n", "after")])
    ordered = F.struct("n2", "node2") < F.struct(F.col("n").alias("n2"), F.col("node").alias("node2"))
    enough = (1 + similarity) * F.least("after", "after2") >= similarity * (F.col("n") + F.col("n2")) - 1e-6
    met = early.join(lesser, "shingle").where((F.col("part") != F.col("part2")) & ordered & enough)
    return met.select(*_ordered("node", "node2"))


def near_classes(docs: DataFrame, carried: list[str], similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """doc_id, the columns ``carried``, node and part (the class) of every row."""
    signs = written(signature_table(docs, bands, rows, counted, carried), "signatures")
    banded = signs.where("n > 0").select("node", "n", F.posexplode("bands").alias("band", "value")).groupBy("band", "value", "node").agg(F.max("n").alias("n"))
    banded = written(banded, "bands")
    buckets = banded.groupBy("band", "value").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node", "band"), "node", "n")).alias("lead")).where("size > 1")
    members = written(banded.join(buckets, ["band", "value"]).select("band", "value", "node", "n", "size", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")), "members")
    wanted = members.select("node").distinct()
    sets = written(signs.join(wanted, "node", "left_semi").select("node", "shingles").dropDuplicates(["node"]), "sets")
    fits = lambda m, n: F.least(m, n) >= similarity * F.greatest(m, n)
    spokes = members.where("node <> lead").where(fits("n", "lead_n"))
    largest = F.row_number().over(Window.partitionBy("node").orderBy(F.col("size").desc(), "band"))
    stars = spokes.withColumn("r", largest).where("r <= 2").select(*_ordered("node", "lead")).distinct()
    links = written(verified(stars, sets, similarity), "links")
    parts = components(links)
    of = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part"))
    rest = spokes.join(of("node"), "node", "left").join(of("lead"), "lead", "left")
    apart = F.coalesce("node_part", "node") != F.coalesce("lead_part", "lead")
    more_links = written(verified(rest.where(apart).select(*_ordered("node", "lead")).distinct(), sets, similarity), "links")
    links = links.union(more_links)
    parts = components(links)
    # what a bucket still holds of different components
    labelled = members.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    mixed = labelled.groupBy("band", "value").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("band", "value")
    left = written(labelled.join(mixed, ["band", "value"]).select("band", "value", "node", "n", "part", "size"), "mixed")
    small = left.where(F.col("size") <= LARGE)
    other = small.select("band", "value", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("part").alias("part2"))
    met = small.join(other, ["band", "value"]).where((F.col("part") < F.col("part2")) & fits("n", "n2")).select(*_ordered("node", "node2"))
    large = left.where(F.col("size") > LARGE).groupBy("node").agg(F.min("part").alias("part"))
    later = written(verified(met.union(prefix_pairs(large, sets, similarity)).distinct(), sets, similarity), "links")
    whole = components(links.union(later))
    placed = signs.select("doc_id", *carried, "node").join(whole, "node", "left")
    return placed.withColumn("part", F.coalesce("part", "node"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """doc_id, node and class_id (the class's smallest id) of every row."""
    placed = near_classes(docs, [], similarity, bands, rows, counted)
    named = placed.groupBy("part").agg(F.min("doc_id").alias("class_id"))
    return placed.join(named, "part").select("doc_id", "node", "class_id")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id")
