"""Suffix-array dedup: removal of every byte covered by a string of ``length`` bytes that also starts elsewhere.

Each window of ``length`` bytes has an anchor: the place of the smallest hash among the 100-byte strings inside it.
Equal windows have equal anchor strings at the same offset, so only windows whose anchor string occurs twice can be
repeated. The windows of one place of an anchor form a fragment of at most 2 * length bytes. Equal fragments are
counted once (all their windows are repeated if there are two); the different fragments of an anchor string meet in one
task, which drops those that can share no window with another. The rest form shards, whose suffixes are sorted by
external induced sorting with common prefixes. A window is repeated if its suffix shares ``length`` bytes with a
neighbour in that order.

An anchor string with more than ``hot`` different fragments is not gathered in a task: its windows are counted by hash
with map-side sums instead, which is exact as well.

Defined cases: null counts as empty; texts shorter than ``length`` keep all bytes; rows equal in id and text are
documents of their own, each a copy of the other; a null id is an id of its own; an empty table gives an empty result;
other columns, whatever their names, are kept by removed_text() and removed_passages() and ignored elsewhere; a very
long text is one row of the first pass and of the last, its fragments are rows of their own in between.

removed_passages() works on words: a text becomes a string of four-byte hashes of its words, so that passages that
differ in white space match. Only passages that stand in several documents go; rows equal in id and text count as one
document there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgrain.llm.common import documents, text_of, written
from fieldgrain.llm.induced import repeated_starts
from fieldgrain.llm.near_dups import BASE, BYTE_VALUES, UNBASE, U, mix, powers

LENGTH = 400
ANCHOR = 100
GROUP_BYTES = 1 << 20
SHARD_BYTES = 1_500_000
SECTIONS = 8
HOT = 20_000
NO_ID = -(1 << 63)
PASSAGE_WORDS = 50
PASSAGE_ANCHOR_WORDS = 10
WORD_BYTES = 4
KNOWN_WORDS = 200_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FRAGMENT = ["anchor", "fragment", "offset", "span"]


def string_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each place on."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([[U(0)], np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data))[1:], dtype=np.uint64)])
    return mix((sums[n:] - sums[:-n]) * powers(UNBASE, len(data))[: len(data) - n + 1])


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def fragments_of(texts: list[bytes], length: int, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """text, first and last window start, anchor's offset from the first, anchor hash, fragment hash of every fragment."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sizes = np.array([len(t) for t in texts])
    stops = np.cumsum(sizes)
    up, down = powers(BASE, len(data)), powers(UNBASE, len(data))
    sums = np.concatenate([[U(0)], np.cumsum(BYTE_VALUES[data] * up[1:], dtype=np.uint64)])
    anchors = mix((sums[anchor:] - sums[:-anchor]) * down[: len(data) - anchor + 1])
    bits = U(max(1, int(len(data)).bit_length()))
    least = sliding_least((anchors >> bits << bits) | np.arange(len(anchors), dtype=np.uint64), length - anchor + 1)
    at = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    window = np.arange(len(at))
    text = np.searchsorted(stops, window, side="right")
    inside = window + length <= stops[np.minimum(text, len(stops) - 1)]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & inside)
    # windows inside a text come before those that cross its end, so a run ends at the next start or there
    edge = np.flatnonzero(new | ~inside)
    follow = np.append(edge, len(at))[np.searchsorted(edge, first, side="right")]
    last = follow - 1
    end = last + length
    whole = mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    start = (stops - sizes)[text[first]]
    return text[first], first - start, last - start, at[first] - first, anchors[at[first]].astype(np.int64), whole.astype(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """The columns with ``_id`` and ``_hash``, which tell rows apart but for equal ones, and ``_bytes``."""
    text = text_of()
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_hash"), text.cast("binary").alias("_bytes"))


def all_fragments(rows: DataFrame, length: int, anchor_bytes: int = ANCHOR, code: Callable[[], Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """The fragments of ``_bytes``, or of what a function made by ``code`` turns it into, in the same Python call."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_hash", "first", "last", "offset", "anchor", "fragment"]
        coded = code() if code else bytes
        for batch in batches:
            ids, hashes = batch.column("_id").to_numpy(), batch.column("_hash").to_numpy()
            group, start, size = [], 0, 0
            for i, text in enumerate([*batch.column("_bytes"), None]):
                if text is not None:
                    group.append(coded(text.as_py()))
                    size += len(group[-1])
                if group and (text is None or size > GROUP_BYTES):
                    at, first, last, offset, anchor, fragment = fragments_of(group, length, anchor_bytes)
                    at = at + start
                    arrays = [ids[at], hashes[at], first.astype(np.int32), last.astype(np.int32), offset.astype(np.int32), anchor, fragment]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)
                    group, start, size = [], i + 1, 0

    cutting = rows.select("_id", "_hash", "_bytes").mapInArrow(cut, "_id long, _hash long, first int, last int, offset int, anchor long, fragment long")
    return cutting.withColumn("span", F.col("last") - F.col("first")).withColumn("_row", F.monotonically_increasing_id())


def sharing(rows: list[tuple], length: int, anchor: int) -> list[tuple]:
    """The fragments of an anchor but for those that share no window with another: the rest need not be sorted.

    Windows are told apart by the section that the anchor's offset in them falls into. All windows of a section have a
    core in common, so fragments with an equal window have an equal core. Equal hashes only keep more than needed.
    """
    step = -(-(length - anchor + 1) // SECTIONS)
    first: dict[tuple[int, int], int] = {}
    kept = set()
    for i, (_, _, offset, span, piece, _) in enumerate(rows):
        for section in range((offset - span) // step, offset // step + 1):
            start = offset - section * step
            other = first.setdefault((section, hash(piece[start : start + length - step + 1])), i)
            if other != i:
                kept |= {i, other}
    return [rows[i] for i in sorted(kept)]


def _shards(batches: Iterator[pa.RecordBatch], length: int, across: bool, anchor: int = ANCHOR) -> Iterator[pa.RecordBatch]:
    """Repeated stretches of the fragments of a partition sorted by anchor; an anchor's fragments stay together."""
    names = [*FRAGMENT, "low", "high"]
    held: list[tuple] = []
    group: list[tuple] = []
    size = 0

    def emit() -> pa.RecordBatch:
        out = []
        owners = [r[5] for r in held] if across else None
        for row, flag in zip(held, repeated_starts([r[4] for r in held], length, owners=owners)):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
            out += [(*row[:4], int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in [*FRAGMENT, "piece", "owner"]]):
            if group and row[0] != group[-1][0]:
                kept = sharing(group, length, anchor)
                held += kept
                size += sum(len(r[4]) for r in kept)
                group = []
                if size > SHARD_BYTES:
                    yield emit()
                    held, size = [], 0
            group.append(row)
    held += sharing(group, length, anchor)
    if held:
        yield emit()


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of the fragments: its place against the anchor, its hash and the fragment's owner."""
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in [*FRAGMENT, "piece", "owner"]]):
            value = string_hashes(np.frombuffer(row[4], np.uint8), length).astype(np.int64)
            n = len(value)
            at = np.arange(n, dtype=np.int32)
            arrays = [np.full(n, row[0]), np.full(n, row[1]), np.full(n, row[2], np.int32), np.full(n, row[3], np.int32), at, row[2] - at, value]
            arrays = [*[pa.array(a) for a in arrays], pa.array([row[5]] * n, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*FRAGMENT, "low", "place", "value", "owner"])


def spans_of(rows: DataFrame, length: int, hot: int = HOT, anchor: int = ANCHOR, across: bool = False, code: Callable[[], Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """_id, _hash, spans: the stretches (start, end) of ``_bytes`` that repeated strings cover. With ``across`` only
    strings that stand in another document (_id, _hash) count; with ``code`` the strings are those of the coded bytes."""
    found = written(all_fragments(rows, length, anchor, code), "fragments")
    document = F.xxhash64("_id", "_hash")
    owners = [F.min(document).alias("owner"), F.max(document).alias("other")]
    classes = found.groupBy(*FRAGMENT).agg(F.count("*").alias("n"), F.min("_row").alias("_row"), *owners)
    # a fragment that stands in several documents belongs to none
    classes = classes.withColumn("owner", F.when(F.col("owner") == F.col("other"), F.col("owner"))).drop("other")
    anchors = classes.groupBy("anchor").agg(F.sum("n").alias("places"), F.count("*").alias("kinds")).where("places > 1").drop("places")
    classes = written(classes.join(anchors, "anchor"), "classes")
    # one place of each fragment of an anchor with several, to fetch its bytes
    heads = classes.where("kinds > 1").select(*FRAGMENT, "kinds", "owner", "_row").join(found.select("_row", "_id", "_hash", "first", "last"), "_row").drop("_row")
    piece = F.expr(f"substring(_bytes, first + 1, last - first + {length})")
    once = _coded(rows, code) if code else rows.select("_id", "_hash", "_bytes")
    pieces = written(heads.join(once, ["_id", "_hash"]).select(*FRAGMENT, "kinds", "owner", piece.alias("piece")).dropDuplicates(FRAGMENT), "pieces")
    kinds = "anchor long, fragment long, offset int, span int, low int, high int"
    gathered = pieces.where(F.col("kinds") <= hot)
    # sorting is bound by CPU, so its tasks are made by the bytes to sort and not merged by the bytes shuffled
    size = gathered.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    sorted_ = gathered.drop("kinds").repartition(max(1, -(-size // (2 * SHARD_BYTES))), "anchor").sortWithinPartitions("anchor")
    shared = sorted_.mapInArrow(lambda b: _shards(b, length, across, anchor), kinds)
    each = pieces.where(F.col("kinds") > hot).drop("kinds").mapInArrow(lambda b: _windows(b, length), "anchor long, fragment long, offset int, span int, low int, place int, value long, owner long")
    apart = F.expr("min(owner) <> max(owner) or count(owner) < count(*)") if across else F.count("*") > 1
    twice = each.groupBy("anchor", "place", "value").agg(apart.alias("apart")).where("apart").drop("apart")
    shared = shared.unionByName(each.join(twice, ["anchor", "place", "value"]).select(*FRAGMENT, "low", F.col("low").alias("high")))
    whole = F.col("owner").isNull() if across else F.col("n") > 1  # all windows of such a fragment count
    copies = classes.where(whole).select(*FRAGMENT, F.lit(0).alias("low"), F.col("span").alias("high"))
    hits = copies.unionByName(shared.join(classes.where(~whole).select(*FRAGMENT), FRAGMENT, "left_semi"))
    placed = found.join(hits, FRAGMENT).select("_id", "_hash", F.struct((F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + length).alias("end")).alias("s"))
    return placed.groupBy("_id", "_hash").agg(F.collect_set("s").alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """_id, _hash, spans: for every document with repeated strings, the stretches (start, end) of bytes they cover."""
    return spans_of(keyed(docs.select("doc_id", "text")), length, hot)


def united(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for run in runs for x in run], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans in zip(batch.column("_bytes"), batch.column("spans")):
                data, runs = data.as_py(), united(spans.as_py() or [])
                out.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(data, runs)).hexdigest()))
            columns = list(zip(*out)) if out else [[]] * 4
            arrays = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = keyed(docs.select("doc_id", "text"))
    met = rows.join(spans_of(rows, length, hot), ["_id", "_hash"], "left").select("doc_id", "_bytes", "spans")
    return met.mapInArrow(digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(docs: DataFrame, rows: DataFrame, spans: DataFrame, keep: Callable[[bytes, list[tuple[int, int]]], bytes]) -> DataFrame:
    """The documents with what ``keep`` leaves of the texts that have spans. The caller's columns travel in a struct."""

    @F.arrow_udf("string")
    def left(text: pa.Array, spans: pa.Array) -> pa.Array:
        kept = [None if t is None else keep(t.encode(), united(s)).decode("utf-8", "ignore") for t, s in zip(text.to_pylist(), spans.to_pylist())]
        return pa.array(kept, pa.string())

    met = rows.join(spans, ["_id", "_hash"], "left")
    hit = F.col("spans").isNotNull()
    met = met.select("_whole", hit.alias("hit"), left(F.when(hit, F.col("_whole.text")), "spans").alias("left"))
    new = {"text": F.when(F.col("hit"), F.col("left")).otherwise(F.col("_whole.text"))}
    if "n_chars" in docs.columns:
        count = F.length("left").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("hit"), count).otherwise(F.col("_whole.n_chars"))
    return met.select(*[new.get(c, F.col(f"_whole.`{c}`")).alias(c) for c in docs.columns])


def _wrapped(docs: DataFrame) -> DataFrame:
    return keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), "doc_id", "text")).drop("doc_id", "text")


def removed_text(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The documents with their remaining text; bytes of a code point that a removal has split are dropped."""
    rows = _wrapped(docs)
    return _cut(docs, rows.drop("_bytes"), spans_of(rows.drop("_whole"), length, hot), kept_bytes)


def _coded(rows: DataFrame, code: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = code()
        for batch in batches:
            out = pa.array([coded(text.as_py()) for text in batch.column("_bytes")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_hash"), out], ["_id", "_hash", "_bytes"])

    return rows.select("_id", "_hash", "_bytes").mapInArrow(each, "_id long, _hash long, _bytes binary")


def word_coder() -> Callable[[bytes], bytes]:
    """Function from a text to the hashes of its words, four bytes each; it remembers words."""
    known: dict[bytes, bytes] = {}

    def coded(text: bytes) -> bytes:
        words = text.split()
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = hashlib.blake2b(w, digest_size=WORD_BYTES).digest()
        return b"".join([known[w] for w in words])

    return coded


def without_words(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the words of the runs, given in bytes of its word string; white space goes with the word before it."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    return kept_bytes(text, [(starts[-(-a // WORD_BYTES)], starts[b // WORD_BYTES]) for a, b in runs])


def removed_passages(docs: DataFrame, words: int = PASSAGE_WORDS, hot: int = HOT) -> DataFrame:
    """The documents without the passages of ``words`` words or more that stand in another document too."""
    rows = _wrapped(docs)
    spans = spans_of(rows.drop("_whole"), words * WORD_BYTES, hot, PASSAGE_ANCHOR_WORDS * WORD_BYTES, across=True, code=word_coder)
    return _cut(docs, rows.drop("_bytes"), spans, without_words)


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
