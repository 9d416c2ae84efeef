"""Merkle manifest of a table: per source a hash tree with three children a node, and a tree over the sources' roots.

A tree is cut into aligned blocks, subtrees of ``height`` levels over 3^height leaves. A block's digests are stored in
van Emde Boas order: the upper half of its levels first, then each lower subtree, every part laid out the same way, so
that a path touches few stretches of memory whatever the size of a cache line or page. Addresses follow from (depth,
index) by arithmetic, which serves both the construction and the fetching of siblings. The roots of the blocks are the
leaves of the next tier, until one root is left; the roots of the sources form a tree of their own. All blocks of a
tier are built at once, each in one Arrow call over at most 3^height rows, so a source that holds most rows spreads over
as many tasks as it has blocks.

Defined cases: every row is a leaf, also if it repeats or has a null id; null ids come first, rows with equal ids are
ordered by digest; null fields, a null source included, count as such (a dash in the leaf, first among the sources); an
empty table gives an empty result; extra columns, whatever their names, are ignored; texts of any length are hashed by
the JVM in place and leave the row as 32 bytes.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldgrain.llm.common import documents, numbered, written

#: Children of a node, fields of a leaf in their order.
FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

HEIGHT = 6
PATH = "array<struct<left: binary, right: binary>>"


@functools.lru_cache(maxsize=64)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """Van Emde Boas address of every node of a complete tree with so many levels, by depth from the root."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    top = levels // 2
    size = lambda n: (FANOUT**n - 1) // (FANOUT - 1)
    below = addresses(levels - top)
    starts = size(top) + size(levels - top) * np.arange(FANOUT**top)
    return (*addresses(top), *[(starts[:, None] + part[None, :]).ravel() for part in below])


def block_nodes(leaves: list[bytes], levels: int) -> tuple[np.ndarray, list[int]]:
    """Digests of a block in van Emde Boas order and the number of nodes at each depth. The last run of three may be
    shorter at any depth; absent nodes stay zero."""
    at = addresses(levels + 1)
    nodes = np.zeros((sum(map(len, at)), 32), np.uint8)
    counts = [len(leaves)]
    nodes[at[levels][: len(leaves)]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32)
    for depth in range(levels - 1, -1, -1):
        n = -(-counts[0] // FANOUT)
        for i in range(n):
            run = nodes[at[depth + 1][FANOUT * i : min(FANOUT * (i + 1), counts[0])]]
            nodes[at[depth][i]] = np.frombuffer(hashlib.sha256(run.tobytes().hex().encode()).digest(), np.uint8)
        counts.insert(0, n)
    return nodes, counts


def siblings(nodes: np.ndarray, counts: list[int], leaf: int) -> list[dict[str, bytes]]:
    """The siblings to the left and to the right of a leaf's way up, from the leaf's own level on."""
    at = addresses(len(counts))
    path = []
    for depth in range(len(counts) - 1, 0, -1):
        first = leaf - leaf % FANOUT
        last = min(first + FANOUT, counts[depth])
        path.append({"left": nodes[at[depth][first:leaf]].tobytes(), "right": nodes[at[depth][leaf + 1 : last]].tobytes()})
        leaf //= FANOUT
    return path


def levels_of(n: Column) -> Column:
    """Levels above n leaves."""
    powers = F.array(*[F.lit(FANOUT**k).cast("long") for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < n))


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """Blocks and paths of one tier. ``nodes``: grp, pos, digest, levels (levels above the nodes).

    One row per node (its path inside its block) and one per block (pos null; its root, its nodes).
    """
    kind = nodes.schema["grp"].dataType
    size = FANOUT**height
    names = ["grp", "block", "pos", "path", "root", "nodes"]
    schema = f"grp {kind.simpleString()}, block long, pos long, path {PATH}, root binary, nodes binary"
    path_kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        leaves, pos = table.column("digest").to_pylist(), table.column("pos").to_pylist()
        own = min(height, table.column("levels")[0].as_py())
        nodes, counts = block_nodes(leaves, own)
        paths = [siblings(nodes, counts, i) for i in range(len(leaves))]
        root = nodes[addresses(own + 1)[0][0]].tobytes()
        n, grp, block = len(leaves), table.column("grp")[0].as_py(), table.column("block")[0].as_py()
        columns = [[grp] * (n + 1), [block] * (n + 1), [*pos, None], [*paths, None], [None] * n + [root], [None] * n + [nodes.tobytes()]]
        kinds = [table.schema.field("grp").type, pa.int64(), pa.int64(), path_kind, pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    cut = nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    return cut.groupBy("grp", "block").applyInArrow(build, schema)


def trees(leaves: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees over leaves (grp, pos, digest, n), one per group: (paths: grp, pos, path), (roots: grp, digest) and the
    manifest (grp, tier, block, root, nodes), which stores every block. Each tier is written once."""
    nodes = leaves.select("grp", "pos", "digest", levels_of(F.col("n")).alias("levels"))
    most = nodes.agg(F.max("levels")).first()[0] or 0
    tiers = []
    for tier in range(max(1, -(-most // height))):
        built = written(_blocks(nodes, height), f"merkle-tier{tier}")
        above = nodes.where("pos = 0").select(F.col("grp").alias("_grp"), "levels")
        tops = built.where("pos is null").select("grp", "block", "root", "nodes")
        tops = tops.join(above, F.col("grp").eqNullSafe(F.col("_grp"))).withColumn("levels", F.greatest(F.col("levels") - height, F.lit(0)))
        tops = written(tops.drop("_grp"), f"merkle-tops{tier}")
        tiers.append((built.where("pos is not null").select("grp", "block", "pos", "path"), tops))
        nodes = tops.where("levels > 0").select("grp", F.col("block").alias("pos"), F.col("root").alias("digest"), "levels")
    paths = None
    for below, tops in reversed(tiers):
        if paths is None:
            paths = below.select("grp", "pos", "path")
            continue
        upper = paths.select(F.col("grp").alias("_grp"), F.col("pos").alias("_block"), F.col("path").alias("_path"))
        met = below.join(upper, (F.col("block") == F.col("_block")) & F.col("grp").eqNullSafe(F.col("_grp")), "left")
        paths = met.select("grp", "pos", F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path")).alias("path"))
    roots = functools.reduce(DataFrame.unionByName, [tops.where("levels = 0").select("grp", F.col("root").alias("digest")) for _, tops in tiers])
    manifest = [tops.select("grp", F.lit(t).alias("tier"), "block", "root", "nodes") for t, (_, tops) in enumerate(tiers)]
    return paths, roots, functools.reduce(DataFrame.unionByName, manifest)


def leaf_digest(text: Column) -> Column:
    """Digest of a row with ``text`` in place of its text."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" else F.col(name).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def tampered_text() -> Column:
    """The text without line feeds where 2 divides crc32 of the id; a null id is left alone."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def hex_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def hash_of(digests: Column) -> Column:
    """H of concatenated digests, which it reads as lower-case hex text."""
    return F.unhex(F.sha2(hex_of(digests).cast("binary"), 256))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its way give."""
    return F.aggregate(path, leaf, lambda node, s: hash_of(F.concat(s["left"], node, s["right"])))


def manifest(docs: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks). Rows: doc_id, source, pos, leaf and altered (the digest of the tampered row), subroot, root, path
    (siblings up to the root), digests in binary. Blocks: grp (the source, or null with ``top``), tier, block, root,
    nodes in van Emde Boas order, top."""
    digests = docs.select("doc_id", "source", leaf_digest(F.col("text")).alias("leaf"), leaf_digest(tampered_text()).alias("altered"))
    leaves = numbered(digests, ["source"], ["doc_id", "leaf"], "pos", "merkle-leaves")
    leaves = leaves.withColumn("grp", F.col("source"))
    paths, roots, blocks = trees(leaves.select("grp", "pos", F.col("leaf").alias("digest"), "n"), height)
    ranked = numbered(roots.withColumnRenamed("grp", "source"), [], ["source"], "pos", "merkle-sources").withColumn("grp", F.lit(0))
    top_paths, top_roots, top_blocks = trees(ranked.select("grp", "pos", "digest", "n"), height)
    # one row for each source
    tops = ranked.join(top_paths.drop("grp"), "pos").select(F.col("source").alias("_source"), F.col("digest").alias("subroot"), F.col("path").alias("_upper"))
    tops = tops.crossJoin(F.broadcast(top_roots.select(F.col("digest").alias("root"))))
    paths = paths.select(F.col("grp").alias("_grp"), F.col("pos").alias("_pos"), "path")
    met = leaves.join(paths, (F.col("pos") == F.col("_pos")) & F.col("grp").eqNullSafe(F.col("_grp")))
    met = met.join(tops, F.col("source").eqNullSafe(F.col("_source")))
    rows = met.select("doc_id", "source", "pos", "leaf", "altered", "subroot", "root", F.concat("path", "_upper").alias("path"))
    kept = ["tier", "block", "root", "nodes"]
    stored = blocks.select("grp", *kept, F.lit(False).alias("top"))
    return rows, stored.unionByName(top_blocks.select(F.lit(None).cast(blocks.schema["grp"].dataType).alias("grp"), *kept, F.lit(True).alias("top")))


def audit(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, digests in lower-case hex."""
    rows, _ = manifest(docs, height)
    proof = F.aggregate("path", F.lit(b""), lambda all_, s: F.concat(all_, s["left"], s["right"]))
    done = rows.select("doc_id", "leaf", "subroot", "root", hash_of(proof).alias("proof"), folded(F.col("altered"), F.col("path")).alias("folded"))
    digests = [hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return done.select("doc_id", *digests, hex_of(F.col("proof")).alias("proof_sha256"), hex_of(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))
