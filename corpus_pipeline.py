"""A corpus pipeline of five stages, each of which works on all that the one before it kept.

Language ID rejects texts without a letter; near-duplicate groups keep one document; passages of 50 words or more that
stand in several documents are removed; sources are mixed to target weights; the mix is encoded and decoded. All but
the last stage return the columns of documents. Each stage first deletes the helper tables of the stages before it,
whose results are on disk by then.

Defined cases: null and empty texts go in the first stage; of equal or near texts the one with the smallest id stays,
nulls last, of equal rows one; a table that is empty, or becomes so, passes all stages; extra columns, whatever their
names, are kept up to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgrain.llm.byte_bpe import encode_and_decode
from fieldgrain.llm.common import documents, small_batches, sweep, written
from fieldgrain.llm.language import UNKNOWN, predicted, train
from fieldgrain.llm.mixing import mixed_texts
from fieldgrain.llm.near_dups import near_classes
from fieldgrain.llm.repeats import removed_passages

#: Words that a worker keeps from the last stage on: workers serve all stages, so what one remembers the others lack.
REMEMBERED = 200_000


def whole_of(docs: DataFrame):
    """All columns in a struct, out of reach of the names that a stage uses."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language."""
    small_batches(spark)
    marked = docs.select(whole_of(docs), "text")
    found = predicted(marked, train(docs), ["_whole"])
    return found.where(F.col("lang_pred") != UNKNOWN).select("_whole.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id, nulls last, then with the smallest hash."""
    sweep(docs)
    # a row's key: two hashes, one over all columns and which of them are null; rows that share it are equal
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keys = {"_text": F.xxhash64("text"), "_row": F.xxhash64(*columns, *[c.isNull() for c in columns])}
    keyed = docs.select(whole_of(docs), "doc_id", "text", *[k.alias(n) for n, k in keys.items()])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", *keys)).alias("first")
    classes = near_classes(keyed.select("doc_id", "text", *keys), list(keys))
    kept = classes.groupBy("part").agg(first).select("first._text", "first._row")
    # equal rows are brought to one first, by tasks' own rows before they are dealt out
    return keyed.dropDuplicates(list(keys)).join(kept, list(keys), "left_semi").select("_whole.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in other documents too."""
    sweep(docs)
    return removed_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents."""
    sweep(docs)
    return mixed_texts(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents' ids and decoded texts."""
    sweep(docs)
    return encode_and_decode(docs, remembered=REMEMBERED)


STAGES = [
    ("language_id", languages),
    ("near_dedup", near_copies),
    ("repeated_passages", repeats),
    ("mixing", mixture),
    ("bpe", encoding),
]

#: The stages' models, hashes and vocabularies are beyond SQL; tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
