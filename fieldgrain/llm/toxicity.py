"""Toxicity by non-negative positive-unlabelled learning.

Only rows labelled toxic teach; all other text, whatever its label, is unlabelled. A linear classifier over the words of
a text and their beginnings minimises  prior * P+ + max(0, U- - prior * P-), where P+ and P- are the mean logistic
losses of the positives if they counted as toxic or clean, U- that of the unlabelled rows if they counted as clean. The
share of toxic rows among the labelled training rows is the class prior.

1. One pass counts, for each of ``buckets`` hashed features, the training documents and the positives that have it. The
   features whose prior-corrected probability, prior * P(feature | positive) / P(feature), is ``screen`` or more stay,
   where the positives count with one standard error less.
2. One pass finds the remaining features of every training document. Unlabelled documents fall into shards of about
   ``shard_docs``; each shard and all positives train one numpy classifier, and the mean of the classifiers, weighted by
   documents, is the model. So every unlabelled document takes part, and a task holds one shard. Squared weights are
   penalised by ``strength`` over the number of training documents, as by a prior of fixed width.
3. One pass scores every document.

Bounds: the positives are the ``positive_limit`` labelled ids with the smallest hash; the model has at most ``buckets``
weights. Positives and model are the only things that reach the driver and are broadcast.

Defined cases: a null or empty text has no feature and gets the score of the bias; without positives every score is 0;
ids that are null or repeat are rows like others (a null id is not held out and has no label); an id with several labels
counts as toxic if one of them is 1; an empty table gives an empty result; extra columns, whatever their names, are
ignored; texts are read whole, a text of any length costs what its different words cost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldgrain.llm.common import documents, text_of, written

BUCKETS = 1 << 18
BEGINNINGS = (3, 4, 5, 6)
#: Words of so many bytes or less are remembered, so many of them at most: a bound on memory, not on what is read.
CACHED_BYTES, CACHED_WORDS = 40, 400_000
SEPARATORS = bytes(b if chr(b).isalpha() and b < 128 or b > 127 else 32 for b in range(256))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Features:
    """Features of texts: of each word and of its beginnings. ``place`` gives the number of each bucket, below 0 for
    those that do not count; without it a feature is its bucket."""

    def __init__(self, buckets: int, place: np.ndarray | None = None):
        self.buckets, self.place = buckets, place
        self.known: dict[bytes, np.ndarray | None] = {}

    def of_word(self, word: bytes) -> np.ndarray | None:
        """Features of a word, None if it has none that count."""
        letters = word.decode("utf-8", "ignore")
        names = [b"=" + word, *[b"^" + letters[:n].encode() for n in BEGINNINGS if n <= len(letters)]]
        found = np.array([zlib.crc32(n) % self.buckets for n in names], np.int32)
        if self.place is not None:
            found = self.place[found]
            found = found[found >= 0] if (found >= 0).any() else None
        if len(word) <= CACHED_BYTES and len(self.known) < CACHED_WORDS:
            self.known[word] = found
        return found

    def of_text(self, text: str) -> np.ndarray:
        """The different features of a text, in ascending order."""
        known, lists = self.known, []
        for w in set(text.lower().encode().translate(SEPARATORS).split()):
            found = known[w] if w in known else self.of_word(w)
            if found is not None:
                lists.append(found)
        return np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int32)


def feature_counts(marked: DataFrame, buckets: int) -> DataFrame:
    """bucket, positives, documents over training rows (text, positive); bucket -1 counts the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums, rows = Features(buckets), np.zeros((2, buckets), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, positive in zip(batch.column("text"), batch.column("positive").to_pylist()):
                at = features.of_text(text.as_py())
                sums[1, at] += 1
                sums[0, at] += positive
                rows += (positive, 1)
        at = np.flatnonzero(sums[1])
        columns = [np.append(at, -1).astype(np.int32), *[np.append(s[at], n) for s, n in zip(sums, rows)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "positives", "documents"])

    parts = marked.select("text", "positive").mapInArrow(count, "bucket int, positives long, documents long")
    return parts.groupBy("bucket").agg(F.sum("positives").alias("positives"), F.sum("documents").alias("documents"))


class Rows:
    """Sets of features, one set a row."""

    def __init__(self, lists: list[np.ndarray], width: int):
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.columns = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(lists)), self.sizes)
        self.width = width

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, weights[self.columns], len(self.sizes)) + bias

    def gradient(self, slopes: np.ndarray) -> np.ndarray:
        """Gradient by weights and, last, bias of a mean whose terms have these slopes by margin."""
        n = max(1, len(slopes))
        return np.append(np.bincount(self.columns, slopes[self.row], self.width), slopes.sum()) / n


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def nn_pu(positives: Rows, unlabelled: Rows, prior: float, steps: int = 300, rate: float = 0.1, penalty: float = 1e-4) -> np.ndarray:
    """Weights and, last, bias that minimise the non-negative risk, by full gradients and Adam.

    Where U- - prior * P- falls below 0 the step goes up that term alone, as in the non-negative rule.
    """
    model = np.zeros(positives.width + 1)
    model[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(model), np.zeros_like(model)
    for step in range(1, steps + 1):
        p, u = positives.margins(model[:-1], model[-1]), unlabelled.margins(model[:-1], model[-1])
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        part = unlabelled.gradient(sigmoid(u)) - prior * positives.gradient(sigmoid(p))
        slope = -part if negative < 0 else prior * positives.gradient(sigmoid(p) - 1) + part
        slope[:-1] += penalty * model[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope * slope
        model -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return model


def placed(kept: np.ndarray, buckets: int) -> np.ndarray:
    """The number of each bucket among those kept, -1 for the others."""
    place = np.full(buckets, -1, np.int32)
    place[kept] = np.arange(len(kept))
    return place


class Model:
    """Weights of the buckets that stayed, and a bias; without positives, no bias."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: float | None, buckets: int):
        self.kept, self.weights, self.bias, self.buckets = kept, weights, bias, buckets

    def scorer(self):
        """Function from a text to its score; it remembers the summed words it has seen."""
        features = Features(self.buckets, placed(self.kept, self.buckets))
        return lambda text: 0.0 if self.bias is None else float(sigmoid(self.weights[features.of_text(text)].sum() + self.bias))


def train(docs: DataFrame, labels: DataFrame, positive_limit: int = 4096, screen: float = 0.25, least: int = 3, strength: float = 1.5, shard_docs: int = 8192, buckets: int = BUCKETS) -> Model:
    spark = docs.sparkSession
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, rows = known.agg(F.sum(F.expr("int(toxic = 1)")), F.count("*")).first()
    if not toxic:
        return Model(np.zeros(0, np.int64), np.zeros(0), None, buckets)
    prior = min(0.9, toxic / rows)
    chosen = known.where("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positive_limit)
    chosen = written(chosen, "toxic-ids").withColumn("positive", F.lit(1))
    training = docs.select("doc_id", text_of().alias("text")).where(~held_out())
    # at most ``positive_limit`` ids, 8 bytes each
    marked = training.join(F.broadcast(chosen), "doc_id", "left").na.fill(0, ["positive"])
    counts = written(feature_counts(marked, buckets), "toxic-features")
    total = counts.where("bucket = -1").first()
    if total is None or not total["positives"]:
        return Model(np.zeros(0, np.int64), np.zeros(0), None, buckets)
    sure = F.greatest(F.col("positives") - F.sqrt("positives"), F.lit(0.0))
    chance = prior * sure / total["positives"] / (F.col("documents") / total["documents"])
    stay = counts.where((F.col("bucket") >= 0) & (F.col("positives") >= least) & (chance >= screen)).select("bucket")
    kept = np.sort(np.array([r["bucket"] for r in stay.collect()], np.int64))  # at most ``buckets`` numbers
    shipped = spark.sparkContext.broadcast(placed(kept, buckets))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets, shipped.value)
        for batch in batches:
            lists = pa.array([features.of_text(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), lists], ["doc_id", "positive", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = marked.select("doc_id", "positive", "text").mapInArrow(find, f"doc_id {kind}, positive int, features array<int>")
    shards = max(1, round(total["documents"] / shard_docs))
    # the row's number keeps null and repeated ids from meeting in one shard
    shard = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards))
    found = written(found.withColumn("shard", shard), "toxic-rows")
    taught = [np.array(r["features"], np.int64) for r in found.where("positive = 1").select("features").orderBy(F.xxhash64("features", "doc_id")).limit(positive_limit).collect()]
    sent = spark.sparkContext.broadcast(taught)
    width, penalty = len(kept), strength / total["documents"]

    def fit(table: pa.Table) -> pa.Table:
        unlabelled = [np.array(x, np.int64) for x in table.column("features").to_pylist()]
        model = nn_pu(Rows(sent.value, width), Rows(unlabelled, width), prior, penalty=penalty)
        at = np.arange(width + 1)
        return pa.table([pa.array(at, pa.int64()), pa.array(model * len(unlabelled)), pa.array([len(unlabelled)] * len(at), pa.int64())], ["at", "weight", "n"])

    fitted = found.groupBy("shard").applyInArrow(fit, "at long, weight double, n long")
    means = fitted.groupBy("at").agg((F.sum("weight") / F.sum("n")).alias("weight")).orderBy("at").collect()  # at most ``buckets``
    weights = np.array([r["weight"] for r in means])
    return Model(kept, weights[:-1], float(weights[-1]), buckets)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shipped.value.scorer()
        for batch in batches:
            values = np.array([of(t.as_py()) for t in batch.column("text")], np.float64)
            arrays = [batch.column("doc_id"), pa.array(values), pa.array((values >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(score, f"doc_id {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return scored(docs, train(docs, labels, **options)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
