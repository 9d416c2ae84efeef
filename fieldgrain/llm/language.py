"""Language identification with error-correcting output codes.

Every learned language has a codeword of bits. For each bit there is a binary classifier over hashed byte n-grams (1 to
4 bytes of the lower-cased text): the log ratio of the n-gram's smoothed share among the languages with the bit set to
that among the others. A text's margin for a bit is the mean over its n-grams; decoding takes the codeword with the
least loss, where a bit's exponential loss counts by how well its classifier separates the training languages. A
prediction whose two best codewords are closer than ``ambiguous`` is flagged.

The n-gram counts are sums over all training documents; only the model, ``buckets`` numbers a language, comes to the
driver. Every language of the training rows is learned.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without training rows every text is
``und``; ties go to the language that sorts first; ids that are null or repeat are rows like others (a null id is not
held out); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldgrain.llm.common import documents

BUCKETS = 1 << 14
GROUP_BYTES = 1 << 20
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_buckets(data: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Buckets of the n-grams that start at each byte, for n from 1 to 4; shorter at the end."""
    out, key = [], np.zeros(len(data), np.uint32)
    for n in range(1, 5):
        key = key[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :].astype(np.uint32) + np.uint32(1)
        mixed = key * np.uint32(0x9E3779B1) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        mixed ^= mixed >> np.uint32(15)
        out.append((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - int(buckets).bit_length() + 1))
    return out


def codewords(languages: int) -> np.ndarray:
    """A row of bits (-1, 1) for each language: the exhaustive code up to 5 languages, else a fixed random one."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        columns = [[1 if (c >> i) & 1 else -1 for i in range(languages)] for c in range(1, 1 << (languages - 1))]
        return np.array(columns).T
    bits = 8 * int(np.ceil(np.log2(languages))) + 7
    code = np.random.default_rng(5).choice([-1, 1], (languages, bits))
    split = np.abs(code.sum(0)) < languages  # a bit that is the same for all says nothing
    return code[:, split]


def count_grams(docs: DataFrame, buckets: int) -> DataFrame:
    """lang, bucket, n over the training documents."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.lower("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(buckets, np.int64)
                for part in gram_buckets(np.frombuffer(text.encode(), np.uint8), buckets) if text else ():
                    sums[lang] += np.bincount(part, minlength=buckets)
        for lang, sum_ in sums.items():
            at = np.flatnonzero(sum_)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sum_[at], pa.int64())], ["lang", "bucket", "n"])

    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, ambiguous: float):
        self.languages, self.ambiguous = languages, ambiguous
        if not languages:  # predict() then says that it does not know
            return
        self.code = codewords(len(languages))
        shares = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
        ones = (self.code.T > 0).astype(float)
        zeros = 1 - ones
        side = lambda m: (m @ shares) / np.maximum(m.sum(1, keepdims=True), 1)
        many = (ones.sum(1) > 0) & (zeros.sum(1) > 0)
        weights = np.where(many[:, None], np.log(np.maximum(side(ones), 1e-12)) - np.log(np.maximum(side(zeros), 1e-12)), 0.0)
        self.table = np.ascontiguousarray(weights.T, np.float32)  # bucket x bit
        own = shares @ self.table  # expected margin of each language for each bit
        gap = np.maximum(np.min(own * self.code, axis=0), 0.0) + 1e-6
        self.bit_weights = gap / gap.sum()
        self.scale = 1.0 / np.maximum(np.median(np.abs(own)), 1e-6)

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean margin of each text for each bit."""
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, text in enumerate(texts):
            data = np.frombuffer(text.encode(), np.uint8)
            counts = np.zeros(len(self.table), np.int64)
            for part in gram_buckets(data, len(self.table)) if len(data) else ():
                counts += np.bincount(part, minlength=len(self.table))
            out[i] = counts @ self.table / max(1, counts.sum())
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        known = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        langs, scores, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if known:
            margins = self.margins([texts[i].lower() for i in known]) * self.scale
            loss = np.exp(-margins[:, None, :] * self.code[None]) @ self.bit_weights
            loss = np.minimum(loss, 1e12)
            near = np.exp(-(loss - loss.min(1, keepdims=True)))
            near /= near.sum(1, keepdims=True)
            best = loss.argmin(1)
            two = np.sort(near, axis=1)[:, ::-1]
            gap = two[:, 0] - (two[:, 1] if two.shape[1] > 1 else 0.0)
            for i, b, s, g in zip(known, best.tolist(), two[:, 0].tolist(), gap.tolist()):
                langs[i], scores[i], unsure[i] = self.languages[b], s, g < self.ambiguous
        return langs, scores, unsure


def train(docs: DataFrame, buckets: int = BUCKETS, ambiguous: float = 0.02) -> Model:
    counts = count_grams(docs, buckets)
    lists = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).collect()  # at most ``buckets`` a language
    table = {r["lang"]: r["c"] for r in lists}
    languages = sorted(table)
    matrix = np.zeros((len(languages), buckets))
    for i, lang in enumerate(languages):
        for bucket, n in table[lang]:
            matrix[i, bucket] = n
    return Model(languages, matrix, ambiguous)


def predicted(docs: DataFrame, model: Model, extra: list[str] | None = None) -> DataFrame:
    """The columns named in ``extra`` (default: doc_id) with lang_pred, score and ambiguous."""
    keep = extra or ["doc_id"]
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # buckets x bits numbers
    names = [*keep, "lang_pred", "score", "ambiguous"]
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, unsure = shipped.value.predict(batch.column(len(keep)).to_pylist())
            arrays = [*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document."""
    return predicted(docs, train(docs)).withColumn("held_out", held_out())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
