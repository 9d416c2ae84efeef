"""Token counts of a sentencepiece model: lengths only, in Arrow batches balanced by bytes.

Long texts are cut at safe boundaries. No piece of the model holds a space mark after another character, and none
holds a line feed, so no merge crosses the point before a run of spaces, nor a line feed (one byte piece); both facts
are checked when the model is loaded. A text is then a list of chunks, each of which is encoded once per worker while it
stays in a bounded memory of counts.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result; ids may be null or
repeat, as rows are independent; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgrain.llm.common import documents, text_of

#: Texts are handed to the encoder in groups of about so many bytes.
GROUP_BYTES = 4_000_000
#: Chunks remembered by a worker.
REMEMBERED = 1_500_000
MARK = "▁"

_counters: dict[str, PieceCounter] = {}


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        pieces = [p.piece for p in model.pieces]
        rules = model.normalizer_spec
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        plain = rules.name == "identity" and not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        self.safe = plain and rules.add_dummy_prefix and "<0x0A>" in pieces and not any("\n" in p or MARK in p.lstrip(MARK) for p in pieces)
        rules.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.known: dict[str, int] = {}  # of a word with the space before it

    def counts(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.whole.encode(texts, num_threads=1)]
        if len(self.known) > REMEMBERED:
            self.known = {}
        # the mark itself, inside a text, is a space to the model
        parts = [(t.replace(MARK, " ") if MARK in t else t).split(" ") for t in texts]
        new: set[str] = set()
        for p in parts:
            new.update(p)
        new.discard("")
        plain = [w for w in new if w not in self.known]
        for words in ([w for w in plain if "\n" not in w], [w for w in plain if "\n" in w]):
            self.known.update(zip(words, self._chunks([MARK + w for w in words])))
        out, know = [], self.known.__getitem__
        for text, p in zip(texts, parts):
            if not text:
                out.append(0)
            elif "" not in p:
                out.append(sum(map(know, p)))
            else:
                out.append(self._spaced(p))
        return out

    def _chunks(self, chunks: list[str]) -> Iterable[int]:
        """Counts of chunks without a space inside, cut at line feeds."""
        if not any("\n" in c for c in chunks):
            return map(len, self.bare.encode(chunks, num_threads=1))
        cut = [c.split("\n") for c in chunks]
        flat = [x for c in cut for x in c if x]
        counts = iter([len(x) for x in self.bare.encode(flat, num_threads=1)])
        return [len(c) - 1 + sum(next(counts) for x in c if x) for c in cut]

    def _spaced(self, parts: list[str]) -> int:
        """A text with runs of spaces: a run and the word after it are one chunk."""
        chunks, total, marks = [], 0, ""
        for p in parts:
            marks += MARK
            if p:
                if len(marks) == 1:
                    total += self.known[p]
                else:
                    chunks.append(marks + p)
                marks = ""
        if marks:
            chunks.append(marks)
        return total + sum(self._chunks(chunks))


def counter(name: str) -> PieceCounter:
    """The worker's counter for a model: a path, or a name known to public_tokenizers."""
    if name not in _counters:
        import os

        import public_tokenizers

        _counters[name] = PieceCounter(name if os.path.sep in name else public_tokenizers.path(name))
    return _counters[name]


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    rows = docs.select("doc_id", text_of().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counter(model)
        for batch in batches:
            texts, lengths, group, size = batch.column("text"), [], [], 0
            for text in texts:
                group.append(text.as_py())
                size += len(group[-1])
                if size >= GROUP_BYTES:
                    lengths += encoder.counts(group)
                    group, size = [], 0
            lengths += encoder.counts(group)
            sizes = pa.compute.binary_length(texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(lengths, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
