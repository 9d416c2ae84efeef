"""Byte-level BPE by speculation and verification.

A text is cut into words with array operations on its code points. For a word not seen before, a greedy longest match
proposes tokens. A list of tokens is the encoding of its bytes exactly if every adjacent pair is: the pairs of all new
words are tested together, by undoing merges in step over arrays. Only words with a failing pair are merged exactly.

Defined cases: a null text counts as empty (no ids, empty decoded text); the added token's string inside a text becomes
its id, as the tokenizer's default has it; rows are independent, so null or repeated ids and extra columns do no harm;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldgrain.llm.common import documents, text_of

#: Words that a worker remembers, and the longest of them in bytes: a bound on memory, not on what is encoded.
REMEMBERED = 1_000_000
LONGEST = 64
#: Code points that are segmented together.
GROUP_CHARS = 1_000_000
SPACE, LETTER, NUMBER, OTHER = range(4)
#: The code points that the pattern's \s stands for.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_coders: dict[str, ByteBpe] = {}


def byte_letters() -> dict[str, int]:
    """The printable letter for each byte: itself where it is visible, else the next free one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def code_point_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            kinds[c] = LETTER
        elif kind == "N":
            kinds[c] = NUMBER
    kinds[list(WHITE)] = SPACE
    return kinds


class Lookup:
    """Array lookup of long keys, -1 where absent: open addressing in a table of at least four times their number."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several for one place, the last stays
            done = self.keys[at] == keys[left]
            self.values[at[done]] = values[left[done]]
            left, at = left[~done], (at[~done] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MIX) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        met = self.keys[at]
        out = self.values[at]
        wrong = np.flatnonzero((met != keys) & (met >= 0))
        out[met != keys] = -1
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            met = self.keys[at[wrong]]
            hit = met == keys[wrong]
            out[wrong[hit]] = self.values[at[wrong[hit]]]
            wrong = wrong[~hit & (met >= 0)]
        return out


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.tokens = [b""] * self.size
        for text, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in text)
        for text, i in added.items():
            self.tokens[i] = text.encode()
        self.added = added
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.ids = {self.tokens[i]: i for i in vocab.values()}
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        self.numbers = [str(i) for i in range(self.size)]
        # a token's order is the place of the merge that makes it; single bytes come first
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.order = np.full(self.size, -1, np.int64)
        self.merges: dict[tuple[int, int], int] = {}
        self.place: dict[int, int] = {}  # of a pair among the merges
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (pair.split(" ") if isinstance(pair, str) else pair)
            i, j, made = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault((i, j), made)
            self.place.setdefault(i * self.size + j, rank)
            self.made.append(made)
            if self.order[made] < 0:
                self.order[made], self.left[made], self.right[made] = rank, i, j
        pairs = np.array(list(self.place), np.int64)
        self.pair_order = Lookup(pairs, np.fromiter(self.place.values(), np.int64))
        self.made_at = np.array(self.made, np.int64)
        # the tokens as a tree of bytes: (node, byte) -> node, and the token that ends at a node
        step: dict[int, int] = {}
        ends = [-1]
        for token, i in self.ids.items():
            node = 0
            for b in token:
                key = node * 256 + b
                if key not in step:
                    step[key] = len(ends)
                    ends.append(-1)
                node = step[key]
            ends[node] = i
        self.step = Lookup(np.array(list(step), np.int64), np.fromiter(step.values(), np.int64))
        self.ends = np.array(ends, np.int64)
        self.classes = code_point_classes()
        self.width = np.uint16 if self.size <= 0x10000 else np.uint32
        self.known: dict[bytes, bytes] = {}
        self.remembered = REMEMBERED
        self.exact = 0  # words that speculation got wrong

    # --- words -----------------------------------------------------------------------------------------------------

    def cuts(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words begin, for texts joined without gaps that begin at ``starts`` (each of at least one code point)."""
        n = len(codes)
        kind = self.classes[codes]
        first = np.zeros(n + 1, bool)
        first[starts] = first[n] = True  # of a text
        begin = first.copy()
        begin[1:n] |= kind[1:] != kind[:-1]
        run = begin.copy()
        # the last character of white space before another word: a plain space joins that word, any other stands alone
        ends = np.flatnonzero(run[1:] & (kind == SPACE)) + 1
        ends = ends[~first[ends]]
        begin[ends - 1] = True
        joins = codes[ends - 1] == 32
        begin[ends[joins]] = False
        # a lone apostrophe at a word's start takes s, t, m, d, re, ve or ll with it
        quotes = np.flatnonzero((codes == 39) & run[:-1] & run[1:] & begin[:-1])
        quotes = quotes[~first[quotes + 1]]
        if len(quotes):
            padded = np.append(codes, [0, 0])
            one, two = padded[quotes + 1], padded[quotes + 2]
            same = ~first[np.minimum(quotes + 2, n)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            pairs = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
            long = same & (pairs[0] | pairs[1] | pairs[2]) & ~short
            for hit, extra in ((short, 2), (long, 3)):
                at = quotes[hit]
                begin[at + 1] = False
                after = at + extra
                begin[after] = True
        return np.flatnonzero(begin)

    def words(self, texts: list[str]) -> list[list[bytes]]:
        """The words of each text as UTF-8."""
        out: list[list[bytes]] = [[] for _ in texts]
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        joined = "".join(texts[i] for i in full)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.cumsum([0, *(len(texts[i]) for i in full)])
        begin = self.cuts(codes, starts[:-1])
        wide = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.concatenate([[0], np.cumsum(wide)])[begin].tolist()
        data = joined.encode()
        pieces = [data[a:b] for a, b in zip(place, place[1:])]
        ends = np.searchsorted(begin, starts).tolist()
        for i, a, b in zip(full, ends, ends[1:]):
            out[i] = pieces[a:b]
        return out

    # --- tokens ----------------------------------------------------------------------------------------------------

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left, all words in step: the tokens and the word of each, word by word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        stop = np.cumsum(lengths)
        word = np.arange(len(words))
        start = stop - lengths
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            # walk the tree from ``start`` and remember the last token passed
            node, at = np.zeros(len(word), np.int64), start.copy()
            token, after = np.full(len(word), -1, np.int64), start.copy()
            live = np.arange(len(word))
            while len(live):
                next_node = self.step(node[live] * 256 + data[at[live]]).astype(np.int64)
                live = live[next_node >= 0]
                next_node = next_node[next_node >= 0]
                node[live] = next_node
                at[live] += 1
                good = self.ends[next_node] >= 0
                token[live[good]], after[live[good]] = self.ends[next_node[good]], at[live[good]]
                live = live[at[live] < stop[word[live]]]
            found.append((word, start, token))
            more = after < stop[word]
            word, start = word[more], after[more]
        word, start, token = (np.concatenate(x) for x in zip(*found))
        by = np.argsort(start)
        return token[by], word[by]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of two tokens, joined, encode to just these two.

        Merges are undone on the side whose merge came later: at each point of that history, a merge across the border
        that would have come before the next one undone shows that the pair cannot stand.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            across = self.pair_order(a * self.size + b).astype(np.int64)
            across[across < 0] = np.iinfo(np.int64).max
            fails = across < limit
            good[live[fails]] = False
            on = ~fails & ((self.order[a] >= 0) | (self.order[b] >= 0))
            live, a, b, limit = live[on], a[on], b[on], limit[on]
            # the left token's merge, if later, was blocked by none before it; an equal order undoes the right one,
            # since of two equal merges the one to the left is done first
            undo_left = self.order[a] > self.order[b]
            limit = np.where(undo_left, self.order[a], self.order[b] + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """The encoding by its definition: the earliest merge, at its leftmost place, until none applies."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lengths > self.LONG).tolist():
            out[i] = np.array(self._merged_long([self.bytes[b] for b in words[i]]))
        for low, high in ((0, 8), (8, 16), (16, self.LONG)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(rows), 20_000):
                self._merged_short([words[i] for i in rows[at : at + 20_000]], rows[at : at + 20_000], high, out)
        return out

    LONG = 32

    def _merged_short(self, words: list[bytes], rows: np.ndarray, width: int, out: list[np.ndarray]) -> None:
        """One merge of every word at a time, in a table of ``width`` tokens a row, -1 behind the last."""
        never = np.int32(len(self.made))
        n = len(words)
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        count = np.fromiter(map(len, words), np.int64, n)
        parts = np.where(np.arange(width) < count[:, None], np.array(self.bytes)[data], -1)

        def order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            got = self.pair_order(np.where((a >= 0) & (b >= 0), a * self.size + b, self.size * self.size))
            return np.where(got < 0, never, got)

        orders = np.full((n, width), never, np.int32)
        orders[:, :-1] = order(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        column = np.arange(width)
        while len(rows):
            place = orders.argmin(axis=1)
            line = np.arange(len(rows))
            first = orders[line, place]
            ended = first == never
            if ended.any():
                for r, p, c in zip(rows[ended].tolist(), parts[ended], count[ended].tolist()):
                    out[r] = p[:c]
                keep = ~ended
                rows, parts, orders, count, place, first = rows[keep], parts[keep], orders[keep], count[keep], place[keep], first[keep]
                line = line[: len(rows)]
                if not len(rows):
                    break
            parts[line, place] = self.made_at[first]
            # what stands behind the merged pair moves one place to the left
            source = np.minimum(column + (column > place[:, None]), width - 1)
            parts, moved = np.take_along_axis(parts, source, 1), np.take_along_axis(orders, source, 1)
            count = count - 1
            parts[column >= count[:, None]] = -1
            moved[column >= count[:, None] - 1] = never
            before = np.maximum(place - 1, 0)
            behind = np.minimum(place + 1, width - 1)
            moved[line, before] = np.where(place > 0, order(parts[line, before], parts[line, place]), moved[line, before])
            moved[line, place] = np.where(place + 1 < count, order(parts[line, place], parts[line, behind]), never)
            orders = moved

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list, for long words."""
        import heapq

        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (m := self.merges.get((parts[i], parts[j]))) is not None:
                heapq.heappush(queue, (int(self.order[m]), i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = self.merges[a, b], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def learn(self, words: list[bytes]) -> None:
        """Encode words not seen before."""
        if not words:
            return
        flat, owner = self.greedy(words)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, place = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        bad = np.zeros(len(words), bool)
        bad[owner[inner[~self.compatible(pairs // self.size, pairs % self.size)[place]]]] = True
        ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        data, unit = flat.astype(self.width).tobytes(), np.dtype(self.width).itemsize
        start = 0
        for w, end, wrong in zip(words, ends, bad.tolist()):
            if not wrong:
                self.known[w] = data[start * unit : end * unit]
            start = end
        failing = [words[i] for i in np.flatnonzero(bad).tolist()]
        self.exact += len(failing)
        for w, ids in zip(failing, self.merged(failing)):
            self.known[w] = ids.astype(self.width).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > GROUP_CHARS:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        plain: list[str] = []
        plan: list[list[int]] = []  # for each text: place in plain, or -1 - id of an added token
        for text in texts:
            steps: list[int] = []
            for part in self.splitter.split(text) if self.splitter.search(text) else [text]:
                if part in self.added:
                    steps.append(-1 - self.added[part])
                else:
                    steps.append(len(plain))
                    plain.append(part)
            plan.append(steps)
        words = self.words(plain)
        new: set[bytes] = set()
        for w in words:
            new.update(w)
        if len(self.known) > self.remembered:
            self.known = {}
        self.learn([w for w in new if w not in self.known])
        know = self.known.__getitem__
        coded = [b"".join(map(know, w)) for w in words]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        made = [b"".join(coded[s] if s >= 0 else np.array([-1 - s], self.width).tobytes() for s in steps) for steps in plan]
        return [np.frombuffer(m, self.width) for m in made]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", errors="replace")

    def listed(self, ids: np.ndarray) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.numbers.__getitem__, ids.tolist()))


def coder(name: str) -> ByteBpe:
    """The worker's coder for a vocabulary: a path, or a name known to public_tokenizers."""
    if name not in _coders:
        import public_tokenizers

        _coders[name] = ByteBpe(name if os.path.sep in name else public_tokenizers.path(name))
    return _coders[name]


def encode_and_decode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", remembered: int = REMEMBERED) -> DataFrame:
    """Every document's doc_id, n_tokens, ids_sha256, decoded_sha256. A worker remembers so many words."""
    rows = docs.select("doc_id", text_of().alias("text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        bpe.remembered = remembered
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            counts, listed, decoded = [], [], []
            for ids in bpe.encode(batch.column("text").to_pylist()):
                counts.append(len(ids))
                listed.append(digest(bpe.listed(ids)))
                decoded.append(digest(bpe.decode(ids)))
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(code, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Every document's doc_id and its ids, as an array."""
    rows = docs.select("doc_id", text_of().alias("text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for batch in batches:
            ids = pa.array([i.tolist() for i in bpe.encode(batch.column("text").to_pylist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return rows.mapInArrow(code, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(documents(spark, sf_dir))
