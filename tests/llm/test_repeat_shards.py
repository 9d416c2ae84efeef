"""Fragments that share their anchor but no window are not sorted; all others are."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fieldgrain.llm import repeats


def batch_of(rows):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
    names = [*repeats.FRAGMENT, "piece", "owner"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


@pytest.mark.parametrize("length,anchor", [(400, 100), (200, 40), (12, 11), (12, 12)])
def test_only_fragments_that_may_share_a_window_are_sorted(monkeypatch, length, anchor):
    draw = random.Random(length + anchor)
    rest = length - anchor
    rows, at = [], {}
    for key in range(30):
        middle = bytes(draw.choices(range(256), k=anchor))
        around = [(bytes(draw.choices(range(256), k=rest)), bytes(draw.choices(range(256), k=rest))) for _ in range(3)]
        for i in range(6):
            left, right = draw.choice(around)[0], draw.choice(around)[1]
            shared = draw.randint(0, rest)  # bytes left of the anchor that are not this fragment's own
            left = bytes(draw.choices(range(256), k=rest - shared)) + left[rest - shared :]
            offset = draw.randint(0, rest)
            span = draw.randint(0, offset)
            piece = (left + middle + right)[rest - offset : rest - offset + length + span]
            rows.append((key, key * 10 + i, offset, span, piece, i))
            for w in range(span + 1):
                at.setdefault(piece[w : w + length], set()).add(len(rows) - 1)
    want = {(rows[i][1], w) for i in range(len(rows)) for w in range(rows[i][3] + 1) if len(at[rows[i][4][w : w + length]]) > 1}
    sorted_ = []
    sort = repeats.repeated_starts

    def watched(pieces, *args, **kwargs):
        sorted_.extend(pieces)
        return sort(pieces, *args, **kwargs)

    monkeypatch.setattr(repeats, "repeated_starts", watched)
    batches = [batch_of(rows[:50]), batch_of(rows[50:])]
    found = repeats._shards(iter(batches), length, False) if anchor == repeats.ANCHOR else repeats._shards(iter(batches), length, False, anchor)
    got = {(r["fragment"], w) for b in found for r in b.to_pylist() for w in range(r["low"], r["high"] + 1)}
    assert got == want
    assert len({f for f, _ in want}) <= len(sorted_) < len(rows) or anchor == length


def test_anchor_alone_is_not_sorted(monkeypatch):
    monkeypatch.setattr(repeats, "repeated_starts", lambda *a, **k: pytest.fail("nothing is to be sorted"))
    middle = np.random.default_rng(1).bytes(100)
    draw = np.random.default_rng(2)
    rows = [(1, i, 300, 300, draw.bytes(300) + middle + draw.bytes(300), i) for i in range(5)]
    assert list(repeats._shards(iter([batch_of(rows)]), 400, False)) == []
