"""Shards are dealt out range by range, so that not all records are shuffled at once, and none is lost."""

import hashlib
from contextlib import contextmanager
from pathlib import Path

from fieldgrain.llm import training_order


def test_shards_are_dealt_out_in_passes(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"document {i} " * (i % 7) + "é") for i in range(90)], "doc_id long, text string")
    path, seen = tmp_path / "shards", []
    freed = training_order.shuffles_freed

    @contextmanager
    def watched(session):
        with freed(session):
            yield
        seen.append(sorted(int(p.name.split("=")[1]) for p in path.glob("shard=*")))

    monkeypatch.setattr(training_order, "shuffles_freed", watched)
    got = training_order.materialise(docs, str(path), length=16, shard_slots=4).collect()
    parts = -(-len(got) // 4)
    passes = training_order.PASSES
    assert passes > 1 and [len(s) for s in seen] == [min(parts, (n + 1) * -(-parts // passes)) for n in range(passes)]
    assert seen[-1] == list(range(parts))
    for shard in range(parts):
        files = list((path / f"shard={shard}").glob("part-*"))
        rows = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["offset"])
        assert len(files) == 1 and files[0].stat().st_size == 33 * len(rows)
        data = files[0].read_bytes()
        assert [hashlib.sha256(data[r["offset"] : r["offset"] + 32]).hexdigest() for r in rows] == [r["record_sha256"] for r in rows]
