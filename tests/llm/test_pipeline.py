"""The pipeline's stages on a small table: each decision takes effect, columns stay, the last stage decodes its input."""

import hashlib

import corpus_pipeline


def test_stages(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(90))
    texts = [base, base + " more", None, "12 34", "", *[f"text {i} " + " ".join(f"t{i}x{j}" for j in range(60)) for i in range(30)]]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], str(tmp_path)))
    language, near, cut, mixed, coded = seen[1:]
    assert all(f.columns == docs.columns for f in (language, near, cut, mixed))
    assert {r[0] for r in language.select("doc_id").collect()} == set(range(35)) - {2, 3, 4}
    assert {r[0] for r in near.select("doc_id").collect()} == set(range(35)) - {1, 2, 3, 4}
    texts = sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in mixed.collect())
    assert sorted(r["decoded_sha256"] for r in coded.collect()) == texts


def test_near_copies_with_null_and_repeated_ids(spark):
    """One row of each class stays, also if its ids are null or stand in other classes too."""
    body = lambda k: " ".join(f"v{k}x{j}" for j in range(90))
    groups = [
        [(None, body(0)), (None, body(0) + " more")], [(None, body(1))], [(None, body(2)), (None, body(2))], [(7, body(3))], [(7, body(4))],
        [(5, body(5)), (7, body(5) + " more")], [(None, body(6)), (9, body(6) + " more")], [(8, body(7)), (8, body(7))], [(None, None), (None, "")],
    ]
    rows = [(i, t, "en", None, len(t or "")) for g in groups for i, t in g]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert len(got) == len(groups)
    for g in groups:
        least = min((i for i, _ in g if i is not None), default=None)
        assert sum(row in got and row[0] == least for row in set(g)) == 1


def test_stages_with_clashing_columns_and_written_results(spark, tmp_path):
    """Each stage's result is written before the next one starts, so helper tables go; extra columns stay what they are."""
    extra = ["tie", "spans", "_text", "_row", "_id", "node", "n", "bands", "key", "_whole", "_copy", "part"]
    passage = " ".join(f"p{i}" for i in range(51))
    texts = [f"{i} " + " ".join(f"t{i}x{j}" for j in range(60)) + (f" {passage} end{i}" if i < 4 else "") for i in range(12)]
    rows = [(i, t, "en", f"s{i % 2}", len(t), *[f"{c}{i}" for c in extra]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs.collect()
        assert got
        if k < 4:
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
            assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in extra)
        if k in (2, 3):
            assert not any("p7 p8" in r["text"] for r in got)
            assert k == 3 or {r["doc_id"]: r["text"] for r in got}[9] == texts[9]


def test_empty_table_passes_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
