"""Training-data operators against brute force, libraries and round trips, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fieldgrain.llm import byte_bpe, fingerprints, induced, language, licenses, mixing, near_dups, quality, repeats, token_counts, training_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, node long"
BASE = " ".join(f"w{i}" for i in range(80))
PASSAGE = "".join(random.Random(2).choices("abcdefgh ", k=450))
TEXTS = [
    None, "", "   \n\t", "a", "123 !!", "Released under the MIT License.", BASE, BASE, BASE + " extra", BASE.replace("w3 ", "x3 "),
    "x " + PASSAGE + " y", PASSAGE + " other é words", "é" * 300 + "é" * 300, "aaa " * 500, "line one\nline one\n\nline two", "it's  I'll\r\n日本語 <|endoftext|> <s>",
    "This work is licensed under the GNU General Public License, version 3. MIT license mit license", BASE, "the of and to " * 40, "Der die das und ist nicht " * 9,
]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "b"][i % 4], 7, "w", 1) for i, t in enumerate(TEXTS)]
    return [*out, out[6], (None, BASE, None, "b", 1, "w", 1), (None, None, "en", None, 1, "w", 1), (3, "a second text", "en", "b", 1, "w", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for frame in (
        fingerprints.fingerprint_documents(empty), repeats.remove_repeats(empty), licenses.license_scan(empty), language.language_id(empty),
        quality.quality(empty, labels), byte_bpe.encode_and_decode(empty), token_counts.token_counts(empty), mixing.mix(empty),
        near_dups.near_duplicates(empty), mixing.mixed_texts(empty), repeats.removed_text(empty),
    ):
        assert frame.count() == 0


def test_bpe_equals_the_library(docs, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert Counter(map(tuple, byte_bpe.encode_and_decode(docs).collect())) == Counter(want)


def test_bpe_random_texts():
    library, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), byte_bpe.coder("byte_bpe_50k.json")
    draw = random.Random(4)
    bits = ["'s", "'", "'re", " ", "  ", "\n", "a", "The", "12", "!", "é", "日本", "<|endoftext|>", " ", "🙂", "''t", "\x1c"]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 12))) for _ in range(4000)] + ["a" * 500, "ab" * 300]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in own.encode(texts)] == [x.ids for x in want]


def test_token_counts_equal_the_library(docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 4096) for r in rows]
    assert Counter(map(tuple, token_counts.token_counts(docs).collect())) == Counter(want)


def test_induced_sorting_against_sorting():
    draw = random.Random(3)
    for turn in range(300):
        letters = draw.choice([1, 2, 5])
        body = [draw.randint(1, letters) for _ in range(draw.randint(1, 90))]
        text = (body[: draw.randint(1, 7)] * 60)[: len(body)] + [0] if turn % 3 == 0 else body + [0]
        order, common = induced.suffix_order(np.array(text), 1000, memory=draw.choice([200, 1 << 20]))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        for a, b, n in zip(order, order[1:], common[1:]):
            assert text[a : a + n] == text[b : b + n] and text[a + n] != text[b + n]


@pytest.mark.parametrize("hot", [20_000, 0])
def test_repeats_against_brute_force(docs, rows, hot):
    seen = defaultdict(int)
    texts = [(r[1] or "").encode() for r in rows]
    for t in texts:
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] += 1
    want = Counter()
    for r, t in zip(rows, texts):
        mark = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                mark[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, m in zip(t, mark) if not m)
        runs = len([1 for k, _ in itertools.groupby(mark) if k])
        want[(r[0], len(t), sum(mark), runs, hashlib.sha256(kept).hexdigest())] += 1
    assert repeats.repeated_spans(docs, hot=hot).count() > 0
    assert Counter(map(tuple, repeats.remove_repeats(docs, hot=hot).collect())) == want


@pytest.mark.parametrize("hot", [20_000, 0])
def test_passages_of_other_documents_against_brute_force(spark, hot):
    """Passages of 50 words go wherever they stand in several documents, also with other white space, and only there."""
    draw = random.Random(6)
    fresh = lambda n: [f"{draw.choice('abcdefgh')}{draw.randint(0, 999)}é" for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 60, 140)]
    own = fresh(70)
    texts = [" ".join(own + fresh(3) + own), " ".join(["same"] * 300), "", None, " \n ", "x"]
    for i in range(24):
        words = fresh(draw.randint(0, 30)) + passages[i % 5] + fresh(draw.randint(0, 30))
        texts.append(draw.choice(["", " "]) + draw.choice([" ", "\n", " \t"]).join(words))
    texts += [" ".join(passages[3] + passages[4][:50]), " ".join(fresh(200_000) + passages[2] + fresh(5))]
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, "y", "z", 5, "w", b"b") for i, t in enumerate(texts)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, spans long, hit long, left string, _text string, _id long, _hash string, _bytes binary"
    got = {r["doc_id"]: r for r in repeats.removed_passages(spark.createDataFrame(rows, kind).repartition(3), hot=hot).collect()}
    owners = defaultdict(set)
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            owners[tuple(w[k : k + 50])].add(i)
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - 49) if len(owners[tuple(w[k : k + 50])]) > 1 for j in range(50)}
        assert WORD.findall(got[i]["text"] or "") == [x for k, x in enumerate(w) if k not in gone]
        assert gone or got[i]["text"] == t
        assert tuple(got[i])[5:] == (1, 2, "y", "z", 5, "w", b"b") and got[i]["n_chars"] == len(got[i]["text"] or "")


def test_licence_base_and_labels(docs, rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.license_scan(docs).collect())
    want = Counter()
    for r in rows:
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        want[(r[0], len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))] += 1
    assert got == want


def test_licence_notices_beyond_the_phrases(spark):
    notices = [(i, "some words first. " + t[2].upper() + ". and more after", t[1]) for i, t in enumerate(licenses.TEMPLATES)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in notices] + [(99, "the terms of the work are free and general")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert all(label in got[i]["labels"].split(",") and got[i]["score"] > 0.9 for i, _, label in notices)
    assert got[99]["labels"] == "" and got[99]["score"] == 0


def test_licence_notices_in_one_file(spark):
    """Every notice of a file counts, however many licence words stand around it."""
    texts = [". ".join(t[2] for t in licenses.TEMPLATES)]
    rare = sorted({r[0] for r in licenses.index_rows() if r[4]}, reverse=True)
    assert len(rare) > 24
    texts += [" and ".join(rare) + ". " + t[2] + ". " + " or ".join(rare) for t in licenses.TEMPLATES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert got[0]["labels"] == ",".join(sorted({t[1] for t in licenses.TEMPLATES}))
    assert all(t[1] in got[i + 1]["labels"].split(",") and got[i + 1]["score"] > 0.9 for i, t in enumerate(licenses.TEMPLATES))


def test_quality_figures(spark, docs, rows):
    labels = spark.createDataFrame([(6, 1), (7, 1), (13, 0), (None, 1), (6, 1)], "doc_id long, quality int")
    want = Counter()
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        times, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered.update(range(i, i + 8))
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        want[(r[0], len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed)] += 1
    got = quality.quality(docs, labels).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_quality_ratio_rejects_labelled_bad_texts(spark):
    """Noisy texts pass the base rules and lie above a ratio of -1; the bound of the trusted rows rejects them."""
    draw = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    clean = [" ".join(draw.choices(words, k=draw.randint(30, 90))) for _ in range(300)]
    noisy = [" ".join(w + draw.choice(["", "", "", "", "", "$$$", "&&&"]) for w in draw.choices(words, k=60)) for _ in range(60)]
    rows = list(enumerate(clean + noisy))
    labelled = [(i, int(i < 300)) for i in range(360) if i % 3]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in quality.quality(frame, spark.createDataFrame(labelled, "doc_id long, quality int")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert all(got[i]["kept"] == bool(good) for i, good in labelled)
    assert not any(got[i]["kept"] for i in range(300, 360)) and all(got[i]["ratio"] > -1 for i in range(300, 360))
    assert sum(got[i]["kept"] for i in range(300)) >= 290
    bare = quality.quality(frame, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert all(r["kept"] and r["ratio"] == 0 for r in bare)


def test_mixing_targets_and_limits(docs, rows):
    got = mixing.mix(docs, block_words=4).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, itertools.cycle((5, 2, 1))))
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += share * weight[s]
        left = sum(max(0, target[s] - 2 * sizes[s]) for s in open_)
        full = {s for s in open_ if target[s] >= 2 * sizes[s]}
        for s in full:
            target[s] = 2 * sizes[s]
        open_ -= full
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(sizes[s], round(target[s], 6)) for s in order}
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5), block_words=4).collect()), key=repr)
    mixed = mixing.mixed_texts(docs, block_words=4)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_near_duplicate_classes(docs, rows):
    got = near_dups.near_duplicates(docs).collect()
    texts = [r[1] or "" for r in rows]

    def parts(text):
        words = WORD.findall(text)
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {text}

    sets, owner = [parts(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            owner = [owner[i] if o == owner[j] else o for o in owner]
    groups = defaultdict(list)
    for o, r in zip(owner, rows):
        groups[o].append(r[0])
    want = Counter()
    for ids in groups.values():
        name = min((i for i in ids if i is not None), default=None)
        want.update((i, name) for i in ids)
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == want


def test_probability_jaccard_estimate():
    draw = random.Random(1)
    base = [f"t{draw.random()}" for _ in range(400)]
    texts = [" ".join(base).encode(), " ".join(base[:360] + [f"u{i}" for i in range(40)]).encode()]
    owner, value = near_dups.shingles(texts)
    slots = near_dups.signatures(owner, value, np.ones(len(owner)), 2, 2048)
    a, b = set(value[owner == 0].tolist()), set(value[owner == 1].tolist())
    assert abs((slots[0] == slots[1]).mean() - len(a & b) / len(a | b)) < 0.05


def test_fingerprints(docs, rows):
    got = fingerprints.fingerprint_documents(docs).collect()
    assert len(got) == len(rows)
    by_text = defaultdict(set)
    lists = defaultdict(list)
    for r in rows:
        lists[-1 if r[0] is None else r[0]].append(r[1] or "")
    ids = sorted(lists)
    for r in got:
        key = -1 if r["doc_id"] is None else r["doc_id"]
        following = lists[ids[(ids.index(key) + 1) % len(ids)]]
        want = {(sha(t[: len(t) - len(t) // 2] + n[: len(t) // 2]), len(t)) for t in lists[key] for n in following}
        assert (r["edited_sha256"], r["n_chars"]) in want
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(lists[key]) == 1:
            by_text[lists[key][0]].add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def test_fingerprint_likeness_is_generalised_jaccard(spark):
    a, b = [f"w{i % 70}" for i in range(200)], [f"w{i % 90}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs, samples=512).collect()}
    equal = np.mean([prints[1][4 * k : 4 * k + 4] == prints[2][4 * k : 4 * k + 4] for k in range(512)])
    x, y = Counter(a), Counter(b)
    assert abs(equal - sum((x & y).values()) / sum((x | y).values())) < 0.08


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_language_unknown(docs, rows):
    got = Counter((r["doc_id"], r["lang_pred"] == "und") for r in language.language_id(docs).collect())
    assert got == Counter((r[0], not any(map(str.isalpha, r[1] or ""))) for r in rows)


def test_training_order_round_trip(spark, docs, rows, tmp_path):
    path = str(tmp_path / "shards")
    got = training_order.materialise(docs, path, length=16, shard_slots=8).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert all(r["shard"] == r["slot"] // 8 and r["offset"] == r["slot"] % 8 * 33 for r in got)
    read = {r["slot"]: r["ids"] for r in training_order.read_from(spark, path, 10, length=16, shard_slots=8).collect()}
    assert sorted(read) == list(range(10, len(got)))
    for r in got:
        if r["slot"] >= 10:
            data = np.array(read[r["slot"]], "<u2")
            assert hashlib.sha256(data.tobytes()).hexdigest() == r["record_sha256"] and not data[r["n_tokens"] :].any()


def test_training_order_numbers_sequences_by_id(spark, docs, empty, tmp_path):
    got = training_order.materialise(docs.where("doc_id is not null").repartition(7), str(tmp_path / "shards"), length=16, shard_slots=8).collect()
    index = {int(s): i for i, s in enumerate(training_order.feistel(np.arange(len(got)), len(got), 11))}
    numbered = [(r["doc_id"], r["part"]) for r in sorted(got, key=lambda r: index[r["slot"]])]
    assert [d for d, _ in numbered] == sorted(d for d, _ in numbered)
    assert all(p == 0 or numbered[i - 1] == (d, p - 1) for i, (d, p) in enumerate(numbered))
    assert training_order.materialise(empty, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_feistel_is_a_permutation(n):
    assert sorted(training_order.feistel(np.arange(n), n, 5).tolist()) == list(range(n))


def test_prefix_pairs_lose_no_similar_pair(spark):
    """Variants of one original, two to a part: every similar pair is met, pairs of one part are not."""
    rng = np.random.default_rng(3)
    sets = []
    for i in range(80):
        lost = rng.choice(60, rng.integers(0, 14), replace=False)
        sets.append(sorted((set(range(60)) - set(lost.tolist())) | set(rng.integers(60, 90, rng.integers(0, 10)).tolist())))
    rows = spark.createDataFrame([(i, bytearray(np.array(x, np.uint32).tobytes())) for i, x in enumerate(sets)], "node long, shingles binary")
    nodes = spark.createDataFrame([(i, i // 2) for i in range(80)], "node long, part long")
    got = {(r.a, r.b) for r in near_dups.prefix_pairs(nodes, rows, 0.8).collect()}
    alike = lambda x, y: len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if a // 2 != b // 2 and alike(sets[a], sets[b])}
    assert want and want <= got and all(a // 2 != b // 2 for a, b in got)


def test_quality_trusts_all_labelled_documents(spark):
    labels = spark.range(250_000).selectExpr("id AS doc_id", "1 AS quality")
    found = quality.trusted_ids(labels, folds=5)
    assert found.count() == 250_000 and {r["fold"] for r in found.select("fold").distinct().collect()} == set(range(5))
    values = spark.range(3001).selectExpr("CAST(id AS double) / 7 AS v")
    assert quality.lower_quantile(values, "v", 0.001).first()[0] == pytest.approx(3 / 7)
    assert quality.lower_quantile(values.limit(1), "v", 0.001).first()[0] is not None
    assert quality.lower_quantile(values.limit(0), "v", 0.001).first()[0] is None
