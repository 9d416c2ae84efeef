"""Toxicity, Merkle manifest and source divergence against brute force and held-out labels, with the defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldgrain.llm import divergence, merkle, toxicity
from fieldgrain.llm.common import numbered

#: Columns whose names the operators use inside.
CLASHES = "pos long, n long, grp string, leaf string, path string, block long, term string, count long, at long, total long, v long, positive int, features string, shard long, _at long, _part long, _n long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
EXTRA = tuple("x" if part.split()[1] == "string" else 7 for part in CLASHES.split(", "))


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in every column, repeated rows and ids, line feeds, a very long text, a hot source."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abCdé", k=draw.randint(1, 2)))
    text = lambda n: "".join(word() + draw.choice([" ", "\n", "1", "–"]) for _ in range(n))
    rows = [(i, text(draw.randint(0, 40)), draw.choice(["en", "de", None, ""]), draw.choice(["a", "a", "b", "é", None, "Z"]), draw.choice([None, 5])) for i in range(260)]
    rows += [(1000 + i, text(6), "en", "hot", i) for i in range(90)]
    rows += [(None, "x\ny", "en", "a", 3), (None, "x\ny", "en", "a", 3), (None, None, None, None, None), (-5, "neg\native", "en", "a", 1), (7, "same id", "en", "a", 1), rows[3], rows[3]]
    return [*rows, (5000, text(120_000), "en", "a", 1), (5001, "only\none", "fr", "single", 8), (5002, None, "en", "bare", 0), (5003, "", "xx", "p", 0), (5004, "", "xx", "q", 0), (5005, "", "xx", None, 0)]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest_by_hand(rows):
    leaf = lambda r, text: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def way(levels, i):
        for row in levels[:-1]:
            first = i - i % 3
            yield "".join(row[first:i]), "".join(row[i + 1 : first + 3])
            i //= 3

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = [tree([leaf(r, r[1]) for r in groups[s]]) for s in names]
    top = tree([t[-1][0] for t in trees])
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*way(trees[k], i), *way(top, k)]
            tampered = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[1].replace("\n", "") if tampered else r[1])
            for left, right in path:
                node = h(left + node + right)
            yield r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in path)), node, node == top[-1][0]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_merkle_against_brute_force(spark, odd_rows, height):
    got = Counter(map(tuple, merkle.audit(table(spark, odd_rows), height).collect()))
    assert got == Counter(manifest_by_hand(odd_rows))
    assert {k[-1] for k in got} == {True, False}


@pytest.mark.parametrize("levels", range(1, 8))
def test_addresses_are_a_layout(levels):
    """Every node has a place of its own; the upper half stands first and each lower subtree is one stretch."""
    at = merkle.addresses(levels)
    assert [len(a) for a in at] == [3**d for d in range(levels)]
    assert sorted(np.concatenate(at).tolist()) == list(range((3**levels - 1) // 2))
    if levels > 1:
        top = levels // 2
        assert max(a.max() for a in at[:top]) == (3**top - 1) // 2 - 1
        for i in range(3**top):
            places = np.concatenate([at[top + d][i * 3**d : (i + 1) * 3**d] for d in range(levels - top)])
            assert np.ptp(places) == len(places) - 1


def test_stored_blocks_hold_the_tree(spark, odd_rows):
    rows, blocks = merkle.manifest(table(spark, odd_rows), 2)
    stored = {(b["grp"], b["top"], b["tier"], b["block"]): b for b in blocks.collect()}
    root = rows.select("root").distinct().collect()
    assert len(root) == 1 and any(b["top"] and b["root"] == root[0][0] for b in stored.values())
    assert all(bytes(b["nodes"][:32]) == bytes(b["root"]) for b in stored.values())  # a block's root stands first
    for r in rows.where("source = 'hot'").collect():
        nodes = np.frombuffer(stored["hot", False, 0, r["pos"] // 9]["nodes"], np.uint8).reshape(-1, 32)
        assert nodes[merkle.addresses(3)[2][r["pos"] % 9]].tobytes() == bytes(r["leaf"])


def test_numbered_ranks_rows_of_hot_and_null_groups(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.choice([None, *range(40)])) for _ in range(500)]
    got = numbered(spark.createDataFrame(rows, "g string, k long").repartition(5), ["g"], ["k"], "place", "places").collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(len(mine))) and {r["n"] for r in mine} == {len(mine)}
        keys = [(r["k"] is not None, r["k"] or 0) for r in mine]
        assert keys == sorted(keys)


def divergence_by_hand(rows):
    word = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}
    counts, found, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        words = [w.translate(lower) for w in word.findall(text or "")]
        counts[lang or "", source or ""].update(words)
        found[lang or ""].update(set(words))
        sources[lang or ""].add(source or "")
    for lang, names in sources.items():
        kept = [t for t, n in found[lang].items() if n >= 30]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(sum((counts[lang, s] for s in names), Counter()))
        p = {s: shares(counts[lang, s]) for s in names}
        for s in names:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in names if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:50]
            for part, found_ in (("pair", pairs), ("term", terms)):
                yield from ((lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found_))


@pytest.mark.parametrize("blocks", [(128, 32), (3, 2)])
def test_divergence_against_brute_force(spark, odd_rows, blocks):
    want = Counter(divergence_by_hand(odd_rows))
    assert Counter(map(tuple, divergence.divergence(table(spark, odd_rows), *blocks).collect())) == want
    assert {("xx", "p", "pair", "q", 0, 2), ("xx", "p", "pair", "", 0, 1)} <= set(want)


def test_divergence_with_sums_that_overflow_memory(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    rows = odd_rows[:200]
    assert Counter(map(tuple, divergence.divergence(table(spark, rows)).collect())) == Counter(divergence_by_hand(rows))


def test_prices_of_indicator_products():
    draw = np.random.default_rng(3)
    one, other = draw.integers(0, 6, (40, 4)), draw.integers(0, 9, (40, 3)) * 10**9
    want = np.abs(one[:, :, None] - other[:, None, :]).sum(0)
    assert (divergence.one_hot_price(one, other) == want).all()


def test_share_is_exact(spark):
    cases = [(0, 0, 1), (10**12, 3 * 10**12, 10**6), (7, 9, 2), (2**40, 2**41, 3), (1, 10**15, 10**7)]
    got = spark.createDataFrame(cases, "c long, total long, v long").select(divergence.share(divergence.F.col("c")).alias("p"))
    assert [r["p"] for r in got.collect()] == [1 + 10**9 * (c + 5) // (t + 5 * v) for c, t, v in cases]


def toxic_table(n, seed=4):
    """Clean texts of made-up words; toxic ones have one to five words of a small set, some with endings of their own."""
    draw = random.Random(seed)
    clean = ["".join(draw.choices("bdfgklmnprst", k=2)) + draw.choice("aeiou") + "".join(draw.choices("bdfgklmnprst", k=2)) for _ in range(900)]
    bad = ["idiot", "scum", "vermin", "wretch"]
    rows, labels = [], []
    for i in range(n):
        words = draw.choices(clean, k=draw.randint(5, 80))
        toxic = int(draw.random() < 0.15)
        for _ in range(toxic * draw.randint(1, 5)):
            words.insert(draw.randint(0, len(words)), draw.choice(bad) + draw.choice(["", "", "en", "s"]))
        rows.append((i, " ".join(words), "en", "s", len(words)))
        if draw.random() < 0.5:
            labels.append((i, 1, toxic))
    return rows, labels, bad


def test_toxicity_on_held_out_labels(spark):
    rows, labels, bad = toxic_table(3000)
    rows += [(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, " ".join(["kalem"] * 200_000) + " scum", "en", "s", 0), (5, "a second text", "en", "s", 1)]
    label_table = spark.createDataFrame([*labels, (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark, rows), label_table, shard_docs=1000).collect()
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] for r in held if truth[r["doc_id"]] == 1]) >= 0.95
    assert np.mean([1 - r["predicted"] for r in held if truth[r["doc_id"]] == 0]) >= 0.98
    scores = {r["doc_id"]: r["score"] for r in got}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert scores[None] == scores[9001] < 0.5 <= scores[9002]


def test_toxicity_reads_no_held_out_label_and_no_clean_label(spark):
    """Labels 0 count for the prior alone, labels of held-out rows for nothing."""
    rows, labels, _ = toxic_table(600)
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    kind = "doc_id long, quality int, toxic int"
    scores = [
        {r["doc_id"]: r["score"] for r in toxicity.toxicity(table(spark, rows, 2), spark.createDataFrame(l, kind)).collect()} for l in (labels, turned)
    ]
    assert scores[0] == scores[1]


def test_non_negative_risk_does_not_fall_below_zero():
    """With every unlabelled row like a positive the plain risk would go to minus infinity; the model stays finite."""
    positives = toxicity.Rows([np.array([0])] * 20, 2)
    model = toxicity.nn_pu(positives, toxicity.Rows([np.array([0])] * 20 + [np.array([1])] * 80, 2), 0.6)
    assert np.isfinite(model).all() and np.abs(model).max() < 60


def test_without_positives_and_on_empty_tables(spark, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    clean = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    missing = spark.createDataFrame([(777777, 1, 1)], "doc_id long, quality int, toxic int")
    docs, empty = table(spark, odd_rows[:20]), table(spark, [])
    for labels in (none, clean, missing):
        assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(docs, labels).collect()} == {(0.0, 0)}
        assert toxicity.toxicity(empty, labels).count() == 0
    assert merkle.audit(empty).count() == divergence.divergence(empty).count() == 0
