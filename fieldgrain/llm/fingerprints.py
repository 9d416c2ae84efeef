"""Document fingerprints by consistent weighted sampling.

A document's terms are its words, weighted by how often they stand in it. For sample k and term x, hashes of (x, k)
give r and c from Gamma(2, 1) and b from U(0, 1). With t = floor(ln(weight) / r + b), the term with the smallest
ln(c) - r * (t - b + 1) is the sample, together with its t. Two documents agree in a sample with a probability equal to
the generalised Jaccard similarity of their weights, so the share of equal samples estimates it.

A minimum of one long per sample does this in hash aggregation: the high bits order the candidates, the low bits
identify (term, t). Only DataFrame functions are used.

Defined cases: a null text counts as empty; texts without words get an empty fingerprint, and are alike (1) to each
other, unlike (0) to others; rows with equal ids: the next document is that of the next larger id, of its
texts the one with the smallest hash; a null id comes before all others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fieldgrain.llm.common import WINDOW_BITS, documents, text_of, words_of, written

#: 32 samples give a standard error of at most 0.09.
SAMPLES = 32
#: Samples that one row of the sampling stage computes: few, so that the compiled code stays small.
GROUP = 8
#: Bits of a packed sample that identify the drawn (term, t): four hexadecimal digits of the fingerprint.
NAME_BITS = 16
#: ln values between -64 and 64 are ordered in steps of 2^-39.
STEP = float(1 << 39)


def _packed(seed: Column, log_weight: Column, sample: int) -> Column:
    """The candidate value of one term for one sample, packed into a non-negative long. ``seed``: hash of term and group."""
    one = F.xxhash64(seed, F.lit(sample))
    two = F.xxhash64(one)
    part = lambda h, shift: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1)) + 0.5) / float(1 << 21)
    r = -F.ln(part(one, 0) * part(one, 21))
    c = -F.ln(part(two, 0) * part(two, 21))
    t = F.floor(log_weight / r + part(one, 42))
    value = F.ln(c) - r * (t - part(one, 42) + 1)
    high = F.least(F.greatest(value, F.lit(-63.0)), F.lit(63.0)) + 64.0
    name = (F.shiftrightunsigned(two, 9) + t * 40503).bitwiseAND(F.lit((1 << NAME_BITS) - 1))
    return F.shiftleft((high * STEP).cast("long"), NAME_BITS).bitwiseOR(name)


def term_hashes(text: Column) -> Column:
    """Hashes of a text's terms, repeats included."""
    return F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))


#: Versions of a document for which a term has a weight.
A, B, BOTH, FACT = range(4)


def sampled(weighed: DataFrame, keys: list[str], samples: int = SAMPLES, facts: dict[str, int] | None = None) -> DataFrame:
    """One row per document: ``keys`` and the longs ``a0`` .., ``b0`` .. with the names of four samples each.

    ``weighed`` has ``keys``, ``version``, ``term``, ``log_weight`` and, with ``facts``, ``fact``: a row of version FACT
    brings its term as the document's value of that name. If the rows are dealt out by one of the keys, nothing is
    shuffled.
    """
    facts = facts or {}
    groups = F.when(F.col("version") < FACT, F.array(*[F.lit(g) for g in range(samples // GROUP)])).otherwise(F.array(F.lit(0)))
    fact = ["fact"] if facts else []
    dealt = weighed.select(*keys, "version", *fact, "term", "log_weight", F.explode(groups).alias("g")).withColumn("seed", F.xxhash64("term", "g"))
    drawn = dealt.groupBy(*keys, "version", *fact, "g").agg(F.min("term").alias("term"), *[F.min(_packed(F.col("seed"), F.col("log_weight"), j)).alias(f"s{j}") for j in range(GROUP)])
    has = {"a": F.col("version").isin(A, BOTH), "b": F.col("version").isin(B, BOTH)}
    least = [F.min(F.when(has[v], F.col(f"s{j}"))).alias(f"{v}{j}") for v in "ab" for j in range(GROUP)]
    carried = [F.max(F.when((F.col("version") == FACT) & (F.col("fact") == k), F.col("term"))).alias(n) for n, k in facts.items()]
    joined = drawn.groupBy(*keys, "g").agg(*least, *carried)

    def pack(version: str, first: int) -> Column:
        parts = [F.shiftleft(F.col(f"{version}{first + j}").bitwiseAND(F.lit((1 << NAME_BITS) - 1)), NAME_BITS * (3 - j)) for j in range(4)]
        return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])

    packed = joined.select(*keys, "g", *facts, *[pack(v, 4 * h).alias(f"{v}p{h}") for v in "ab" for h in (0, 1)])
    longs = [F.max(F.when(F.col("g") == g, F.col(f"{v}p{h}"))).alias(f"{v}{2 * g + h}") for v in "ab" for g in range(samples // GROUP) for h in (0, 1)]
    return packed.groupBy(*keys).agg(*longs, *[F.max(n).alias(n) for n in facts])


def spelled(prefix: str, samples: int = SAMPLES) -> Column:
    """The fingerprint, four hexadecimal digits a sample; empty without words."""
    return F.concat(*[F.coalesce(F.lpad(F.lower(F.hex(F.col(f"{prefix}{i}"))), 16, "0"), F.lit("")) for i in range(samples // 4)])


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint of every document that has words; rows with equal ids count as one document."""
    terms = docs.select("doc_id", F.explode(term_hashes(text_of())).alias("term"))
    weighed = terms.groupBy("doc_id", "term").agg(F.log(F.count("*").cast("double")).alias("log_weight"))
    drawn = sampled(weighed.withColumn("version", F.lit(A)), ["doc_id"], samples)
    return drawn.select("doc_id", spelled("a", samples).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    equal = F.aggregate(
        F.sequence(F.lit(0), F.lit(samples - 1)),
        F.lit(0),
        lambda n, k: n + (F.substring(a, k * 4 + 1, F.lit(4)) == F.substring(b, k * 4 + 1, F.lit(4))).cast("int"),
    )
    some = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(some, equal / float(samples)).when((F.length(a) == 0) & (F.length(b) == 0), 1.0).otherwise(0.0)


def neighbours(ids: DataFrame) -> DataFrame:
    """``id`` and ``next`` of the distinct non-null longs in ``ids`` (column ``id``): the next larger, after the last the first.

    No window holds all: ids are cut into blocks of 2^12 values; the last id of a block takes the first of the next
    block that has any, which is found the same way.
    """
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return ids.select("id", F.col("id").alias("next"))

    def following(t: DataFrame, bits: int) -> DataFrame:  # t: key, first
        if bits <= WINDOW_BITS:
            return t.withColumn("next", F.lead("first").over(Window.orderBy("key")))
        t = t.withColumn("block", F.shiftright("key", WINDOW_BITS))
        inside = t.withColumn("next", F.lead("first").over(Window.partitionBy("block").orderBy("key")))
        blocks = t.groupBy("block").agg(F.min("first").alias("first")).withColumnRenamed("block", "key")
        above = following(blocks, bits - WINDOW_BITS).select(F.col("key").alias("block"), F.col("next").alias("above"))
        return inside.join(above, "block").select("key", "first", F.coalesce("next", "above").alias("next"))

    bits = max(1, (int(high) >> 1).bit_length(), (int(low) >> 1).bit_length()) + 2
    found = following(ids.select(F.col("id").alias("key"), F.col("id").alias("first")), bits)
    return found.select(F.col("key").alias("id"), F.coalesce("next", F.lit(int(low))).alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's and its edited text's fingerprint, with their likeness and that to the next document."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_of().alias("text"))
    own = rows.repartition("id")
    links = neighbours(rows.select("id").distinct())
    # the length that a document takes of the next one's text goes there, a prefix comes back
    most = rows.groupBy("id").agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("most"))
    wanted = links.join(most, "id").select(F.col("id").alias("asks"), F.col("next").alias("id"), "most")
    sent = own.join(wanted, "id").select("asks", F.expr("substring(text, 1, most)").alias("prefix"), F.xxhash64("text").alias("next_hash"), F.col("id").alias("next"))
    first = F.row_number().over(Window.partitionBy("asks").orderBy("next_hash"))
    sent = sent.withColumn("r", first).where("r = 1").drop("r")
    # rows get a number that holds within one task, where all that is grouped by it happens
    met = own.join(sent, own["id"] == sent["asks"]).drop("asks").withColumn("row", F.monotonically_increasing_id())
    half = "cast(floor(length(text) / 2) as int)"
    edited = F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(prefix, 1, {half}))")
    texts = met.withColumn("edited", edited)
    digest = F.sha2("edited", 256)
    facts = [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4)]
    facts += [F.length("text").cast("long"), F.col("next"), F.xxhash64("text"), F.col("next_hash")]
    # kinds 0 and 1 are the two texts; facts of the document travel as lists of one term
    lists = [term_hashes(F.col("text")), term_hashes(F.col("edited")), *map(F.array, facts)]
    kinds = texts.select("id", "row", F.posexplode(F.array(*lists)).alias("kind", "terms"))
    terms = kinds.select("id", "row", "kind", F.explode("terms").alias("term"))
    fact, of = F.greatest(F.col("kind"), F.lit(1)), lambda k: F.count(F.when(F.col("kind") == k, 1)).cast("double")
    counted = terms.groupBy("id", "row", fact.alias("fact"), "term").agg(of(0).alias("a"), of(1).alias("b"))
    # a weight shared by both texts is sampled once
    weight = lambda c, version: F.struct(F.log(c).alias("log_weight"), F.lit(version).alias("version"))
    a, b = F.col("a"), F.col("b")
    apart = F.when(b == 0, F.array(weight(a, A))).when(a == 0, F.array(weight(b, B))).otherwise(F.array(weight(a, A), weight(b, B)))
    weights = F.when(F.col("fact") > 1, F.array(weight(F.lit(1.0), FACT))).when(a == b, F.array(weight(a, BOTH))).otherwise(apart)
    weighed = counted.select("id", "row", "fact", "term", F.explode(weights).alias("w")).select("id", "row", "fact", "term", "w.*")
    names = ["d0", "d1", "d2", "d3", "n_chars", "next", "hash", "next_hash"]
    whole = sampled(weighed, ["id", "row"], facts={n: 2 + i for i, n in enumerate(names)})
    sha = F.concat(*[F.lpad(F.lower(F.hex(F.col(f"d{i}"))), 16, "0") for i in range(4)])
    return whole.select("id", "next", "hash", "next_hash", "n_chars", sha.alias("edited_sha256"), spelled("a").alias("fingerprint"), spelled("b").alias("edited_fingerprint"))


#: Stands for a null id, before all others.
NO_ID = -(1 << 63)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    drawn = written(edited_fingerprints(docs), "fingerprints")
    # rows equal in id and text have one fingerprint
    after = drawn.groupBy(F.col("id").alias("next"), F.col("hash").alias("next_hash")).agg(F.max("fingerprint").alias("next_fingerprint"))
    met = drawn.join(after, ["next", "next_hash"])
    return met.select(
        F.when(F.col("id") != NO_ID, F.col("id")).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
