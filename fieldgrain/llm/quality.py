"""Quality rules: rule figures per document and a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and pairs of neighbouring words fall into ``buckets`` hash buckets. Two multinomials over the buckets, smoothed,
are counted: one over the documents labelled as good, one over all documents. A document's value is the mean of
log(trusted / raw) over its n-grams. The bound lies where clean text ends: trusted documents that pass the base rules
get a second value from a table without the trusted documents of their own fold, as text that was not counted gets it,
and the ``quantile`` of these values is the bound. Every document below the bound is not kept.

All documents labelled as good are trusted. Their ids meet the texts once, for the counts, in a sort-merge join: that
takes one shuffle of the texts at every size. The scores meet them as short rows. The table of log ratios has ``buckets`` rows. Everything is counted over all documents, and
the bound is the exact quantile. Only DataFrame functions are used.

Defined cases: a null or blank text has no words, zero figures, no value (null), fails the base rule; ids that are null
or repeat are kept as rows of their own; an unlabelled table gives ratio 0 for all; without trusted
documents in two folds, of which one passes the base rules, there is no bound and only the base rules reject; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldgrain.llm.common import documents, let, text_of, words_of, written
from fieldgrain.operators.order_stats import running_totals

#: Fixed value: the symbols that are counted.
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column, window: int) -> Column:
    """Words inside windows of ``window`` words that stand twice or more in the list. ``words``: words or their hashes."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(hashed: Column) -> Column:
        placed = F.array_sort(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            near = lambda x, i, step: F.coalesce(F.get(rows, i + step)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(rows, lambda x, i: near(x, i, -1) | near(x, i, 1)), lambda x: x["i"]))

        def union(starts: Column) -> Column:
            gaps = F.transform(starts, lambda s, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - s, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)

        return let(let(placed, twice), union)

    # most texts have no window twice: only the others are sorted
    rare = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(hashes, rare))


def rule_figures(docs: DataFrame) -> DataFrame:
    """The input with the words and the figures of the base rules."""
    text = text_of()
    symbols = sum((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit(""))) for s in SYMBOLS), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0)
    return (
        docs.withColumn("_words", words_of(text))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", symbols.cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("n_repeat_words", repeated_words(F.col("_hashes"), 8))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def grams(hashes: Column) -> Column:
    """Array of (a, b): a word's hash and the next word's, null after the last."""
    return F.arrays_zip(hashes.alias("a"), F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1))).alias("b"))


def gram_buckets(buckets: int) -> tuple[Column, Column]:
    """Buckets of the word and of the pair (null after the last word), from ``g`` of grams()."""
    one = F.pmod(F.xxhash64("g.a"), F.lit(buckets)).cast("int")
    return one, F.when(F.col("g.b").isNotNull(), F.pmod(F.xxhash64("g.a", "g.b"), F.lit(buckets)).cast("int"))


def word_hashes() -> Column:
    return F.transform(words_of(F.lower(text_of())), lambda w: F.xxhash64(w))


def bucket_counts(docs: DataFrame, keep: list[str], buckets: int) -> DataFrame:
    """``keep`` and ``bucket``: one row per word and per pair of neighbouring words of each document."""
    lists = docs.select(*keep, word_hashes().alias("_h"))
    rows = lists.select(*keep, F.explode(grams(F.col("_h"))).alias("g"))
    one, two = gram_buckets(buckets)
    return rows.select(*keep, F.explode(F.array(one, two)).alias("bucket")).where("bucket is not null")


def fold_of(folds: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int")


def trusted_ids(labels: DataFrame, folds: int) -> DataFrame:
    """doc_id and fold of all documents labelled as good."""
    good = labels.where("quality = 1").select("doc_id").where("doc_id is not null").distinct()
    return good.withColumn("fold", fold_of(folds))


def log_ratios(docs: DataFrame, good: DataFrame, buckets: int, folds: int, smoothing: float = 1.0) -> DataFrame:
    """bucket, ratios: the smoothed log ratio of the trusted to the raw multinomial for every bucket, then those without
    the trusted documents of each fold (null where no others are left)."""
    marked = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left")
    parts = bucket_counts(marked, ["fold"], buckets).groupBy("bucket", "fold").agg(F.count("*").alias("n"))
    of = lambda here: F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0))
    goods = [of(F.col("fold").isNotNull()).alias("good"), *[of(F.col("fold") != k).alias(f"good{k}") for k in range(folds)]]
    names = ["good", *[f"good{k}" for k in range(folds)]]
    counts = parts.groupBy("bucket").agg(F.sum("n").alias("raw"), *goods)
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").na.fill(0)
    sums = full.agg(*[F.sum(c).alias(f"{c}_all") for c in ("raw", *names)])
    share = lambda n: (F.col(n) + smoothing) / (F.col(f"{n}_all") + smoothing * buckets)
    ratio = lambda n, none: F.when(F.col(f"{n}_all") == 0, none).otherwise(F.log(share(n)) - F.log(share("raw")))
    ratios = F.array(ratio("good", F.lit(0.0)), *[ratio(n, F.lit(None).cast("double")) for n in names[1:]])
    return full.crossJoin(F.broadcast(sums)).select("bucket", ratios.alias("ratios"))


def lower_quantile(rows: DataFrame, value: str, quantile: float) -> DataFrame:
    """One row, ``_bound``: the smallest value with at least this share of the values at or below it (null without values)."""
    ranked = running_totals(rows.select(value), [], value, bits=(8, 28))  # coarse cells first: few meet in one task
    return ranked.where(F.col("n_upto") >= F.ceil(F.col("n_total") * quantile)).agg(F.min(value).alias("_bound"))


def quality(docs: DataFrame, labels: DataFrame, buckets: int = 8192, quantile: float = 0.001, folds: int = 5) -> DataFrame:
    """Rule figures, ``ratio`` (mean log ratio) and the verdicts of every document."""
    good = trusted_ids(labels, folds)
    ratios = written(log_ratios(docs, good, buckets, folds), "quality-ratios")
    # a row number that holds for this reading of the table keeps rows with equal ids apart; the sums of a document are
    # made where it is read, and one row per document is shuffled
    figures = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    marked = docs.select("doc_id", "text", fold_of(folds).alias("fold"))
    rows = rule_figures(marked).withColumn("_row", F.monotonically_increasing_id()).withColumn("_h", word_hashes())
    table = ratios.agg(F.sort_array(F.collect_list(F.struct("bucket", "ratios"))).alias("t")).select(F.transform("t", lambda x: x["ratios"]).alias("_ratios"))
    one, two = gram_buckets(buckets)
    each = rows.select("_row", *figures, "fold", F.explode_outer(grams(F.col("_h"))).alias("g")).crossJoin(F.broadcast(table))
    each = each.select("_row", *figures, "fold", F.get("_ratios", one).alias("_one"), F.get("_ratios", two).alias("_two"))
    at = lambda k: F.get("_one", k) + F.when(F.col("_two").isNull(), 0.0).otherwise(F.get("_two", k))
    sums = [F.sum(at(F.lit(0))).alias("total"), F.sum(at(F.col("fold") + 1)).alias("apart")]
    n_grams = 2 * F.col("n_words") - 1
    scored = each.groupBy("_row", *figures).agg(*sums).select(*figures, (F.col("total") / n_grams).alias("ratio"), (F.col("apart") / n_grams).alias("apart"))
    # the scores are read twice, for the bound and for the verdicts
    scored = written(scored, "quality-scores")
    passing = scored.where(~F.col("base_failed")).select("doc_id", "apart")
    bound = lower_quantile(passing.join(good.hint("merge"), "doc_id", "left_semi"), "apart", quantile)
    kept = ~F.col("base_failed") & (F.col("_bound").isNull() | (F.col("ratio") >= F.col("_bound")))
    return scored.crossJoin(F.broadcast(bound)).select(*figures, F.coalesce(kept, F.lit(False)).alias("kept"), "ratio")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
