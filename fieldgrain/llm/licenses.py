"""License scans with a positional index of rare template words.

Templates are the texts of common licence notices. The index holds the positions of each template's words that are
rare among the templates. Every rare word of a file is looked up, and a posting at template position t for a word at
place p votes for the alignment p - t. For an alignment with enough votes, all words of the mandatory key phrase must
stand at their places in the file. The index is a fixed table of a few hundred rows, which is why it may be broadcast.
Only DataFrame functions are used.

Defined cases: a null or empty text has no words, null places and empty labels; ties among words of equal frequency go
by the word; rows with a null or repeated id are told apart by a hash of the text, equal rows get equal results; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldgrain.llm.common import documents, text_of

#: Phrases that give a label wherever they stand.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: What separates words.
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Template name, label, text of the notice, key phrase inside it that must be there.
TEMPLATES = [
    ("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "to deal in the software without restriction"),
    ("mit-line", "mit", "released under the mit license", "under the mit license"),
    ("apache-grant", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-line", "apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-grant", "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license"),
    ("gpl-line", "gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license version"),
    ("lgpl-grant", "lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-line", "agpl", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("bsd-grant", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-notice", "mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc-grant", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "use copy modify and or distribute this software for any purpose"),
    ("cc-by-nc-line", "cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-line", "cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("unlicense", "unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
]
#: Words with fewer letters are common in any text and are not looked up.
RARE_LETTERS = 5


def index_rows() -> list[tuple[str, float, int, int, bool, bool]]:
    """word, idf, template, position, whether rare enough to be looked up, whether of the key phrase."""
    split = [(t[2].split(), t[3].split()) for t in TEMPLATES]
    frequency = Counter(w for words, _ in split for w in set(words))
    rows = []
    for i, (words, key) in enumerate(split):
        start = next(p for p in range(len(words)) if words[p : p + len(key)] == key)
        for p, w in enumerate(words):
            idf = math.log(len(TEMPLATES) / frequency[w])
            rare = frequency[w] <= len(TEMPLATES) // 2 and len(w) >= RARE_LETTERS
            rows.append((w, idf, i, p, rare, start <= p < start + len(key)))
    return rows


def license_words(text: Column) -> Column:
    # lower() also changes letters beyond A-Z; they stay word characters, and no such letter is in a template word
    return F.array_remove(F.split(F.lower(text), BREAKS), "")


def phrase_places(docs: DataFrame) -> DataFrame:
    """The input with n_words, n_base, first_word, last_word and the base labels (an array)."""
    names = "|".join(PHRASES)
    cut = f"(?<= )(?:{names})(?= )"
    rows = docs.withColumn("n_words", F.size(F.array_remove(F.split(text_of(), BREAKS.replace("\\x60", "\\x40\\x5B-\\x60")), "")).cast("long"))
    # a text without the common last word needs no search
    joined = F.concat(F.lit(" "), F.array_join(license_words(text_of()), " "), F.lit(" "))
    some = F.when(F.contains(F.lower(text_of()), F.lit("license")), joined)
    rows = rows.withColumn("_joined", some).withColumn("_pieces", F.split("_joined", cut)).withColumn("_found", F.regexp_extract_all("_joined", F.lit(f"(?<= )({names})(?= )"), 1))
    count = lambda piece: F.size(F.array_remove(F.split(piece, " "), ""))
    last = F.element_at("_found", -1)
    hit = F.size("_found") > 0
    return (
        rows.withColumn("n_base", F.coalesce(F.when(hit, F.size("_found")), F.lit(0)).cast("long"))
        .withColumn("first_word", F.when(hit, count(F.element_at("_pieces", 1))).cast("long"))
        .withColumn("last_word", F.when(hit, F.col("n_words") - count(F.element_at("_pieces", -1)) - count(last)).cast("long"))
        .withColumn("_base", F.when(hit, F.array_sort(F.array_distinct(F.transform("_found", _label)))).otherwise(F.array().cast("array<string>")))
    )


def _label(phrase: Column) -> Column:
    return F.coalesce(*[F.when(phrase == p, F.lit(label)) for p, label in PHRASES.items()])


def alignments(docs: DataFrame, votes: int) -> DataFrame:
    """doc_id, tie and for every accepted template: its number, the best alignment and the share of its idf found."""
    spark = docs.sparkSession
    index = spark.createDataFrame(index_rows(), "word string, idf double, template int, position int, rare boolean, in_key boolean")
    placed = docs.select("doc_id", F.xxhash64("text").alias("tie"), license_words(text_of()).alias("_words"))
    # a text without any rare word gets no vote
    marks = F.array(*[F.lit(w) for w in sorted({r[0] for r in index_rows() if r[4]})])
    placed = placed.where(F.size(F.array_intersect("_words", marks)) > 0)
    row = ["doc_id", "tie"]
    postings = placed.select(*row, F.posexplode("_words").alias("place", "word")).join(F.broadcast(index), "word")
    aligned = postings.groupBy(*row, "template", (F.col("place") - F.col("position")).alias("offset")).agg(
        F.countDistinct("position").alias("words"),
        F.countDistinct(F.when(F.col("rare"), F.col("position"))).alias("votes"),
        F.countDistinct(F.when(F.col("in_key"), F.col("position"))).alias("keys"),
        F.sum("idf").alias("idf"),
    )
    whole = index.groupBy("template").agg(F.sum("idf").alias("all_idf"), F.sum(F.col("in_key").cast("int")).alias("all_keys"), F.sum(F.col("rare").cast("int")).alias("all_rare"))
    good = aligned.join(F.broadcast(whole), "template").where((F.col("votes") >= F.least(F.lit(votes), "all_rare")) & (F.col("keys") == F.col("all_keys")))
    return good.withColumn("share", F.least(F.lit(1.0), F.col("idf") / F.col("all_idf")))


def license_scan(docs: DataFrame, votes: int = 2) -> DataFrame:
    """One row per document: words, base places and labels, all labels, and the best alignment's share as score."""
    names = F.array(*[F.lit(t[1]) for t in TEMPLATES])
    good = alignments(docs, votes).withColumn("label", F.element_at(names, F.col("template") + 1))
    found = good.groupBy("doc_id", "tie").agg(F.collect_set("label").alias("_more"), F.max("share").alias("_share"))
    base = phrase_places(docs.select("doc_id", "text")).withColumn("tie", F.xxhash64("text"))
    base = base.select("doc_id", "tie", "n_words", "n_base", "first_word", "last_word", "_base")
    met = base.join(found, base["doc_id"].eqNullSafe(found["doc_id"]) & (base["tie"] == found["tie"]), "left").select(base["*"], "_more", "_share")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("_share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word"]
    return met.select(*columns, F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
