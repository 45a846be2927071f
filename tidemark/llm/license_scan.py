"""License scan by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of a text is joined to the positions of equal k-grams in license templates.
A hit at word p of the text and word t of a template votes for diagonal p - t. Votes are gathered by
diagonal, neighbouring diagonals are merged (words inserted or left out), and a merged span stands only
if its verified words cover enough of the template.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Label and text of license phrases and of the opening lines of well-known licenses.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
NOTICES = (
    ("apache-2.0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by", "creative commons attribution"),
    ("cc0", "cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Words a template shorter than LONG needs side by side; longer ones vote with grams of LONG words.
SHORT, LONG = 2, 4
#: Template grams up to which the table is broadcast (about 40 bytes each); a larger one joins by shuffle.
BROADCAST_GRAMS = 200_000


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(template, label, text) rows, numbered in the given order."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(templates)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _positions(words: Column) -> Column:
    """An entry per word with the words after it, and a last one without words."""
    padded = F.concat(words, F.array(F.lit(None).cast("string")))
    return F.arrays_zip(padded.alias("w0"), *[F.slice(padded, i + 1, F.size(padded)).alias(f"w{i}") for i in range(1, LONG)])


def template_grams(templates: DataFrame) -> DataFrame:
    """(template, label, length, k, t_pos, gram, tail): one row per gram; templates of one word are refused by having none."""
    words = templates.select("template", "label", _words(F.col("text")).alias("words")).withColumn("length", F.size("words"))
    every = words.select("template", "label", "length", F.posexplode(_positions(F.col("words"))).alias("t_pos", "w"))
    k = F.when(F.col("length") >= LONG, LONG).otherwise(SHORT)
    return (
        every.where(F.col("t_pos") + k <= F.col("length"))
        .select(
            "template", "label", "length", k.alias("k"), "t_pos", F.xxhash64("w.w0", "w.w1").alias("gram"), F.col("w.w0").alias("t0"), F.col("w.w1").alias("t1"),
            F.when(k == LONG, F.col("w.w2")).alias("t2"), F.when(k == LONG, F.col("w.w3")).alias("t3"),
        )
    )


def license_hits(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Verified gram hits, and one row without template per input row: (doc_id, content, n_words, template, label, length, k, t_pos, pos)."""
    source = docs.select("doc_id", F.xxhash64("text").alias("content"), _words(F.col("text")).alias("words"))
    exploded = source.select("doc_id", "content", F.size("words").alias("n_words"), F.posexplode(_positions(F.col("words"))).alias("pos", "w")).select(
        "doc_id", "content", "n_words", "pos", *[F.col(f"w.w{i}").alias(f"w{i}") for i in range(LONG)]
    )
    grams = template_grams(templates)
    if grams.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    # Equal hashes alone do not count: the words themselves are compared.
    same = (F.xxhash64("w0", "w1") == F.col("gram")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
    same = same & ((F.col("k") == SHORT) | ((F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3"))))
    joined = exploded.join(grams, same, "left").where(F.col("template").isNotNull() | F.col("w0").isNull())
    return joined.select("doc_id", "content", "n_words", "template", "label", "length", "k", "t_pos", F.when(F.col("template").isNotNull(), F.col("pos")).alias("pos"))


def license_spans(hits: DataFrame, drift: int = 3, coverage: float = 0.8) -> DataFrame:
    """Verified spans: (doc_id, content, template, label, length, start, stop, covered).

    A template of at most two grams' words must stand whole and on one diagonal. In longer ones diagonals at most
    ``drift`` apart merge, ``coverage`` of the template's words must be in hits, and the span may be longer or
    shorter than the template by ``drift`` words for each ten.
    """
    key = ["doc_id", "content", "template", "label", "length"]
    votes = hits.where("template IS NOT NULL").dropDuplicates([*key, "t_pos", "pos"]).withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    diagonals = votes.groupBy(*key, "k", "diagonal").agg(
        F.collect_set("t_pos").alias("t_positions"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("k")).alias("stop")
    )
    order = Window.partitionBy(*key).orderBy("diagonal")
    loose = F.col("length") > 2 * LONG
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    fresh = F.when(loose & (step <= drift), 0).otherwise(1)
    grouped = diagonals.withColumn("__fresh", fresh).withColumn("__span", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = grouped.groupBy(*key, "k", "__span").agg(
        F.array_distinct(F.flatten(F.collect_list("t_positions"))).alias("t_positions"), F.min("first").alias("start"), F.max("stop").alias("stop")
    )
    inside = F.array_distinct(F.flatten(F.transform("t_positions", lambda t: F.sequence(t, t + F.col("k") - 1))))
    spans = spans.withColumn("covered", F.size(inside) / F.col("length"))
    near = F.abs(F.col("stop") - F.col("start") - F.col("length")) <= drift * F.ceil(F.col("length") / 10)
    stands = F.when(loose, (F.col("covered") >= coverage) & near).otherwise(F.col("covered") == 1.0)
    return spans.where(stands).select(*key, "start", "stop", "covered")


def license_scan(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, notices: Sequence[tuple[str, str]] = NOTICES, drift: int = 3, coverage: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    ``docs`` needs doc_id and text; other columns are not read. A null or empty text has no words, no places,
    empty labels and score 0. Rows repeated or sharing a doc_id are answered one by one, equal rows alike; a null
    doc_id is a value like others. An empty table gives an empty one. Very long texts are only more rows of one
    scan. ``score`` is the greatest share of a template's words that a span covers.
    """
    templates = template_table(docs.sparkSession, [*base, *notices])
    hits = written(license_hits(docs, templates), "license-hits")
    spans = license_spans(hits, drift, coverage)
    is_base = F.col("template") < len(base)
    label_set = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    found = spans.groupBy("doc_id", "content").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        label_set(F.when(is_base, F.col("label"))).alias("base_labels"),
        label_set(F.col("label")).alias("labels"),
        F.max("covered").alias("score"),
        F.count(F.lit(1)).alias("n_spans"),
    )
    rows = hits.where("template IS NULL").select("doc_id", "content", "n_words")
    both = rows.join(found.withColumnRenamed("doc_id", "__id").withColumnRenamed("content", "__content"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("content") == F.col("__content")), "left")
    return both.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
