"""License scan: word grams of texts vote for diagonals of templates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from porescreen.llm.common import LOWER, small
from porescreen.session import cut_lineage

# The phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Opening words of public license notices, lower case, without punctuation.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files to deal in the software without restriction": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons": "cc",
    "licensed under cc by": "cc",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A-Z in lower case, and a space for each byte that is in no word; bytes of other characters than ASCII stand in words.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)
#: Share of a notice's grams that a span holds, and words that a copy may have more or less in one place.
SHARE, SLACK = 0.6, 3


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(template, base, label, grams, words, at, gram, h): each pair of neighbouring words of each template."""
    rows = []
    for n, (text, label) in enumerate([*phrases.items(), *notices.items()]):
        words = text.split()
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        rows += [(n, n < len(phrases), label, len(pairs), len(words), i, g) for i, g in enumerate(pairs)]
    kinds = "template int, base boolean, label string, grams int, words int, at int, gram string"
    return spark.createDataFrame(rows, kinds).withColumn("h", F.xxhash64("gram"))


def words_of(text: bytes) -> list[bytes]:
    """The words (``WORD``) of a text in lower case, as UTF-8 bytes."""
    return text.translate(WORD_BYTES).split()


def _template_pairs(known: dict[tuple[bytes, bytes], str]):
    def run(batches):
        for batch in small(batches):
            counts, positions, pairs = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text or b"")
                at = [i for i, pair in enumerate(zip(words, words[1:])) if pair in known]
                counts.append(len(words))
                positions.append(at)
                pairs.append([known[words[i], words[i + 1]] for i in at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"), pa.array(counts, pa.int64()),
                 pa.array(positions, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.string()))],
                ["doc_id", "hash", "n_words", "positions", "pairs"])
    return run


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``.

    Every pair of neighbouring words of every whole text is looked up among the pairs of the templates, and those that
    are there are joined by their hash to the places they have; equal pairs vote for the difference of the two places.
    A phrase stands where all its pairs have voted for one diagonal. A notice is found where neighbouring diagonals,
    merged, hold at least ``share`` of its pairs within one and a half times its length. score is the largest share
    found, 1 for a whole phrase, 0 for nothing.

    Null texts are empty: no words, no labels. Repeated rows and rows without an id are returned like any others;
    other columns are ignored; an empty table gives no rows.
    """
    # What is found in a row follows from its text alone, so rows of one id and one text need not be told apart.
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("hash"),
                       F.col(text_column).cast("binary").alias("text"))
    # A fixed number of template grams, whatever the input.
    known = templates(docs.sparkSession)
    grams = {tuple(r["gram"].encode().split()): r["gram"] for r in known.select("gram").distinct().collect()}
    # Read twice below; without the cut the texts would be split once for each.
    rows = cut_lineage(rows.mapInArrow(_template_pairs(grams), "doc_id long, hash long, n_words long, positions array<int>, pairs array<string>"))
    pairs = rows.select("doc_id", "hash", F.explode(F.arrays_zip("positions", "pairs")).alias("p")) \
        .select("doc_id", "hash", F.col("p.positions").alias("pos"), F.col("p.pairs").alias("pair"))
    votes = pairs.join(F.broadcast(known), (F.xxhash64("pair") == F.col("h")) & (F.col("pair") == F.col("gram")))
    diagonals = votes.groupBy("doc_id", "hash", "template", "base", "label", "grams", "words", (F.col("pos") - F.col("at")).alias("diagonal")) \
        .agg(F.size(F.collect_set("pos")).alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    # Both kinds of template read these few rows; without the cut the texts would be read once for each.
    diagonals = cut_lineage(diagonals)
    whole = diagonals.where(F.col("base") & (F.col("votes") == F.col("grams")))
    places = whole.select("doc_id", "hash", "label", F.lit(1.0).alias("share"), F.lit(True).alias("base"), F.col("diagonal").alias("start"))

    strong = diagonals.where(~F.col("base") & (F.col("votes") >= F.greatest(F.lit(2), F.col("grams") / 10)))
    order = Window.partitionBy("doc_id", "hash", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int")
    merged = strong.withColumn("run", F.sum(F.coalesce(apart, F.lit(0))).over(order)) \
        .groupBy("doc_id", "hash", "template", "label", "grams", "words", "run") \
        .agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("votes").alias("best"))
    # Verified as one span, or else by the best of its diagonals alone.
    fits = F.col("high") - F.col("low") + 2 <= 1.5 * F.col("words")
    found = merged.select("doc_id", "hash", "label", F.least(F.lit(1.0), F.when(fits, F.col("votes")).otherwise(F.col("best")) / F.col("grams"))
                          .alias("share"), F.lit(False).alias("base"),
                          F.lit(None).cast("int").alias("start")).where(F.col("share") >= share)
    result = places.unionByName(found).groupBy("doc_id", "hash").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"),
        F.max("share").alias("score"))
    none = F.array().cast("array<string>")
    result = result.withColumnsRenamed({"doc_id": "at", "hash": "found"})
    same = F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("hash") == F.col("found"))
    return rows.select("doc_id", "hash", "n_words").join(result, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(F.coalesce("base_labels", none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.coalesce("labels", none)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
