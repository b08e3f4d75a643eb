"""Benchmark decontamination in DataFrame functions alone: windows as long as an item at shared shingles, exact similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porescreen.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
WORD = r"[\p{L}\p{N}]+"
#: What is made of the items is broadcast up to this size; beyond it Spark joins by shuffle.
BROADCAST_BYTES = 32 << 20


def _words(column):
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(words: str, to: str) -> Column:
    """Expression over every start of a run of five words; none where there are fewer."""
    return F.expr(f"IF(size({words}) < {SHINGLE}, array(), "
                  f"transform(sequence(1, size({words}) - {SHINGLE - 1}), i -> {to.format(f'slice({words}, i, {SHINGLE})')}))")


def _weighted(words: str) -> Column:
    """Shingles with the number of their occurrence, so that sets of them weigh a shingle by its count."""
    text = f"transform(sequence(1, size({words}) - {SHINGLE - 1}), i -> concat_ws(' ', slice({words}, i, {SHINGLE})))"
    return F.expr(f"""IF(size({words}) < {SHINGLE}, array(), aggregate(array({text}), CAST(array() AS ARRAY<STRING>),
        (_, sh) -> transform(sh, (s, i) -> concat(s, ' #', size(filter(slice(sh, 1, i + 1), x -> x = s))))))""")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_words, n) of the items of five words or more; shorter ones can't be told from chance."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("item_words"))
    items = items.where((F.size("item_words") >= SHINGLE) & F.col("item_id").isNotNull()).dropDuplicates(["item_id"])
    return items.withColumn("n", F.size("item_words"))


def _sized(df: DataFrame, row_bytes: Column) -> DataFrame:
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, start_word, n_words, similarity): the best place of each item in each document.

    Wherever a document holds five words of an item in a row, the window that then lines up with the item, of as many
    words as the item, is a candidate; windows without such words have no similarity at all. Every candidate is
    compared with the items that it lines up with and kept if the weighted Jaccard similarity of their shingles,
    counted exactly, is at least 0.8; ties go to the first place.

    Words are runs of letters and digits in lower case. Null and empty texts, and items of fewer than five words or
    without an id, have no leaks. Repeated rows give one result, and of items that share an id one is searched; documents without an id are told apart by the hash of
    their text. Other columns are ignored; empty tables give no rows.
    """
    items = cut_lineage(items_of(benchmark))
    grams = items.select("item_id", "n", F.posexplode(_shingles("item_words", "xxhash64(concat_ws(' ', {}))")).alias("at", "h"))
    grams = cut_lineage(grams)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("text_hash"),
                       _words(F.col(text_column)).alias("words"))
    spots = rows.select("doc_id", "text_hash", "words",
                        F.posexplode(_shingles("words", "xxhash64(concat_ws(' ', {}))")).alias("pos", "h"))
    spots = spots.join(_sized(grams, F.lit(32)), "h").select(
        "doc_id", "text_hash", "item_id", "n", (F.col("pos") - F.col("at")).alias("start"),
        F.expr("slice(words, greatest(pos - at, 0) + 1, n + least(pos - at, 0))").alias("window"))
    windows = spots.groupBy("doc_id", "text_hash", "n", "start").agg(
        F.first("window").alias("window"), F.collect_set("item_id").alias("items"))
    windows = cut_lineage(windows.select("doc_id", "text_hash", "n", "start", "items", _weighted("window").alias("a")))
    met = windows.withColumn("item_id", F.explode("items")).drop("items")
    held = cut_lineage(items.select("item_id", _weighted("item_words").alias("b")))
    sets = met.join(_sized(held, F.octet_length(F.concat_ws(" ", "b")) + 16 * F.size("b")), "item_id")
    judged = sets.withColumn("both", F.size(F.array_intersect("a", "b"))).withColumn(
        "similarity", F.col("both") / (F.size("a") + F.size("b") - F.col("both"))).where(F.col("similarity") >= SIMILARITY)
    best = judged.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("best.back")).cast("long").alias("start_word"),
                       F.col("best.n").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark item; rows without an id are judged by their text."""
    found = leaks(docs, benchmark, id_column, text_column).select(
        F.col("doc_id").alias("__at"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col(id_column).cast("long").eqNullSafe(F.col("__at")) & (F.xxhash64(text_column) == F.col("__hash"))
    return docs.join(found, same, "left_anti")
