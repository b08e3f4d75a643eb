"""Helpers shared by the operators: table scans, lineage cuts, components of a graph of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from porescreen.session import cut_lineage, written

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(batches, name: str = "text", most: int = 4 << 20):
    """The rows of Arrow batches again, in batches of about ``most`` bytes of a column, so that memory is bounded."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0))
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        if not len(ends):
            yield batch
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def text_of(batch, name: str = "text") -> list[str]:
    """The strings of a column of an Arrow batch; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def gathered_bits(words: DataFrame, size: int) -> np.ndarray:
    """The rows (word, bits) of a filter of ``size`` words of 64 bits, or-ed together on the driver."""
    def pack(batches):
        for batch in batches:
            pairs = np.stack([np.asarray(batch.column(c)) for c in ("word", "bits")], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([pairs.tobytes()], pa.binary())], ["pairs"])

    out = np.zeros(size, np.int64)
    merged = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))  # ``size`` rows at most
    for row in merged.mapInArrow(pack, "pairs binary").collect():
        pairs = np.frombuffer(row["pairs"], np.int64).reshape(-1, 2)
        out[pairs[:, 0]] = pairs[:, 1]
    return out


def cut_round(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for loops over tables of longs.

    Spark keeps what it has inferred of the columns beyond a checkpoint, and this knowledge multiplies in every round;
    it forgets columns that are computed."""
    return cut_lineage(df.select(*[F.col(c).bitwiseXOR(F.lit(0).cast("long")).alias(c) for c in df.columns]))


def laid_out(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows dealt and sorted by ranges of keys and order, so that a group of any size spreads, and one row per
    (partition, group) with ``n``, the rows of the group, and what ``placed`` needs.

    Keys are not null. Columns of a group join to the second table before ``placed``, which spares the rows a join
    on a key that may be hot. Rows that agree in keys and order stay together: order ends in something that differs."""
    laid = cut_lineage(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
                           .withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    parts = laid.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    group = W.partitionBy(*keys)
    before = F.sum("_rows").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    return laid, parts.select(*keys, "_part", F.sum("_rows").over(group).alias("n"),
                              (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))


def placed(laid: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``pos``, their place in the group from 0, and the other columns of ``parts``."""
    return (laid.join(parts, [*keys, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift"))
                .drop("_at", "_part", "_shift"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): one row (node, root) per linked node, root its least member.

    Alternates the large-star and small-star steps: each attaches the neighbours of a node to the least of them,
    so the trees flatten in a logarithmic number of rounds. A round writes its edges to the shared folder, as files that
    the next round reads: only so the estimates of sizes start anew. The minima are checkpointed too, so that the join that spreads them has two plain sides and Spark can split a node
    that has very many links. Null ends and loops are dropped; no links give no rows.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                         .distinct())
    while not _flat(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_round(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # Read twice below, over one exchange, and not written.
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = cut_round(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = written(small.where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _flat(edges: DataFrame) -> bool:
    """Whether every node that has a lesser neighbour has no other one; the edges (a, b), a > b, then are the result.

    It tells the last round as such, so that none is run only to find that nothing changes."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    return ends.groupBy("e.node").agg(F.max("e.up").alias("up"), F.count("*").alias("n")).where("up = 1 and n > 1").isEmpty()
