"""Prefix trie of conversations, from whole sequences: identical ones collapse into one of some weight, those that are proper
prefixes of others are no leaves, and the weighted prefixes of the rest are aggregated.

A prefix is known by its depth and two 64-bit hashes: the exclusive or of the hashes of its turns with their places. So it is
a running value along a conversation, which is computed in blocks: a conversation may be of any length.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from porescreen.llm.common import laid_out, placed
from porescreen.session import cut_lineage

#: Turns of a conversation, or ids of a group of identical ones, that are gathered at most.
BLOCK = 4096
#: Parts into which the children of a node are dealt to meet it.
PARTS = 1024
#: Turns taken from a group's first conversation are fewer than HEADS; a group has GROUP conversations.
HEADS, GROUP = 9, 5
NODE = ["depth", "p1", "p2"]


def _zero() -> Column:
    return F.lit(0).cast("long")


def _turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, pos, role, text, takes, given) and one row per conversation, (conv_id, n, base, takes, given)."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row_id")).where("conv_id IS NOT NULL")
    laid, parts = laid_out(turns, ["conv_id"], ["turn", "role", "text", "row_id"])
    sizes = parts.groupBy("conv_id").agg(F.max("n").alias("n"))
    takes = F.crc32(F.col("conv_id").cast("string")) % HEADS
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = cut_lineage(
        sizes.withColumn("takes", takes).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
             .join(first, "base", "left").withColumn("given", F.least("takes", F.coalesce("base_n", _zero())))
             .select("conv_id", "n", "base", "takes", "given"))
    rows = placed(laid, parts.join(convs.select("conv_id", "takes", "given"), "conv_id"), ["conv_id"])
    return rows.select("conv_id", "pos", "role", "text", "takes", "given"), convs


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations, (conv_id, depth, role, text) with depth from 1, and one row per conversation, (conv_id, ...).

    A conversation takes up to ``takes`` turns from the first of its group and loses as many of its own."""
    turns, convs = _turns(conversations)
    own = turns.where("pos >= takes").select("conv_id", (F.col("pos") - F.col("takes") + F.col("given") + 1).alias("depth"), "role", "text")
    heads = turns.where((F.col("pos") < HEADS) & (F.col("conv_id") % GROUP == 0)).select(
        F.col("conv_id").alias("base"), "pos", "role", "text")  # a conversation gives HEADS turns to its group at most
    taken = heads.join(convs.select("conv_id", "base", F.col("takes").alias("most")), "base").where("pos < most")
    return own.unionAll(taken.select("conv_id", (F.col("pos") + 1).alias("depth"), "role", "text")), convs


def _hashed(turns: DataFrame) -> DataFrame:
    one, two = F.xxhash64("depth", "role", "text"), F.xxhash64("text", F.lit(1), "role", "depth")
    return cut_lineage(turns.select("conv_id", "depth", F.floor((F.col("depth") - 1) / BLOCK).alias("block"),
                                    one.alias("z1"), two.alias("z2"), F.octet_length("text").cast("long").alias("n_bytes")))


def _blocks(turns: DataFrame) -> DataFrame:
    """One row per block of a conversation, with what stands before it."""
    sums = turns.groupBy("conv_id", "block").agg(F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"),
                                                 F.sum("n_bytes").alias("b"), F.count("*").alias("c"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return cut_lineage(sums.select("*", F.coalesce(F.bit_xor("x1").over(before), _zero()).alias("before1"),
                                   F.coalesce(F.bit_xor("x2").over(before), _zero()).alias("before2"),
                                   F.coalesce(F.sum("b").over(before), _zero()).alias("before_bytes")))


def _end_digests(chunks: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of the joined chunks of each sequence; long lists are read chunk by chunk."""
    short = chunks.where("n <= {}".format(BLOCK)).select(*NODE, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    long = chunks.where("n > {}".format(BLOCK)).repartition(*NODE).sortWithinPartitions(*NODE, "chunk")

    def run(batches):
        now, digest = None, None

        def done():
            return pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], [*now, digest.hexdigest()]))], schema)

        schema = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])
        for batch in batches:
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"])):
                if node != now:
                    if now is not None:
                        yield done()
                    now, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if now is not None:
            yield done()

    return short.unionAll(long.select(*NODE, "ids").mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string"))


def _sequences(convs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rebuilt conversations, (depth, p1, p2, conv_id, weight, total), and the digests of their lists of ids."""
    whole = blocks.groupBy("conv_id").agg(F.sum("c").alias("depth"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"),
                                          F.sum("b").alias("total"))
    filled = convs.select("conv_id").join(whole, "conv_id", "left").na.fill(0)
    # A group of identical conversations is cut into chunks of ids before anything is gathered.
    ranked = placed(*laid_out(filled, NODE, ["conv_id"]), NODE).withColumn("chunk", F.floor(F.col("pos") / BLOCK))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = cut_lineage(ranked.groupBy(*NODE, "chunk").agg(
        ids.alias("ids"), F.min("conv_id").alias("first"), F.max("n").alias("n"), F.max("total").alias("total")))
    found = chunks.groupBy(*NODE).agg(F.min("first").alias("conv_id"), F.max("n").alias("weight"), F.max("total").alias("total"))
    return cut_lineage(found), _end_digests(chunks)


def _spread(sequences: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns of sequences once for each block of their turns, to meet the rows of a long one in many places."""
    last = F.floor((F.greatest(F.col("depth"), F.lit(1)) - 1) / BLOCK)
    return sequences.select("conv_id", F.explode(F.sequence(_zero(), last)).alias("block"), *columns)


def _prefixes(turns: DataFrame, blocks: DataFrame, sequences: DataFrame) -> DataFrame:
    """The prefixes of each distinct sequence: (conv_id, block, node, parent1, parent2, n_bytes, upto, length, weight, total).

    ``upto`` are the bytes of the prefix; the empty prefix is there too."""
    known = _spread(sequences, F.col("depth").alias("length"), "weight", "total")
    starts = known.join(blocks.select("conv_id", "block", "before1", "before2", "before_bytes"), ["conv_id", "block"])
    rows = turns.join(starts, ["conv_id", "block"])
    along = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    p1 = F.bit_xor("z1").over(along).bitwiseXOR(F.col("before1"))
    p2 = F.bit_xor("z2").over(along).bitwiseXOR(F.col("before2"))
    rows = rows.select("conv_id", "block", "depth", p1.alias("p1"), p2.alias("p2"), "z1", "z2", "n_bytes",
                       (F.sum("n_bytes").over(along) + F.col("before_bytes")).alias("upto"), "length", "weight", "total")
    rows = rows.select("conv_id", "block", *NODE, F.col("p1").bitwiseXOR(F.col("z1")).alias("parent1"),
                       F.col("p2").bitwiseXOR(F.col("z2")).alias("parent2"), "n_bytes", "upto", "length", "weight", "total")
    roots = sequences.select("conv_id", _zero(), _zero(), _zero(), _zero(), F.lit(None).cast("long"), F.lit(None).cast("long"), _zero(), _zero(),
                             "depth", "weight", "total")
    return cut_lineage(rows.unionAll(roots))


def _leaf_sums(prefixes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node, n_leaves, under, start): leaves below each node, the bytes that they own, and where its owner's bytes start.

    Of the leaves below a node the one of least id owns it, so every node has one owner and a leaf owns an end of its path."""
    rows = cut_lineage(prefixes.join(_spread(leaves), ["conv_id", "block"]).select("conv_id", "block", *NODE, "n_bytes", "upto"))
    owned = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.min("upto").alias("upto"), F.min("n_bytes").alias("n_bytes"))
    per_leaf = owned.groupBy("conv_id").agg(F.max("upto").alias("stop"), F.min(F.col("upto") - F.col("n_bytes")).alias("start"))
    told = _spread(leaves.join(per_leaf, "conv_id"), "start", (F.col("stop") - F.col("start")).alias("own"))
    return rows.join(told, ["conv_id", "block"]).groupBy(*NODE).agg(
        F.count("*").alias("n_leaves"), F.sum("own").alias("under"), F.min_by("start", "conv_id").alias("start"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, n_bytes).

    Turns stand by number, null first; equal numbers by role and text. A null role or text is empty, rows without a conversation
    are left out, repeated rows are turns of their own. Conversations without turns end at the root. Other columns are ignored;
    an empty table gives no rows.
    """
    turns, convs = rebuilt_turns(conversations)
    turns = _hashed(turns)
    blocks = _blocks(turns)
    sequences, ends = _sequences(convs, blocks)
    prefixes = _prefixes(turns, blocks, sequences)
    nodes = cut_lineage(prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("length").alias("longest"),
        F.min("parent1").alias("parent1"), F.min("parent2").alias("parent2"), F.min("n_bytes").alias("n_bytes"),
        F.min("upto").alias("upto"), F.sum(F.col("weight") * F.col("total")).alias("all_bytes")))
    leaves = cut_lineage(sequences.join(nodes.where("longest > depth").select(*NODE), NODE, "left_anti").select("conv_id", "depth"))

    # Children meet their parent by parts, as a node may have very many.
    parent = [(F.col("depth") - 1).alias("depth"), F.col("parent1").alias("p1"), F.col("parent2").alias("p2"),
              F.pmod("p1", F.lit(PARTS)).alias("part")]
    children = nodes.where("depth > 0").select("conv_id", *[F.col(c).alias(f"own_{c}") for c in NODE], *parent)
    parts = children.groupBy(*NODE, "part").agg(F.count("*").alias("n"))
    counts = parts.groupBy(*NODE).agg(F.sum("n").alias("n_children"))
    met = parts.join(nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id")), NODE).drop("n")
    parents = children.join(met, [*NODE, "part"]).select(*[F.col(f"own_{c}").alias(c) for c in NODE], "parent_conv_id")

    above = F.col("upto") - F.col("n_bytes")
    distinct = F.col("under") - (above - F.col("start"))
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.join(_leaf_sums(prefixes, leaves), NODE).join(counts, NODE, "left").join(parents, NODE, "left").join(ends, NODE, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", _zero()).alias("n_children"), "n_leaves",
                    (F.col("all_bytes") - F.col("n_convs") * above - distinct).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "n_bytes"))
