"""Merkle manifest of a dataset: levels built as parent-linked node rows, leaves checked by a recursive query that climbs them.

A tree has a fan of three. One tree stands over the leaves of each source, one over the roots of the sources. Levels are
built and stored ``HOP`` at a time, so a stored node carries the siblings of its next ``HOP`` ancestors and links to the
one above them; a climb then takes a quarter of the levels in rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porescreen.llm.common import laid_out, placed
from porescreen.session import cut_lineage

FAN, HOP = 3, 4
#: Nodes below one stored link; what a task gathers at most.
BLOCK = FAN ** HOP
#: Copies of a node that stands over many leaves, each met by some of them.
COPIES = 256
#: The tree over the roots of the sources.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


@dataclass(frozen=True)
class Manifest:
    """``leaves``: (leaf_id, doc_id, leaf, subroot); ``starts``: leaves after their first hop; ``nodes``: links above; ``root``."""

    leaves: DataFrame
    starts: DataFrame
    nodes: DataFrame
    root: str | None


def record(values: list[Column]) -> Column:
    """The text that is hashed: `-` for null, else bytes of the value, a colon, the value."""
    parts = [v.cast("string") for v in values]
    return F.concat(*[F.when(p.isNull(), "-").otherwise(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)) for p in parts])


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_rows(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """(leaf_id, doc_id, has, source, leaf, tampered): digests as binary; ``tampered`` is the digest after the tampering.

    Tampering deletes the line ends of texts whose id has an even CRC-32; a row without an id is never tampered with."""
    number, source, *others, text = fields
    values = [F.col(c) for c in (number, source, *others)]
    even = F.crc32(F.col(number).cast("string")) % 2 == 0
    leaf = _digest(record([*values, F.col(text)]))
    changed = even & F.contains(F.col(text), F.lit("\n"))
    return docs.select(
        F.monotonically_increasing_id().alias("leaf_id"), F.col(number).cast("long").alias("doc_id"),
        F.col(source).isNotNull().alias("has"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        leaf.alias("leaf"),
        F.when(changed, _digest(record([*values, F.replace(F.col(text), F.lit("\n"), F.lit(""))]))).otherwise(leaf).alias("tampered"))


def _copies(hop: Column) -> Column:
    """How many copies of a node a hop up there are: as many as there are blocks of leaves below it, at most COPIES."""
    return F.when(hop <= 1, 1).when(hop == 2, BLOCK).otherwise(COPIES)


def _blocks(nodes: DataFrame) -> DataFrame:
    """The nodes of each block with the levels above them: (tree, block, n, kids, levels, n_up)."""
    kids = F.array_sort(F.collect_list(F.struct((F.col("pos") % BLOCK).alias("at"), "hash", "extra")))
    up = lambda level: F.transform(
        F.sequence(F.lit(1), F.size(level), F.lit(FAN)),
        lambda i: _digest(F.array_join(F.transform(F.slice(level, i, F.lit(FAN)), _text), "")))
    n_levels = F.least(F.lit(HOP), sum([(F.col("n") > FAN ** k).cast("int") for k in range(HOP)], F.lit(0)))
    blocks = (nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("n").alias("n"), kids.alias("kids"))
                   .withColumn("n_levels", n_levels))
    grown = F.aggregate(
        F.sequence(F.lit(0), F.col("n_levels")), F.array(F.transform("kids", lambda k: k["hash"])),
        lambda levels, k: F.when(k == 0, levels).otherwise(F.concat(levels, F.array(up(F.element_at(levels, -1))))))
    n_up = F.ceil(F.col("n") / F.pow(F.lit(FAN), F.col("n_levels"))).cast("long")
    return cut_lineage(blocks.withColumn("levels", grown).withColumn("n_up", n_up))


def _siblings() -> Column:
    """For each level below the top of a block, what stands left and right of the ancestor of a node in its run."""
    joined = lambda part: F.aggregate(part, F.lit(b""), lambda a, h: F.concat(a, h))

    def at_level(level, k):
        j = F.floor(F.col("kid.at") / F.pow(F.lit(FAN), k)).cast("int")
        start = j - j % FAN
        return F.struct(
            joined(F.slice(level, start + 1, j - start)).alias("left"),
            joined(F.slice(level, j + 2, F.greatest(F.lit(0), F.least(start + FAN, F.size(level)) - j - 1))).alias("right"))

    return F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), at_level)


def node_rows(blocks: DataFrame, hop: int) -> DataFrame:
    """The stored nodes of a hop: (tree, hop, pos, hash, path, parent_tree, parent_hop, parent_pos, extra).

    ``path`` has the siblings of the node and of its next ancestors; the parent link leads to the ancestor above them, from
    the root of a source to the tree over the sources, and is null at the root of all."""
    last, top = F.col("n_up") == 1, F.col("tree") == TOP
    kids = blocks.select("*", F.explode("kids").alias("kid"))
    return kids.select(
        "tree", F.lit(hop).alias("hop"), (F.col("block") * BLOCK + F.col("kid.at")).alias("pos"), F.col("kid.hash").alias("hash"),
        _siblings().alias("path"),
        F.when(last & top, None).when(last, F.lit(TOP).cast("long")).otherwise(F.col("tree")).alias("parent_tree"),
        F.when(last, 0).otherwise(hop + 1).alias("parent_hop"),
        F.when(last, F.col("tree")).otherwise(F.col("block")).alias("parent_pos"), F.col("kid.extra").alias("extra"))


def _parents(blocks: DataFrame) -> DataFrame:
    return blocks.select("tree", F.col("block").alias("pos"), F.col("n_up").alias("n"),
                         F.element_at(F.element_at("levels", -1), 1).alias("hash"), F.lit(None).cast("long").alias("extra"))


def _tree(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each hop of all trees, and (tree, hash) of the roots."""
    hops, roots, nodes = [], nodes.where("n = 1").select("tree", "hash"), nodes.where("n > 1")
    while most > 1:
        hops.append(_blocks(nodes))
        nodes = _parents(hops[-1])
        roots = roots.unionAll(nodes.where("n = 1").select("tree", "hash"))
        nodes, most = nodes.where("n > 1"), -(-most // BLOCK)
    return hops, roots


def build(leaves: DataFrame) -> Manifest:
    """The trees over rows of ``leaf_rows``; the leaves of a source ascend by id (null first, then by digest).

    Rows that are alike are leaves of their own. An empty table has no root and no nodes."""
    keys = ["has", "source"]
    laid, parts = laid_out(leaves, keys, ["doc_id", "leaf", "leaf_id"])
    sources = parts.groupBy(*keys).agg(F.max("n").alias("_n")).withColumn("_one", F.lit(0))
    trees = placed(*laid_out(sources, ["_one"], keys), ["_one"]).select(*keys, F.col("pos").alias("tree"), F.col("n").alias("n_trees"))
    parts = cut_lineage(parts.join(trees, keys))
    most, n_trees = parts.agg(F.max("n"), F.max("n_trees")).first()
    if most is None:
        none = leaves.sparkSession.createDataFrame(
            [], "tree long, hop int, pos long, hash binary, path array<struct<left binary, right binary>>, parent_tree long, "
                "parent_hop int, parent_pos long, copy long")
        starts = "leaf_id long, tree long, hop int, pos long, block long, folded binary, proof binary"
        return Manifest(leaves.sparkSession.createDataFrame([], "leaf_id long, doc_id long, leaf string, subroot string"),
                        leaves.sparkSession.createDataFrame([], starts), none, None)
    ranked = placed(laid, parts, keys).select(
        "tree", "pos", "n", F.col("leaf").alias("hash"), F.struct("leaf_id", "doc_id", "tampered").alias("extra"))
    ranked = cut_lineage(ranked)
    # A source of one leaf has no levels; the others lose their leaf columns above the first hop.
    alone = ranked.where("n = 1")
    first = _blocks(ranked.where("n > 1"))
    hops, roots = _tree(_parents(first), -(-most // BLOCK))
    subroots = cut_lineage(roots.unionAll(alone.select("tree", "hash")))
    top, whole = _tree(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).alias("n"),
                                       "hash", F.lit(None).cast("long").alias("extra")), n_trees)
    root = whole.first()["hash"].hex()  # one row

    linked = [node_rows(b, k + 1) for k, b in enumerate(hops)] + [node_rows(b, k) for k, b in enumerate(top)]
    link_kinds = ("tree", "hop", "pos", "hash", "path", "parent_tree", "parent_hop", "parent_pos")
    nodes = None
    for k, rows in enumerate(linked):
        copies = _copies(F.when(F.col("tree") == TOP, F.lit(99)).otherwise(F.col("hop")))
        rows = rows.select(*link_kinds, F.explode(F.sequence(F.lit(0).cast("long"), (copies - 1).cast("long"))).alias("copy"))
        nodes = rows if nodes is None else nodes.unionAll(rows)
    if nodes is None:
        nodes = node_rows(first.where("false"), 0).select(*link_kinds, F.lit(0).cast("long").alias("copy"))

    lower = node_rows(first, 0)
    starts = lower.select(
        F.col("extra.leaf_id").alias("leaf_id"), F.col("parent_tree").alias("tree"), F.col("parent_hop").alias("hop"),
        F.col("parent_pos").alias("pos"), F.floor(F.col("pos") / BLOCK).alias("block"),
        folded(F.col("extra.tampered"), F.col("path")).alias("folded"), proof(F.col("path")).alias("proof"))
    starts = starts.unionAll(alone.select(
        F.col("extra.leaf_id"), F.lit(TOP).cast("long"), F.lit(0), F.col("tree"), F.lit(0).cast("long"), F.col("extra.tampered"),
        F.lit(b"")))
    told = first.join(subroots.withColumnRenamed("hash", "subroot"), "tree").select("subroot", F.explode("kids").alias("k"))
    told = told.select(F.col("k.extra.leaf_id").alias("leaf_id"), F.col("k.extra.doc_id").alias("doc_id"),
                       _text(F.col("k.hash")).alias("leaf"), _text(F.col("subroot")).alias("subroot"))
    told = told.unionAll(alone.select("extra.leaf_id", "extra.doc_id", _text(F.col("hash")), _text(F.col("hash"))))
    return Manifest(told, starts, cut_lineage(nodes), root)


def folded(digest: Column, path: Column) -> Column:
    """The digest of the ancestor above ``path``, from that of the node below it."""
    return F.aggregate(path, digest, lambda h, p: _digest(F.concat(_text(p["left"]), _text(h), _text(p["right"]))))


def proof(path: Column) -> Column:
    """The siblings of a path, bottom up, each level left to right."""
    return F.aggregate(path, F.lit(b""), lambda a, p: F.concat(a, p["left"], p["right"]))


CLIMB = """
WITH RECURSIVE climb (leaf_id, depth, tree, hop, pos, block, folded, proof) AS (
    SELECT leaf_id, 0, tree, hop, pos, block, folded, proof FROM {starts}
    UNION ALL
    SELECT c.leaf_id, c.depth + 1, n.parent_tree, n.parent_hop, n.parent_pos, c.block,
           aggregate(n.path, c.folded, (h, p) -> unhex(sha2(CAST(concat(lower(hex(p.left)), lower(hex(h)), lower(hex(p.right))) AS BINARY), 256))),
           aggregate(n.path, X'', (a, p) -> concat(a, p.left, p.right))
    FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.hop = n.hop AND c.pos = n.pos
        AND c.block % CASE WHEN c.tree < 0 OR c.hop > 2 THEN {copies} WHEN c.hop = 2 THEN {fan} ELSE 1 END = n.copy)
SELECT leaf_id, depth, folded, proof FROM climb"""


def climb(built: Manifest) -> DataFrame:
    """(leaf_id, folded, proof) of every leaf: a recursive query takes all leaves a hop up in each round and folds the
    siblings met into its tampered digest; the siblings come out a row per hop and are put in order at the end."""
    spark = built.starts.sparkSession
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # rows are leaves times hops, of which none may be left out
    try:
        hops = cut_lineage(spark.sql(CLIMB.replace("{copies}", str(COPIES)).replace("{fan}", str(BLOCK)), starts=built.starts, nodes=built.nodes))
    finally:
        spark.conf.set(ROW_LIMIT, before)
    siblings = F.array_sort(F.collect_list(F.struct("depth", "proof")))  # one a hop
    return hops.groupBy("leaf_id").agg(
        F.max_by("folded", "depth").alias("folded"),
        F.aggregate(siblings, F.lit(b""), lambda a, s: F.concat(a, s["proof"])).alias("proof"))


def verify(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """One row per document: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof).

    Null fields are hashed as `-`, so they differ from empty ones. A null source is a source of its own, before all others.
    Rows that share an id are leaves of their own, ordered by digest; rows without an id come first and are never tampered
    with. Other columns are ignored; an empty table gives no rows. ``proof`` has the siblings as binary.
    """
    built = build(cut_lineage(leaf_rows(docs, fields)))
    root = F.lit(built.root).cast("string")
    return built.leaves.join(climb(built), "leaf_id").select(
        "doc_id", "leaf", "subroot", root.alias("root"), F.sha2(_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        _text(F.col("folded")).alias("folded_root"), (_text(F.col("folded")) == root).alias("verified"), "proof")
