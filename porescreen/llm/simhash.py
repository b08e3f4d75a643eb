"""SimHash near-dedup: fingerprints of word shingles, compared exactly in tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porescreen.llm.common import LOWER, components, text_of
from porescreen.session import cut_lineage

SEED = 42
#: The bits of a fingerprint are counted in three parts: a pair within the radius differs by no more in all three counts.
PARTS = (22, 21, 21)
#: Fingerprints in a tile, about; a parameter of speed and memory alone.
TILE = 1024
#: Shingles of a document whose bits are added at once.
CHUNK = 32768


def fingerprint(text: str, words: int = 4) -> int:
    """SimHash of the word shingles of a text, 0 for a text without words."""
    found = text.encode("utf-8", "replace").translate(LOWER).split()
    if not found:
        return 0
    joined, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    span = min(words, len(found)) - 1
    starts, ends = starts[: len(found) - span].tolist(), ends[span:].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null texts are empty texts."""
    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in text_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _part_counts(fp: Column) -> list[Column]:
    counts, low = [], 0
    for size in PARTS:
        counts.append(F.bit_count(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << size) - 1))))
        low += size
    return counts


def _steps(radius: int) -> list[int]:
    """Differences of the three counts within the radius, half of them, as differences of cell numbers."""
    reach = range(-radius, radius + 1)
    return [x * 10_000 + y * 100 + z for x in reach for y in reach for z in reach
            if abs(x) + abs(y) + abs(z) <= radius and (x, y, z) >= (0, 0, 0)]


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) that connect what the matrix of links connects, at most one per row and column."""
    rows, columns = np.nonzero(near)
    if len(rows) <= sum(near.shape):
        return list(zip(rows.tolist(), columns.tolist()))
    pairs, new_rows = [], near.any(axis=1)
    new_columns = near.any(axis=0)
    while new_rows.any():
        row = int(np.argmax(new_rows))
        new_rows[row] = False
        wave = [row]
        while wave:
            reached = []
            for r in wave:
                for c in np.nonzero(near[r] & new_columns)[0].tolist():
                    new_columns[c] = False
                    pairs.append((r, c))
                    for other in np.nonzero(near[:, c] & new_rows)[0].tolist():
                        new_rows[other] = False
                        pairs.append((other, c))
                        reached.append(other)
            wave = reached
    return pairs


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            ends = []
            sides = []
            for name in ("left", "right"):
                column = batch.column(name)
                sides.append((np.asarray(column.values).view(np.uint64), np.asarray(column.offsets)))
            same = batch.column("same").to_pylist()
            (a, at), (b, bt) = sides
            for i, own in enumerate(same):
                x, y = a[at[i]:at[i + 1]], b[bt[i]:bt[i + 1]]
                near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
                if own:
                    np.fill_diagonal(near, False)
                if near.any():
                    ends += [(x[r], y[c]) for r, c in forest(near)]
            pairs = np.array(ends, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
    return run


def fingerprint_links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` within the radius; they connect whatever such pairs connect.

    Every fingerprint lies in the cell of its three population counts, and a cell in tiles of about ``tile``
    fingerprints. Cells whose counts differ by more than the radius together are never compared. All other tile
    pairs are: each is one row, compared by exclusive or and bit counts, and it gives a spanning forest of its links.
    """
    counts = _part_counts(F.col("fp"))
    cell = (counts[0] * 10_000 + counts[1] * 100 + counts[2]).cast("int")
    placed = fps.select("fp", cell.alias("cell"))
    # 23 x 22 x 22 cells at most, whatever the number of fingerprints.
    sizes = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).alias("tiles")))
    tiles = cut_lineage(placed.join(sizes, "cell").groupBy("cell", F.pmod(F.xxhash64("fp"), "tiles").alias("tile"))
                        .agg(F.collect_list("fp").alias("fps")))
    left = tiles.select("cell", F.col("tile").alias("left_tile"), F.col("fps").alias("left"))
    right = tiles.select(F.explode(F.array(*[F.lit(s) for s in _steps(radius)])).alias("step"), "cell",
                         F.col("tile").alias("right_tile"), F.col("fps").alias("right"))
    right = right.select((F.col("cell") + F.col("step")).alias("cell"), (F.col("step") == 0).alias("own"), "right_tile", "right")
    pairs = left.join(right, "cell").where(~F.col("own") | (F.col("left_tile") <= F.col("right_tile")))
    pairs = pairs.select("left", "right", (F.col("own") & (F.col("left_tile") == F.col("right_tile"))).alias("same"))
    return pairs.mapInArrow(_compare(radius), "a long, b long")


def _grouped(own: DataFrame, links_of) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of (doc_id, fp): its group, and the least id in the group.

    ``links_of`` gives the links (a, b) of a table of distinct fingerprints."""
    distinct = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links_of(distinct.select("fp")))
    rooted = cut_lineage(distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")))
    least = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return cut_lineage(rooted.join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4,
                    radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Null texts are empty; texts without words have fingerprint zero and link like any other. Repeated rows are
    returned as often as they come; rows without an id are returned, but give no component its id (a component of
    such rows alone has a null one). Other columns are ignored. An empty table gives no rows.
    """
    own = cut_lineage(fingerprints(docs, id_column, text_column, words))
    return own.join(_grouped(own, lambda fps: fingerprint_links(fps, radius)).drop("root"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def kept_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4,
                   radius: int = 4) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the least id.

    Repeated rows of that id leave one row. Rows without an id leave when their group has a document with one; of a
    group of such rows alone one text stays, that of the least hash.
    """
    return kept_of_groups(docs, lambda d, i: fingerprints(d, i, text_column, words), lambda fps: fingerprint_links(fps, radius),
                          id_column, text_column)


def kept_of_groups(docs: DataFrame, prints_of, links_of, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``kept_documents`` of any prints: prints_of(docs, id column) gives (doc_id, fp), links_of(fps) links of prints."""
    own = cut_lineage(prints_of(docs, id_column))
    groups = _grouped(own, links_of)
    ids = groups.where("component_id is not null").select(F.col("component_id").alias("__kept")).distinct()
    named = docs.join(ids, F.col(id_column).cast("long") == F.col("__kept"), "left_semi").dropDuplicates([id_column])

    nameless, mark = docs.where(F.col(id_column).isNull()), F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    prints = prints_of(nameless.select(mark.alias("mark"), text_column), "mark")
    alone = groups.where("component_id is null").select("fp", "root")
    marks = prints.join(alone, "fp").groupBy("root").agg(F.min("doc_id").alias("__kept")).select("__kept")
    return named.unionByName(nameless.join(marks, mark == F.col("__kept"), "left_semi").dropDuplicates([text_column]))
