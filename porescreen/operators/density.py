"""Partition of cells by density: boxes with about equally many atoms, and the images that each box has to meet."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from porescreen.functions import lattice as lat
from porescreen.functions.numbers import norm3
from porescreen.session import cut_lineage

#: Places along each axis at which a cell can be split; a framework has at most the cube of it in counts.
RESOLUTION = 64
#: Levels of the binary tree that one join descends.
LEVELS = 3

FRACTIONS = ("fx", "fy", "fz")
VECTORS = ("a", "b", "c")
LOW, HIGH = [f"lo_{v}" for v in VECTORS], [f"hi_{v}" for v in VECTORS]
BOX = [*LOW, *HIGH]
HEIGHTS = [f"h_{v}" for v in VECTORS]
_CORNERS = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], float)


def _reach(low: np.ndarray, high: np.ndarray, at: np.ndarray, cell: np.ndarray, slack: float) -> float:
    """The distance within which every point of a box has an atom: least over its atoms of the farthest corner."""
    if not len(at):
        return float("inf")
    corners = np.where(_CORNERS == 1, high, low) @ cell
    far = np.linalg.norm((at @ cell)[:, None, :] - corners[None, :, :], axis=2).max(axis=1)
    return float(far.min()) + slack


def _grow(counts: pd.DataFrame, leaf_atoms: int, resolution: int, grid_n: int | None = None) -> pd.DataFrame:
    """The tree of one framework from its counts by place (x, y, z, n); a framework without counts is one box.

    With ``grid_n``, boxes without the centre of a voxel are left out; a box with one always has a part with one."""
    cell = counts[lat.CELL].iloc[0].to_numpy(float).reshape(3, 3)
    height = abs(np.linalg.det(cell)) / np.array([np.linalg.norm(np.cross(cell[(v + 1) % 3], cell[(v + 2) % 3])) for v in range(3)])
    counts = counts[counts["n"].notna()]
    place, n = counts[["x", "y", "z"]].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    # An atom lies within half the diagonal of its place from the centre of it.
    slack = np.linalg.norm((_CORNERS - 0.5) @ cell, axis=1).max() / resolution
    nodes, todo = [], [(-1, 0, np.zeros(3, np.int64), np.full(3, resolution, np.int64), np.arange(len(n)))]
    while todo:
        parent, depth, low, high, rows = todo.pop()
        if grid_n and (np.ceil(low / resolution * grid_n - 0.5) > np.ceil(high / resolution * grid_n - 0.5) - 1).any():
            continue
        at = len(nodes)
        spread = np.array([place[rows, v].max() - place[rows, v].min() for v in range(3)]) if len(rows) else np.zeros(3)
        leaf = n[rows].sum() <= leaf_atoms or not spread.any()
        reach = _reach(low / resolution, high / resolution, (place[rows] + 0.5) / resolution, cell, slack) if leaf else 0.0
        nodes.append([at, parent, depth, leaf, reach, *(low / resolution), *(high / resolution)])
        if leaf:
            continue
        v = int(np.argmax(np.where(spread > 0, (high - low) * height, -1.0)))
        sums = np.bincount(place[rows, v] - low[v], n[rows], high[v] - low[v]).cumsum()
        # The split that comes nearest to halves, with atoms on both sides.
        inside = np.nonzero((sums > 0) & (sums < sums[-1]))[0]
        cut = low[v] + 1 + int(inside[np.argmin(np.abs(2 * sums[inside] - sums[-1]))])
        left = place[rows, v] < cut
        for side, keep in ((0, left), (1, ~left)):
            lo, hi = low.copy(), high.copy()
            (hi if side == 0 else lo)[v] = cut
            todo.append((at, depth + 1, lo, hi, rows[keep]))
    for at in range(len(nodes) - 1, 0, -1):  # a node reaches as far as any leaf below it
        up = nodes[nodes[at][1]]
        up[4] = max(up[4], nodes[at][4])
    kept = []
    for at, parent, depth, leaf, reach, *box in nodes:
        if depth % LEVELS and not leaf:
            continue
        while parent >= 0 and nodes[parent][2] % LEVELS:
            parent = nodes[parent][1]
        kept.append([at, parent, -(-depth // LEVELS), bool(leaf), reach, *box])
    out = pd.DataFrame(kept, columns=["node", "parent", "level", "leaf", "reach", *BOX])
    return out.assign(square=not cell[~np.eye(3, dtype=bool)].any(), **dict(zip(HEIGHTS, height)))


def density_tree(images: DataFrame, cells: DataFrame, leaf_atoms: int = 1, resolution: int = RESOLUTION,
                 grid_n: int | None = None) -> DataFrame:
    """A k-d tree per framework: (framework, node, parent, level, leaf, reach, lo_a .. hi_c), boxes in fractions
    of the cell, and the plane distances h_a .. h_c of the cell and whether its angles are right.

    Boxes are split along their longest side where the counts of atoms come nearest to halves.  The leaves tile the cell and
    have at most ``leaf_atoms`` atoms each, more only where atoms share a place of the resolution.  Every point of a leaf has
    an atom within ``reach``; an inner node has the largest reach below it.  A task gets the counts by place of a framework,
    which are bounded however many atoms there are.  A cell without atoms is one leaf of unlimited reach.
    With ``grid_n`` only boxes that hold the centre of a voxel of that grid are in the tree, so it is bounded by the grid.
    """
    inside = images
    for f in FRACTIONS:
        inside = inside.filter((F.col(f) >= 0) & (F.col(f) < 1))
    place = [F.least(F.floor(F.col(f) * resolution), F.lit(resolution - 1)).alias(x) for f, x in zip(FRACTIONS, "xyz")]
    counts = inside.groupBy("framework", *place).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.select("framework", *lat.CELL).join(counts, "framework", "left")

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        return _grow(part, leaf_atoms, resolution, grid_n).assign(framework=part["framework"].iloc[0])

    kinds = "node long, parent long, level int, leaf boolean, reach double, " + ", ".join(f"{c} double" for c in [*BOX, *HEIGHTS]) + ", square boolean"
    return rows.groupBy("framework").applyInPandas(grow, f"framework {cells.schema['framework'].dataType.simpleString()}, {kinds}")


def box_distance() -> Column:
    """At most the distance of (fx, fy, fz) from the box, exact in a cell of right angles."""
    gaps = [F.greatest(F.col(lo) - F.col(f), F.col(f) - F.col(hi), F.lit(0.0)) * F.col(h)
            for f, lo, hi, h in zip(FRACTIONS, LOW, HIGH, HEIGHTS)]
    return F.when(F.col("square"), norm3(*gaps)).otherwise(F.greatest(*gaps))


def least_parts(df: DataFrame) -> int:
    """Parts that keep all cores busy."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def leaf_images(images: DataFrame, tree: DataFrame, carried: list[str]) -> DataFrame:
    """The images that may be nearest to a point of a leaf: the leaves (framework, node, box) with the fractions and ``carried``.

    Images descend from the root, three binary levels a join, and leave where the box is farther than its reach.  Every
    leaf has a row; one that no image reaches has null fractions."""
    near = box_distance() <= F.col("reach") * (1 + 1e-9)
    nodes = tree.select("framework", "node", "parent", "leaf", "reach", *BOX, *HEIGHTS, "square")
    rows = images.select("framework", *FRACTIONS, *carried).join(nodes.filter("parent < 0").drop("parent"), "framework").filter(near)
    # That join deals by framework; the images of one large cell descend in all tasks.
    rows = rows.repartition(least_parts(images), "framework", *FRACTIONS)
    # A leaf above the lowest level is its own child.
    below = nodes.unionByName(nodes.filter("leaf").withColumn("parent", F.col("node")))
    depth = tree.agg(F.max("level")).first()[0] or 0
    for _ in range(depth):
        at = rows.select("framework", *FRACTIONS, *carried, F.col("node").alias("parent"))
        rows = at.join(below, ["framework", "parent"]).filter(near)
    held = rows.select("framework", "node", *BOX, *FRACTIONS, *carried)
    bare = tree.filter("leaf").select("framework", "node", *BOX)
    return held.unionByName(bare, allowMissingColumns=True)


def nearest_images(images: DataFrame, cells: DataFrame, grid_n: int, carried: list[str], leaf_atoms: int = 1,
                   resolution: int = RESOLUTION, slab_voxels: int = 1 << 15) -> DataFrame:
    """(framework, i, j, k, d, carried): the image whose centre is nearest to the centre of each voxel, ties to the least ``carried``.

    What is shuffled are leaves and their images, not voxels: a leaf generates the voxels of its box where it meets its
    images, in slabs of about ``slab_voxels``, and a slab is one key, so that a wide empty box spreads over tasks.  Voxels of a
    framework without images have nulls.
    """
    cells = cells.select("framework", *lat.CELL)
    tree = cut_lineage(density_tree(images, cells, leaf_atoms, resolution, grid_n))
    axes = list(zip("ijk", LOW, HIGH))
    spans = {f"_{e}_{x}": F.ceil(F.col(c) * grid_n - 0.5) - less for x, lo, hi in axes for e, c, less in (("from", lo, 0), ("to", hi, 1))}
    rows = leaf_images(images, tree, carried).withColumns(spans)
    plane = (F.col("_to_j") - F.col("_from_j") + 1) * (F.col("_to_k") - F.col("_from_k") + 1)
    rows = rows.withColumn("_thick", F.greatest(F.lit(1), F.floor(F.lit(slab_voxels) / plane)))
    rows = rows.withColumn("_slab", F.explode(F.expr("sequence(0L, (_to_i - _from_i) div _thick)")))
    rows = rows.withColumns({"_from_i": F.col("_from_i") + F.col("_slab") * F.col("_thick")}).withColumn(
        "_to_i", F.least("_to_i", F.col("_from_i") + F.col("_thick") - 1))
    # A fixed number of parts: the rows are few, but each stands for the voxels of a slab.
    frameworks = tree.filter("parent < 0").count()
    parts = max(least_parts(images), -(-frameworks * grid_n ** 3 // (8 * slab_voxels)))
    key = ["framework", "node", "_slab"]
    rows = rows.join(cells, "framework").select(*key, *lat.CELL, *FRACTIONS, *carried, *[f"_{e}_{x}" for x, *_ in axes for e in ("from", "to")])
    rows = rows.repartition(parts, *key)
    for x, *_ in axes:
        rows = rows.withColumn(x, F.explode(F.sequence(F.col(f"_from_{x}").cast("int"), F.col(f"_to_{x}").cast("int"))))
    delta = [F.col(f) - (F.col(x) + 0.5) / grid_n for f, x in zip(FRACTIONS, "ijk")]
    # The least distance by carried values first: a plain number, which Spark keeps in a hash table.
    least = rows.groupBy(*key, "i", "j", "k", *carried).agg(F.min(norm3(*lat.to_cartesian(*delta))).alias("d"))
    found = least.groupBy(*key, "i", "j", "k").agg(F.min(F.when(F.col("d").isNotNull(), F.struct("d", *carried))).alias("_hit"))
    return found.select("framework", "i", "j", "k", "_hit.d", *[f"_hit.{c}" for c in carried])
