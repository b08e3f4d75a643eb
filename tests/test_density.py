"""Nearest images by boxes of equal density, against a plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from porescreen.functions import lattice as lat
from porescreen.operators import density, voxel

CELLS = [("skew", 9.0, 11.0, 14.0, 70.0, 100.0, 115.0), ("wide", 30.0, 8.0, 8.0, 90.0, 90.0, 90.0), ("bare", 8.0, 8.0, 8.0, 90.0, 90.0, 90.0)]
NAMES = "framework string, a double, b double, c double, alpha double, beta double, gamma double"
GRID = 5


def atoms_of(rng):
    """Dense in a corner, one atom far off, one twice, one given outside the cell."""
    out = []
    for name in ("skew", "wide"):
        dense = [tuple(rng.random() * 0.2 for _ in range(3)) for _ in range(25)]
        out += [(name, n, "O" if n % 3 else "Ti", *at) for n, at in enumerate([*dense, dense[0], (0.7, 0.6, 0.9), (-0.3, 1.2, 0.5)])]
    return out


@pytest.mark.parametrize("leaf_atoms, resolution, slab", [(1, 64, 1 << 15), (4, 4, 5)])
def test_nearest_images_equal_a_plain_search(spark, leaf_atoms, resolution, slab):
    atoms = atoms_of(random.Random(leaf_atoms))
    cells = lat.with_cell(spark.createDataFrame(CELLS, NAMES))
    df = spark.createDataFrame(atoms, "framework string, atom_id int, element string, fx double, fy double, fz double")
    images = voxel.periodic_images(df.select("framework", "fx", "fy", "fz", F.when(F.col("element") == "O", 1.266).otherwise(1.35).alias("rad")))
    got = {tuple(r)[:4]: (r["d"], r["rad"]) for r in density.nearest_images(images, cells, GRID, ["rad"], leaf_atoms, resolution, slab).collect()}
    assert len(got) == 3 * GRID ** 3
    shift = np.array([[p, q, r] for p in (-1, 0, 1) for q in (-1, 0, 1) for r in (-1, 0, 1)])
    for row in cells.collect():
        name, matrix = row["framework"], np.array([row[c] for c in lat.CELL]).reshape(3, 3)
        own = [a for a in atoms if a[0] == name]
        for i, j, k in np.ndindex(GRID, GRID, GRID):
            d, rad = got[name, i, j, k]
            if not own:
                assert d is None and rad is None
                continue
            at = (np.array([a[3:] for a in own])[:, None, :] + shift[None] - (np.array([i, j, k]) + 0.5) / GRID) @ matrix
            plain = min((float(x), 1.266 if a[2] == "O" else 1.35) for a, near in zip(own, np.linalg.norm(at, axis=2)) for x in near)
            assert d == pytest.approx(plain[0], abs=1e-9) and rad == plain[1]


def test_leaves_tile_the_cell_and_hold_few_atoms(spark):
    atoms = atoms_of(random.Random(3))
    cells = lat.with_cell(spark.createDataFrame(CELLS, NAMES))
    df = spark.createDataFrame(atoms, "framework string, atom_id int, element string, fx double, fy double, fz double")
    tree = density.density_tree(df, cells, leaf_atoms=3).toPandas()
    for name in ("skew", "wide", "bare"):
        leaves = tree[(tree["framework"] == name) & tree["leaf"]]
        low, high = leaves[density.LOW].to_numpy(), leaves[density.HIGH].to_numpy()
        assert (high - low).prod(axis=1).sum() == pytest.approx(1.0)
        inside = np.array([a[3:] for a in atoms if a[0] == name and all(0 <= x < 1 for x in a[3:])]).reshape(-1, 3)
        held = ((inside[:, None] >= low) & (inside[:, None] < high)).all(axis=2)
        assert (held.sum(axis=1) == 1).all() and held.sum(axis=0).max(initial=0) <= 3
    assert tree[tree["framework"] == "bare"]["reach"].tolist() == [float("inf")]


def test_deepest_boxes_without_a_voxel_centre(spark):
    """Atoms crowd where no voxel has its centre: the boxes above must not be taken for leaves that hold one."""
    rng = random.Random(5)
    # Voxel centres of a grid of 2 lie at 1/4 and 3/4.
    atoms = [("wide", n, *(0.4 + 0.2 * rng.random() for _ in range(3))) for n in range(300)]
    cells = lat.with_cell(spark.createDataFrame(CELLS[1:2], NAMES))
    df = spark.createDataFrame(atoms, "framework string, atom_id int, fx double, fy double, fz double")
    tree = density.density_tree(df, cells, grid_n=2).toPandas()
    assert set(tree[~tree["leaf"]]["node"]) == set(tree[tree["parent"] >= 0]["parent"])
    images = voxel.periodic_images(df.select("framework", "fx", "fy", "fz", F.lit(1.0).alias("rad")))
    got = {tuple(r)[1:4]: r["d"] for r in density.nearest_images(images, cells, 2, ["rad"]).collect()}
    matrix = np.array([cells.first()[c] for c in lat.CELL]).reshape(3, 3)
    at = np.array([a[2:] for a in atoms])
    shift = np.array([[p, q, r] for p in (-1, 0, 1) for q in (-1, 0, 1) for r in (-1, 0, 1)])
    assert len(got) == 8
    for place, d in got.items():
        near = (at[:, None, :] + shift[None] - (np.array(place) + 0.5) / 2) @ matrix
        assert d == pytest.approx(np.linalg.norm(near, axis=2).min(), abs=1e-9)


def test_images_of_one_cell_descend_in_many_tasks(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([("wide", *(rng.random() for _ in range(3))) for _ in range(300)], "framework string, fx double, fy double, fz double")
    cells = lat.with_cell(spark.createDataFrame(CELLS[1:2], NAMES))
    images = voxel.periodic_images(df.withColumn("rad", F.lit(1.0)))
    held = density.leaf_images(images, density.density_tree(images, cells), ["rad"]).filter("fx IS NOT NULL")
    tasks = [r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 1 and max(tasks) < sum(tasks) / 2
