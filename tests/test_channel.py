"""Voxel graphs: small hand-made cells, and bricks of any size give the same answer."""

import random

import pytest
from pyspark.sql import functions as F

from porescreen.functions import lattice as lat
from porescreen.operators import channel, field, voxel
from porescreen.operators.ordered import sequence
from porescreen.session import cut_lineage
from tests.conftest import rows

KEYS = channel.KEYS


def voxels(spark, cells, name="fw"):
    return spark.createDataFrame([(name, *v) for v in cells], "framework string, i int, j int, k int, e double")


def sizes(spark, ni, nj, nk, name="fw"):
    return spark.createDataFrame([(name, ni, nj, nk)], "framework string, ni int, nj int, nk int")


def orthogonal(spark, a=6.0, b=4.0, c=4.0):
    return lat.with_cell(spark.createDataFrame([("fw", a, b, c, 90.0, 90.0, 90.0)],
                                               "framework string, a double, b double, c double, alpha double, beta double, gamma double"))


def test_straight_channel(spark):
    mask = voxels(spark, [(i, 1, 1, float(i % 3)) for i in range(6)])
    dims = sizes(spark, 6, 4, 4)
    got = channel.traversals(mask, dims)
    assert rows(got.select("axis", "fraction", "traverses")) == [("X", 1.0, True), ("Y", 0.0, False), ("Z", 0.0, False)]
    assert rows(channel.dimensionality(got)) == [("fw", "1D", "Yes", "No", "No")]
    assert rows(channel.percolates(mask, dims).select("axis", "percolates")) == [("X", True), ("Y", False), ("Z", False)]


def test_thin_contact_is_rejected(spark):
    cells = [(i, 0, 0, 0.0) for i in range(6)] + [(i, j, k, 0.0) for i in (2, 3) for j in range(3, 12) for k in range(4)]
    got = channel.traversals(voxels(spark, cells), sizes(spark, 6, 13, 4)).filter("axis = 'X'").first()
    assert got["fraction"] == pytest.approx(6 / 78) and not got["traverses"]


def test_two_routes_and_blocked_neck(spark):
    # Short way through 7, long way round through 5.
    short = [(i, 0, 0, 7.0 if i == 3 else 1.0) for i in range(6)]
    round_ = [(i, j, 0, 5.0 if (i, j) == (3, 2) else 1.0) for i, j in ((2, 1), (2, 2), (3, 2), (4, 2), (4, 1))]
    mask = voxels(spark, short + round_).withColumn("e_min", F.lit(1.0))
    dims, cells = sizes(spark, 6, 5, 1), orthogonal(spark)
    asked = channel.per_axis(dims.select("framework")).withColumn("traverses", F.col("axis") == "X")
    records, paths = channel.barriers(mask, mask, dims, cells, asked)
    row = records.filter("axis = 'X'").first()
    assert (row["barrier"], row["transition_energy"], row["mask"], row["status"]) == (4.0, 5.0, "original", "OK")
    assert paths.agg(F.max("e")).first()[0] == 5.0 and row["n_path_nodes"] == paths.count()
    # A gap of one voxel opens only on the dilated mask, at the threshold energy.
    gap = voxels(spark, [(i, 2, 2, 1.0) for i in (0, 1, 2, 4, 5)]).withColumn("e_min", F.lit(1.0))
    dims2 = sizes(spark, 6, 5, 5)
    records, _ = channel.barriers(gap, gap, dims2, cells, channel.per_axis(dims2.select("framework")).withColumn("traverses", F.col("axis") == "X"))
    row = records.filter("axis = 'X'").first()
    assert (row["barrier"], row["mask"]) == (300.0, "repaired")
    records, _ = channel.barriers(gap, gap, dims2, cells, channel.per_axis(dims2.select("framework")).withColumn("traverses", F.col("axis") == "X"), dilation=0)
    assert records.filter("axis = 'X'").first()["status"] == "no path"


def test_wrapping_route_is_unwrapped(spark):
    mask = voxels(spark, [(i, (i // 2) % 4, 0, 1.0) for i in range(8)])
    dims = sizes(spark, 8, 4, 1)
    reached, energy = channel.crossing_energies(mask, dims)
    route = channel.crossing_paths(reached, energy.filter("axis = 'X'"), dims)
    flat = channel.fractional_paths(route, sequence(route, KEYS), dims).orderBy("seq").collect()
    assert all(abs(b["fy"] - a["fy"]) <= 0.2501 for a, b in zip(flat, flat[1:]))
    assert flat[-1]["fy"] - flat[0]["fy"] > 1.5


def test_diagonal_gate_of_percolation(spark):
    # The only way along a leaves through the face of c and comes back: open only if c is orthogonal to a.
    cells = [(0, 0, 0, 1.0), (1, 0, 0, 1.0), (1, 0, 2, 1.0), (2, 0, 2, 1.0)]
    dims = sizes(spark, 3, 1, 3)
    right = orthogonal(spark)
    lean = lat.with_cell(spark.createDataFrame([("fw", 6.0, 4.0, 4.0, 90.0, 70.0, 90.0)],
                                               "framework string, a double, b double, c double, alpha double, beta double, gamma double"))
    assert channel.percolates(voxels(spark, cells), dims, right).filter("axis = 'X'").first()["percolates"]
    assert not channel.percolates(voxels(spark, cells), dims, lean).filter("axis = 'X'").first()["percolates"]


def test_bricks_do_not_change_results(spark):
    rng = random.Random(4)
    cells = [(i, j, k, float(rng.randrange(40))) for i in range(9) for j in range(4) for k in range(4) if rng.random() < 0.7]
    grid = voxels(spark, cells).cache()
    dims = spark.createDataFrame([("fw", 9, 4, 4, False, True, True)],
                                 "framework string, ni int, nj int, nk int, wrap_i boolean, wrap_j boolean, wrap_k boolean")
    bricks = {"volume": 36, "edge": 3}
    assert rows(field.components(grid.drop("e"), dims, ["framework"], 6)) == rows(
        field.components(grid.drop("e"), dims, ["framework"], 6, **bricks))
    start = F.col("i") < 2
    whole = cut_lineage(field.minimax(grid, dims, ["framework"], start))
    assert rows(whole) == rows(field.minimax(grid, dims, ["framework"], start, **bricks))
    far = cut_lineage(field.hops(whole, dims, ["framework"], start))
    near = cut_lineage(field.hops(whole, dims, ["framework"], start, **bricks))
    assert rows(far) == rows(near)
    ends = far.filter("i = 8 and hop is not null").groupBy("framework").agg(F.min(F.struct("w", "hop", "lin")).alias("_e")).select("framework", "_e.lin")
    one = field.trace(far, ends, dims, ["framework"])
    assert rows(one) == rows(field.trace(near, ends, dims, ["framework"], **bricks)) and one.count() > 5


def test_limiting_diameter_is_a_percolation_threshold(spark):
    rng = random.Random(9)
    radius = voxels(spark, [(i, j, k, float(rng.randrange(1, 30))) for i in range(5) for j in range(5) for k in range(5)]).withColumnRenamed("e", "r")
    dims = sizes(spark, 5, 5, 5)
    for row in channel.limiting_diameters(radius, dims).collect():
        for step, expected in ((0.0, True), (0.5, False)):
            open_ = radius.filter(F.col("r") >= row["pld"] / 2 + step)
            got = channel.percolates(open_, dims).filter(F.col("axis") == row["axis"]).first()
            assert got["percolates"] is expected
    empty = channel.pore_sizes(radius.filter("r > 99"), dims).first()
    assert not empty["ok"] and empty["pld_a"] == 0.0


def test_one_atom_cell(spark):
    s = spark.createDataFrame([("fw", 10.0, 10.0, 10.0, 90.0, 90.0, 90.0)],
                              "framework string, a double, b double, c double, alpha double, beta double, gamma double")
    atoms = spark.createDataFrame([("fw", 0, "O", 0.0, 0.0, 0.0)], "framework string, atom_id int, element string, fx double, fy double, fz double")
    free = {tuple(r)[1:4]: r["r"] for r in voxel.free_radius_grid(s, atoms, grid_n=4).collect()}
    assert len(free) == 64
    assert free[0, 0, 0] == pytest.approx(1.25 * 3 ** 0.5 - 1.266) and free[3, 3, 3] == pytest.approx(free[0, 0, 0])
    e = {tuple(r)[1:4]: r["e"] for r in voxel.energy_grid(s, atoms, spacing=2.5, cutoff=14.0, min_supercell=28.0).collect()}
    assert e[0, 0, 0] == 1000.0 and e[1, 0, 0] == pytest.approx(e[0, 1, 0]) == pytest.approx(e[0, 0, 1])
    assert e[2, 2, 2] < 0


def test_whole_run(spark):
    from porescreen.plans.screening import screen

    names = "framework string, a double, b double, c double, alpha double, beta double, gamma double"
    s = spark.createDataFrame([("open", 9.0, 9.0, 9.0, 90.0, 90.0, 90.0)], names)
    atoms = spark.createDataFrame([("open", 0, "Si", 0.0, 0.0, 0.0), ("open", 1, "O", 0.5, 0.0, 0.0)],
                                  "framework string, atom_id int, element string, fx double, fy double, fz double")
    ext = spark.createDataFrame([(" OPEN ", 17.0, 20.0, 300.0)], "Zeolites string, FDSi double, Vacc double, ASA double")
    out = screen(s, atoms, ext, spacing=1.0, cutoff=9.0, min_supercell=18.0, pore_grid_n=9)
    features = out["features"].orderBy("direction").collect()
    assert [r["sample"] for r in features] == ["open_x", "open_y", "open_z"]
    for r in features:
        assert r["dimensionality"] == "3D" and r["FDSi"] == 17.0 and r["PLD"] >= 3.5 and r["tortuosity"] >= 1
        assert r["barrier_official"] >= 0 and r["E_max"] == pytest.approx(r["barrier_official"] + r["E_min_official"], abs=1e-3)
    assert rows(out["summary"].select("framework", "status")) == [("open", "OK")]


def test_pore_points_are_tiled_along_every_axis(spark):
    from porescreen.plans import load_queries

    built = {n: load_queries()[n].build(spark, "/root/testdata/sf0.001") for n in ("crossing_path", "tiled_pore_points_by_axis")}
    paths = {tuple(r) for r in built["crossing_path"].select("framework", "axis").distinct().collect()}
    tiled = built["tiled_pore_points_by_axis"].groupBy("framework", "axis").agg(*[F.expr(f"max({x}) as {x}") for x in "ijk"]).collect()
    assert {(r["framework"], r["axis"]) for r in tiled} == paths and {a for _, a in paths} >= {"Y", "Z"}
    for r in tiled:  # an axis has three cells in its own direction
        x, n = {"X": ("i", 50), "Y": ("j", 11), "Z": ("k", 9)}[r["axis"]]
        assert 2 * n <= r[x] < 3 * n


def many_frameworks(spark):
    rng, names = random.Random(11), [f"g{n}" for n in range(6)]
    cells = [(g, i, j, k, float(rng.randrange(9))) for g in names for i in range(5) for j in range(4) for k in range(3)
             if rng.random() < (0.15 if g in ("g4", "g5") else 0.45) and (g != "g3" or (i < 2 and j < 2 and k < 1))]
    grid = spark.createDataFrame(cells + [(None, 0, 0, 0, 1.0)], "framework string, i int, j int, k int, e double").withColumn("e_min", F.lit(0.0))
    dims = spark.createDataFrame([(g, *((2, 2, 1) if g == "g3" else (5, 4, 3))) for g in [*names, "empty", None]], "framework string, ni int, nj int, nk int")
    edges = lat.with_cell(spark.createDataFrame([(g, 5.0, 4.0, 3.0, 90.0, 80.0 if g == "g1" else 90.0, 90.0) for g in [*names, "empty"]],
                                                "framework string, a double, b double, c double, alpha double, beta double, gamma double"))
    return grid, dims, edges


def test_groups_in_one_call_are_solved_as_voxel_by_voxel(spark):
    """Bottlenecks and paths found in a call are those of the passes over voxels; small bricks make no rounds of jobs."""
    grid, dims, edges = many_frameworks(spark)
    reached, energy = channel.crossing_energies(grid, dims)
    want = rows(channel.crossing_paths(reached, energy, dims).select(*KEYS, "seq", "i", "j", "k", "e"))
    sizes = channel.tiled_dims(dims, True).join(channel._end_regions(dims, 0.1), KEYS)
    groups = sizes.withColumns({"along": channel.axis_number(), "unit": F.col("n_axis")})
    job = field.job_of(sizes, volume=12, edge=3)
    assert job.most > 1 and not job.split
    spark.sparkContext.setJobGroup("small groups", "")
    paths = field.crossings(grid, groups, ["framework"], KEYS, 26, job, 3, paths=True).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("small groups")
    spark.sparkContext.setJobGroup("", "")
    assert sorted(map(tuple, paths)) == want and len({r[:2] for r in want}) > 5 and len(jobs) < 10
    least = {tuple(r)[:2]: r["w"] for r in field.crossings(grid, groups, ["framework"], KEYS, 26, job, 3).collect()}
    assert least == {tuple(r)[:2]: r["transition_energy"] for r in energy.collect()}


def test_diameters_of_groups_in_one_call_and_in_several(spark, monkeypatch):
    grid, dims, edges = many_frameworks(spark)
    free = grid.withColumn("r", F.col("e") + 1)
    whole = rows(channel.pore_sizes(free, dims, edges, 2.0, volume=12, edge=3))
    monkeypatch.setattr(field, "BRICK_VOLUME", 20)  # g3 alone still fits into a call
    small, large = field.job_of(channel.single_dims(dims, edges), 12, 3).halves(channel.single_dims(dims, edges))
    assert {r["framework"] for r in small.collect()} == {"g3"} and large.count() > 9
    assert rows(channel.pore_sizes(free, dims, edges, 2.0, volume=12, edge=3)) == whole
