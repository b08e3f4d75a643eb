"""Channels through a crystal: pore limiting diameters, dimensionality, barriers and their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from porescreen.functions import lattice as lat
from porescreen.operators import field
from porescreen.operators.ordered import Sequence
from porescreen.operators.sequence import rebuild_periodic, unwrap_periodic
from porescreen.session import cut_lineage

# Fixed values of the channel rules.
BOUNDARY_FRACTION = 0.10
MIN_FRACTION = 0.10
MIN_PATH_NODES = 5
DILATION = 1
ENERGY_THRESHOLD = 300.0
ORTHOGONAL = 1e-6

KEYS = ["framework", "axis"]
AXIS_OF = {"X": "i", "Y": "j", "Z": "k"}
VECTOR_OF = {"i": "a", "j": "b", "k": "c"}


def per_axis(df: DataFrame) -> DataFrame:
    """One copy of each row per axis X, Y, Z."""
    return df.withColumn("axis", F.explode(F.array(*[F.lit(a) for a in AXIS_OF])))


def _along(columns: dict[str, Column]) -> Column:
    """The entry of the axis of the row."""
    return F.when(F.col("axis") == "X", columns["i"]).when(F.col("axis") == "Y", columns["j"]).otherwise(columns["k"])


def axis_index() -> Column:
    return _along({x: F.col(x) for x in "ijk"})


def axis_number() -> Column:
    return _along({x: F.lit(n) for n, x in enumerate("ijk")})


def axis_size() -> Column:
    return _along({x: F.col(f"n{x}") for x in "ijk"})


def tiled(voxels: DataFrame, dims: DataFrame) -> DataFrame:
    """Three copies along each axis; ``copy`` is 0, 1 or 2.  Carries the unit-cell size ``n_axis``."""
    sized = per_axis(voxels.join(dims.select("framework", "ni", "nj", "nk"), "framework"))
    out = sized.withColumn("n_axis", axis_size()).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    for axis, x in AXIS_OF.items():
        out = out.withColumn(x, F.when(F.col("axis") == axis, F.col(x) + F.col("copy") * F.col("n_axis")).otherwise(F.col(x)).cast("int"))
    return out.drop("ni", "nj", "nk")


def tiled_dims(dims: DataFrame, transverse_wraps: bool) -> DataFrame:
    """Sizes of the tiled groups: the axis is open, the transverse axes wrap if asked."""
    out = per_axis(dims.select("framework", "ni", "nj", "nk"))
    for axis, x in AXIS_OF.items():
        here = F.col("axis") == axis
        out = out.withColumn(f"n{x}", F.when(here, 3 * F.col(f"n{x}")).otherwise(F.col(f"n{x}")).cast("int"))
        out = out.withColumn(f"wrap_{x}", F.lit(False) if not transverse_wraps else ~here)
    return out


def single_dims(dims: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Sizes of one cell per axis; a transverse axis wraps if its vector is orthogonal to the axis.

    Without ``cells`` the cell counts as orthogonal."""
    out = per_axis(dims.select("framework", "ni", "nj", "nk"))
    if cells is not None:
        out = out.join(cells.select("framework", *lat.CELL), "framework")
    for axis, x in AXIS_OF.items():
        if cells is None:
            square = F.lit(True)
        else:
            square = F.abs(_along({y: lat.dot(VECTOR_OF[y], VECTOR_OF[x]) for y in "ijk"})) <= ORTHOGONAL
        out = out.withColumn(f"wrap_{x}", (F.col("axis") != axis) & square)
    return out.select(*KEYS, "ni", "nj", "nk", "wrap_i", "wrap_j", "wrap_k")


def open_dims(dims: DataFrame) -> DataFrame:
    """Sizes of one cell with no periodic axis."""
    return dims.select("framework", "ni", "nj", "nk", *[F.lit(False).alias(f"wrap_{x}") for x in "ijk"])


def dilate(mask: DataFrame, dims: DataFrame, iterations: int = DILATION) -> DataFrame:
    """Grow the mask by ``iterations`` voxels in the 26-neighbourhood, clipped to the cell.

    The box is separable: three steps along one axis each copy 3 rows where a joint step copies 27."""
    out = mask.select("framework", "i", "j", "k").join(dims.select("framework", "ni", "nj", "nk"), "framework")
    for x in "ijk":
        out = out.withColumn(x, F.explode(F.sequence(
            F.greatest(F.col(x) - iterations, F.lit(0)), F.least(F.col(x) + iterations, F.col(f"n{x}") - 1)))).distinct()
    return out.select("framework", *[F.col(x).cast("int").alias(x) for x in "ijk"])


def repair_report(mask: DataFrame, dims: DataFrame, iterations: int = DILATION, **bricks) -> DataFrame:
    """Component counts before and after dilation, and whether it may have merged channels."""
    def count(voxels, name):
        # A component is counted at the voxel that names it; labels are never gathered.
        found = field.components(voxels, open_dims(dims), ["framework"], **bricks).join(dims.select("framework", "nj", "nk"), "framework")
        return found.groupBy("framework").agg(F.count_if(F.col("label") == field.voxel_number()).alias(name))

    before = count(mask.select("framework", "i", "j", "k"), "n_before")
    after = count(dilate(mask, dims, iterations), "n_after")
    half = F.greatest(F.lit(1), F.floor(F.col("n_before") / 2))
    return before.join(after, "framework").withColumn("may_merge", (F.col("n_before") > 2) & (F.col("n_after") < half))


def percolates(accessible: DataFrame, dims: DataFrame, cells: DataFrame | None = None, **bricks) -> DataFrame:
    """Per (framework, axis): do the entry and the exit face share a 6-connected component?"""
    sizes = single_dims(dims, cells)
    found = field.components(per_axis(accessible.select("framework", "i", "j", "k")), sizes, KEYS, neighbours=6, **bricks)
    sized = found.join(sizes.select(*KEYS, "ni", "nj", "nk"), KEYS)
    faces = sized.groupBy(*KEYS, "label").agg(
        F.bool_or(axis_index() == 0).alias("_in"), F.bool_or(axis_index() == axis_size() - 1).alias("_out"))
    hit = faces.groupBy(*KEYS).agg(F.bool_or(F.col("_in") & F.col("_out")).alias("percolates"))
    return sizes.select(*KEYS).join(hit, KEYS, "left").withColumn("percolates", F.coalesce("percolates", F.lit(False)))


def limiting_diameters(free_radius: DataFrame, dims: DataFrame, cells: DataFrame | None = None,
                       probe_radius: float = 0.0, **bricks) -> DataFrame:
    """Directional pore limiting diameter: twice the largest radius at which the axis percolates.

    That threshold is the widest path from the entry to the exit face, so one minimax pass over
    the negative radii replaces a bisection with a labelling per step."""
    sizes = single_dims(dims, cells)
    open_ = free_radius.filter(F.col("r") > probe_radius).select("framework", "i", "j", "k", (-F.col("r")).alias("e"))
    job = field.job_of(sizes, **bricks)
    small, large = job.halves(sizes)
    found = field.crossings(open_, small.withColumns({"along": axis_number(), "unit": axis_size(), "width": F.lit(1)}), ["framework"], KEYS, 6, job)
    # A voxel without one of its indices is a way by itself where the axis has one place.
    alone = open_.where("i IS NULL OR j IS NULL OR k IS NULL").join(small.select(*KEYS, "ni", "nj", "nk"), "framework")
    found = found.unionByName(alone.where((axis_index() == 0) & (axis_size() == 1)).select(*KEYS, F.col("e").alias("w")))
    if large is not None:
        reached = field.minimax(per_axis(open_), large, KEYS, start=axis_index() == 0, neighbours=6, **bricks)
        at_exit = reached.join(large.select(*KEYS, "ni", "nj", "nk"), KEYS).filter(axis_index() == axis_size() - 1)
        found = found.unionByName(at_exit.select(*KEYS, "w"))
    best = found.groupBy(*KEYS).agg(F.min("w").alias("_w"))
    return sizes.select(*KEYS).join(best, KEYS, "left").select(
        *KEYS, F.coalesce(-2.0 * F.col("_w"), F.lit(0.0)).alias("pld"))


def pore_sizes(free_radius: DataFrame, dims: DataFrame, cells: DataFrame | None = None, probe_radius: float = 0.0,
               **bricks) -> DataFrame:
    """Cavity diameter and the three limiting diameters per framework, rounded to 4 decimals."""
    pld = limiting_diameters(free_radius, dims, cells, probe_radius, **bricks)
    wide = pld.groupBy("framework").agg(*[
        F.round(F.max(F.when(F.col("axis") == a, F.col("pld"))), 4).alias(f"pld_{v}") for a, v in zip("XYZ", "abc")])
    gcd = free_radius.groupBy("framework").agg(F.round(2 * F.max("r"), 4).alias("gcd"))
    found = dims.select("framework").join(gcd, "framework", "left").join(wide, "framework", "left")
    known = F.col("gcd").isNotNull()
    return found.select(
        F.col("framework").alias("name"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("gcd", "pld_a", "pld_b", "pld_c")],
        known.alias("ok"), F.when(known, "").otherwise("no free-radius voxels").alias("error"))


def traversals(mask: DataFrame, dims: DataFrame, min_fraction: float = MIN_FRACTION, **bricks) -> DataFrame:
    """Per (framework, axis): share of first-copy voxels in components that reach the third copy of
    a triple tiling (26 neighbours, nothing periodic), and whether the axis is traversable."""
    rows = tiled(mask.select("framework", "i", "j", "k"), dims)
    found = field.components(rows.select(*KEYS, "i", "j", "k"), tiled_dims(dims, False), KEYS, **bricks)
    n_axis = per_axis(dims.select("framework", "ni", "nj", "nk")).select(*KEYS, axis_size().alias("n_axis"))
    copy = F.floor(axis_index() / F.col("n_axis"))
    parts = found.join(n_axis, KEYS).groupBy(*KEYS, "label").agg(
        F.count_if(copy == 0).alias("_first"), F.count_if(copy == 2).alias("_third"))
    sums = parts.groupBy(*KEYS).agg(
        F.sum("_first").alias("_all"),
        F.sum(F.when(F.col("_third") > 0, F.col("_first")).otherwise(0)).alias("_through"))
    out = n_axis.select(*KEYS).join(sums, KEYS, "left")
    share = F.coalesce(F.col("_through") / F.nullif(F.col("_all"), F.lit(0)), F.lit(0.0))
    return out.select(*KEYS, share.alias("fraction"),
                      ((share >= min_fraction) & (F.coalesce("_through", F.lit(0)) > 0)).alias("traverses"))


def dimensionality(traversal: DataFrame) -> DataFrame:
    """Number of traversable axes as a label, and Yes or No per axis."""
    flags = {a: F.bool_or((F.col("axis") == a) & F.col("traverses")) for a in AXIS_OF}
    return traversal.groupBy("framework").agg(
        F.concat(F.count_if(F.col("traverses")), F.lit("D")).alias("dimensionality"),
        *[F.when(f, "Yes").otherwise("No").alias(a) for a, f in flags.items()])


def _end_regions(dims: DataFrame, fraction: float) -> DataFrame:
    """Width of the start and end regions of the tiled axis."""
    sizes = per_axis(dims.select("framework", "ni", "nj", "nk"))
    width = F.greatest(F.lit(1), F.floor(axis_size() * fraction).cast("int"))
    return sizes.select(*KEYS, axis_size().alias("n_axis"), width.alias("width"))


def crossing_energies(voxels: DataFrame, dims: DataFrame, fraction: float = BOUNDARY_FRACTION,
                      axes: DataFrame | None = None, **bricks) -> tuple[DataFrame, DataFrame]:
    """Minimax energies on the triple tiling (axis open, transverse periodic, 26 neighbours), of the given ``axes`` or all.

    Returns the reached voxels (w) and, per (framework, axis) that reaches the end region, the
    transition energy."""
    regions = _end_regions(dims, fraction)
    if axes is not None:
        regions = regions.join(axes.select(*KEYS), KEYS, "left_semi")
    rows = tiled(voxels.select("framework", "i", "j", "k", "e"), dims).join(regions.select(*KEYS, "width"), KEYS)
    rows = rows.withColumn("_start", axis_index() < F.col("width"))
    seeded = rows.select(*KEYS, "i", "j", "k", "e", F.when(F.col("_start"), F.col("e")).alias("w"))
    # Written out: the reached voxels are read for the energies and again for the paths.
    reached = cut_lineage(field.spread(seeded, tiled_dims(dims, True), KEYS, 26, **bricks))
    at_end = reached.join(regions, KEYS).filter(axis_index() >= 3 * F.col("n_axis") - F.col("width"))
    energy = at_end.groupBy(*KEYS).agg(F.min("w").alias("transition_energy")).filter(F.col("transition_energy").isNotNull())
    return reached, energy


def crossing_paths(reached: DataFrame, energy: DataFrame, dims: DataFrame, fraction: float = BOUNDARY_FRACTION,
                   **bricks) -> DataFrame:
    """Voxels (seq, i, j, k, e) of one minimax path per (framework, axis).

    Every prefix of the path is itself minimax-optimal.  Among equal choices the path has the
    fewest steps, then parents with the least minimax value, then the least voxel number."""
    regions = _end_regions(dims, fraction)
    sizes = tiled_dims(dims, True)
    useful = reached.join(energy, KEYS).filter(F.col("w") <= F.col("transition_energy")).join(regions, KEYS)
    useful = useful.withColumn("_start", axis_index() < F.col("width"))
    seeded = useful.select(*KEYS, "i", "j", "k", "e", "w", F.when(
        F.col("_start") & (F.col("w") == F.col("e")), F.lit(0)).cast("long").alias("hop"))
    stepped = cut_lineage(field.count_hops(seeded, sizes, KEYS, 26, **bricks))
    ends = stepped.join(regions, KEYS).filter((axis_index() >= 3 * F.col("n_axis") - F.col("width")) & F.col("hop").isNotNull())
    ends = ends.groupBy(*KEYS).agg(F.min(F.struct("w", "hop", "lin")).alias("_e")).select(*KEYS, "_e.lin")
    chain = field.trace(stepped, ends, sizes, KEYS, **bricks)
    placed = chain.join(sizes.select(*KEYS, "nj", "nk"), KEYS)
    return placed.select(*KEYS, F.col("hop").alias("seq"), *[v.alias(x) for x, v in field.voxel_of("lin").items()], "e")


def fractional_paths(paths: DataFrame, seq: Sequence, dims: DataFrame) -> DataFrame:
    """Index paths with periodic steps unwrapped, and their fractional voxel centres fx, fy, fz.

    Along the tiled axis the fraction runs from 0 to 3; along the others it may leave [0, 1)."""
    sized = paths.join(dims.select("framework", "ni", "nj", "nk"), "framework")
    # The tiled axis is already linear: no step can exceed half of six cells.
    period = {x: F.when(F.col("axis") == a, 6 * F.col(f"n{x}")).otherwise(F.col(f"n{x}")) for a, x in AXIS_OF.items()}
    flat = unwrap_periodic(sized, seq, period)
    return flat.withColumns({f: (F.col(x) + 0.5) / F.col(f"n{x}") for f, x in zip(("fx", "fy", "fz"), "ijk")})


def cartesian_paths(paths: DataFrame, seq: Sequence, dims: DataFrame, cells: DataFrame) -> DataFrame:
    """Index paths as Cartesian paths: unwrapped voxel centres, with sideways drift rebuilt."""
    placed = fractional_paths(paths, seq, dims).join(cells.select("framework", *lat.CELL), "framework")
    points = placed.withColumns(dict(zip("xyz", lat.to_cartesian(F.col("fx"), F.col("fy"), F.col("fz")))))
    edges = {c: lat.vector_length(v) for c, v in zip("xyz", "abc")}
    return rebuild_periodic(points, seq, F.col("axis"), edges)


def barriers(grid: DataFrame, mask: DataFrame, dims: DataFrame, cells: DataFrame, traversal: DataFrame,
             threshold: float = ENERGY_THRESHOLD, min_nodes: int = MIN_PATH_NODES,
             fraction: float = BOUNDARY_FRACTION, dilation: int = DILATION, **bricks) -> tuple[DataFrame, DataFrame]:
    """Barrier records and index paths of the traversable axes.

    Axes without a path of enough nodes on the pore mask are tried again on the dilated mask,
    where added voxels carry the threshold energy.  A traversable axis that still has no path
    gets the status ``no path``.
    """
    wanted = traversal.filter("traverses").select(*KEYS)
    low = mask.groupBy("framework").agg(F.first("e_min").alias("e_min"))

    def search(voxels: DataFrame, axes: DataFrame) -> DataFrame:
        sizes = tiled_dims(dims, True).join(_end_regions(dims, fraction).join(axes, KEYS, "left_semi"), KEYS)
        job = field.job_of(sizes, **bricks)
        small, large = job.halves(sizes)
        path = field.crossings(voxels, small.withColumns({"along": axis_number(), "unit": F.col("n_axis")}), ["framework"], KEYS, 26, job, 3, paths=True)
        if large is not None:
            reached, energy = crossing_energies(voxels, dims, fraction, large, **bricks)
            path = path.unionByName(crossing_paths(reached, energy, dims, fraction, **bricks))
        path = cut_lineage(path)
        return path.join(path.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")), KEYS).filter(F.col("_n") >= min_nodes).drop("_n")

    first = search(mask, wanted)
    unsolved = wanted.join(first.select(*KEYS).distinct(), KEYS, "left_anti")
    paths = first.withColumn("mask", F.lit("original"))
    if dilation > 0 and not unsolved.isEmpty():
        frameworks = unsolved.select("framework").distinct()
        grown = dilate(mask.join(frameworks, "framework", "left_semi"), dims, dilation)
        known = mask.select("framework", "i", "j", "k", "e")
        repaired = grown.join(known, ["framework", "i", "j", "k"], "left").join(low, "framework").select(
            "framework", "i", "j", "k", F.coalesce("e", F.col("e_min") + threshold).alias("e"))
        second = search(repaired, unsolved)
        paths = cut_lineage(paths.unionByName(second.withColumn("mask", F.lit("repaired"))))
    found = paths.groupBy(*KEYS).agg(F.max("e").alias("transition_energy"), F.count(F.lit(1)).alias("n_path_nodes"),
                                     F.first("mask").alias("mask"))
    edges = cells.select("framework", *lat.CELL)
    rows = traversal.select(*KEYS, "traverses").join(low, "framework").join(found, KEYS, "left").join(edges, "framework")
    records = rows.select(
        *KEYS, "traverses", (F.col("transition_energy") - F.col("e_min")).alias("barrier"), "transition_energy",
        F.col("e_min").alias("min_energy"),
        F.when(F.col("n_path_nodes").isNotNull(), _along({x: lat.vector_length(v) for x, v in VECTOR_OF.items()})).alias("cell_length"),
        F.coalesce("n_path_nodes", F.lit(0)).alias("n_path_nodes"), "mask",
        F.when(~F.col("traverses"), "not traversing").when(F.col("n_path_nodes").isNull(), "no path").otherwise("OK").alias("status"))
    return records, paths.select(*KEYS, "seq", "i", "j", "k", "e")
