"""Voxel fields of atoms: pair energies and distances to the nearest atom surface.

Pairs are found through bins of space, not per framework: an atom is copied to the bins it can
reach and meets only the voxels of those bins.  A bin holds a bounded number of voxels and
atoms, so the work of one large framework spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from porescreen.functions import lattice as lat
from porescreen.functions.numbers import norm3
from porescreen.operators.density import nearest_images

# Lennard-Jones sigma (nm) and epsilon (kJ/mol), atom radii (A), caps.
FORCE_FIELD = {
    "o": (0.3304, 0.442329411),
    "si": (0.2310, 0.18458107),
    "ch4": (0.3730, 1.230540467),
    "xe": (0.4100, 1.837496239),
}
ATOM_RADII = {"Si": 1.266, "O": 1.266}
DEFAULT_RADIUS = 1.35
ENERGY_CAP = 1000.0
CONTACT_NM = 0.01
MASK_SLACK = 1e-8
BIN_ANGSTROM = 4.0

AXES = ("i", "j", "k")
FRACTIONS = ("fx", "fy", "fz")
VECTORS = ("a", "b", "c")


def _lookup(key: Column, table: dict, item: int | None, default: Column) -> Column:
    """A fixed table of a few entries as one expression."""
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v if item is None else v[item])]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def periodic_images(atoms: DataFrame, n_shell: int = 1) -> DataFrame:
    """Copies of each atom in the (2n+1)^3 cells around the home cell; fractions leave [0, 1)."""
    out = atoms
    for f in FRACTIONS:
        out = out.withColumn("_n", F.explode(F.sequence(F.lit(-n_shell), F.lit(n_shell)))) \
            .withColumn(f, F.col(f) + F.col("_n")).drop("_n")
    return out


def supercell_atoms(atoms: DataFrame, cells: DataFrame) -> DataFrame:
    """Atoms of the supercell as fractions of it; ``cells`` carries the factors sa, sb, sc."""
    out = atoms.join(cells.select("framework", "sa", "sb", "sc"), "framework")
    for f, s in zip(FRACTIONS, ("sa", "sb", "sc")):
        out = out.withColumn("_n", F.explode(F.sequence(F.lit(0), F.col(s) - 1))) \
            .withColumn(f, (F.col(f) + F.col("_n")) / F.col(s)).drop("_n")
    return out.drop("sa", "sb", "sc")


def grid_sizes(structures: DataFrame, spacing: float = 0.2, min_supercell: float = 28.0) -> DataFrame:
    """Cell matrix, replication factors (sa..), supercell points (ma..) and unit-cell points (na..)."""
    cells = lat.with_cell(structures)
    for v in VECTORS:
        length = lat.vector_length(v)
        factor = lat.replication(length, min_supercell)
        cells = cells.withColumn(f"s{v}", factor)
        cells = cells.withColumn(f"m{v}", lat.grid_points(length * F.col(f"s{v}") / 10.0, spacing / 10.0))
        cells = cells.withColumn(f"n{v}", F.floor(F.col(f"m{v}") / F.col(f"s{v}")).cast("int"))
    return cells


def energy_grid(structures: DataFrame, atoms: DataFrame, probe: str = "ch4", spacing: float = 0.2,
                cutoff: float = 14.0, min_supercell: float = 28.0, bin_size: float = BIN_ANGSTROM) -> DataFrame:
    """Lennard-Jones energy of the probe on the unit-cell voxels: (framework, i, j, k, e).

    Energies are those of the supercell with minimum images, sampled at its grid positions i/m;
    only the voxels of the first unit cell are ever generated.
    """
    cells = grid_sizes(structures, spacing, min_supercell)
    for v in VECTORS:
        height = lat.plane_distance(v) * F.col(f"s{v}")
        cells = cells.withColumn(f"_h{v}", height)
        cells = cells.withColumn(f"_nb{v}", F.greatest(F.lit(1), F.floor(height / bin_size)).cast("int"))
    geometry = ["framework", *lat.CELL, "sa", "sb", "sc"]
    bins = [f"_b{v}" for v in VECTORS]

    voxels = cells
    for axis, v in zip(AXES, VECTORS):
        voxels = voxels.withColumn(axis, F.explode(F.sequence(F.lit(0), F.col(f"n{v}") - 1)))
    voxels = voxels.select(
        *geometry, *AXES,
        *[(F.col(x) / F.col(f"m{v}")).alias(f"_v{v}") for x, v in zip(AXES, VECTORS)],
        *[F.floor(F.col(x) / F.col(f"m{v}") * F.col(f"_nb{v}")).cast("int").alias(f"_b{v}") for x, v in zip(AXES, VECTORS)])

    sigma_p, eps_p = FORCE_FIELD[probe.lower()]
    key = lat.element_key(F.col("element"))
    placed = supercell_atoms(atoms, cells).join(
        cells.select("framework", *[f"{p}{v}" for v in VECTORS for p in ("_h", "_nb", "n", "m")]), "framework")
    for f, v in zip(FRACTIONS, VECTORS):
        nb, reach = F.col(f"_nb{v}"), F.lit(cutoff) / F.col(f"_h{v}")
        low = F.floor((F.col(f) - reach) * nb)
        high = F.least(F.floor((F.col(f) + reach) * nb), low + nb - 1)
        last = F.floor((F.col(f"n{v}") - 1) / F.col(f"m{v}") * nb)
        placed = placed.withColumn(f"_b{v}", F.explode(F.sequence(low, high))) \
            .withColumn(f"_b{v}", F.pmod(f"_b{v}", nb).cast("int")).filter(F.col(f"_b{v}") <= last)
    sources = placed.select(
        "framework", *bins, *FRACTIONS,
        (0.5 * (_lookup(key, FORCE_FIELD, 0, F.lit(FORCE_FIELD["o"][0])) + sigma_p)).alias("_s"),
        F.sqrt(_lookup(key, FORCE_FIELD, 1, F.lit(FORCE_FIELD["o"][1])) * eps_p).alias("_eps"))

    pairs = voxels.join(sources, ["framework", *bins], "left")
    delta = [lat.minimum_image(F.col(f) - F.col(f"_v{v}")) * F.col(f"s{v}") for f, v in zip(FRACTIONS, VECTORS)]
    r = norm3(*lat.to_cartesian(*delta, scale=0.1))
    near = pairs.select("framework", *AXES, "_s", "_eps", r.alias("_r"))
    sr2 = F.pow(F.col("_s") / F.col("_r"), 2)
    sr6 = sr2 * sr2 * sr2
    term = 4.0 * F.col("_eps") * sr6 * (sr6 - 1.0)
    total = F.sum(F.when((F.col("_r") <= cutoff / 10.0) & (F.col("_r") >= CONTACT_NM), term))
    touches = F.coalesce(F.bool_or(F.col("_r") < CONTACT_NM), F.lit(False))
    return near.groupBy("framework", *AXES).agg(
        F.when(touches, F.lit(ENERGY_CAP))
        .otherwise(F.least(F.coalesce(total, F.lit(0.0)), F.lit(ENERGY_CAP))).alias("e"))


def free_radius_grid(structures: DataFrame, atoms: DataFrame, grid_n: int = 120, n_shell: int = 1,
                     leaf_atoms: int = 1) -> DataFrame:
    """Distance from each voxel centre to the surface of the atom with the nearest centre.

    The cell is cut into boxes of about ``leaf_atoms`` atoms, so boxes are small where atoms are dense and wide in a
    pore; a voxel meets the images that its box may need, see ``density.nearest_images``.
    """
    cells = lat.with_cell(structures).select("framework", *lat.CELL)
    radius = _lookup(F.col("element"), ATOM_RADII, None, F.lit(DEFAULT_RADIUS))
    images = periodic_images(atoms.select("framework", *FRACTIONS, radius.alias("_rad")), n_shell)
    near = nearest_images(images, cells, grid_n, ["_rad"], leaf_atoms)
    return near.select("framework", *AXES, (F.col("d") - F.col("_rad")).alias("r"))


def valid_range(grid: DataFrame, cap: float = ENERGY_CAP) -> DataFrame:
    """Energy extent of the voxels below the cap."""
    return grid.filter(F.col("e") < cap).groupBy("framework").agg(
        F.count(F.lit(1)).alias("n_valid"), F.min("e").alias("e_min"), F.max("e").alias("e_max"))


def pore_mask(grid: DataFrame, threshold: float = 300.0, cap: float = ENERGY_CAP) -> DataFrame:
    """Voxels within ``threshold`` above the lowest valid energy; carries ``e_min``."""
    low = grid.filter(F.col("e") < cap).groupBy("framework").agg(F.min("e").alias("e_min"))
    return grid.join(low, "framework").filter(
        (F.col("e") >= F.col("e_min") - MASK_SLACK) & (F.col("e") <= F.col("e_min") + threshold))


def pore_statistics(grid: DataFrame, threshold: float = 300.0, cap: float = ENERGY_CAP) -> DataFrame:
    """Voxel extent and pore share per framework, with a status in place of an error."""
    low = F.min(F.when(F.col("e") < cap, F.col("e")))
    low_rows = grid.groupBy("framework").agg(low.alias("e_min"))
    inside = (F.col("e") >= F.col("e_min") - MASK_SLACK) & (F.col("e") <= F.col("e_min") + threshold)
    sums = grid.join(low_rows, "framework").groupBy("framework").agg(
        *[(F.max(x) + 1).alias(f"n_{x}") for x in AXES], F.max("e_min").alias("e_min"),
        F.count(F.lit(1)).alias("n_voxels"), F.count_if(inside).alias("n_pore"))
    return sums.withColumns({
        "pore_percent": 100.0 * F.col("n_pore") / F.col("n_voxels"),
        "status": F.when(F.col("e_min").isNull(), "no valid voxel").when(F.col("n_pore") == 0, "no pore voxel").otherwise("OK")})


def largest_cavity(free_radius: DataFrame) -> DataFrame:
    return free_radius.groupBy("framework").agg((2 * F.max("r")).alias("gcd"))


def thresholds(free_radius: DataFrame, probe_radius: float = 0.0) -> DataFrame:
    """Distinct free radii above the probe radius: the only values at which connectivity changes."""
    return free_radius.filter(F.col("r") > probe_radius).select("framework", "r").distinct()


def point_table(grid: DataFrame, cells: DataFrame, clip: tuple[float, float] | None = None) -> DataFrame:
    """Cartesian grid points (x, y, z, e) in A, six decimals; energies clipped if asked.

    ``cells`` carries the cell matrix and the point counts na, nb, nc."""
    joined = grid.join(cells.select("framework", *lat.CELL, "na", "nb", "nc"), "framework")
    xyz = lat.to_cartesian(*[F.col(x) / F.col(f"n{v}") for x, v in zip(AXES, VECTORS)])
    e = F.col("e") if clip is None else F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), F.col("e")))
    return joined.select("framework", *AXES, *[F.round(v, 6).alias(n) for v, n in zip(xyz, "xyz")], F.round(e, 6).alias("e"))


def tile(voxels: DataFrame, sizes: dict[str, Column], low: dict[str, Column], high: dict[str, Column]) -> DataFrame:
    """Copies of the voxels in the cells low..high along each axis; indices go on beyond the cell."""
    out = voxels
    for axis in sizes:
        out = out.withColumn("_t", F.explode(F.sequence(low[axis], high[axis]))) \
            .withColumn(axis, F.col(axis) + F.col("_t") * sizes[axis]).drop("_t")
    return out


def tile_ranges(path: DataFrame, margin: int = 1, least: int = -3, most: int = 4) -> DataFrame:
    """Cells that a path in fractional coordinates touches, with a margin, clamped."""
    def lo(f):
        return F.greatest(F.floor(F.min(f)) - margin, F.lit(least)).cast("int").alias(f"lo_{f}")

    def hi(f):
        return F.least(F.ceil(F.max(f)) + margin, F.lit(most)).cast("int").alias(f"hi_{f}")

    return path.groupBy("framework", "axis").agg(*[g(f) for f in FRACTIONS for g in (lo, hi)])
