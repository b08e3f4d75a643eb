"""The full screening run as one chain of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from porescreen.functions.lattice import with_cell
from porescreen.functions.names import FEATURE_ORDER, nomenclature
from porescreen.operators import assemble, attribute, channel, score, symmetry, voxel
from porescreen.operators.ordered import Sequence, compact, sequence
from porescreen.operators.sequence import describe_paths
from porescreen.session import cut_lineage
from porescreen.sources import structures as cif

KEYS = channel.KEYS


def path_features(records: DataFrame, paths: DataFrame, dims: DataFrame, cells: DataFrame) -> DataFrame:
    """Descriptors per (framework, axis).  Records count with 4 decimals and paths with 6."""
    route = cut_lineage(paths)
    points = channel.cartesian_paths(route, sequence(route, KEYS), dims, cells)
    points = cut_lineage(points.withColumns({c: F.round(c, 6) for c in ("x", "y", "z", "e")}))
    described = describe_paths(points, sequence(points, KEYS), F.col("axis"))
    exact = records.withColumns({c: F.round(c, 4) for c in ("barrier", "transition_energy")})
    return exact.filter(F.col("status") == "OK").join(described, KEYS, "left").select(
        "framework", F.col("axis").alias("direction"), F.concat_ws("_", "framework", F.lower("axis")).alias("sample"),
        F.col("barrier").alias("barrier_official"), F.col("sigma_e").alias("sigma_E"), "eta_main", "tortuosity",
        F.col("e_max").alias("E_max"), (F.col("transition_energy") - F.col("barrier")).alias("E_min_official"),
        "peak_slope_mean", F.col("h_entropy").alias("H_entropy"), "barrier_freq")


def screen(structures: DataFrame, atoms: DataFrame, external: DataFrame, probe: str = "ch4", spacing: float = 0.2,
           cutoff: float = 14.0, min_supercell: float = 28.0, threshold: float = channel.ENERGY_THRESHOLD,
           pore_grid_n: int = 120, rejects: DataFrame | None = None) -> dict[str, DataFrame]:
    """Structures and atoms to the feature table.

    Returns ``features``, ``pores``, ``barriers``, ``rejects`` and ``summary``.  A framework in which a
    traversable axis has no path counts as failed and yields no features.  Every stage adds what it loses to the
    ``rejects`` of reading, and the summary names stage and reason of each failure.
    """
    cells = with_cell(structures)
    radii = cut_lineage(voxel.free_radius_grid(structures, atoms, pore_grid_n))
    cube = structures.select("framework", *[F.lit(pore_grid_n).alias(f"n{x}") for x in "ijk"])
    pores = cut_lineage(channel.pore_sizes(radii, cube, cells))

    grid = cut_lineage(voxel.energy_grid(structures, atoms, probe, spacing, cutoff, min_supercell))
    sizes = voxel.grid_sizes(structures, spacing, min_supercell)
    dims = sizes.select("framework", F.col("na").alias("ni"), F.col("nb").alias("nj"), F.col("nc").alias("nk"))
    mask = cut_lineage(voxel.pore_mask(grid, threshold))
    traversal = cut_lineage(channel.traversals(mask, dims))
    records, paths = channel.barriers(grid, mask, dims, cells, traversal, threshold)
    records = cut_lineage(records)
    failed: Column = F.col("status") == "no path"
    good = records.join(records.filter(failed).select("framework").distinct(), "framework", "left_anti")

    rows = path_features(good, paths.join(good.select(*KEYS), KEYS, "left_semi"), dims, cells)
    rows = rows.join(channel.dimensionality(traversal).select("framework", "dimensionality"), "framework")
    features = assemble.feature_table(rows, pores, external, FEATURE_ORDER)
    sized = pores.select(F.col("name").alias("framework"), "ok").filter("ok")
    lost = assemble.stage_rejects(structures, sized, "pore size", "no free-radius voxels").unionByName(
        assemble.stage_rejects(structures, mask, "mask", "no pore voxels")).unionByName(assemble.barrier_rejects(records))
    lost = cut_lineage(lost if rejects is None else lost.unionByName(rejects))
    seen = structures.select("framework").unionByName(lost.select("framework"))
    return {"features": features, "pores": pores, "barriers": records, "rejects": lost,
            "summary": assemble.run_report(seen, good.select("framework", "axis", "barrier"), lost)}


def cell_atoms(lines: DataFrame, skip_expansion: bool = False) -> DataFrame:
    """All atoms of each cell (framework, atom_id, element, fx, fy, fz), from the lines of structure files.

    Every site is moved by every operation of its file and coinciding sites are dropped, so the cell stays and its symmetry
    is P1.  Files without operations keep their sites, and so do all with ``skip_expansion``.
    """
    sites = cut_lineage(cif.atom_table(lines).select("framework", "atom_id", "element", "fx", "fy", "fz"))
    if skip_expansion:
        return sites
    ops = symmetry.parse_operations(cif.operation_table(lines))
    named = sites.select("framework").distinct().join(ops.select("framework").distinct(), "framework", "left_anti")
    identity = symmetry.parse_operations(named.select("framework", F.lit(0).cast("long").alias("op_id"), F.lit("x, y, z").alias("xyz")))
    moved = symmetry.apply_operations(sites, ops.unionByName(identity))
    kept = symmetry.drop_coinciding(cut_lineage(moved), ["atom_id", "op_id"])
    # Numbered in the order of sites and operations; the place of a site among its images is bounded by the operations.
    most = ops.agg(F.max("op_id")).first()[0] or 0
    placed = kept.select("framework", (F.col("atom_id") * (most + 1) + F.col("op_id")).alias("atom_id"), "element", "fx", "fy", "fz")
    return compact(placed, Sequence(("framework",), "atom_id"))


def screen_lines(lines: DataFrame, external: DataFrame, skip_expansion: bool = False, **options) -> dict[str, DataFrame]:
    """The whole run from the lines of structure files (``sources.text``) to the tables of ``screen``, which takes ``options``.

    Adds the table ``atoms``.  Files that can't be read whole are rejected, with stage and reason in the summary; the
    others go on.
    """
    rejects = cut_lineage(cif.read_rejects(lines))
    unread = rejects.filter(F.col("reason") != "site without coordinates").select("framework").distinct()
    structures = cut_lineage(cif.structure_table(lines).join(unread, "framework", "left_anti"))
    atoms = cell_atoms(lines, skip_expansion).join(unread, "framework", "left_anti")
    atoms = cut_lineage(atoms)
    return {"atoms": atoms, **screen(structures, atoms, external, rejects=rejects, **options)}


def score_and_explain(features: DataFrame, network, columns: list[str], scaler: dict[str, tuple[float, float]],
                      background: DataFrame | None = None, known: DataFrame | None = None, name: str = "sample",
                      unit: str = "10⁻⁹ m² s⁻¹", max_explain: int | None = None) -> dict[str, DataFrame]:
    """The feature table to the four result tables.

    ``descriptors`` are the features with their predictions, ``diffusivity`` the predicted rows alone, ``attributions``
    the contributions on the original scale, known ones (see ``known_attributions``) before computed ones, and
    ``nomenclature`` the meaning of the columns.  Without a background the batch itself is summarised.
    """
    predicted = cut_lineage(score.predict(features, columns, scaler, network))
    ready = score.scale_features(predicted.filter("pred_ok"), scaler).select(name, *columns)
    supplied = score.scale_features(background, scaler) if background is not None else None
    base = attribute.choose_background(ready, supplied, columns)
    if known is None:
        matrix = attribute.shapley_values(ready, base, name, columns, network).withColumn("source", F.lit("computed"))
    else:
        matrix = attribute.hybrid_attributions(ready, known, base, name, columns, network, max_explain)
    matrix = cut_lineage(matrix)
    original = attribute.original_scale(matrix.filter("base_value is not null"), name, columns)
    sources = matrix.select(name, "source")
    return {"descriptors": predicted, "diffusivity": score.diffusivity_table(predicted, [name], unit),
            "attributions": sources.join(original, name, "left"),
            "nomenclature": nomenclature(features.sparkSession)}
