"""The run from structure lines, against the run from tables that were made by hand."""

import inspect

from porescreen.plans import run_queries
from porescreen.plans.screening import cell_atoms, screen, screen_lines
from tests.conftest import rows

HEAD = """data_x
_cell_length_a 9.0
_cell_length_b 9.0
_cell_length_c 9.0
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
"""
OPS = """loop_
_symmetry_equiv_pos_as_xyz
'x, y, z'
'x+1/2, y, z'
"""
SITES = """loop_
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
"""
FILES = {
    "moved": HEAD + OPS + SITES + "Si 0.0 0.0 0.0\nSi 0.5 0.0 0.0\n",  # the images coincide with the sites
    "plain": HEAD + SITES + "Si 0.0 0.0 0.0\nO 0.25 0.0 0.0\n",
    "broken": HEAD.replace("_cell_length_b 9.0\n", "") + SITES + "Si 0.0 0.0 0.0\n",
}


def lines_of(spark):
    return spark.createDataFrame([(f, n, line) for f, text in FILES.items() for n, line in enumerate(text.split("\n"))],
                                 "framework string, line_no long, line string")


def test_sites_are_expanded_unless_skipped(spark):
    lines = lines_of(spark).filter("framework <> 'broken'")
    expanded = rows(cell_atoms(lines).select("framework", "atom_id", "element", "fx"))
    assert expanded == [("moved", 0, "Si", 0.0), ("moved", 1, "Si", 0.5), ("plain", 0, "Si", 0.0), ("plain", 1, "O", 0.25)]
    one = lines.filter("NOT (framework = 'moved' AND line LIKE 'Si 0.5%')")
    assert rows(cell_atoms(one).filter("framework = 'moved'").select("atom_id", "fx")) == [(0, 0.0), (1, 0.5)]
    assert rows(cell_atoms(one, skip_expansion=True).filter("framework = 'moved'").select("atom_id", "fx")) == [(0, 0.0)]
    assert cell_atoms(lines.limit(0)).count() == 0


def test_run_goes_on_without_the_files_that_fail(spark):
    external = spark.createDataFrame([(" MOVED ", 17.0, 20.0, 300.0)], "Zeolites string, FDSi double, Vacc double, ASA double")
    out = screen_lines(lines_of(spark), external, spacing=1.5, cutoff=9.0, min_supercell=9.0, pore_grid_n=6)
    assert {r["framework"]: (r["status"], r["stage"], r["reason"]) for r in out["summary"].collect()} == {
        "moved": ("OK", None, None), "plain": ("OK", None, None), "broken": ("FAILED", "read", "incomplete cell")}
    features = out["features"].collect()
    assert {r["sample"] for r in features} == {f"{f}_{a}" for f in ("moved", "plain") for a in "xyz"}
    assert {r["framework"]: r["FDSi"] for r in features} == {"moved": 17.0, "plain": None}


def test_registered_run_has_the_grids_of_the_reference(spark, monkeypatch):
    """The run was registered on voxels of 2 A, a cutoff of 6 A and 6 pore voxels an axis."""
    asked = []
    monkeypatch.setattr(run_queries, "screen_lines", lambda lines, external, *rest, **options: asked.append((rest, options)) or {"features": None})
    run_queries.screening_run(spark, "/root/testdata/sf0.001")
    assert asked == [((False,), {})]
    values = {k: p.default for k, p in inspect.signature(screen).parameters.items()}
    assert [values[k] for k in ("spacing", "cutoff", "min_supercell", "threshold", "pore_grid_n")] == [0.2, 14.0, 28.0, 300.0, 120]
