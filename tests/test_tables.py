"""Sources, lookups, scoring and attribution on fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from porescreen.functions import names
from porescreen.operators import assemble as asm, attribute as att, report, score, symmetry
from porescreen.sources import paths as path_text, structures as cif, text, trajectory
from tests.conftest import rows

STRUCTURE = """# written by hand
data_toy
_cell_length_a   10.5(2)
_cell_length_b   11
_cell_length_c   12.25
_cell_angle_alpha   90
_cell_angle_beta   95.5
_cell_angle_gamma   90
loop_
 _symmetry_equiv_pos_site_id
 _symmetry_equiv_pos_as_xyz
  1  'x, y, z'
  2  '-x, y+1/2, -z'

loop_
 _atom_site_label
 _atom_site_fract_x
 _atom_site_fract_y
 _atom_site_fract_z
 _atom_site_type_symbol
  Si1  0.25  0.5  0.75(3)  Si4+
  O1   0.1\t0.2  0.3  O2-
_cell_volume 1400.0
"""


def test_structure_files(spark, tmp_path):
    (tmp_path / "toy.cif").write_text(STRUCTURE)
    (tmp_path / "TWIN.CIF").write_text(STRUCTURE.replace("10.5(2)", "9"))
    (tmp_path / "notes.txt").write_text("no structure")
    assert [r["file"] for r in text.list_files(spark, str(tmp_path)).collect()] == ["TWIN.CIF", "toy.cif"]
    lines = text.read_structure_lines(spark, str(tmp_path))
    assert rows(cif.structure_table(lines)) == [("TWIN", 9.0, 11.0, 12.25, 90.0, 95.5, 90.0), ("toy", 10.5, 11.0, 12.25, 90.0, 95.5, 90.0)]
    atoms = cif.atom_table(lines).filter("framework = 'toy'").select("atom_id", "element", "label", "fx", "fz")
    assert rows(atoms) == [(0, "Si", "Si1", 0.25, 0.75), (1, "O", "O1", 0.1, 0.3)]
    ops = symmetry.parse_operations(cif.operation_table(lines).filter("framework = 'toy'"))
    assert rows(ops.select("op_id", "r11", "r22", "r33", "t2")) == [(0, 1.0, 1.0, 1.0, 0.0), (1, -1.0, 1.0, -1.0, 0.5)]


def test_chain_of_close_sites_is_settled_in_order(spark):
    sites = spark.createDataFrame([("f", 0, 0, "O", 0.1, 0.1, 0.1), ("f", 1, 0, "O", 0.1008, 0.1, 0.1), ("f", 2, 0, "O", 0.1016, 0.1, 0.1),
                                   ("f", 3, 0, "Si", 0.1, 0.1, 0.1), ("f", 4, 0, "O", 0.1, 0.1, 0.1)],
                                  "framework string, atom_id int, op_id int, element string, fx double, fy double, fz double")
    kept = symmetry.drop_coinciding(sites, ["atom_id", "op_id"]).select("atom_id")
    assert rows(kept) == [(0,), (2,), (3,)]


def test_path_files(spark):
    good = ["# n_nodes = 6", "# barrier = 12.5 kJ/mol"] + [f" {i}.5 0 -1e1  {i} extra" for i in range(5)] + ["1 2 3", "a b c d", "1.0d 0 0 0", ""]
    lines = spark.createDataFrame([("g", i, v) for i, v in enumerate(good)] + [("short", i, "1 2 3 4") for i in range(4)],
                                  "name string, line_no long, line string")
    assert rows(path_text.parse_path_lines(lines, "name"))[:2] == [("g", 0, 0.5, 0.0, -10.0, 0.0), ("g", 1, 1.5, 0.0, -10.0, 1.0)]
    assert path_text.parse_path_lines(lines, "name").count() == 5
    assert rows(path_text.parse_path_comments(lines, "name")) == [("g", 6, 12.5, None)]


def test_trajectory_text(spark):
    frame = ["title", " 2", "    0MOL    O      1   1.007   0.138   0.922", "    1MOL    Si  6908   2.642   5.178   5.041", "   4.0 5.0 6.0"]
    lines = spark.createDataFrame([("t", i, v) for i, v in enumerate(frame * 2)], "file string, line_no long, line string")
    assert rows(trajectory.frame_atoms(lines).filter("frame = 1").select("row", "atom", "atom_no", "x")) == [(0, "O", 1, 1.007), (1, "Si", 6908, 2.642)]
    index = spark.createDataFrame([("i", 0, "[ System ]"), ("i", 1, "  1 2"), ("i", 2, " 3"), ("i", 3, "[ CH4 ]"), ("i", 4, " 2")],
                                  "file string, line_no long, line string")
    assert rows(trajectory.group_members(index).select("group", "atom_no")) == [("CH4", 2), ("System", 1), ("System", 2), ("System", 3)]


def test_two_stage_lookup(spark):
    wanted = spark.createDataFrame([("MFI", "MFI_x"), ("rho ", "rho _x"), ("ATN", "ATN_x"), ("NON", "NON_x")], "framework string, sample string")
    ext = spark.createDataFrame([(" mfi ", 1.0, None, 3.0), ("MFI_X", 9.0, 8.0, 9.0), ("RHO", 4.0, 5.0, 6.0), ("atn_x", 7.0, 7.0, 7.0)],
                                "Zeolites string, FDSi double, Vacc double, ASA double")
    got = asm.lookup_external(wanted, ext).select("framework", "FDSi", "Vacc", "ASA")
    assert rows(got) == [("ATN", 7.0, 7.0, 7.0), ("MFI", 1.0, 8.0, 3.0), ("NON", None, None, None), ("rho ", 4.0, 5.0, 6.0)]
    with pytest.raises(Exception, match="more than once"):
        asm.lookup_external(wanted, ext.unionByName(ext.limit(1))).collect()


def test_unknown_diameter_is_kept(spark):
    df = spark.createDataFrame([("a", None), ("b", 3.499), ("c", 3.5)], "n string, PLD double")
    assert rows(asm.exclude_narrow(df).select("n")) == [("a",), ("c",)]


def test_names(spark):
    assert names.ALIASES["e_a"] == "barrier_official" and names.ALIASES["emin"] == "E_min_official" and names.ALIASES["e_max"] == "E_max"
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], ["σE", "pld1", "Ds"])
    assert names.resolve_columns(df, ["sigma_E", "PLD"]).columns == ["sigma_E", "PLD", "Ds"]


def test_network_matches_loop(spark):
    rng = np.random.default_rng(0)
    ws, bs = (rng.normal(size=(4, 3)), rng.normal(size=(1, 4))), (rng.normal(size=4), rng.normal(size=1))
    for act in ("relu", "gelu", "leaky_relu", "tanh", "elu", "other"):
        net = score.Network(ws, bs, act)
        x = rng.normal(size=3)
        h = ws[0] @ x + bs[0]
        f = {"gelu": lambda v: v * 0.5 * (1 + math.erf(v / 2 ** 0.5)), "leaky_relu": lambda v: v if v >= 0 else 0.01 * v,
             "tanh": math.tanh, "elu": lambda v: v if v > 0 else math.exp(v) - 1}.get(act, lambda v: max(v, 0.0))
        assert net(x[None])[0] == pytest.approx(float(ws[1][0] @ [f(v) for v in h] + bs[1][0]))


def test_attribution_of_a_linear_score(spark):
    w = np.array([2.0, -1.0, 0.5])
    f = ["a", "b", "c"]
    bg = spark.createDataFrame([(0.0, 1.0, 2.0), (1.0, 1.0, 0.0), (3.0, 0.0, 1.0), (0.0, 2.0, 1.0)], f)
    x = spark.createDataFrame([("s", 5.0, 5.0, 5.0)], ["name", *f])
    want = [2.0 * (5 - 1), -1.0 * (5 - 1), 0.5 * (5 - 1)]
    for permutations in (None, 20):
        row = att.shapley_values(x, bg, "name", f, lambda m: m @ w, permutations=permutations).first()
        assert [row[c] for c in f] == pytest.approx(want) and row["base_value"] == pytest.approx(1.5)
    part = att.hybrid_attributions(x.unionByName(spark.createDataFrame([("t", 1.0, 1.0, 1.0), ("K", 0.0, 0.0, 0.0)], ["name", *f])),
                                   spark.createDataFrame([("k", 9.0, 1.0, 2.0, 3.0)], ["match_key", "base_value", *f]), bg, "name", f, lambda m: m @ w, max_explain=1)
    assert {r["source"] for r in part.collect()} == {"known", "computed", "not explained"}


def test_additivity_and_zero_sum(spark):
    m = spark.createDataFrame([("s", 0.5, 1.0, -0.25), ("z", 0.5, 1.0, -1.0)], "name string, base_value double, a double, b double")
    for r in att.original_scale(m, "name", ["a", "b"]).collect():
        assert r["a"] + r["b"] + r["orig_base"] == pytest.approx(r["orig_pred"])
    assert rows(att.original_scale(m, "name", ["a", "b"]).filter("name = 'z'").select("a", "b")) == [(0.0, 0.0)]


def test_message_text(spark):
    msg = "intro\n| a | b |\n|---|---|\n| 1 | 2 |\n\nplain | pipe\nend\n|x|\n|-|"
    df = spark.createDataFrame([(1, msg)], "id int, text string")
    got = [(r["kind"], r["text"], r["header"], r["rows"]) for r in report.table_blocks(df, ["id"]).orderBy("block_no").collect()]
    assert got == [("text", "intro", None, None), ("table", None, ["a", "b"], [["1", "2"]]), ("text", "\nplain | pipe\nend", None, None), ("table", None, ["x"], [])]
    stream = ['data: {"choices":[{"delta":{"content":"Hi"}}]}', "data: {bad", "note", 'data: {"choices":[{"delta":{"content":" you"}}]}', "data: [DONE]",
              'data: {"choices":[{"delta":{"content":"late"}}]}']
    lines = spark.createDataFrame([(1, i, v) for i, v in enumerate(stream)], "id int, seq int, line string")
    assert rows(report.reassemble_stream(lines, ["id"])) == [(1, "Hi you")]
    prose = spark.createDataFrame([("- **Key** `x`\n### Head\n*soft*",)], ["t"]).select(report.plain_prose(F.col("t"))).first()[0]
    assert prose == "Key x\nHead\nsoft"
    found = report.symbol_mentions(spark.createDataFrame([(1, "Emax, PLDX xHE HE. GE,mean σE Emax_")], "id int, text string"), ["id"])
    assert rows(found.select("symbol", "n")) == [("Emax", 2), ("GE,mean", 1), ("HE", 1), ("σE", 1)]
