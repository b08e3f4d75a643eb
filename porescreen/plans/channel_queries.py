"""Queries over voxel graphs: components, percolation, traversal, barriers and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from porescreen.functions import lattice as lat
from porescreen.functions.numbers import rounded
from porescreen.operators import assemble, channel, field, voxel
from porescreen.operators.ordered import sequence
from porescreen.plans.bindings import GRID, V_GRID, V_PORE, grid, low_energy
from porescreen.plans.registry import query
from porescreen.session import cut_lineage

NI, NJ, NK = GRID
KEYS = channel.KEYS


def voxels(spark, sf_dir):
    """The voxel grid, written once because every query reads it several times, and its sizes."""
    rows = cut_lineage(grid(spark, sf_dir))
    sizes = rows.select("framework").distinct().select(
        "framework", F.lit(NI).alias("ni"), F.lit(NJ).alias("nj"), F.lit(NK).alias("nk"))
    return rows, sizes


def cells(dims):
    """Cells of the frameworks: F is right-angled, in O the vector c leans towards a."""
    beta = F.when(F.col("framework") == "O", F.lit(80.0)).otherwise(F.lit(90.0))
    return lat.with_cell(dims.select(
        "framework", F.lit(20.0).alias("a"), F.lit(9.0).alias("b"), F.lit(8.0).alias("c"),
        F.lit(90.0).alias("alpha"), beta.alias("beta"), F.lit(90.0).alias("gamma")))


# -- SQL pieces --------------------------------------------------------------------------------

AXES_SQL = "axes(axis, a) AS (VALUES ('X', 0), ('Y', 1), ('Z', 2))"
OFFS_26 = """offs AS (SELECT di, dj, dk FROM range(-1, 2) a(di), range(-1, 2) b(dj), range(-1, 2) c(dk)
  WHERE NOT (di = 0 AND dj = 0 AND dk = 0))"""
OFFS_6 = """offs AS (SELECT di, dj, dk FROM range(-1, 2) a(di), range(-1, 2) b(dj), range(-1, 2) c(dk)
  WHERE abs(di) + abs(dj) + abs(dk) = 1)"""
# Group sizes and periodic axes.
DM_OPEN = f"dm AS (SELECT framework, 'all' AS axis, {NI} AS ni, {NJ} AS nj, {NK} AS nk, false AS wi, false AS wj, false AS wk FROM (SELECT DISTINCT l_linestatus AS framework FROM lineitem))"
_TILED = f"SELECT framework, axis, {NI} * CASE a WHEN 0 THEN 3 ELSE 1 END AS ni, {NJ} * CASE a WHEN 1 THEN 3 ELSE 1 END AS nj, {NK} * CASE a WHEN 2 THEN 3 ELSE 1 END AS nk"
_FW = "(SELECT DISTINCT l_linestatus AS framework FROM lineitem), axes"
DM_TILED_OPEN = f"dm AS ({_TILED}, false AS wi, false AS wj, false AS wk FROM {_FW})"
DM_TILED_WRAP = f"dm AS ({_TILED}, a <> 0 AS wi, a <> 1 AS wj, a <> 2 AS wk FROM {_FW})"
# One cell: transverse faces wrap, except between a and c of the leaning framework O.
DM_SINGLE = f"""dm AS (SELECT framework, axis, {NI} AS ni, {NJ} AS nj, {NK} AS nk, a <> 0 AND NOT (framework = 'O' AND a = 2) AS wi, a <> 1 AS wj,
  a <> 2 AND NOT (framework = 'O' AND a = 0) AS wk FROM {_FW})"""
# Voxels three times along each axis.
TILE = """nodes AS (
  SELECT framework, axis, (i + CASE a WHEN 0 THEN c.c * 50 ELSE 0 END)::INT AS i, (j + CASE a WHEN 1 THEN c.c * 11 ELSE 0 END)::INT AS j,
         (k + CASE a WHEN 2 THEN c.c * 9 ELSE 0 END)::INT AS k, e FROM {src}, axes, range(0, 3) c(c))"""
_STEP = """(SELECT l.framework, l.axis, CASE WHEN wi THEN (l.i + di + ni) % ni ELSE l.i + di END AS i,
      CASE WHEN wj THEN (l.j + dj + nj) % nj ELSE l.j + dj END AS j, CASE WHEN wk THEN (l.k + dk + nk) % nk ELSE l.k + dk END AS k, {cols}
    FROM {name} l JOIN dm ON dm.framework = l.framework AND dm.axis = l.axis, offs {where}) m
    JOIN recurring.{name} v ON v.framework = m.framework AND v.axis = m.axis AND v.i = m.i AND v.j = m.j AND v.k = m.k"""


def sql_components(name: str = "lab", nodes: str = "nodes") -> str:
    step = _STEP.format(name=name, cols="l.label", where="")
    return f"""{name}(framework, axis, i, j, k, label) USING KEY (framework, axis, i, j, k) AS (
    SELECT framework, axis, i, j, k, (i::BIGINT * nj + j) * nk + k FROM {nodes} JOIN dm USING (framework, axis)
    UNION SELECT v.framework, v.axis, v.i, v.j, v.k, min(m.label) FROM {step} WHERE m.label < v.label GROUP BY ALL)"""


def sql_minimax(start: str, name: str = "mm", nodes: str = "nodes") -> str:
    step = _STEP.format(name=name, cols="l.w", where="WHERE l.w < 1e300")
    return f"""{name}(framework, axis, i, j, k, e, w) USING KEY (framework, axis, i, j, k) AS (
    SELECT framework, axis, i, j, k, e, CASE WHEN {start} THEN e ELSE 1e300 END FROM {nodes} JOIN dm USING (framework, axis)
    UNION SELECT v.framework, v.axis, v.i, v.j, v.k, v.e, min(greatest(m.w, v.e)) FROM {step} WHERE greatest(m.w, v.e) < v.w GROUP BY ALL)"""


_IX = "CASE axis WHEN 'X' THEN i WHEN 'Y' THEN j ELSE k END"
_NX = "CASE axis WHEN 'X' THEN ni WHEN 'Y' THEN nj ELSE nk END"
# Width of the end regions of a tiled axis: a tenth of one cell, at least one voxel.
_BW = f"greatest(1, floor({_NX} // 3 * 0.10::DOUBLE))"
IN_START, IN_END = f"{_IX} < {_BW}", f"{_IX} >= {_NX} - {_BW}"


# -- masks and components ----------------------------------------------------------------------

SQL_DILATED = V_PORE + f""",
grown AS (
  SELECT DISTINCT framework, (i + di)::INT AS i, (j + dj)::INT AS j, (k + dk)::INT AS k
  FROM v_pore, range(-1, 2) a(di), range(-1, 2) b(dj), range(-1, 2) c(dk)
  WHERE i + di BETWEEN 0 AND {NI - 1} AND j + dj BETWEEN 0 AND {NJ - 1} AND k + dk BETWEEN 0 AND {NK - 1})"""


@query("H7 J7", f"WITH {SQL_DILATED} SELECT framework, i, j, k FROM grown")
def dilated_mask(spark, sf_dir):
    rows, dims = voxels(spark, sf_dir)
    return channel.dilate(low_energy(rows), dims)


@query("H1 J7 J14", f"""WITH RECURSIVE {V_PORE}, {AXES_SQL}, {OFFS_26}, {DM_OPEN},
nodes AS (SELECT framework, 'all' AS axis, i, j, k, e FROM v_pore), {sql_components()}
SELECT framework, i, j, k, label FROM lab""")
def pore_components(spark, sf_dir):
    rows, dims = voxels(spark, sf_dir)
    mask = low_energy(rows).select("framework", "i", "j", "k")
    return field.components(mask, channel.open_dims(dims), ["framework"])


_COUNT = "SELECT framework, count(*) AS {name} FROM {lab} JOIN dm USING (framework, axis) WHERE label = (i::BIGINT * nj + j) * nk + k GROUP BY 1"
SQL_SPARSE = V_GRID + """,
bound AS (SELECT framework, quantile_disc(e, 0.06) AS bound FROM v_grid GROUP BY 1),
v_pore AS (SELECT framework, i, j, k, e FROM v_grid JOIN bound USING (framework) WHERE e <= bound)"""


@query("G12 H7", f"""WITH RECURSIVE {SQL_DILATED.replace(V_PORE, SQL_SPARSE)}, {OFFS_26}, {DM_OPEN},
nodes AS (SELECT framework, 'all' AS axis, i, j, k FROM v_pore), grownodes AS (SELECT framework, 'all' AS axis, i, j, k FROM grown),
{sql_components()}, {sql_components('lab2', 'grownodes')},
c1 AS ({_COUNT.format(name='n_before', lab='lab')}), c2 AS ({_COUNT.format(name='n_after', lab='lab2')})
SELECT framework, n_before, n_after, n_before > 2 AND n_after < greatest(1, n_before // 2) AS may_merge FROM c1 JOIN c2 USING (framework)""")
def dilation_report(spark, sf_dir):
    rows, dims = voxels(spark, sf_dir)
    return channel.repair_report(low_energy(rows, 0.06), dims)


SQL_HALF = V_GRID + """,
bound AS (SELECT framework, quantile_disc(e, 0.65) AS bound FROM v_grid GROUP BY 1),
nodes AS (SELECT framework, axis, i, j, k, e FROM v_grid JOIN bound USING (framework), axes WHERE e <= bound)"""


@query("H2 H3 U2", f"""WITH RECURSIVE {AXES_SQL}, {SQL_HALF}, {OFFS_6}, {DM_SINGLE}, {sql_components()},
entry AS (SELECT framework, axis, label FROM lab WHERE {_IX} = 0),
leave AS (SELECT framework, axis, label FROM lab JOIN dm USING (framework, axis) WHERE {_IX} = {_NX} - 1),
hit AS (SELECT DISTINCT framework, axis FROM (SELECT * FROM entry INTERSECT SELECT * FROM leave))
SELECT framework, axis, EXISTS (SELECT 1 FROM hit h WHERE h.framework = dm.framework AND h.axis = dm.axis) AS percolates FROM dm""")
def percolating_axes(spark, sf_dir):
    rows, dims = voxels(spark, sf_dir)
    return channel.percolates(low_energy(rows, 0.65), dims, cells(dims))


# -- limiting diameters ------------------------------------------------------------------------

# Free radius from the energy: e / 10,000 above a probe radius of 2.
def _free(rows):
    return rows.select("framework", "i", "j", "k", (F.col("e") / 10000).alias("r"))


SQL_PLD = f"""WITH RECURSIVE {AXES_SQL}, {V_GRID}, {OFFS_6}, {DM_SINGLE},
nodes AS (SELECT framework, axis, i, j, k, -(e / 10000) AS e FROM v_grid, axes WHERE e / 10000 > 2), {sql_minimax(f'{_IX} = 0')},
pld AS (SELECT framework, axis, min(w) AS w FROM mm JOIN dm USING (framework, axis) WHERE {_IX} = {_NX} - 1 AND w < 1e300 GROUP BY ALL)"""


@query("H4 C7 G14", SQL_PLD + " SELECT framework, axis, round(coalesce(-2 * w, 0), 6) AS pld FROM dm LEFT JOIN pld USING (framework, axis)")
def limiting_diameter(spark, sf_dir):
    rows, dims = voxels(spark, sf_dir)
    out = channel.limiting_diameters(_free(rows), dims, cells(dims), 2.0)
    return out.withColumn("pld", rounded("pld"))


@query("H5 G3 B7", SQL_PLD + """, gcd AS (SELECT framework, round(2 * max(e / 10000), 4) AS gcd FROM v_grid GROUP BY 1)
SELECT framework AS name, any_value(gcd) AS gcd, max(round(coalesce(-2 * w, 0), 4)) FILTER (axis = 'X') AS pld_a,
       max(round(coalesce(-2 * w, 0), 4)) FILTER (axis = 'Y') AS pld_b, max(round(coalesce(-2 * w, 0), 4)) FILTER (axis = 'Z') AS pld_c,
       true AS ok, '' AS error
FROM dm LEFT JOIN pld USING (framework, axis) JOIN gcd USING (framework) GROUP BY framework""")
def pore_size_table(spark, sf_dir):
    rows, dims = voxels(spark, sf_dir)
    return channel.pore_sizes(_free(rows), dims, cells(dims), 2.0)


# -- traversal ---------------------------------------------------------------------------------

# A quarter of the voxels, so that some axes fail.
SQL_QUARTER = V_PORE.replace("quantile_disc(e, 0.3)", "quantile_disc(e, 0.12)")
SQL_TRAVERSE = f"""WITH RECURSIVE {SQL_QUARTER}, {AXES_SQL}, {OFFS_26}, {DM_TILED_OPEN}, {TILE.format(src='v_pore')}, {sql_components()},
parts AS (
  SELECT framework, axis, label, count(*) FILTER ({_IX} < {_NX} // 3) AS f1, count(*) FILTER ({_IX} >= {_NX} // 3 * 2) AS f3
  FROM lab JOIN dm USING (framework, axis) GROUP BY ALL),
trav AS (
  SELECT framework, axis, coalesce(sum(f1) FILTER (f3 > 0), 0) / sum(f1) AS fraction,
         coalesce(sum(f1) FILTER (f3 > 0), 0) > 0 AND coalesce(sum(f1) FILTER (f3 > 0), 0) / sum(f1) >= 0.10 AS traverses
  FROM parts GROUP BY ALL)"""


def _traversal(spark, sf_dir):
    rows, dims = voxels(spark, sf_dir)
    return channel.traversals(low_energy(rows, 0.12), dims)


@query("H6 G13 J9 U2", SQL_TRAVERSE + " SELECT framework, axis, round(fraction, 6) AS fraction, traverses FROM trav")
def axis_traversal(spark, sf_dir):
    return _traversal(spark, sf_dir).withColumn("fraction", rounded("fraction"))


@query("G11", SQL_TRAVERSE + """ SELECT framework, count(*) FILTER (traverses) || 'D' AS dimensionality,
  CASE WHEN bool_or(axis = 'X' AND traverses) THEN 'Yes' ELSE 'No' END AS X, CASE WHEN bool_or(axis = 'Y' AND traverses) THEN 'Yes' ELSE 'No' END AS Y,
  CASE WHEN bool_or(axis = 'Z' AND traverses) THEN 'Yes' ELSE 'No' END AS Z FROM trav GROUP BY 1""")
def channel_dimensionality(spark, sf_dir):
    return channel.dimensionality(_traversal(spark, sf_dir))


# -- barriers and paths ------------------------------------------------------------------------

SQL_CROSS = f"""WITH RECURSIVE {V_PORE}, {AXES_SQL}, {OFFS_26}, {DM_TILED_WRAP}, {TILE.format(src='v_pore')}, {sql_minimax(IN_START)},
energy AS (SELECT framework, axis, min(w) AS te FROM mm JOIN dm USING (framework, axis) WHERE {IN_END} AND w < 1e300 GROUP BY ALL),
low AS (SELECT framework, min(e) AS e_min FROM v_pore GROUP BY 1)"""


@query("H8 C9 J7 J9", SQL_CROSS + """ SELECT framework, axis, te AS transition_energy, te - e_min AS barrier,
  (SELECT count(*) FROM mm WHERE mm.framework = energy.framework AND mm.axis = energy.axis AND w < 1e300) AS n_reached
FROM energy JOIN low USING (framework)""")
def crossing_barrier(spark, sf_dir):
    rows, dims = voxels(spark, sf_dir)
    mask = low_energy(rows)
    reached, energy = channel.crossing_energies(mask, dims)
    low = mask.groupBy("framework").agg(F.min("e").alias("_low"))
    n = reached.filter("w is not null").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_reached"))
    return energy.join(low, "framework").join(n, KEYS).select(
        *KEYS, "transition_energy", (F.col("transition_energy") - F.col("_low")).alias("barrier"), "n_reached")


# Hops along tight edges, parents, and the walk back from the best end voxel.
_HOP_STEP = _STEP.format(name="hp", cols="l.w AS uw, l.h", where="WHERE l.h < 1000000")
SQL_PATH = SQL_CROSS + f""",
useful AS (SELECT mm.* FROM mm JOIN energy USING (framework, axis) WHERE w <= te),
hp(framework, axis, i, j, k, e, w, h) USING KEY (framework, axis, i, j, k) AS (
  SELECT framework, axis, i, j, k, e, w, CASE WHEN {IN_START} THEN 0 ELSE 1000000 END FROM useful JOIN dm USING (framework, axis)
  UNION SELECT v.framework, v.axis, v.i, v.j, v.k, v.e, v.w, min(m.h + 1) FROM {_HOP_STEP}
  WHERE greatest(m.uw, v.e) = v.w AND m.h + 1 < v.h GROUP BY ALL),
num AS (SELECT hp.*, (i::BIGINT * nj + j) * nk + k AS lin FROM hp JOIN dm USING (framework, axis) WHERE h < 1000000),
moves AS (
  SELECT l.framework, l.axis, l.lin AS ulin, l.w AS uw, l.h AS uh, CASE WHEN wi THEN (l.i + di + ni) % ni ELSE l.i + di END AS i,
         CASE WHEN wj THEN (l.j + dj + nj) % nj ELSE l.j + dj END AS j, CASE WHEN wk THEN (l.k + dk + nk) % nk ELSE l.k + dk END AS k
  FROM num l JOIN dm USING (framework, axis), offs),
par AS (
  SELECT n.framework, n.axis, n.lin, arg_min(ulin, {{'w': uw, 'l': ulin}}) AS parent
  FROM num n JOIN moves m ON n.framework = m.framework AND n.axis = m.axis AND n.i = m.i AND n.j = m.j AND n.k = m.k
  WHERE uh + 1 = n.h AND greatest(uw, n.e) = n.w GROUP BY ALL),
tip AS (
  SELECT framework, axis, arg_min(lin, {{'w': w, 'h': h, 'l': lin}}) AS lin FROM num JOIN dm USING (framework, axis)
  WHERE {IN_END} GROUP BY ALL),
walk AS (
  SELECT framework, axis, lin FROM tip
  UNION ALL SELECT w.framework, w.axis, p.parent FROM walk w JOIN par p ON p.framework = w.framework AND p.axis = w.axis AND p.lin = w.lin),
route AS (SELECT framework, axis, h::BIGINT AS seq, i, j, k, e FROM walk JOIN num USING (framework, axis, lin))"""


def _route(rows, dims):
    reached, energy = channel.crossing_energies(low_energy(rows), dims)
    return channel.crossing_paths(reached, energy, dims)


@query("H9", SQL_PATH + " SELECT framework, axis, seq, i, j, k, e FROM route")
def crossing_path(spark, sf_dir):
    return _route(*voxels(spark, sf_dir))


_U = {x: f"sum(CASE WHEN {x} - p{x} > {n} * 0.5 THEN -{n} WHEN {x} - p{x} < -{n} * 0.5 THEN {n} ELSE 0 END) OVER w AS s{x}"
      for x, n in zip("ijk", GRID)}
SQL_CARTESIAN = SQL_PATH + f""",
prev AS (SELECT *, lag(i) OVER w AS pi, lag(j) OVER w AS pj, lag(k) OVER w AS pk FROM route WINDOW w AS (PARTITION BY framework, axis ORDER BY seq)),
flat AS (
  SELECT framework, axis, seq, e, i + CASE WHEN axis = 'X' THEN 0 ELSE si END AS i, j + CASE WHEN axis = 'Y' THEN 0 ELSE sj END AS j,
         k + CASE WHEN axis = 'Z' THEN 0 ELSE sk END AS k
  FROM (SELECT *, {_U['i']}, {_U['j']}, {_U['k']} FROM prev WINDOW w AS (PARTITION BY framework, axis ORDER BY seq ROWS UNBOUNDED PRECEDING))),
ang AS (SELECT *, CASE framework WHEN 'O' THEN cos(radians(80)) ELSE 0 END AS cb FROM flat),
pts AS (
  SELECT framework, axis, seq, e, (i + 0.5::DOUBLE) / {NI} * 20 + (k + 0.5::DOUBLE) / {NK} * 8 * cb AS x, (j + 0.5::DOUBLE) / {NJ} * 9 AS y,
         (k + 0.5::DOUBLE) / {NK} * sqrt(64 - 64 * cb * cb) AS z FROM ang)"""
# The middle third, straightened and repeated, for paths that drift sideways.
SQL_REBUILT = """,
sized AS (SELECT {key}, count(*) AS n, arg_min({{'x': x, 'y': y, 'z': z}}, seq) AS p, arg_max({{'x': x, 'y': y, 'z': z}}, seq) AS q FROM pts GROUP BY ALL),
judged AS (
  SELECT *, n >= 30 AND ((axis <> 'X' AND abs(q.x - p.x) > 0.2 * {la}) OR (axis <> 'Y' AND abs(q.y - p.y) > 0.2 * {lb})
         OR (axis <> 'Z' AND abs(q.z - p.z) > 0.2 * {lc})) AS drifts FROM sized),
mid AS (SELECT pts.*, n, p, seq - n // 3 AS m0 FROM pts JOIN judged USING ({key}) WHERE drifts AND seq >= n // 3 AND seq < 2 * n // 3),
ends2 AS (SELECT {key}, count(*) AS m, arg_min({{'x': x, 'y': y, 'z': z}}, seq) AS u, arg_max({{'x': x, 'y': y, 'z': z}}, seq) AS v FROM mid GROUP BY ALL),
rebuilt AS (
  SELECT {key}, c.c * m + m0 AS seq, e,
    CASE WHEN axis = 'X' THEN x - u.x + p.x + c.c * greatest(v.x - u.x, 1e-6) WHEN abs(v.x - u.x) > 0.05 * {la} THEN x - m0 / (m - 1)::DOUBLE * (v.x - u.x) ELSE x END AS x,
    CASE WHEN axis = 'Y' THEN y - u.y + p.y + c.c * greatest(v.y - u.y, 1e-6) WHEN abs(v.y - u.y) > 0.05 * {lb} THEN y - m0 / (m - 1)::DOUBLE * (v.y - u.y) ELSE y END AS y,
    CASE WHEN axis = 'Z' THEN z - u.z + p.z + c.c * greatest(v.z - u.z, 1e-6) WHEN abs(v.z - u.z) > 0.05 * {lc} THEN z - m0 / (m - 1)::DOUBLE * (v.z - u.z) ELSE z END AS z
  FROM mid JOIN ends2 USING ({key}), range(0, 3) c(c)
  UNION ALL SELECT {key}, seq, e, x, y, z FROM pts JOIN judged USING ({key}) WHERE NOT drifts)"""


@query("H11 W10 W11 W12 W13", SQL_CARTESIAN + SQL_REBUILT.format(key="framework, axis", la=20, lb=9, lc=8) + """
SELECT framework, axis, seq, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, e FROM rebuilt""")
def crossing_path_cartesian(spark, sf_dir):
    rows, dims = voxels(spark, sf_dir)
    route = cut_lineage(_route(rows, dims))
    out = channel.cartesian_paths(route, sequence(route, KEYS), dims, cells(dims))
    return out.select(*KEYS, "seq", *[rounded(c).alias(c) for c in "xyz"], "e")


# Sparse pores, so that some axes need the dilated mask; the axis Y of framework O counts as closed.
SQL_THIN = V_PORE.replace("quantile_disc(e, 0.3)", "quantile_disc(e, 0.03)")
SQL_BARRIERS = f"""WITH RECURSIVE {SQL_DILATED.replace(V_PORE, SQL_THIN)}, {AXES_SQL}, {OFFS_26}, {DM_TILED_WRAP}, {TILE.format(src='v_pore')},
low AS (SELECT framework, min(e) AS e_min FROM v_pore GROUP BY 1),
patched AS (SELECT g.framework, g.i, g.j, g.k, coalesce(p.e, low.e_min + 300) AS e FROM grown g LEFT JOIN v_pore p USING (framework, i, j, k) JOIN low USING (framework)),
{TILE.format(src='patched').replace('nodes AS', 'nodes2 AS')}, {sql_minimax(IN_START)}, {sql_minimax(IN_START, 'mm2', 'nodes2')},
first AS (SELECT framework, axis, min(w) AS te, 'original' AS mask FROM mm JOIN dm USING (framework, axis) WHERE {IN_END} AND w < 1e300 GROUP BY ALL),
second AS (SELECT framework, axis, min(w) AS te, 'repaired' AS mask FROM mm2 JOIN dm USING (framework, axis) WHERE {IN_END} AND w < 1e300 GROUP BY ALL),
best AS (SELECT * FROM first UNION ALL SELECT * FROM second s WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.framework = s.framework AND f.axis = s.axis)),
asked AS (SELECT framework, axis, NOT (framework = 'O' AND axis = 'Y') AS traverses FROM dm)
SELECT framework, axis, traverses, te - e_min AS barrier, te AS transition_energy, e_min AS min_energy,
  CASE WHEN te IS NOT NULL THEN CASE axis WHEN 'X' THEN 20 WHEN 'Y' THEN 9 ELSE 8 END END::DOUBLE AS cell_length, mask,
  CASE WHEN NOT traverses THEN 'not traversing' WHEN te IS NULL THEN 'no path' ELSE 'OK' END AS status
FROM (SELECT asked.*, CASE WHEN traverses THEN best.te END AS te, CASE WHEN traverses THEN best.mask END AS mask
      FROM asked LEFT JOIN best USING (framework, axis)) JOIN low USING (framework)"""


@query("H10 H8 H9", SQL_BARRIERS)
def barrier_records(spark, sf_dir):
    rows, dims = voxels(spark, sf_dir)
    mask = low_energy(rows, 0.03)
    low = mask.groupBy("framework").agg(F.min("e").alias("e_min"))
    traversal = channel.per_axis(dims.select("framework")).withColumn(
        "traverses", ~((F.col("framework") == "O") & (F.col("axis") == "Y")))
    records, _ = channel.barriers(rows, mask.join(low, "framework"), dims, cells(dims), traversal)
    return records.drop("n_path_nodes").withColumn("cell_length", rounded("cell_length"))


# Copies of the pore voxels over the cells that a path touches.
@query("J9", SQL_CARTESIAN + f""",
fr AS (SELECT framework, axis, i + 0.5::DOUBLE AS a, j + 0.5::DOUBLE AS b, k + 0.5::DOUBLE AS c FROM flat),
rng AS (
  SELECT framework, axis, greatest(floor(min(b / {NJ})) - 1, -3)::INT AS lo_fy, least(ceil(max(b / {NJ})) + 1, 4)::INT AS hi_fy,
         greatest(floor(min(c / {NK})) - 1, -3)::INT AS lo_fz, least(ceil(max(c / {NK})) + 1, 4)::INT AS hi_fz FROM fr WHERE axis = 'X' GROUP BY ALL)
SELECT framework, (v.i + t.t * {NI})::INT AS i, (v.j + u.u * {NJ})::INT AS j, (v.k + w.w * {NK})::INT AS k, e
FROM v_pore v JOIN rng USING (framework), range(0, 3) t(t), range(-3, 5) u(u), range(-3, 5) w(w)
WHERE u BETWEEN lo_fy AND hi_fy AND w BETWEEN lo_fz AND hi_fz""")
def tiled_pore_points(spark, sf_dir):
    return _tiled_points(spark, sf_dir).filter("axis = 'X'").drop("axis")


def _tiled_points(spark, sf_dir):
    """Copies along the path of every axis: three cells in its own direction, and those it touches in the others."""
    rows, dims = voxels(spark, sf_dir)
    route = cut_lineage(_route(rows, dims))
    fractions = channel.fractional_paths(route, sequence(route, KEYS), dims)
    ranges = voxel.tile_ranges(fractions)
    placed = low_energy(rows).join(ranges, "framework").join(dims, "framework")
    own = {x: F.col("axis") == axis for x, axis in zip("ijk", "XYZ")}
    ends = dict(zip("ijk", ("fx", "fy", "fz")))
    sizes = {x: F.col(f"n{x}") for x in "ijk"}
    low = {x: F.when(own[x], F.lit(0)).otherwise(F.col(f"lo_{f}")) for x, f in ends.items()}
    high = {x: F.when(own[x], F.lit(2)).otherwise(F.col(f"hi_{f}")) for x, f in ends.items()}
    return voxel.tile(placed, sizes, low, high).select(*KEYS, "i", "j", "k", "e")


_RANGES = ", ".join(f"""CASE axis WHEN '{a}' THEN 0 ELSE greatest(floor(min({c} / {n})) - 1, -3) END::INT AS lo_{f},
         CASE axis WHEN '{a}' THEN 2 ELSE least(ceil(max({c} / {n})) + 1, 4) END::INT AS hi_{f}""" for a, c, n, f in zip("XYZ", "abc", GRID, ("fx", "fy", "fz")))


@query("J9", SQL_CARTESIAN + f""",
fr AS (SELECT framework, axis, i + 0.5::DOUBLE AS a, j + 0.5::DOUBLE AS b, k + 0.5::DOUBLE AS c FROM flat),
rng AS (SELECT framework, axis, {_RANGES} FROM fr GROUP BY framework, axis)
SELECT framework, axis, (v.i + t.t * {NI})::INT AS i, (v.j + u.u * {NJ})::INT AS j, (v.k + w.w * {NK})::INT AS k, e
FROM v_pore v JOIN rng USING (framework), range(-3, 5) t(t), range(-3, 5) u(u), range(-3, 5) w(w)
WHERE t BETWEEN lo_fx AND hi_fx AND u BETWEEN lo_fy AND hi_fy AND w BETWEEN lo_fz AND hi_fz""")
def tiled_pore_points_by_axis(spark, sf_dir):
    return _tiled_points(spark, sf_dir)


@query("S5 S4", f"""WITH {V_PORE}, named AS (SELECT *, framework || '_' || i || '_' || j || '_' || k AS point FROM v_pore)
SELECT point, e FROM named ORDER BY md5(point || '|7'), point LIMIT 1500""")
def sampled_pore_points(spark, sf_dir):
    """A seeded sample of at most 1,500 pore points, as for a figure."""
    named = low_energy(grid(spark, sf_dir)).select(F.concat_ws("_", "framework", "i", "j", "k").alias("point"), "e")
    return assemble.seeded_sample(named, "point", 1500, seed=7)
