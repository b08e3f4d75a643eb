"""Voxel graphs of many frameworks, cut into small bricks, so that borders are contracted and paths cross several bricks."""

from __future__ import annotations

from pyspark.sql import functions as F

from porescreen.functions import lattice as lat
from porescreen.functions.numbers import rounded
from porescreen.operators import channel, field
from porescreen.plans.bindings import V_SUPPLIER, low_energy, supplier_grid
from porescreen.plans.channel_queries import AXES_SQL, IN_END, IN_START, OFFS_6, OFFS_26, _IX, _NX, _STEP, sql_components, sql_minimax
from porescreen.plans.registry import query
from porescreen.session import cut_lineage

KEYS = channel.KEYS
#: Bricks of a hundred voxels; border graphs of more than ``room`` edges take rounds.
SMALL = {"volume": 100, "edge": 6, "room": 128}
#: Bricks for paths, whose hops take a round per crossing.
LONG = {"volume": 1200, "edge": 16, "room": 512}


def _voxels(spark, sf_dir):
    voxels, dims = supplier_grid(spark, sf_dir)
    return cut_lineage(voxels), cut_lineage(dims)


def _cells(dims):
    """Cells of 20 x 9 x 8; in every third framework the vector c leans towards a."""
    leaning = F.substring("framework", 2, 20).cast("long") % 3 == 0
    return lat.with_cell(dims.select(
        "framework", F.lit(20.0).alias("a"), F.lit(9.0).alias("b"), F.lit(8.0).alias("c"), F.lit(90.0).alias("alpha"),
        F.when(leaning, 80.0).otherwise(90.0).alias("beta"), F.lit(90.0).alias("gamma")))


def _pores(share: float) -> str:
    return f"""{V_SUPPLIER},
bound AS (SELECT framework, quantile_disc(e, {share}) AS bound FROM v_grid GROUP BY 1),
v_pore AS (SELECT framework, i, j, k, e FROM v_grid JOIN bound USING (framework) WHERE e <= bound)"""


_LEANS = "CAST(framework[2:] AS BIGINT) % 3 = 0"
DM_OPEN = "dm AS (SELECT framework, 'all' AS axis, ni, nj, nk, false AS wi, false AS wj, false AS wk FROM sd)"
DM_SINGLE = f"""dm AS (SELECT framework, axis, ni, nj, nk, a <> 0 AND NOT ({_LEANS} AND a = 2) AS wi, a <> 1 AS wj,
  a <> 2 AND NOT ({_LEANS} AND a = 0) AS wk FROM sd, axes)"""
_TILED = """dm AS (SELECT framework, axis, ni * CASE a WHEN 0 THEN 3 ELSE 1 END AS ni, nj * CASE a WHEN 1 THEN 3 ELSE 1 END AS nj,
  nk * CASE a WHEN 2 THEN 3 ELSE 1 END AS nk, {wraps} FROM sd, axes)"""
DM_TILED_OPEN = _TILED.format(wraps="false AS wi, false AS wj, false AS wk")
DM_TILED_WRAP = _TILED.format(wraps="a <> 0 AS wi, a <> 1 AS wj, a <> 2 AS wk")
TILE = """{name} AS (
  SELECT framework, axis, (i + CASE a WHEN 0 THEN c.c * ni ELSE 0 END)::INT AS i, (j + CASE a WHEN 1 THEN c.c * nj ELSE 0 END)::INT AS j,
         (k + CASE a WHEN 2 THEN c.c * nk ELSE 0 END)::INT AS k, e FROM {src} JOIN sd USING (framework), axes, range(0, 3) c(c))"""


@query("H1 J7 J14", f"""WITH RECURSIVE {_pores(0.4)}, {OFFS_26}, {DM_OPEN},
nodes AS (SELECT framework, 'all' AS axis, i, j, k, e FROM v_pore), {sql_components()}
SELECT framework, i, j, k, label FROM lab""")
def supplier_components(spark, sf_dir):
    voxels, dims = _voxels(spark, sf_dir)
    return field.components(low_energy(voxels, 0.4), channel.open_dims(dims), ["framework"], **SMALL)


@query("H2 H3 U2", f"""WITH RECURSIVE {AXES_SQL}, {_pores(0.7)}, {OFFS_6}, {DM_SINGLE},
nodes AS (SELECT framework, axis, i, j, k, e FROM v_pore, axes), {sql_components()},
ends AS (SELECT framework, axis, label, bool_or({_IX} = 0) AS a, bool_or({_IX} = {_NX} - 1) AS b FROM lab JOIN dm USING (framework, axis) GROUP BY ALL)
SELECT framework, axis, coalesce(bool_or(a AND b), false) AS percolates FROM dm LEFT JOIN ends USING (framework, axis) GROUP BY ALL""")
def supplier_percolation(spark, sf_dir):
    voxels, dims = _voxels(spark, sf_dir)
    return channel.percolates(low_energy(voxels, 0.7), dims, _cells(dims), **SMALL)


@query("H4 H5 C7 G14", f"""WITH RECURSIVE {AXES_SQL}, {V_SUPPLIER}, {OFFS_6}, {DM_SINGLE},
nodes AS (SELECT framework, axis, i, j, k, -(e / 10000) AS e FROM v_grid, axes WHERE e / 10000 > 2), {sql_minimax(f'{_IX} = 0')},
pld AS (SELECT framework, axis, min(w) AS w FROM mm JOIN dm USING (framework, axis) WHERE {_IX} = {_NX} - 1 AND w < 1e300 GROUP BY ALL),
gcd AS (SELECT framework, round(2 * max(e / 10000), 4) AS gcd FROM v_grid GROUP BY 1)
SELECT framework AS name, any_value(gcd) AS gcd, max(round(coalesce(-2 * w, 0), 4)) FILTER (axis = 'X') AS pld_a,
       max(round(coalesce(-2 * w, 0), 4)) FILTER (axis = 'Y') AS pld_b, max(round(coalesce(-2 * w, 0), 4)) FILTER (axis = 'Z') AS pld_c,
       true AS ok, '' AS error
FROM dm LEFT JOIN pld USING (framework, axis) JOIN gcd USING (framework) GROUP BY framework""")
def supplier_pore_sizes(spark, sf_dir):
    voxels, dims = _voxels(spark, sf_dir)
    radii = voxels.select("framework", "i", "j", "k", (F.col("e") / 10000).alias("r"))
    return channel.pore_sizes(radii, dims, _cells(dims), 2.0, **SMALL)


@query("H6 G13 J9", f"""WITH RECURSIVE {_pores(0.2)}, {AXES_SQL}, {OFFS_26}, {DM_TILED_OPEN}, {TILE.format(name='nodes', src='v_pore')},
{sql_components()},
parts AS (
  SELECT framework, axis, label, count(*) FILTER ({_IX} < {_NX} // 3) AS f1, count(*) FILTER ({_IX} >= {_NX} // 3 * 2) AS f3
  FROM lab JOIN dm USING (framework, axis) GROUP BY ALL)
SELECT framework, axis, round(coalesce(sum(f1) FILTER (f3 > 0), 0) / sum(f1), 6) AS fraction,
       coalesce(sum(f1) FILTER (f3 > 0), 0) > 0 AND coalesce(sum(f1) FILTER (f3 > 0), 0) / sum(f1) >= 0.10 AS traverses
FROM parts GROUP BY ALL""")
def supplier_traversal(spark, sf_dir):
    voxels, dims = _voxels(spark, sf_dir)
    return channel.traversals(low_energy(voxels, 0.2), dims, **SMALL).withColumn("fraction", rounded("fraction"))


@query("G12 H7", f"""WITH RECURSIVE {_pores(0.1)}, {OFFS_26}, {DM_OPEN},
grown AS (SELECT DISTINCT framework, (i + di)::INT AS i, (j + dj)::INT AS j, (k + dk)::INT AS k
  FROM v_pore JOIN sd USING (framework), range(-1, 2) a(di), range(-1, 2) b(dj), range(-1, 2) c(dk)
  WHERE i + di BETWEEN 0 AND ni - 1 AND j + dj BETWEEN 0 AND nj - 1 AND k + dk BETWEEN 0 AND nk - 1),
nodes AS (SELECT framework, 'all' AS axis, i, j, k FROM v_pore), grownodes AS (SELECT framework, 'all' AS axis, i, j, k FROM grown),
{sql_components()}, {sql_components('lab2', 'grownodes')},
c1 AS (SELECT framework, count(*) AS n_before FROM lab JOIN dm USING (framework, axis) WHERE label = (i::BIGINT * nj + j) * nk + k GROUP BY 1),
c2 AS (SELECT framework, count(*) AS n_after FROM lab2 JOIN dm USING (framework, axis) WHERE label = (i::BIGINT * nj + j) * nk + k GROUP BY 1)
SELECT framework, n_before, n_after, n_before > 2 AND n_after < greatest(1, n_before // 2) AS may_merge FROM c1 JOIN c2 USING (framework)""")
def supplier_dilation(spark, sf_dir):
    voxels, dims = _voxels(spark, sf_dir)
    return channel.repair_report(low_energy(voxels, 0.1), dims, **SMALL)


def _sql_search(k: str, nodes: str) -> str:
    """Minimax values, hops along tight edges, and the best end voxel of every axis with its number of path nodes."""
    step = _STEP.format(name=f"hp{k}", cols="l.w AS uw, l.h", where="WHERE l.h < 1000000")
    return f"""{sql_minimax(IN_START, f'mm{k}', nodes)},
energy{k} AS (SELECT framework, axis, min(w) AS te FROM mm{k} JOIN dm USING (framework, axis) WHERE {IN_END} AND w < 1e300 GROUP BY ALL),
useful{k} AS (SELECT m.* FROM mm{k} m JOIN energy{k} USING (framework, axis) WHERE w <= te),
hp{k}(framework, axis, i, j, k, e, w, h) USING KEY (framework, axis, i, j, k) AS (
  SELECT framework, axis, i, j, k, e, w, CASE WHEN {IN_START} THEN 0 ELSE 1000000 END FROM useful{k} JOIN dm USING (framework, axis)
  UNION SELECT v.framework, v.axis, v.i, v.j, v.k, v.e, v.w, min(m.h + 1) FROM {step}
  WHERE greatest(m.uw, v.e) = v.w AND m.h + 1 < v.h GROUP BY ALL),
tip{k} AS (
  SELECT framework, axis, min({{'w': w, 'h': h}}) AS tip FROM hp{k} JOIN dm USING (framework, axis) WHERE {IN_END} AND h < 1000000 GROUP BY ALL),
path{k} AS (SELECT framework, axis, tip.w AS te, tip.h + 1 AS n FROM tip{k} WHERE tip.h + 1 >= 5)"""


SQL_RECORDS = f"""WITH RECURSIVE {_pores(0.06)}, {AXES_SQL}, {OFFS_26}, {DM_TILED_WRAP},
low AS (SELECT framework, min(e) AS e_min FROM v_pore GROUP BY 1),
grown AS (SELECT DISTINCT framework, (i + di)::INT AS i, (j + dj)::INT AS j, (k + dk)::INT AS k
  FROM v_pore JOIN sd USING (framework), range(-1, 2) a(di), range(-1, 2) b(dj), range(-1, 2) c(dk)
  WHERE i + di BETWEEN 0 AND ni - 1 AND j + dj BETWEEN 0 AND nj - 1 AND k + dk BETWEEN 0 AND nk - 1),
patched AS (SELECT g.framework, g.i, g.j, g.k, coalesce(p.e, low.e_min + 300) AS e FROM grown g LEFT JOIN v_pore p USING (framework, i, j, k) JOIN low USING (framework)),
{TILE.format(name='nodes', src='v_pore')}, {TILE.format(name='nodes2', src='patched')},
{_sql_search('', 'nodes')}, {_sql_search('2', 'nodes2')},
best AS (SELECT *, 'original' AS mask FROM path UNION ALL
  SELECT *, 'repaired' FROM path2 s WHERE NOT EXISTS (SELECT 1 FROM path f WHERE f.framework = s.framework AND f.axis = s.axis)),
asked AS (SELECT framework, axis, NOT (CAST(framework[2:] AS BIGINT) % 4 = 0 AND axis = 'Y') AS traverses FROM dm)
SELECT framework, axis, traverses, te - e_min AS barrier, te AS transition_energy, e_min AS min_energy,
  CASE WHEN te IS NOT NULL THEN CASE axis WHEN 'X' THEN 20 WHEN 'Y' THEN 9 ELSE 8 END END::DOUBLE AS cell_length,
  CAST(coalesce(n, 0) AS BIGINT) AS n_path_nodes, mask,
  CASE WHEN NOT traverses THEN 'not traversing' WHEN te IS NULL THEN 'no path' ELSE 'OK' END AS status
FROM (SELECT asked.*, CASE WHEN traverses THEN best.te END AS te, CASE WHEN traverses THEN best.mask END AS mask, CASE WHEN traverses THEN n END AS n
      FROM asked LEFT JOIN best USING (framework, axis)) JOIN low USING (framework)"""


@query("H8 H9 H10", SQL_RECORDS)
def supplier_barriers(spark, sf_dir):
    """Thin pores: some axes need the dilated mask, and flat frameworks have paths of too few nodes."""
    voxels, dims = _voxels(spark, sf_dir)
    mask = cut_lineage(low_energy(voxels, 0.06))
    low = mask.groupBy("framework").agg(F.min("e").alias("e_min"))
    number = F.substring("framework", 2, 20).cast("long")
    asked = channel.per_axis(dims.select("framework")).withColumn("traverses", ~((number % 4 == 0) & (F.col("axis") == "Y")))
    records, _ = channel.barriers(voxels, cut_lineage(mask.join(low, "framework")), dims, _cells(dims), asked, **LONG)
    return records.withColumn("cell_length", rounded("cell_length"))
