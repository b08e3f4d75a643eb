"""Queries over atoms and voxel fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from porescreen.functions import lattice as lat
from porescreen.functions.numbers import rounded
from porescreen.operators import symmetry, voxel
from porescreen.plans.bindings import V_ATOMS, V_GRID, atoms, grid, structures, table
from porescreen.plans.registry import query

SPACING, CUTOFF, MIN_SUPERCELL, GRID_N = 2.0, 6.0, 12.0, 6


def skewed(spark, sf_dir):
    """Structures with angles that depend on the label, for the lattice algebra."""
    s = structures(spark, sf_dir)
    return s.withColumns({"alpha": F.col("a") + 70, "beta": F.col("b") + 65, "gamma": F.col("c") + 55})


V_SKEW = V_ATOMS + """,
skew AS (SELECT framework, a, b, c, a + 70 AS alpha, b + 65 AS beta, c + 55 AS gamma FROM v_struct),
cell AS (
  SELECT *, a AS ax, b * cos(radians(gamma)) AS bx, b * sin(radians(gamma)) AS by_, c * cos(radians(beta)) AS cx,
         c * (cos(radians(alpha)) - cos(radians(beta)) * cos(radians(gamma))) / sin(radians(gamma)) AS cy
  FROM skew),
cell2 AS (SELECT *, sqrt(c * c - cx * cx - cy * cy) AS cz FROM cell)"""


@query("F1 F5", f"""WITH {V_SKEW}
SELECT framework, round(ax, 6) AS ax, round(bx, 6) AS bx, round(by_, 6) AS "by", round(cx, 6) AS cx, round(cy, 6) AS cy,
       round(cz, 6) AS cz, round(ax * by_ * cz, 6) AS volume, round(sqrt(bx * bx + by_ * by_), 6) AS len_b,
       round(by_ * cz * ax / sqrt(by_ * by_ * cz * cz + bx * bx * cz * cz + (bx * cy - by_ * cx) * (bx * cy - by_ * cx)), 6) AS gap_a,
       greatest(1, ceil(28 / ax))::INT AS factor_a, greatest(1, ceil(b / 0.7))::INT AS points_b FROM cell2""")
def cell_matrices(spark, sf_dir):
    cells = lat.with_cell(skewed(spark, sf_dir))
    return cells.select(
        "framework", *[rounded(c).alias(c) for c in ("ax", "bx", "by", "cx", "cy", "cz")],
        rounded(lat.volume()).alias("volume"), rounded(lat.vector_length("b")).alias("len_b"),
        rounded(lat.plane_distance("a")).alias("gap_a"), lat.replication(F.col("ax"), 28.0).alias("factor_a"),
        lat.grid_points(F.col("b"), 0.7).alias("points_b"))


@query("F2 F3 F4 F9", f"""WITH {V_SKEW}, xyz AS (
  SELECT framework, atom_id, fx, fy, fz, fx * ax + fy * bx + fz * cx AS x, fy * by_ + fz * cy AS y, fz * cz AS z
  FROM v_atoms JOIN cell2 USING (framework))
SELECT framework, atom_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(fx, 6) + 0.0 AS back_x,
       round(fy, 6) + 0.0 AS back_y, round(fz, 6) + 0.0 AS back_z, round(3 * fx - 1.5 - floor(3 * fx - 1.5), 6) + 0.0 AS wrapped,
       round(fx - fy - round_even(fx - fy, 0), 6) + 0.0 AS image FROM xyz""")
def cartesian_atoms(spark, sf_dir):
    joined = atoms(spark, sf_dir).join(lat.with_cell(skewed(spark, sf_dir)), "framework")
    xyz = lat.to_cartesian(F.col("fx"), F.col("fy"), F.col("fz"))
    placed = joined.withColumns(dict(zip("xyz", xyz)))
    back = lat.to_fractional(F.col("x"), F.col("y"), F.col("z"))
    return placed.select(
        "framework", "atom_id", *[rounded(c).alias(c) for c in "xyz"],
        *[rounded(v).alias(f"back_{n}") for v, n in zip(back, "xyz")],
        rounded(lat.wrap(3 * F.col("fx") - 1.5)).alias("wrapped"),
        rounded(lat.minimum_image(F.col("fx") - F.col("fy"))).alias("image"))


SQL_LJ = V_ATOMS + f""",
ff(ekey, sigma, eps) AS (VALUES ('o', 0.3304::DOUBLE, 0.442329411::DOUBLE), ('si', 0.2310::DOUBLE, 0.18458107::DOUBLE)),
fac AS (
  SELECT framework, a, b, c, ceil({MIN_SUPERCELL} / a)::INT AS sa, ceil({MIN_SUPERCELL} / b)::INT AS sb, ceil({MIN_SUPERCELL} / c)::INT AS sc
  FROM v_struct),
dims AS (
  SELECT *, ceil(a * sa / 10 / ({SPACING}::DOUBLE / 10))::INT AS ma, ceil(b * sb / 10 / ({SPACING}::DOUBLE / 10))::INT AS mb,
         ceil(c * sc / 10 / ({SPACING}::DOUBLE / 10))::INT AS mc FROM fac),
vox AS (
  SELECT dims.*, i::INT AS i, j::INT AS j, k::INT AS k FROM dims, range(0, 20) r1(i), range(0, 20) r2(j), range(0, 20) r3(k)
  WHERE i < ma // sa AND j < mb // sb AND k < mc // sc),
sup AS (
  SELECT framework, (fx + p) / sa AS gx, (fy + q) / sb AS gy, (fz + r) / sc AS gz, sigma, eps
  FROM v_atoms JOIN fac USING (framework) JOIN ff ON ekey = lower(element), range(0, 2) r1(p), range(0, 2) r2(q), range(0, 2) r3(r)
  WHERE p < sa AND q < sb AND r < sc),
dist AS (
  SELECT v.framework, i, j, k, (sigma + 0.3730::DOUBLE) / 2 AS sm, sqrt(eps * 1.230540467::DOUBLE) AS em,
         sqrt(pow((gx - i / ma::DOUBLE - round_even(gx - i / ma::DOUBLE, 0)) * a * sa / 10, 2)
            + pow((gy - j / mb::DOUBLE - round_even(gy - j / mb::DOUBLE, 0)) * b * sb / 10, 2)
            + pow((gz - k / mc::DOUBLE - round_even(gz - k / mc::DOUBLE, 0)) * c * sc / 10, 2)) AS r
  FROM vox v JOIN sup USING (framework)),
lj AS (
  SELECT framework, i, j, k, CASE WHEN bool_or(r < 0.01) THEN 1000 ELSE least(1000, coalesce(sum(
         CASE WHEN r <= {CUTOFF}::DOUBLE / 10 THEN 4 * em * (pow(sm / r, 12) - pow(sm / r, 6)) END), 0)) END AS e
  FROM dist GROUP BY 1, 2, 3, 4)"""


def energies(spark, sf_dir):
    return voxel.energy_grid(structures(spark, sf_dir), atoms(spark, sf_dir), spacing=SPACING, cutoff=CUTOFF,
                             min_supercell=MIN_SUPERCELL, bin_size=3.0)


@query("J5 G1 J8 F5 F7 F8", f"WITH {SQL_LJ} SELECT framework, i, j, k, round(e, 6) + 0.0 AS e FROM lj")
def pair_energy_grid(spark, sf_dir):
    return energies(spark, sf_dir).withColumn("e", rounded("e"))


@query("C1", f"""WITH {SQL_LJ} SELECT framework, count(*) AS n_valid, round(min(e), 6) + 0.0 AS e_min, round(max(e), 6) + 0.0 AS e_max
FROM lj WHERE e < 1000 GROUP BY 1""")
def valid_energy_range(spark, sf_dir):
    out = voxel.valid_range(energies(spark, sf_dir))
    return out.select("framework", "n_valid", rounded("e_min").alias("e_min"), rounded("e_max").alias("e_max"))


@query("B5 F6", f"""WITH {SQL_LJ}
SELECT lj.framework, lj.i, lj.j, lj.k, round(lj.i / (ma // sa)::DOUBLE * a, 6) AS x, round(lj.j / (mb // sb)::DOUBLE * b, 6) AS y,
       round(lj.k / (mc // sc)::DOUBLE * c, 6) AS z, round(greatest(-1e6, least(200, e)), 6) + 0.0 AS e
FROM lj JOIN dims USING (framework) ORDER BY lj.framework, lj.k, lj.j, lj.i""")
def energy_grid_points(spark, sf_dir):
    cells = voxel.grid_sizes(structures(spark, sf_dir), SPACING, MIN_SUPERCELL)
    points = voxel.point_table(energies(spark, sf_dir), cells, clip=(-1e6, 200.0))
    return points.withColumn("e", rounded("e")).orderBy("framework", "k", "j", "i")


SQL_FREE = V_ATOMS + f""",
img AS (
  SELECT framework, fx + p AS gx, fy + q AS gy, fz + r AS gz, CASE WHEN atom_id % 4 = 1 THEN 1.35 ELSE 1.266 END::DOUBLE AS rad
  FROM v_atoms, range(-1, 2) r1(p), range(-1, 2) r2(q), range(-1, 2) r3(r)),
vox AS (SELECT v_struct.*, i::INT AS i, j::INT AS j, k::INT AS k FROM v_struct, range(0, {GRID_N}) r1(i), range(0, {GRID_N}) r2(j), range(0, {GRID_N}) r3(k)),
near AS (
  SELECT framework, i, j, k, rad, sqrt(pow((gx - (i + 0.5::DOUBLE) / {GRID_N}) * a, 2) + pow((gy - (j + 0.5::DOUBLE) / {GRID_N}) * b, 2)
         + pow((gz - (k + 0.5::DOUBLE) / {GRID_N}) * c, 2)) AS d
  FROM vox JOIN img USING (framework)),
free AS (SELECT framework, i, j, k, min(d) - arg_min(rad, d) AS r FROM near GROUP BY 1, 2, 3, 4)"""


def free_radii(spark, sf_dir):
    """Every fourth atom is of an element without a radius of its own, so the nearest centre need not be the nearest surface."""
    element = F.when(F.col("atom_id") % 4 == 1, F.lit("Ti")).otherwise(F.col("element"))
    return voxel.free_radius_grid(structures(spark, sf_dir), atoms(spark, sf_dir).withColumn("element", element), grid_n=GRID_N)


@query("J6 J8 F6", f"WITH {SQL_FREE} SELECT framework, i, j, k, round(r, 6) + 0.0 AS r FROM free")
def free_radius_field(spark, sf_dir):
    return free_radii(spark, sf_dir).withColumn("r", rounded("r"))


@query("G3 F9", f"WITH {SQL_FREE} SELECT framework, round(2 * max(r), 4) AS gcd FROM free GROUP BY 1")
def largest_cavity_diameter(spark, sf_dir):
    return voxel.largest_cavity(free_radii(spark, sf_dir)).withColumn("gcd", rounded("gcd", 4))


@query("C7 G14", f"""WITH {V_GRID} SELECT DISTINCT framework, e AS r FROM v_grid WHERE e > 30000""")
def free_radius_thresholds(spark, sf_dir):
    return voxel.thresholds(grid(spark, sf_dir).withColumnRenamed("e", "r"), 30000.0)


SQL_MASK = V_GRID + """,
low AS (SELECT framework, min(e) AS e_min FROM v_grid WHERE e < 60000 GROUP BY 1),
mask AS (SELECT v_grid.*, e_min FROM v_grid JOIN low USING (framework) WHERE e >= e_min - 1e-8 AND e <= e_min + 20000)"""


@query("C2", f"WITH {SQL_MASK} SELECT framework, i, j, k, e, e_min FROM mask")
def pore_voxels(spark, sf_dir):
    return voxel.pore_mask(grid(spark, sf_dir), 20000.0, 60000.0)


@query("G2 C2", f"""WITH {SQL_MASK}
SELECT g.framework, max(g.i) + 1 AS n_i, max(g.j) + 1 AS n_j, max(g.k) + 1 AS n_k, any_value(low.e_min) AS e_min,
       count(*) AS n_voxels, count(*) FILTER (g.e >= low.e_min - 1e-8 AND g.e <= low.e_min + 20000) AS n_pore,
       round(100.0 * count(*) FILTER (g.e >= low.e_min - 1e-8 AND g.e <= low.e_min + 20000) / count(*), 6) AS pore_percent, 'OK' AS status
FROM v_grid g JOIN low USING (framework) GROUP BY 1""")
def pore_share(spark, sf_dir):
    out = voxel.pore_statistics(grid(spark, sf_dir), 20000.0, 60000.0)
    return out.withColumn("pore_percent", rounded("pore_percent"))


OPS = ("x, y, z", "-x, -y, -z", "x+1/2, -y, 1/4-z", "-y, x, z+0.75")


def operations(spark, sf_dir):
    """Four operations for every framework of the atom table."""
    per = structures(spark, sf_dir).select("framework", F.posexplode(F.array(*[F.lit(o) for o in OPS])).alias("op_id", "xyz"))
    return symmetry.parse_operations(per)


def symmetric_sites(spark, sf_dir):
    """Atoms snapped to a mesh of 1/16, so that many images coincide."""
    snap = atoms(spark, sf_dir)
    for f in ("fx", "fy", "fz"):
        snap = snap.withColumn(f, F.floor(F.col(f) * 16) / 16 + F.when(F.col("atom_id") % 5 == 0, 0.0004).otherwise(0.0))
    return snap


SQL_OPS = V_ATOMS + """,
snap AS (
  SELECT framework, atom_id, element, floor(fx * 16) / 16 + d AS fx, floor(fy * 16) / 16 + d AS fy, floor(fz * 16) / 16 + d AS fz
  FROM (SELECT *, CASE WHEN atom_id % 5 = 0 THEN 0.0004::DOUBLE ELSE 0 END AS d FROM v_atoms)),
ops AS (
  SELECT framework, atom_id, 0 AS op_id, element, fx AS x, fy AS y, fz AS z FROM snap
  UNION ALL SELECT framework, atom_id, 1, element, -fx, -fy, -fz FROM snap
  UNION ALL SELECT framework, atom_id, 2, element, fx + 0.5::DOUBLE, -fy, 0.25::DOUBLE - fz FROM snap
  UNION ALL SELECT framework, atom_id, 3, element, -fy, fx, fz + 0.75::DOUBLE FROM snap),
moved AS (SELECT framework, atom_id, op_id, element, x - floor(x) AS fx, y - floor(y) AS fy, z - floor(z) AS fz FROM ops)"""


@query("J10 F3", f"""WITH {SQL_OPS} SELECT framework, atom_id, op_id::INT AS op_id, element, round(fx, 6) + 0.0 AS fx, round(fy, 6) + 0.0 AS fy,
       round(fz, 6) + 0.0 AS fz FROM moved""")
def symmetry_images(spark, sf_dir):
    out = symmetry.apply_operations(symmetric_sites(spark, sf_dir), operations(spark, sf_dir))
    return out.select("framework", "atom_id", "op_id", "element", *[rounded(f).alias(f) for f in ("fx", "fy", "fz")])


# A pass over the images in order, as a recursion: one site per step and framework and element.
SQL_KEEP = SQL_OPS + """,
lined AS (SELECT *, row_number() OVER (PARTITION BY framework, element ORDER BY atom_id, op_id) AS n FROM moved),
pass AS (
  SELECT framework, element, 1::BIGINT AS n, [{'x': fx, 'y': fy, 'z': fz, 'n': n}] AS kept FROM lined WHERE n = 1
  UNION ALL
  SELECT p.framework, p.element, l.n,
         CASE WHEN len(list_filter(p.kept, lambda s: abs(s.x - l.fx) < 1e-3 AND abs(s.y - l.fy) < 1e-3 AND abs(s.z - l.fz) < 1e-3)) > 0
              THEN p.kept ELSE list_append(p.kept, {'x': l.fx, 'y': l.fy, 'z': l.fz, 'n': l.n}) END
  FROM pass p JOIN lined l ON l.framework = p.framework AND l.element = p.element AND l.n = p.n + 1),
final AS (SELECT framework, element, unnest(arg_max(kept, n)).n AS n FROM pass GROUP BY 1, 2)"""


@query("J11", f"""WITH RECURSIVE {SQL_KEEP}
SELECT framework, element, atom_id, op_id::INT AS op_id, round(fx, 6) + 0.0 AS fx, round(fy, 6) + 0.0 AS fy, round(fz, 6) + 0.0 AS fz
FROM final JOIN lined USING (framework, element, n)""")
def distinct_sites(spark, sf_dir):
    images = symmetry.apply_operations(symmetric_sites(spark, sf_dir), operations(spark, sf_dir))
    out = symmetry.drop_coinciding(images, ["atom_id", "op_id"])
    return out.select("framework", "element", "atom_id", "op_id", *[rounded(f).alias(f) for f in ("fx", "fy", "fz")])
