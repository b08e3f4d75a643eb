"""Queries over ordered paths."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from porescreen.functions.numbers import rounded
from porescreen.operators import ordered, sequence as sq
from porescreen.operators.ordered import Sequence, number_rows
from porescreen.plans.bindings import PATH_KEYS, V_CLEAN, V_PATH, V_STEPS, paths, table
from porescreen.plans.registry import query

def axis_of_user():
    """Direction of a path, for the operators that need one."""
    return F.element_at(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")), (F.col("user_id") % 3 + 1).cast("int"))


SQL_AXIS = "['X','Y','Z'][(user_id % 3 + 1)::INT]"


def clean_paths(spark, sf_dir):
    path, seq = paths(spark, sf_dir)
    clean = sq.drop_repeated_points(path, seq)
    kept = ordered.group_values(clean, seq, {"_n": F.count(F.lit(1))})
    return kept.filter(F.col("_n") >= sq.MIN_NODES).drop("_n"), seq


@query("W1", f"""WITH {V_CLEAN}
SELECT user_id, seq, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, e FROM renumbered""")
def path_without_repeats(spark, sf_dir):
    path, seq = paths(spark, sf_dir)
    clean = sq.drop_repeated_points(path, seq)
    return clean.select("user_id", "seq", *[rounded(c).alias(c) for c in "xyz"], "e")


@query("W2", f"""WITH {V_STEPS}
SELECT user_id, seq, round(ds, 6) + 0.0 AS ds, round(s, 6) + 0.0 AS s, round(e_mid, 6) + 0.0 AS e_mid FROM steps""")
def path_arc_length(spark, sf_dir):
    path, seq = clean_paths(spark, sf_dir)
    return sq.segment_lengths(path, seq).select(
        "user_id", "seq", *[rounded(c).alias(c) for c in ("ds", "s", "e_mid")])


SQL_SPREAD = V_STEPS + """,
totals AS (SELECT user_id, sum(ds) AS total, sum(ds * e_mid) / sum(ds) AS mean FROM steps GROUP BY 1),
spread AS (
  SELECT user_id, count(*) AS n_nodes, max(s) AS length, min(e) AS e_min, max(e) AS e_max,
         max(e) - min(e) AS e_range, max(mean) AS e_mean,
         sqrt(sum(ds / total * (e_mid - mean) * (e_mid - mean))) AS sigma_e
  FROM steps JOIN totals USING (user_id) GROUP BY 1)"""


@query("G4 G5", f"""WITH {SQL_SPREAD}
SELECT user_id, n_nodes, round(length, 6) AS length, e_min, e_max, round(e_range, 6) AS e_range,
       round(e_mean, 6) AS e_mean, round(sigma_e, 6) AS sigma_e FROM spread""")
def path_energy_spread(spark, sf_dir):
    path, seq = clean_paths(spark, sf_dir)
    out = sq.energy_spread(path, seq)
    return out.select("user_id", "n_nodes", rounded("length").alias("length"), "e_min", "e_max",
                      *[rounded(c).alias(c) for c in ("e_range", "e_mean", "sigma_e")])


SQL_GEOMETRY = """
ends AS (
  SELECT user_id, max(s) AS length, arg_max(x, seq) - arg_min(x, seq) AS dx,
         arg_max(y, seq) - arg_min(y, seq) AS dy, arg_max(z, seq) - arg_min(z, seq) AS dz
  FROM steps GROUP BY 1),
shape AS (
  SELECT user_id, length, sqrt(dx*dx + dy*dy + dz*dz) AS chord,
         length / greatest(sqrt(dx*dx + dy*dy + dz*dz), 1e-6) AS tortuosity,
         abs(CASE user_id % 3 WHEN 0 THEN dx WHEN 1 THEN dy ELSE dz END) / greatest(length, 1e-6) AS eta_main
  FROM ends)"""


@query("G10", f"""WITH {V_STEPS}, {SQL_GEOMETRY}
SELECT user_id, round(length, 6) AS length, round(chord, 6) AS chord, round(tortuosity, 6) AS tortuosity,
       round(eta_main, 6) AS eta_main FROM shape""")
def path_tortuosity(spark, sf_dir):
    path, seq = clean_paths(spark, sf_dir)
    out = sq.path_geometry(path, seq, axis_of_user())
    return out.select("user_id", *[rounded(c).alias(c) for c in ("length", "chord", "tortuosity", "eta_main")])


SQL_JUMPS = """
diffs AS (
  SELECT user_id, seq, e, n, abs(lead(e) OVER (PARTITION BY user_id ORDER BY seq) - e) AS d_e FROM clean),
meds AS (SELECT user_id, median(d_e) AS med FROM diffs GROUP BY 1),
mads AS (SELECT user_id, any_value(med) AS med, median(abs(d_e - med)) AS mad FROM diffs JOIN meds USING (user_id) GROUP BY 1),
jumps AS (
  SELECT user_id, seq, e, n, d_e, med, mad, coalesce(mad >= 1e-10 AND d_e > med + {factor} * mad, false) AS jump
  FROM diffs JOIN mads USING (user_id))"""


@query("G6 W3", f"""WITH {V_CLEAN}, {SQL_JUMPS.format(factor='5.0')}
SELECT user_id, seq, round(d_e, 6) AS d_e, round(med, 6) AS med, round(mad, 6) AS mad, jump FROM jumps""")
def path_step_outliers(spark, sf_dir):
    path, seq = clean_paths(spark, sf_dir)
    return sq.step_outliers(path, seq).select(
        "user_id", "seq", *[rounded(c).alias(c) for c in ("d_e", "med", "mad")], "jump")


SQL_GROUPS = """
jp AS (SELECT user_id, seq AS jx, lag(seq) OVER (PARTITION BY user_id ORDER BY seq) AS prev FROM jumps WHERE jump),
marked AS (
  SELECT user_id, jx, sum(CASE WHEN prev IS NULL OR jx - prev > 2 THEN 1 ELSE 0 END)
         OVER (PARTITION BY user_id ORDER BY jx) AS group_no FROM jp),
grp AS (SELECT user_id, group_no::BIGINT AS group_no, min(jx) AS lft, max(jx) + 1 AS rgt FROM marked GROUP BY 1, 2)"""


# The data has few outliers at factor 5, so these two queries lower it to 1.5.
@query("W4", f"""WITH {V_CLEAN}, {SQL_JUMPS.format(factor='1.5')}, {SQL_GROUPS}
SELECT user_id, group_no, lft AS "left", rgt AS "right" FROM grp""")
def path_jump_groups(spark, sf_dir):
    path, seq = clean_paths(spark, sf_dir)
    return sq.jump_groups(sq.step_outliers(path, seq, mad_factor=1.5), seq)


# Sequential repair as a recursion over group numbers on whole energy lists.
SQL_REPAIR = """
lists AS (SELECT user_id, list(e ORDER BY seq) AS raw FROM clean GROUP BY 1),
fix AS (
  SELECT user_id, 0::BIGINT AS g, raw AS es FROM lists
  UNION ALL
  SELECT f.user_id, f.g + 1,
         list_transform(range(1, len(f.es) + 1), lambda p:
           CASE WHEN p - 1 >= q.lft AND p - 1 < q.rgt THEN
             coalesce(list_avg(f.es[greatest(q.lft - 3, 0) + 1 : q.lft]), f.es[q.lft + 1])
               * (1.0 - (p - q.lft) / (q.rgt - q.lft + 1)::DOUBLE)
             + coalesce(list_avg(f.es[q.rgt + 2 : q.rgt + 4]), f.es[q.rgt + 1])
               * ((p - q.lft) / (q.rgt - q.lft + 1)::DOUBLE)
           ELSE f.es[p] END)
  FROM fix f JOIN grp q ON q.user_id = f.user_id AND q.group_no = f.g + 1),
fixed AS (SELECT user_id, arg_max(es, g) AS es FROM fix GROUP BY 1),
repaired AS (
  SELECT c.user_id, c.seq, c.e, c.x, c.y, c.z, c.n, f.es[c.seq + 1] AS e_smooth
  FROM clean c JOIN fixed f USING (user_id))"""


@query("W5", f"""WITH RECURSIVE {V_CLEAN}, {SQL_JUMPS.format(factor='1.5')}, {SQL_GROUPS}, {SQL_REPAIR}
SELECT user_id, seq, e, round(e_smooth, 6) + 0.0 AS e_smooth FROM repaired""")
def path_jump_repair(spark, sf_dir):
    path, seq = clean_paths(spark, sf_dir)
    return sq.repair_jumps(path, seq, mad_factor=1.5).select("user_id", "seq", "e", rounded("e_smooth").alias("e_smooth"))


SQL_RUNS = """
chg AS (SELECT user_id, seq, {v} AS v, n, lag({v}) OVER (PARTITION BY user_id ORDER BY seq) AS pv FROM {src}),
runs AS (
  SELECT user_id, seq AS l, v, lag(v) OVER w AS lo, lead(v) OVER w AS hi, lead(seq) OVER w - 1 AS r
  FROM chg WHERE pv IS NULL OR pv <> v WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
tops AS (
  SELECT user_id, (l + r) // 2 AS idx, v, l, CASE WHEN v > lo AND v > hi THEN 'peak' ELSE 'valley' END AS kind
  FROM runs WHERE (v > lo AND v > hi) OR (v < lo AND v < hi)),
signed AS (SELECT *, CASE kind WHEN 'peak' THEN 1 ELSE -1 END AS sg FROM tops),
stops AS (
  SELECT t.user_id, t.idx, t.l, t.v, t.kind, t.sg,
         coalesce(max(CASE WHEN r.l < t.l AND t.sg * r.v > t.sg * t.v THEN r.l END), -1) AS lb,
         coalesce(min(CASE WHEN r.l > t.l AND t.sg * r.v > t.sg * t.v THEN r.l END), 1000000000) AS rb
  FROM signed t JOIN runs r USING (user_id) GROUP BY ALL),
prom AS (
  SELECT t.user_id, t.idx, t.v AS height, t.kind,
         t.sg * t.v - greatest(min(t.sg * r.v) FILTER (r.l > lb AND r.l <= t.l),
                               min(t.sg * r.v) FILTER (r.l < rb AND r.l >= t.l)) AS prominence
  FROM stops t JOIN runs r USING (user_id) GROUP BY t.user_id, t.idx, t.v, t.kind, t.sg)"""


@query("W6 W7", f"""WITH {V_CLEAN}, {SQL_RUNS.format(v='e', src='clean')}
SELECT user_id, idx, kind, height, round(prominence, 6) AS prominence FROM prom WHERE prominence >= 3""")
def path_extremes(spark, sf_dir):
    path, seq = clean_paths(spark, sf_dir)
    out = sq.extremes(path, seq, "e")
    return out.select("user_id", "idx", "kind", "height", rounded("prominence").alias("prominence"))


#: Two paths over all events, so that the higher value of an extreme often lies many blocks away.
TWO_PATHS = """
clean AS (
  SELECT user_id % 2 AS user_id, row_number() OVER (PARTITION BY user_id % 2 ORDER BY ts, event_id) - 1 AS seq,
         value AS e, 0 AS n FROM events)"""
IN_BLOCKS = 64


@query("W6 W7", f"""WITH {TWO_PATHS}, {SQL_RUNS.format(v='e', src='clean')}
SELECT user_id, idx, kind, height, round(prominence, 6) AS prominence FROM prom WHERE prominence >= 3""")
def path_extremes_in_blocks(spark, sf_dir):
    """Two paths over all events, cut into blocks of 64 nodes: the tree of block summaries finds the higher values."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("user_id"), "ts", "event_id", F.col("value").alias("e"))
    numbered, _ = number_rows(rows, ["user_id"], ["ts", "event_id"])
    out = sq.extremes(numbered.select("user_id", "seq", "e"), Sequence(("user_id",), "seq", IN_BLOCKS, True), "e")
    return out.select("user_id", "idx", "kind", "height", rounded("prominence").alias("prominence"))


SQL_SLOPES = """
found AS (SELECT * FROM prom WHERE prominence >= 3),
pk AS (
  SELECT p.user_id, p.idx AS peak_idx,
         coalesce((SELECT max(v.idx) FROM found v WHERE v.user_id = p.user_id AND v.kind = 'valley' AND v.idx < p.idx), 0) AS left_idx,
         coalesce((SELECT min(v.idx) FROM found v WHERE v.user_id = p.user_id AND v.kind = 'valley' AND v.idx > p.idx),
                  (SELECT max(seq) FROM clean c WHERE c.user_id = p.user_id)) AS right_idx
  FROM found p WHERE p.kind = 'peak'),
flank AS (
  SELECT pk.*, greatest(
    (p.e - l.e) / greatest(sqrt((p.x-l.x)*(p.x-l.x) + (p.y-l.y)*(p.y-l.y) + (p.z-l.z)*(p.z-l.z)), 1e-6),
    (p.e - r.e) / greatest(sqrt((p.x-r.x)*(p.x-r.x) + (p.y-r.y)*(p.y-r.y) + (p.z-r.z)*(p.z-r.z)), 1e-6)) AS slope
  FROM pk JOIN clean p ON p.user_id = pk.user_id AND p.seq = peak_idx
  JOIN clean l ON l.user_id = pk.user_id AND l.seq = left_idx
  JOIN clean r ON r.user_id = pk.user_id AND r.seq = right_idx)"""


@query("W8 W9", f"""WITH {V_CLEAN}, {SQL_RUNS.format(v='e', src='clean')}, {SQL_SLOPES}
SELECT user_id, peak_idx, left_idx, right_idx, round(slope, 6) AS slope FROM flank""")
def path_flank_slopes(spark, sf_dir):
    path, seq = clean_paths(spark, sf_dir)
    found = sq.extremes(path, seq, "e")
    out = sq.flank_slopes(path, seq, found)
    return out.select("user_id", "peak_idx", "left_idx", "right_idx", rounded("slope").alias("slope"))


SQL_ENTROPY = """
span AS (
  SELECT user_id, count(*) AS n_nodes, min(e) AS lo, max(e) AS hi,
         least(20, greatest(5, count(*) // 5)) AS bins FROM clean GROUP BY 1),
cells AS (
  SELECT user_id, least(floor((e - lo) / (hi - lo) * bins), bins - 1) AS cell, count(*) AS c
  FROM clean JOIN span USING (user_id) WHERE hi - lo > 0.1 GROUP BY 1, 2),
dens AS (SELECT user_id, c / (n_nodes * ((hi - lo) / bins)) AS h, (hi - lo) / bins AS w FROM cells JOIN span USING (user_id)),
ent AS (SELECT user_id, -sum(h * ln(h + 1e-30) * w) AS ent FROM dens GROUP BY 1),
entropy AS (SELECT user_id, n_nodes, bins, coalesce(ent, 0) AS h_entropy FROM span LEFT JOIN ent USING (user_id))"""


@query("G7", f"""WITH {V_CLEAN}, {SQL_ENTROPY}
SELECT user_id, n_nodes, bins::INT AS bins, round(h_entropy, 6) AS h_entropy FROM entropy""")
def path_energy_entropy(spark, sf_dir):
    path, seq = clean_paths(spark, sf_dir)
    out = sq.energy_entropy(path, PATH_KEYS)
    return out.select("user_id", "n_nodes", "bins", rounded("h_entropy").alias("h_entropy"))


SQL_DESCRIBE = f"""WITH RECURSIVE {SQL_SPREAD}, {SQL_GEOMETRY}, {SQL_ENTROPY},
{SQL_JUMPS.format(factor='5.0')}, {SQL_GROUPS}, {SQL_REPAIR},
{SQL_RUNS.format(v='e_smooth', src='repaired')}, {SQL_SLOPES},
density AS (SELECT user_id, count(*) AS n_peaks, avg(slope) AS slope FROM flank GROUP BY 1),
described AS (
  SELECT u.user_id, e_max, sigma_e, coalesce(n_peaks, 0) / greatest(s.length, 1e-6) AS barrier_freq,
         coalesce(slope, 0) AS peak_slope_mean, tortuosity, eta_main, h_entropy
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN spread s USING (user_id)
  LEFT JOIN shape USING (user_id) LEFT JOIN entropy USING (user_id) LEFT JOIN density USING (user_id))"""


@query("G8 G9 G4 G5 G7 G10", SQL_DESCRIBE + """
SELECT user_id, e_max, round(sigma_e, 6) AS sigma_e, round(barrier_freq, 6) AS barrier_freq,
       round(peak_slope_mean, 6) + 0.0 AS peak_slope_mean, round(tortuosity, 6) AS tortuosity,
       round(eta_main, 6) AS eta_main, round(h_entropy, 6) AS h_entropy FROM described""")
def path_descriptors(spark, sf_dir):
    path, seq = paths(spark, sf_dir)
    out = sq.describe_paths(path, seq, axis_of_user())
    return out.select("user_id", "e_max", *[rounded(c).alias(c) for c in (
        "sigma_e", "barrier_freq", "peak_slope_mean", "tortuosity", "eta_main", "h_entropy")])
