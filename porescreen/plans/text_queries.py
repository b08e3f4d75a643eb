"""Queries over structure, path, trajectory and message text derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from porescreen.functions import names
from porescreen.functions.numbers import rounded
from porescreen.operators import assemble as asm, report, sequence as sq
from porescreen.operators.ordered import Sequence, running_sum
from porescreen.plans.assemble_queries import SQL_AXIS, _axis_results
from porescreen.plans.bindings import V_ATOMS, V_FEAT, V_PATH, atoms, features, paths, structures, table
from porescreen.plans.registry import query
from porescreen.plans.score_queries import FEATURES, SQL_ORIGINAL, _original
from porescreen.session import shared_folder
from porescreen.sources import paths as path_text, structures as cif, text, trajectory


def _written(spark, lines, name, part_lines):
    """A folder with the lines as text files."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4()}"
    text.write_lines(lines, folder, name, part_lines=part_lines)
    return folder


# -- structure text ----------------------------------------------------------------------------

def structure_lines(spark, sf_dir):
    """Structure files rendered from the atom table: cell, operation loop, atom loop, a closing item."""
    cells = structures(spark, sf_dir)
    tags = [F.concat(F.lit(f"{t}   "), F.format_string("%.8f", c)) for c, t in cif.CELL_TAGS.items()]
    head = [F.concat(F.lit("data_"), F.col("framework")), *tags, F.lit("loop_"), F.lit(" _symmetry_equiv_pos_site_id"),
            F.lit(" _symmetry_equiv_pos_as_xyz"), F.lit("  1  'x, y, z'"), F.lit("  2  '-x+1/2, y, -z'"), F.lit(""), F.lit("loop_"),
            F.lit(" _atom_site_type_symbol"), F.lit(" _atom_site_label"), F.lit(" _atom_site_symmetry_multiplicity"),
            F.lit(" _atom_site_fract_x"), F.lit(" _atom_site_fract_y"), F.lit(" _atom_site_fract_z"), F.lit(" _atom_site_occupancy")]
    top = cells.select("framework", F.posexplode(F.array(*head)).alias("line_no", "line"))
    top = top.select("framework", F.col("line_no").cast("long").alias("line_no"), "line")
    rows = atoms(spark, sf_dir).select("framework", (F.col("atom_id") + 100).alias("line_no"), F.format_string(
        "  %s  %s%d  1  %.8f  %.8f  %.8f  1", "element", "element", "atom_id", "fx", "fy", "fz").alias("line"))
    tail = cells.select("framework", F.lit(1 << 40).alias("line_no"), F.lit("_cell_formula_units_Z   96").alias("line"))
    return top.unionByName(rows).unionByName(tail)


def _damaged_lines(spark, sf_dir):
    """Structure files of which some lack a cell length, some all sites, and some the x of every seventh site."""
    number = F.substring("framework", 3, 9).cast("int")
    site = F.col("line_no").between(100, (1 << 40) - 1)
    lines = structure_lines(spark, sf_dir).filter(~((number % 5 == 1) & F.col("line").startswith("_cell_length_b")) & ~((number % 5 == 2) & site))
    blank = F.regexp_replace("line", r"  1  [-0-9.]+  ", "  1  ?  ")
    return lines.withColumn("line", F.when((number % 5 == 3) & site & (F.col("line_no") % 7 == 0), blank).otherwise(F.col("line")))


@query("B7 A1 G17", f"""WITH {V_ATOMS}, f AS (SELECT framework, framework[3:]::INT AS n FROM v_struct),
bad AS (SELECT framework, count(*) FILTER (framework[3:]::INT % 5 = 3 AND (atom_id + 100) % 7 = 0) AS b FROM v_atoms GROUP BY 1)
SELECT framework, CASE WHEN n % 5 IN (1, 2) OR n % 3 = 0 THEN 'FAILED' ELSE 'OK' END AS status,
       CASE WHEN n % 5 IN (1, 2) THEN 'read' WHEN n % 3 = 0 THEN 'barrier' END AS stage,
       CASE WHEN n % 5 = 1 THEN 'incomplete cell' WHEN n % 5 = 2 THEN 'no atom sites' WHEN n % 3 = 0 THEN 'no path along X, Z' END AS reason,
       CASE WHEN n % 5 = 3 THEN b ELSE 0 END AS rows_left_out,
       CASE WHEN NOT (n % 5 IN (1, 2) OR n % 3 = 0) THEN n + 0.5::DOUBLE END AS "barrier_X", CAST(NULL AS DOUBLE) AS "barrier_Y",
       CASE WHEN NOT (n % 5 IN (1, 2) OR n % 3 = 0) THEN n + 1.5::DOUBLE END AS "barrier_Z"
FROM f JOIN bad USING (framework)""")
def run_status_reasons(spark, sf_dir):
    """Stage and reason of every failure, from damaged structure files and from axes without a path."""
    frameworks = structures(spark, sf_dir).select("framework", F.substring("framework", 3, 9).cast("int").alias("n"))
    records = frameworks.select("framework", "n", F.explode(F.array(F.lit("X"), F.lit("Z"))).alias("axis")).select(
        "framework", "axis", (F.col("n") + F.when(F.col("axis") == "X", 0.5).otherwise(1.5)).alias("barrier"),
        F.when(F.col("n") % 3 == 0, "no path").otherwise("OK").alias("status"))
    rejects = cif.read_rejects(_damaged_lines(spark, sf_dir)).unionByName(asm.barrier_rejects(records))
    return asm.run_report(frameworks, records.filter("status = 'OK'"), rejects)


@query("A1 B5", f"""WITH {V_ATOMS}
SELECT framework, row_number() OVER (PARTITION BY framework ORDER BY atom_id) - 1 AS atom_id, element, round(fx, 8) + 0.0 AS fx, round(fy, 8) + 0.0 AS fy,
       round(fz, 8) + 0.0 AS fz FROM v_atoms""")
def atoms_from_files(spark, sf_dir):
    """Structure files written and read; their long atom loops stand in several parts."""
    folder = _written(spark, structure_lines(spark, sf_dir), "framework", 100)
    out = cif.atom_table(text.read_written_lines(spark, folder))
    return out.select("framework", "atom_id", "element", *[rounded(c, 8).alias(c) for c in ("fx", "fy", "fz")])


@query("A1 A2", f"""WITH {V_ATOMS}
SELECT framework, row_number() OVER (PARTITION BY framework ORDER BY atom_id) - 1 AS atom_id, element, element || atom_id AS label,
       1::INT AS multiplicity, round(fx, 8) + 0.0 AS fx, round(fy, 8) + 0.0 AS fy, round(fz, 8) + 0.0 AS fz, 1.0::DOUBLE AS occupancy FROM v_atoms""")
def atoms_from_text(spark, sf_dir):
    seq = Sequence(("framework",))
    out = cif.atom_table(structure_lines(spark, sf_dir), seq)
    return out.select("framework", "atom_id", "element", "label", "multiplicity", *[rounded(c, 8).alias(c) for c in ("fx", "fy", "fz")], "occupancy")


@query("A1", f"WITH {V_ATOMS} SELECT * FROM v_struct")
def structures_from_text(spark, sf_dir):
    return cif.structure_table(structure_lines(spark, sf_dir))


@query("A1 J10", f"""WITH {V_ATOMS} SELECT framework, unnest([0, 1])::BIGINT AS op_id, unnest(['x, y, z', '-x+1/2, y, -z']) AS xyz FROM v_struct""")
def operations_from_text(spark, sf_dir):
    return cif.operation_table(structure_lines(spark, sf_dir))


# -- path, barrier and summary text ------------------------------------------------------------

def _path_lines(spark, sf_dir):
    path, seq = paths(spark, sf_dir)
    records = path.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_nodes"), (F.max("e") - F.min("e")).alias("barrier"))
    lines = path_text.path_lines(path, records, "user_id")
    # Every tenth line of a path is damaged and must be skipped.
    spoilt = F.when((F.col("line_no") > 3) & (F.col("line_no") % 10 == 0), F.concat(F.lit("n/a "), "line")).otherwise(F.col("line"))
    return lines.withColumn("line", spoilt), Sequence(("user_id",), "seq", seq.block_rows, seq.blocked)


@query("A6 B6 F15", f"""WITH {V_PATH}, good AS (SELECT * FROM v_path WHERE (seq + 4) % 10 <> 0), n AS (SELECT user_id, count(*) AS n FROM good GROUP BY 1)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS seq, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y,
       round(z, 6) + 0.0 AS z, round(e, 6) + 0.0 AS e FROM good JOIN n USING (user_id) WHERE n >= 5""")
def paths_from_text(spark, sf_dir):
    lines, seq = _path_lines(spark, sf_dir)
    out = path_text.parse_path_lines(lines, "user_id", seq)
    return out.select("user_id", "seq", *[rounded(c).alias(c) for c in ("x", "y", "z", "e")])


@query("A6 B6", f"""WITH {V_PATH}, n AS (SELECT user_id, count(*) AS n FROM v_path GROUP BY 1)
SELECT user_id::VARCHAR AS user_id, seq, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(e, 6) + 0.0 AS e
FROM v_path JOIN n USING (user_id) WHERE n >= 5""")
def paths_from_files(spark, sf_dir):
    """Path files written by the tasks, in parts of 64 lines, and read again as a table of lines."""
    path, seq = paths(spark, sf_dir)
    records = path.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_nodes"), (F.max("e") - F.min("e")).alias("barrier"))
    folder = _written(spark, path_text.path_lines(path, records, "user_id"), "user_id", 64)
    out = path_text.parse_path_lines(text.read_written_lines(spark, folder, "user_id"), "user_id")
    return out.select("user_id", "seq", *[rounded(c).alias(c) for c in ("x", "y", "z", "e")])


@query("A2 B6", f"""WITH {V_PATH}, l AS (SELECT user_id, seq + 4 AS line_no FROM v_path UNION ALL SELECT DISTINCT user_id, unnest(range(0, 4)) FROM v_path)
SELECT user_id::VARCHAR AS user_id, count(DISTINCT line_no // 64) AS parts FROM l GROUP BY 1""")
def listed_path_files(spark, sf_dir):
    path, _ = paths(spark, sf_dir)
    records = path.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_nodes"), (F.max("e") - F.min("e")).alias("barrier"))
    folder = _written(spark, path_text.path_lines(path, records, "user_id"), "user_id", 64)
    return text.list_written(spark, folder, "user_id").select("user_id", "parts")


@query("A6", f"""WITH {V_PATH} SELECT user_id, count(*) AS n_nodes, round(max(e) - min(e), 4) AS barrier, CAST(NULL AS BIGINT) AS n_supercell
FROM v_path GROUP BY 1""")
def path_comments_from_text(spark, sf_dir):
    return path_text.parse_path_comments(_path_lines(spark, sf_dir)[0], "user_id")


@query("A7 B6", f"""WITH {SQL_AXIS}, grid AS (SELECT DISTINCT framework, a.axis FROM ax, (VALUES ('X'), ('Y'), ('Z')) a(axis))
SELECT framework, axis, barrier IS NOT NULL AS traverses, barrier, CASE WHEN barrier IS NOT NULL THEN transition_energy END AS transition_energy,
       CASE WHEN barrier IS NOT NULL THEN length::BIGINT END AS n_path_nodes FROM grid LEFT JOIN ax USING (framework, axis)""")
def barriers_from_text(spark, sf_dir):
    records = _axis_results(spark, sf_dir).withColumn("n_path_nodes", F.col("length").cast("long"))
    return path_text.parse_barrier_text(path_text.barrier_text(records, "framework"), "framework")


@query("A8 B6", f"""WITH {V_ATOMS} SELECT framework, (a % 4)::INT || 'D' AS dimensionality, a % 4 > 0 AS traverses_X, a % 4 > 1 AS traverses_Y,
  a % 4 > 2 AS traverses_Z, a AS a_A, round(b / 3, 2) AS b_A, round(c / 7, 2) AS c_A FROM v_struct""")
def summaries_from_text(spark, sf_dir):
    s = structures(spark, sf_dir)
    n = F.pmod(F.col("a"), F.lit(4.0)).cast("int")
    flags = {x: F.when(n > i, "Yes").otherwise("No") for i, x in enumerate("XYZ")}
    rows = s.select("framework", "a", (F.col("b") / 3).alias("b"), (F.col("c") / 7).alias("c"),
                    F.concat(n, F.lit("D")).alias("dimensionality"), *[v.alias(x) for x, v in flags.items()])
    return path_text.parse_summary_text(path_text.summary_text(rows, "framework"), "framework")


# -- trajectories ------------------------------------------------------------------------------

# Frames of one file per user: 3 atoms per frame, so every path row fills one atom line.
def _frame_lines(spark, sf_dir):
    path, _ = paths(spark, sf_dir)
    frame, at = F.expr("seq div 3"), F.expr("seq % 3")
    rows = path.select(F.col("user_id").alias("file"), (frame * 6 + at + 2).alias("line_no"), F.format_string(
        "%5d%-5s%5s%5d%8.3f%8.3f%8.3f", F.expr("seq % 1000"), F.lit("MOL"), F.lit("C"), F.expr("(seq + 1) % 1000"), F.col("e"), F.col("y"), F.col("z")).alias("line"))
    frames = path.filter("seq % 3 = 0").select(F.col("user_id").alias("file"), frame.alias("_f"), F.explode(F.array(
        F.struct(F.lit(0).alias("at"), F.lit("generated, t= 0.0").alias("line")), F.struct(F.lit(1).alias("at"), F.lit(" 3").alias("line")),
        F.struct(F.lit(5).alias("at"), F.lit("   4.01800   5.92140   5.25680").alias("line")))).alias("_r"))
    return rows.unionByName(frames.select("file", (F.col("_f") * 6 + F.col("_r.at")).alias("line_no"), F.col("_r.line").alias("line")))


@query("A10", f"""WITH {V_PATH} SELECT user_id AS file, seq // 3 AS frame, (seq % 3)::BIGINT AS row, (seq % 1000)::BIGINT AS resid, 'MOL' AS resname, 'C' AS atom,
  ((seq + 1) % 1000)::BIGINT AS atom_no, round(e, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM v_path""")
def trajectory_atoms(spark, sf_dir):
    return trajectory.frame_atoms(_frame_lines(spark, sf_dir))


@query("A10", f"""WITH {V_PATH} SELECT user_id AS file, seq // 3 AS frame, 4.018::DOUBLE AS box_x, 5.9214::DOUBLE AS box_y, 5.2568::DOUBLE AS box_z
FROM v_path WHERE seq % 3 = 0""")
def trajectory_boxes(spark, sf_dir):
    return trajectory.frame_boxes(_frame_lines(spark, sf_dir))


@query("A10", """SELECT 'index_' || user_id // 1000 AS file, 'user_' || user_id AS "group", event_id AS atom_no FROM events""")
def index_groups(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id")
    # A file holds the groups of a thousand users: one header per user, then one line per event.
    file = F.concat(F.lit("index_"), F.expr("user_id div 1000")).alias("file")
    base = F.col("user_id") % 1000 * F.lit(1 << 32)
    heads = ev.select("user_id").distinct().select(file, base.alias("line_no"), F.concat(F.lit("[ user_"), "user_id", F.lit(" ]")).alias("line"))
    rows = ev.select(file, (base + F.col("event_id") + 1).alias("line_no"), F.concat(F.lit("  "), "event_id", F.lit(" ")).alias("line"))
    # Lines are numbered with gaps; blocks keep any file, and any user in it, spread over tasks.
    return trajectory.group_members(heads.unionByName(rows), "file", Sequence(("file",), "line_no", 1 << 20, True))


BOX, LAGS = 500, 4
SQL_TRACK = V_PATH + f""",
cum AS (SELECT user_id, seq, sum(e) OVER w AS cx, sum(y * 3) OVER w AS cy, sum(z) OVER w AS cz FROM v_path
        WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
wrapped AS (SELECT user_id, seq, cx - floor(cx / {BOX}) * {BOX} AS x, cy - floor(cy / {BOX}) * {BOX} AS y, cz - floor(cz / {BOX}) * {BOX} AS z FROM cum),
steps2 AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM wrapped WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
whole AS (SELECT user_id, seq, """ + ", ".join(
    f"{c} + sum(CASE WHEN d{c} > {BOX / 2} THEN -{BOX} WHEN d{c} < -{BOX / 2} THEN {BOX} ELSE 0 END) OVER w AS {c}" for c in "xyz") + """
  FROM steps2 WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


def _whole_track(spark, sf_dir):
    path, seq = paths(spark, sf_dir)
    track = path
    for c, v in (("x", F.col("e")), ("y", F.col("y") * 3), ("z", F.col("z"))):
        track = running_sum(track, seq, v, f"_c{c}")
    wrapped = track.select("user_id", "seq", *[F.pmod(f"_c{c}", F.lit(float(BOX))).alias(c) for c in "xyz"])
    return sq.unwrap_periodic(wrapped, seq, {c: F.lit(float(BOX)) for c in "xyz"}), seq


@query("W10", f"WITH {SQL_TRACK} SELECT user_id, seq, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z FROM whole")
def whole_trajectories(spark, sf_dir):
    track, _ = _whole_track(spark, sf_dir)
    return track.select("user_id", "seq", *[rounded(c, 4).alias(c) for c in "xyz"])


def _sql_lags(most: str) -> str:
    return f"""WITH {SQL_TRACK}, moved AS (
  SELECT l.lag::INT AS lag, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz
  FROM whole a, range(1, {most}) l(lag) JOIN whole b ON b.user_id = a.user_id AND b.seq = a.seq + l.lag)
SELECT lag, count(*) AS n_pairs, round(avg(dx * dx), 4) AS msd_x, round(avg(dy * dy), 4) AS msd_y, round(avg(dz * dz), 4) AS msd_z,
       round(avg(dx * dx) + avg(dy * dy) + avg(dz * dz), 4) AS msd FROM moved GROUP BY 1"""


def _by_lag(out):
    return out.select("lag", "n_pairs", *[rounded(c, 4).alias(c) for c in ("msd_x", "msd_y", "msd_z", "msd")])


@query("W15", _sql_lags(str(LAGS + 1)))
def displacement_by_lag(spark, sf_dir):
    track, seq = _whole_track(spark, sf_dir)
    return _by_lag(sq.mean_squared_displacement(track, seq, LAGS))


@query("W15", "SELECT lag, n_pairs, " + ", ".join(f"round({c} / 10000, 4) AS {c}" for c in ("msd_x", "msd_y", "msd_z", "msd"))
       + " FROM (" + _sql_lags("(SELECT max(seq) + 1 FROM v_path)::BIGINT").replace("round(", "(").replace(", 4) AS", ") AS") + ")")
def displacement_at_all_lags(spark, sf_dir):
    """Every lag of every track, in squares of 100; blocks of 32 rows, so that tracks span several."""
    track, seq = _whole_track(spark, sf_dir)
    out = sq.mean_squared_displacement(track, seq, block_rows=32)
    return out.select("lag", "n_pairs", *[rounded(F.col(c) / 10000, 4).alias(c) for c in ("msd_x", "msd_y", "msd_z", "msd")])


# -- drifting paths ----------------------------------------------------------------------------

from porescreen.plans.channel_queries import SQL_REBUILT  # noqa: E402
from porescreen.plans.sequence_queries import axis_of_user, SQL_AXIS as SQL_AXIS_OF  # noqa: E402


@query("W11 W12 W13", f"""WITH {V_PATH}, pts AS (SELECT *, {SQL_AXIS_OF} AS axis FROM v_path) {SQL_REBUILT.format(key='user_id, axis', la=400, lb=20, lc=18)}
SELECT user_id, seq, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, e FROM rebuilt""")
def rebuilt_paths(spark, sf_dir):
    path, seq = paths(spark, sf_dir)
    out = sq.rebuild_periodic(path, seq, axis_of_user(), {"x": F.lit(400.0), "y": F.lit(20.0), "z": F.lit(18.0)})
    return out.select("user_id", "seq", *[rounded(c).alias(c) for c in "xyz"], "e")


# -- messages ----------------------------------------------------------------------------------

def messages(spark, sf_dir):
    """Documents with a pipe table in the middle, a table without end, and list and code marks."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.col("text"), F.lit("\n| name | value |\n|---|:--|\n| n | "), F.col("n_chars"), F.lit(" |\n|lang| "), "lang",
                    F.lit(" |\n- item **one** and `code`\n## Title *two*\na | b\nc | d\n--|--\n"), "source", F.lit(" | x"))
    return d.select("doc_id", text.alias("text"))


V_MSG = """
msg AS (
  SELECT doc_id, text || E'\\n| name | value |\\n|---|:--|\\n| n | ' || n_chars || E' |\\n|lang| ' || lang ||
         E' |\\n- item **one** and `code`\\n## Title *two*\\na | b\\nc | d\\n--|--\\n' || source || ' | x' AS text FROM documents),
ln AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS line, unnest(range(0, len(string_split(text, E'\\n')))) AS n FROM msg)"""

# The table scan as a recursion over the lines, with the state of the line before.
SQL_BLOCKS = V_MSG + """,
ctx AS (
  SELECT doc_id, n, line, line LIKE '%|%' AS pipe, length(trim(line)) > 0 AS filled, trim(line) AS bare,
         lead(trim(line)) OVER (PARTITION BY doc_id ORDER BY n) AS nxt FROM ln),
cand AS (SELECT *, pipe AND coalesce(regexp_full_match(nxt, '[-|: ]+') AND nxt LIKE '%-%' AND nxt LIKE '%|%', false) AS opens FROM ctx),
scan AS (
  SELECT doc_id, n, CASE WHEN opens THEN 'head' ELSE 'text' END AS st, 1 AS block FROM cand WHERE n = 0
  UNION ALL
  SELECT s.doc_id, c.n,
         CASE WHEN s.st = 'head' THEN 'sep' WHEN s.st IN ('sep', 'row') AND c.filled AND c.pipe THEN 'row' WHEN c.opens THEN 'head' ELSE 'text' END,
         s.block + CASE WHEN s.st = 'head' THEN 0 WHEN s.st IN ('sep', 'row') AND c.filled AND c.pipe THEN 0
                        WHEN c.opens THEN 1 WHEN s.st = 'text' THEN 0 ELSE 1 END
  FROM scan s JOIN cand c ON c.doc_id = s.doc_id AND c.n = s.n + 1),
blk AS (
  SELECT doc_id, block, st <> 'text' AS is_table, string_agg(line, E'\\n' ORDER BY n) FILTER (st = 'text') AS text,
         count(*) FILTER (st = 'row') AS n_rows,
         any_value(list_transform(string_split(regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', ''), '|'), lambda c: trim(c))) FILTER (st = 'head') AS header,
         string_agg(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', ''), '|'), lambda c: trim(c)), '~'),
                    E'\\n' ORDER BY n) FILTER (st = 'row') AS cells
  FROM scan JOIN ctx USING (doc_id, n) GROUP BY ALL)"""


@query("T3", f"""WITH RECURSIVE {SQL_BLOCKS}
SELECT doc_id, block::INT AS block_no, CASE WHEN is_table THEN 'table' ELSE 'text' END AS kind, text, array_to_string(header, '~') AS header,
       CASE WHEN is_table THEN n_rows::INT END AS n_rows, CASE WHEN is_table THEN coalesce(cells, '') END AS cells FROM blk""")
def message_tables(spark, sf_dir):
    out = report.table_blocks(messages(spark, sf_dir), ["doc_id"])
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, "~")), "\n")
    return out.select("doc_id", "block_no", "kind", "text", F.array_join("header", "~").alias("header"),
                      F.when(F.col("rows").isNotNull(), F.size("rows")).alias("n_rows"), cells.alias("cells"))


@query("T4", f"""WITH {V_MSG}, cleaned AS (
  SELECT doc_id, string_agg(regexp_replace(regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^[-*•]\\s+', ''), '^#{{1,6}}\\s*', ''), E'\\n' ORDER BY n) AS t FROM ln GROUP BY 1)
SELECT doc_id, regexp_replace(replace(t, '*', ''), '`([^`]+)`', '\\1', 'g') AS prose FROM cleaned""")
def message_prose(spark, sf_dir):
    return messages(spark, sf_dir).select("doc_id", report.plain_prose(F.col("text")).alias("prose"))


# Frequent words become symbols, some of them glued to letters.
_SWAPS = {" the ": " Ebarrier ", " of ": " PLDX ", " in ": " PLD, ", " de ": " σE ", " et ": " (GE,mean) ", " der ": " xHE ", " und ": " HE."}


def _mentions(spark, sf_dir):
    text = F.col("text")
    for word, symbol in _SWAPS.items():
        text = F.replace(text, F.lit(word), F.lit(symbol))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


_SWAP_SQL = "text"
for _w, _s in _SWAPS.items():
    _SWAP_SQL = f"replace({_SWAP_SQL}, '{_w}', '{_s}')"
_FORMS = sorted({*names.SYMBOLS.values(), *names.PLAIN_SYMBOLS.values()})


@query("T5", f"""WITH tok AS (
  SELECT doc_id, unnest(regexp_extract_all({_SWAP_SQL}, '[A-Za-z0-9_σηρτ]+(?:,mean)?')) AS symbol FROM documents)
SELECT doc_id, symbol, count(*) AS n FROM tok WHERE symbol IN ({', '.join("'" + f + "'" for f in _FORMS)}) GROUP BY 1, 2""")
def symbol_counts(spark, sf_dir):
    return report.symbol_mentions(_mentions(spark, sf_dir), ["doc_id"])


def _stream(spark, sf_dir):
    """Each turn as a stream: one fragment per word, broken and empty lines, an end mark, late lines."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("_w"))
    noise = F.array(F.lit("data: {broken"), F.lit(": keep-alive"), F.lit('data: {"choices": []}'), F.lit(""))

    def row(seq, line):
        return F.struct(seq.cast("int").alias("seq"), line.alias("line"))

    def of_word(text, p):
        delta = F.struct(F.struct(F.concat(text, F.lit(" ")).alias("content")).alias("delta"))
        piece = F.to_json(F.struct(F.array(delta).alias("choices")))
        return F.array(row(p * 3, F.concat(F.lit("data: "), piece)), row(p * 3 + 1, F.element_at(noise, p % 4 + 1)))

    end = F.size("_w") * 3
    late = F.lit('data: {"choices":[{"delta":{"content":"late"}}]}')
    lines = F.concat(F.flatten(F.transform("_w", of_word)), F.array(row(end, F.lit("data: [DONE]")), row(end + 1, late)))
    return turns.select("conv_id", "turn", F.explode(lines).alias("_r")).select("conv_id", "turn", "_r.*")


@query("T6", """SELECT conv_id, turn, text || ' ' AS text FROM conversations""")
def reassembled_turns(spark, sf_dir):
    return report.reassemble_stream(_stream(spark, sf_dir), ["conv_id", "turn"])


@query("T1 S3 F15", f"""WITH {SQL_ORIGINAL},
parts AS (SELECT sample, string_agg(printf('f%d=%+.4f', p + 1, contribution), ', ' ORDER BY abs(contribution) DESC, p) AS txt,
                 any_value(orig_base) AS ob, any_value(orig_pred) AS op FROM orig GROUP BY 1)
SELECT sample, printf('%s: Ds = %.4e', sample, op) || E'\\n' || printf('  base=%.4f, pred=%.4f', ob, op) || E'\\n  contributions: ' || txt ||
  E'\\n  features: ' || printf('f1=%.6f, f2=%.6f, f3=%.6f, f4=%.6f, f5=%.6f', f1, f2, f3, f4, f5) AS report
FROM parts JOIN v_feat USING (sample)""")
def sample_report_text(spark, sf_dir):
    return report.sample_reports(_original(spark, sf_dir), features(spark, sf_dir), "sample", FEATURES)
