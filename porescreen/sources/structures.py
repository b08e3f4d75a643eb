"""Structure text (CIF loop layout) to structure, atom and operation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from porescreen.operators.ordered import Sequence, carried, compact, running_sum
from porescreen.sources.text import number

# Tags of the format.
CELL_TAGS = {
    "a": "_cell_length_a", "b": "_cell_length_b", "c": "_cell_length_c",
    "alpha": "_cell_angle_alpha", "beta": "_cell_angle_beta", "gamma": "_cell_angle_gamma",
}
ATOM_TAGS = {
    "symbol": "_atom_site_type_symbol", "label": "_atom_site_label", "multiplicity": "_atom_site_symmetry_multiplicity",
    "fx": "_atom_site_fract_x", "fy": "_atom_site_fract_y", "fz": "_atom_site_fract_z", "occupancy": "_atom_site_occupancy",
}
OPERATION_TAGS = ("_symmetry_equiv_pos_as_xyz", "_space_group_symop_operation_xyz")


def structure_table(lines: DataFrame) -> DataFrame:
    """Cell lengths and angles per framework."""
    word = F.split(F.trim("line"), r"\s+")
    value = number(F.regexp_replace(F.get(word, F.lit(1)), r"\(.*\)", ""))
    return lines.groupBy("framework").agg(*[F.max(F.when(word[0] == tag, value)).alias(c) for c, tag in CELL_TAGS.items()])


def loop_rows(lines: DataFrame, seq: Sequence) -> tuple[DataFrame, DataFrame]:
    """Header tags (framework, loop_no, tag, col) and data rows (framework, loop_no, seq, line) of all loops."""
    text = F.trim(F.regexp_replace("line", r"\t", " "))
    body = lines.select("framework", F.col("line_no").alias(seq.pos), text.alias("line")).filter(
        (F.col("line") != "") & ~F.col("line").startswith("#"))
    body = compact(body, seq)
    kind = F.when(F.lower("line") == "loop_", "L").when(F.col("line").startswith("_"), "T").otherwise("D")
    body = body.withColumn("_kind", kind).withColumns({
        "_l": F.when(F.col("_kind") == "L", F.col(seq.pos)), "_d": F.when(F.col("_kind") == "D", F.col(seq.pos))})
    body = carried(carried(body, seq, "_l", "_last_loop"), seq, "_d", "_last_data")
    header = (F.col("_kind") == "T") & (F.col("_last_data").isNull() | (F.col("_last_data") < F.col("_last_loop")))
    body = body.withColumn("_header", F.coalesce(header & F.col("_last_loop").isNotNull(), F.lit(False)))
    # A tag outside a header, or a data block line, closes the loop before it.
    stop = ((F.col("_kind") == "T") & ~F.col("_header")) | F.lower("line").startswith("data_")
    body = carried(body.withColumn("_t", F.when(stop, F.col(seq.pos))), seq, "_t", "_last_stop")
    body = running_sum(body, seq, (F.col("_kind") == "L").cast("int"), "loop_no")
    tags = body.filter("_header").select(
        "framework", "loop_no", F.element_at(F.split("line", r"\s+"), 1).alias("tag"),
        (F.col(seq.pos) - F.col("_last_loop") - 1).cast("int").alias("col"))
    inside = (F.col("_kind") == "D") & F.col("_last_loop").isNotNull() & (
        F.col("_last_stop").isNull() | (F.col("_last_stop") < F.col("_last_loop")))
    return tags, body.filter(inside).select("framework", "loop_no", seq.pos, "line")


def _sites(lines: DataFrame, seq: Sequence) -> DataFrame:
    """All rows of the atom loops, also those without coordinates."""
    tags, rows = loop_rows(lines, seq)
    places = tags.groupBy("framework", "loop_no").agg(
        *[F.max(F.when(F.col("tag") == t, F.col("col"))).alias(f"_{c}") for c, t in ATOM_TAGS.items()])
    places = places.filter(F.col("_fx").isNotNull())
    word = F.split("line", r"\s+")
    cell = {c: F.get(word, F.col(f"_{c}")) for c in ATOM_TAGS}
    plain = {c: number(F.regexp_replace(v, r"\(.*\)", "")) for c, v in cell.items() if c not in ("symbol", "label")}
    return rows.join(places, ["framework", "loop_no"]).select(
        "framework", seq.pos, F.regexp_extract(F.coalesce(cell["symbol"], cell["label"]), r"^([A-Za-z]{1,2})", 1).alias("element"),
        cell["label"].alias("label"), plain["multiplicity"].cast("int").alias("multiplicity"),
        *[plain[c].alias(c) for c in ("fx", "fy", "fz", "occupancy")])


PLACED = "fx IS NOT NULL AND fy IS NOT NULL AND fz IS NOT NULL"


def atom_table(lines: DataFrame, seq: Sequence | None = None) -> DataFrame:
    """Atom sites in file order; element from the type symbol, else from the label.  ``read_rejects`` names what is left out."""
    seq = seq or Sequence(("framework",))
    return compact(_sites(lines, seq).filter(PLACED), seq).withColumnRenamed(seq.pos, "atom_id")


def read_rejects(lines: DataFrame, seq: Sequence | None = None) -> DataFrame:
    """Rejects (framework, stage, reason, n) of reading: sites without coordinates, structures without sites or a whole cell."""
    seq = seq or Sequence(("framework",))
    cells = structure_table(lines)
    whole = F.lit(True)
    for c in CELL_TAGS:
        whole = whole & F.col(c).isNotNull()
    sites = _sites(lines, seq).groupBy("framework").agg(F.count_if(F.expr(PLACED)).alias("_good"), F.count_if(~F.expr(PLACED)).alias("_bad"))
    rows = cells.select("framework", whole.alias("_whole")).join(sites, "framework", "left").na.fill(0, ["_good", "_bad"])
    found = F.filter(F.array(
        F.when(~F.col("_whole"), reject("incomplete cell", F.lit(1))),
        F.when(F.col("_good") == 0, reject("no atom sites", F.lit(1))),
        F.when((F.col("_bad") > 0) & (F.col("_good") > 0), reject("site without coordinates", F.col("_bad")))), lambda r: r.isNotNull())
    return rows.select("framework", F.explode(found).alias("_r")).select("framework", F.lit("read").alias("stage"), "_r.*")


def reject(reason: str, n: Column) -> Column:
    return F.struct(F.lit(reason).alias("reason"), n.cast("long").alias("n"))


def operation_table(lines: DataFrame, seq: Sequence | None = None) -> DataFrame:
    """Symmetry operations (framework, op_id, xyz) in file order."""
    seq = seq or Sequence(("framework",))
    tags, rows = loop_rows(lines, seq)
    wanted = tags.filter(F.col("tag").isin(*OPERATION_TAGS)).select("framework", "loop_no").distinct()
    quoted = F.regexp_extract("line", r"['\"]([^'\"]*)['\"]", 1)
    bare = F.regexp_replace("line", r"^\d+\s+", "")
    ops = rows.join(wanted, ["framework", "loop_no"]).select(
        "framework", seq.pos, F.when(quoted != "", quoted).otherwise(bare).alias("xyz"))
    return compact(ops, seq).withColumnRenamed(seq.pos, "op_id")
