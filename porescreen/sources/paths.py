"""Path, barrier and summary text: rendering and parsing.

The numbers pass through text with 6, 4 and 2 decimals; the rounding is part of the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from porescreen.operators.ordered import Sequence, compact, group_values
from porescreen.operators.sequence import MIN_ROWS_READ
from porescreen.sources.text import number

AXES = ("X", "Y", "Z")

# The labels, titles and number formats of the three text files.
PATH_TITLE, PATH_COLUMNS = "# Minimum Energy Path", "# X(A)  Y(A)  Z(A)  Energy(kJ/mol)"
PATH_NODES, PATH_BARRIER = "# n_nodes = %d", "# barrier = %.4f kJ/mol"
PATH_NOTES = ("n_nodes", "barrier", "n_supercell")
BARRIER_TITLE, BARRIER_NONE = "Diffusion barriers", " direction: no traversing path found"
BARRIER_LINE = "%s direction: barrier = %.4f kJ/mol  transition energy = %.4f kJ/mol  path nodes = %d"
BARRIER_LABELS = ("barrier", "transition energy", "path nodes")
SUMMARY_CELL, SUMMARY_AXES = "   Original unit cell: a=%.2f  b=%.2f  c=%.2f A", "   X=%s  Y=%s  Z=%s"
SUMMARY_DIMENSION = "Dimensionality:"


def _fields(text: Column, apart: str) -> Column:
    """``label = value unit`` fields of a line as (label, value): what stands before the sign, and the word after it."""
    pieces = F.filter(F.split(text, apart), lambda f: f.contains("="))
    return F.transform(pieces, lambda f: F.struct(
        F.trim(F.substring_index(f, "=", 1)).alias("label"),
        F.get(F.split(F.trim(F.substring_index(f, "=", -1)), " "), F.lit(0)).alias("value")))


def _value(fields: Column, label: str | Column) -> Column:
    """Value of the first field with the label, NULL without one."""
    return F.get(F.filter(fields, lambda f: f["label"] == label), F.lit(0))["value"]


def path_lines(path: DataFrame, records: DataFrame, key: str, pos: str = "seq") -> DataFrame:
    """Lines of the path files: comment lines with node count and barrier, then x y z e."""
    body = path.select(key, (F.col(pos) + 4).alias("line_no"),
                       F.format_string("%12.6f  %12.6f  %12.6f  %12.6f", "x", "y", "z", "e").alias("line"))
    head = records.select(key, F.posexplode(F.array(
        F.lit(PATH_TITLE), F.format_string(PATH_NODES, F.col("n_nodes").cast("long")),
        F.format_string(PATH_BARRIER, "barrier"), F.lit(PATH_COLUMNS))).alias("line_no", "line"))
    return head.select(key, F.col("line_no").cast("long").alias("line_no"), "line").unionByName(body)


def parse_path_lines(lines: DataFrame, key: str, seq: Sequence | None = None, min_rows: int = MIN_ROWS_READ) -> DataFrame:
    """Path rows (seq, x, y, z, e): the first four numbers of a line.  Lines that do not hold four
    numbers are skipped; files with fewer than ``min_rows`` rows yield nothing."""
    seq = seq or Sequence((key,))
    text = F.trim(F.regexp_replace("line", r"\t", " "))
    word = F.split(text, r"\s+")
    values = {c: number(F.get(word, F.lit(i))) for i, c in enumerate(("x", "y", "z", "e"))}
    rows = lines.filter(~text.startswith("#") & (text != "")).select(
        key, F.col("line_no").alias(seq.pos), *[v.alias(c) for c, v in values.items()]).dropna(subset=list(values))
    sized = group_values(rows, seq, {"_n": F.count(F.lit(1))}).filter(F.col("_n") >= min_rows).drop("_n")
    return compact(sized, seq)


def parse_path_comments(lines: DataFrame, key: str) -> DataFrame:
    """Node count, barrier and cell count from the comment lines; the last mention counts."""
    notes = lines.filter(F.trim("line").startswith("#")).withColumn("_f", _fields(F.ltrim(F.trim("line"), F.lit("# ")), "\n"))
    found = {}
    for name in PATH_NOTES:
        value = _value(F.col("_f"), name).try_cast("double" if name == "barrier" else "long")
        found[name] = F.max_by(value, F.when(value.isNotNull(), F.col("line_no")))
    return notes.groupBy(key).agg(*[v.alias(n) for n, v in found.items()])


def barrier_text(records: DataFrame, key: str) -> DataFrame:
    """One text per framework with a line per axis."""
    known = F.format_string(BARRIER_LINE, F.col("axis"), F.col("barrier"), F.col("transition_energy"),
                            F.col("n_path_nodes").cast("long"))
    line = F.when(F.col("barrier").isNotNull(), known).otherwise(F.concat("axis", F.lit(BARRIER_NONE)))
    per = records.groupBy(key).agg(*[F.max(F.when(F.col("axis") == a, line)).alias(a) for a in AXES])
    return per.select(key, F.concat_ws("\n", F.lit(BARRIER_TITLE), *AXES).alias("text"))


def parse_barrier_text(texts: DataFrame, key: str) -> DataFrame:
    """One row per framework and axis; an axis without a barrier does not traverse."""
    rows = texts.withColumn("axis", F.explode(F.array(*[F.lit(a) for a in AXES])))
    start = F.concat("axis", F.lit(" direction:"))
    line = F.get(F.filter(F.split("text", "\n"), lambda x: F.ltrim(x).startswith(start)), F.lit(0))
    fields = _fields(F.substring_index(F.coalesce(line, F.lit("")), ":", -1), "kJ/mol|  +")
    values = rows.withColumn("_f", fields).select(key, "axis", *[_value(F.col("_f"), b).alias(b) for b in BARRIER_LABELS])
    barrier, energy, nodes = (F.col(b) for b in BARRIER_LABELS)
    return values.select(
        key, "axis", barrier.isNotNull().alias("traverses"), barrier.try_cast("double").alias("barrier"),
        energy.try_cast("double").alias("transition_energy"), nodes.try_cast("long").alias("n_path_nodes"))


def summary_text(frameworks: DataFrame, key: str) -> DataFrame:
    """Summary with cell lengths (2 decimals), dimensionality and the Yes or No of each axis."""
    cell = F.format_string(SUMMARY_CELL, "a", "b", "c")
    axes = F.format_string(SUMMARY_AXES, "X", "Y", "Z")
    return frameworks.select(key, F.concat_ws(
        "\n", F.lit("1. Supercell"), cell, F.lit(""), F.lit("2. Dimensionality"),
        F.concat(F.lit(f"   {SUMMARY_DIMENSION} "), "dimensionality"), axes).alias("text"))


def parse_summary_text(texts: DataFrame, key: str) -> DataFrame:
    """Dimensionality, traversal flags and cell lengths; NULL where the text lacks them."""
    words = F.split(F.regexp_replace("text", r"\s*=\s*", "="), r"\s+")
    pairs = F.transform(F.filter(words, lambda w: w.contains("=")), lambda w: F.struct(
        F.substring_index(w, "=", 1).alias("label"), F.substring_index(w, "=", -1).alias("value")))
    after = F.get(words, F.nullif(F.array_position(words, SUMMARY_DIMENSION), F.lit(0)).cast("int"))
    read = texts.select(key, pairs.alias("_p"), F.when(after.rlike(r"^\dD"), F.left(after, F.lit(2))).alias("dimensionality"))
    answer = {a: F.lower(_value(F.col("_p"), a)) for a in AXES}
    return read.select(
        key, "dimensionality", *[F.when(v.isin("yes", "no"), v == "yes").alias(f"traverses_{a}") for a, v in answer.items()],
        *[_value(F.col("_p"), c).try_cast("double").alias(f"{c}_A") for c in "abc"])
