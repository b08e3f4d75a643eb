"""Fixed-width trajectory frames and group index files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from porescreen.operators.ordered import Sequence, carried

# Column positions (start, width) of an atom line, and the lines around the atoms.
FIELDS = {"resid": (1, 5), "resname": (6, 5), "atom": (11, 5), "atom_no": (16, 5), "x": (21, 8), "y": (29, 8), "z": (37, 8)}
EXTRA_LINES = 3


def frame_atoms(lines: DataFrame, name: str = "file") -> DataFrame:
    """Atoms of all frames.  A file repeats frames of title, atom count, atoms and box; the count of
    its first frame gives the place of every line, so no ordering of lines is needed."""
    sizes = lines.filter(F.col("line_no") == 1).select(name, F.trim("line").try_cast("long").alias("_n"))
    rows = lines.join(sizes, name).withColumns({
        "frame": F.expr(f"line_no div (_n + {EXTRA_LINES})"), "_at": F.expr(f"line_no % (_n + {EXTRA_LINES})")})
    atoms = rows.filter((F.col("_at") >= 2) & (F.col("_at") < F.col("_n") + 2))
    text = {c: F.trim(F.substring("line", *p)) for c, p in FIELDS.items()}
    return atoms.select(
        name, "frame", (F.col("_at") - 2).alias("row"), text["resid"].try_cast("long").alias("resid"),
        text["resname"].alias("resname"), text["atom"].alias("atom"), text["atom_no"].try_cast("long").alias("atom_no"),
        *[text[c].try_cast("double").alias(c) for c in "xyz"])


def frame_boxes(lines: DataFrame, name: str = "file") -> DataFrame:
    """Box edges of all frames."""
    sizes = lines.filter(F.col("line_no") == 1).select(name, F.trim("line").try_cast("long").alias("_n"))
    rows = lines.join(sizes, name).withColumns({
        "frame": F.expr(f"line_no div (_n + {EXTRA_LINES})"), "_at": F.expr(f"line_no % (_n + {EXTRA_LINES})")})
    word = F.split(F.trim("line"), r"\s+")
    return rows.filter(F.col("_at") == F.col("_n") + 2).select(
        name, "frame", *[F.get(word, F.lit(i)).try_cast("double").alias(f"box_{c}") for i, c in enumerate("xyz")])


def group_members(lines: DataFrame, name: str = "file", seq: Sequence | None = None) -> DataFrame:
    """Members (group, atom_no) of the groups of an index file."""
    seq = seq or Sequence((name,), "line_no")
    header = F.nullif(F.regexp_extract("line", r"^\s*\[\s*(.*?)\s*\]", 1), F.lit(""))
    filled = carried(lines.withColumn("_header", header), seq, "_header", "group")
    words = F.filter(F.split(F.trim("line"), r"\s+"), lambda w: w.rlike(r"^\d+$"))
    return filled.filter(F.col("_header").isNull() & F.col("group").isNotNull()).select(
        name, "group", F.explode(F.transform(words, lambda w: w.cast("long"))).alias("atom_no"))
