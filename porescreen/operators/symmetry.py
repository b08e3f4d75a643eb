"""Expansion of sites by given symmetry operations, and removal of coinciding sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from porescreen.functions.lattice import wrap
from porescreen.session import cut_lineage

SITE_TOLERANCE = 1e-3
BUCKET = 0.01


def parse_operations(ops: DataFrame, text: str = "xyz") -> DataFrame:
    """Rotation (r11 .. r33) and translation (t1 .. t3) of operations such as ``-x+1/2, y, z``."""
    parts = F.split(F.lower(F.regexp_replace(text, r"[\s'\"]", "")), ",")

    def factor(part: Column, letter: str) -> Column:
        sign = F.regexp_extract(part, rf"([+-]?){letter}", 1)
        return F.when(part.contains(letter), F.when(sign == "-", -1.0).otherwise(1.0)).otherwise(0.0)

    def shift(part: Column) -> Column:
        number = F.regexp_extract(part, r"([+-]?\d+(?:\.\d+)?)", 1)
        below = F.regexp_extract(part, r"/(\d+)", 1)
        value = F.when(number == "", 0.0).otherwise(F.expr("1D") * number.cast("double"))
        return value / F.when(below == "", 1.0).otherwise(below.cast("double"))

    out = {}
    for row in (1, 2, 3):
        part = parts[row - 1]
        out |= {f"r{row}{col}": factor(part, letter) for col, letter in enumerate("xyz", 1)}
        out[f"t{row}"] = shift(part)
    return ops.withColumns(out)


def apply_operations(sites: DataFrame, ops: DataFrame) -> DataFrame:
    """Every site under every operation of its framework, wrapped into the cell."""
    joined = sites.join(ops, "framework")
    moved = [wrap(sum((F.col(f"r{r}{c}") * F.col(f) for c, f in enumerate(("fx", "fy", "fz"), 1)), F.lit(0.0))
                  + F.col(f"t{r}")) for r in (1, 2, 3)]
    return joined.select("framework", "atom_id", "op_id", "element", *[m.alias(f) for m, f in zip(moved, ("fx", "fy", "fz"))])


def drop_coinciding(sites: DataFrame, order: list[str], tolerance: float = SITE_TOLERANCE) -> DataFrame:
    """Keep a site unless an earlier kept one of the same element lies within the tolerance on
    every axis (no wrap in the comparison), as a pass in ``order`` would.

    Identical sites collapse first, by a combinable aggregate.  Close pairs come from buckets; a
    site is copied to a second bucket only next to an edge.  Rounds over the few close pairs
    then settle chains in which an earlier site was itself dropped.
    """
    coords = ["fx", "fy", "fz"]
    kind = ["framework", "element"]
    rest = [c for c in sites.columns if c not in (*kind, *coords)]
    once = (sites.groupBy(*kind, *coords).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_row"))
            .select(*kind, *coords, "_row.*").withColumn("_ord", F.struct(*order)))
    spread = once.select(*kind, *coords, "_ord")
    for c in coords:
        spread = spread.withColumn(f"_{c}", F.explode(F.sequence(
            F.floor((F.col(c) - tolerance) / BUCKET), F.floor((F.col(c) + tolerance) / BUCKET))))
    home = once.select(*kind, *[F.col(c).alias(f"e_{c}") for c in coords], F.col("_ord").alias("earlier"),
                       *[F.floor(F.col(c) / BUCKET).alias(f"_{c}") for c in coords])
    close = F.col("earlier") < F.col("_ord")
    for c in coords:
        close = close & (F.abs(F.col(c) - F.col(f"e_{c}")) < tolerance)
    pairs = cut_lineage(spread.join(home, [*kind, *[f"_{c}" for c in coords]]).filter(close)
                        .select("framework", F.col("_ord").alias("later"), "earlier").distinct())
    dropped = pairs.select("framework", F.col("later").alias("site")).limit(0)
    open_pairs = pairs
    while not open_pairs.isEmpty():
        # A site without an open earlier neighbour stays; whatever is close to it goes.
        waiting = open_pairs.select("framework", F.col("later").alias("site")).distinct()
        kept = open_pairs.select("framework", F.col("earlier").alias("site")).distinct() \
            .join(waiting, ["framework", "site"], "left_anti")
        gone = open_pairs.join(kept.withColumnRenamed("site", "earlier"), ["framework", "earlier"], "left_semi") \
            .select("framework", F.col("later").alias("site")).distinct()
        dropped = cut_lineage(dropped.unionByName(gone))
        open_pairs = cut_lineage(
            open_pairs.join(dropped.withColumnRenamed("site", "later"), ["framework", "later"], "left_anti")
            .join(dropped.withColumnRenamed("site", "earlier"), ["framework", "earlier"], "left_anti"))
    return once.join(dropped.withColumnRenamed("site", "_ord"), ["framework", "_ord"], "left_anti").drop("_ord")
