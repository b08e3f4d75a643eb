"""Lattice algebra as column expressions.  Rows of a cell matrix are the lattice vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from porescreen.functions.numbers import norm3

CELL = [f"{v}{c}" for v in "abc" for c in "xyz"]


def _cos(angle: str) -> Column:
    return F.when(F.col(angle) == 90.0, F.lit(0.0)).otherwise(F.cos(F.radians(angle)))


def with_cell(structures: DataFrame) -> DataFrame:
    """Add the cell matrix (ax .. cz) from lengths and angles; a lies along x, b in the xy plane."""
    sin_gamma = F.when(F.col("gamma") == 90.0, F.lit(1.0)).otherwise(F.sin(F.radians("gamma")))
    cx = F.col("c") * _cos("beta")
    cy = F.col("c") * (_cos("alpha") - _cos("beta") * _cos("gamma")) / sin_gamma
    values = [F.col("a"), F.lit(0.0), F.lit(0.0), F.col("b") * _cos("gamma"), F.col("b") * sin_gamma, F.lit(0.0),
              cx, cy, F.sqrt(F.col("c") * F.col("c") - cx * cx - cy * cy)]
    return structures.withColumns(dict(zip(CELL, values)))


def to_cartesian(fx: Column, fy: Column, fz: Column, scale: float = 1.0) -> tuple[Column, Column, Column]:
    """Fractional to Cartesian: row vector times cell matrix."""
    return tuple((fx * F.col(f"a{c}") + fy * F.col(f"b{c}") + fz * F.col(f"c{c}")) * scale for c in "xyz")


def to_fractional(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Cartesian to fractional, by the inverse of the cell matrix (adjugate over determinant)."""
    m = {n: F.col(n) for n in CELL}
    det = volume()
    rows = (("by*cz-bz*cy", "bz*cx-bx*cz", "bx*cy-by*cx"), ("cy*az-cz*ay", "cz*ax-cx*az", "cx*ay-cy*ax"),
            ("ay*bz-az*by", "az*bx-ax*bz", "ax*by-ay*bx"))

    def minor(text: str) -> Column:
        plus, minus = text.split("-")
        (p, q), (r, s) = plus.split("*"), minus.split("*")
        return m[p] * m[q] - m[r] * m[s]

    return tuple((x * minor(r[0]) + y * minor(r[1]) + z * minor(r[2])) / det for r in rows)


def volume() -> Column:
    m = {n: F.col(n) for n in CELL}
    return (m["ax"] * (m["by"] * m["cz"] - m["bz"] * m["cy"]) - m["ay"] * (m["bx"] * m["cz"] - m["bz"] * m["cx"])
            + m["az"] * (m["bx"] * m["cy"] - m["by"] * m["cx"]))


def vector_length(v: str) -> Column:
    return norm3(*[F.col(f"{v}{c}") for c in "xyz"])


def plane_distance(v: str) -> Column:
    """Distance of the two cell faces that the vector ``v`` connects."""
    p, q = [w for w in "abc" if w != v]
    m = {n: F.col(n) for n in CELL}
    cross = [m[f"{p}{i}"] * m[f"{q}{j}"] - m[f"{p}{j}"] * m[f"{q}{i}"] for i, j in ("yz", "zx", "xy")]
    return F.abs(volume()) / norm3(*cross)


def dot(v: str, w: str) -> Column:
    return sum((F.col(f"{v}{c}") * F.col(f"{w}{c}") for c in "xyz"), F.lit(0.0))


def wrap(fraction: Column) -> Column:
    """Fractional coordinate in [0, 1)."""
    return F.pmod(fraction, F.lit(1.0))


def minimum_image(difference: Column) -> Column:
    """Fractional difference to the nearest image; halves go to the even integer."""
    return difference - F.rint(difference)


def grid_points(length: Column, spacing: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(length / F.lit(spacing))).cast("int")


def replication(length: Column, minimum: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(minimum) / length)).cast("int")


def element_key(element: Column) -> Column:
    """Force-field key of an element symbol: its first two letters in lower case."""
    return F.substring(F.lower(element), 1, 2)
