"""Descriptors of ordered paths: arc length, jumps, peaks, roughness, entropy, tortuosity.

A path table has the group keys, a dense index ``seq``, Cartesian ``x, y, z`` and energy ``e``.
All functions take the ``Sequence`` of the table, see ``ordered``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from porescreen.functions.numbers import norm3
from porescreen.operators.ordered import (
    Sequence, carried, compact, group_median, group_values, neighbours, recent, running_sum)
from porescreen.operators.prominence import side_minima
from porescreen.session import cut_lineage

# Fixed values of the descriptor definitions.
JUMP_MAD_FACTOR = 5.0
JUMP_WIDTH = 3
JUMP_MERGE_GAP = 2
PEAK_PROMINENCE = 3.0
MIN_ROWS_READ = 5
MIN_NODES = 4
ENTROPY_MIN_RANGE = 0.1
FLOOR = 1e-6
REPEAT_TOLERANCE = 1e-8
MAD_FLOOR = 1e-10
# Bits below which an earlier link of a chain of jump groups can't change a double.
NEGLIGIBLE_BITS = 62
# Rows of a track that a displacement task transforms at once, and lags up to which looking ahead row by row is quicker.
LAG_ROWS, FEW_LAGS = 1 << 16, 8
# Rows of short blocks that one displacement task gets together.
ROWS_OF_CALL = 1 << 14


def drop_repeated_points(path: DataFrame, seq: Sequence, tolerance: float = REPEAT_TOLERANCE) -> DataFrame:
    """Drop rows that lie on their raw predecessor and renumber; the first of a run stays."""
    before = neighbours(path, seq, {"_x": ("x", 1), "_y": ("y", 1), "_z": ("z", 1)})
    step = norm3(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"), F.col("z") - F.col("_z"))
    kept = before.filter(F.col("_x").isNull() | (step > tolerance)).drop("_x", "_y", "_z")
    return compact(kept, seq)


def segment_lengths(path: DataFrame, seq: Sequence) -> DataFrame:
    """Add ``ds`` (length of the step into the row, 0 for the first), ``s`` (arc length so far)
    and ``e_mid`` (mean energy of the step)."""
    before = neighbours(path, seq, {"_x": ("x", 1), "_y": ("y", 1), "_z": ("z", 1), "_e": ("e", 1)})
    step = norm3(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"), F.col("z") - F.col("_z"))
    steps = (before.withColumn("ds", F.coalesce(step, F.lit(0.0)))
             .withColumn("e_mid", 0.5 * (F.col("_e") + F.col("e")))
             .drop("_x", "_y", "_z", "_e"))
    return running_sum(steps, seq, F.col("ds"), "s")


def step_outliers(path: DataFrame, seq: Sequence, mad_factor: float = JUMP_MAD_FACTOR) -> DataFrame:
    """Add ``d_e`` (absolute step to the next row), its median ``med`` and ``mad`` over the path,
    and ``jump``: the step exceeds ``med + mad_factor * mad``.  Quiet or very short paths have none."""
    ahead = neighbours(path, seq, {"_e": ("e", -1)}).withColumn("d_e", F.abs(F.col("_e") - F.col("e")))
    med = group_median(ahead.drop("_e"), seq, "d_e", "med")
    dev = med.withColumn("_dev", F.abs(F.col("d_e") - F.col("med")))
    mad = group_median(dev, seq, "_dev", "mad").drop("_dev")
    sized = group_values(mad, seq, {"n": F.count(F.lit(1))})
    jump = ((F.col("n") >= MIN_NODES) & (F.col("mad") >= MAD_FLOOR)
            & (F.col("d_e") > F.col("med") + mad_factor * F.col("mad")))
    return sized.withColumn("jump", F.coalesce(jump, F.lit(False)))


def jump_groups(outliers: DataFrame, seq: Sequence, merge_gap: int = JUMP_MERGE_GAP) -> DataFrame:
    """Merge jump indices at most ``merge_gap`` apart: one row (group_no, left, right) per group,
    where ``left`` is the first jump index and ``right`` the index after the last one."""
    at = outliers.filter("jump").select(*seq.keys, seq.pos, F.col(seq.pos).alias("at"))
    at = compact(at, seq)
    gap = neighbours(at, seq, {"_prev": ("at", 1)})
    opens = F.when(F.col("_prev").isNull() | (F.col("at") - F.col("_prev") > merge_gap), 1).otherwise(0)
    numbered = running_sum(gap, seq, opens, "group_no")
    return numbered.groupBy(*seq.keys, "group_no").agg(
        F.min("at").alias("left"), (F.max("at") + 1).alias("right"))


def _fold_links(links: Column, reach: int) -> Column:
    """Left mean of the last link, where each link reads shares of the left means of up to ``reach`` links before it."""
    start = F.array(*[F.lit(0.0)] * reach)
    last = F.aggregate(links, start, lambda values, link: F.slice(F.concat(F.array(
        link["own"] + sum((F.get(values, F.lit(k)) * F.get(link["shares"], F.lit(k)) for k in range(reach)), F.lit(0.0))),
        values), 1, reach))
    return F.get(last, F.lit(0))


def repair_jumps(path: DataFrame, seq: Sequence, mad_factor: float = JUMP_MAD_FACTOR,
                 width: int = JUMP_WIDTH) -> DataFrame:
    """Add ``e_smooth``: jump groups replaced by a linear blend of the means beside them.

    The groups of a path count from left to right, and the ``width`` points left of a group may hold repaired points
    of the groups before it.  A repaired point is a blend of its own group's left and right mean, so the left means
    are a linear recurrence over as many groups as fit into the width.  The shares of one step sum to less than
    (width - 2) / (2 width), at most a half, so that an earlier link fades below the last bit after a number of links
    that follows from the width; so many are read.
    """
    reach = max(1, -(-(width - 2) // 3))
    fading = math.log2(2 * width / (width - 2)) if width > 2 else 1.0
    links_read = math.ceil(NEGLIGIBLE_BITS / fading) * reach
    # Written out: the groups, their surroundings and the result all read these rows.
    rows = cut_lineage(step_outliers(path, seq, mad_factor))
    groups = jump_groups(rows, seq)
    look = {f"_b{k}": ("e", k) for k in range(1, width + 1)}
    look |= {f"_a{k}": ("e", -k) for k in range(1, width + 1)}
    beside = neighbours(rows.select(*seq.keys, seq.pos, "e"), seq, look)

    def mean_of(prefix: str) -> Column:
        terms = [F.col(f"{prefix}{k}") for k in range(1, width + 1)]
        total = sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))
        count = sum((t.isNotNull().cast("int") for t in terms), F.lit(0))
        return F.when(count > 0, total / count).otherwise(F.col("e"))

    sides = beside.select(*seq.keys, F.col(seq.pos).alias("_at"), *[F.col(f"_b{k}") for k in range(1, width + 1)],
                          F.col("e").alias("_here"), mean_of("_a").alias("_right_mean"))
    g = (groups.join(sides.drop("_right_mean").withColumnRenamed("_at", "left"), [*seq.keys, "left"])
         .join(sides.select(*seq.keys, F.col("_at").alias("right"), F.col("_right_mean").alias("e_right")),
               [*seq.keys, "right"]))
    g = g.withColumn("_n", F.col("right") - F.col("left"))
    # Groups have a dense number from 1.
    order = seq.over(*seq.keys)
    ranked = g.withColumn(seq.pos, F.col("group_no") - 1)
    look = {f"{new}{k}": (old, k) for k in range(1, reach + 1)
            for new, old in (("_pl", "left"), ("_pr", "right"), ("_pe", "e_right"), ("_pn", "_n"))}
    last = neighbours(ranked, order, look)
    count = sum((F.col(f"_b{j}").isNotNull().cast("int") for j in range(1, width + 1)), F.lit(0))
    own, shares = F.lit(0.0), [F.lit(0.0)] * reach
    for j in range(1, width + 1):
        at, value = F.col("left") - j, F.coalesce(F.col(f"_b{j}"), F.lit(0.0))
        for k in range(1, reach + 1):
            inside = F.coalesce((at >= F.col(f"_pl{k}")) & (at < F.col(f"_pr{k}")), F.lit(False))
            alpha = (at - F.col(f"_pl{k}") + 1) / (F.col(f"_pn{k}") + 1)
            value = F.when(inside, F.col(f"_pe{k}") * alpha).otherwise(value)
            shares[k - 1] = shares[k - 1] + F.when(inside, 1.0 - alpha).otherwise(0.0)
        own = own + value
    link = F.struct(F.when(count > 0, own / count).otherwise(F.col("_here")).alias("own"),
                    F.array(*[F.when(count > 0, s / count).otherwise(0.0) for s in shares]).alias("shares"))
    linked = recent(last.withColumn("_link", link), order, "_link", "_links", links_read)
    blends = linked.select(
        *seq.keys, F.col("left").alias("_left"), "_n", "e_right", _fold_links(F.col("_links"), reach).alias("_e_left"),
        F.explode(F.expr("sequence(left, right - 1)")).alias(seq.pos))
    alpha = (F.col(seq.pos) - F.col("_left") + 1) / (F.col("_n") + 1)
    blends = blends.select(
        *seq.keys, seq.pos,
        (F.col("_e_left") * (1.0 - alpha) + F.col("e_right") * alpha).alias("_blend"))
    out = rows.join(blends, [*seq.keys, seq.pos], "left")
    return out.withColumn("e_smooth", F.coalesce("_blend", "e")).drop("_blend", "d_e", "med", "mad", "jump", "n")


def extremes(path: DataFrame, seq: Sequence, value: str = "e_smooth",
             prominence: float = PEAK_PROMINENCE) -> DataFrame:
    """Local maxima and minima of ``value`` with at least the given prominence.

    Equal neighbours form one plateau that counts at its midpoint (rounded down); plateaus that
    touch an end never count.  One row (kind, idx, height, prominence) per extreme.
    """
    prev = neighbours(path.select(*seq.keys, seq.pos, value), seq, {"_prev": (value, 1)})
    starts = prev.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col(value)))
    runs = compact(starts.select(*seq.keys, seq.pos, F.col(seq.pos).alias("_from"), F.col(value).alias("_h")), seq)
    beside = neighbours(runs, seq, {"_lo": ("_h", 1), "_hi": ("_h", -1), "_next": ("_from", -1)})
    idx = F.floor((F.col("_from") + F.col("_next") - 1) / 2)
    kind = (F.when((F.col("_h") > F.col("_lo")) & (F.col("_h") > F.col("_hi")), 1)
            .when((F.col("_h") < F.col("_lo")) & (F.col("_h") < F.col("_hi")), -1))
    marked = beside.select(*seq.keys, seq.pos, "_h", kind.alias("_kind"), idx.alias("_idx"))
    solved = side_minima(marked, seq, "_h", "_kind")
    found = (solved.filter(F.col("_drop") >= prominence)
             .select(*seq.keys, F.col("_idx").alias("idx"),
                     F.when(F.col("_kind") == 1, F.lit("peak")).otherwise(F.lit("valley")).alias("kind"),
                     F.col("_h").alias("height"), F.col("_drop").alias("prominence")))
    return found


def flank_slopes(path: DataFrame, seq: Sequence, found: DataFrame) -> DataFrame:
    """One row per peak: bordering valleys (or the path ends) and the steeper flank slope.

    Extremes come from the repaired energies, slopes from the raw ``e`` and the chord lengths."""
    point = F.struct(F.col(seq.pos).alias("idx"), "e", "x", "y", "z")
    ends = path.groupBy(*seq.keys).agg(
        F.min_by(point, F.col(seq.pos)).alias("_start"), F.max_by(point, F.col(seq.pos)).alias("_end"))
    at = path.select(*seq.keys, F.col(seq.pos).alias("idx"), point.alias("_point"))
    marks = (found.select(*seq.keys, "idx", "kind").join(at, [*seq.keys, "idx"])
             .withColumn(seq.pos, F.col("idx")))
    marks = compact(marks, seq).withColumn("_valley", F.when(F.col("kind") == "valley", F.col("_point")))
    marks = carried(carried(marks, seq, "_valley", "_left"), seq, "_valley", "_right", ahead=True)
    peaks = marks.filter(F.col("kind") == "peak").join(ends, list(seq.keys))
    peaks = peaks.withColumn("_left", F.coalesce("_left", "_start")).withColumn(
        "_right", F.coalesce("_right", "_end"))

    def slope(side: str) -> Column:
        p, q = F.col("_point"), F.col(side)
        chord = norm3(p["x"] - q["x"], p["y"] - q["y"], p["z"] - q["z"])
        return (p["e"] - q["e"]) / F.greatest(chord, F.lit(FLOOR))

    return peaks.select(
        *seq.keys, F.col("idx").alias("peak_idx"), F.col("_left.idx").alias("left_idx"),
        F.col("_right.idx").alias("right_idx"), F.greatest(slope("_left"), slope("_right")).alias("slope"))


def path_totals(path: DataFrame, seq: Sequence, axis: Column) -> DataFrame:
    """Per path, from one pass over its steps: length, extremes of the energy, length-weighted mean and standard
    deviation of the step energies, tortuosity and main-axis efficiency; ``axis`` names the direction X, Y or Z."""
    steps = segment_lengths(path.withColumn("_axis", axis), seq)
    totals = {"_total": F.sum("ds"), "_mean_sum": F.sum(F.col("ds") * F.col("e_mid"))}
    centred = group_values(steps, seq, totals).withColumn("_mean", F.col("_mean_sum") / F.col("_total"))
    dev = F.col("ds") / F.col("_total") * F.pow(F.col("e_mid") - F.col("_mean"), 2)
    point = F.struct("x", "y", "z")
    ends = centred.groupBy(*seq.keys).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max("s").alias("length"),
        F.min("e").alias("e_min"), F.max("e").alias("e_max"), (F.max("e") - F.min("e")).alias("e_range"),
        F.max("_mean").alias("e_mean"), F.sqrt(F.sum(dev)).alias("sigma_e"), F.first("_axis").alias("_axis"),
        F.min_by(point, F.col(seq.pos)).alias("_p"), F.max_by(point, F.col(seq.pos)).alias("_q"))
    dx, dy, dz = (F.col("_q")[c] - F.col("_p")[c] for c in "xyz")
    along = F.abs(F.when(F.col("_axis") == "X", dx).when(F.col("_axis") == "Y", dy).otherwise(dz))
    return ends.withColumns({
        "chord": norm3(dx, dy, dz), "tortuosity": F.col("length") / F.greatest(norm3(dx, dy, dz), F.lit(FLOOR)),
        "eta_main": along / F.greatest(F.col("length"), F.lit(FLOOR))}).drop("_axis", "_p", "_q")


def energy_spread(path: DataFrame, seq: Sequence) -> DataFrame:
    """Per path: node count, length, energy extremes, and the length-weighted mean and standard deviation."""
    return path_totals(path, seq, F.lit("X")).drop("chord", "tortuosity", "eta_main")


def path_geometry(path: DataFrame, seq: Sequence, axis: Column) -> DataFrame:
    """Per path: tortuosity and main-axis efficiency; ``axis`` names the direction X, Y or Z."""
    return path_totals(path, seq, axis).select(*seq.keys, "length", "chord", "tortuosity", "eta_main")


def energy_entropy(path: DataFrame, keys) -> DataFrame:
    """Differential entropy per path of the raw energies in min(20, max(5, n // 5)) equal bins.

    Bin counts are partial aggregates, so the shuffle carries bins and not rows."""
    keys = list(keys)
    span = path.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("e").alias("_lo"), F.max("e").alias("_hi"))
    span = span.withColumn("_bins", F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.col("_n") / 5))).cast("int"))
    wide = span.filter(F.col("_hi") - F.col("_lo") > ENTROPY_MIN_RANGE)
    # The share of the width first: another order of the operations puts values at a bin edge elsewhere.
    share = (F.col("e") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    binned = path.select(*keys, "e").join(wide, keys).withColumn(
        "_bin", F.least(F.floor(share * F.col("_bins")), F.col("_bins").cast("long") - 1))
    counts = binned.groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"),
        F.max((F.col("_hi") - F.col("_lo")) / F.col("_bins")).alias("_width"))
    density = F.col("_c") / (F.col("_n") * F.col("_width"))
    sums = counts.groupBy(*keys).agg(
        (-F.sum(density * F.log(density + 1e-30) * F.col("_width"))).alias("_h"))
    return span.join(sums, keys, "left").select(
        *keys, F.col("_n").alias("n_nodes"), F.col("_bins").alias("bins"),
        F.coalesce("_h", F.lit(0.0)).alias("h_entropy"))


def describe_paths(path: DataFrame, seq: Sequence, axis: Column) -> DataFrame:
    """All path descriptors; paths with fewer than four distinct nodes keep NULLs."""
    clean = drop_repeated_points(path, seq)
    sized = group_values(clean, seq, {"_n": F.count(F.lit(1))}).filter(F.col("_n") >= MIN_NODES).drop("_n")
    # Written out: every descriptor reads the cleaned paths.
    sized, keys = cut_lineage(sized), list(seq.keys)
    totals = path_totals(sized, seq, axis)
    entropy = energy_entropy(sized, keys).select(*keys, "h_entropy")
    found = extremes(repair_jumps(sized, seq), seq)
    slopes = flank_slopes(sized, seq, found).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_peaks"), F.avg("slope").alias("_slope"))
    every = path.select(*keys).distinct()
    out = every.join(totals, keys, "left").join(entropy, keys, "left").join(slopes, keys, "left")
    known = F.col("n_nodes").isNotNull()
    n_peaks = F.coalesce("n_peaks", F.lit(0))
    return out.select(
        *keys, "e_max", "sigma_e",
        F.when(known, n_peaks / F.greatest(F.col("length"), F.lit(FLOOR))).alias("barrier_freq"),
        F.when(known, F.coalesce("_slope", F.lit(0.0))).alias("peak_slope_mean"),
        "tortuosity", "eta_main", "h_entropy")


def unwrap_periodic(path: DataFrame, seq: Sequence, columns: dict[str, Column | str]) -> DataFrame:
    """Remove periodic wraps: ``columns`` maps an index column to its period.

    A step of more than half a period into a row shifts this and all later rows by one period."""
    before = neighbours(path, seq, {f"_{c}": (c, 1) for c in columns})
    for name, period in columns.items():
        n = F.col(period) if isinstance(period, str) else period
        step = F.col(name) - F.col(f"_{name}")
        shift = F.when(step > n * 0.5, -n).when(step < -n * 0.5, n).otherwise(n * 0)
        before = running_sum(before, seq, shift, f"_s_{name}").withColumn(name, F.col(name) + F.col(f"_s_{name}"))
    return before.drop(*[f"_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def rebuild_periodic(path: DataFrame, seq: Sequence, axis: Column, lengths: dict[str, Column],
                     min_nodes: int = 30, path_drift: float = 0.20, segment_drift: float = 0.05) -> DataFrame:
    """Replace drifting paths by three copies of their straightened middle third.

    ``axis`` is the traversal direction (X, Y, Z) and ``lengths`` the cell edge per coordinate.
    A path qualifies when it has ``min_nodes`` nodes and its end-to-end shift along a transverse
    coordinate exceeds ``path_drift`` of the edge.  Inside the middle third, a shift above
    ``segment_drift`` is removed by a linear ramp.  Other paths pass unchanged.
    """
    keys, pos = list(seq.keys), F.col(seq.pos)
    rows = path.withColumns({"_axis": axis} | {f"_cell_{c}": v for c, v in lengths.items()})
    point = F.struct("x", "y", "z")
    rows = group_values(rows, seq, {
        "_n": F.count(F.lit(1)), "_p": F.min_by(point, pos), "_q": F.max_by(point, pos)})
    letter = {"x": "X", "y": "Y", "z": "Z"}
    drifts = [(F.col("_axis") != letter[c])
              & (F.abs(F.col("_q")[c] - F.col("_p")[c]) > path_drift * F.col(f"_cell_{c}")) for c in "xyz"]
    rows = rows.withColumn("_drifts", (F.col("_n") >= min_nodes) & (drifts[0] | drifts[1] | drifts[2]))
    first, stop = F.floor(F.col("_n") / 3), F.floor(2 * F.col("_n") / 3)
    middle = rows.filter(F.col("_drifts") & (pos >= first) & (pos < stop)).withColumn("_k", pos - first)
    middle = group_values(middle, seq, {
        "_m": F.count(F.lit(1)), "_u": F.min_by(point, pos), "_v": F.max_by(point, pos)})
    ramp = F.when(F.col("_m") > 1, F.col("_k") / (F.col("_m") - 1)).otherwise(F.lit(0.0))
    straight = {}
    for c in "xyz":
        shift = F.col("_v")[c] - F.col("_u")[c]
        mends = (F.col("_axis") != letter[c]) & (F.abs(shift) > segment_drift * F.col(f"_cell_{c}"))
        along = F.col(c) - F.col("_u")[c] + F.col("_p")[c] + F.col("_copy") * F.greatest(shift, F.lit(FLOOR))
        straight[c] = (F.when(F.col("_axis") == letter[c], along)
                       .when(mends, F.col(c) - ramp * shift).otherwise(F.col(c)))
    copies = middle.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    copies = copies.select(*keys, (F.col("_copy") * F.col("_m") + F.col("_k")).alias(seq.pos),
                           *[v.alias(c) for c, v in straight.items()], "e")
    return rows.filter(~F.col("_drifts")).select(*keys, seq.pos, "x", "y", "z", "e").unionByName(copies)


def _lag_sums(near: np.ndarray, far: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lags from 1, pairs, sums of squared steps per axis) between the rows of two blocks, ``far`` beginning ``ahead`` rows later.

    A squared step is a square plus a square minus twice a product: the squares come from running sums, the products of all
    lags at once from a Fourier correlation."""
    middle = near.mean(axis=0)
    near, far = near - middle, far - middle
    n, m = len(near), len(far)
    size = 1 << int(n + m - 1).bit_length()
    product = np.fft.irfft(np.conj(np.fft.rfft(near, size, axis=0)) * np.fft.rfft(far, size, axis=0), size, axis=0)
    shift = np.arange(max(-(n - 1), 1 - ahead), m)
    first, stop = np.maximum(0, -shift), np.minimum(n, m - shift)
    square = lambda x: np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x * x, axis=0)])
    a, b = square(near), square(far)
    sums = a[stop] - a[first] + b[stop + shift] - b[first + shift] - 2 * product[shift % size]
    return shift + ahead, stop - first, sums


def _few_lags(track: DataFrame, seq: Sequence, lags: int, group: str | None) -> DataFrame:
    ahead = {f"_{c}{k}": (c, -k) for k in range(1, lags + 1) for c in "xyz"}
    rows = neighbours(track, seq, ahead)
    steps = F.explode(F.array(*[
        F.struct(F.lit(k).alias("lag"), *[(F.col(f"_{c}{k}") - F.col(c)).alias(f"d{c}") for c in "xyz"])
        for k in range(1, lags + 1)]))
    by = [group] if group else []
    moved = rows.select(*by, steps.alias("_d")).select(*by, "_d.*").filter(F.col("dx").isNotNull())
    sq = {c: F.avg(F.col(f"d{c}") * F.col(f"d{c}")) for c in "xyz"}
    return moved.groupBy(*by, "lag").agg(
        F.count(F.lit(1)).alias("n_pairs"), sq["x"].alias("msd_x"), sq["y"].alias("msd_y"),
        sq["z"].alias("msd_z"), (sq["x"] + sq["y"] + sq["z"]).alias("msd"))


def mean_squared_displacement(track: DataFrame, seq: Sequence, lags: int | None = None, group: str | None = None,
                              block_rows: int = LAG_ROWS) -> DataFrame:
    """Mean squared displacement by lag, in total and per axis, of unwrapped positions; at all lags unless ``lags`` bounds them.

    Up to FEW_LAGS every row looks at as many rows ahead.  Beyond, a track is cut into blocks, and each block meets those that
    its lags reach, in pairs.  A pair costs n log n, whatever the number of lags, and holds two blocks; its sums by lag are what
    is shuffled."""
    if lags is not None and lags <= FEW_LAGS:
        return _few_lags(track, seq, lags, group)
    by, keys = ([group] if group else []), list(seq.keys)
    rows = track.select(*dict.fromkeys([*by, *keys]), F.col(seq.pos).alias("_pos"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    rows = rows.withColumn("_block", F.floor(F.col("_pos") / block_rows))
    last = rows.groupBy(*keys).agg(F.max("_block").alias("_last")) if lags is None else None
    reach = F.col("_last") if lags is None else F.lit(-(-lags // block_rows))
    if last is not None:
        rows = rows.join(last, keys)
    # As the near block of pairs up to its reach, and as the far block of pairs that begin up to its reach before it.
    steps = F.sequence(F.lit(0).cast("long"), F.least(reach.cast("long"), F.col("_last") - F.col("_block") if last is not None else reach.cast("long")))
    back = F.sequence(F.lit(0).cast("long"), F.least(reach.cast("long"), F.col("_block")))
    near = rows.withColumn("_ahead", F.explode(steps)).withColumn("_far", F.lit(False))
    far = rows.withColumn("_ahead", F.explode(back)).withColumn("_far", F.lit(True)).withColumn("_block", F.col("_block") - F.col("_ahead"))
    kinds = [T.StructField(g, track.schema[g].dataType) for g in by] + [T.StructField("lag", T.IntegerType()), T.StructField("n", T.LongType())] + [
        T.StructField(f"s{c}", T.DoubleType()) for c in "xyz"]

    used = [*dict.fromkeys([*by, *keys]), "_block", "_ahead", "_far", "_pos", "x", "y", "z"]
    name = [*keys, "_block", "_ahead"]

    def solve(pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values([*name, "_far", "_pos"], kind="stable").reset_index(drop=True)
        new = np.append(True, pairs[name].ne(pairs[name].shift()).any(axis=1).to_numpy()[1:])
        cuts, places = [*np.flatnonzero(new), len(pairs)], pairs[["x", "y", "z"]].to_numpy(float)
        far, ahead, out = pairs["_far"].to_numpy(bool), pairs["_ahead"].to_numpy(np.int64), []
        of = pairs[group].to_numpy() if group else None
        for first, stop in zip(cuts, cuts[1:]):
            middle = first + int((~far[first:stop]).sum())
            if first < middle < stop:
                lag, n, sums = _lag_sums(places[first:middle], places[middle:stop], int(ahead[first]) * block_rows)
                keep = slice(None) if lags is None else lag <= lags
                out.append(pd.DataFrame({g: of[first] for g in by} | {"lag": lag[keep].astype(np.int32), "n": n[keep]}
                                        | {f"s{c}": sums[keep, k] for k, c in enumerate("xyz")}))
        if not out:
            return pd.DataFrame({k.name: [] for k in kinds})
        return pd.concat(out).groupby([*by, "lag"], dropna=False, as_index=False).sum()[[k.name for k in kinds]]

    # A call gets short pairs of many tracks, up to about the rows of one pair of the usual length.
    pairs = near.select(*used).unionByName(far.select(*used))
    if block_rows < ROWS_OF_CALL:
        parts = max(1, -(-pairs.count() // ROWS_OF_CALL))
        calls = pairs.groupBy(F.pmod(F.xxhash64(*name), F.lit(parts)).alias("_call"))
    else:
        calls = pairs.groupBy(*name)
    out = calls.applyInPandas(solve, T.StructType(kinds)).groupBy(*by, "lag").agg(
        F.sum("n").alias("n_pairs"), *[F.sum(f"s{c}").alias(f"s{c}") for c in "xyz"])
    mean = {c: F.greatest(F.col(f"s{c}") / F.col("n_pairs"), F.lit(0.0)) for c in "xyz"}
    return out.where("n_pairs > 0").select(
        *by, "lag", "n_pairs", *[m.alias(f"msd_{c}") for c, m in mean.items()], (mean["x"] + mean["y"] + mean["z"]).alias("msd"))
