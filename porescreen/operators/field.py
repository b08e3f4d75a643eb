"""Components, least bottlenecks, hops and paths on voxel graphs, brick by brick.

A voxel group (one framework, or one framework and axis) is cut into bricks of bounded volume. A call of a grouped job gets
bricks of up to BRICK_VOLUME voxels of a group, or of many small groups, and solves them together: the array operations work on
graphs, and bricks without edges between them are one graph. Edges between bricks of the same call are found there, those to
bricks of another call by a join.

  components  a brick labels its own voxels; labels that meet across a border make a graph, which ``contract`` solves
  minimax     a brick reports a spanning forest between its border voxels; ``contract`` finds the bottlenecks of these, and the
              brick then settles its inner voxels from them
  hops        steps from a start voxel along edges that keep the minimax value; rounds of bricks that exchange their borders
  trace       a brick reports where a chain that enters it leaves it; list ranking over the entries finds the bricks of a path

So but for the hops voxels are read twice, whatever the number of bricks that a path crosses. A group in one brick has no border
and needs no second pass.

``crossings`` solves groups that fit into a call there: copies along the axes are made in the call, and bottlenecks, hops and
paths are found on the whole group, so its voxels are shuffled once and no border is told.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from porescreen.operators import contract
from porescreen.session import cut_lineage

BRICK_VOLUME = 1 << 18
BRICK_EDGE = 64
AXES = ("i", "j", "k")
#: Parts of a call's room that the bricks of a call are hashed to, so that calls stay small where groups are.
PARTS_OF_CALL = 8
FAR = np.iinfo(np.int64).max
NO_HOP = 1 << 40


def offsets(neighbours: int) -> list[tuple[int, int, int]]:
    """The 6 face neighbours or all 26."""
    cube = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    return cube if neighbours == 26 else [o for o in cube if sum(map(abs, o)) == 1]


def voxel_number() -> Column:
    """Number of a voxel in its group, from i, j, k and the sizes nj, nk."""
    return (F.col("i").cast("long") * F.col("nj") + F.col("j")) * F.col("nk") + F.col("k")


def voxel_of(number: str) -> dict[str, Column]:
    """Voxel indices i, j, k of a voxel number."""
    return {"i": F.expr(f"cast({number} div nk div nj as int)"), "j": F.expr(f"cast(({number} div nk) % nj as int)"),
            "k": F.expr(f"cast({number} % nk as int)")}


def with_bricks(dims: DataFrame, volume: int = BRICK_VOLUME, edge: int = BRICK_EDGE) -> DataFrame:
    """Add brick edges (ei, ej, ek) and counts (bi_n ..) to the size table of the groups."""
    ek, ej = F.least("nk", F.lit(edge)), F.least("nj", F.lit(edge))
    ei = F.least(F.col("ni"), F.greatest(F.lit(1), F.floor(F.lit(volume) / (ek * ej)).cast("int")))
    out = dims.withColumns({"ek": ek, "ej": ej, "ei": ei})
    return out.withColumns({f"b{x}_n": F.ceil(F.col(f"n{x}") / F.col(f"e{x}")).cast("int") for x in AXES})


def _placements(axis: str) -> Column:
    """Bricks (b) in which a voxel appears along one axis, with its padded position (l) there."""
    x, n, e, m = F.col(axis), F.col(f"n{axis}"), F.col(f"e{axis}"), F.col(f"b{axis}_n")
    home = F.floor(x / e).cast("int")
    wrap = F.col(f"wrap_{axis}")

    def at(brick: Column, place: Column) -> Column:
        return F.struct(brick.cast("int").alias("b"), place.cast("int").alias("l"))

    first, last = x == home * e, (x == home * e + e - 1) | (x == n - 1)
    several = m > 1
    own = at(home, x - home * e + 1)
    below = F.when(several & first & (home > 0), at(home - 1, e + 1)) \
        .when(several & first & wrap, at(m - 1, n - (m - 1) * e + 1))
    above = F.when(several & last & (home < m - 1), at(home + 1, F.lit(0))) \
        .when(several & last & wrap, at(F.lit(0), F.lit(0)))
    return F.filter(F.array(own, below, above), lambda p: p.isNotNull())


def _spread(state: DataFrame, several: bool) -> DataFrame:
    """Rows by brick: each voxel in its own brick and, at a border, as a copy in the next one."""
    out = state
    if not several:
        place = {f"b{x}": F.lit(0) for x in AXES} | {f"l{x}": F.col(x) + 1 for x in AXES}
        return out.withColumns(place | {"own": F.lit(True)})
    for x in AXES:
        out = out.withColumn("_p", F.explode(_placements(x))).withColumns({f"b{x}": F.col("_p.b"), f"l{x}": F.col("_p.l")}).drop("_p")
    inside = F.lit(True)
    for x in AXES:
        inside = inside & (F.floor(F.col(x) / F.col(f"e{x}")) == F.col(f"b{x}")) & (F.col(f"l{x}") >= 1) & \
            (F.col(f"l{x}") == F.col(x) - F.col(f"b{x}") * F.col(f"e{x}") + 1)
    return out.withColumn("own", inside)


class _Rows:
    """The voxels of a call by group, brick and number: places, sizes, and dense numbers of their groups and bricks."""

    def __init__(self, part: pd.DataFrame, keys: list[str], volume: int, edge: int):
        group = np.zeros(len(part), np.int64)
        for key in keys:
            code, names = pd.factorize(part[key], use_na_sentinel=False)
            group = group * len(names) + code
        size = [part[f"n{x}"].to_numpy(np.int64) for x in AXES]
        ek, ej = np.minimum(size[2], edge), np.minimum(size[1], edge)
        extent = [np.minimum(size[0], np.maximum(1, volume // (ek * ej))), ej, ek]
        at = [part[x].to_numpy(np.int64) for x in AXES]
        # A copy beside a brick has the brick it was copied to; a voxel lies in its own.
        home = [part[f"b{x}"].to_numpy(np.int64) if f"b{x}" in part else a // e for x, a, e in zip(AXES, at, extent)]
        many = [-(-n // e) for n, e in zip(size, extent)]
        lin = (at[0] * size[1] + at[1]) * size[2] + at[2]
        block = (home[0] * many[1] + home[1]) * many[2] + home[2]
        order = np.lexsort((lin, block, group))
        group, block = group[order], block[order]
        next_group = np.append(False, group[1:] != group[:-1])
        self.part = part.take(order).reset_index(drop=True)
        self.group, self.brick = np.cumsum(next_group), np.cumsum(next_group | np.append(False, block[1:] != block[:-1]))
        self.lin, self.at, self.size, self.extent, self.home, self.many = lin[order], *(
            [a[order] for a in arrays] for arrays in (at, size, extent, home, many))
        bits = self.part["wraps"].to_numpy(np.int64)
        self.wraps = [(bits >> axis & 1).astype(bool) for axis in range(3)]

    def __len__(self) -> int:
        return len(self.lin)

    @property
    def border(self) -> np.ndarray:
        """Voxels at the border of a brick to another one."""
        out = np.zeros(len(self), bool)
        for a, n, e, m in zip(self.at, self.size, self.extent, self.many):
            out |= (m > 1) & ((a % e == 0) | (a % e == e - 1) | (a == n - 1))
        return out

    def within(self, steps, padded: bool = False):
        """For every step: the row next to each row in its brick, also through a face that wraps onto the brick itself, or
        the number of rows. ``padded`` rows have places l in the brick, with those of the next bricks around them."""
        whole = [m == 1 for m in self.many]
        size = [np.where(w, n, e) + 2 * padded for w, n, e in zip(whole, self.size, self.extent)]
        at = [self.part[f"l{x}"].to_numpy(np.int64) for x in AXES] if padded else [a - h * e for a, h, e in zip(self.at, self.home, self.extent)]
        first = np.flatnonzero(np.append(True, self.brick[1:] != self.brick[:-1]))
        room = (size[0] * size[1] * size[2])[first]
        start = (np.cumsum(room) - room)[self.brick]
        where = np.full(int(room.sum()), len(self), np.int32)
        where[start + (at[0] * size[1] + at[1]) * size[2] + at[2]] = np.arange(len(self), dtype=np.int32)
        moved = []
        for a, n, w, wrap in zip(at, size, whole, self.wraps):
            ways, inner = {}, n - 2 * padded
            for d in (-1, 0, 1):
                to = np.where(w & wrap, (a + d - padded) % inner + padded, a + d)
                ways[d] = to, (to >= 0) & (to < n)
            moved.append(ways)
        for step in steps:
            (i, ok_i), (j, ok_j), (k, ok_k) = (ways[d] for ways, d in zip(moved, step))
            ok = ok_i & ok_j & ok_k
            yield np.where(ok, where[np.where(ok, start + (i * size[1] + j) * size[2] + k, 0)], len(self))

    def inside(self, steps) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of a brick that are neighbours in it."""
        u, v, every = [], [], np.arange(len(self))
        for near in self.within(steps):
            ok = np.flatnonzero((near < len(self)) & (near != every))
            u.append(ok)
            v.append(near[ok])
        return np.concatenate(u), np.concatenate(v).astype(np.int64)

    def between(self, steps) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows in different bricks of the same group that are neighbours."""
        on = np.flatnonzero(self.border)
        none = np.zeros(0, np.int64)
        if not len(on):
            return none, none
        first = np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1]))
        room = (self.size[0] * self.size[1] * self.size[2])[first]
        start = (np.cumsum(room) - room)[self.group]
        place = (start + self.lin)[on]
        order = np.argsort(place)
        place, rows = place[order], on[order]
        u, v = [], []
        for step in steps:
            ok, to = np.ones(len(on), bool), []
            for a, n, wrap, d in zip(self.at, self.size, self.wraps, step):
                t = a[on] + d
                ok &= wrap[on] | ((t >= 0) & (t < n[on]))
                to.append(t % n[on])
            goal = start[on] + (to[0] * self.size[1][on] + to[1]) * self.size[2][on] + to[2]
            at = np.minimum(np.searchsorted(place, goal), len(place) - 1)
            ok &= (place[at] == goal) & (self.brick[rows[at]] != self.brick[on])
            u.append(on[ok])
            v.append(rows[at][ok])
        return np.concatenate(u), np.concatenate(v)


class _Bricks:
    """Neighbour table of bricks with the rows around them: row v lists the rows next to it, or one past the end."""

    def __init__(self, rows: _Rows, steps):
        n = len(rows)
        self.own = rows.part["own"].to_numpy(bool)
        self.near = np.full((n, len(steps)), n, dtype=np.int32)
        for s, near in enumerate(rows.within(steps, padded=True)):
            self.near[self.own, s] = near[self.own]

    def settle(self, value: np.ndarray, improve, usable=None) -> np.ndarray:
        """Label-correcting search: voxels next to the last changes try again until none improves.

        ``usable`` restricts the edges along which a voxel may read a neighbour."""
        n = len(value)
        reads = self.near if usable is None else np.where(usable, self.near, n)
        padded = np.append(value, np.array([np.inf]) if value.dtype.kind == "f" else np.array([NO_HOP]))
        front = np.flatnonzero(self.own)
        while len(front):
            better = improve(padded[reads[front]].min(axis=1), front)
            falls = better < padded[front]
            changed = front[falls]
            padded[changed] = better[falls]
            mark = np.zeros(n + 1, dtype=bool)
            mark[self.near[changed]] = True
            mark[:-1] &= self.own
            front = np.flatnonzero(mark[:-1])
        return padded[:-1]


def _hop_solver(steps, columns):
    def solve(v: _Rows) -> pd.DataFrame:
        rows, brick = v.part, _Bricks(v, steps)
        e, w = rows["e"].to_numpy(float), np.append(rows["w"].fillna(np.inf).to_numpy(float), np.inf)
        lin = np.append(v.lin, FAR)
        old = rows["hop"].fillna(NO_HOP).to_numpy(np.int64)
        tight = (np.maximum(w[brick.near], e[:, None]) == w[:-1, None]) & np.isfinite(w[:-1, None])
        new = brick.settle(old, lambda near, at: near + 1, tight)
        # Parent: tight neighbour one hop nearer, least minimax value, then least voxel number.
        nearer = tight & (np.append(new, NO_HOP)[brick.near] + 1 == new[:, None])
        energy = np.where(nearer, w[brick.near], np.inf)
        first = nearer & (energy == energy.min(axis=1, keepdims=True))
        parent = np.where(first, lin[brick.near], FAR).min(axis=1)
        known = new < NO_HOP
        out = rows.assign(hop=pd.Series(new, index=rows.index, dtype="Int64").where(known),
                          parent=np.where(first.any(axis=1) & known & (new > 0), parent, -1))
        return out.assign(changed=new != old)[brick.own][columns]

    return solve


def _sized(rows: DataFrame, dims: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the sizes of their group, and its periodic axes as the bits of ``wraps``."""
    bits = [F.when(F.col(f"wrap_{x}"), 1 << axis).otherwise(0) for axis, x in enumerate(AXES)]
    return rows.join(dims.select(*keys, *SIZES, (bits[0] + bits[1] + bits[2]).alias("wraps")), keys)


def _cut(rows: DataFrame, volume: int, edge: int) -> DataFrame:
    """Add the bricks of voxels: edges and counts of the bricks of their group, and the brick of each voxel."""
    rows = with_bricks(rows, volume, edge)
    return rows.withColumns({f"b{x}": F.floor(F.col(x) / F.col(f"e{x}")).cast("int") for x in AXES} | {
        f"wrap_{x}": F.col("wraps").bitwiseAND(1 << axis) != 0 for axis, x in enumerate(AXES)})


def _per_call() -> Column:
    """Bricks of a group that go through one call: as many as hold BRICK_VOLUME voxels together."""
    return F.greatest(F.lit(1), F.floor(F.lit(BRICK_VOLUME) / (F.col("ei").cast("long") * F.col("ej") * F.col("ek"))))


def _bundle(brick: Column | None = None) -> Column:
    """The call of a brick among those of its group."""
    if brick is None:
        brick = (F.col("bi").cast("long") * F.col("bj_n") + F.col("bj")) * F.col("bk_n") + F.col("bk")
    return F.floor(brick / _per_call())


class _Job:
    """How the groups of a size table are cut: the brick, the most bricks along an axis, the calls, and whether any group
    takes more than one."""

    def __init__(self, dims: DataFrame, volume: int, edge: int):
        self.volume, self.edge = volume, edge
        bricks = F.col("bi_n").cast("long") * F.col("bj_n") * F.col("bk_n")
        most, voxels, split = with_bricks(dims, volume, edge).agg(
            F.max(F.greatest(*[F.col(f"b{x}_n") for x in AXES])), F.sum(F.col("ni").cast("double") * F.col("nj") * F.col("nk")),
            F.max(bricks > _per_call())).first()
        self.most, self.split = most or 1, bool(split)
        self.parts = max(1, math.ceil(PARTS_OF_CALL * (voxels or 0) / BRICK_VOLUME))

    def call(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys, _bundle()), F.lit(self.parts)).alias("call")

    def halves(self, dims: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The sizes of the groups that fit into a call, and those of the others, if there are any."""
        if not self.split:
            return dims, None
        several = F.col("bi_n").cast("long") * F.col("bj_n") * F.col("bk_n") > _per_call()
        cut = with_bricks(dims, self.volume, self.edge)
        return cut.where(~several).select(*dims.columns), cut.where(several).select(*dims.columns)

    def grouped(self, rows: DataFrame, keys: list[str], solve, fields: list[T.StructField]) -> DataFrame:
        """``solve`` on the bricks of every call; it names the row that a row of its result belongs to in the index, and the
        keys of that row are put before the columns."""
        schema = T.StructType([rows.schema[k] for k in keys] + fields)

        def run(part: pd.DataFrame) -> pd.DataFrame:
            v = _Rows(part, keys, self.volume, self.edge)
            found = solve(v)
            for place, key in enumerate(keys):
                found.insert(place, key, v.part[key].to_numpy()[found.index.to_numpy()])
            return found

        used = rows.columns
        return _cut(rows, self.volume, self.edge).groupBy(self.call(keys)).applyInPandas(
            lambda part: run(part[used]), schema)


def job_of(dims: DataFrame, volume: int = BRICK_VOLUME, edge: int = BRICK_EDGE, room: int | None = None) -> _Job:
    """How the groups of ``dims`` are cut into bricks and calls."""
    return _Job(dims, volume, edge)


def _half(neighbours: int) -> list[tuple[int, int, int]]:
    """One of each pair of opposite steps."""
    return [s for s in offsets(neighbours) if s > (0, 0, 0)]


def _across(rows: DataFrame, keys: list[str], values: list[str], steps, job: _Job) -> DataFrame:
    """Pairs of voxels in bricks of different calls that are neighbours: (keys, values, values of the other with `_`)."""
    def moved(x: str, d: int) -> Column:
        to, n = F.col(x) + d, F.col(f"n{x}")
        return F.when((to >= 0) & (to < n), to).when(F.col(f"wrap_{x}"), F.pmod(to, n))

    several = F.col("bi_n").cast("long") * F.col("bj_n") * F.col("bk_n") > _per_call()
    rows = _cut(rows, job.volume, job.edge).where(several).withColumn("lin", voxel_number())
    ways = F.array(*[F.struct(*[moved(x, d).alias(x) for x, d in zip(AXES, step)]) for step in steps])
    out = rows.withColumn("to", F.explode(ways))
    b = {x: F.floor(F.col(f"to.{x}") / F.col(f"e{x}")).cast("long") for x in AXES}
    # A step out of an open face leads to null, and so does the comparison.
    other = _bundle((b["i"] * F.col("bj_n") + b["j"]) * F.col("bk_n") + b["k"]) != _bundle()
    number = (F.col("to.i").cast("long") * F.col("nj") + F.col("to.j")) * F.col("nk") + F.col("to.k")
    out = out.where(other).select(*keys, *values, number.alias("_lin"))
    return out.join(rows.select(*keys, *[F.col(c).alias("_" + c) for c in dict.fromkeys(["lin", *values])]), [*keys, "_lin"])


SIZES = [f"n{x}" for x in AXES]
_INDEX = [T.StructField(x, T.IntegerType()) for x in AXES]
_LONG, _DOUBLE = T.LongType(), T.DoubleType()


def components(voxels: DataFrame, dims: DataFrame, keys: list[str], neighbours: int = 26, volume: int = BRICK_VOLUME,
               edge: int = BRICK_EDGE, room: int = contract.ROOM) -> DataFrame:
    """Connected components; ``label`` is the least voxel number of the component.

    ``voxels`` has the keys, i, j and k.  ``dims`` has one row per group: ni, nj, nk and the periodic axes wrap_i, wrap_j,
    wrap_k."""
    job, steps = _Job(dims, volume, edge), _half(neighbours)
    rows = _sized(voxels.select(*keys, *AXES), dims, keys)

    def label(v: _Rows) -> pd.DataFrame:
        name = v.lin[contract.merged(len(v), *v.inside(steps))]
        out = v.part[[*AXES]].assign(label=name)
        if job.most == 1:
            return out
        a, b = v.between(steps)
        met = pd.DataFrame({"group": v.group[a], "label": name[a], "met": name[b]}, index=a).drop_duplicates().drop(columns="group")
        return pd.concat([out.assign(met=pd.Series(pd.NA, index=out.index, dtype="Int64")).astype({x: "Int32" for x in AXES}),
                          met.assign(**{x: pd.Series(pd.NA, index=met.index, dtype="Int32") for x in AXES}).astype({"met": "Int64"})])[
            [*AXES, "label", "met"]]

    fields = [*_INDEX, T.StructField("label", _LONG)]
    if job.most == 1:
        return job.grouped(rows, keys, label, fields)
    # The voxels with their labels, and the pairs of labels that meet.
    both = cut_lineage(job.grouped(rows, keys, label, [*fields, T.StructField("met", _LONG)]))
    found = both.where("met IS NULL").drop("met")
    edges = both.where("met IS NOT NULL").select(*keys, F.col("label").alias("a"), F.col("met").alias("b"))
    if job.split:
        apart = _across(_sized(found, dims, keys), keys, ["label"], steps, job)
        edges = edges.unionAll(apart.select(*keys, F.col("label").alias("a"), F.col("_label").alias("b")))
    least = contract.spread_components(edges, keys, room).withColumnRenamed("node", "label")
    # A label names voxels of one brick, so no key of this join has more rows than a brick.
    return found.join(least, [*keys, "label"], "left").select(*keys, *AXES, F.coalesce("least", "label").alias("label"))


def spread(seeded: DataFrame, dims: DataFrame, keys: list[str], neighbours: int = 26, volume: int = BRICK_VOLUME,
           edge: int = BRICK_EDGE, room: int = contract.ROOM) -> DataFrame:
    """Least possible highest ``e`` on a path from the voxels with a ``w`` (their start value), as ``w``; NULL out of reach.

    Where groups have several bricks, ``seeded`` is computed twice and not written, as copies by axis may be many."""
    job, steps = _Job(dims, volume, edge), _half(neighbours)
    rows = _sized(seeded.select(*keys, *AXES, "e", "w"), dims, keys)
    several = job.most > 1

    def weighted(v: _Rows, pairs):
        e, (a, b) = v.part["e"].to_numpy(float), pairs
        return a, b, np.maximum(e[a], e[b])

    def report(v: _Rows) -> pd.DataFrame:
        # One source for all groups: no path between two voxels of a forest leads through it from one group to another.
        n, lin, border = len(v), np.append(v.lin, contract.SOURCE), v.border
        a, b, w = weighted(v, v.inside(steps))
        starts = np.flatnonzero(v.part["w"].notna())
        a, b = np.concatenate([a, starts]), np.concatenate([b, np.full(len(starts), n)])
        w = np.concatenate([w, v.part["w"].to_numpy(float)[starts]])
        a, b, w = contract.between(n + 1, *contract.forest(n + 1, a, b, w), np.append(border, True))
        c, d, x = weighted(v, v.between(steps))
        a, b, w = np.concatenate([a, c]), np.concatenate([b, d]), np.concatenate([w, x])
        out = pd.DataFrame({"a": lin[a], "b": lin[b], "w": w}, index=np.minimum(a, b))
        # A group in one brick is settled without the others.
        alone = np.logical_and.reduce([m == 1 for m in v.many])
        return out[~alone[out.index.to_numpy()]]

    def settle(v: _Rows) -> pd.DataFrame:
        n, start = len(v), v.part["w"].fillna(np.inf).to_numpy(float)
        if several:
            start = np.fmin(start, v.part["told"].to_numpy(float))
        a, b, w = weighted(v, v.inside(steps))
        known = np.flatnonzero(np.isfinite(start))
        a, b, w = np.concatenate([a, known]), np.concatenate([b, np.full(len(known), n)]), np.concatenate([w, start[known]])
        found = contract.bottlenecks(n + 1, a, b, w, n)[:-1]
        return v.part[[*AXES, "e"]].assign(w=pd.Series(found, index=v.part.index).where(np.isfinite(found)))

    if several:
        edges = job.grouped(rows, keys, report, [T.StructField("a", _LONG), T.StructField("b", _LONG), T.StructField("w", _DOUBLE)])
        if job.split:
            edges = edges.unionAll(_across(rows, keys, ["lin", "e"], steps, job).select(
                *keys, F.col("lin").alias("a"), F.col("_lin").alias("b"), F.greatest("e", "_e").alias("w")))
        told = contract.spread_bottlenecks(edges, keys, room)
        rows = rows.withColumn("lin", voxel_number()).join(
            told.select(*keys, F.col("node").alias("lin"), F.col("w").alias("told")), [*keys, "lin"], "left").drop("lin")
    return job.grouped(rows, keys, settle, [*_INDEX, T.StructField("e", _DOUBLE), T.StructField("w", _DOUBLE)])


def minimax(voxels: DataFrame, dims: DataFrame, keys: list[str], start: Column, neighbours: int = 26, **bricks) -> DataFrame:
    """Least possible highest ``e`` on a path from the start voxels (``w``; NULL if unreachable)."""
    return spread(voxels.select(*keys, *AXES, "e", F.when(start, F.col("e")).alias("w")), dims, keys, neighbours, **bricks)


def count_hops(seeded: DataFrame, dims: DataFrame, keys: list[str], neighbours: int = 26, volume: int = BRICK_VOLUME,
               edge: int = BRICK_EDGE, room: int | None = None) -> DataFrame:
    """Steps from the voxels of hop 0 along minimax-tight edges (e, w), and the ``parent`` voxel number (-1: none).

    Each round brings a brick, with copies of the voxels next to it, to its own fixpoint; then the borders are exchanged. A
    group leaves the loop as soon as it is stable."""
    job, values = _Job(dims, volume, edge), ["e", "w", "hop", "lin"]
    carried = [*keys, *AXES, *values, *SIZES, "wraps"]
    state = _sized(seeded, dims, keys).withColumn("lin", voxel_number()).select(*carried)
    fields = [*state.schema.fields, T.StructField("parent", _LONG), T.StructField("changed", T.BooleanType())]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    solve = _hop_solver(offsets(neighbours), [f.name for f in fields])
    result = [*keys, *AXES, *values, "parent"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return solve(_Rows(part, keys, volume, edge))

    def one_round(df: DataFrame, several: bool = True) -> DataFrame:
        around = _spread(_cut(df.select(*carried), volume, edge), several)
        return around.select(*carried, *[f"{c}{x}" for c in "bl" for x in AXES], "own", job.call(keys)).groupBy("call").applyInPandas(
            lambda part: run(part), schema)

    if job.most == 1:
        return one_round(state, several=False).select(*result)
    bricks = with_bricks(dims, volume, edge)
    single = bricks.where(F.greatest(*[F.col(f"b{x}_n") for x in AXES]) == 1).select(*keys)
    finished = [one_round(state.join(single, keys, "left_semi"), several=False).select(*result)]
    state = cut_lineage(one_round(state.join(single, keys, "left_anti")))
    while True:
        active = state.filter("changed").select(*keys).distinct()
        if active.isEmpty():
            break
        finished.append(state.join(active, keys, "left_anti").select(*result))
        state = cut_lineage(one_round(state.join(active, keys, "left_semi")))
    out = state.select(*result)
    for part in finished:
        out = out.unionByName(part)
    return out


def hops(reached: DataFrame, dims: DataFrame, keys: list[str], start: Column, neighbours: int = 26, **bricks) -> DataFrame:
    """Steps from the start voxels along minimax-tight edges, and the parent voxel number."""
    seeded = reached.filter(F.col("w").isNotNull()).select(
        *keys, *AXES, "e", "w", F.when(start & (F.col("w") == F.col("e")), F.lit(0)).cast("long").alias("hop"))
    return count_hops(seeded, dims, keys, neighbours, **bricks)


def trace(parents: DataFrame, ends: DataFrame, dims: DataFrame, keys: list[str],
          volume: int = BRICK_VOLUME, edge: int = BRICK_EDGE, room: int | None = None) -> DataFrame:
    """Voxels of the parent chain from one end voxel (``lin``) per group back to the start.

    Every brick tells where a chain that enters it at a border voxel goes on; ``contract.reachable`` ranks these entries,
    and the bricks of the path mark its voxels."""
    job, values = _Job(dims, volume, edge), ["parent", "hop", "e", "w"]
    nodes = _sized(parents.select(*keys, "lin", *values), dims, keys)
    rows = nodes.select(*keys, *[v.alias(x) for x, v in voxel_of("lin").items()], "lin", *values, *SIZES, "wraps")
    entered = ends.select(*keys, "lin").withColumn("entry", F.lit(True))

    def above(v: _Rows) -> np.ndarray:
        """The row of the parent of each row, itself where the parent is elsewhere or there is none."""
        parent, span = v.part["parent"].to_numpy(np.int64), int(v.lin.max(initial=0)) + 2
        place = v.brick * span + v.lin
        goal = np.where(parent < span, v.brick * span + parent, -1)
        at = np.minimum(np.searchsorted(place, goal), len(v) - 1)
        return np.where((parent >= 0) & (place[at] == goal), at, np.arange(len(v)))

    def leave(v: _Rows) -> pd.DataFrame:
        last, parent = contract.hooked(above(v)), v.part["parent"].to_numpy(np.int64)
        on = np.flatnonzero(v.border | v.part["entry"].notna().to_numpy())
        out = parent[last[on]]
        return pd.DataFrame({"node": v.lin[on], "next": pd.Series(out, dtype="Int64").where(out >= 0).to_numpy()}, index=on).astype({"next": "Int64"})

    def mark(v: _Rows) -> pd.DataFrame:
        found, step = v.part["entry"].notna().to_numpy(), above(v)
        while True:
            wider = found.copy()
            wider[step[found]] = True
            if np.array_equal(wider, found):
                return v.part[found][["lin", "hop", "e", "w"]]
            found, step = wider, step[step]

    if job.most > 1:
        rows = cut_lineage(rows)
        links = job.grouped(rows.join(entered, [*keys, "lin"], "left"), keys, leave,
                            [T.StructField("node", _LONG), T.StructField("next", _LONG)])
        found = contract.reachable(links, entered.withColumnRenamed("lin", "node"), keys)
        entered = found.withColumnRenamed("node", "lin").withColumn("entry", F.lit(True))
        # Bricks that no path enters are left out.
        bricks = [f"b{x}" for x in AXES]
        placed = _cut(rows, volume, edge).select(*rows.columns, *bricks)
        used = placed.join(entered, [*keys, "lin"], "left_semi").select(*keys, *bricks).distinct()
        rows = placed.join(used, [*keys, *bricks], "left_semi").select(*rows.columns)
    return job.grouped(rows.join(entered, [*keys, "lin"], "left"), keys, mark, [
        T.StructField("lin", _LONG), T.StructField("hop", _LONG), T.StructField("e", _DOUBLE), T.StructField("w", _DOUBLE)])


def crossings(voxels: DataFrame, groups: DataFrame, base: list[str], keys: list[str], neighbours: int, job: _Job, copies: int = 1,
              paths: bool = False) -> DataFrame:
    """Least bottleneck from the first to the last places along an axis, of groups that fit into a call: (keys, w), or with
    ``paths`` the voxels (keys, seq, i, j, k, e) of the path that ``hops`` and ``trace`` find. Groups without a way have no row.

    ``voxels`` has ``base`` (some of the keys), i, j, k and e. ``groups`` has one row per group: the keys, the sizes of the tiled
    group, wrap_i, wrap_j, wrap_k, ``along`` (the number of the axis), ``unit`` (its size in one of the ``copies``) and ``width``
    (places that count as the first and as the last)."""
    steps, spark = offsets(neighbours), voxels.sparkSession
    # Calls and tasks take a tenth of a second however few their rows, so a call has its whole room and an axis of it at a time.
    # Partitions are told, as rows are few for their work.
    calls = max(-(-job.parts // PARTS_OF_CALL), min(job.parts, 2 * spark.sparkContext.defaultParallelism))
    bits = [F.when(F.col(f"wrap_{x}"), 1 << axis).otherwise(0) for axis, x in enumerate(AXES)]
    given = F.lit(True)
    for key in base:
        given = given & F.col(key).isNotNull()
    # A voxel without a place has no neighbours.
    placed = F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("k").isNotNull()
    left = voxels.where(given & placed).select(*base, *AXES, "e")
    # Named anew, as a join of a table with itself leaves columns that the call can't tell apart.
    right = groups.where(given).select(*[F.col(k).alias(k) for k in keys], *SIZES, (bits[0] + bits[1] + bits[2]).alias("wraps"), "along", "unit", "width")
    found = [T.StructField("seq", _LONG), *_INDEX, T.StructField("e", _DOUBLE)] if paths else [T.StructField("w", _DOUBLE)]
    schema = T.StructType([*(right.schema[k] for k in keys), *found])

    def solved(some: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
        rows = some.merge(sizes, on=base)
        number = np.tile(np.arange(copies), len(rows))
        rows = rows.take(np.repeat(np.arange(len(rows)), copies)).reset_index(drop=True)
        along = rows["along"].to_numpy()
        for axis, x in enumerate(AXES):
            rows[x] = rows[x].to_numpy(np.int64) + np.where(along == axis, number * rows["unit"].to_numpy(np.int64), 0)
        v = _Rows(rows, keys, FAR, FAR)  # a group is one brick
        out = _crossed(v, steps, paths)
        for place, key in enumerate(keys):
            out.insert(place, key, v.part[key].to_numpy()[out.index.to_numpy()])
        return out

    def run(some: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
        # An axis at a time, so that a call holds no more than it would of one.
        out = [solved(some, part) for _, part in sizes.groupby("along")] if len(some) else []
        out = [rows for rows in out if len(rows)]
        return pd.concat(out) if out else pd.DataFrame()

    def dealt(rows: DataFrame):
        used = rows.withColumn("call", F.pmod(F.xxhash64(*base), F.lit(calls)))
        return used.repartition(calls, "call").groupBy("call")

    return dealt(left).cogroup(dealt(right)).applyInPandas(lambda some, sizes: run(some.drop(columns="call"), sizes.drop(columns="call")), schema)


def _crossed(v: _Rows, steps, paths: bool) -> pd.DataFrame:
    """What ``crossings`` returns, by rows of ``v``."""
    n = len(v)
    if not n:
        return pd.DataFrame({x: np.zeros(0, np.int64) for x in (["seq", *AXES] if paths else [])} | {"e" if paths else "w": np.zeros(0)})
    near = np.empty((n, len(steps)), np.int32)
    for s, to in enumerate(v.within(steps)):
        near[:, s] = to
    e, along, width = v.part["e"].to_numpy(float), v.part["along"].to_numpy(), v.part["width"].to_numpy()
    at, size = np.choose(along, v.at), np.choose(along, v.size)
    first, last = np.flatnonzero(at < width), at >= size - width
    a, s = np.nonzero((near < n) & (near > np.arange(n)[:, None]))
    b = near[a, s].astype(np.int64)
    w = contract.bottlenecks(n + 1, np.concatenate([a, first]), np.concatenate([b, np.full(len(first), n)]),
                             np.concatenate([np.maximum(e[a], e[b]), e[first]]), n)[:-1]
    least = np.full(v.group[-1] + 1, np.inf)
    np.minimum.at(least, v.group[last], w[last])
    if not paths:
        ends = np.flatnonzero(np.append(True, v.group[1:] != v.group[:-1]) & np.isfinite(least[v.group]))
        return pd.DataFrame({"w": least[v.group[ends]]}, index=ends)
    w = np.where(np.isfinite(w) & (w <= least[v.group]), w, np.inf)
    hop, parent = _stepped(near, w, e, first[w[first] == e[first]])
    ends = np.flatnonzero(last & (hop < NO_HOP))
    ends = ends[np.lexsort((ends, hop[ends], w[ends], v.group[ends]))]
    ends = ends[np.append(True, v.group[ends[1:]] != v.group[ends[:-1]])[:len(ends)]]
    on = [ends]
    while len(on[-1]):
        up = parent[on[-1]]
        on.append(up[up < n])
    on = np.concatenate(on)
    return pd.DataFrame({"seq": hop[on], **{x: v.at[axis][on] for axis, x in enumerate(AXES)}, "e": e[on]}, index=on)


def _stepped(near: np.ndarray, w: np.ndarray, e: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hops from the starts along edges that keep the minimax value, and the parents: rows ascend by voxel number."""
    n = len(w)
    wide = np.append(w, np.inf)
    hop, front, step = np.full(n + 1, NO_HOP), starts, 0
    hop[front] = 0
    while len(front):
        step += 1
        to = near[front]
        # A row reads the front where the greater of that value and its own energy is its minimax value.
        ok = (to < n) & (hop[to] == NO_HOP)
        to, back = to[ok], np.broadcast_to(w[front][:, None], ok.shape)[ok]
        front = np.unique(to[(np.maximum(back, e[to]) == w[to]) & np.isfinite(w[to])])
        hop[front] = step
    # Parent: tight neighbour one hop nearer, least minimax value, then least voxel number.
    parent, on = np.full(n, n), np.flatnonzero((hop[:-1] > 0) & (hop[:-1] < NO_HOP))
    near = near[on]
    nearer = (np.maximum(wide[near], e[on, None]) == w[on, None]) & (hop[near] + 1 == hop[on, None])
    value = np.where(nearer, wide[near], np.inf)
    parent[on] = np.where(nearer & (value == value.min(axis=1, keepdims=True)), near, n).min(axis=1)
    return hop[:-1], parent
