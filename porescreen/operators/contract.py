"""Graphs cut into bricks: what a brick tells of itself to the others, and how the told graph is contracted.

A brick (a bounded box of voxels) solves itself with array operations and reports a small graph over its border. The borders of
all bricks of a group make one graph, which is contracted in Spark: every node hooks onto the neighbour of its lightest edge,
chains of hooks are cut short by pointer doubling, and the edges move to the roots. A round at least halves the nodes, so
their number is logarithmic and does not depend on how many bricks a path crosses. A group whose graph has at most ``room``
edges is finished by one task.

Hooking by lightest edges (with ties broken by the ends) keeps least bottlenecks: along a chain of hooks the edges never grow
heavier, so the bottleneck from a node to a start outside its tree is the greater of its own lightest edge and that of its
tree in the contracted graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from porescreen.session import cut_lineage

#: The node that stands for all start voxels of a group.
SOURCE = -1
#: Edges of a group that one task may hold.
ROOM = 1 << 18
#: Parts of that room that small groups are hashed to.
PARTS_OF_ROOM = 8


# -- inside a brick ----------------------------------------------------------------------------

def hooked(pointer: np.ndarray) -> np.ndarray:
    """Roots of a forest of pointers."""
    while True:
        up = pointer[pointer]
        if np.array_equal(up, pointer):
            return up
        pointer = up


def merged(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least node that each node is connected to."""
    root = np.arange(n)
    while len(u):
        pointer = np.arange(n)
        np.minimum.at(pointer, np.maximum(u, v), np.minimum(u, v))
        pointer = hooked(pointer)
        root, u, v = pointer[root], pointer[u], pointer[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return root


def _by_lightest(n: int, u, v, w, fixed: int | None = None):
    """Rounds of hooking: yields (label, lightest edge of each label or -1, its weight, roots); labels are nodes 0..n-1.

    The edges are given by rising weight, so an edge's place is its rank. ``fixed`` never hooks."""
    label, edge = np.arange(n), np.arange(len(w))
    while len(edge):
        best = np.full(n, len(w))
        np.minimum.at(best, u, edge)
        np.minimum.at(best, v, edge)
        has = best < len(w)
        at = np.flatnonzero(has)
        place = np.searchsorted(edge, best[at])
        pointer = np.arange(n)
        pointer[at] = u[place] + v[place] - at
        if fixed is not None:
            pointer[label[fixed]] = label[fixed]
        mutual = (pointer[pointer] == np.arange(n)) & (np.arange(n) < pointer)
        pointer[mutual] = np.flatnonzero(mutual)
        root = hooked(pointer)
        yield label, np.where(has, best, -1), root
        label, u, v = root[label], root[u], root[v]
        apart = u != v
        u, v, edge = u[apart], v[apart], edge[apart]


def bottlenecks(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, source: int) -> np.ndarray:
    """Least possible heaviest edge on a path from ``source`` to each node; infinite if there is none."""
    order = np.argsort(w, kind="stable")
    u, v, w = u[order], v[order], w[order]
    out, joined, label = np.full(n, -np.inf), np.arange(n) == source, np.arange(n)
    for label, best, root in _by_lightest(n, u, v, w, source):
        own = best[label]
        open_ = ~joined & (own >= 0)
        out[open_] = np.maximum(out[open_], w[own[open_]])
        label = root[label]
        joined |= label == label[source]
    return np.where(joined, out, np.inf)


def forest(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest, as edges."""
    order = np.argsort(w, kind="stable")
    u, v, w = u[order], v[order], w[order]
    used = [best[best >= 0] for _, best, _ in _by_lightest(n, u, v, w)]
    used = np.unique(np.concatenate(used)) if used else np.zeros(0, int)
    return u[used], v[used], w[used]


def between(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, kept: np.ndarray):
    """A forest reduced to the nodes ``kept`` and those where three ways meet, with the same bottlenecks between them.

    Other ends are raked off; of the inner nodes of a chain a third is bridged in each round, by a fixed shuffled order."""
    turn = np.random.default_rng(7).permutation(n)
    while True:
        ends = np.concatenate([u, v])
        degree = np.bincount(ends, minlength=n)
        loose = ~kept & (degree == 1)
        if not (loose | (~kept & (degree == 2))).any():
            return u, v, w
        hold = ~(loose[u] | loose[v])
        u, v, w = u[hold], v[hold], w[hold]
        inner = ~kept & (np.bincount(np.concatenate([u, v]), minlength=n) == 2)
        if not inner.any():
            continue
        # Bridged: an inner node whose turn comes before that of the inner nodes next to it.
        first = np.where(inner, turn, n)
        lowest = np.full(n, n)
        np.minimum.at(lowest, u, first[v])
        np.minimum.at(lowest, v, first[u])
        pick = inner & (first < lowest)
        side = np.concatenate([u, v])
        other, edge = np.concatenate([v, u]), np.tile(np.arange(len(u)), 2)
        at = np.flatnonzero(pick[side])
        at = at[np.argsort(side[at], kind="stable")].reshape(-1, 2)
        hold = np.ones(len(u), bool)
        hold[edge[at].ravel()] = False
        u, v, w = (np.concatenate([u[hold], other[at[:, 0]]]), np.concatenate([v[hold], other[at[:, 1]]]),
                   np.concatenate([w[hold], w[edge[at]].max(axis=1)]))


# -- between bricks ----------------------------------------------------------------------------

def _lightest(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, other, m): the lightest edge of each node but the source, ties by the ends."""
    both = edges.select(*keys, "a", "b", "w").unionAll(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    best = both.where(F.col("a") != SOURCE).groupBy(*keys, F.col("a").alias("node")).agg(
        F.min(F.struct("w", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), F.col("b").alias("other"))).alias("best"))
    return best.select(*keys, "node", F.col("best.other").alias("other"), F.col("best.w").alias("m"))


def _roots(best: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, m, root): where the chain of hooks of each node ends; of two that hook onto each other the lesser is root."""
    best = cut_lineage(best)
    mates = best.select(*keys, F.col("node").alias("other"), F.col("other").alias("back"))
    hooks = best.join(mates, [*keys, "other"], "left").select(
        *keys, "node", "m", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("other")), F.col("node")).otherwise(F.col("other")).alias("root"))
    hooks = cut_lineage(hooks)
    while True:
        above = hooks.select(*keys, F.col("node").alias("root"), F.col("root").alias("up"))
        hooks = cut_lineage(hooks.join(above, [*keys, "root"], "left").select(
            *keys, "node", "m", F.coalesce("up", "root").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
        if hooks.where("moved").isEmpty():
            return hooks.drop("moved")
        hooks = hooks.drop("moved")


def _distinct(edges: DataFrame, keys: list[str]) -> DataFrame:
    return (edges.where("a <> b").groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                 .agg(F.min("w").alias("w")))


def _moved(edges: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """The edges between the roots of their ends; the source is its own root."""
    for end in ("a", "b"):
        to = roots.select(*keys, F.col("node").alias(end), F.col("root").alias("_to"))
        edges = edges.join(to, [*keys, end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return _distinct(edges, keys)


def _finish(edges: DataFrame, keys: list[str], solve, value: T.StructField, parts: int) -> DataFrame:
    """(keys, node, value), many small groups by one task: graphs without edges between them are one graph, and its nodes
    ascend by group and name. The sources of all groups are one node, the first."""
    fields = [f for f in edges.schema.fields if f.name in keys]
    schema = T.StructType([*sorted(fields, key=lambda f: keys.index(f.name)), T.StructField("node", T.LongType()), value])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        group = np.zeros(len(rows), np.int64)
        for key in keys:
            code, names = pd.factorize(rows[key], use_na_sentinel=False)
            group = group * len(names) + code
        ends, of = rows[["a", "b"]].to_numpy(np.int64).T.ravel(), np.tile(group, 2)
        of = np.where(ends == SOURCE, -1, of)
        order = np.lexsort((ends, of))
        new = np.append(True, (ends[order][1:] != ends[order][:-1]) | (of[order][1:] != of[order][:-1]))
        at = np.empty(len(ends), np.int64)
        at[order] = np.cumsum(new) - 1
        first = order[new]
        found = solve(ends[first], at[:len(rows)], at[len(rows):], rows["w"].to_numpy(float))
        out = pd.DataFrame({k: rows[k].to_numpy()[first % len(rows)] for k in keys} | {"node": ends[first], value.name: found})
        return out[out["node"] != SOURCE]

    return edges.groupBy(F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("part")).applyInPandas(run, schema)


def _contract(edges: DataFrame, keys: list[str], room: int, solve, value: T.StructField, lifted) -> DataFrame:
    """Rounds of hooking for groups of more than ``room`` edges, the rest by ``solve``; then back through the rounds.

    ``lifted`` gives the value of a node from its lightest edge ``m``, its ``root`` and the root's value ``v``."""
    edges, levels, solved = cut_lineage(_distinct(edges, keys)), [], []
    while True:
        counts = edges.groupBy(*keys).count()
        rows, most = counts.agg(F.sum("count"), F.max("count")).first()
        # A call holds less than ROOM edges of small groups, or few groups near to ``room``.
        parts = max(1, -(-PARTS_OF_ROOM * (rows or 0) // ROOM))
        if (most or 0) <= room:
            solved.append(_finish(edges, keys, solve, value, parts))
            break
        large = cut_lineage(counts.where(F.col("count") > room).select(*keys))
        solved.append(_finish(edges.join(large, keys, "left_anti"), keys, solve, value, parts))
        edges = edges.join(large, keys, "left_semi")
        levels.append(_roots(_lightest(edges, keys), keys))
        edges = cut_lineage(_moved(edges, levels[-1], keys))
    out = solved.pop()
    while levels:
        top = out.select(*keys, F.col("node").alias("root"), F.col(value.name).alias("v"))
        own = levels.pop().join(top, [*keys, "root"], "left").select(*keys, "node", lifted().alias(value.name))
        out = own.unionByName(solved.pop())
    return out


def spread_bottlenecks(edges: DataFrame, keys: list[str], room: int = ROOM) -> DataFrame:
    """(keys, node, w): least bottleneck from the source along edges (keys, a, b, w); nodes out of reach are left out.

    A root without edges left has no value, unless it is the source."""
    def solve(names, a, b, w):
        source = np.flatnonzero(names == SOURCE)
        return bottlenecks(len(names), a, b, w, int(source[0])) if len(source) else np.full(len(names), np.inf)

    def lifted():
        return F.when(F.col("root") == SOURCE, F.col("m")).otherwise(F.greatest("m", F.coalesce("v", F.lit(float("inf")))))

    found = _contract(edges, keys, room, solve, T.StructField("w", T.DoubleType()), lifted)
    return found.where((F.col("node") != SOURCE) & (F.col("w") < float("inf")))


def spread_components(edges: DataFrame, keys: list[str], room: int = ROOM) -> DataFrame:
    """(keys, node, least): least node that each node of the edges (keys, a, b) is connected to."""
    def solve(names, a, b, w):
        return names[merged(len(names), a, b)]

    found = _contract(edges.withColumn("w", F.lit(0.0)), keys, room, solve, T.StructField("least", T.LongType()),
                      lambda: F.coalesce("v", "root"))
    # Roots name a component; its least node is found at the end.
    lowest = found.groupBy(*keys, F.col("least").alias("_name")).agg(F.min("node").alias("least"))
    return found.withColumnRenamed("least", "_name").join(lowest, [*keys, "_name"]).drop("_name")


def reachable(links: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node) on the chains that begin at ``starts`` (keys, node) and follow ``links`` (keys, node, next).

    List ranking: in each round every node learns who stands twice as far ahead, and the known part of a chain doubles."""
    found = cut_lineage(starts.select(*keys, "node"))
    ahead = cut_lineage(links.where("next IS NOT NULL").select(*keys, "node", "next"))
    while True:
        new = found.join(ahead, [*keys, "node"]).select(*keys, F.col("next").alias("node"))
        new = cut_lineage(new.join(found, [*keys, "node"], "left_anti"))
        if new.isEmpty():
            return found
        found = cut_lineage(found.unionAll(new).distinct())
        further = ahead.select(*keys, F.col("node").alias("next"), F.col("next").alias("_far"))
        ahead = cut_lineage(ahead.join(further, [*keys, "next"]).select(*keys, "node", F.col("_far").alias("next")))
