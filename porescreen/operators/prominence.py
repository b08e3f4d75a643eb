"""Prominence of local extremes over ordered groups of any length.

The side minimum of an element is the lowest value met before a strictly higher one (or the group end).  Inside a block the next
higher value is found for all elements at once, over tables of the highest and lowest values of the last 1, 2, 4, ... rows.
Elements that meet none in their block go on over block summaries: a tree of highest and lowest values, ``FAN`` blocks to a node,
is a table; each block knows the nodes beside its way to the root, nearest first, so one join tells an open element in which
node its higher value lies, and a join per level leads down to the block.  All joins of elements carry their own block in the
key, so no group has more elements than a block, however many of them are open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from porescreen.operators.ordered import Sequence
from porescreen.session import cut_lineage

FAN = 64
#: Rows of the blocks that one call gets together; a longer block is a call of its own.
ROWS_OF_CALL = 1 << 13
SIDES = (("_left", -1), ("_right", 1))


def lowest_before(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the places ``at``: the lowest value from there back to the previous strictly higher one, and that one's place.

    ``values`` begins with an infinite one, so there always is one."""
    highest, lowest, size = [values], [values], 1
    while 2 * size <= len(values):
        high, low = highest[-1].copy(), lowest[-1].copy()
        high[size:] = np.maximum(highest[-1][size:], highest[-1][:-size])
        low[size:] = np.minimum(lowest[-1][size:], lowest[-1][:-size])
        highest.append(high)
        lowest.append(low)
        size *= 2
    own, place, low = values[at], at - 1, values[at].copy()
    for k in range(len(highest) - 1, -1, -1):
        passed = (place - (1 << k) + 1 >= 0) & (highest[k][place] <= own)
        low = np.where(passed, np.minimum(low, lowest[k][place]), low)
        place = np.where(passed, place - (1 << k), place)
    return low, place


def _walk(batch: pd.DataFrame, keys: list[str], value: str, kind: str) -> pd.DataFrame:
    picked = np.flatnonzero(batch[kind].notna())
    out = batch.iloc[picked]
    if not len(picked):
        return out.assign(_left=[], _left_open=[], _right=[], _right_open=[])
    group = batch.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    # An infinite value stands before the first row, between groups, and after the last row.
    shift = np.cumsum(np.append(True, group[1:] != group[:-1]))
    sign, n = out[kind].to_numpy(float), len(batch) + shift[-1] + 1
    found = {name: np.empty(len(picked)) for name in ("_left", "_right")}
    none = {name: np.empty(len(picked), bool) for name in ("_left", "_right")}
    for s in (1.0, -1.0):
        signed = np.full(n, np.inf)
        signed[np.arange(len(batch)) + shift] = s * batch[value].to_numpy(float)
        own = np.flatnonzero(sign == s)
        at = picked[own] + shift[picked[own]]
        for name, line, place in (("_left", signed, at), ("_right", signed[::-1].copy(), n - 1 - at)):
            found[name][own], stop = lowest_before(line, place)
            none[name][own] = np.isinf(line[stop])
    return out.assign(_left=found["_left"], _left_open=none["_left"], _right=found["_right"], _right_open=none["_right"])


def side_minima(marked: DataFrame, seq: Sequence, value: str, kind: str) -> DataFrame:
    """Rows with a ``kind`` (1 peak, -1 valley) and their prominence ``_drop``."""
    keys = [*seq.keys, "_block"] if seq.blocked else list(seq.keys)
    rows = cut_lineage(marked.withColumn("_block", seq.block)) if seq.blocked else marked
    schema = T.StructType(rows.schema.fields + [
        T.StructField("_left", T.DoubleType()), T.StructField("_left_open", T.BooleanType()),
        T.StructField("_right", T.DoubleType()), T.StructField("_right_open", T.BooleanType())])

    def walk(batches):
        # Rows arrive sorted by group; the last group of a batch waits for its remaining rows.
        waiting = []
        for batch in batches:
            if batch.empty:
                continue
            same = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
            start = len(batch) if not same.any() else int(np.argmax(same))
            if start > 0:
                yield _walk(pd.concat([*waiting, batch.iloc[:start]]), keys, value, kind)
                waiting = []
            waiting.append(batch.iloc[start:])
        if waiting:
            yield _walk(pd.concat(waiting), keys, value, kind)

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, seq.pos)
    solved = ordered.mapInPandas(walk, schema)
    if seq.blocked:
        solved = _across_blocks(rows, solved, seq, value, kind)
    sign = F.col(kind)
    drop = sign * F.col(value) - F.greatest("_left", "_right")
    return solved.withColumn("_drop", drop).drop("_left", "_left_open", "_right", "_right_open", "_block")


def _tree(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """(keys, level, parent, nodes): the summaries below each node of each level, by place, and how many levels."""
    top = edges.agg(F.max("node")).first()[0] or 0
    levels, out, now = 1, None, edges
    while True:
        below = now.groupBy(*keys, F.floor(F.col("node") / FAN).alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("node", "lo", "hi"))).alias("nodes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        part = below.select(*keys, F.lit(levels - 1).alias("level"), "parent", "nodes")
        out = part if out is None else out.unionByName(part)
        if top < FAN:
            return cut_lineage(out), levels
        now, top, levels = below.select(*keys, F.col("parent").alias("node"), "lo", "hi"), top // FAN, levels + 1


def _beside(edges: DataFrame, tree: DataFrame, levels: int, keys: list[str], step: int) -> DataFrame:
    """(keys, _block, beside): the nodes beside the way from a block to the root on one side, nearest first."""
    out, parts = edges.select(*keys, F.col("node").alias("_block")), []
    for level in range(levels):
        own = F.floor(F.col("_block") / FAN ** level)
        siblings = tree.where(F.col("level") == level).select(*keys, F.col("parent").alias("_parent"), F.col("nodes").alias(f"_n{level}"))
        out = out.withColumns({f"_own{level}": own, "_parent": F.floor(own / FAN)}).join(siblings, [*keys, "_parent"]).drop("_parent")
        parts.append(_others(level, step))
    return out.select(*keys, "_block", F.concat(*parts).alias("beside"))


def _others(level: int, step: int) -> Column:
    """The siblings of the own node of a level on one side, nearest first."""
    own = F.col(f"_own{level}")
    nodes = F.filter(f"_n{level}", lambda x: (x["node"] < own) if step < 0 else (x["node"] > own))
    return F.transform(F.reverse(nodes) if step < 0 else nodes, lambda x: F.struct(
        F.lit(level).alias("level"), x["node"].alias("node"), x["lo"].alias("lo"), x["hi"].alias("hi")))


def _first_higher(nodes: Column, sign: Column, v: Column) -> tuple[Column, Column]:
    """The place (from 0) of the first node with a value above ``v``, null if there is none, and the lowest of those before it."""
    high = F.transform(nodes, lambda x, i: F.when(F.when(sign > 0, x["hi"]).otherwise(-x["lo"]) > v, i))
    first = F.array_min(high)
    passed = F.filter(nodes, lambda x, i: first.isNull() | (i < first))
    return first, F.array_min(F.transform(passed, lambda x: F.when(sign > 0, x["lo"]).otherwise(-x["hi"])))


def _meet(elements: DataFrame, told: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Join elements to what is told of a node, once per node and block of theirs, so that no key has more than a block's."""
    pairs = elements.select(*keys, "_block", *on).distinct().join(told, [*keys, *on])
    return elements.join(pairs, [*keys, "_block", *on])


def _stairs(rows: DataFrame, wanted: DataFrame, keys: list[str], pos: str, step: int, per_call: int) -> DataFrame:
    """(keys, node, sign, tops, lows) of the wanted blocks: rising highest values seen from the side of an element, and the
    lowest value before each; arrays of a block's length at most. A call gets ``per_call`` blocks."""
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("node", T.LongType()), T.StructField("sign", T.IntegerType()),
                           T.StructField("tops", T.ArrayType(T.DoubleType())), T.StructField("lows", T.ArrayType(T.DoubleType()))])

    def solve(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks, out = blocks.sort_values([*keys, "node", pos]).reset_index(drop=True), []
        for first, stop in _runs(blocks, [*keys, "node"]):
            values = blocks["_v"].to_numpy(float)[first:stop][::1 if step > 0 else -1]
            for sign in (1, -1):
                signed = sign * values
                highest = np.maximum.accumulate(signed)
                rises = np.flatnonzero(np.append(True, highest[1:] > highest[:-1]))
                before = np.append(np.inf, np.minimum.accumulate(signed)[:-1])
                out.append((first, sign, signed[rises], before[rises]))
        head = blocks.iloc[[x[0] for x in out]]
        return pd.DataFrame({k: head[k].to_numpy() for k in [*(f.name for f in fields), "node"]}
                            | {n: [x[at] for x in out] for at, n in ((1, "sign"), (2, "tops"), (3, "lows"))})[[f.name for f in schema.fields]]

    held = rows.join(wanted.select(*keys, "node").distinct(), [*keys, "node"], "left_semi")
    return held.groupBy(*keys, F.floor(F.col("node") / per_call).alias("_call")).applyInPandas(solve, schema)


def _runs(rows: pd.DataFrame, columns: list[str]) -> list[tuple[int, int]]:
    """(first, stop) of the runs of rows that agree in the columns."""
    new = np.append(True, (rows[columns].ne(rows[columns].shift())).any(axis=1).to_numpy()[1:])
    cuts = [*np.flatnonzero(new), len(rows)]
    return list(zip(cuts, cuts[1:]))


def _across_blocks(rows: DataFrame, solved: DataFrame, seq: Sequence, value: str, kind: str) -> DataFrame:
    """Finish the elements that met no higher value inside their block."""
    keys, pos = list(seq.keys), seq.pos
    solved = cut_lineage(solved)
    edges = cut_lineage(rows.groupBy(*keys, F.col("_block").alias("node")).agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    tree, levels = _tree(edges, keys)
    key_fields = [solved.schema[k] for k in keys]
    tail_schema = T.StructType([*key_fields, T.StructField(pos, T.LongType()), T.StructField("_low", T.DoubleType())])

    def tail(elements: pd.DataFrame, stairs: pd.DataFrame) -> pd.DataFrame:
        if not len(elements) or not len(stairs):
            return pd.DataFrame({f.name: [] for f in tail_schema.fields})
        elements = elements.sort_values(["node", "_sign"]).reset_index(drop=True)
        told = {(n, s): (t, w) for n, s, t, w in zip(stairs["node"], stairs["sign"], stairs["tops"], stairs["lows"])}
        low, own, node, sign = (elements[c].to_numpy() for c in ("_low", "_v", "node", "_sign"))
        low = low.astype(float)
        for first, stop in _runs(elements, ["node", "_sign"]):
            tops, lows = told[node[first], sign[first]]
            place = np.searchsorted(np.asarray(tops), own[first:stop].astype(float), side="right")
            low[first:stop] = np.fmin(low[first:stop], np.asarray(lows)[place])
        return elements.assign(_low=low)[[f.name for f in tail_schema.fields]]

    for side, step in SIDES:
        waiting = solved.where(f"{side}_open").select(
            *keys, pos, "_block", F.col(kind).cast("int").alias("_sign"), (F.col(kind) * F.col(value)).alias("_v"))
        met = waiting.join(_beside(edges, tree, levels, keys, step), [*keys, "_block"])
        first, low = _first_higher(F.col("beside"), F.col("_sign"), F.col("_v"))
        met = met.select(*keys, pos, "_block", "_sign", "_v", low.alias("_low"), F.get("beside", first).alias("_to"))
        met = cut_lineage(met.select(*keys, pos, "_block", "_sign", "_v", "_low", F.col("_to.level").alias("level"), F.col("_to.node").alias("node")))
        done, going = met.where("node IS NULL").select(*keys, pos, "_low"), met.where("node IS NOT NULL")
        for level in range(levels - 1, 0, -1):
            above = going.where(F.col("level") == level)
            told = tree.where(F.col("level") == level - 1).select(*keys, F.col("parent").alias("node"), "nodes")
            down = _meet(above, told, keys, ["node"])
            nodes = F.reverse("nodes") if step < 0 else F.col("nodes")
            first, low = _first_higher(nodes, F.col("_sign"), F.col("_v"))
            down = down.select(*keys, pos, "_block", "_sign", "_v", F.least("_low", low).alias("_low"),
                               F.lit(level - 1).alias("level"), F.get(nodes, first)["node"].alias("node"))
            going = going.where(F.col("level") < level).unionByName(down)
        if levels > 1:
            going = cut_lineage(going)
        per_call = max(1, ROWS_OF_CALL // seq.block_rows)
        stairs = _stairs(rows.select(*keys, F.col("_block").alias("node"), pos, F.col(value).alias("_v")), going, keys, pos, step, per_call)
        # A call gets the elements of some blocks that look into some others, and these blocks once.
        going = going.withColumns({"_call": F.floor(F.col("_block") / per_call), "_far": F.floor(F.col("node") / per_call)})
        near = going.select(*keys, "_call", "_far", "node").distinct().join(stairs, [*keys, "node"])
        near = near.select(*[F.col(c).alias(c) for c in near.columns])
        ends = going.groupBy(*keys, "_call", "_far").cogroup(near.groupBy(*keys, "_call", "_far")).applyInPandas(tail, tail_schema)
        more = done.unionByName(ends).select(*keys, pos, F.col("_low").alias("_more"))
        solved = (solved.join(more, [*keys, pos], "left")
                  .withColumn(side, F.least(side, F.nanvl("_more", F.lit(None).cast("double")))).drop("_more"))
    return solved
