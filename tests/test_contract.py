"""Contraction of border graphs and list ranking against plain versions, with so little room that rounds are needed."""

import numpy as np
from pyspark.sql import functions as F

from porescreen.operators import contract, field

KEYS = ["g"]


def plain_bottlenecks(n, edges, source):
    out = np.full(n, np.inf)
    out[source] = -np.inf
    for _ in range(n):
        for a, b, w in edges:
            out[b] = min(out[b], max(out[a], w))
            out[a] = min(out[a], max(out[b], w))
    return out


def plain_least(n, edges):
    out = np.arange(n)
    for _ in range(n):
        for a, b, _ in edges:
            out[a] = out[b] = min(out[a], out[b])
    return out


def random_graph(rng, n, m):
    u, v = rng.integers(0, n, m), rng.integers(0, n, m)
    apart = u != v
    return u[apart], v[apart], rng.integers(0, 6, apart.sum()).astype(float)  # few weights: many ties


def test_brick_kernels():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(2, 40))
        u, v, w = random_graph(rng, n, int(rng.integers(0, 80)))
        want = plain_bottlenecks(n, list(zip(u, v, w)), 0)
        assert np.array_equal(contract.bottlenecks(n, u, v, w, 0), want)
        tree = contract.forest(n, u, v, w)
        assert len(tree[0]) == n - len(set(plain_least(n, list(zip(u, v, w)))))
        assert np.array_equal(plain_bottlenecks(n, list(zip(*tree)), 0), want)
        kept = rng.random(n) < 0.3
        kept[0] = True
        short = contract.between(n, *tree, kept)
        assert np.array_equal(plain_bottlenecks(n, list(zip(*short)), 0)[kept], want[kept]) and len(short[0]) <= 2 * kept.sum()
        assert np.array_equal(contract.merged(n, u, v), plain_least(n, list(zip(u, v, w))))
    assert len(contract.between(1000, np.arange(999), np.arange(1, 1000), np.arange(999.0), np.isin(np.arange(1000), [0, 999]))[0]) == 1


def test_rounds_of_contraction(spark):
    rng, edges, want_w, want_c = np.random.default_rng(2), [], {}, {}
    for g, (n, m) in enumerate([(60, 90), (40, 30), (5, 4)]):
        u, v, w = random_graph(rng, n, m)
        own = list(zip(map(int, u), map(int, v), map(float, w)))
        edges += [(g, a, b, x) for a, b, x in own] + [(g, 3, contract.SOURCE, 2.0)]
        found = plain_bottlenecks(n + 1, [*own, (3, n, 2.0)], n)
        want_w |= {(g, k): x for k, x in enumerate(found[:n]) if np.isfinite(x)}
        least, met = plain_least(n, own), {x for e in own for x in e[:2]}
        want_c |= {(g, k): least[k] for k in met}
    df = spark.createDataFrame(edges, "g int, a long, b long, w double")
    for room in (2, 1 << 18):
        got = contract.spread_bottlenecks(df, KEYS, room)
        assert {(r["g"], r["node"]): r["w"] for r in got.collect()} == want_w
        got = contract.spread_components(df.where(f"b <> {contract.SOURCE}"), KEYS, room)
        assert {(r["g"], r["node"]): r["least"] for r in got.collect()} == want_c


def test_list_ranking(spark):
    links = [("p", i, i + 1 if i < 37 else None) for i in range(38)] + [("p", 100 + i, 20 if i == 0 else 99 + i) for i in range(9)]
    links += [("q", 5, None)]
    got = contract.reachable(spark.createDataFrame(links, "g string, node long, next long"),
                             spark.createDataFrame([("p", 12), ("q", 5)], "g string, node long"), KEYS)
    assert sorted((r["g"], r["node"]) for r in got.collect()) == [("p", i) for i in range(12, 38)] + [("q", 5)]


def test_small_bricks_give_the_same_values(spark):
    rng = np.random.default_rng(4)
    cells = [("fw", int(i), int(j), int(k), float(rng.integers(0, 9))) for i in range(11) for j in range(7) for k in range(5) if rng.random() < 0.13]
    df = spark.createDataFrame(cells, "framework string, i int, j int, k int, e double")
    dims = spark.createDataFrame([("fw", 11, 7, 5, False, True, True)],
                                 "framework string, ni int, nj int, nk int, wrap_i boolean, wrap_j boolean, wrap_k boolean")

    def values(**bricks):
        a = field.components(df, dims, ["framework"], **bricks)
        b = field.minimax(df, dims, ["framework"], start=df["i"] == 0, **bricks)
        return ({(r["i"], r["j"], r["k"]): r["label"] for r in a.collect()}, {(r["i"], r["j"], r["k"]): r["w"] for r in b.collect()})

    whole, cut = values(), values(volume=12, edge=3, room=10)
    assert whole == cut and len(set(whole[0].values())) > 1 and None in whole[1].values()


def test_calls_hold_many_groups_or_parts_of_one(spark, monkeypatch):
    """The same results whether a call holds all groups, or a group is cut into bricks of several calls."""
    rng, steps = np.random.default_rng(4), [("ni", 7), ("nj", 5), ("nk", 6)]
    names = [(f"g{n}", n % 2) for n in range(40)]
    dims = spark.createDataFrame([(g, a, *(s for _, s in steps), a == 1, False, n % 3 == 0) for n, (g, a) in enumerate(names)],
                                 "g string, axis int, ni int, nj int, nk int, wrap_i boolean, wrap_j boolean, wrap_k boolean")
    voxels = [(g, a, i, j, k, float(rng.integers(0, 9))) for g, a in names for i, j, k in np.ndindex(7, 5, 6) if rng.random() < 0.4]
    rows, keys = spark.createDataFrame(voxels, "g string, axis int, i int, j int, k int, e double"), ["g", "axis"]
    job = field._Job(dims, 8, 2)
    assert job.parts < len(names) and not job.split and job.most > 1

    def solved(**bricks):
        labels = sorted(map(tuple, field.components(rows, dims, keys, 6, **bricks).collect()))
        reached = field.minimax(rows, dims, keys, F.col("i") == 0, **bricks)
        return labels, sorted(map(str, reached.collect()))

    whole = solved()
    assert solved(volume=8, edge=2) == whole
    monkeypatch.setattr(field, "BRICK_VOLUME", 20)
    assert field._Job(dims, 8, 2).split
    assert solved(volume=8, edge=2) == whole
