"""Hand-made paths with known descriptors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from porescreen.operators import sequence as sq
from porescreen.operators.ordered import Sequence
from tests.conftest import rows

SEQ = Sequence(("p",))


def path_of(spark, energies, coords=None, p="p"):
    coords = coords or [(float(i), 0.0, 0.0) for i in range(len(energies))]
    return spark.createDataFrame([(p, i, *c, float(e)) for i, (c, e) in enumerate(zip(coords, energies))],
                                 "p string, seq long, x double, y double, z double, e double")


def test_plateau_peaks(spark):
    path = path_of(spark, [0, 5, 5, 0, 5, 4, 4.5, 0])
    found = sq.extremes(path, SEQ, "e", 0.0).filter("kind = 'peak'").select("idx", "prominence")
    assert rows(found) == [(1, 5.0), (4, 5.0), (6, 0.5)]
    assert rows(sq.extremes(path, SEQ, "e").filter("kind = 'peak'").select("idx")) == [(1,), (4,)]


def ramp(spikes):
    rng = random.Random(1)
    e = [i * 0.5 + rng.random() for i in range(30)]
    for s in spikes:
        e[s] += 40.0
    return e


def repaired(spark, e):
    return [r["e_smooth"] for r in sq.repair_jumps(path_of(spark, e), SEQ).orderBy("seq").collect()]


def blend(lo, hi, share):
    return lo * (1 - share) + hi * share


def test_one_spike_is_blended(spark):
    e = ramp([10])
    got, lo, hi = repaired(spark, e), sum(e[6:9]) / 3, sum(e[12:15]) / 3
    assert got[9:11] == pytest.approx([blend(lo, hi, 1 / 3), blend(lo, hi, 2 / 3)])
    assert got[:9] + got[11:] == e[:9] + e[11:]


def test_spikes_at_the_ends_use_what_is_there(spark):
    e = ramp([0, 29])
    got = repaired(spark, e)
    assert got[0] == pytest.approx(blend(e[0], sum(e[2:5]) / 3, 0.5))
    assert got[28] == pytest.approx(blend(sum(e[25:28]) / 3, e[29], 0.5)) and got[29] == e[29]


def test_close_spikes_merge_and_the_next_group_reads_repaired_points(spark):
    e = ramp([10, 13])
    got, lo, hi = repaired(spark, e), sum(e[6:9]) / 3, sum(e[15:18]) / 3
    assert got[9:14] == pytest.approx([blend(lo, hi, (j + 1) / 6) for j in range(5)])
    e = ramp([10, 14])
    got, lo, hi = repaired(spark, e), sum(e[6:9]) / 3, sum(e[12:15]) / 3
    assert got[10] == pytest.approx(blend(lo, hi, 2 / 3))
    lo, hi = (got[10] + e[11] + e[12]) / 3, sum(e[16:19]) / 3
    assert got[13:15] == pytest.approx([blend(lo, hi, 1 / 3), blend(lo, hi, 2 / 3)])
    e = ramp([10, 15])
    got, lo, hi = repaired(spark, e), sum(e[11:14]) / 3, sum(e[17:20]) / 3
    assert got[14:16] == pytest.approx([blend(lo, hi, 1 / 3), blend(lo, hi, 2 / 3)])


def plain_repair(e, width, jumps):
    """The rule one group after the other, on the values as they stand."""
    e, groups = list(e), []
    for j in jumps:
        if groups and j - groups[-1][1] <= sq.JUMP_MERGE_GAP:
            groups[-1][1] = j
        else:
            groups.append([j, j])
    for left, last in groups:
        right = last + 1
        before, after = e[max(0, left - width):left], e[right + 1:right + 1 + width]
        lo = sum(before) / len(before) if before else e[left]
        hi = sum(after) / len(after) if after else e[right]
        for p in range(left, right):
            e[p] = blend(lo, hi, (p - left + 1) / (right - left + 1))
    return e


@pytest.mark.parametrize("width", [2, 3, 4, 5, 7, 9])
def test_any_width_reads_all_repaired_points(spark, width):
    rng = random.Random(width)
    e = [rng.uniform(-0.1, 0.1) + 0.01 * i for i in range(90)]
    for at in (8, 13, 18, 23, 24, 31, 36, 41, 46, 60, 63, 70, 75):
        e[at] += 30
    marked = sq.step_outliers(path_of(spark, e), SEQ).filter("jump").orderBy("seq").collect()
    want = plain_repair(e, width, [r["seq"] for r in marked])
    got = [r["e_smooth"] for r in sq.repair_jumps(path_of(spark, e), SEQ, width=width).orderBy("seq").collect()]
    assert len(marked) > 15 and got == pytest.approx(want, abs=1e-12)


def test_constant_path(spark):
    row = sq.describe_paths(path_of(spark, [2.0] * 12), SEQ, F.lit("X")).first()
    assert row["h_entropy"] == 0 and row["peak_slope_mean"] == 0 and row["barrier_freq"] == 0 and row["sigma_e"] == 0
    assert row["tortuosity"] == 1 and row["eta_main"] == 1


def test_short_path_has_no_descriptors(spark):
    coords = [(0.0, 0.0, 0.0)] * 5 + [(1.0, 0.0, 0.0), (2.0, 0.0, 0.0)]
    row = sq.describe_paths(path_of(spark, range(7), coords), SEQ, F.lit("X")).first()
    assert row["e_max"] is None and row["tortuosity"] is None and row["barrier_freq"] is None


def test_repeats_compare_with_raw_predecessor(spark):
    coords = [(0.0, 0.0, 0.0), (6e-9, 0.0, 0.0), (1.2e-8, 0.0, 0.0), (1.0, 0.0, 0.0)]
    assert rows(sq.drop_repeated_points(path_of(spark, range(4), coords), SEQ).select("seq", "e")) == [(0, 0.0), (1, 3.0)]


def test_properties_of_random_paths(spark):
    rng = random.Random(2)
    parts = None
    for p in "abcdef":
        at, coords = [0.0, 0.0, 0.0], []
        for _ in range(40):
            at = [a + rng.uniform(-1, 1.5) for a in at]
            coords.append(tuple(at))
        df = path_of(spark, [rng.uniform(-20, 20) for _ in range(40)], coords, p)
        parts = df if parts is None else parts.unionByName(df)
    for r in sq.describe_paths(parts, SEQ, F.lit("Y")).collect():
        assert r["tortuosity"] >= 1 - 1e-12 and 0 <= r["eta_main"] <= 1 and r["sigma_e"] >= 0 and r["peak_slope_mean"] > 0


def test_wrap_and_whole_track(spark):
    true = [0.0, 1.5, 3.0, 4.5, 6.0, 7.5, 6.0, 4.5]
    path = path_of(spark, [0] * 8, [(t % 4.0, 0.0, 0.0) for t in true])
    got = [r["x"] for r in sq.unwrap_periodic(path, SEQ, {"x": F.lit(4.0)}).orderBy("seq").collect()]
    assert got == pytest.approx(true)
    msd = sq.mean_squared_displacement(path_of(spark, [0] * 5, [(2.0 * i, 1.0 * i, 0.0) for i in range(5)]), SEQ, 2)
    assert rows(msd.select("lag", "n_pairs", "msd_x", "msd_y", "msd")) == [(1, 4, 4.0, 1.0, 5.0), (2, 3, 16.0, 4.0, 20.0)]


def test_rebuilt_path_is_periodic(spark):
    coords = [(i * 0.5, i * 0.2, 0.0) for i in range(60)]
    path = path_of(spark, [math.sin(i) for i in range(60)], coords)
    out = sq.rebuild_periodic(path, SEQ, F.lit("X"), {"x": F.lit(10.0), "y": F.lit(10.0), "z": F.lit(10.0)}).orderBy("seq").collect()
    assert len(out) == 60
    for i in range(20):
        assert out[i]["e"] == out[i + 20]["e"] == out[i + 40]["e"]
        assert out[i + 20]["x"] - out[i]["x"] == pytest.approx(9.5)
        assert out[i]["y"] == pytest.approx(4.0)
    short = path_of(spark, range(29), coords[:29])
    assert rows(sq.rebuild_periodic(short, SEQ, F.lit("X"), {c: F.lit(10.0) for c in "xyz"}).select("x", "y")) == rows(short.select("x", "y"))


def plain_side_minima(values, at, sign):
    lows = []
    for step in (-1, 1):
        low, i = sign * values[at], at + step
        while 0 <= i < len(values) and sign * values[i] <= sign * values[at]:
            low, i = min(low, sign * values[i]), i + step
        lows.append(low)
    return sign * values[at] - max(lows)


def test_prominence_over_block_summaries(spark, monkeypatch):
    """A zigzag that rises, one that falls and a random one: most elements are open in their block, and two levels stand above."""
    import random

    from porescreen.operators import prominence
    from porescreen.operators.ordered import Sequence

    monkeypatch.setattr(prominence, "FAN", 3)
    rng, tracks = random.Random(5), {}
    tracks["up"] = [i // 2 + (2.0 if i % 2 else 0.0) for i in range(90)]
    tracks["down"] = tracks["up"][::-1]
    tracks["any"] = [float(rng.randrange(12)) for _ in range(100)]
    tracks["short"] = [1.0, 3.0, 2.0]
    kinds = {}
    for name, v in tracks.items():
        for i in range(1, len(v) - 1):
            if v[i - 1] < v[i] > v[i + 1] or v[i - 1] > v[i] < v[i + 1]:
                kinds[name, i] = 1 if v[i] > v[i - 1] else -1
    df = spark.createDataFrame([(n, i, x, kinds.get((n, i))) for n, v in tracks.items() for i, x in enumerate(v)],
                               "p string, seq long, e double, kind int")
    want = {(n, i): plain_side_minima(tracks[n], i, s) for (n, i), s in kinds.items()}
    for seq in (Sequence(("p",), "seq", 5, True), Sequence(("p",), "seq")):
        got = {(r["p"], r["seq"]): r["_drop"] for r in prominence.side_minima(df, seq, "e", "kind").collect()}
        assert got == pytest.approx(want) and len(want) > 100


def test_displacement_at_all_lags(spark):
    rng, tracks = random.Random(8), {"a": 70, "b": 33, "c": 1, "d": 2}
    points = {t: [tuple(rng.gauss(0, 1) + 50 * k for k in range(3)) for _ in range(n)] for t, n in tracks.items()}
    df = spark.createDataFrame([(t, i, *p) for t, ps in points.items() for i, p in enumerate(ps)], "p string, seq long, x double, y double, z double")
    sums = {}
    for ps in points.values():
        for i in range(len(ps)):
            for j in range(i + 1, len(ps)):
                sums.setdefault(j - i, []).append(sum((u - v) ** 2 for u, v in zip(ps[i], ps[j])))
    for lags, block_rows in ((None, 1 << 16), (None, 8), (19, 8), (3, 16)):
        got = sq.mean_squared_displacement(df, Sequence(("p",), "seq"), lags, block_rows=block_rows).collect()
        want = {m: (len(s), sum(s) / len(s)) for m, s in sums.items() if lags is None or m <= lags}
        assert {r["lag"]: r["n_pairs"] for r in got} == {m: n for m, (n, _) in want.items()}
        assert {r["lag"]: r["msd"] for r in got} == pytest.approx({m: d for m, (_, d) in want.items()})


def test_entropy_bins_of_values_at_an_edge(spark):
    """A value at a bin edge lies where the share of the width puts it: 28.34 is the edge of the fifth of seven bins."""
    lo, hi, bins = 5.94, 45.14, 7
    values = [lo] * 8 + [hi] * 8 + [25.0] * 14 + [28.34] * 5
    path = spark.createDataFrame([(1, e) for e in values], "id int, e double")
    found = sq.energy_entropy(path, ["id"]).first()
    counts = {}
    for e in values:
        cell = min(math.floor((e - lo) / (hi - lo) * bins), bins - 1)
        counts[cell] = counts.get(cell, 0) + 1
    width = (hi - lo) / bins
    want = -sum(c / (35 * width) * math.log(c / (35 * width)) * width for c in counts.values())
    assert counts[4] == 5 and found["bins"] == bins and found["h_entropy"] == pytest.approx(want, abs=1e-12)
