"""The block-wise helpers agree with plain windows, whatever the block size."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from porescreen.operators import ordered, sequence as sq
from porescreen.operators.ordered import Sequence
from tests.conftest import rows

PLAIN = Sequence(("p",))
BLOCKED = Sequence(("p",), block_rows=7, blocked=True)


@pytest.fixture(scope="module")
def path(spark):
    rng = random.Random(5)
    data = []
    for p, n in (("a", 60), ("b", 23), ("c", 3), ("d", 41)):
        e = 0.0
        for s in range(n):
            e += rng.choice([-4.0, -2.0, 0.0, 0.0, 1.0, 3.0, 5.0, 30.0, -30.0]) if p != "d" else -1.0 if s < 20 else 1.5
            data.append((p, s, float(s) if s % 9 else float(max(s - 1, 0)), e / 7, float(s // 5), e))
    return spark.createDataFrame(data, "p string, seq long, x double, y double, z double, e double").cache()


def same(plain, blocked):
    a, b = rows(plain), rows(blocked.select(*plain.columns))
    assert len(a) == len(b)
    for left, right in zip(a, b):
        assert left == pytest.approx(right, nan_ok=True)


@pytest.mark.parametrize("step", [
    lambda d, s: ordered.neighbours(d, s, {"u": ("e", 1), "v": ("e", -2), "w": ("x", 9)}),
    lambda d, s: ordered.running_sum(d, s, F.col("e"), "t"),
    lambda d, s: ordered.compact(d.filter("seq % 3 <> 1"), s),
    lambda d, s: ordered.carried(d.withColumn("m", F.when(F.col("seq") % 11 == 4, F.col("e"))), s, "m", "t"),
    lambda d, s: ordered.carried(d.withColumn("m", F.when(F.col("seq") % 11 == 4, F.col("e"))), s, "m", "t", ahead=True),
    lambda d, s: ordered.group_values(d, s, {"n": F.count(F.lit(1)), "h": F.max("e")}),
    lambda d, s: ordered.group_median(d, s, "e", "m"),
    lambda d, s: sq.drop_repeated_points(d, s),
    lambda d, s: sq.segment_lengths(d, s),
    lambda d, s: sq.step_outliers(d, s, 1.0),
    lambda d, s: sq.jump_groups(sq.step_outliers(d, s, 1.0), s),
    lambda d, s: sq.repair_jumps(d, s, 1.0),
    lambda d, s: sq.extremes(d, s, "e"),
    lambda d, s: sq.flank_slopes(d, s, sq.extremes(d, s, "e")),
    lambda d, s: sq.describe_paths(d, s, F.lit("X")),
    lambda d, s: sq.unwrap_periodic(d, s, {"x": F.lit(4.0), "y": F.lit(3.0)}),
    lambda d, s: sq.rebuild_periodic(d, s, F.lit("Z"), {c: F.lit(5.0) for c in "xyz"}),
    lambda d, s: sq.mean_squared_displacement(d, s, 3),
])
def test_blocks_agree_with_windows(path, step):
    same(step(path, PLAIN), step(path, BLOCKED))


def test_sequence_checks_the_longest_group(path):
    assert not ordered.sequence(path, ["p"]).blocked
    assert ordered.sequence(path, ["p"], block_rows=50).blocked


def test_number_rows_slices_long_groups(spark):
    rng = random.Random(3)
    data = [("hot", rng.randrange(90), i) for i in range(400)] + [("cold", rng.randrange(90), i) for i in range(9)]
    df = spark.createDataFrame(data, "p string, t long, id long")
    plain, seq = ordered.number_rows(df, ["p"], ["t", "id"])
    sliced, cut = ordered.number_rows(df, ["p"], ["t", "id"], block_rows=50)
    assert not seq.blocked and cut.blocked
    same(plain, sliced)


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [5.0] * 9, [1.0, 2.0, 2.0, 9.0, 50.0], list(map(float, range(101))), [1e9, -1e9, 3.0, 4.0]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    for bins in (1, 4, 1 << 16):
        assert ordered.exact_median(df, ["k"], "v", "m", bins).first()["m"] == statistics.median(values)
