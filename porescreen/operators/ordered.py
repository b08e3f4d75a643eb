"""Ordered groups of any length.

A path is a group of rows with a dense index ``seq`` = 0, 1, 2, ...  As long as the longest
group of a table has at most ``block_rows`` rows (checked once, by ``sequence``), the helpers
are plain windows over the group and Spark shares one exchange among all of them.  Beyond
that size a group is cut into blocks of consecutive rows: neighbours come from copies of the
few rows next to a block edge, running values from one summary row per block.  No task ever
holds more than one block, however long a single group is.  A helper that reads its input twice
(for the rows and for the block summaries) first writes it to the checkpoint folder, so that a
chain of helpers is computed once per step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from porescreen.session import cut_lineage

BLOCK_ROWS = 1 << 18


@dataclass(frozen=True)
class Sequence:
    """How the rows of a table are ordered, and whether groups are cut into blocks."""

    keys: tuple[str, ...]
    pos: str = "seq"
    block_rows: int = BLOCK_ROWS
    blocked: bool = False

    @property
    def block(self) -> Column:
        return F.floor(F.col(self.pos) / F.lit(self.block_rows))

    @property
    def rows(self) -> W:
        """Window over the rows of one group (or of one block of it)."""
        by = [*self.keys, "_block"] if self.blocked else list(self.keys)
        return W.partitionBy(*by).orderBy(self.pos)

    def over(self, *keys: str) -> "Sequence":
        return Sequence(tuple(keys), self.pos, self.block_rows, self.blocked)


def longest_group(df: DataFrame, keys) -> int:
    """Row count of the largest group; a partial aggregation over the key columns alone."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def sequence(df: DataFrame, keys, pos: str = "seq", block_rows: int = BLOCK_ROWS) -> Sequence:
    """Check the longest group of ``df`` and choose plain windows or blocks."""
    row = df.agg(F.max(pos).alias("n")).first()
    return Sequence(tuple(keys), pos, block_rows, int(row["n"] or 0) >= block_rows)


def number_rows(df: DataFrame, keys, order, pos: str = "seq",
                block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Sequence]:
    """Give the rows of each group a dense index by ``order`` (column names, most significant first).

    Groups beyond ``block_rows`` rows are first cut into slices by approximate quantiles of
    the leading order column; the slice counts then give each slice its offset.
    """
    keys, order = tuple(keys), list(order)
    n = longest_group(df, keys)
    seq = Sequence(keys, pos, block_rows, n > block_rows)
    if not seq.blocked:
        window = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(pos, F.row_number().over(window).cast("long") - 1), seq

    pieces = 2 * (n // block_rows + 1)
    shares = [i / pieces for i in range(1, pieces)]
    # The bounds are written out once: a second evaluation of an approximate quantile may differ.
    bounds = cut_lineage(df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(F.col(order[0]), shares, 10 * pieces).alias("_bounds"),
    ).filter(F.col("_n") > block_rows).drop("_n"))
    sliced = df.join(bounds, list(keys), "left").withColumn(
        "_slice",
        F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(order[0]))), F.lit(0)),
    ).drop("_bounds")
    sliced = cut_lineage(sliced)
    offsets = _offsets(sliced.groupBy(*keys, "_slice").count(), keys, "_slice", "count")
    inner = W.partitionBy(*keys, "_slice").orderBy(*order)
    out = (sliced.withColumn("_rn", F.row_number().over(inner).cast("long") - 1)
           .join(offsets, [*keys, "_slice"])
           .withColumn(pos, F.col("_rn") + F.col("_offset"))
           .drop("_rn", "_slice", "_offset"))
    return out, seq


def compact(df: DataFrame, seq: Sequence) -> DataFrame:
    """Make the index dense again after rows were dropped."""
    if not seq.blocked:
        return df.withColumn(seq.pos, F.row_number().over(seq.rows).cast("long") - 1)
    cut = cut_lineage(df.withColumn("_block", seq.block))
    offsets = _offsets(cut.groupBy(*seq.keys, "_block").count(), seq.keys, "_block", "count")
    return (cut.withColumn("_rn", F.row_number().over(seq.rows).cast("long") - 1)
            .join(offsets, [*seq.keys, "_block"])
            .withColumn(seq.pos, F.col("_rn") + F.col("_offset"))
            .drop("_rn", "_block", "_offset"))


def neighbours(df: DataFrame, seq: Sequence, columns: dict[str, tuple[Column | str, int]]) -> DataFrame:
    """Add columns read from other rows of the group: ``out -> (column, offset)``.

    A positive offset looks back, a negative one ahead; NULL beyond the ends.
    """
    if not seq.blocked:
        return df.withColumns({out: F.lag(c, k).over(seq.rows) for out, (c, k) in columns.items()})
    back = max([k for _, k in columns.values()] + [0])
    ahead = max([-k for _, k in columns.values()] + [0])
    spread = _with_edges(df, seq, back, ahead)
    return _home_rows(spread.withColumns({out: F.lag(c, k).over(seq.rows) for out, (c, k) in columns.items()}))


def recent(df: DataFrame, seq: Sequence, value: str, out: str, back: int) -> DataFrame:
    """Add the list of ``value`` over the last ``back`` rows and the row itself."""
    frame = seq.rows.rowsBetween(-back, W.currentRow)
    if not seq.blocked:
        return df.withColumn(out, F.collect_list(value).over(frame))
    return _home_rows(_with_edges(df, seq, back, 0).withColumn(out, F.collect_list(value).over(frame)))


def _with_edges(df: DataFrame, seq: Sequence, back: int, ahead: int) -> DataFrame:
    """Rows by block, with copies of the rows that a neighbouring block looks back or ahead to."""
    size, pos = F.lit(seq.block_rows), F.col(seq.pos)
    first, last = F.floor((pos - ahead) / size), F.floor((pos + back) / size)
    return (df.withColumn("_home", seq.block)
            .withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))))


def _home_rows(spread: DataFrame) -> DataFrame:
    return spread.filter(F.col("_home") == F.col("_block")).drop("_home", "_block")


def running_sum(df: DataFrame, seq: Sequence, value: Column, out: str) -> DataFrame:
    """Inclusive running sum along the group."""
    frame = seq.rows.rowsBetween(W.unboundedPreceding, W.currentRow)
    if not seq.blocked:
        return df.withColumn(out, F.sum(value).over(frame))
    cut = cut_lineage(df.withColumn("_block", seq.block).withColumn("_value", value))
    offsets = _offsets(cut.groupBy(*seq.keys, "_block").agg(F.sum("_value").alias("_total")),
                       seq.keys, "_block", "_total")
    return (cut.withColumn(out, F.sum("_value").over(frame))
            .join(offsets, [*seq.keys, "_block"])
            .withColumn(out, F.col(out) + F.col("_offset"))
            .drop("_block", "_value", "_offset"))


def carried(df: DataFrame, seq: Sequence, value: str, out: str, ahead: bool = False) -> DataFrame:
    """Last non-NULL ``value`` at or before each row, or the first one at or after it (``ahead``)."""
    if ahead:
        local = F.first(value, ignorenulls=True).over(
            seq.rows.rowsBetween(W.currentRow, W.unboundedFollowing))
    else:
        local = F.last(value, ignorenulls=True).over(
            seq.rows.rowsBetween(W.unboundedPreceding, W.currentRow))
    if not seq.blocked:
        return df.withColumn(out, local)
    cut = cut_lineage(df.withColumn("_block", seq.block))
    order = F.when(F.col(value).isNotNull(), F.col(seq.pos))
    edge = F.min_by(value, order) if ahead else F.max_by(value, order)
    ends = cut.groupBy(*seq.keys, "_block").agg(edge.alias("_edge"))
    by = W.partitionBy(*seq.keys).orderBy("_block")
    if ahead:
        far = F.first("_edge", ignorenulls=True).over(by.rowsBetween(1, W.unboundedFollowing))
    else:
        far = F.last("_edge", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1))
    ends = ends.withColumn("_far", far).drop("_edge")
    return (cut.withColumn(out, local).join(ends, [*seq.keys, "_block"])
            .withColumn(out, F.coalesce(out, "_far")).drop("_block", "_far"))


def group_values(df: DataFrame, seq: Sequence, values: dict[str, Column]) -> DataFrame:
    """Add aggregates over the whole group to each of its rows."""
    if not seq.blocked:
        whole = W.partitionBy(*seq.keys)
        return df.withColumns({out: v.over(whole) for out, v in values.items()})
    rows = cut_lineage(df)
    sums = rows.groupBy(*seq.keys).agg(*[v.alias(out) for out, v in values.items()])
    return rows.join(sums, list(seq.keys))


def group_median(df: DataFrame, seq: Sequence, value: str, out: str) -> DataFrame:
    """Add the exact median of ``value`` over the group to each of its rows."""
    if not seq.blocked:
        return df.withColumn(out, F.median(value).over(W.partitionBy(*seq.keys)))
    rows = cut_lineage(df)
    return rows.join(exact_median(rows, seq.keys, value, out), list(seq.keys), "left")


def exact_median(df: DataFrame, keys, value: str, out: str, bins: int = 1 << 16) -> DataFrame:
    """Exact median per group without gathering a group.

    A histogram of ``bins`` equal bins per group locates the middle ranks; only the rows of
    those bins are counted by value.  Repeated values collapse before the shuffle.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    span = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                   F.count(F.lit(1)).alias("_n"))
    width = F.col("_hi") - F.col("_lo")
    binned = rows.join(span, keys).withColumn(
        "_bin", F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * bins),
                                          F.lit(bins - 1))).otherwise(F.lit(0)))
    counts = _offsets(binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"),
                                                        F.max("_n").alias("_n")),
                      keys, "_bin", "_c", keep=["_c", "_n"])
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = counts.filter((F.col("_offset") <= high) & (F.col("_offset") + F.col("_c") > low)) \
        .select(*keys, "_bin", "_offset")
    values = (binned.join(middle, [*keys, "_bin"])
              .groupBy(*keys, "_bin", "_v")
              .agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"),
                   F.max("_offset").alias("_offset")))
    upto = F.sum("_c").over(W.partitionBy(*keys, "_bin").orderBy("_v"))
    ranked = values.withColumn("_to", F.col("_offset") + upto).withColumn("_from", F.col("_to") - F.col("_c"))
    hits = ranked.withColumn("_times", F.expr("int(_from <= floor((_n - 1) / 2) and _to > floor((_n - 1) / 2))"
                                              " + int(_from <= floor(_n / 2) and _to > floor(_n / 2))"))
    return hits.groupBy(*keys).agg((F.sum(F.col("_v") * F.col("_times")) / 2).alias(out))


def _offsets(totals: DataFrame, keys, block: str, total: str, keep=()) -> DataFrame:
    """Exclusive prefix sums of block totals: one row per block, not per input row."""
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(total).over(before), F.lit(0)).alias("_offset")
    return totals.select(*keys, block, *keep, offset)
