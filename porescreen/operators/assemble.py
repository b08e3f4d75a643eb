"""Assembly of direction rows, pore sizes and external descriptors into the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from porescreen.functions.names import match_key

# Fixed values of the assembly rules.
PLD_MIN = 3.5
AXES = ("X", "Y", "Z")
PORE_COLUMNS = {"X": "pld_a", "Y": "pld_b", "Z": "pld_c"}
EXTERNAL_COLUMNS = ("FDSi", "Vacc", "ASA")
NAMES_SHOWN = 10


def pore_rows(pores: DataFrame) -> DataFrame:
    """Pore results that succeeded as (framework, direction, PLD) rows."""
    axes = F.explode(F.array(*[
        F.struct(F.lit(a).alias("direction"), F.col(c).alias("PLD")) for a, c in PORE_COLUMNS.items()]))
    return (pores.filter("ok").select(F.col("name").alias("framework"), axes.alias("_r"))
            .select("framework", "_r.direction", "_r.PLD"))


def wide_axes(directions: DataFrame, values: list[str]) -> DataFrame:
    """One row per framework with ``X_``, ``Y_``, ``Z_`` columns, from one row per (framework, axis).

    ``<axis>_traverses`` tells whether a barrier is known; the baseline energy is the (already
    rounded) transition energy minus the barrier when both columns are present."""
    columns = [c for c in values]
    rows = directions
    if {"barrier", "transition_energy"} <= set(directions.columns):
        rows = rows.withColumn("E_min_official", F.col("transition_energy") - F.col("barrier"))
        columns.append("E_min_official")
    picks = []
    for axis in AXES:
        here = F.col("axis") == axis
        picks.append(F.coalesce(F.bool_or(F.when(here, F.col("barrier").isNotNull())), F.lit(False)).alias(f"{axis}_traverses"))
        picks += [F.max(F.when(here, F.col(c))).alias(f"{axis}_{c}") for c in columns]
    return rows.groupBy("framework").agg(*picks)


def direction_rows(wide: DataFrame, values: list[str]) -> DataFrame:
    """One row per traversing direction of a wide framework row; sample = framework_<axis>."""
    shared = [c for c in wide.columns if c[:2] not in ("X_", "Y_", "Z_")]
    per_axis = F.explode(F.array(*[
        F.struct(F.lit(a).alias("direction"), F.col(f"{a}_traverses").alias("_traverses"),
                 *[F.col(f"{a}_{v}").alias(v) for v in values]) for a in AXES]))
    rows = wide.select(*shared, per_axis.alias("_r")).select(*shared, "_r.*").filter("_traverses").drop("_traverses")
    return rows.withColumn("sample", F.concat_ws("_", "framework", F.lower("direction")))


def exclude_narrow(rows: DataFrame, minimum: float = PLD_MIN) -> DataFrame:
    """Drop directions whose pore limiting diameter is known and below the probe diameter."""
    return rows.filter(F.col("PLD").isNull() | (F.col("PLD") >= minimum))


def unique_by(dimension: DataFrame, key: str) -> DataFrame:
    """The table itself, or an error when a key occurs twice (raised by the job that reads it)."""
    others = [c for c in dimension.columns if c != key]
    once = F.when(F.count(F.lit(1)) > 1,
                  F.raise_error(F.concat(F.lit("key occurs more than once: "), F.first(key)))).otherwise(F.lit(True))
    checked = dimension.groupBy(key).agg(
        F.first(F.struct(*others)).alias("_row"), once.alias("_once"))
    return checked.filter("_once").select(key, "_row.*")


def lookup_external(rows: DataFrame, external: DataFrame, columns=EXTERNAL_COLUMNS) -> DataFrame:
    """Two-stage lookup of external descriptors.

    Each column is matched on the framework name; where it is still missing, on the full sample
    name.  The fallback is per column."""
    keyed = unique_by(external.select(match_key("Zeolites").alias("_key"), *columns), "_key")
    first = keyed.select(F.col("_key").alias("_k1"), *[F.col(c).alias(f"_{c}1") for c in columns])
    second = keyed.select(F.col("_key").alias("_k2"), *[F.col(c).alias(f"_{c}2") for c in columns])
    joined = (rows.join(first, match_key("framework") == F.col("_k1"), "left")
              .join(second, match_key("sample") == F.col("_k2"), "left"))
    return joined.select(rows["*"], *[F.coalesce(f"_{c}1", f"_{c}2").alias(c) for c in columns])


def ensure_columns(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Fixed column order; columns that do not exist become NULL."""
    have = set(df.columns)
    return df.select(*[c for c in ids if c in have],
                     *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in columns])


def audit_missing(df: DataFrame, columns: list[str], name: str = "framework") -> DataFrame:
    """Per column: number of rows without a value, and the first distinct names among them.

    The table is read once: its cells are counted by column and name, and both parts of the answer start from
    these counts.  Names come from a distributed top-k; no column gathers its names in one place."""
    cells = df.select(F.col(name).alias("_name"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("missing")) for c in columns])).alias("_c"))
    counts = cells.groupBy("_c.column", "_name").agg(F.count_if("_c.missing").alias("_n"))
    totals = counts.groupBy("column").agg(F.sum("_n").alias("n_missing"))
    place = F.row_number().over(W.partitionBy("column").orderBy("_name"))
    first = counts.filter("_n > 0").withColumn("_place", place).filter(F.col("_place") <= NAMES_SHOWN)
    names = first.groupBy("column").agg(F.array_join(F.sort_array(F.collect_list("_name")), ",").alias("names"))
    return totals.join(names, "column", "left")


def feature_table(directions: DataFrame, pores: DataFrame, external: DataFrame, columns: list[str]) -> DataFrame:
    """Direction rows with pore diameters and external descriptors, narrow directions excluded."""
    merged = directions.join(pore_rows(pores), ["framework", "direction"], "left")
    looked_up = lookup_external(exclude_narrow(merged), external)
    return ensure_columns(looked_up, ["sample", "framework", "direction", "dimensionality"], columns)


def complete_cases(df: DataFrame, columns: list[str], out: str = "complete") -> DataFrame:
    """Cast the columns to numbers and mark the rows in which all of them have a value."""
    cast = df.withColumns({c: F.nanvl(F.expr(f"try_cast(`{c}` AS double)"), F.lit(None).cast("double")) for c in columns})
    whole: Column = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return cast.withColumn(out, whole)


def first_match(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key; a combinable aggregate instead of a window over the key."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def seeded_sample(df: DataFrame, name: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows with the smallest hash of name and seed: the same rows in every run."""
    draw = F.md5(F.concat_ws("|", F.col(name).cast("string"), F.lit(str(seed))))
    return df.withColumn("_draw", draw).orderBy("_draw", name).limit(n).drop("_draw")


def run_summary(inputs: DataFrame, barriers: DataFrame) -> DataFrame:
    """One row per input with its status and the rounded barriers; failed inputs stay."""
    picks = [F.max(F.when(F.col("axis") == a, F.round("barrier", 4))).alias(f"barrier_{a}") for a in AXES]
    per = barriers.groupBy("framework").agg(F.lit(True).alias("_done"), *picks)
    joined = inputs.select("framework").distinct().join(per, "framework", "left")
    return joined.select("framework", F.when(F.col("_done"), "OK").otherwise("FAILED").alias("status"),
                         *[f"barrier_{a}" for a in AXES])


# Stages of a run in order, and the reasons that leave rows out without ending the run of a framework.
STAGES = ("read", "pore size", "mask", "barrier", "features")
HARMLESS = ("site without coordinates",)


def stage_rejects(inputs: DataFrame, passed: DataFrame, stage: str, reason: str) -> DataFrame:
    """Rejects (framework, stage, reason, n) of the inputs that a stage did not pass on."""
    lost = inputs.select("framework").distinct().join(passed.select("framework").distinct(), "framework", "left_anti")
    return lost.select("framework", F.lit(stage).alias("stage"), F.lit(reason).alias("reason"), F.lit(1).cast("long").alias("n"))


def barrier_rejects(records: DataFrame) -> DataFrame:
    """One reject per framework with traversable axes that have no path; the reason names the axes."""
    lost = records.filter(F.col("status") == "no path").groupBy("framework").agg(F.array_sort(F.collect_set("axis")).alias("_a"))
    return lost.select("framework", F.lit("barrier").alias("stage"), F.concat(F.lit("no path along "), F.array_join("_a", ", ")).alias("reason"),
                       F.size("_a").cast("long").alias("n"))


def run_report(inputs: DataFrame, barriers: DataFrame, rejects: DataFrame) -> DataFrame:
    """``run_summary`` with the stage at which a failed input was lost, the reason, and how many rows of it were left out.

    The earliest stage counts, then the first reason by name.  An input without any reject that yields nothing was lost
    at the last stage.  Inputs are what was listed, so one that no stage saw is there too."""
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    ends = F.when(~F.col("reason").isin(*HARMLESS), F.struct(order.alias("at"), "reason", "stage"))
    per = rejects.groupBy("framework").agg(F.min(ends).alias("_r"), F.sum(F.when(F.col("reason").isin(*HARMLESS), F.col("n")).otherwise(0)).alias("_left"))
    rows = run_summary(inputs, barriers).join(per, "framework", "left")
    failed = F.col("_r").isNotNull() | (F.col("status") != "OK")
    return rows.select(
        "framework", F.when(failed, "FAILED").otherwise("OK").alias("status"),
        F.when(failed, F.coalesce(F.col("_r.stage"), F.lit(STAGES[-1]))).alias("stage"),
        F.when(failed, F.coalesce(F.col("_r.reason"), F.lit("no result"))).alias("reason"), F.coalesce("_left", F.lit(0)).alias("rows_left_out"),
        *[F.when(~failed, F.col(f"barrier_{a}")).alias(f"barrier_{a}") for a in AXES])


def status_counts(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count_if(F.col("status") == "OK").alias("n_ok"),
                       F.count_if(F.col("status") != "OK").alias("n_failed"))
