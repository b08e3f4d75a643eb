"""Shapley attribution of scores against a background, and its conversion to original scale."""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from porescreen.functions.names import match_key
from porescreen.session import cut_lineage

# Fixed values of the attribution rules.
NAME_COLUMNS = ("zeolites", "zeolite", "name")
BASE_COLUMNS = ("base_value", "base", "expected_value")
# Rows that a task scores at once.
CHUNK_ROWS = 1 << 17
# Rows that stand for a background, and the intervals of its score.
BACKGROUND_ROWS, SCORE_BINS = 256, 32


def _masks(d: int, permutations: int | None, seed: int) -> tuple[np.ndarray, list]:
    """Coalitions to evaluate and, per feature, (with, without, weight) rows into them."""
    if permutations is None:
        number = np.arange(1 << d)
        masks = (number[:, None] >> np.arange(d)) & 1
        size = masks.sum(axis=1)
        share = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])
        terms = []
        for i in range(d):
            without = number[masks[:, i] == 0]
            terms.append((without | (1 << i), without, share[size[without]]))
        return masks.astype(bool), terms
    rng = np.random.default_rng(seed)
    rows: dict[bytes, int] = {}
    pairs: list[list[tuple[int, int]]] = [[] for _ in range(d)]

    def row(mask):
        return rows.setdefault(mask.tobytes(), len(rows))

    for _ in range(permutations):
        order = rng.permutation(d)
        for walk in (order, order[::-1]):
            mask = np.zeros(d, dtype=bool)
            for i in walk:
                before = row(mask)
                mask[i] = True
                pairs[i].append((row(mask), before))
    masks = np.array([np.frombuffer(m, dtype=bool) for m in rows])
    terms = [(np.array([a for a, _ in p]), np.array([b for _, b in p]), np.full(len(p), 1 / len(p))) for p in pairs]
    return masks, terms


def background_sample(background: DataFrame, features: list[str], model, most: int = BACKGROUND_ROWS, bins: int = SCORE_BINS,
                      seed: int = 0, key: str | None = None) -> tuple[DataFrame, float]:
    """A weighted sample (bin, part, weight, features) of about ``most`` rows of the background, and its base value.

    The base value is the mean score of all rows.  A background of at most ``most`` rows enters as it is.  A larger one is
    cut into ``bins`` equal intervals of its score, an interval into parts by a seeded hash of ``key`` (as many as its share
    of the rows), and a part is represented by its row of least hash, with the number of its rows as weight.  Counts and
    least rows merge, so every task reduces its rows before they are shuffled, and the same rows are drawn in every run.

    Errors: weighted, the sample's mean score is within one interval, (highest - lowest score) / bins, of the base
    value; the weights are then tilted along the score so that it is the base value.  The value of a coalition is off by
    at most r * sqrt(ln(2 / q) / (2 * most)) with probability 1 - q, where r is the range of the scores.
    """
    kinds = T.StructType([T.StructField(f, T.DoubleType()) for f in features]
                         + [T.StructField("_order", T.StringType()), T.StructField("_y", T.DoubleType())])
    named = F.col(key).cast("string") if key else F.concat_ws(",", *features)
    rows = background.select(*[F.col(f).cast("double").alias(f) for f in features],
                             F.md5(F.concat(named, F.lit(f"|{seed}")).cast("binary")).alias("_order"))

    def scored(batches):
        for batch in batches:
            yield batch.assign(_y=model(batch[features].to_numpy(dtype=float)) if len(batch) else [])

    rows = cut_lineage(rows.mapInPandas(scored, kinds))
    n, base, low, high = rows.agg(F.count("*"), F.avg("_y"), F.min("_y"), F.max("_y")).first()
    if not n:
        raise ValueError("background holds no complete rows")
    if n <= most or high == low:
        few = rows if n <= most else rows.orderBy("_order").limit(most)  # scores all equal: any rows have their mean
        return few.select(F.lit(0).alias("bin"), F.col("_order").alias("part"), F.lit(float(n) / min(n, most)).alias("weight"), *features), float(base)
    bin_ = F.least(F.floor((F.col("_y") - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")
    binned = rows.withColumn("bin", bin_)
    parts = [1] * bins
    for row in binned.groupBy("bin").count().collect():  # ``bins`` rows
        parts[row["bin"]] = max(1, row["count"] * most // n)
    number = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    share = F.element_at(F.array(*[F.lit(k) for k in parts]), F.col("bin") + 1)
    picked = binned.groupBy("bin", (number % share).cast("string").alias("part")).agg(
        F.count("*").alias("_n"), F.min_by(F.struct("_y", *features), "_order").alias("_row"))
    picked = cut_lineage(picked.select("bin", "part", F.col("_n").cast("double").alias("_n"), "_row.*"))  # most + bins rows
    mean = F.sum(F.col("_n") * F.col("_y")) / F.sum("_n")
    square = F.sum(F.col("_n") * F.col("_y") * F.col("_y")) / F.sum("_n")
    m, q = picked.agg(mean, square).first()
    tilt = (base - m) / (q - m * m) if q > m * m else 0.0
    return picked.select("bin", "part", (F.col("_n") * (1 + F.lit(tilt) * (F.col("_y") - F.lit(m)))).alias("weight"), *features), float(base)


def shapley_values(samples: DataFrame, background: DataFrame, name: str, features: list[str], model,
                   permutations: int | None = None, seed: int = 0, exact_features: int = 15, most: int = BACKGROUND_ROWS,
                   bins: int = SCORE_BINS, key: str | None = None) -> DataFrame:
    """Attribution matrix: one row per sample with ``base_value`` and one column per feature.

    Up to ``exact_features`` features every coalition is evaluated once, which gives the exact values that a
    permutation estimate converges to; beyond that, or on request, ``permutations`` seeded
    orders are walked forwards and backwards.  Samples stay partitioned; the background enters by its
    ``background_sample``, so the cost is linear in the samples and the base value is that of all its rows.  ``model`` maps a (rows, features) matrix to scores.
    """
    d = len(features)
    if permutations is None and d > exact_features:
        raise ValueError(f"{d} features: give a number of permutations")
    masks, terms = _masks(d, permutations, seed)
    sample, base = background_sample(background, features, model, most, bins, seed, key)
    drawn = np.array([tuple(r) for r in sample.orderBy("bin", "part").select("weight", *features).collect()], dtype=float)
    weights, reference = drawn[:, 0] / drawn[:, 0].sum(), drawn[:, 1:]
    together = max(1, CHUNK_ROWS // (len(masks) * len(reference)))
    step = max(1, CHUNK_ROWS // (together * len(reference)))

    def explain(batches):
        for batch in batches:
            rows, out = batch[features].to_numpy(dtype=float), np.empty((len(batch), d))
            for first in range(0, len(rows), together):
                x = rows[first:first + together, None, None, :]
                value = np.empty((len(x), len(masks)))
                for at in range(0, len(masks), step):
                    part = masks[at:at + step]
                    mixed = np.where(part[None, :, None, :], x, reference[None, None, :, :])
                    scores = model(mixed.reshape(-1, d)).reshape(len(x), len(part), -1)
                    value[:, at:at + len(part)] = scores @ weights
                for i, (a, b, w) in enumerate(terms):
                    out[first:first + len(x), i] = (value[:, a] - value[:, b]) @ w
            yield pd.DataFrame({name: batch[name], "base_value": base} | {
                f: out[:, i] for i, f in enumerate(features)})

    key = samples.schema[name]
    schema = T.StructType([key, T.StructField("base_value", T.DoubleType())]
                          + [T.StructField(f, T.DoubleType()) for f in features])
    return samples.select(name, *features).mapInPandas(explain, schema)


def choose_background(batch: DataFrame, supplied: DataFrame | None, features: list[str]) -> DataFrame:
    """The supplied training sample, else the current batch; either is sampled where it is used."""
    return supplied if supplied is not None else batch


def attribution_rows(matrix: DataFrame, name: str, features: list[str]) -> DataFrame:
    """Long form (name, feature, phi, base_value) of an attribution matrix."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("phi")) for f in features]))
    return matrix.select(name, "base_value", cells.alias("_c")).select(name, "_c.feature", "_c.phi", "base_value")


def attribution_matrix(rows: DataFrame, name: str, features: list[str]) -> DataFrame:
    """Wide form, base value first."""
    picks = [F.max(F.when(F.col("feature") == f, F.col("phi"))).alias(f) for f in features]
    return rows.groupBy(name).agg(F.max("base_value").alias("base_value"), *picks).select(name, "base_value", *features)


def known_attributions(table: DataFrame, features: list[str], position: str,
                       default_base: float | None = None) -> DataFrame:
    """Precomputed attributions keyed by name; of repeated names the last row (by ``position``) wins.

    The name and base columns are found among their usual spellings."""
    lower = {c.strip().lower(): c for c in reversed(table.columns)}
    name = next((lower[c] for c in lower if c in NAME_COLUMNS), None)
    base = next((lower[c] for c in lower if c in BASE_COLUMNS), None)
    missing = [f for f in features if f not in table.columns]
    if name is None or missing:
        raise ValueError(f"attribution table not usable (name column: {name}, missing: {missing})")
    if base is None and default_base is None:
        raise ValueError("attribution table has no base column and no default is given")
    value = F.col(base) if base else F.lit(default_base)
    row = F.struct(value.cast("double").alias("base_value"), *[F.col(f).cast("double").alias(f) for f in features])
    return (table.groupBy(match_key(F.col(name)).alias("match_key"))
            .agg(F.max_by(row, F.col(position)).alias("_row")).select("match_key", "_row.*"))


def hybrid_attributions(samples: DataFrame, known: DataFrame, background: DataFrame, name: str,
                        features: list[str], model, max_explain: int | None = None, seed: int = 0, **background_rule) -> DataFrame:
    """Known attributions where the name is known, computed ones elsewhere.

    With ``max_explain`` only a seeded sample of the unknown names is computed; the others keep
    NULLs, so that an unexplained row cannot be read as one without contributions."""
    from porescreen.operators.assemble import seeded_sample

    keyed = samples.withColumn("match_key", match_key(name))
    hits = keyed.select(name, "match_key").join(known, "match_key").select(
        name, "base_value", *features).withColumn("source", F.lit("known"))
    misses = keyed.join(known.select("match_key"), "match_key", "left_anti")
    chosen = misses if max_explain is None else seeded_sample(misses, name, max_explain, seed)
    computed = shapley_values(chosen, background, name, features, model, **background_rule).withColumn("source", F.lit("computed"))
    out = hits.unionByName(computed)
    if max_explain is not None:
        rest = misses.select(name).join(chosen.select(name), name, "left_anti")
        nulls = [F.lit(None).cast("double").alias(c) for c in ("base_value", *features)]
        out = out.unionByName(rest.select(name, *nulls, F.lit("not explained").alias("source")))
    return out


def original_scale(matrix: DataFrame, name: str, features: list[str]) -> DataFrame:
    """Convert ln-scale attributions to the original scale.

    Each feature gets its share of the total, times the difference between prediction and base;
    all zero when the total is zero.  Unnamed samples are called ``sample_<i>`` by ``pos`` if present."""
    total: Column = sum((F.col(f) for f in features), F.lit(0.0))
    pred, base = F.exp(F.col("base_value") + F.col("_total")), F.exp(F.col("base_value"))
    label = F.coalesce(F.col(name), F.concat(F.lit("sample_"), F.col("pos"))) if "pos" in matrix.columns else F.col(name)
    return matrix.withColumn("_total", total).select(
        label.alias(name), pred.alias("orig_pred"), base.alias("orig_base"),
        *[F.when(F.col("_total") == 0, F.lit(0.0)).otherwise(F.col(f) / F.col("_total") * (pred - base)).alias(f)
          for f in features])


def waterfall_rows(original: DataFrame, name: str, features: list[str]) -> DataFrame:
    """Waterfall layout: features from the smallest to the largest contribution, each with the
    running value before and after it, from the base to the prediction."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(f).alias("feature"), F.col(f).alias("contribution"))
        for i, f in enumerate(features)]))
    rows = original.select(name, "orig_base", cells.alias("_c")).select(name, "orig_base", "_c.*")
    order = W.partitionBy(name).orderBy(F.abs("contribution"), F.desc("ord"))
    end = F.col("orig_base") + F.sum("contribution").over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.select(
        name, "feature", "contribution", F.row_number().over(order).alias("step"),
        (end - F.col("contribution")).alias("start_value"), end.alias("end_value"))


def ranked_contributions(original: DataFrame, name: str, features: list[str]) -> DataFrame:
    """Features of each sample by falling magnitude, ties in model order.

    Sorting happens inside the row; nothing is shuffled."""
    cells = F.array(*[F.struct((-F.abs(F.col(f))).alias("neg"), F.lit(i).alias("ord"), F.lit(f).alias("feature"),
                               F.col(f).alias("contribution")) for i, f in enumerate(features)])
    rows = original.select(name, F.posexplode(F.array_sort(cells)).alias("_p", "_c"))
    return rows.select(name, (F.col("_p") + 1).alias("rank"), "_c.feature", "_c.contribution")

