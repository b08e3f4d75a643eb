"""Scoring of feature rows with a small network held as weight tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from porescreen.operators.assemble import complete_cases

LEAK = 0.01
BATCH_NORM_EPS = 1e-5
ERF_TERMS, ERF_REACH = 160, 6.0


def _erf(x: Column) -> Column:
    """Error function by the series of positive terms x (2 x^2)^n / (1 3 ... (2n+1)), exact to about 1e-15.

    Beyond ``ERF_REACH`` it is one but for the last bit."""
    near = F.greatest(F.least(x, F.lit(ERF_REACH)), F.lit(-ERF_REACH))
    start = F.struct(near.alias("term"), near.alias("total"))

    def add(acc, n):
        term = acc["term"] * 2.0 * near * near / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(ERF_TERMS)), start, add)["total"]
    return total * F.exp(-near * near) * (2.0 / math.sqrt(math.pi))


def _erf_array(x: np.ndarray) -> np.ndarray:
    near = np.clip(x, -ERF_REACH, ERF_REACH)
    term, total = near.copy(), near.copy()
    for n in range(1, ERF_TERMS + 1):
        term *= 2.0 * near * near / (2 * n + 1)
        total += term
    return total * np.exp(-near * near) * (2.0 / math.sqrt(math.pi))


def activation(value: Column, name: str) -> Column:
    """Activation as a column expression; unknown names act as relu."""
    kinds = {
        "leaky_relu": F.when(value >= 0, value).otherwise(LEAK * value),
        "tanh": F.tanh(value),
        "elu": F.when(value > 0, value).otherwise(F.exp(value) - 1.0),
        "gelu": 0.5 * value * (1.0 + _erf(value / math.sqrt(2.0))),
    }
    return kinds.get((name or "relu").lower(), F.greatest(value, F.lit(0.0)))


def _activate(values: np.ndarray, name: str) -> np.ndarray:
    name = (name or "relu").lower()
    if name == "gelu":
        return 0.5 * values * (1.0 + _erf_array(values / math.sqrt(2.0)))
    if name == "leaky_relu":
        return np.where(values >= 0, values, LEAK * values)
    if name == "tanh":
        return np.tanh(values)
    if name == "elu":
        return np.where(values > 0, values, np.expm1(np.minimum(values, 0.0)))
    return np.maximum(values, 0.0)


@dataclass(frozen=True)
class Network:
    """Dense layers with batch normalisation folded in; one output."""

    weights: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    activation: str = "relu"

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        for w, b in zip(self.weights[:-1], self.biases[:-1]):
            rows = _activate(rows @ w.T + b, self.activation)
        return (rows @ self.weights[-1].T + self.biases[-1]).ravel()


def parameter_gaps(weights: DataFrame, widths: DataFrame) -> DataFrame:
    """Strict match of a weight table: expected (layer, out, in) entries that are absent, and
    entries that are not expected.  Empty when the table fits.

    ``widths(layer, out, n_in)`` lists the expected units and their input counts."""
    expected = widths.select("layer", "out", F.explode(F.expr("sequence(0, cast(n_in as int) - 1)")).alias("in"))
    have = weights.select("layer", "out", F.col("in").cast("int").alias("in"))
    keys = ["layer", "out", "in"]
    return (expected.join(have, keys, "left_anti").withColumn("problem", F.lit("missing"))
            .unionByName(have.join(expected, keys, "left_anti").withColumn("problem", F.lit("unexpected"))))


def fold_batch_norm(weights: DataFrame, bias: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold the stored running statistics into weights and biases; layers without them pass."""
    scale = F.coalesce(F.col("gamma") / F.sqrt(F.col("var") + BATCH_NORM_EPS), F.lit(1.0))
    units = bias.withColumn("_scale", scale)
    folded = weights.join(units.select("layer", "out", "_scale"), ["layer", "out"]).select(
        "layer", "out", "in", (F.col("w") * F.col("_scale")).alias("w"))
    shifted = units.select("layer", "out", (
        (F.col("b") - F.coalesce("mean", F.lit(0.0))) * F.col("_scale") + F.coalesce("beta", F.lit(0.0))).alias("b"))
    return folded, shifted


def load_network(weights: DataFrame, bias: DataFrame, activation_name: str = "relu",
                 widths: DataFrame | None = None, max_parameters: int = 10_000_000) -> Network:
    """Read the weight tables of one model into a form tasks can apply.

    ``widths`` (see ``parameter_gaps``) makes the match strict: entries that are absent or not expected are an error,
    and so are more weights than ``max_parameters``, which every task would hold."""
    n = weights.count()
    if n > max_parameters:
        raise ValueError(f"{n} weights exceed the bound of {max_parameters}")
    if widths is not None and (gaps := parameter_gaps(weights, widths).limit(5).collect()):
        raise ValueError(f"weight table does not fit the model, for example {[tuple(g) for g in gaps]}")
    folded, shifted = (t.toPandas() for t in fold_batch_norm(weights, bias))
    ws, bs = [], []
    for layer, rows in folded.groupby("layer", sort=True):
        ws.append(rows.pivot(index="out", columns="in", values="w").sort_index().to_numpy())
        bs.append(shifted[shifted["layer"] == layer].sort_values("out")["b"].to_numpy())
    return Network(tuple(ws), tuple(bs), activation_name)


def scale_features(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Apply the stored transform (x - mean) / scale to each feature."""
    return df.withColumns({f: (F.col(f) - F.lit(m)) / F.lit(s) for f, (m, s) in scaler.items()})


def network_output(features: list[Column], network: Network) -> Column:
    """Model output as a column; rows travel in Arrow batches and meet the weights as matrices."""
    @F.pandas_udf(T.DoubleType())
    def forward(rows: pd.Series) -> pd.Series:
        if rows.empty:
            return pd.Series([], dtype=float)
        return pd.Series(network(np.stack(rows.to_numpy()).astype(float)))

    return forward(F.array(*[F.coalesce(f, F.lit(0.0)) for f in features]))


def predict(df: DataFrame, features: list[str], scaler: dict[str, tuple[float, float]], network: Network,
            log_base: float = math.e, scale: float = 1.0) -> DataFrame:
    """Add ``ln_Ds_pred``, ``Ds_pred`` and ``pred_ok``; incomplete rows keep NULLs."""
    marked = complete_cases(df, features, "pred_ok")
    scaled = [(F.col(f) - F.lit(scaler[f][0])) / F.lit(scaler[f][1]) for f in features]
    out = marked.withColumn("_y", network_output(scaled, network))
    power = F.exp("_y") if log_base == math.e else F.pow(F.lit(log_base), F.col("_y"))
    return out.withColumns({
        "ln_Ds_pred": F.when(F.col("pred_ok"), F.col("_y")),
        "Ds_pred": F.when(F.col("pred_ok"), power * scale)}).drop("_y")


def diffusivity_table(predicted: DataFrame, ids: list[str], unit: str) -> DataFrame:
    """Result table: predicted rows only, with the unit in the column name."""
    return predicted.filter("pred_ok").select(*ids, F.col("Ds_pred").alias(f"Ds_pred ({unit})"))
