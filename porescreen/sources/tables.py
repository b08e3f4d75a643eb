"""Table scans that check what they read, and the result tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from porescreen.functions.names import match_key, resolve_columns
from porescreen.operators.assemble import EXTERNAL_COLUMNS, complete_cases
from porescreen.operators.score import Network, load_network

WEIGHT_COLUMNS = ("layer", "out", "in", "w")
BIAS_COLUMNS = ("layer", "out", "b", "gamma", "beta", "mean", "var")


def read_table(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A Parquet or CSV table (by its suffix); columns that are required and absent are named in the error."""
    reader = spark.read.option("header", True)
    df = reader.csv(path) if path.rstrip("/").endswith(".csv") else reader.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}; it has {df.columns}")
    return df


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """External descriptors (Zeolites and numbers), with the key by which names meet."""
    df = read_table(spark, path, ("Zeolites", *EXTERNAL_COLUMNS))
    values = [F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in EXTERNAL_COLUMNS]
    return df.select("Zeolites", *values).withColumn("match_key", match_key("Zeolites"))


def background_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Background rows by feature: other spellings of the columns resolved, text made numbers, incomplete rows left out.

    Reading the result fails if a feature has no column, or if no complete row is left."""
    found = resolve_columns(df, features)
    missing = [f for f in features if f not in found.columns]
    if missing:
        raise ValueError(f"background lacks the features {missing}; it has {df.columns}")
    rows = complete_cases(found, features).filter("complete").select(*features)
    if rows.isEmpty():
        raise ValueError("background holds no complete rows")
    return rows


def read_model(spark: SparkSession, folder: str, activation: str = "relu") -> tuple[Network, list[str], dict]:
    """The model tables of a folder: ``weights``, ``bias``, ``widths``, and ``features`` (pos, feature, mean, scale).

    The weights must match the widths entry by entry.  Returns the network, the order of its features and its scaler."""
    tables = {name: read_table(spark, f"{folder}/{name}.parquet", need) for name, need in {
        "weights": WEIGHT_COLUMNS, "bias": BIAS_COLUMNS, "widths": ("layer", "out", "n_in"),
        "features": ("pos", "feature", "mean", "scale")}.items()}
    order = tables["features"].orderBy("pos").collect()
    network = load_network(tables["weights"], tables["bias"], activation, tables["widths"])
    return network, [r["feature"] for r in order], {r["feature"]: (r["mean"], r["scale"]) for r in order}


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> list[str]:
    """Write each table as a folder of part files, Parquet or CSV with a header; returns the paths."""
    paths = []
    for name, df in tables.items():
        path = f"{folder}/{name}.{kind}"
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
        paths.append(path)
    return paths
