"""Descriptor nomenclature and name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Keys, symbols, plain symbols, names, units and families of the 13 model features,
# in model order.  The definitions are worded here.
DESCRIPTORS = [
    ("barrier_official", "Ebarrier", "Ebarrier", "Minimax (min-bottleneck) diffusion barrier",
     "kJ mol⁻¹", "Barrier structure",
     "Lowest possible highest energy on a crossing path, above the lowest pore energy."),
    ("sigma_E", "σE", "sigmaE", "Energy-landscape roughness", "kJ mol⁻¹", "Energy landscape",
     "Standard deviation of the energy along the path, weighted by arc length."),
    ("eta_main", "ηmain", "etamain", "Main-axis transport efficiency", "", "Pathway topology",
     "Displacement along the main axis divided by the path length."),
    ("tortuosity", "Pτ", "Ptau", "Pathway tortuosity", "", "Pathway topology",
     "Path length divided by the distance between its ends."),
    ("E_max", "Emax", "Emax", "Maximum pathway energy", "kJ mol⁻¹", "Energy landscape",
     "Highest energy met along the path."),
    ("E_min_official", "Emin", "Emin", "Adsorption-site baseline energy", "kJ mol⁻¹", "Energy landscape",
     "Transition energy minus barrier: the common energy zero."),
    ("peak_slope_mean", "GE,mean", "GEmean", "Mean barrier steepness", "kJ mol⁻¹ Å⁻¹", "Barrier structure",
     "Mean over the peaks of the steeper flank gradient; 0 without peaks."),
    ("H_entropy", "HE", "HE", "Differential energy entropy", "", "Energy landscape",
     "Differential entropy of the energies along the path."),
    ("barrier_freq", "ρbarrier", "rhobarrier", "Barrier number density", "Å⁻¹", "Barrier structure",
     "Prominent peaks per path length, after repair of jumps."),
    ("PLD", "PLD", "PLD", "Pore limiting diameter", "Å", "Pore geometry",
     "Largest sphere that passes along the direction."),
    ("FDSi", "FDSi", "FDSi", "Framework density", "Si nm⁻³", "Pore geometry",
     "Silicon centres per volume."),
    ("Vacc", "Vacc", "Vacc", "Accessible pore volume fraction", "%", "Pore geometry",
     "Probe-accessible share of the cell volume."),
    ("ASA", "ASA", "ASA", "Accessible surface area", "m² g⁻¹", "Pore geometry",
     "Probe-accessible inner surface per mass."),
]

# Older spellings that still resolve.
OLDER_SPELLINGS = {
    "barrier_official": ["E_a", "E_a,mb", "E_a_mb", "Ea"],
    "E_min_official": ["E_min", "E_min,mb", "E_min_mb"],
    "sigma_E": ["sigma_E", "σ_E"],
    "eta_main": ["eta_main", "η_main"],
    "tortuosity": ["P_tau", "P_τ"],
    "E_max": ["E_max"],
    "peak_slope_mean": ["G_E,mean", "G_E_mean", "SPmean", "SP_mean"],
    "H_entropy": ["H_E"],
    "barrier_freq": ["rho_barrier", "ρ_barrier", "fbarrier", "f_barrier"],
    "FDSi": ["FD_Si"],
    "PLD": ["PLD1"],
    "Vacc": ["V_acc"],
    "ASA": ["A_acc"],
}

FEATURE_ORDER = [d[0] for d in DESCRIPTORS]
SYMBOLS = {d[0]: d[1] for d in DESCRIPTORS}
PLAIN_SYMBOLS = {d[0]: d[2] for d in DESCRIPTORS}
UNITS = {d[0]: d[4] for d in DESCRIPTORS}

# Spelling (lower case) -> key.  A current spelling beats an older one.
ALIASES = {s.lower(): key for key, older in reversed(OLDER_SPELLINGS.items()) for s in reversed(older)}
ALIASES |= {s.lower(): d[0] for d in DESCRIPTORS for s in d[:4]}


def nomenclature(spark: SparkSession) -> DataFrame:
    """The nomenclature table; a blank unit reads 'dimensionless'."""
    rows = [(i + 1, *d) for i, d in enumerate(DESCRIPTORS)]
    table = spark.createDataFrame(
        rows, "ord int, key string, symbol string, ascii string, name string, unit string, family string, definition string")
    return table.withColumn("unit", F.coalesce(F.nullif("unit", F.lit("")), F.lit("dimensionless")))


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(ALIASES.items()), "alias string, key string")


def match_key(name: Column | str) -> Column:
    """Names meet regardless of case and outer blanks."""
    return F.lower(F.trim(name))


def resolve_names(df: DataFrame, name: str, out: str = "key") -> DataFrame:
    """Add the internal key of a descriptor name; unknown names pass through unchanged."""
    aliases = alias_table(df.sparkSession).select(F.col("alias").alias("_alias"), F.col("key").alias("_key"))
    joined = df.join(aliases, match_key(name) == F.col("_alias"), "left")
    return joined.withColumn(out, F.coalesce("_key", name)).drop("_alias", "_key")


def label_names(df: DataFrame, key: str) -> DataFrame:
    """Add ``symbol``, ``ascii`` and ``symbol_with_unit``; unknown keys keep their own text."""
    lookup = df.sparkSession.createDataFrame(
        [(d[0], d[1], d[2], f"{d[1]} ({d[4]})" if d[4] else d[1]) for d in DESCRIPTORS],
        "_key string, symbol string, ascii string, symbol_with_unit string")
    joined = df.join(lookup, F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumns({c: F.coalesce(c, key) for c in ("symbol", "ascii", "symbol_with_unit")})


def resolve_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Rename columns that carry another spelling of a wanted key; a column already named so wins."""
    renames = {}
    for column in df.columns:
        key = ALIASES.get(column.strip().lower())
        if column not in wanted and key in wanted and key not in df.columns and key not in renames.values():
            renames[column] = key
    return df.withColumnsRenamed(renames)


def symbol_columns(df: DataFrame, with_unit: bool = False) -> DataFrame:
    """Rename feature columns to their symbols, with the unit if asked."""
    names = {k: f"{s} ({UNITS[k]})" if with_unit and UNITS[k] else s for k, s in SYMBOLS.items()}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
