"""Views of the given tables in the shape of paths, voxel grids, atoms and feature tables.

Each view exists twice: as a DataFrame and as the text of a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from porescreen.operators.ordered import Sequence, number_rows

N_DIMS = 5
GRID = (50, 11, 9)
POROSITY = 0.3
PATH_KEYS = ("user_id",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- ordered paths from the event stream -------------------------------------------------------

def paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Sequence]:
    """One path per user: event time, value and property as coordinates, value as energy."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id",
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("us"),
        F.col("value").alias("e"),
        F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("k"))
    numbered, seq = number_rows(rows, PATH_KEYS, ["us", "event_id"])
    return numbered.select(
        "user_id", "seq", (F.col("us") / 3.6e9).alias("x"), (F.col("e") / 10).alias("y"),
        (F.col("k") / 10).alias("z"), "e"), seq


V_PATH = """
ev AS (
  SELECT user_id, event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us, value AS e,
         CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS k
  FROM events),
v_path AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS seq,
         us / 3.6e9::DOUBLE AS x, e / 10 AS y, k / 10 AS z, e
  FROM ev)"""

# Repeated points dropped and renumbered; paths below four nodes removed.
V_CLEAN = V_PATH + """,
lagged AS (
  SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz
  FROM v_path WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
kept AS (
  SELECT user_id, seq, x, y, z, e FROM lagged
  WHERE px IS NULL OR sqrt((x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)) > 1e-8),
renumbered AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS seq, x, y, z, e,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM kept),
clean AS (SELECT * FROM renumbered WHERE n >= 4)"""

# Steps of the cleaned path: length, running arc length and middle energy.
V_STEPS = V_CLEAN + """,
steps0 AS (
  SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lag(e) OVER w AS pe
  FROM clean WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
steps1 AS (
  SELECT user_id, seq, x, y, z, e, n,
         coalesce(sqrt((x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)), 0.0::DOUBLE) AS ds, 0.5 * (pe + e) AS e_mid
  FROM steps0),
steps AS (
  SELECT *, sum(ds) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM steps1)"""


# -- voxel grid from order lines ---------------------------------------------------------------

def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frameworks (line status) of 50 x 11 x 9 voxels; the energy is the mean price, as an
    integer.  Voxels without lines are solid."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("framework"),
        (F.col("l_quantity") - 1).cast("int").alias("i"),
        F.round(F.col("l_discount") * 100).cast("int").alias("j"),
        F.round(F.col("l_tax") * 100).cast("int").alias("k"), "l_extendedprice")
    return rows.groupBy("framework", "i", "j", "k").agg(
        F.round(F.avg("l_extendedprice")).cast("double").alias("e"))


V_GRID = """
v_grid AS (
  SELECT l_linestatus AS framework, CAST(l_quantity - 1 AS INT) AS i,
         CAST(round(l_discount * 100) AS INT) AS j, CAST(round(l_tax * 100) AS INT) AS k,
         CAST(round(avg(l_extendedprice)) AS DOUBLE) AS e
  FROM lineitem GROUP BY 1, 2, 3, 4)"""


def low_energy(voxels: DataFrame, share: float = POROSITY) -> DataFrame:
    """Voxels up to the energy that ``share`` of the voxels of a framework do not exceed.

    Counted per distinct (integer) energy, so the ranking window holds values, not voxels."""
    per_value = voxels.groupBy("framework", "e").count()
    upto = F.sum("count").over(W.partitionBy("framework").orderBy("e"))
    total = F.sum("count").over(W.partitionBy("framework"))
    bound = (per_value.select("framework", "e", upto.alias("upto"), total.alias("total"))
             .filter(F.col("upto") >= F.ceil(F.lit(share) * F.col("total")))
             .groupBy("framework").agg(F.min("e").alias("bound")))
    return voxels.join(bound, "framework").filter(F.col("e") <= F.col("bound")).drop("bound")


V_PORE = V_GRID + f""",
bound AS (SELECT framework, quantile_disc(e, {POROSITY}) AS bound FROM v_grid GROUP BY 1),
v_pore AS (SELECT framework, i, j, k, e FROM v_grid JOIN bound USING (framework) WHERE e <= bound)"""


# -- atoms from embeddings ---------------------------------------------------------------------

def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One framework per label; three embedding dimensions as fractional coordinates."""
    v = table(spark, sf_dir, "embeddings")
    part = [F.pmod(F.col("embedding")[d].cast("double"), F.lit(1.0)) for d in range(3)]
    return v.select(
        F.concat(F.lit("fw"), F.col("label")).alias("framework"), F.col("vec_id").alias("atom_id"),
        F.when(F.col("vec_id") % 3 == 0, F.lit("Si")).otherwise(F.lit("O")).alias("element"),
        part[0].alias("fx"), part[1].alias("fy"), part[2].alias("fz"))


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell edges grow with the label; right angles."""
    v = table(spark, sf_dir, "embeddings").select("label").distinct()
    edge = [(F.col("label") + base).cast("double") for base in (10, 11, 12)]
    return v.select(F.concat(F.lit("fw"), F.col("label")).alias("framework"),
                    *[e.alias(n) for e, n in zip(edge, "abc")],
                    *[F.lit(90.0).alias(n) for n in ("alpha", "beta", "gamma")])


V_ATOMS = """
v_atoms AS (
  SELECT 'fw' || label AS framework, vec_id AS atom_id,
         CASE WHEN vec_id % 3 = 0 THEN 'Si' ELSE 'O' END AS element,
         embedding[1]::DOUBLE - floor(embedding[1]::DOUBLE) AS fx,
         embedding[2]::DOUBLE - floor(embedding[2]::DOUBLE) AS fy,
         embedding[3]::DOUBLE - floor(embedding[3]::DOUBLE) AS fz
  FROM embeddings),
v_struct AS (
  SELECT DISTINCT 'fw' || label AS framework, (label + 10)::DOUBLE AS a, (label + 11)::DOUBLE AS b,
         (label + 12)::DOUBLE AS c, 90.0::DOUBLE AS alpha, 90.0::DOUBLE AS beta, 90.0::DOUBLE AS gamma
  FROM embeddings)"""


# -- feature tables from embeddings ------------------------------------------------------------

def feature_names(d: int = N_DIMS) -> list[str]:
    return [f"f{i + 1}" for i in range(d)]


def features(spark: SparkSession, sf_dir: str, d: int = N_DIMS) -> DataFrame:
    """Samples ``vec_<id>`` with d features; the second is missing in every 17th sample."""
    v = table(spark, sf_dir, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(feature_names(d))]
    cols[1] = F.when(F.col("vec_id") % 17 != 0, F.col("embedding")[1].cast("double")).alias("f2")
    return v.select(F.concat(F.lit("vec_"), F.col("vec_id")).alias("sample"), "label", *cols)


def background(spark: SparkSession, sf_dir: str, d: int = N_DIMS) -> DataFrame:
    return features(spark, sf_dir, d).filter("label = 0").dropna(subset=feature_names(d))


V_FEAT = """
v_feat AS (
  SELECT 'vec_' || vec_id AS sample, label, embedding[1]::DOUBLE AS f1,
         CASE WHEN vec_id % 17 <> 0 THEN embedding[2]::DOUBLE END AS f2,
         embedding[3]::DOUBLE AS f3, embedding[4]::DOUBLE AS f4, embedding[5]::DOUBLE AS f5
  FROM embeddings),
v_bg AS (SELECT * FROM v_feat WHERE label = 0 AND f2 IS NOT NULL)"""


# -- direction rows and dimension table from nations and customers ------------------------------

def direction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (nation, direction) with customers in it: direction from the customer key."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer")
    letter = F.element_at(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")), (F.col("c_custkey") % 3 + 1).cast("int"))
    sums = (c.withColumn("direction", letter).groupBy("c_nationkey", "direction")
            .agg(F.round(F.avg("c_acctbal"), 4).alias("barrier"), F.count(F.lit(1)).alias("n_customers")))
    return (sums.join(n, sums.c_nationkey == n.n_nationkey)
            .select(F.col("n_name").alias("framework"), "direction",
                    F.concat("n_name", F.lit("_"), F.lower("direction")).alias("sample"),
                    "barrier", "n_customers"))


V_DIR = """
v_dir AS (
  SELECT n_name AS framework, direction, n_name || '_' || lower(direction) AS sample, barrier, n_customers
  FROM (SELECT c_nationkey, ['X','Y','Z'][(c_custkey % 3 + 1)::INT] AS direction,
               round(avg(c_acctbal), 4) AS barrier, count(*) AS n_customers
        FROM customer GROUP BY 1, 2) JOIN nation ON c_nationkey = n_nationkey)"""


def pore_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pore results per nation from its suppliers: three directional values, a status, no row for some."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    per = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("m"), F.max("s_suppkey").alias("k"))
    rows = per.join(n, per.s_nationkey == n.n_nationkey)
    def pld(shift):
        return (F.pmod(F.col("k") * 7 + F.col("m") * 3 + shift, F.lit(11)) / 2 + 1.0).alias("v")
    return rows.select(
        F.col("n_name").alias("name"), (F.col("m") * 1.5 + 6).alias("gcd"),
        pld(0).alias("pld_a"), pld(4).alias("pld_b"), pld(9).alias("pld_c"),
        (F.col("n_nationkey") % 6 != 5).alias("ok"))


V_PORES = """
v_pores AS (
  SELECT n_name AS name, m * 1.5::DOUBLE + 6 AS gcd,
         ((k * 7 + m * 3 + 0) % 11) / 2.0::DOUBLE + 1.0 AS pld_a,
         ((k * 7 + m * 3 + 4) % 11) / 2.0::DOUBLE + 1.0 AS pld_b,
         ((k * 7 + m * 3 + 9) % 11) / 2.0::DOUBLE + 1.0 AS pld_c,
         n_nationkey % 6 <> 5 AS ok
  FROM (SELECT s_nationkey, count(*) AS m, max(s_suppkey) AS k FROM supplier GROUP BY 1)
  JOIN nation ON s_nationkey = n_nationkey)"""


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External descriptors: padded upper-case names, names with a direction suffix, and gaps."""
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 7 <> 0")
    r = table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("  "), F.upper("n_name"), F.lit(" "))) \
        .otherwise(F.concat("n_name", F.lit("_x")))
    key = F.col("n_nationkey")
    return j.select(
        name.alias("Zeolites"), (key * 0.5 + 10).alias("FDSi"),
        F.when(key % 5 != 0, key * 1.25).alias("Vacc"), (F.length("r_name") * 100.0 + key).alias("ASA"))


V_DIM = """
v_dim AS (
  SELECT CASE WHEN n_nationkey % 2 = 0 THEN '  ' || upper(n_name) || ' ' ELSE n_name || '_x' END AS Zeolites,
         n_nationkey * 0.5::DOUBLE + 10 AS FDSi,
         CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 1.25::DOUBLE END AS Vacc,
         length(r_name) * 100.0::DOUBLE + n_nationkey AS ASA
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 0)"""


# -- a voxel grid per supplier -----------------------------------------------------------------

SUPPLIER_GRID = (10, 11, 9)


def supplier_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One framework per supplier, so the frameworks grow with the tables, of 10 x 11 x 1 to 9 voxels; and their sizes."""
    depth = (1 + F.col("l_suppkey") % SUPPLIER_GRID[2]).cast("int")
    name = F.concat(F.lit("S"), F.col("l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").select(
        name.alias("framework"), F.floor((F.col("l_quantity") - 1) / 5).cast("int").alias("i"),
        F.round(F.col("l_discount") * 100).cast("int").alias("j"),
        (F.round(F.col("l_tax") * 100).cast("int") % depth).alias("k"), depth.alias("nk"), "l_extendedprice")
    voxels = rows.groupBy("framework", "i", "j", "k").agg(F.round(F.avg("l_extendedprice")).cast("double").alias("e"))
    dims = rows.groupBy("framework").agg(F.max("nk").alias("nk")).select(
        "framework", F.lit(SUPPLIER_GRID[0]).alias("ni"), F.lit(SUPPLIER_GRID[1]).alias("nj"), "nk")
    return voxels, dims


V_SUPPLIER = """
v_grid AS (
  SELECT 'S' || l_suppkey AS framework, CAST(l_quantity - 1 AS INT) // 5 AS i, CAST(round(l_discount * 100) AS INT) AS j,
         CAST(CAST(round(l_tax * 100) AS INT) % (1 + l_suppkey % 9) AS INT) AS k, CAST(round(avg(l_extendedprice)) AS DOUBLE) AS e
  FROM lineitem GROUP BY 1, 2, 3, 4),
sd AS (SELECT DISTINCT 'S' || l_suppkey AS framework, 10 AS ni, 11 AS nj, CAST(1 + l_suppkey % 9 AS INT) AS nk FROM lineitem)"""
