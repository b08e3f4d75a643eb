"""Queries that score feature rows and explain the scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from porescreen.functions import names
from porescreen.functions.numbers import rounded
from porescreen.operators import assemble as asm, attribute as att, score
from porescreen.plans.bindings import N_DIMS, V_FEAT, background, feature_names, features, table
from porescreen.plans.registry import query
from porescreen.sources.tables import background_rows

FEATURES = feature_names()
LAYERS = ((8, N_DIMS), (8, 8), (4, 8), (1, 4))
SCALER = {f: ((i - 2) / 50, 0.1 + i / 100) for i, f in enumerate(FEATURES)}


def model_tables(spark):
    """Weights, biases and running statistics of the small test network, from a rule."""
    weights = [(l, o, i, ((7 * o + 3 * i + l) % 11 - 5) / 20)
               for l, (n_out, n_in) in enumerate(LAYERS) for o in range(n_out) for i in range(n_in)]
    bias = [(l, o, ((o + l) % 5 - 2) / 10, *((1 + o / 10, o / 20, o / 30, 1 + o / 5) if l < 3 else (None,) * 4))
            for l, (n_out, _) in enumerate(LAYERS) for o in range(n_out)]
    return (spark.createDataFrame(weights, "layer int, out int, in int, w double"),
            spark.createDataFrame(bias, "layer int, out int, b double, gamma double, beta double, mean double, var double"))


def network(spark):
    return score.load_network(*model_tables(spark))


def _layer_sql(layer: int, n_out: int, n_in: int, source: str, target: str, extra: str) -> str:
    dot = (f"list_sum(list_transform(range(0, {n_in}), lambda i: ((7 * o + 3 * i + {layer}) % 11 - 5) / 20::DOUBLE * x[i + 1]))"
           f" + ((o + {layer}) % 5 - 2) / 10::DOUBLE")
    if layer < 3:
        dot = (f"greatest(0::DOUBLE, ({dot} - o / 30::DOUBLE) / sqrt(1 + o / 5::DOUBLE + 0.00001::DOUBLE)"
               f" * (1 + o / 10::DOUBLE) + o / 20::DOUBLE)")
    return f"{target} AS (SELECT {extra}, list_transform(range(0, {n_out}), lambda o: {dot}) AS x FROM {source})"


def forward_sql(source: str, extra: str, out: str) -> str:
    """CTEs that run the network over ``source(extra, x)``; the last one is ``out(extra, y)``."""
    steps, src = [], source
    for l, (n_out, n_in) in enumerate(LAYERS):
        steps.append(_layer_sql(l, n_out, n_in, src, f"{out}_{l}", extra))
        src = f"{out}_{l}"
    return ", ".join(steps) + f", {out} AS (SELECT {extra}, x[1] AS y FROM {src})"


_SCALED = "[" + ", ".join(f"(f{i + 1} - ({i} - 2) / 50::DOUBLE) / (0.1::DOUBLE + {i} / 100::DOUBLE)" for i in range(N_DIMS)) + "]"
SQL_SCALED = V_FEAT + f""",
ready AS (SELECT sample, {_SCALED} AS x FROM v_feat WHERE f2 IS NOT NULL),
bg AS (SELECT {_SCALED} AS x, sample FROM v_bg),
{forward_sql('ready', 'sample', 'fwd')}"""


@query("A4", f"""WITH {V_FEAT}, txt AS (
  SELECT sample, f1::VARCHAR AS f1, CASE WHEN label = 4 THEN 'n/a' ELSE f2::VARCHAR END AS f2, f3 FROM v_feat)
SELECT round((TRY_CAST(f1 AS DOUBLE) + 0.04::DOUBLE) / 0.1::DOUBLE, 6) + 0.0 AS E_max,
       round((TRY_CAST(f2 AS DOUBLE) + 0.02::DOUBLE) / 0.11::DOUBLE, 6) + 0.0 AS tortuosity,
       round(f3 / 0.12::DOUBLE, 6) + 0.0 AS PLD
FROM txt WHERE TRY_CAST(f2 AS DOUBLE) IS NOT NULL""")
def scaled_background(spark, sf_dir):
    raw = features(spark, sf_dir).select(
        "sample", F.col("f1").cast("string").alias("Emax"),
        F.when(F.col("label") == 4, F.lit("n/a")).otherwise(F.col("f2").cast("string")).alias("Pτ"),
        F.col("f3").alias("PLD1"))
    wanted = ["E_max", "tortuosity", "PLD"]
    scaled = score.scale_features(background_rows(raw, wanted), {"E_max": (-0.04, 0.1), "tortuosity": (-0.02, 0.11), "PLD": (0.0, 0.12)})
    return scaled.select(*[rounded(c).alias(c) for c in wanted])


@query("A9", """WITH w AS (
  SELECT label AS layer, vec_id AS out, unnest(range(0, len(embedding)))::INT AS "in" FROM embeddings),
kept AS (SELECT * FROM w WHERE (out * 64 + "in") % 997 <> 0)
SELECT layer, out, "in", 'missing' AS problem FROM (SELECT * FROM w EXCEPT SELECT * FROM kept)
UNION ALL SELECT label, vec_id, len(embedding)::INT, 'unexpected' FROM embeddings WHERE vec_id % 97 = 5""")
def weight_table_gaps(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    weights = v.select(F.col("label").alias("layer"), F.col("vec_id").alias("out"), F.posexplode("embedding").alias("in", "w"))
    widths = v.select(F.col("label").alias("layer"), F.col("vec_id").alias("out"), F.size("embedding").alias("n_in"))
    extra = v.filter("vec_id % 97 = 5").select(
        F.col("label").alias("layer"), F.col("vec_id").alias("out"), F.size("embedding").alias("in"), F.lit(0.0).cast("float").alias("w"))
    return score.parameter_gaps(weights.filter((F.col("out") * 64 + F.col("in")) % 997 != 0).unionByName(extra), widths)


@query("M3", f"""WITH {V_FEAT}
SELECT sample, round(greatest(f1, 0), 6) + 0.0 AS relu, round(CASE WHEN f1 >= 0 THEN f1 ELSE 0.01 * f1 END, 6) + 0.0 AS leaky_relu,
       round((exp(2 * f1) - 1) / (exp(2 * f1) + 1), 6) + 0.0 AS tanh,
       round(CASE WHEN f1 > 0 THEN f1 ELSE exp(f1) - 1 END, 6) + 0.0 AS elu, round(greatest(f1, 0), 6) + 0.0 AS unknown,
       round(0.5::DOUBLE * f1 * (1 + 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n:
         pow(-1::DOUBLE, n) * pow(f1 / sqrt(2::DOUBLE), 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))), 6) + 0.0 AS gelu FROM v_feat""")
def activations(spark, sf_dir):
    rows = features(spark, sf_dir)
    return rows.select("sample", *[rounded(score.activation(F.col("f1"), a)).alias(a)
                                   for a in ("relu", "leaky_relu", "tanh", "elu", "unknown", "gelu")])


@query("M1", f"""WITH {V_FEAT}
SELECT sample, """ + ", ".join(
    f"round((f{i + 1} - ({i} - 2) / 50::DOUBLE) / (0.1::DOUBLE + {i} / 100::DOUBLE), 6) + 0.0 AS f{i + 1}" for i in range(N_DIMS))
    + " FROM v_feat")
def scaled_features(spark, sf_dir):
    rows = score.scale_features(features(spark, sf_dir), SCALER)
    return rows.select("sample", *[rounded(f).alias(f) for f in FEATURES])


SQL_PREDICTED = f"""WITH {SQL_SCALED}
SELECT sample, y IS NOT NULL AS pred_ok, round(y, 6) + 0.0 AS ln_Ds_pred, round({{power}}, 6) AS Ds_pred
FROM v_feat LEFT JOIN fwd USING (sample)"""


@query("M2 M4 F10", SQL_PREDICTED.format(power="exp(y)"))
def predictions(spark, sf_dir):
    out = score.predict(features(spark, sf_dir), FEATURES, SCALER, network(spark))
    return out.select("sample", "pred_ok", rounded("ln_Ds_pred").alias("ln_Ds_pred"), rounded("Ds_pred").alias("Ds_pred"))


@query("F10 M4", SQL_PREDICTED.format(power="pow(10::DOUBLE, y) * 2.5::DOUBLE"))
def predictions_base_ten(spark, sf_dir):
    out = score.predict(features(spark, sf_dir), FEATURES, SCALER, network(spark), log_base=10.0, scale=2.5)
    return out.select("sample", "pred_ok", rounded("ln_Ds_pred").alias("ln_Ds_pred"), rounded("Ds_pred").alias("Ds_pred"))


@query("B2", f"""WITH {SQL_SCALED}
SELECT sample, round(exp(y), 6) AS "Ds_pred (10⁻⁹ m² s⁻¹)" FROM fwd""")
def diffusivity(spark, sf_dir):
    unit = "10⁻⁹ m² s⁻¹"
    out = score.diffusivity_table(
        score.predict(features(spark, sf_dir), FEATURES, SCALER, network(spark)), ["sample"], unit)
    return out.withColumn(f"Ds_pred ({unit})", rounded(F.col(f"Ds_pred ({unit})")))


def _ready(spark, sf_dir):
    rows = asm.complete_cases(features(spark, sf_dir), FEATURES).filter("complete")
    return score.scale_features(rows, SCALER).select("sample", "label", *FEATURES)


def _background(spark, sf_dir):
    return score.scale_features(background(spark, sf_dir), SCALER).select("sample", *FEATURES)


@query("G15", f"""WITH {SQL_SCALED}, {forward_sql('bg', 'sample', 'bgf')} SELECT round(avg(y), 6) AS base_value FROM bgf""")
def background_base(spark, sf_dir):
    y = score.network_output([F.col(f) for f in FEATURES], network(spark))
    return _background(spark, sf_dir).select(y.alias("y")).agg(rounded(F.avg("y")).alias("base_value"))


#: Rows that stand for the background in these queries, so that their tables are sampled; the operator's default is larger.
DRAWN = {"most": 24, "bins": 8, "key": "sample"}
DRAWN_BATCH = {"most": 64, "bins": 16, "key": "sample"}
_DF = math.factorial(N_DIMS)


def sample_sql(rows: str, scored: str, most: int, bins: int, key: str) -> str:
    """CTEs that draw the weighted sample ``drawn`` from ``rows`` (sample, x) with the scores ``scored`` (sample, y)."""
    return f"""
told AS (SELECT r.sample, r.x, s.y, md5(r.{key} || '|0') AS o FROM {rows} r JOIN {scored} s USING (sample)),
lim AS (SELECT min(y) AS lo, max(y) AS hi, count(*) AS n, avg(y) AS base_value FROM told),
binned AS (SELECT told.*, least(floor((y - lo) / (hi - lo) * {bins}), {bins - 1})::INT AS bin, n FROM told, lim),
parts AS (SELECT bin, greatest(1, count(*) * {most} // any_value(n)) AS k FROM binned GROUP BY bin),
picked AS (SELECT bin, ('0x' || substr(o, 1, 8))::BIGINT % k AS part, count(*)::DOUBLE AS c, arg_min({{'x': x, 'y': y}}, o) AS r
           FROM binned JOIN parts USING (bin) GROUP BY ALL),
moments AS (SELECT sum(c * r.y) / sum(c) AS m, sum(c * r.y * r.y) / sum(c) AS q FROM picked),
drawn AS (SELECT bin, part, r.x AS x, CASE WHEN n <= {most} THEN 1.0 ELSE c * (1 + (base_value - m) / (q - m * m) * (r.y - m)) END AS w
          FROM picked, moments, lim)"""


SQL_SHAP = SQL_SCALED + f""",
{forward_sql('bg', 'sample', 'bgf')}, {sample_sql('bg', 'bgf', **DRAWN)},
mixed AS (
  SELECT r.sample AS sample, m.mask AS mask, b.w AS w,
         [CASE WHEN (m.mask >> (p - 1)) & 1 = 1 THEN r.x[p] ELSE b.x[p] END for p in range(1, {N_DIMS + 1})] AS x
  FROM ready r, range(0, {1 << N_DIMS}) m(mask), drawn b),
{forward_sql('mixed', 'sample, mask, w', 'mx')},
v AS (SELECT sample, mask, sum(w * y) / sum(w) AS v, bit_count(mask::INT) AS s FROM mx GROUP BY ALL),
phi AS (
  SELECT a.sample AS sample, f.p AS p,
         sum((b.v - a.v) * factorial(a.s::INT)::DOUBLE * factorial(({N_DIMS - 1} - a.s)::INT)::DOUBLE / {_DF}) AS phi
  FROM range(0, {N_DIMS}) f(p) JOIN v a ON (a.mask >> f.p) & 1 = 0
  JOIN v b ON b.sample = a.sample AND b.mask = a.mask + (1 << f.p) GROUP BY ALL),
base AS (SELECT base_value FROM lim)"""


@query("M5 J13 U4", f"""WITH {SQL_SHAP}
SELECT sample, 'f' || (p + 1) AS feature, round(phi, 6) + 0.0 AS phi, round(base_value, 6) AS base_value FROM phi, base""")
def shapley_rows(spark, sf_dir):
    matrix = att.shapley_values(_ready(spark, sf_dir), _background(spark, sf_dir), "sample", FEATURES, network(spark), **DRAWN)
    rows = att.attribution_rows(matrix, "sample", FEATURES)
    return rows.select("sample", "feature", rounded("phi").alias("phi"), rounded("base_value").alias("base_value"))


# Precomputed attributions: names with other case and blanks, repeated; the last row wins.
def _known_table(spark, sf_dir):
    v = features(spark, sf_dir)
    number = F.regexp_extract("sample", r"(\d+)", 1).cast("long")
    return v.select(
        number.alias("pos"), F.concat(F.lit("  VEC_"), number - number % 3, F.lit(" ")).alias("Zeolites"),
        (F.col("f1") * 2).alias("Expected_Value"), *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in FEATURES])


SQL_KNOWN = """
nums AS (SELECT *, replace(sample, 'vec_', '')::BIGINT AS num FROM v_feat),
knownall AS (SELECT num, 'vec_' || (num - num % 3) AS match_key, f1 * 2 AS base_value, f1, coalesce(f2, 0) AS f2, f3, f4, f5 FROM nums),
known AS (SELECT * EXCLUDE (num) FROM (SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY num DESC) AS rn FROM knownall) WHERE rn = 1)"""


@query("A5", f"""WITH {V_FEAT}, {SQL_KNOWN}
SELECT match_key, round(base_value, 6) + 0.0 AS base_value, """ + ", ".join(f"round(f{i}, 6) + 0.0 AS f{i}" for i in range(1, 6)) + " FROM known")
def precomputed_attributions(spark, sf_dir):
    rows = att.known_attributions(_known_table(spark, sf_dir), FEATURES, "pos")
    return rows.select("match_key", *[rounded(c).alias(c) for c in ("base_value", *FEATURES)])


@query("J3", f"""WITH {V_FEAT}, {SQL_KNOWN}
SELECT sample, lower(trim(sample)) IN (SELECT match_key FROM known) AS hit FROM v_feat""")
def attribution_hits(spark, sf_dir):
    known = att.known_attributions(_known_table(spark, sf_dir), FEATURES, "pos").select("match_key", F.lit(True).alias("_hit"))
    rows = features(spark, sf_dir).select("sample", names.match_key("sample").alias("match_key"))
    return rows.join(known, "match_key", "left").select("sample", F.coalesce("_hit", F.lit(False)).alias("hit"))


_WIDE_PHI = ", ".join(f"max(phi) FILTER (p = {i}) AS f{i + 1}" for i in range(N_DIMS))
SQL_HYBRID = SQL_SHAP + "," + SQL_KNOWN + f""",
computed AS (SELECT sample, any_value(base_value) AS base_value, {_WIDE_PHI} FROM phi, base GROUP BY sample),
hybrid AS (
  SELECT r.sample, k.base_value, k.f1, k.f2, k.f3, k.f4, k.f5, 'known' AS source
  FROM ready r JOIN known k ON k.match_key = r.sample
  UNION ALL SELECT *, 'computed' FROM computed WHERE sample NOT IN (SELECT match_key FROM known))"""


@query("M6 J3 U4 R4", f"""WITH {SQL_HYBRID}
SELECT sample, source, round(base_value, 6) + 0.0 AS base_value, """ + ", ".join(
    f"round(f{i}, 6) + 0.0 AS f{i}" for i in range(1, 6)) + " FROM hybrid")
def hybrid_attribution_matrix(spark, sf_dir):
    known = att.known_attributions(_known_table(spark, sf_dir), FEATURES, "pos")
    rows = att.hybrid_attributions(_ready(spark, sf_dir), known, _background(spark, sf_dir), "sample", FEATURES, network(spark), **DRAWN)
    return rows.select("sample", "source", *[rounded(c).alias(c) for c in ("base_value", *FEATURES)])


def _original(spark, sf_dir):
    matrix = att.shapley_values(_ready(spark, sf_dir), _background(spark, sf_dir), "sample", FEATURES, network(spark), **DRAWN)
    return att.original_scale(matrix, "sample", FEATURES)


SQL_ORIGINAL = SQL_SHAP + """,
sums AS (SELECT sample, sum(phi) AS total FROM phi GROUP BY 1),
orig AS (
  SELECT sample, p, exp(base_value + total) AS orig_pred, exp(base_value) AS orig_base,
         CASE WHEN total = 0 THEN 0 ELSE phi / total * (exp(base_value + total) - exp(base_value)) END AS contribution
  FROM phi JOIN sums USING (sample), base)"""


@query("M7 M8 B3", f"""WITH {SQL_ORIGINAL}
SELECT sample, round(any_value(orig_pred), 6) AS orig_pred, round(any_value(orig_base), 6) AS orig_base, """ + ", ".join(
    f"round(max(contribution) FILTER (p = {i}), 6) + 0.0 AS f{i + 1}" for i in range(N_DIMS)) + " FROM orig GROUP BY sample")
def original_scale_attributions(spark, sf_dir):
    out = _original(spark, sf_dir)
    return out.select("sample", *[rounded(c).alias(c) for c in ("orig_pred", "orig_base", *FEATURES)])


@query("W14", f"""WITH {SQL_ORIGINAL}, ranked AS (
  SELECT sample, p, contribution, orig_base, row_number() OVER w AS step, sum(contribution) OVER w AS run
  FROM orig WINDOW w AS (PARTITION BY sample ORDER BY abs(contribution), p DESC ROWS UNBOUNDED PRECEDING))
SELECT sample, 'f' || (p + 1) AS feature, step::INT AS step, round(contribution, 6) + 0.0 AS contribution,
       round(orig_base + run - contribution, 6) + 0.0 AS start_value, round(orig_base + run, 6) + 0.0 AS end_value FROM ranked""")
def waterfall(spark, sf_dir):
    rows = att.waterfall_rows(_original(spark, sf_dir), "sample", FEATURES)
    return rows.select("sample", "feature", "step", *[rounded(c).alias(c) for c in ("contribution", "start_value", "end_value")])


@query("S3", f"""WITH {V_FEAT}, cells AS (
  SELECT sample, unnest(['f1','f2','f3','f4','f5']) AS feature, unnest(range(0, 5)) AS p, unnest([f1, f2, f3, f4, f5]) AS contribution
  FROM v_feat WHERE f2 IS NOT NULL)
SELECT sample, feature, round(contribution, 6) + 0.0 AS contribution,
       row_number() OVER (PARTITION BY sample ORDER BY abs(contribution) DESC, p)::INT AS rank FROM cells""")
def contributions_by_magnitude(spark, sf_dir):
    rows = features(spark, sf_dir).dropna(subset=FEATURES)
    return att.ranked_contributions(rows, "sample", FEATURES).select(
        "sample", "feature", rounded("contribution").alias("contribution"), "rank")


@query("M9 G16", f"""WITH {SQL_SCALED}, {sample_sql('ready', 'fwd', **DRAWN_BATCH)}
SELECT bin, part::VARCHAR AS part, round(w, 6) AS weight, """ + ", ".join(f"round(x[{i}], 6) + 0.0 AS f{i}" for i in range(1, N_DIMS + 1)) + " FROM drawn")
def batch_background(spark, sf_dir):
    rows = att.choose_background(_ready(spark, sf_dir), None, FEATURES)
    drawn, _ = att.background_sample(rows, FEATURES, network(spark), **DRAWN_BATCH)
    return drawn.select("bin", "part", rounded("weight").alias("weight"), *[rounded(f).alias(f) for f in FEATURES])


@query("G15 M9", f"""WITH {SQL_SCALED}, {sample_sql('ready', 'fwd', **DRAWN_BATCH)}
SELECT count(*) AS n_drawn, round((SELECT base_value FROM lim), 6) AS base_value, round(any_value(base_value), 6) AS sampled_base
FROM drawn, lim""")
def batch_base(spark, sf_dir):
    """The base value of all rows, and the mean score of the weighted sample, which the tilted weights make equal to it."""
    model = network(spark)
    drawn, base = att.background_sample(_ready(spark, sf_dir), FEATURES, model, **DRAWN_BATCH)
    y = score.network_output([F.col(f) for f in FEATURES], model)
    return drawn.select("weight", y.alias("y")).agg(
        F.count("*").alias("n_drawn"), rounded(F.lit(base)).alias("base_value"),
        rounded(F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).alias("sampled_base"))


@query("M8", f"""WITH {V_FEAT}, named AS (
  SELECT CASE WHEN num % 5 = 0 THEN 'sample_' || num ELSE sample END AS sample, f1 / 4 AS base, f1, f3, f4,
         CASE WHEN num % 7 = 0 THEN 0 ELSE f1 + f3 + f4 END AS total, CASE WHEN num % 7 = 0 THEN 0 ELSE 1 END AS k
  FROM (SELECT *, replace(sample, 'vec_', '')::BIGINT AS num FROM v_feat))
SELECT sample, round(exp(base + total), 6) AS orig_pred, round(exp(base), 6) AS orig_base, """ + ", ".join(
    f"round(CASE WHEN total = 0 THEN 0 ELSE {f} / total * (exp(base + total) - exp(base)) END, 6) + 0.0 AS {f}" for f in ("f1", "f3", "f4"))
    + " FROM named")
def unnamed_attributions(spark, sf_dir):
    """Rows without a name are called by their place; rows whose contributions cancel stay zero."""
    number = F.regexp_extract("sample", r"(\d+)", 1).cast("long")
    used = ["f1", "f3", "f4"]
    matrix = features(spark, sf_dir).select(
        F.when(number % 5 != 0, F.col("sample")).alias("sample"), number.alias("pos"), (F.col("f1") / 4).alias("base_value"),
        *[F.when(number % 7 != 0, F.col(f)).otherwise(0.0).alias(f) for f in used])
    out = att.original_scale(matrix, "sample", used)
    return out.select("sample", *[rounded(c).alias(c) for c in ("orig_pred", "orig_base", *used)])
