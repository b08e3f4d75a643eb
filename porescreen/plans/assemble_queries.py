"""Queries over direction rows, dimension tables and result tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from porescreen.functions import names
from porescreen.functions.numbers import rounded
from porescreen.operators import assemble as asm
from porescreen.plans.bindings import (
    V_DIM, V_DIR, V_FEAT, V_PORES, dimension, direction_rows, feature_names, features, pore_sizes, table)
from porescreen.plans.registry import query


@query("A3", f"""WITH {V_DIM}
SELECT Zeolites, FDSi, Vacc, ASA, lower(trim(Zeolites)) AS match_key FROM v_dim""")
def external_dimension(spark, sf_dir):
    return dimension(spark, sf_dir).withColumn("match_key", names.match_key("Zeolites"))


@query("R3 C5", f"""WITH {V_PORES}
SELECT name AS framework, direction, PLD FROM (
  SELECT name, unnest(['X','Y','Z']) AS direction, unnest([pld_a, pld_b, pld_c]) AS PLD FROM v_pores WHERE ok)""")
def pore_diameter_rows(spark, sf_dir):
    return asm.pore_rows(pore_sizes(spark, sf_dir))


SQL_MERGED = V_DIR + "," + V_PORES + "," + V_DIM + """,
pld AS (SELECT name AS framework, unnest(['X','Y','Z']) AS direction, unnest([pld_a, pld_b, pld_c]) AS PLD
        FROM v_pores WHERE ok),
merged AS (SELECT v_dir.*, PLD FROM v_dir LEFT JOIN pld USING (framework, direction)),
kept AS (SELECT * FROM merged WHERE PLD IS NULL OR PLD >= 3.5),
keyed AS (SELECT lower(trim(Zeolites)) AS mk, FDSi, Vacc, ASA FROM v_dim),
looked AS (
  SELECT k.*, coalesce(a.FDSi, b.FDSi) AS FDSi, coalesce(a.Vacc, b.Vacc) AS Vacc, coalesce(a.ASA, b.ASA) AS ASA
  FROM kept k LEFT JOIN keyed a ON lower(trim(k.framework)) = a.mk LEFT JOIN keyed b ON lower(trim(k.sample)) = b.mk)"""


@query("J1", f"""WITH {SQL_MERGED}
SELECT framework, direction, sample, barrier, n_customers, PLD FROM merged""")
def directions_with_pore_diameter(spark, sf_dir):
    return direction_rows(spark, sf_dir).join(
        asm.pore_rows(pore_sizes(spark, sf_dir)), ["framework", "direction"], "left")


def _kept(spark, sf_dir):
    return asm.exclude_narrow(directions_with_pore_diameter(spark, sf_dir))


@query("C3", f"""WITH {SQL_MERGED}
SELECT framework, direction, sample, barrier, n_customers, PLD FROM kept""")
def directions_wide_enough(spark, sf_dir):
    return _kept(spark, sf_dir)


@query("J2", f"""WITH {SQL_MERGED}
SELECT framework, direction, sample, barrier, n_customers, PLD, FDSi, Vacc, ASA FROM looked""")
def external_lookup(spark, sf_dir):
    return asm.lookup_external(_kept(spark, sf_dir), dimension(spark, sf_dir))


@query("C6 J1 J2 C3", f"""WITH {SQL_MERGED}
SELECT sample, framework, direction, barrier, CAST(NULL AS DOUBLE) AS H_entropy, PLD, FDSi, Vacc, ASA FROM looked""")
def assembled_features(spark, sf_dir):
    return asm.feature_table(direction_rows(spark, sf_dir), pore_sizes(spark, sf_dir), dimension(spark, sf_dir),
                             ["barrier", "H_entropy", "PLD", "FDSi", "Vacc", "ASA"])


@query("C8", f"""WITH {SQL_MERGED}, gaps AS (
  SELECT unnest(['FDSi','Vacc','ASA']) AS "column", framework, unnest([FDSi, Vacc, ASA]) AS v FROM looked)
SELECT "column", count(*) FILTER (v IS NULL) AS n_missing,
       array_to_string(list_sort(list(DISTINCT framework) FILTER (v IS NULL))[1:10], ',') AS names
FROM gaps GROUP BY 1""")
def missing_value_audit(spark, sf_dir):
    return asm.audit_missing(external_lookup(spark, sf_dir), ["FDSi", "Vacc", "ASA"])


# Barriers per (framework, axis): customers of a nation by key, with some directions blocked.
def _axis_results(spark, sf_dir):
    d = direction_rows(spark, sf_dir)
    open_way = F.col("n_customers") % 5 != 0
    return d.select(
        "framework", F.col("direction").alias("axis"),
        F.when(open_way, F.round(F.abs("barrier") / 100, 4)).alias("barrier"),
        F.when(open_way, F.round(F.abs("barrier") / 100 - F.col("n_customers"), 4)).alias("transition_energy"),
        F.col("n_customers").cast("double").alias("length"))


SQL_AXIS = V_DIR + """,
ax AS (
  SELECT framework, direction AS axis,
         CASE WHEN n_customers % 5 <> 0 THEN round(abs(barrier) / 100, 4) END AS barrier,
         CASE WHEN n_customers % 5 <> 0 THEN round(abs(barrier) / 100 - n_customers, 4) END AS transition_energy,
         n_customers::DOUBLE AS length FROM v_dir)"""

_WIDE_SQL = ", ".join(
    f"coalesce(bool_or(barrier IS NOT NULL) FILTER (axis = '{a}'), false) AS {a}_traverses, "
    f"max(barrier) FILTER (axis = '{a}') AS {a}_barrier, max(length) FILTER (axis = '{a}') AS {a}_length, "
    f"round(max(transition_energy - barrier) FILTER (axis = '{a}'), 4) AS {a}_E_min_official" for a in "XYZ")


@query("R2", f"WITH {SQL_AXIS} SELECT framework, {_WIDE_SQL} FROM ax GROUP BY framework")
def axes_to_wide(spark, sf_dir):
    wide = asm.wide_axes(_axis_results(spark, sf_dir), ["barrier", "length"])
    return wide.withColumns({f"{a}_E_min_official": F.round(f"{a}_E_min_official", 4) for a in "XYZ"})


@query("R1 F11", f"""WITH {SQL_AXIS}
SELECT framework, axis AS direction, barrier, length, round(transition_energy - barrier, 4) AS E_min_official,
       framework || '_' || lower(axis) AS sample FROM ax WHERE barrier IS NOT NULL""")
def wide_to_directions(spark, sf_dir):
    return asm.direction_rows(axes_to_wide(spark, sf_dir), ["barrier", "length", "E_min_official"])


@query("B7", f"""WITH {SQL_AXIS}
SELECT s_nation AS framework, CASE WHEN count(ax.framework) > 0 THEN 'OK' ELSE 'FAILED' END AS status,
       max(round(barrier, 4)) FILTER (axis = 'X') AS barrier_X, max(round(barrier, 4)) FILTER (axis = 'Y') AS barrier_Y,
       max(round(barrier, 4)) FILTER (axis = 'Z') AS barrier_Z
FROM (SELECT n_name AS s_nation FROM nation) LEFT JOIN (SELECT * FROM ax WHERE barrier > 20) ax ON framework = s_nation
GROUP BY 1""")
def run_status(spark, sf_dir):
    inputs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("framework"))
    return asm.run_summary(inputs, _axis_results(spark, sf_dir).filter("barrier > 20"))


@query("G17 B7", f"""WITH {SQL_AXIS}, done AS (SELECT DISTINCT framework FROM ax WHERE barrier > 20)
SELECT (SELECT count(*) FROM done) AS n_ok, (SELECT count(*) FROM nation) - (SELECT count(*) FROM done) AS n_failed""")
def run_status_counts(spark, sf_dir):
    return asm.status_counts(run_status(spark, sf_dir))


@query("C4", f"""WITH {V_FEAT}, txt AS (
  SELECT sample, f1, CASE WHEN label = 3 THEN 'n/a' ELSE f2::VARCHAR END AS f2, f3 FROM v_feat)
SELECT sample, f1, TRY_CAST(f2 AS DOUBLE) AS f2, f3,
       f1 IS NOT NULL AND TRY_CAST(f2 AS DOUBLE) IS NOT NULL AND f3 IS NOT NULL AS complete FROM txt""")
def complete_feature_rows(spark, sf_dir):
    rows = features(spark, sf_dir).withColumn(
        "f2", F.when(F.col("label") == 3, F.lit("n/a")).otherwise(F.col("f2").cast("string")))
    return asm.complete_cases(rows.select("sample", "f1", "f2", "f3"), ["f1", "f2", "f3"])


# Part names in many spellings: a spelling from the alias list by part key, padded and upper-cased by size.
SPELLINGS = [s for d in names.DESCRIPTORS for s in d[:4]] + [s for v in names.OLDER_SPELLINGS.values() for s in v]
_SPELL_SQL = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SPELLINGS) + "]"
# Both lists as they are; which spelling wins is stated in SQL: a current one (the last of them), else the first older one.
_CURRENT = [(s, d[0]) for d in names.DESCRIPTORS for s in d[:4]]
_OLDER = [(s, k) for k, v in names.OLDER_SPELLINGS.items() for s in v]
_ALIAS_SQL = ", ".join(f"('{s.replace(chr(39), chr(39) * 2)}', '{k}', {kind}, {pos})"
                       for kind, spelled in enumerate((_CURRENT, _OLDER)) for pos, (s, k) in enumerate(spelled))
_NOMEN_SQL = ", ".join(
    "(" + ", ".join([str(i + 1)] + ["'" + v + "'" for v in d[:6]]) + ")" for i, d in enumerate(names.DESCRIPTORS))
V_NAMES = f"""
spelled AS (
  SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN '  ' || upper(s) || ' ' ELSE s END AS name
  FROM (SELECT p_partkey, p_name, {_SPELL_SQL}[(p_partkey % {len(SPELLINGS)} + 1)::INT] AS s FROM part)),
spellings(spelling, skey, older, pos) AS (VALUES {_ALIAS_SQL}),
alias AS (SELECT lower(spelling) AS alias, arg_min(skey, CASE older WHEN 0 THEN -pos ELSE 100000 + pos END) AS akey
          FROM spellings GROUP BY 1),
resolved AS (
  SELECT p_partkey, name, coalesce(akey, name) AS key FROM spelled LEFT JOIN alias ON lower(trim(name)) = alias),
nomen(ord, nkey, symbol, ascii, long_name, unit, family) AS (VALUES {_NOMEN_SQL})"""


def _spelled(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    pick = F.element_at(F.array(*[F.lit(s) for s in SPELLINGS]), (F.col("p_partkey") % len(SPELLINGS) + 1).cast("int"))
    turn = F.col("p_partkey") % 7
    return part.select("p_partkey", F.when(turn == 0, F.col("p_name"))
                       .when(turn == 1, F.concat(F.lit("  "), F.upper(pick), F.lit(" "))).otherwise(pick).alias("name"))


@query("J12", f"WITH {V_NAMES} SELECT p_partkey, name, key FROM resolved")
def resolved_names(spark, sf_dir):
    return names.resolve_names(_spelled(spark, sf_dir), "name")


@query("F13", f"""WITH {V_NAMES}
SELECT p_partkey, key, coalesce(symbol, key) AS symbol, coalesce(ascii, key) AS ascii,
       coalesce(symbol || CASE WHEN unit = '' THEN '' ELSE ' (' || unit || ')' END, key) AS symbol_with_unit
FROM resolved LEFT JOIN nomen ON key = nkey""")
def name_labels(spark, sf_dir):
    return names.label_names(resolved_names(spark, sf_dir).select("p_partkey", "key"), "key")


@query("B4", f"""WITH {V_NAMES}
SELECT ord, nkey AS key, symbol, ascii, long_name AS name, coalesce(nullif(unit, ''), 'dimensionless') AS unit, family,
       (SELECT count(*) FROM resolved WHERE resolved.key = nkey) AS n_used FROM nomen""")
def nomenclature_usage(spark, sf_dir):
    used = resolved_names(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    table_ = names.nomenclature(spark).drop("definition")
    return table_.join(used, "key", "left").withColumn("n_used", F.coalesce("n", F.lit(0))).drop("n")


@query("B1 S1", f"""WITH {SQL_MERGED}
SELECT sample, framework, direction, PLD, FDSi, Vacc, ASA, barrier AS "Ebarrier (kJ mol⁻¹)"
FROM looked ORDER BY framework, direction""")
def descriptor_display(spark, sf_dir):
    rows = external_lookup(spark, sf_dir).select(
        "sample", "framework", "direction", "PLD", "FDSi", "Vacc", "ASA", F.col("barrier").alias("barrier_official"))
    label = names.symbol_columns(rows.select("barrier_official"), with_unit=True).columns[0]
    return rows.withColumnRenamed("barrier_official", label).orderBy("framework", "direction")


@query("S2", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def first_hundred(spark, sf_dir):
    return (table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
            .orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100))


@query("S4", """SELECT c_name, c_acctbal FROM customer ORDER BY md5(c_name || '|0'), c_name LIMIT 200""")
def seeded_subsample(spark, sf_dir):
    return asm.seeded_sample(table(spark, sf_dir, "customer").select("c_name", "c_acctbal"), "c_name", 200)


@query("S6 J4", f"""WITH {V_FEAT}, contrib AS (
  SELECT sample, label, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, sample) AS rn FROM v_feat)
SELECT contrib.label, contrib.sample, f1, f2 FROM contrib JOIN v_feat USING (sample) WHERE rn = 1""")
def first_match_per_label(spark, sf_dir):
    feats = features(spark, sf_dir)
    rows = feats.select("label", "sample", (-F.col("f1")).alias("_neg"))
    best = asm.first_match(rows, ["label"], ["_neg", "sample"]).drop("_neg")
    return best.join(feats.select("sample", "f1", "f2"), "sample", "left")


@query("U1", """SELECT lower(p_brand) || '_' || p_size || '.cif' AS file FROM part WHERE p_partkey % 2 = 0
UNION SELECT lower(p_brand) || '_' || p_size || '.cif' FROM part WHERE p_size > 10 ORDER BY 1""")
def merged_file_lists(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    file = F.concat(F.lower("p_brand"), F.lit("_"), F.col("p_size"), F.lit(".cif")).alias("file")
    return part.filter("p_partkey % 2 = 0").select(file).union(part.filter("p_size > 10").select(file)).distinct().orderBy("file")


@query("U3", f"""WITH {V_DIR} SELECT n_name AS framework, direction FROM nation, (VALUES ('X'), ('Y'), ('Z')) d(direction)
EXCEPT SELECT framework, direction FROM v_dir WHERE n_customers >= 20""")
def required_minus_present(spark, sf_dir):
    required = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("framework"), F.explode(F.array(*[F.lit(a) for a in "XYZ"])).alias("direction"))
    present = direction_rows(spark, sf_dir).filter("n_customers >= 20").select("framework", "direction")
    return required.subtract(present)
