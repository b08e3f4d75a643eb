"""One query per operator, with production parameters on its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from porescreen.llm import bpe, decontaminate, html, langid, licenses, lines, manifest, repeats, simhash, topk, toxicity, trie, wordpiece
from porescreen.llm.common import table


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


OP3_SQL = r"""
WITH i AS (
    SELECT item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark)
    WHERE item_id IS NOT NULL AND len(w) >= 5),
ig AS (SELECT item_id, n, x AS q, array_to_string(w[x + 1 : x + 5], ' ') AS g FROM (SELECT *, unnest(range(n - 4)) AS x FROM i)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
dg AS (SELECT doc_id, x AS pos, array_to_string(w[x + 1 : x + 5], ' ') AS g FROM (
    SELECT *, unnest(range(greatest(len(w) - 4, 0))) AS x FROM d)),
c AS (SELECT DISTINCT doc_id, item_id, n, pos - q AS start FROM dg JOIN ig USING (g)),
a AS (SELECT c.doc_id, item_id, n, start, g, count(*) AS k FROM c JOIN dg
      ON dg.doc_id = c.doc_id AND pos >= greatest(start, 0) AND pos <= start + n - 5 GROUP BY ALL),
b AS (SELECT item_id, g, count(*) AS k FROM ig GROUP BY ALL),
s AS (SELECT a.doc_id, a.item_id, a.n, a.start, CAST(sum(least(a.k, coalesce(b.k, 0))) AS BIGINT) AS shared, CAST(sum(a.k) AS BIGINT) AS size
      FROM a LEFT JOIN b ON a.item_id = b.item_id AND a.g = b.g GROUP BY ALL),
j AS (SELECT *, shared / CAST(size + n - 4 - shared AS DOUBLE) AS similarity FROM s)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start_word, CAST(n AS BIGINT) AS n_words, similarity FROM j WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.scan(table(spark, folder, "documents"))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(table(spark, folder, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
p AS (SELECT doc_id, h, octet_length(h) AS n, unnest(range(octet_length(h))) AS pos FROM d),
w AS (SELECT doc_id, pos, hex(h[pos + 1 : pos + 1]) AS b, CASE WHEN pos + 50 <= n THEN h[pos + 1 : pos + 50] END AS s FROM p),
m AS (SELECT s, min(doc_id) AS least FROM w WHERE s IS NOT NULL GROUP BY s),
f AS (SELECT w.doc_id, pos, b, max(CASE WHEN least < w.doc_id THEN 1 ELSE 0 END)
          OVER (PARTITION BY w.doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM w LEFT JOIN m USING (s)),
g AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS span FROM f),
r AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(span) AS BIGINT) AS n_spans,
             coalesce(string_agg(b, '' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, folder, "documents"))


def op9_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, folder, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP9_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS query_id, b.vec_id,
           CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"))


def op11_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def _duck_crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, in DuckDB, bit by bit."""
    return (f"xor(list_reduce(list_transform(range(0, strlen({text}) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 "
            f"ELSE CAST(ascii(substr({text}, i, 1)) AS BIGINT) END), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), "
            "lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)")


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verify(table(spark, folder, "documents")).drop("proof")


def _duck_record(*columns: str) -> str:
    return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in columns)


OP12_SQL = f"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS id, doc_id, source IS NOT NULL AS has, coalesce(source, '') AS src,
             sha256({_duck_record("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
             CASE WHEN {_duck_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0
                  THEN sha256({_duck_record("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")}) END AS changed FROM documents),
e AS (SELECT *, coalesce(changed, leaf) AS alt, dense_rank() OVER (ORDER BY has, src) - 1 AS tree,
             row_number() OVER (PARTITION BY has, src ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos FROM d),
up AS (
    SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM e
    UNION ALL
    SELECT tree, any_value(level) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM up WHERE n > 1
    GROUP BY tree, pos // 3),
top AS (
    SELECT 0 AS level, tree AS pos, h, count(*) OVER () AS n FROM up WHERE n = 1
    UNION ALL
    SELECT any_value(level) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY pos // 3),
nodes AS (SELECT tree, level, pos, h, n FROM up UNION ALL SELECT -1, level, pos, h, n FROM top),
beside AS (
    SELECT tree, level, pos, n,
           coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM nodes WINDOW r AS (PARTITION BY tree, level, pos // 3 ORDER BY pos)),
climb AS (
    SELECT id, tree AS origin, tree, 0 AS level, pos, alt AS f, '' AS proof FROM e
    UNION ALL
    SELECT c.id, c.origin, CASE WHEN b.n > 1 THEN c.tree ELSE -1 END, CASE WHEN b.n > 1 THEN c.level + 1 ELSE 0 END,
           CASE WHEN b.n > 1 THEN c.pos // 3 ELSE c.tree END,
           CASE WHEN b.n > 1 THEN sha256(b.l || c.f || b.r) ELSE c.f END, CASE WHEN b.n > 1 THEN c.proof || b.l || b.r ELSE c.proof END
    FROM climb c JOIN beside b ON b.tree = c.tree AND b.level = c.level AND b.pos = c.pos WHERE b.n > 1 OR c.tree >= 0),
ends AS (SELECT c.id, c.f, c.proof FROM climb c JOIN nodes n ON c.tree = -1 AND n.tree = -1 AND n.level = c.level AND n.pos = c.pos AND n.n = 1),
root AS (SELECT h AS root FROM top WHERE n = 1),
subroot AS (SELECT tree, h AS subroot FROM up WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM e JOIN subroot USING (tree) JOIN ends USING (id) CROSS JOIN root"""


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations")).drop("n_bytes")


OP13_SQL = f"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY pos) AS turns, {_duck_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t GROUP BY conv_id),
b AS (SELECT s.conv_id, list_concat(coalesce(o.turns[1 : s.h], []), s.turns[s.h + 1 :]) AS turns FROM s LEFT JOIN s o ON o.conv_id = s.conv_id - s.conv_id % 5),
p AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM b),
n AS (SELECT turns[1 : depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY ALL),
c AS (SELECT k[1 : depth - 1] AS k, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN strlen(n.k[n.depth].x) ELSE 0 END AS n_bytes
      FROM n LEFT JOIN c ON n.k = c.k AND n.depth = c.depth),
u AS (SELECT unnest(range(depth + 1)) AS up, k, n_children, (n_convs - 1) * n_bytes AS saved FROM v),
a AS (SELECT k[1 : up] AS k, up AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM u GROUP BY ALL)
SELECT v.conv_id, v.depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN a ON v.k = a.k AND v.depth = a.depth LEFT JOIN n o ON v.depth > 0 AND o.depth = v.depth - 1 AND o.k = v.k[1 : v.depth - 1]"""


QUERIES = {
    "op1_simhash": op1_simhash, "op2_main_text": op2_main_text, "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup, "op5_licenses": op5_licenses, "op6_toxicity": op6_toxicity, "op7_repeats": op7_repeats,
    "op8_token_counts": op8_token_counts, "op9_topk": op9_topk, "op10_byte_bpe": op10_byte_bpe,
    "op11_language": op11_language, "op12_manifest": op12_manifest, "op13_prefix_trie": op13_prefix_trie, "pipeline": corpus_pipeline.run,
}
SQL = {"op3_decontamination": OP3_SQL, "op7_repeats": OP7_SQL, "op9_topk": OP9_SQL, "op12_manifest": OP12_SQL, "op13_prefix_trie": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
