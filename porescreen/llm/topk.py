"""Exact top-k search by inner product without random access (bounds from sorted lists)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from porescreen.session import cut_lineage

SCALE = 1024
#: Vectors of a block, about, and queries that are answered together; parameters of memory alone.
BLOCK, QUERIES = 4096, 512
#: The first share of every list that is read, doubled until no outsider can qualify.
FIRST_SHARE = 16


def integer_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                    scale: int = SCALE) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x), x as double.

    Rows without an id or vector, and vectors that hold null or non-finite components, take no part.
    """
    usable = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    doubles = df.select(F.col(id_column).cast("long").alias("vec_id"),
                        F.col(vector_column).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    return doubles.where(F.coalesce(usable, F.lit(False))).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def block_top(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple]:
    """(query number, id, score) of the k best rows of a block for each query, ties to the smaller id.

    Every dimension is a list sorted by value, read from the top where the query is positive and from the bottom
    where it is negative. After ``depth`` entries a row scores at most what it has shown plus, in the lists where it
    has not appeared, the last entry read; and at least what it has shown plus the end of those lists. Reading stops
    for a query when more than k rows (its own may be one) have lower bounds above every other row's upper bound;
    these rows' scores are then read to the end. Bounds of all open queries come from matrix products.
    """
    n, width = rows.shape
    lists = np.sort(rows, axis=0)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    open_, out, depth = np.arange(len(queries)), [], max(1, n // FIRST_SHARE)
    while len(open_):
        depth = min(depth, n)
        top, bottom = lists[n - depth], lists[depth - 1]
        p, m = plus[open_], minus[open_]
        above, below = rows >= top, rows <= bottom
        upper = p @ np.maximum(rows, top).T + m @ np.minimum(rows, bottom).T
        lower = p @ np.where(above, rows, lists[0]).T + m @ np.where(below, rows, lists[-1]).T
        still = []
        for i, q in enumerate(open_):
            apart = ids != own[q]
            if depth < n and n > k + 1:
                bound = np.partition(lower[i][apart], -k)[-k] if apart.sum() >= k else -np.inf
                inside = apart & (upper[i] >= bound)
                if inside.sum() > 4 * k:
                    still.append(q)
                    continue
            else:
                inside = apart
            chosen = np.nonzero(inside)[0]
            scores = rows[chosen] @ queries[q]
            best = np.lexsort((ids[chosen], -scores))[:k]
            out += [(int(q), int(ids[chosen[b]]), int(scores[b])) for b in best]
        open_, depth = np.array(still, np.int64), depth * 2
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, together: int = QUERIES) -> DataFrame:
    """The k candidates of greatest inner product for every query: (query_id, rank, vec_id, score).

    Both inputs are (vec_id, v) as ``integer_vectors`` gives them; a candidate with the id of the query is left out.
    Candidates are dealt to blocks by hash, each block answers every query exactly by sorted lists, and the k best of
    the blocks' answers are the result. Ties go to the smaller id. Shorter vectors count as filled up with zeros.
    Repeated rows are candidates as often as they come; a repeated query is answered once. Fewer candidates give
    fewer rows, an empty table none. Products must stay below 2^53.
    """
    candidates = cut_lineage(candidates)
    queries = cut_lineage(queries.dropDuplicates(["vec_id"]))
    blocks = max(1, -(-candidates.count() // block))
    groups = max(1, -(-queries.count() // together))
    salted = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    rows = candidates.select(salted.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"),
                             F.lit(False).alias("asks"), "vec_id", "v")
    asks = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                          F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("grp"),
                          F.lit(True).alias("asks"), "vec_id", "v")

    def answer(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf.asks], pdf[~pdf.asks]
        found = []
        if len(q) and len(c):
            width = int(pdf.v.map(len).max())
            own = q.vec_id.to_numpy()
            top = block_top(_matrix(q.v, width), own, c.vec_id.to_numpy(), _matrix(c.v, width), k)
            found = [(own[i], at, score) for i, at, score in top]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    best = rows.unionAll(asks).groupBy("block", "grp").applyInPandas(answer, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
