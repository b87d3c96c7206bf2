"""Exact top-k inner products by columnar branch and bound.

Vectors lie in vertical layout, a block of dimensions at a time. For a block of queries and a block of candidates, scores are
accumulated dimension block by dimension block; after each, a candidate stays only while its score so far plus the most that
the remaining mass of both vectors can add (Cauchy-Schwarz) reaches the query's k-th best lower bound, which the first block of candidates
hands on to all others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.llm.common import materialize, table

#: Dimensions accumulated at a time, queries and candidates per block at most, bytes of a block's vectors, candidates that a block has at least, and the magnitude up to which doubles hold scores exactly.
DIMS, QUERY_BLOCK, VECTOR_BLOCK, BLOCK_BYTES, LEAST_BLOCK, EXACT = 16, 4096, 32_768, 16 << 20, 2048, 2.0**52


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null for a vector that is null or holds null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def best(query: np.ndarray, block: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, masses: np.ndarray, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the k best candidates of one query that reach `least`; block is (dimensions, candidates) of integers or doubles, own marks rows to leave out."""
    parts = [slice(a, a + DIMS) for a in range(0, len(query), DIMS)]
    mass = np.array([np.dot(query[p].astype(float), query[p].astype(float)) for p in parts])
    order = np.argsort(-mass, kind="stable")
    alive = np.flatnonzero(~own)
    score = np.zeros(len(alive), block.dtype)
    rest = masses[:, alive].sum(0)
    left = float(mass.sum())
    for p in order:
        score = score + query[parts[p]] @ block[parts[p]][:, alive]
        rest = np.maximum(rest - masses[p, alive], 0)
        left = max(left - mass[p], 0.0)
        near = score.astype(float)
        reach = np.sqrt(left * rest) * (1 + 1e-9) + np.abs(near) * 1e-9 + 1e-6
        floor = least
        if len(alive) > k:
            floor = max(floor, np.partition(near - reach, len(alive) - k)[len(alive) - k])
        keep = near + reach >= floor
        alive, score, rest = alive[keep], score[keep], rest[keep]
    top = np.lexsort((ids[alive], -score))[:k]
    return alive[top], score[top]


def top_k(queries: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank (from 1), id_col, score: for each query row the k vectors of other ids with the largest integer inner products.

    vector_col holds arrays of whole numbers. Ties go to the smaller id; all are returned if there are fewer. Rows with a null
    id or vector take no part; shorter vectors count as filled up with zeros; scores must fit a long. Queries
    with the same id and vector are asked once, those that only share an id each on their own; candidates that repeat are all
    ranked. Empty tables give no rows; other columns are not read. Queries and vectors are dealt into blocks and each pair of
    blocks is one task, so nothing is broadcast. Each query first meets one block of vectors; the k-th best score there goes
    with it to all others, which return only what reaches it.
    """
    q = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null").distinct()
    q = q.withColumn("x", F.xxhash64(F.lit(1), "v")).withColumn("y", F.xxhash64(F.lit(2), "v"))
    x = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    n_q, n_x, dims = q.count(), *x.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    # long vectors lie in smaller blocks, so that what a task holds does not grow with them
    fits = max(1, BLOCK_BYTES // (8 * max(dims, 1)))
    query_block, vector_block = min(query_block, fits), min(vector_block, fits)
    q_blocks = max(1, -(-n_q // query_block))
    # smaller blocks than asked for while there are fewer than tasks that can run
    x_blocks = max(1, -(-n_x // vector_block), min(vectors.sparkSession.sparkContext.defaultParallelism, n_x // min(LEAST_BLOCK, vector_block)))
    deal = lambda df, name, n, seed: df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(n)).cast("int"))
    q, x = deal(q, "qb", q_blocks, 1), deal(x, "xb", x_blocks, 2).withColumns({"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long"), "least": F.lit(None).cast("long")})
    kind = "query_id long, x long, y long, vec_id long, score long"

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, ids = pdf.asks.to_numpy(), pdf.id.to_numpy()
        size = max(pdf.v.map(len).max(), 1)
        dense = np.zeros((len(pdf), size), np.int64)
        for n, v in enumerate(pdf.v):
            dense[n, : len(v)] = v
        masses = np.stack([(dense[~asks, a : a + DIMS].astype(float) ** 2).sum(1) for a in range(0, size, DIMS)])
        most = (dense[asks].astype(float) ** 2).sum(1).max(initial=0) * masses.sum(0).max(initial=0)
        if most < EXACT**2:
            dense = dense.astype(float)
        block, block_ids = np.ascontiguousarray(dense[~asks].T), ids[~asks]
        out = []
        for row in np.flatnonzero(asks).tolist():
            least = pdf.least.iat[row]
            rows, score = best(dense[row], block, block_ids == ids[row], block_ids, k, masses, -np.inf if pd.isna(least) else float(least))
            out.append(pd.DataFrame({"query_id": ids[row], "x": pdf.x.iat[row], "y": pdf.y.iat[row], "vec_id": block_ids[rows], "score": score.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "x", "y", "vec_id", "score")}).astype("int64")

    def searched(asked: DataFrame, held: DataFrame) -> DataFrame:
        columns = ["qb", "xb", "id", "v", "x", "y", "least"]
        both = asked.select(*columns, F.lit(True).alias("asks")).unionByName(held.select(*columns, F.lit(False).alias("asks")))
        return both.groupBy("qb", "xb").applyInPandas(search, kind)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = Window.partitionBy("query_id", "x", "y").orderBy(F.desc("score"), "vec_id")
    if x_blocks == 1:
        found = searched(q.withColumn("xb", F.lit(0)).withColumn("least", F.lit(None).cast("long")), x.withColumn("qb", every(q_blocks)))
    else:
        # the one block that each query meets first; it meets the others with what it found there
        met = q.withColumn("xb", F.pmod("qb", F.lit(x_blocks)).cast("int")).withColumn("least", F.lit(None).cast("long"))
        first = materialize(searched(met, x.withColumn("qb", every(q_blocks)).where(F.pmod("qb", F.lit(x_blocks)) == F.col("xb"))))
        bound = first.groupBy("query_id", "x", "y").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
        asked = q.join(bound, (q.id == bound.query_id) & (q.x == bound.x) & (q.y == bound.y), "left").select(q.id, q.v, q.x, q.y, "qb", "least")
        asked = asked.withColumn("xb", every(x_blocks)).where(F.pmod("qb", F.lit(x_blocks)) != F.col("xb"))
        rest = searched(asked, x.withColumn("qb", every(q_blocks)).where(F.pmod("qb", F.lit(x_blocks)) != F.col("xb")))
        found = first.unionByName(rest)
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's five best of every query over all embeddings."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("embedding"))
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)


QUERIES = {"op1_exact_topk": op1_exact_topk}
ORACLES = {
    "op1_exact_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
