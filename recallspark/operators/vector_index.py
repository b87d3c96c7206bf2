"""Vector search that prunes: unit vectors in cells around centres, probed exactly by the triangle inequality or approximately.

Centres are k-means of a bounded sample; every vector lies in the cell of its nearest centre, and a cell knows the largest distance of
its members. A query first meets its nearest cells that hold enough vectors; no member of another cell is nearer than the distance of
its centre less its radius, so only cells that may still beat the k-th best so far are read. Cells and queries are dealt in
blocks of bounded bytes, so neither a crowded cell nor many queries make one large task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.scratch import new_path, written

#: Rows of the sample for each centre, rounds of k-means, bytes that all centres take at most, and bytes of vectors in a block.
SAMPLE_EACH, ROUNDS, CENTRE_BYTES, BLOCK_BYTES = 32, 8, 32 << 20, 16 << 20
#: Similarities are rounded to six digits, so distances that differ by less than this count as equal (of squares).
SLACK = 4e-6


@dataclass
class Index:
    """rows: drawer_id, embedding, cell (-1: zero vectors), distance (to the centre) and carried columns. cells: cell, n, radius. centres: one row a cell."""

    rows: DataFrame
    cells: DataFrame
    centres: np.ndarray
    n: int


def _units(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as a matrix, and their lengths."""
    a = np.stack([np.asarray(v, float) for v in vectors])
    length = np.sqrt((a * a).sum(1))
    return a / np.where(length > 0, length, 1)[:, None], length


def _distances(a: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] - 2 * a @ centres.T + (centres * centres).sum(1)[None]
    return np.sqrt(np.maximum(square, 0))


def build(vectors: DataFrame, carry: list[str] | None = None, cells: int | None = None, seed: int = 1) -> Index:
    """Indexes every row of vectors (drawer_id, embedding, carried columns) that has a vector.

    There are about as many cells as the root of the number of rows, fewer if their centres would pass CENTRE_BYTES. The rows are
    written sorted by cell, so that a scan of some cells skips the rest by the statistics of row groups. Vectors must be of
    one length. An empty table has no cells.
    """
    carry = carry or []
    held = vectors.where("embedding is not null").select("drawer_id", "embedding", *carry)
    n, dims = held.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    many = max(1, min(cells or int(n**0.5), CENTRE_BYTES // (8 * max(dims, 1))))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda z, x: z + x.cast("double") * x.cast("double")))
    unit = held.withColumn("_norm", norm).where("_norm > 0").select(F.transform("embedding", lambda x: x.cast("double") / F.col("_norm")).alias("u"))
    part = min(1.0, SAMPLE_EACH * many / max(n, 1))
    some = unit if part == 1 else unit.sample(part, seed)
    some = some.select(array_to_vector("u").alias("features"))
    found = KMeans(k=many, seed=seed, maxIter=ROUNDS).fit(some).clusterCenters() if many > 1 and n > many else [c.u for c in unit.limit(1).collect()]
    centres = np.array(found, float).reshape(-1, dims)

    def assign(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            a, length = _units(pdf["embedding"])
            far = _distances(a, centres) if len(centres) else np.zeros((len(a), 1))
            cell = far.argmin(1)
            pdf["cell"] = np.where(length > 0, cell, -1).astype(np.int32)
            pdf["distance"] = np.where(length > 0, far[np.arange(len(a)), cell], 0.0)
            yield pdf

    kind = ", ".join([*(f"`{c}` {t}" for c, t in held.dtypes), "cell int, distance double"])
    path = new_path(held.sparkSession, "vectors")
    held.mapInPandas(assign, kind).repartitionByRange("cell", "drawer_id").sortWithinPartitions("cell").write.parquet(path)
    rows = held.sparkSession.read.parquet(path)
    known = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
    return Index(rows, written(known, "cells"), centres, n)


def _wanted(index: Index, queries: DataFrame, k: int, probes: int | None) -> DataFrame:
    """query_id, v, cell, at (its place by distance, from 1), first (whether it is among the nearest that hold k vectors, or the nearest `probes`) and reach (the least distance of a member)."""
    centres, sizes = index.centres, np.zeros(len(index.centres), np.int64)
    radius, zeros = np.zeros(len(centres)), 0
    for r in index.cells.collect():  # as many as there are centres
        if r["cell"] < 0:
            zeros = r["n"]
        else:
            sizes[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            a, length = _units(pdf["v"])
            far = _distances(a, centres) if len(centres) else np.zeros((len(a), 0))
            for q in range(len(pdf)):
                order = np.argsort(far[q], kind="stable")
                order = order[sizes[order] > 0]
                held = np.cumsum(sizes[order])
                first = np.arange(len(order)) < probes if probes else held - sizes[order] < k
                reach = np.maximum(far[q][order] - radius[order], 0)
                if not length[q]:  # all similarities are null
                    first, reach = np.ones(len(order), bool), np.zeros(len(order))
                cell = order.tolist() + [-1] * bool(zeros)
                few = bool(zeros) and not probes and (not length[q] or int(sizes.sum()) < k)
                out = pd.DataFrame({"cell": np.array(cell, np.int32), "first": [*first.tolist(), *[few] * bool(zeros)], "reach": [*reach.tolist(), *[2.0] * bool(zeros)]})
                out["at"] = np.arange(1, len(out) + 1, dtype=np.int32)
                if not len(out):
                    continue
                out["query_id"], out["v"] = pdf["query_id"].iat[q], [pdf["v"].iat[q]] * len(out)
                yield out[["query_id", "v", "cell", "at", "first", "reach"]]

    return queries.mapInPandas(run, "query_id long, v array<double>, cell int, at int, first boolean, reach double")


def _nearest(k: int, per: list[str]):
    """The k best of each query (and group `per`) in a block of rows of one cell."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "drawer_id", *per, "similarity"]
        if not len(rows) or not len(asked):
            return pd.DataFrame(columns=names)
        a, long = _units(rows["embedding"])
        ids, out = rows["drawer_id"].to_numpy(), []
        for at in range(0, len(asked), 256):
            some = asked.iloc[at : at + 256]
            b, asking = _units(some["v"])
            near = np.round(b @ a.T, 6)
            near[:, long == 0] = np.nan
            near[asking == 0] = np.nan
            for q, row in zip(some["query_id"], near):
                order = np.lexsort((ids, -np.where(np.isnan(row), -np.inf, row)))
                if per:
                    place = rows[per].iloc[order].groupby(per, dropna=False, sort=False).cumcount().to_numpy()
                    order = order[place < k]
                else:
                    order = order[:k]
                out.append(pd.DataFrame({"query_id": q, "drawer_id": ids[order], **{c: rows[c].to_numpy()[order] for c in per}, "similarity": row[order]}))
        return pd.concat(out)

    return run


def _probed(rows: DataFrame, cells: DataFrame, pairs: DataFrame, n_queries: int, dims: int, k: int, per: list[str]) -> DataFrame:
    """Similarities of the pairs (query_id, v, cell) with the rows of their cells, k of each block."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") * (8.0 * dims) / BLOCK_BYTES)).cast("int")
    sizes = cells.select("cell", parts.alias("_parts"))
    q_parts = max(1, -(-n_queries * 8 * dims // BLOCK_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = rows.join(F.broadcast(sizes), "cell").withColumn("_part", F.pmod(F.xxhash64("drawer_id"), F.col("_parts")).cast("int")).withColumn("_q", every(F.lit(q_parts)))
    asked = pairs.join(F.broadcast(sizes), "cell").withColumn("_part", every(F.col("_parts"))).withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q_parts)).cast("int"))
    key = ["cell", "_part", "_q"]
    kinds = dict(rows.dtypes)
    kind = ", ".join(["query_id long", f"drawer_id {kinds['drawer_id']}", *(f"`{c}` {kinds[c]}" for c in per), "similarity double"])
    held = held.select(*key, "drawer_id", "embedding", *per)
    found = held.groupBy(*key).cogroup(asked.select(*key, "query_id", "v").groupBy(*key)).applyInPandas(_nearest(k, per), kind)
    return found.withColumn("similarity", F.when(~F.isnan("similarity"), F.col("similarity")))


def search(index: Index, queries: DataFrame, k: int, where: Column | None = None, per: list[str] | None = None, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """query_id, drawer_id, similarity and rank (from 1) of the k nearest rows of each query (query_id, v) that `where` admits, and of each group `per`; besides, how much was read.

    Exact, equal to holding each query against every row, unless `probes` names a number of nearest cells to read instead. where is a condition on carried
    columns and is pushed to the scan. The second frame has query_id, read (rows of the cells that the query met) and held (all rows). Queries
    without a vector give no rows; a zero vector's similarity is null and comes last; ties go to the smaller id. With groups
    every cell that may hold a near row of some group is read.
    """
    per = per or []
    rows = index.rows if where is None else index.rows.where(where)
    asked = queries.where("v is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v"))
    n_queries = asked.count()
    dims = index.centres.shape[1]
    pairs = written(_wanted(index, asked, k, probes), "pairs")
    place = Window.partitionBy("query_id", *per).orderBy(F.desc_nulls_last("similarity"), "drawer_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    first = pairs.where("first") if not per or probes else pairs
    best = written(ranked(_probed(rows, index.cells, first, n_queries, dims, k, per)).drop("rank"), "best")
    met = first.select("query_id", "cell")
    if not per and not probes:
        # the k-th best distance so far; a query that has fewer than k must read on everywhere
        bound = best.groupBy("query_id").agg(F.count("similarity").alias("_n"), F.min("similarity").alias("_s"))
        rest = pairs.where("not first").join(bound, "query_id", "left")
        far = F.sqrt(F.greatest(2 - 2 * F.col("_s"), F.lit(0.0)) + SLACK)
        rest = written(rest.where(F.col("_n").isNull() | (F.col("_n") < k) | ((F.col("cell") >= 0) & (F.col("reach") <= far))).select("query_id", "v", "cell"), "rest")
        best = best.unionByName(ranked(_probed(rows, index.cells, rest, n_queries, dims, k, per)).drop("rank"))
        met = met.unionByName(rest.select("query_id", "cell"))
    read = met.join(F.broadcast(index.cells.select("cell", "n")), "cell").groupBy("query_id").agg(F.sum("n").alias("read"))
    return ranked(best), read.withColumn("held", F.lit(index.n).cast("long"))


def probes_for(index: Index, queries: DataFrame, k: int, least: float = 0.9, where: Column | None = None) -> int:
    """How many nearest cells a query must read so that, over these queries, at least that part of their k nearest rows is found: a quantile of the places of the cells that hold them."""
    exact, _ = search(index, queries, k, where)
    asked = queries.where("v is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v"))
    places = _wanted(index, asked, k, None).select("query_id", "cell", "at")
    found = exact.select("query_id", "drawer_id").join(index.rows.select("drawer_id", "cell"), "drawer_id").join(places, ["query_id", "cell"])
    at = found.agg(F.percentile("at", F.lit(least))).first()[0]
    return max(1, int(np.ceil(at or 1)))


def recall(index: Index, queries: DataFrame, k: int, probes: int, where: Column | None = None) -> DataFrame:
    """query_id, wanted, hits, read and held: how many of each query's k nearest rows the approximate search finds, and what it reads."""
    exact, _ = search(index, queries, k, where)
    near, read = search(index, queries, k, where, probes=probes)
    both = exact.select("query_id", "drawer_id").join(near.select("query_id", "drawer_id", F.lit(1).alias("_hit")), ["query_id", "drawer_id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("_hit").alias("hits")).join(read, "query_id")
