"""The vector index against brute force: clusters, crowded cells, zero vectors, ties, groups and conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.operators import retrieval, vector_index

KIND = "drawer_id long, embedding array<double>, wing string, open boolean"


def rows_of(seed=1, clusters=6, each=60, dims=12):
    dice = np.random.default_rng(seed)
    centres = dice.standard_normal((clusters, dims)) * 8
    rows = [(c * each + k, (centres[c] + dice.standard_normal(dims)).tolist(), f"w{k % 3}", k % 4 != 0) for c in range(clusters) for k in range(each)]
    rows += [(1000 + k, rows[3][1], "w0", True) for k in range(200)]  # one crowded point
    return [*rows, (2000, [0.0] * dims, "w1", True), (2001, None, "w1", True)]


@pytest.fixture(scope="module")
def world(spark):
    rows = rows_of()
    frame = spark.createDataFrame(rows, KIND).repartition(4)
    asked = [(k, rows[k * 17][1]) for k in range(15)] + [(50, [0.0] * 12), (51, None)]
    return frame, spark.createDataFrame(asked, "query_id long, v array<double>"), vector_index.build(frame, ["wing", "open"])


def told(df, *more):
    return sorted((tuple(r) for r in df.select("query_id", "drawer_id", *more, "similarity", "rank").collect()), key=str)


def test_search_equals_brute_force_and_reads_less(world, monkeypatch):
    frame, queries, index = world
    want = told(retrieval.vector_candidates(frame, queries, 7))
    out, read = vector_index.search(index, queries, 7)
    assert told(out) == want
    parts = {r["query_id"]: r["read"] / r["held"] for r in read.collect()}
    assert sorted(parts.values())[len(parts) // 2] < 0.7  # clustered vectors leave most cells unread
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 2000)  # blocks of 20 vectors, several of queries
    assert told(vector_index.search(index, queries, 7)[0]) == want


def test_conditions_and_groups(world):
    frame, queries, index = world
    some = F.col("open") & (F.col("wing") != "w2")
    assert told(vector_index.search(index, queries, 5, some)[0]) == told(retrieval.vector_candidates(frame.where(some), queries, 5))
    assert told(vector_index.search(index, queries, 2, per=["wing"])[0], "wing") == told(retrieval.vector_candidates(frame, queries, 2, ["wing"]), "wing")


def test_fewer_rows_than_asked_for(spark, world):
    _, queries, _ = world
    few = spark.createDataFrame(rows_of()[:3] + rows_of()[-2:], KIND)
    assert told(vector_index.search(vector_index.build(few), queries, 7)[0]) == told(retrieval.vector_candidates(few, queries, 7))
    none = few.limit(0)
    assert vector_index.search(vector_index.build(none), queries, 7)[0].count() == 0
    assert retrieval.vector_candidates(none, queries, 7).count() == 0


def test_the_approximate_mode_reaches_its_recall(world):
    _, queries, index = world
    probes = vector_index.probes_for(index, queries, 7, 0.9)
    found = vector_index.recall(index, queries.where("query_id < 50"), 7, probes).collect()
    assert sum(r["hits"] for r in found) >= 0.9 * sum(r["wanted"] for r in found)
    assert sum(r["read"] for r in found) < 0.7 * sum(r["held"] for r in found)


def test_blocks_of_bytes_in_brute_force(world, monkeypatch):
    frame, queries, _ = world
    want = told(retrieval.vector_candidates(frame, queries, 4))
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 700)
    assert told(retrieval.vector_candidates(frame, queries, 4)) == want
