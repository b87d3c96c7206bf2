"""Blocks of postings against scoring every record: common words, ties, empty texts, few records."""

import random

import pytest

from recallspark.operators import postings, retrieval

KIND = "drawer_id long, text string"


@pytest.fixture(scope="module")
def world(spark):
    dice = random.Random(4)
    rare = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(["the"] * dice.randrange(4) + [dice.choice(rare[: 10 + k % 290]) for _ in range(dice.choice([1, 5, 30, 120]))])) for k in range(900)]
    rows += [(1000, None), (1001, ""), (1002, rows[7][1]), (1003, "only here"), (1004, "the " * 500)]
    asked = [(k, " ".join(dice.choice(rare) for _ in range(3)) + " the") for k in range(12)] + [(20, "only"), (21, "unknown"), (22, None), (23, "the"), (24, "w1 w1 W1")]
    return spark.createDataFrame(rows, KIND).repartition(5), spark.createDataFrame(asked, "query_id long, query string")


def told(df):
    return sorted(tuple(r) for r in df.select("query_id", "drawer_id", "score", "rank").collect())


def test_search_equals_scoring_every_record_and_reads_less(world, monkeypatch):
    drawers, queries = world
    want = told(retrieval.bm25(drawers, queries, 5))
    index = postings.build(drawers, 16)
    out, read = postings.search(index, queries, 5)
    assert told(out) == want
    parts = [(r["read"], r["held"]) for r in read.collect()]
    assert sum(a for a, _ in parts) < 0.8 * sum(b for _, b in parts)
    assert index.posts.groupBy("range", "term").count().agg({"count": "max"}).first()[0] < 60  # no block of a whole term
    monkeypatch.setattr(postings, "BROADCAST_ROWS", 0)
    assert told(postings.search(index, queries, 5, first=1)[0]) == want


def test_no_records(world):
    drawers, queries = world
    assert postings.search(postings.build(drawers.limit(0)), queries, 5)[0].count() == 0
    assert told(postings.search(postings.build(drawers.where("drawer_id > 999")), queries, 5)[0]) == told(retrieval.bm25(drawers.where("drawer_id > 999"), queries, 5))
