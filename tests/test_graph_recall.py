"""Graph recall keyed by query: each query gets its own facts, hints lead, hidden rows neither seed nor show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recallspark.operators import graph, graph_recall
from recallspark.plans import catalog, more

SF = "/root/testdata/sf0.001"
S = "statement_id string, space_id string, subject_id string, predicate string, object_id string, audience string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, confidence double, sensitive boolean, source_turn_id string"
DAY = lambda n: dt.datetime(2024, 1, n)


def statement(key, subject, object_, turn, audience="owner", confidence=0.5, start=1, end=None, sensitive=False, space="s"):
    return (key, space, subject, "likes", object_, audience, DAY(start), DAY(end) if end else None, DAY(start), confidence, sensitive, turn)


@pytest.fixture(scope="module")
def world(spark):
    rows = [
        statement("a1", "ann", "tea", "t1", confidence=0.9), statement("a2", "ann", "milk", "t2", confidence=0.8), statement("a3", "ann", "ale", "t3", end=2),
        statement("b1", "bob", "tea", "t4"), statement("b2", "bob", "jazz", "t5", audience="companion:x"), statement("b3", "bob", "flu", "t6", sensitive=True),
        statement("c1", "cat", "bob", "t7"), statement("d1", "dan", "gin", "t8", end=3), statement("d2", "dan", "rum", "t9"), statement("z1", "ann", "tea", "t1", space="other"),
    ]
    names = sorted({x for r in rows for x in (r[2], r[4])})
    entities = spark.createDataFrame([(sp, n, n) for sp in ("s", "other") for n in names], "space_id string, entity_id string, name string")
    mentions = spark.createDataFrame([("s", "dan", "old friend", 0.9, "owner"), ("s", "cat", "kitty", 0.9, "companion:x")], "space_id string, entity_id string, alias string, confidence double, audience string")
    return spark.createDataFrame(rows, S), entities, mentions


def ask(spark, world, queries, hints=(), recalled=(), audiences=("owner",)):
    statements, entities, mentions = world
    q = spark.createDataFrame([(k, "s", t) for k, t in queries], "query_id long, space_id string, query string")
    h = spark.createDataFrame(list(hints), "query_id long, name string, place int")
    r = spark.createDataFrame([(k, "s", t) for k, t in recalled], "query_id long, space_id string, source_turn_id string")
    out = graph_recall.recall(q, h, r, statements, entities, mentions, list(audiences), graph.time("2024-01-10T00:00:00")).collect()
    found = {k: [] for k, _ in queries}
    for x in sorted(out, key=lambda x: (x["query_id"], x["ordinal"])):
        found[x["query_id"]].append(x["statement_id"] + ("*" if x["restates"] else ""))
        assert x["ordinal"] == len(found[x["query_id"]])
    return found


def test_each_query_gets_its_own_facts(spark, world):
    assert ask(spark, world, [(1, "where is ann"), (2, "and dan?"), (3, "nobody")]) == {1: ["a1", "a2"], 2: ["d2"], 3: []}


def test_hints_lead_and_phrases_fill_the_rest(spark, world):
    hints = [(1, "dan", 1), (1, "dan", 2), (2, "ann", 1), (2, "dan", 2), (2, "cat", 3), (2, "bob", 4)]
    found = ask(spark, world, [(1, "ann"), (2, "bob"), (3, "ann, dan, cat, bob")], hints)
    assert found[1] == ["d2", "a1", "a2"]
    assert found[2] == ["a1", "a2", "d2", "c1"]  # three hints leave the phrase no place
    assert found[3] == ["a1", "a2", "b1", "c1"]  # three names of equal length, by name


def test_hidden_rows_neither_seed_nor_show(spark, world):
    assert ask(spark, world, [(1, "bob and kitty")]) == {1: ["b1", "c1"]}
    assert set(ask(spark, world, [(1, "bob and kitty")], audiences=("owner", "companion:x"))[1]) == {"b1", "b2", "c1"}
    assert ask(spark, world, [(1, "bob and kitty")], audiences=()) == {1: []}
    # the only statement of a recalled turn is hidden, so its entities do not seed
    assert ask(spark, world, [(1, "?")], recalled=[(1, "t5"), (1, "t6")]) == {1: []}


def test_one_hop_from_recalled_turns(spark, world):
    # history seeds (t8 ended), only what holds is returned; what a record says already comes last
    assert ask(spark, world, [(1, "?"), (2, "?")], recalled=[(1, "t8"), (2, "t4"), (2, "t4"), (2, "")]) == {1: ["d2"], 2: ["c1", "a1", "b1*"]}


def test_a_shared_statement_counts_once(spark, world):
    assert ask(spark, world, [(1, "ann tea")], recalled=[(1, "t1")]) == {1: ["a2", "b1", "a1*"]}


def test_busy_entities_are_cut_before_they_are_joined(spark, world):
    statements, entities, mentions = world
    many = spark.range(2000).select(F.format_string("h%05d", "id").alias("statement_id"), F.lit("s").alias("space_id"), F.lit("ann").alias("subject_id"), F.lit("likes").alias("predicate"), F.lit("tea").alias("object_id"), F.lit("owner").alias("audience"),
        F.lit(DAY(1)).cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(DAY(1)).cast("timestamp_ntz").alias("recorded_at"), F.lit(0.1).alias("confidence"), F.lit(False).alias("sensitive"), F.lit("t").alias("source_turn_id"))
    frontier = spark.range(50).select(F.col("id").alias("query_id"), F.lit("s").alias("space_id"), F.lit("ann").alias("name"), F.lit(1).alias("ordinal"))
    out = graph_recall.facts(frontier, statements.unionByName(many), entities)
    assert out.count() == 50 * graph_recall.EACH
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_contexts_differ_and_show_no_hidden_theme(spark):
    facts = {}
    for r in more.recall_facts(spark, SF).collect():
        facts.setdefault(r["query_id"], set()).add(r["statement_id"])
    assert len(set(map(frozenset, facts.values()))) > 5
    seen = {r["drawer_id"] for r in catalog.recallable(spark, SF).select("drawer_id").collect()}
    assert {r["drawer_id"] for r in more.theme_merge(spark, SF).collect()} <= seen
