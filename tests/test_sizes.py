"""What a task holds, and what is shuffled, does not grow with the tables."""

import pytest
from pyspark.sql import functions as F

from recallspark.functions import text
from recallspark.operators import graph, graph_recall, ledgers, postings
from recallspark.plans import catalog, more
from recallspark.sources import views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_commitments_are_dealt_by_their_lines(unbroadcast, monkeypatch):
    monkeypatch.setattr(views, "LINES", 300)
    lines = views.load(unbroadcast, SF, "lineitem").count()
    events = views.commitment_events(unbroadcast, SF)
    for df in (ledgers.fold_commitments(events), ledgers.commitment_history(events, 3), catalog.QUERIES["commitment_unarchived"](unbroadcast, SF)):
        shuffles = [x for x in plan(df).splitlines() if "Exchange" in x]
        assert shuffles and all(f", {-(-lines // 300)})" in x and "REPARTITION_BY_NUM" in x for x in shuffles)


def test_commitments_of_sources_are_dealt_by_their_lines(spark, monkeypatch):
    monkeypatch.setattr(views, "LINES", 300)
    events = views.commitment_events(spark, SF)
    sources = spark.createDataFrame([("supplier:7",), ("supplier:7",), ("none",)], "source string")
    out = ledgers.commitments_of_sources(events.select("commitment_id", F.col("participant").alias("source")), events.groupBy("commitment_id").agg(F.count("*").alias("revision")), F.broadcast(sources))
    assert not [x for x in plan(out).splitlines() if "Exchange hashpartitioning(commitment_id" in x]
    assert told(out.select("commitment_id")) == told(events.where("participant = 'supplier:7'").select("commitment_id").distinct())


def test_applied_commitments_are_shuffled_once(unbroadcast):
    shuffles = [x for x in plan(catalog.QUERIES["commitment_apply"](unbroadcast, SF)).splitlines() if "Exchange" in x]
    assert len(shuffles) == 2  # lines and orders


def test_names_are_broadcast_and_phrases_dealt(unbroadcast, monkeypatch):
    phrases = unbroadcast.createDataFrame([(k, f"s{k % 2}", f"near user:{k % 7} of 日本") for k in range(60)], "phrase_id long, space_id string, phrase string")
    names = unbroadcast.createDataFrame([("s0", "user:1"), ("s1", "user:1"), ("s0", "日本"), ("s1", "本"), ("s1", "本"), ("s0", ""), ("s1", None), ("s0", "none of these")], "space_id string, match string")
    monkeypatch.setattr(graph, "PHRASES", 2)
    few = graph.match_names(phrases, names)
    assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" not in plan(few) and "hashpartitioning(phrase_id" in plan(few) and ", 30)" in plan(few)
    rows = told(few.select("phrase_id", "match"))
    asked = [(k, f"s{k % 2}", f"near user:{k % 7} of 日本") for k in range(60)]
    assert rows == sorted((k, m) for k, s, p in asked for t, m in [("s0", "user:1"), ("s1", "user:1"), ("s0", "日本"), ("s1", "本"), ("s1", "本")] if t == s and m in p)
    monkeypatch.setattr(graph, "NAMES", 0)
    many = graph.match_names(phrases, names)
    assert "SortMergeJoin" in plan(many) and told(many.select("phrase_id", "match")) == rows
    assert graph.match_names(phrases, names.limit(0)).count() == 0


def test_names_of_any_length_are_found(unbroadcast, monkeypatch):
    word = "日本 of the north and the east "
    said = {1: f"moved to {word * 4}near user:7", 2: f"{word * 9}end", 3: word * 2 + word.upper() + word * 2, 4: "x" * 200, 5: "user:7", 6: None, 7: word * 3 + "," + word * 3}
    asked = [(k, f"s{t}", p) for k, p in said.items() for t in (0, 1)]
    long = [word * 3, word * 3, word * 8 + word[:5], word * 2 + word[:3], (word * 2 + word[:3])[1:], "x" * 64, "x" * 65, "x" * 199, "x" * 200, "x" * 201, word * 3 + "end", "7", word * 2 + "!" * 9]
    known = [("s0", n, k) for k, n in enumerate(long)] + [("s1", n, -k) for k, n in enumerate(long[3:], 1)]
    phrases = unbroadcast.createDataFrame(asked, "phrase_id long, space_id string, phrase string")
    names = unbroadcast.createDataFrame(known, "space_id string, match string, n int")
    want = sorted((k, t, m, n) for k, t, p in asked for u, m, n in known if t == u and m in (p or ""))
    assert max(len(m) for _, _, m, _ in want) == 237
    few = graph.match_names(phrases, names)
    assert told(few.select("phrase_id", "space_id", "match", "n")) == want and "SortMergeJoin" not in plan(few) and few.columns == ["space_id", "match", "phrase_id", "phrase", "n"]
    monkeypatch.setattr(graph, "NAMES", 0)
    many = graph.match_names(phrases, names)
    assert told(many.select("phrase_id", "space_id", "match", "n")) == want and "BroadcastHashJoin" not in plan(many)


def test_long_names_that_begin_alike_are_not_tried_one_by_one(unbroadcast):
    begin = "https://a.long.address/" + "that/all/of/them/have/" * 3
    phrases = unbroadcast.range(50).select(F.col("id").alias("phrase_id"), F.lit("s").alias("space_id"), F.concat(F.lit("see " + begin), F.col("id").cast("string"), F.lit(" now")).alias("phrase"))
    names = unbroadcast.range(3000).select(F.lit("s").alias("space_id"), F.concat(F.lit(begin), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(" now")).alias("match"))
    out = graph.match_names(phrases.withColumn("phrase", F.regexp_replace("phrase", "/([0-9]+) now", "/00$1 now")), names)
    assert sorted(r.match for r in out.select("match").collect()) == sorted(f"{begin}{k:04d} now" for k in range(10, 50))
    assert "Aggregate" in plan(out)  # heads and lengths, each once


def test_facts_are_dealt_by_query_once(unbroadcast):
    statements, entities = views.statements(unbroadcast, SF), views.entities(unbroadcast, SF)
    frontier = unbroadcast.createDataFrame([(1, "space_0", "user:8", 1, 0)], "query_id long, space_id string, name string, ordinal int, _side int")
    none = unbroadcast.createDataFrame([], "query_id long, source_turn_id string")
    out = graph_recall.merged(graph_recall.facts(frontier, statements, entities, key=("query_id", "_side")), none)
    shuffles = [x for x in plan(out).splitlines() if "Exchange hashpartitioning(query_id" in x]
    assert len(shuffles) == 2  # statements found, and turns shown


@pytest.mark.parametrize(("value", "name"), [("é" * 500 + "a b", "a_b"), ("a" + "é" * 500 + "b" * 30, "a_bbbbbbbbbbbb" + "bbbbbbbbbbbbbbbbbb"), ("_" * 500, "default"), ("x" * 40 + " " * 3, "x" * 40), ("x" * 40 + "é" * 300, "x" * 40)])
def test_names_of_texts_whose_head_says_too_little(spark, value, name):
    assert spark.createDataFrame([(value,)], "v string").select(text.safe_name(F.col("v"), 40)).first()[0] == name


def test_long_texts_are_named_by_their_head(spark):
    rows = spark.createDataFrame([("ab. " * 100,)], "v string").select(text.safe_name(F.col("v"), 40).alias("name"))
    assert "CASE WHEN (char_length(regexp_replace(regexp_replace(substring(" in rows._jdf.queryExecution().analyzed().toString()
    assert rows.first()[0].startswith("ab_ab_ab_ab_ab_ab_ab_ab" [:23] + "_")


def test_postings_are_dealt_by_their_words(spark, monkeypatch):
    monkeypatch.setattr(postings, "WORDS", 100)
    index = postings.build(spark.range(600).select(F.col("id").alias("drawer_id"), F.concat_ws(" ", F.lit("the"), F.col("id").cast("string"), F.lit("end")).alias("text")), 16)
    assert len(index.posts.inputFiles()) > 12 and index.posts.count() == 1800 and index.n == 600


def test_seeds_match_phrases_once(unbroadcast):
    assert "matched-" in plan(more.graph.seeded(["item:9"], graph.matched_entities(views.phrases(unbroadcast, SF), views.entities(unbroadcast, SF), views.mentions(unbroadcast, SF), ["owner"])))
