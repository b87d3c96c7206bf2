"""Edge cases of the operators on small hand-written rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recallspark.functions import ids
from recallspark.operators import browse, evaluation, graph, ledgers, retrieval
from recallspark.operators.visibility import Caller, tier, visible

STATEMENT = "statement_id string, subject_id string, predicate string, object_id string, audience string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, confidence double, sensitive boolean, source_turn_id string, space_id string, projection_id string"


def day(n):
    return datetime(2024, 1, n) if n else None


def statement(k, s="a", p="likes", o="b", audience="owner", start=1, end=None, recorded=1, confidence=0.5, sensitive=False, turn="t", space="x", projection=None):
    return (f"s{k}", s, p, o, audience, day(start), day(end), day(recorded), confidence, sensitive, turn, space, projection)


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), STATEMENT)


def names(df):
    return sorted(r.statement_id for r in df.collect())


def test_validity_is_half_open_and_open_at_nulls(table):
    df = table(statement(1, start=1, end=5), statement(2, start=5), statement(3, start=None), statement(4, start=6))
    assert names(df.where(graph.valid_at(graph.time("2024-01-05T00:00:00")))) == ["s2", "s3"]


def test_no_audiences_read_nothing_and_the_owner_reads_all(table):
    df = table(statement(1), statement(2, audience="c"), statement(3, sensitive=True))
    assert names(graph.visible(df, [])) == []
    assert names(graph.visible(df, ["owner"])) == ["s1"]
    assert names(graph.visible(df, None, sensitive=True)) == ["s1", "s2", "s3"]


def test_hidden_rows_do_not_fill_the_window(table):
    df = table(*(statement(k, audience="c", confidence=0.9) for k in range(20)), statement(90, confidence=0.1))
    assert names(graph.top_per_subject(graph.visible(df, ["owner"]), 3)) == ["s90"]


def test_entity_that_is_both_ends_counts_once(spark, table):
    df = table(statement(1, s="a", o="a"), statement(2, s="a", o="b"))
    entities = spark.createDataFrame([("x", "a", "A"), ("x", "b", "B"), ("y", "a", "Z")], "space_id string, entity_id string, name string")
    assert [tuple(r) for r in graph.entities_of_turns(df, entities, ["t"], 9).collect()] == [("A", 2), ("B", 1)]
    assert names(graph.entity_read(df, "a")) == ["s1", "s2"]


def test_combined_read_gives_a_shared_statement_to_the_first_seed(table):
    df = table(statement(1, s="a", o="b"), statement(2, s="b", o="c"))
    assert {(r.statement_id, r.seed) for r in graph.read_combined(df, ["b", "a"], 5).collect()} == {("s1", 0), ("s2", 0)}


def test_replayed_add_does_not_resurrect_and_supersede_leaves_no_gap(table):
    df = table(statement(1, end=3), statement(2, recorded=9))
    assert names(graph.add_triples(df)) == ["s1"]
    out = graph.supersede(table(statement(1, o="x", start=1), statement(2, o="y", start=4)), ["likes"]).collect()
    assert {r.statement_id: r.valid_to for r in out} == {"s1": day(4), "s2": None}


def test_invalidate_closes_open_statements_only(spark, table):
    df = table(statement(1, start=2), statement(2, start=2, end=9), statement(3, start=8))
    ends = spark.createDataFrame([("x", "a", "likes", "b", day(1)), ("x", "a", "likes", "b", day(6)), ("x", "a", "likes", "b", day(5)), ("y", "a", "likes", "b", day(4))], "space_id string, subject_id string, predicate string, object_id string, ended_at timestamp_ntz")
    assert {r.statement_id: r.valid_to for r in graph.invalidate(df, ends, ["owner"]).collect()} == {"s1": day(5), "s2": day(9), "s3": None}


def test_whole_names_then_tails_then_aliases_longest_first(spark):
    phrases = spark.createDataFrame([(1, "x", "Visit new york with BINGO"), (2, "x", ""), (3, "x", None), (4, "y", "new york")], "phrase_id int, space_id string, phrase string")
    entities = spark.createDataFrame([("x", "a", "york"), ("x", "b", "new york"), ("x", "c", ""), ("x", "d", "Visit New"), ("x", "e", "pet:with"), ("x", "f", "dog"), ("x", "g", "tail:")], "space_id string, entity_id string, name string")
    mentions = spark.createDataFrame([("x", "f", "bingo", 0.9, "owner"), ("x", "a", "visit", 0.9, "owner"), ("x", "b", "with", 0.5, "companion:z")], "space_id string, entity_id string, alias string, confidence double, audience string")
    found = lambda **k: [(r.phrase_id, r.name, r.stage) for r in graph.matched_entities(phrases, entities, mentions, ["owner"], **k).orderBy("phrase_id", "rank").collect()]
    assert found(cap=9) == [(1, "new york", 0), (1, "york", 0), (1, "pet:with", 1), (1, "dog", 2)]
    assert found(cap=2) == [(1, "new york", 0), (1, "york", 0)]
    assert found(cap=9, aliases_only=True) == [(1, "dog", 2), (1, "york", 2)]


def test_visibility_fails_closed(spark):
    kind = "id int, wing string, space_id string, privacy string, layer string, visibility string, scope string, session_id string, person_id string, audience string, source_device_id string, target_device_id string"
    base = dict(wing="Wing_Life", space_id="s", privacy=None, layer=None, visibility=None, scope=None, session_id=None, person_id=None, audience=None, source_device_id=None, target_device_id=None)
    changes = [{}, {"wing": "Wing_Privacy"}, {"space_id": "o"}, {"privacy": "DO_NOT_RECALL"}, {"privacy": "private"}, {"visibility": "private"}, {"scope": "session"}, {"scope": "session", "session_id": "x"}, {"person_id": "p"}, {"person_id": ""}, {"audience": "c"}, {"visibility": "current_device"}, {"visibility": "current_device", "source_device_id": "d"}, {"visibility": "current_device", "target_device_id": "d"}]
    df = spark.createDataFrame([(k, *(base | c).values()) for k, c in enumerate(changes)], kind)
    see = lambda c: {r.id for r in df.where(visible(c)).collect()}
    assert see(Caller("s")) == {0, 9}
    assert see(Caller("s", session_id="x", person_id="p", device_id="d", audiences=("owner", "c"))) == {0, 7, 8, 9, 10, 12, 13}
    assert see(Caller("s", audiences=())) == set() and see(Caller("s", layers=("household",))) == set()
    assert see(Caller("s", every_audience=True, include_private=True)) == {0, 4, 5, 6, 7, 8, 9, 10}
    assert df.select(F.max(tier(Caller("s")))).first()[0] == 0.75


def test_fusion_counts_ranks_from_zero_and_lexical_rows_last(spark):
    v = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id int, drawer_id int, similarity double, rank int")
    x = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id int, drawer_id int, rank int")
    out = [(r.drawer_id, r.rrf) for r in retrieval.fuse(v, x, 5).orderBy("rank").collect()]
    assert out == [(11, round(2 / 61, 9)), (10, round(1 / 60, 9)), (12, round(1 / 60, 9))]


def test_bm25_of_an_empty_table(spark):
    none = spark.createDataFrame([], "drawer_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id int, query string")
    assert retrieval.bm25(none, asked, 3).count() == 0


def test_command_status_equals_the_state_machine(spark):
    import random

    dice = random.Random(2)
    events = [(f"r{dice.randrange(60)}", k, dice.choice(["accepted", "retrying", "failed", "applied"])) for k in range(300)]
    state = {}
    for r, _, s in events:
        if r not in state:
            state[r] = s, int(s != "accepted")
            continue
        now, tries = state[r]
        if now == "applied" or now == "failed" and s != "applied" or s == "accepted" and now != "accepted":
            continue
        state[r] = s, tries + (s != "accepted")
    df = spark.createDataFrame(events, "request_id string, seq int, status string")
    assert {r.request_id: (r.status, r.attempts) for r in ledgers.command_status(df).collect()} == state


def test_commitments_reject_forbidden_transitions(spark):
    rows = [(1, "p", (1,), "proposed", "x", day(5)), (1, "p", (2,), "fulfilled", "y", None), (1, "p", (3,), "confirmed", "z", None), (1, "p", (4,), "fulfilled", "x", day(7)), (1, "p", (5,), "proposed", "q", day(9))]
    df = spark.createDataFrame(rows, "commitment_id int, promisor string, place struct<n:int>, status string, participant string, due_at timestamp_ntz")
    r = ledgers.fold_commitments(df).first()
    assert (r.status, r.revision, r.rejected, r.participants, r.due_at) == ("fulfilled", 3, 2, ["x", "z"], day(7))


def test_forgotten_facts_stay_forgotten(spark):
    rows = [("f", "s", 1, "add", "e1"), ("f", "s", 2, "forget", None), ("f", "s", 3, "add", "e2"), ("g", "s", 1, "add", "e1"), ("g", "s", 2, "invalidate", None), ("g", "s", 3, "reactivate", None)]
    df = spark.createDataFrame(rows, "fact_id string, slot string, seq int, kind string, evidence string")
    out = {r.fact_id: (r.state, r.evidence, r.activations) for r in ledgers.fold_facts(df).collect()}
    assert out == {"f": ("forgotten", 2, 2), "g": ("active", 1, 2)}


def test_provisional_budget_skips_but_does_not_stop(spark):
    df = spark.createDataFrame([("g", 5, 20), ("g", 4, 90), ("g", 3, 30), ("g", 2, 51), ("g", 1, 50)], "turn_group string, id long, bytes long")
    assert sorted(r.id for r in ledgers.provisional_sources(df, 5, 100).collect()) == [1, 3, 5]


def test_sync_deliveries_repeat_by_id_or_hash(spark):
    df = spark.createDataFrame([(1, "a", "h1"), (2, "a", "h2"), (3, "b", "h1"), (4, "c", "h3")], "seq int, event_id string, idempotency_hash string")
    assert sorted(r.seq for r in ledgers.first_deliveries(df).collect()) == [1, 4]


def test_forget_candidates_and_scores(spark):
    df = spark.createDataFrame([(1, "Old House!"), (2, "the old house burned"), (3, "hous"), (4, "old"), (5, None)], "id int, text string")
    assert {r.id: r.score for r in browse.forget_candidates(df, "old house").collect()} == {1: 1.0, 2: 0.9, 3: 0.85}


def test_confusion_counts_multisets_and_nothing(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    assert tuple(evaluation.confusion(df("a", "a", "b"), df("a", "c"), ["k"]).first()) == (1, 3, 2, 0.333333, 0.5)
    assert tuple(evaluation.confusion(df(), df(), ["k"]).first()) == (None, None, None, None, None)


def test_ids(spark):
    r = spark.range(1).select(ids.slug(F.lit(" O'Neil Jr ")), ids.content_id("x_", 24, F.lit("a"), F.lit(None))).first()
    assert r[0] == "oneil_jr" and r[1].startswith("x_") and len(r[1]) == 26


def test_vector_candidates_of_more_queries_than_a_block(spark):
    drawers = spark.createDataFrame([(f"d{k}", [float(k), 1.0]) for k in range(20)], "drawer_id string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(q, [float(q % 20), 1.0]) for q in range(600)], "query_id long, v array<double>")
    out = retrieval.vector_candidates(drawers, queries, 2).collect()
    assert len(out) == 1200 and {r.query_id: r.drawer_id for r in out if r["rank"] == 1} == {q: f"d{q % 20}" for q in range(600)}
