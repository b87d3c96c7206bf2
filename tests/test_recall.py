"""Budgets, previews, confirmations, forgetting, embedders, stewards, stores, and what words and renderings look like."""

import pytest
from pyspark.sql import functions as F

from recallspark.functions import text
from recallspark.operators import canonical, graph, recall, retrieval, storage, visibility
from recallspark.sources import views

SF = "/root/testdata/sf0.001"


def test_tokens_of_scripts_without_blanks(spark):
    out = spark.createDataFrame([("我喜欢铁锤 Iron-Hammer 2x, é",)], "t string").select(retrieval.tokens(F.col("t")).alias("w")).first().w
    assert out == ["我", "喜", "欢", "铁", "锤", "iron-hammer", "2x", ",", "é"]


def test_render_has_facts_themes_and_groups_in_order(spark):
    kind = "query_id int, place int, wing string, memory_type string, text string, memory_time timestamp_ntz"
    rows = [(1, k, "Wing_Work", "work", f"job {k}", None) for k in range(6)] + [(1, 9, "Wing_Theme", "theme", "t" * 250, None), (1, 10, "Wing_Health", "health", "fit", None), (1, 11, "Wing_Event", "event", "trip", None)]
    facts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id int, ordinal int, line string")
    frame = spark.createDataFrame(rows, kind).withColumn("memory_time", F.when(F.col("place") == 10, F.lit("2024-03-05 10:00:00").cast("timestamp_ntz")))
    out = retrieval.render(frame, facts).first().context
    assert out == "- a\n- b\n\n[主题]\n- " + "t" * 200 + "…\n\n个人画像与健康:\n- [2024-03-05] fit\n工作学习:\n- job 0\n- job 1\n- job 2\n- job 3\n生活方式与近况:\n- trip"


def test_sentences(spark):
    ask = [("self", "owns", "pet:铁锤"), ("pet:铁锤", "holds_role", "柯基"), ("mother:张丽", "holds_role", "医生"), ("a b:c", "invented", "{o}"), ("self", "likes", "{s}")]
    df = spark.createDataFrame(ask, "s string, p string, o string")
    assert [r.x for r in df.select(text.fact_sentence(F.col("s"), F.col("p"), F.col("o")).alias("x")).collect()] == ["用户 拥有 铁锤", "铁锤 的品种/身份是 柯基", "张丽 的角色/身份是 医生", "a b:c invented {o}", "用户 喜欢 {s}"]
    day = lambda t: F.lit(t).cast("timestamp_ntz")
    line = lambda p, a, b, r: spark.range(1).select(text.transcribed(F.lit("self"), F.lit(p), F.lit("x"), day(a), day(b), day(r)).alias("x")).first().x
    assert line("promised", "2024-01-01", "2024-02-03 15:00:00", "2024-01-09") == "（推测）用户 承诺 x（截至 2024-02-03 15:00）"
    assert line("likes", "2015-06-01", None, "2024-01-09") == "（推测）用户 喜欢 x（自 2015-06-01；根据 2024-01 的对话）"
    assert line("likes", None, "2024-02-03", None) == "（推测）用户 喜欢 x（？ → 2024-02-03，已结束）"


def test_companions_do_not_end_each_others_facts(spark):
    kind = "statement_id string, space_id string, subject_id string, predicate string, object_id string, audience string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, source_turn_id string, projection_id string"
    at = __import__("datetime").datetime
    row = lambda k, space, audience, turn="t", end=None, p=None: (k, space, "a", "likes", "b", audience, at(2024, 1, 1), end, at(2024, 1, int(k)), turn, p)
    df = spark.createDataFrame([row("1", "s0", "owner"), row("2", "s0", "companion:x"), row("3", "s1", "owner"), row("4", "s0", "owner", "t2"), row("5", "s1", "owner", "t2", None, "p"), row("6", "s1", "companion:x", "t3", None, "p")], kind)
    assert sorted(r.statement_id for r in graph.add_triples(df).collect()) == ["1", "2", "3"]
    assert [r.statement_id for r in graph.projection_conflicts(df).collect()] == ["6"]
    ends = spark.createDataFrame([("s0", "a", "likes", "b", at(2024, 3, 1))], "space_id string, subject_id string, predicate string, object_id string, ended_at timestamp_ntz")
    closed = {r.statement_id for r in graph.invalidate(df, ends, ["owner"]).where("valid_to is not null").collect()}
    assert closed == {"1", "4"}


def test_budget_degrades_and_restores(spark):
    assert recall.within(spark.range(3), 60) == ([(0,), (1,), (2,)], False)
    slow = spark.range(4).select(F.pandas_udf(lambda x: __import__("time").sleep(30) or x, "long")("id"))
    assert recall.within(slow, 1.0) == ([], True)
    assert recall.owner_view(visibility.Caller("s", ())).every_audience


def test_previews_are_refused_rather_than_cut(spark):
    rows = spark.createDataFrame([(k, f"Green tea {k}") for k in range(5)], "drawer_id int, text string")
    assert recall.forget_preview(rows, "green TEA").count() == 5
    for limits, phrase in (({"most": 4}, "green tea"), ({"scanned": 4}, "green tea"), ({}, "!x")):
        with pytest.raises(ValueError):
            recall.forget_preview(rows, phrase, **limits)


def test_confirmations():
    token = recall.confirmation(b"k", "s0", {"drawers": ["b", "a", "b"]}, 1000)
    assert recall.confirmed(b"k", "s0", token, 1500) == {"drawers": ["a", "b"]}
    for secret, space, now, change in ((b"x", "s0", 1500, ""), (b"k", "s1", 1500, ""), (b"k", "s0", 1601, ""), (b"k", "s0", 1500, "A")):
        with pytest.raises(ValueError):
            recall.confirmed(secret, space, token + change, now)
    with pytest.raises(recall.TooMany):
        recall.confirmation(b"k", "s0", {"drawers": [str(k) for k in range(101)]}, 0)


def test_forgetting_reaches_every_store(spark):
    turns = spark.createDataFrame([("turn_1",), ("turn_2",)], "source_turn_id string")
    events = views.canonical_events(spark, SF)
    fact = events.where("kind = 'add'").first().fact_id
    out = recall.forgotten(events, views.statements(spark, SF), views.entities(spark, SF), views.drawers(spark, SF), turns, spark.createDataFrame([(fact,)], "fact_id string"))
    assert out["statements"].where("source_turn_id in ('turn_1', 'turn_2')").count() == out["drawers"].where("source_turn_id in ('turn_1', 'turn_2')").count() == 0
    left = out["ledger"].where(F.col("fact_id") == fact).collect()
    assert left and all(r.kind == "forget" for r in left)
    ends = {e for r in out["statements"].select("subject_id", "object_id").collect() for e in r}
    assert {r.entity_id for r in out["entities"].collect()} <= ends
    assert out["receipts"].count() == views.drawers(spark, SF).join(turns, "source_turn_id").count() + 1
    assert {r.source for r in canonical.sources_of_forgotten(out["ledger"]).collect()}.isdisjoint({None})


def test_embedders_and_stewards(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "c")], "turn_id int, user_text string")
    out = {r.turn_id: r.embedding for r in recall.embedded(rows, lambda texts: [[float(len(t)), 0.0] for t in texts], "user_text", 2).collect()}
    assert out == {1: [2.0, 0.0], 2: None, 3: [1.0, 0.0]}
    assert [(r.turn_id, r.content) for r in recall.decide(rows, "verbatim").orderBy("turn_id").collect()] == [(1, "ab"), (3, "c")]
    assert recall.decide(rows, "noop").count() == 0


def test_appends_receipts_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "drawer_id string, n int")
    path = str(tmp_path / "store")
    assert [storage.append_verified(rows, path, "drawer_id", ["n"]) for _ in range(2)] == [2, 0]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 1)]
    storage.append_receipts(rows, str(tmp_path / "receipts"))
    assert spark.read.json(str(tmp_path / "receipts")).count() == 3
    tables, folder = {"rows": (rows, ["drawer_id", "n"])}, str(tmp_path / "snapshot")
    storage.write_snapshot(tables, folder)
    assert storage.verify_snapshot(spark, {"rows": ["drawer_id", "n"]}, folder).count() == 0
    rows.limit(1).write.mode("append").parquet(f"{folder}/rows")
    assert [r.fault for r in storage.verify_snapshot(spark, {"rows": ["drawer_id", "n"]}, folder).collect()] == ["changed"]
    assert storage.registry(spark, [{"realm": "r1", "owner": "o"}, {"realm": "r1"}, {"realm": " "}]).count() == 1


def test_extension_policies_can_be_registered(spark):
    text.register_policy("mood", lambda found, query: F.when(F.contains(query, found["mood"]["word"]), F.lit(0.5)).otherwise(F.lit(0.0)))
    try:
        raw = '{"mood": {"word": "glad"}, "Bad": {"x": "1"}, "note": "text"}'
        row = spark.createDataFrame([(raw,), ("no json",), (None,)], "e string").select(text.extensions(F.col("e")).alias("f")).select("f", text.boosts(F.col("f"), F.lit("so glad")).alias("b")).collect()
        assert row[0].f == {"mood": {"word": "glad"}} and [r.b for r in row] == [0.5, 0.0, 0.0] and row[1].f == {}
    finally:
        del text.POLICIES["mood"]


def test_cursors(spark):
    made = spark.range(1).select(text.cursor(F.lit("2024-01-02T03:04:05"), F.lit("a/ü\"+")).alias("c"))
    assert made.select(text.cursor_parts(F.col("c")).alias("p")).first().p == ["2024-01-02T03:04:05", "a/ü\"+"]
    assert spark.range(1).select(text.cursor_parts(F.lit("x" * 1025)).alias("p")).first().p is None
