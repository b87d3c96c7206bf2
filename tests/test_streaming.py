"""Streams end in the state of the batch folds, also after a restart and a repeated delivery."""

import json

from pyspark.sql import functions as F

from recallspark.operators import canonical, graph, ledgers
from recallspark.sources import views
from recallspark.streaming import folds

SF = "/root/testdata/sf0.001"


def test_refold_equals_batch(spark, tmp_path):
    events = views.command_events(spark, SF).drop("ts").repartition(6)
    source, table, out, mark = (str(tmp_path / x) for x in ("in", "table", "out", "mark"))
    half = events.where("seq % 2 = 0")
    half.write.parquet(source)
    run = lambda: folds.refold(spark, folds.read_events(spark, source, events.schema, 2), ledgers.command_status, "request_id", table, out, mark).awaitTermination()
    run()
    events.where("seq % 2 = 1").write.mode("append").parquet(source)
    run()
    run()
    want = ledgers.command_status(events)
    assert sorted(map(tuple, spark.read.parquet(out).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_first_arrivals_drop_repeats(spark, tmp_path):
    events = views.sync_events(spark, SF).withColumn("at", views.F.col("ts").cast("timestamp")).select("event_id", "at")
    twice = events.unionByName(events)
    twice.write.parquet(str(tmp_path / "in"))
    stream = folds.first_arrivals(folds.read_events(spark, str(tmp_path / "in"), twice.schema), ["event_id"], "at", "400 days")
    folds.append_events(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("event_id").distinct().count() == events.select("event_id").distinct().count()


def test_a_replayed_add_does_not_resurrect(spark, tmp_path):
    """An add that comes again after the invalidation of its fact, in a later batch, leaves it invalidated."""
    kind = "fact_id string, slot string, seq long, kind string, result string, intent_id string, source string, applied boolean, drawer string, kg string, ts timestamp"
    add = ("f", "s", 1, "add", None, "i1", "t1", True, "projected", "projected", None)
    end = ("f", "s", 2, "invalidate", "invalidated", "i2", "t2", True, "projected", "projected", None)
    source, table, out, mark = (str(tmp_path / x) for x in ("in", "table", "out", "mark"))
    for rows in ([add, end], [("f", "s", 3, *add[3:])], [("g", "s", 4, *add[3:])]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(source)
        stream = folds.read_events(spark, source, spark.createDataFrame([], kind).schema)
        folds.refold(spark, stream, canonical.fold, "fact_id", table, out, mark).awaitTermination()
    got = {r.fact_id: (r.state, r.evidence) for r in spark.read.parquet(out).collect()}
    assert got == {"f": ("invalidated", 1), "g": ("active", 1)}


def messages(spark):
    turn = lambda k, space="s0", layer="personal", person="p": json.dumps({"kind": "conversation_turn", "payload": json.dumps({"turn_id": f"t{k}", "memory_space_id": space, "layer": layer, "person_id": person, "user_text": f"text {k}"})})
    rows = [turn(0), turn(1), turn(2, space="s1"), turn(3, layer="household"), turn(4, person=None), "{broken", json.dumps({"kind": "device_sync", "payload": "[]"}), turn(7)]
    return spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "message_id int, value string")


def test_misrouted_and_failing_messages_become_dead_letters(spark, tmp_path):
    source, done, retry, dead, mark = (str(tmp_path / x) for x in ("in", "done", "retry", "dead", "mark"))
    seen = []
    for k in range(4):
        part = messages(spark) if not k else messages(spark).where("message_id = 0").withColumn("message_id", F.lit(100 + k))
        part.write.mode("append").parquet(source)
        routed = folds.turns_of(folds.read_events(spark, source, part.schema), "s0", "personal").select("message_id", "turn_id", "route", "error")
        folds.consume(routed, lambda rows: rows.withColumn("failed", F.col("message_id") == 7), done, retry, dead, mark, audit=lambda out, n: seen.append((n, out.count()))).awaitTermination()
    rows = {r.message_id: (r.error, r.attempt) for r in spark.read.parquet(dead).collect()}
    assert rows == {3: ("wrong layer or nobody", 0), 4: ("wrong layer or nobody", 0), 5: ("unreadable", 0), 7: ("failed", 3)}
    assert sorted(r.message_id for r in spark.read.parquet(done).collect()) == [0, 1, 101, 102, 103]
    assert seen == [(0, 3), (1, 2), (2, 2), (3, 1)]


def test_synced_turns_count_once(spark):
    sync = lambda *pairs: json.dumps([{"event_id": e, "idempotency_hash": h, "user_text": e} for e, h in pairs])
    rows = spark.createDataFrame([(1, sync(("a", "x"), ("b", "y"))), (2, sync(("a", "z"), ("c", "x"), ("d", "w"))), (3, None)], "seq int, payload string")
    assert sorted(r.event_id for r in folds.synced_turns(rows).collect()) == ["a", "b", "d"]


def test_consolidation_is_idempotent(spark, tmp_path):
    drawers, out = views.drawers(spark, SF), str(tmp_path / "themes")
    now = graph.time("2024-02-01T00:00:00")
    first = folds.consolidate(drawers, out, now)
    assert first > 0 and folds.consolidate(drawers, out, now) == 0 and spark.read.parquet(out).count() == first


def test_progress_is_observed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n int, key string")
    rows.write.parquet(str(tmp_path / "in"))
    gauge = folds.Progress()
    spark.streams.addListener(gauge)
    try:
        folds.append_events(folds.observed(folds.read_events(spark, str(tmp_path / "in"), rows.schema), "seen", "key"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        for _ in range(50):
            if gauge.observed:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(gauge)
    assert gauge.observed["seen"] == {"rows": 2, "without_key": 1}
