"""Keyed stream state: out-of-order and replayed batches equal the batch fold; retries end without new input."""

import datetime as dt
import json
import random
import time

import pytest

from recallspark.streaming import folds, keyed

FACT = "space_id string, subject_id string, predicate string, object_id string, audience string"
KIND = f"{FACT}, seq long, op string, statement_id string, turn_id string, at timestamp_ntz"


@pytest.fixture()
def keyed_spark(spark):
    before = spark.conf.get(keyed.PROVIDER, None)
    spark.conf.set(keyed.PROVIDER, keyed.ROCKSDB)
    yield spark
    spark.conf.set(keyed.PROVIDER, before) if before else spark.conf.unset(keyed.PROVIDER)


def events(n=160):
    dice = random.Random(8)
    return [("s", f"u{dice.randrange(3)}", "likes", f"o{dice.randrange(4)}", "owner", k, dice.choice(["add", "add", "add", "invalidate"]), f"x{k}", dice.choice([None, "", *(f"t{j}" for j in range(6))]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)) for k in range(n)]


def told(rows):
    return sorted((tuple(r[:5]), tuple(r[5:])) for r in rows)


def test_a_replay_does_not_resurrect_and_only_one_is_open():
    day = lambda n: dt.datetime(2024, 1, n)
    log = [("add", "a", "t1", day(1)), ("add", "b", "t2", day(2)), ("invalidate", "c", None, day(3)), ("add", "d", "t1", day(4)), ("add", "e", "t2", day(5)), ("invalidate", "f", None, day(6)), ("invalidate", "g", None, day(7)), ("add", "h", None, day(8))]
    assert keyed.statements_of(log) == [["a", day(1), day(3)], ["e", day(5), day(6)], ["h", day(8), None]]


def test_every_order_of_arrival_ends_in_the_batch_fold(keyed_spark, tmp_path):
    spark, rows = keyed_spark, events()
    want = told(tuple(r) for r in keyed.statement_log(spark.createDataFrame(rows, KIND)).collect())
    by = {}
    for r in sorted(rows, key=lambda r: r[5]):
        by.setdefault(r[:5], []).append(r[6:])
    assert want == told((*f, *s) for f, log in by.items() for s in keyed.statements_of(log))
    dice = random.Random(1)
    mixed = rows + dice.sample(rows, 60)
    dice.shuffle(mixed)
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    changed = []
    for part in (mixed[:90], mixed[90:91], mixed[91:]):
        spark.createDataFrame(part, KIND).coalesce(2).write.mode("append").parquet(source)
        stream = keyed.fold_statements(folds.read_events(spark, source, spark.createDataFrame([], KIND).schema))
        keyed.keep_changes(stream, out, mark).awaitTermination()
        changed.append(spark.read.parquet(out).count() - sum(changed))
    assert changed[1] <= 1  # a batch of one event touches one fact
    last = keyed.latest(spark, out, keyed.FACT).selectExpr(*keyed.FACT, "inline(statements)")
    assert told(tuple(r) for r in last.collect()) == want


def test_first_by_key_across_batches(keyed_spark, tmp_path):
    spark = keyed_spark
    kind = "event_id string, seq long"
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in ([("a", 2), ("a", 1), ("b", 3)], [("a", 0), ("c", 4)], [("c", 4)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        stream = keyed.first_by(folds.read_events(spark, source, spark.createDataFrame([], kind).schema), "event_id")
        folds.append_events(stream, out, mark).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_synced_turns_count_once_over_batches(keyed_spark, tmp_path):
    spark = keyed_spark
    sync = lambda *pairs: json.dumps([{"event_id": e, "idempotency_hash": h, "user_text": e} for e, h in pairs])
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in ([(1, sync(("a", "x"), ("b", "y"))), (3, None)], [(2, sync(("a", "z"), ("c", "x"), ("d", "w")))], [(4, sync(("e", "w"), ("f", "v"))), (5, "{broken")]):
        spark.createDataFrame(part, "seq int, payload string").coalesce(1).write.mode("append").parquet(source)
        stream = keyed.synced(folds.read_events(spark, source, spark.createDataFrame([], "seq int, payload string").schema))
        folds.append_events(stream, out, mark).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "d", "f"]


def test_a_failing_message_is_dead_without_new_input(keyed_spark, tmp_path):
    spark = keyed_spark
    kind = "subject string, seq long, message_id string, payload string"
    rows = [("s0", 2, "m2", "bad"), ("s0", 1, "m1", "good"), ("s1", 3, "m3", "raises"), ("s1", 4, "m4", "good"), ("s1", 5, "m5", "second")]
    tries = str(tmp_path / "tries")

    def attempt(message):
        with open(f"{tries}-{message.message_id}", "a") as f:
            f.write("x")
        if message.payload == "raises":
            raise RuntimeError("no answer")
        if message.payload == "second":
            with open(f"{tries}-{message.message_id}") as f:
                return None if len(f.read()) > 1 else "not yet"
        return "refused" if message.payload == "bad" else None

    for k in keyed.SUBJECTS[:2]:
        spark.createDataFrame(rows if k == "conversation_turn" else rows[1:2], kind).coalesce(1).write.parquet(str(tmp_path / k))
    schema = spark.createDataFrame([], kind).schema
    running = keyed.run_subjects(lambda k: folds.read_events(spark, str(tmp_path / k), schema), {k: attempt for k in keyed.SUBJECTS[:2]}, str(tmp_path / "out"), str(tmp_path / "mark"), every="200 milliseconds", wait_ms=300)
    try:
        for _ in range(300):
            time.sleep(0.2)
            assert not any(q.exception() for q in running.values())
            try:
                found = {r.message_id: (r.outcome, r.attempts, r.error) for r in spark.read.parquet(str(tmp_path / "out/conversation_turn")).collect()}
                other = spark.read.parquet(str(tmp_path / "out/memory_command")).collect()
            except Exception:
                continue
            if len(found) == 5 and other:
                break
    finally:
        for q in running.values():
            q.stop()
    assert found == {"m1": ("done", 1, None), "m4": ("done", 1, None), "m5": ("done", 2, None), "m2": ("dead", 3, "refused"), "m3": ("dead", 3, "RuntimeError: no answer")}
    assert [r.message_id for r in other] == ["m1"]


def test_deadlines_end_retries(keyed_spark, tmp_path):
    spark = keyed_spark
    kind = "subject string, seq long, message_id string, payload string"
    spark.createDataFrame([("s", 1, "m", "bad")], kind).write.parquet(str(tmp_path / "in"))
    stream = keyed.deliver(folds.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema), lambda m: "refused", deliveries=50, wait_ms=200, deadline_ms=100)
    running = keyed.keep_changes(stream, str(tmp_path / "out"), str(tmp_path / "mark"), once=False, every="200 milliseconds")
    try:
        found = []
        for _ in range(100):
            time.sleep(0.2)
            assert not running.exception()
            try:
                found = spark.read.parquet(str(tmp_path / "out")).collect()
            except Exception:
                continue
            if found:
                break
    finally:
        running.stop()
    assert [(r.outcome, r.attempts) for r in found] == [("dead", 1)]


def test_the_state_store_is_asked_for(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        keyed.require(spark)
