"""Registration, decisions and commitments in full; ontology; spoken recalls within budgets; names and pooling."""

import time

import pytest
from pyspark.sql import functions as F

from recallspark.functions import text
from recallspark.operators import browse, canonical, ledgers, ontology, recall


def test_registering_facts(spark):
    kind = "space_id string, audience string, subject_id string, predicate string, object_id string, seq long, op string, intent_id string, payload string, single boolean"
    events = [("register", "home", "i1", "a"), ("register", "home", "i1", "a"), ("register", "home", "i1", "b"), ("register", "away", "i2", "c"), ("register", "home", "i3", "d"), ("invalidate", "home", None, None), ("register", "home", "i4", "e"),
              ("register", "away", "i5", "f"), ("invalidate", "none", None, None), ("forget", "home", None, None), ("register", "home", "i1", "a"), ("forget", "home", None, None)]
    rows = [("s", "owner", "ann", "lives_in", o, k, op, i, p, True) for k, (op, o, i, p) in enumerate(events)] + [("s", "owner", "ann", "likes", o, k, op, i, p, False) for k, (op, o, i, p) in enumerate(events[:5])]
    out = canonical.registered(spark.createDataFrame(rows, kind).repartition(3)).orderBy("predicate", "seq").collect()
    assert [r["outcome"] for r in out if r["predicate"] == "lives_in"] == ["created", "replay", "evidence conflict", "slot conflict", "evidence", "invalidated", "inactive", "created", "none", "erased", "forgotten", "none"]
    assert [r["outcome"] for r in out if r["predicate"] == "likes"] == ["created", "replay", "evidence conflict", "created", "evidence"]
    assert [r["evidence"] for r in out if r["predicate"] == "likes"] == [1, 1, 1, 1, 2]
    assert canonical.registered(spark.createDataFrame([], kind)).count() == 0


def test_forgetting_escalates_and_marks_count_after_requests(spark):
    rows = [("a", 1, "mark", None, None, ["kg"]), ("a", 2, "begin", False, "soft", ["drawer"]), ("a", 3, "mark", None, None, ["drawer", "kg"]), ("a", 4, "begin", True, "hard", ["drawer", "kg"]), ("b", 1, "begin", True, "x", ["kg"]), ("b", 2, "mark", None, None, ["kg"]), ("b", 3, "begin", False, "y", ["kg"]), ("c", 1, "mark", None, None, ["kg"])]
    out = canonical.fold_forgets(spark.createDataFrame(rows, "k string, seq long, op string, hard boolean, reason string, targets array<string>"), "k").orderBy("k").collect()
    assert [tuple(r) for r in out] == [("a", True, "hard", "projected", "pending", True, False), ("b", True, "x", "not_required", "projected", True, True)]


def test_decisions_with_tombstones_and_attribution(spark):
    kind = "space_id string, turn_id string, version string, seq long, input_hash string"
    rows = [("s", "t1", "v1", 1, "a"), ("s", "t1", "v1", 2, "a"), ("s", "t1", "v1", 3, "b"), ("s", "t1", "v2", 4, "b"), ("s", "t1", "prov", 5, "a"), ("s", "t2", "prov", 6, "a"), ("s", "t2", "v1", 7, "a"), ("s", "t2", "prov", 8, "a"), ("s", "t3", "v1", 9, "a"), ("s", "t3", "v1", 11, "a"), ("r", "t3", "v1", 12, "a")]
    stones = spark.createDataFrame([("s", "t3", 10)], "space_id string, turn_id string, seq long")
    out = ledgers.decided(spark.createDataFrame(rows, kind), stones, "prov").orderBy("seq").collect()
    assert [r["outcome"] for r in out] == ["stored", "replay", "input conflict", "stored", "attribution conflict", "stored", "attribution conflict", "replay", "stored", "redacted", "stored"]


def test_commitments_keep_their_identity_and_condition(spark):
    kind = "commitment_id long, place long, status string, participant string, condition string, due_at string, promisor string, action string"
    rows = [(1, 1, "proposed", "a", "if dry", None, "ann", "paint"), (1, 2, "confirmed", "b", None, "may", "ann", "paint"), (1, 3, "cancelled", "c", None, None, "bob", "paint"), (1, 4, "confirmed", "d", "if warm", None, "ann", "paint"), (1, 5, "fulfilled", "e", None, None, "ann", "paint"), (1, 6, "proposed", "f", "no", "june", "ann", "paint")]
    r = ledgers.applied_commitments(spark.createDataFrame(rows, kind), ["promisor", "action"]).first()
    assert (r["status"], r["revision"], r["rejected"], r["strangers"], r["participants"], r["condition"], r["due_at"]) == ("fulfilled", 4, 1, 1, ["a", "b", "d", "e"], "if warm", "may")


def test_the_ontology_has_32_predicates(spark):
    rows = ontology.registry(spark).collect()
    assert len(rows) == len({r["predicate"] for r in rows}) == 32
    intents = [("a", "lives_in", "b", "", None), ("a", "lives_in", "b", "auto", "profile"), ("a", "lives_in", "b", "Wing_Work", ""), ("a", "lives_in", "b", "", "work"), ("a", "flies", "b", "", ""), (None, None, None, "Wing_Life", "life"), (None, None, None, "auto", "life"), ("a", "likes", "", "Wing_Life", "x")]
    out = ontology.placed(spark.createDataFrame([(k, *i) for k, i in enumerate(intents)], "k int, subject string, predicate string, object string, wing string, memory_type string")).orderBy("k").collect()
    assert [(r["to_wing"], r["to_type"], r["error"]) for r in out] == [("Wing_Profile", "profile", None), ("Wing_Profile", "profile", None), (None, None, "wing conflicts"), (None, None, "type conflicts"), (None, None, "unsupported predicate"), ("Wing_Life", "life", None), (None, None, "needs wing and type"), ("Wing_Life", "x", None)]


def test_spoken_recalls_keep_their_budgets(spark):
    @F.udf("long")
    def slow(x):
        time.sleep(4)
        return x

    quick, late = spark.range(2), spark.range(1).select(slow("id").alias("id"))
    broken = spark.range(1).select(F.raise_error(F.lit("no store")).alias("id"))
    render = lambda rows, said: f"{len(rows)} records, {len(said)} facts"
    quick.collect()
    whole = recall.voice(quick, quick, render, 20, 20)
    assert whole["context"] == "2 records, 2 facts" and not whole["degraded"] and whole["facts_reason"] is None
    start = time.time()
    cut = recall.voice(quick, late, render, 20, 0.5)
    assert cut["context"] == "2 records, 0 facts" and not cut["degraded"] and cut["facts_reason"] == "timeout" and time.time() - start < 15
    lost = recall.voice(late, quick, render, 0.5, 0.4)
    assert lost["context"] == "" and lost["degraded"] and lost["reason"] == "timeout"
    failed = recall.voice(broken, None, render, 20, 20)
    assert failed["degraded"] and "no store" in failed["reason"]


def test_owner_tree_counts_what_is_withheld(spark):
    rows = spark.createDataFrame([(1, "A", "x", True), (2, "B", "x", True), (3, "A", "x", False), (4, "Z", "y", True), (5, "A", "x", True)], "drawer_id long, wing string, room string, open boolean")
    out = browse.owner_tree(rows, F.col("open"), ["B", "A"], 1, 4).orderBy("place").collect()
    assert [(r["wing"], r["drawers"], r["titles"], r["more"]) for r in out] == [("B", 1, [2], False), ("A", 1, [1], False), ("Z", 1, [4], False)]
    assert {(r["entry_count"], r["withheld_count"], r["truncated"]) for r in out} == {(3, 1, True)}


@pytest.mark.parametrize(("value", "name"), [("a.b:c", "a_b_c"), ("__x__", "x"), ("...", "default"), (None, "default"), ("ab-c_D9", "ab-c_D9")])
def test_safe_names(spark, value, name):
    assert spark.createDataFrame([(value,)], "v string").select(text.safe_name(F.col("v"))).first()[0] == name


def test_long_names_and_pooling(spark):
    long = spark.createDataFrame([("x" * 300,)], "v string").select(text.safe_name(F.col("v"))).first()[0]
    assert len(long) == 180 and long.startswith("x" * 163 + "_")
    rows = spark.createDataFrame([([[3.0, 4.0], [0.0, 2.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 0.0]], [0]), ([], [])], "h array<array<double>>, m array<int>")
    out = rows.select(text.pooled(F.col("h"), F.col("m")).alias("mean"), text.pooled(F.col("h"), F.col("m"), "cls").alias("cls")).collect()
    assert [round(x, 6) for x in out[0]["mean"]] == [round(1.5 / 11.25**0.5, 6), round(3 / 11.25**0.5, 6)] and out[0]["cls"] == [0.6, 0.8]
    assert out[1]["mean"] is None and out[1]["cls"] == [1.0, 0.0] and out[2]["mean"] is None and out[2]["cls"] is None
