"""Privacy requests and exact invalidations: outcomes, all tables at once, nothing half done, replays."""

import datetime as dt

import pytest

from recallspark.operators import erasure, graph
from recallspark.operators.commits import Store, replace

AT = dt.datetime(2024, 3, 1)
DRAWERS = "drawer_id long, space_id string, source_turn_id string, privacy string, text string"
STATEMENTS = "statement_id string, space_id string, subject_id string, predicate string, object_id string, audience string, valid_to timestamp_ntz, source_turn_id string"


def filled(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    drawers = [(1, "s", "t1", "normal", "a"), (2, "s", "t2", "normal", "b"), (3, "s", "t3", "normal", "c"), (4, "s", "t3", "normal", "d"), (5, "s", None, "normal", "e"), (6, "s", "canonical:f1", "normal", "f"), (7, "r", "t1", "normal", "g")]
    statements = [(f"x{k}", "s", "ann", "likes", o, "owner", end, t) for k, (o, end, t) in enumerate([("tea", None, "t1"), ("ale", AT, "t2"), ("gin", None, "t2"), ("rum", None, "t3"), ("tea", None, "t9")])] + [("y", "r", "ann", "likes", "tea", "owner", None, "t1")]
    store.commit({
        "drawers": replace(spark.createDataFrame(drawers, DRAWERS)), "statements": replace(spark.createDataFrame(statements, STATEMENTS)), "facts": replace(spark.createDataFrame([], "space_id string, source_turn_id string, erased boolean")),
        "receipts": replace(spark.createDataFrame([], "table string, receipt string")), "ledger": replace(spark.createDataFrame([], "fact_id string, intent_id string, kind string, result string")),
    })
    return store


def state(store):
    m = store.manifest()
    return {t: sorted((tuple(r) for r in store.read(t, m).collect()), key=str) for t in m["tables"]}


def asked(spark):
    return spark.createDataFrame([("one", "delete", 1), ("one", "delete", 1), ("many", "delete", 2), ("many", "delete", 3), ("topic", "archive_topic", 5), ("last", "delete", 4), ("both", "delete", 3)], "target string, action string, drawer_id long")


def test_an_ambiguous_delete_is_archived(spark):
    out = {(r["target"], r["drawer_id"]): (r["outcome"], r["downgraded"]) for r in erasure.privacy_outcomes(asked(spark)).collect()}
    assert out == {("one", 1): ("erase", False), ("many", 2): ("archive", True), ("many", 3): ("archive", True), ("both", 3): ("archive", True), ("topic", 5): ("archive", False), ("last", 4): ("erase", False)}


def test_privacy_requests_take_effect_everywhere_at_once(spark, tmp_path, monkeypatch):
    store = filled(spark, tmp_path)
    before, run = state(store), lambda: erasure.privacy_requests(store, asked(spark), graph.time("2024-03-02T00:00:00"), "privacy", 3)
    real, told = Store._write, []

    def killed(self, table, rows):
        told.append(table)
        if len(told) == 3:
            raise KeyboardInterrupt
        return real(self, table, rows)

    monkeypatch.setattr(Store, "_write", killed)
    with pytest.raises(KeyboardInterrupt):
        run()
    assert state(store) == before
    monkeypatch.setattr(Store, "_write", real)
    run()
    run()
    now = state(store)
    assert {r[0]: r[3] for r in now["drawers"]} == {2: "do_not_recall", 3: "do_not_recall", 5: "do_not_recall", 6: "normal", 7: "normal"}
    # t1 is erased in its own space; t3 is shared with a drawer that stays, so it only ends, as does t2
    assert {r[0]: (r[6] and r[6].day) for r in now["statements"]} == {"x1": 1, "x2": 2, "x3": 2, "x4": None, "y": None}
    assert now["facts"] == [("s", "t1", True)] and len(now["receipts"]) == 3


def test_exact_invalidations_end_one_triple(spark, tmp_path):
    store = filled(spark, tmp_path)
    asks = spark.createDataFrame([("s", "ann", "likes", "tea", "owner", AT, "f1", "i1"), ("s", "ann", "likes", "tea", "owner", AT, "f1", "i1")], "space_id string, subject_id string, predicate string, object_id string, audience string, ended_at timestamp_ntz, fact_id string, intent_id string")
    erasure.exact_invalidations(store, asks, "steward", 0)
    now = state(store)
    assert {r[0] for r in now["statements"] if r[6] is None} == {"x2", "x3", "y"}
    assert [r[0] for r in now["drawers"] if r[3] == "do_not_recall"] == [6] and now["ledger"] == [("f1", "i1", "invalidate", "invalidated")]
    erasure.exact_invalidations(store, asks, "steward", 1)
    assert state(store) == now
