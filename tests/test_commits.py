"""Commits over several tables: a run killed at any step leaves the old or the new state; erasing rewrites only what it must."""

import os

import pytest
from pyspark.sql import functions as F

from recallspark.operators import commits
from recallspark.operators.commits import Change, Conflict, Store, append, replace


def frame(spark, rows, kind="k long, v string"):
    return spark.createDataFrame(rows, kind).coalesce(1)


def state(store):
    m = store.manifest()
    return {t: sorted(map(tuple, store.read(t, m).collect())) for t in m["tables"]}


def test_versions_and_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.manifest()["version"] == 0
    store.commit({"a": replace(frame(spark, [(1, "x")])), "b": replace(frame(spark, []))}, "w", 0)
    store.commit({"a": append(frame(spark, [(2, "y")]))}, "w", 1)
    assert state(store) == {"a": [(1, "x"), (2, "y")], "b": []}
    again = store.commit({"a": append(frame(spark, [(2, "y")]))}, "w", 1)
    assert again["version"] == 2 and state(store)["a"] == [(1, "x"), (2, "y")]
    assert sorted(map(tuple, store.read("a", store.manifest(1)).collect())) == [(1, "x")]


@pytest.mark.parametrize("step", range(3))
def test_a_run_killed_at_any_step_leaves_the_old_state_and_can_be_run_again(spark, tmp_path, monkeypatch, step):
    store = Store(spark, str(tmp_path / "s"))
    store.commit({t: replace(frame(spark, [(1, t)])) for t in ("drawers", "statements")})
    before, change = state(store), lambda: {t: replace(frame(spark, [(2, t)])) for t in ("drawers", "statements")}
    done = []

    def killed(real, at):
        def run(*a):
            if len(done) == at:
                raise KeyboardInterrupt
            done.append(1)
            return real(*a)

        return run

    write, publish = Store._write, Store._publish
    monkeypatch.setattr(Store, "_write", killed(write, step))
    monkeypatch.setattr(Store, "_publish", killed(publish, step))
    with pytest.raises(KeyboardInterrupt):
        store.commit(change(), "w", 7)
    assert state(store) == before
    monkeypatch.setattr(Store, "_write", write)
    monkeypatch.setattr(Store, "_publish", publish)
    store.commit(change(), "w", 7)
    store.commit(change(), "w", 7)
    assert state(store) == {t: [(2, t)] for t in ("drawers", "statements")}
    assert store.sweep(keep=1) == 2 + step % 3 and state(store) == {t: [(2, t)] for t in ("drawers", "statements")}


def test_of_two_commits_on_one_base_one_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    base = store.commit({"a": replace(frame(spark, [(1, "x")]))})
    store.commit({"a": append(frame(spark, [(2, "y")]))}, base=base)
    with pytest.raises(Conflict):
        store.commit({"a": append(frame(spark, [(3, "z")]))}, base=base)
    seen = []

    def late(m):
        if not seen:
            seen.append(store.commit({"a": append(frame(spark, [(4, "w")]))}))
        return {"a": append(frame(spark, [(3, "z")]))}

    store.update(late)
    assert state(store)["a"] == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]


def filled(spark, root):
    store = Store(spark, root)
    rows = spark.range(300).select(F.col("id").alias("k"), F.format_string("turn_%d", F.floor(F.col("id") / 3)).alias("turn"), F.lit("text").alias("v"))
    store.commit({"drawers": replace(rows.repartitionByRange(10, "k")), "statements": replace(rows.repartitionByRange(6, "k"))})
    return store, rows


@pytest.mark.parametrize("indexed", [False, True])
def test_erasing_rewrites_only_files_with_the_keys(spark, tmp_path, indexed):
    store, rows = filled(spark, str(tmp_path / "s"))
    if indexed:
        store.index("drawers", "turn")
        store.index("drawers", "turn")
        store.index("statements", "turn")
    before = store.manifest()
    keys = spark.createDataFrame([("turn_1",), ("turn_2",), ("unknown",), (None,)], "turn string")
    made = store.erase({"drawers": ("turn", keys), "statements": ("turn", keys)}, writer="privacy", batch=0)
    for t, many in (("drawers", 10), ("statements", 6)):
        old, new = before["tables"][t]["files"], made["tables"][t]["files"]
        assert len(set(old) & set(new)) == many - 1  # one file held all of them
        assert store.read(t).count() == 294 and not store.read(t).where("turn in ('turn_1', 'turn_2')").count()
    assert store.read("receipts").count() == 4 and "turn_1" not in str(store.read("receipts").collect())
    assert store.erase({"drawers": ("turn", keys)}, writer="privacy", batch=0) == made
    if indexed:
        # files that the bitmaps rule out are not read, so their loss isn't noticed
        store.index("drawers", "turn")
        m = store.manifest()
        one = spark.createDataFrame([("turn_50",)], "turn string")
        hit = store.files_with("drawers", "turn", one, m)
        assert len(hit) == 1
        for f in set(m["tables"]["drawers"]["files"]) - set(hit):
            os.remove(f"{store.root}/{f}")
        assert store.files_with("drawers", "turn", one, m) == hit


def test_snapshots_find_the_changed_file_and_refuse_what_was_forgotten(spark, tmp_path):
    store, _ = filled(spark, str(tmp_path / "s"))
    root = store.snapshot("one")
    assert store.verify("one").count() == 0
    with pytest.raises(Conflict):
        store.snapshot("one")
    store.commit({"drawers": append(store.read("drawers").limit(1))})
    assert store.snapshot("two") != root
    store.restore("one")
    assert store.read("drawers").count() == 300
    store.sweep(keep=1)
    assert store.verify("two").count() == 0  # snapshots keep their files
    held = store.manifest()["tables"]["drawers"]["files"]
    with open(f"{store.root}/{held[3]}", "r+b") as f:
        f.seek(40)
        byte = f.read(1)
        f.seek(40)
        f.write(bytes([byte[0] ^ 1]))
    os.remove(f"{store.root}/{held[5]}")
    crc = f"{store.root}/{os.path.dirname(held[3])}/.{os.path.basename(held[3])}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert {(r["file"], r["fault"]) for r in store.verify("one").collect()} == {(held[3], "changed"), (held[5], "missing")}
    with pytest.raises(RuntimeError):
        store.restore("one")


def test_a_snapshot_from_before_an_erasure_is_stale(spark, tmp_path):
    store, _ = filled(spark, str(tmp_path / "s"))
    store.snapshot("old")
    store.erase({"drawers": ("turn", spark.createDataFrame([("turn_1",)], "turn string"))})
    with pytest.raises(commits.Stale):
        store.restore("old")
    store.snapshot("new")
    store.restore("new")
    assert store.read("drawers").count() == 297


def test_the_tree_has_one_node_for_each_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "FAN", 3)
    store, _ = filled(spark, str(tmp_path / "s"))
    rows = store.tree(store.manifest()).collect()
    top = max(r["level"] for r in rows)
    assert top == 3 and sorted(r["table"] for r in rows if r["level"] == top) == ["drawers", "statements"]
    assert sum(r["level"] == 0 for r in rows) == 16
    assert isinstance(Change().keep, list)
