"""Mixing of sources: quotas against listed quotients, targets against stepwise resharing, takes against the words they name."""

import random

from pyspark.sql import functions as F

from recallspark.llm import mixing
from recallspark.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets as the contract words it: shares by weight, those above their bound cut, the excess reshared until none is above."""
    total, names = sum(sizes.values()) * share, sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed = {}
    while True:
        left, of = total - sum(fixed.values()), sum(w for s, w in weight.items() if s not in fixed)
        got = {s: left * weight[s] / of for s in names if s not in fixed} if of else {}
        over = {s: most * sizes[s] for s, x in got.items() if x > most * sizes[s] + 1e-9}
        if not over:
            return fixed | got
        fixed |= over


def check(mix, docs, slack=8):
    sizes = {}
    for r in docs:
        sizes[r[2]] = sizes.get(r[2], 0) + len(words(r[1]))
    want, taken = reshared(sizes), dict.fromkeys(sizes, 0)
    assert len(mix) == len(docs)
    for r in mix:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        taken[r["source"]] += r["taken"]
        held = sorted((s["start"], s["end"]) for s in r["spans"])
        assert all(a[1] <= b[0] for a, b in zip(held, held[1:])) and all(0 <= a < b <= r["size"] for a, b in held)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack, (s, taken[s], want[s])


def rows_of(dice):
    made = [(k, " ".join(dice.choice("abcdefg") for _ in range(dice.choice([0, 1, 5, 40, 300]))), dice.choice(["a", "b", "é", "z", None, "hot", "hot", "hot"])) for k in range(300)]
    made += [(None, "x y z", "hot")] * 40 + [(7, made[7][1], made[7][2])] * 3 + [(7, "other words here", "b"), (900, None, "a"), (901, " \t\n", "nothing"), (902, "w " * 9000, "long"), (903, "one", "tiny")]
    return made


def test_a_mix_meets_its_targets_and_agrees_with_reruns(spark):
    rows = rows_of(random.Random(3))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, taken int, spans int")
    out = mixing.mixed(docs, block=8, shard=700).cache()
    check(out.collect(), rows)
    key = ["doc_id", "source", "key", "copy", "taken", "repeats", "spans"]
    again = mixing.mixed(docs.repartition(7, "text"), block=8, shard=700).select(*key)
    assert out.select(*key).exceptAll(again).count() == 0
    said = {}
    for r in mixing.texts(docs, out).collect():
        place = (r["doc_id"], r["source"], r["copy"])
        said[place] = said.get(place, 0) + len(words(r["text"]))
    told = {}
    for r in out.where("taken > 0").collect():
        place = (r["doc_id"], r["source"], r["copy"])
        told[place] = told.get(place, 0) + r["taken"]
    assert said == told


def test_seats_go_to_the_highest_quotients(spark):
    dice = random.Random(9)
    parties = [(g, k, dice.choice([0, 1, 7, 7, 30, 400, 12345])) for g in range(6) for k in range(dice.choice([1, 3, 40]))]
    seats = {g: dice.choice([0, 1, 17, 1000]) for g in range(6)}
    df = spark.createDataFrame([(*p, seats[p[0]]) for p in parties], "g long, k long, w long, n long")
    out = {(r["g"], r["k"]): r["quota"] for r in mixing.apportioned(df, ["g"], 6, ["k"], "w", F.col("n")).collect()}
    for g, n in seats.items():
        listed = sorted((-w / (2 * j - 1), k) for h, k, w in parties if h == g and w for j in range(1, n + 1))[:n]
        for h, k, _ in parties:
            if h == g:
                assert out[g, k] == sum(x[1] == k for x in listed), (g, k)


def test_places_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 10)
    rows = [(k % 3 if k % 7 else None, k * 37 % 100) for k in range(100)]
    out = mixing.ranked(spark.createDataFrame(rows, "g long, x long"), ["g"], [F.asc("x")]).collect()
    for g in {r[0] for r in rows}:
        own = sorted((r["x"], r["rank"]) for r in out if r["g"] == g)
        assert [r for _, r in own] == list(range(1, len(own) + 1))


def test_mixes_of_few_and_none(spark, monkeypatch):
    kind = "doc_id long, text string, source string"
    assert mixing.mixed(spark.createDataFrame([], kind)).count() == 0
    empty = mixing.mixed(spark.createDataFrame([(1, None, None), (2, "", "a")], kind)).collect()
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in empty) == [(1, 0, 0.0), (2, 0, 0.0)]
    one = mixing.mixed(spark.createDataFrame([(1, "a b c d", "s")], kind)).collect()
    assert [(r["taken"], r["target"]) for r in one] == [(6, 6.0)]
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    rows = rows_of(random.Random(5))
    check(mixing.mixed(spark.createDataFrame(rows, kind), block=8, shard=500).collect(), rows)


def test_registered_mix(spark):
    out = QUERIES["op13_source_mix"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    source = {r["doc_id"]: r["source"] for r in docs}
    check([{**r.asDict(), "source": source[r["doc_id"]], "spans": []} for r in out], [tuple(r) for r in docs])
