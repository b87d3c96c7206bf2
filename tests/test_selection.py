"""Order statistics by selection, and joins by time, against sorting and holding every pair."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recallspark.operators import evaluation, graph_recall


def test_order_statistics_equal_sorting(spark):
    dice = random.Random(2)
    rows = [("hot", dice.choice([dice.random(), 0.5, dice.random() * 1e6, -1e300, 1e300, float("inf"), float("-inf")])) for _ in range(3000)]
    rows += [("one", 3.0), ("ties", 1.0), ("ties", 1.0), ("ties", 1.0), (None, 5.0), (None, -5.0), ("empty", None), ("nan", float("nan")), ("close", 1.0), ("close", 1.0 + 2**-52), ("close", 1.0 + 2**-51)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    n = F.col("n")
    out = {r["g"]: (r["n"], list(r["values"])) for r in evaluation.order_statistics(df, "g", "v", [F.lit(1), F.floor((n + 1) / 2), n]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted(v for h, v in rows if h == g and v is not None and v == v)
        if own:
            want[g] = (len(own), [own[0], own[(len(own) + 1) // 2 - 1], own[-1]])
    assert out == want


def test_large_whole_numbers_and_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BUCKETS", 4)
    rows = [("a", 2**62 + k) for k in range(9)] + [("b", k * k) for k in range(50)]
    df = spark.createDataFrame(rows, "g string, v long")
    out = {r["g"]: list(r["values"]) for r in evaluation.order_statistics(df, "g", "v", [F.lit(2), F.col("n") - 1]).collect()}
    assert out == {"a": [2**62 + 1, 2**62 + 7], "b": [1, 48 * 48]}


def test_no_task_holds_a_group(spark):
    rows = spark.range(0, 200_000, 1, 8).select(F.lit("g").alias("g"), F.rand(3).alias("v"))
    assert evaluation.nearest_rank(rows, "g", "v", [0.5]).first()["n"] == 200_000
    plan = rows.withColumn("bucket", F.floor("v")).groupBy("g", "bucket").count()._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


@pytest.mark.parametrize("slot", [None, 3600, 40 * 86400])
def test_facts_that_held_when_asked(spark, slot):
    dice = random.Random(5)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    moments = [(k, dice.choice("ab"), dice.choice([None, day(dice.randrange(500))])) for k in range(80)]
    facts = []
    for k in range(120):
        a = dice.choice([None, dice.randrange(500)])
        b = dice.choice([None, (a or 0) + dice.choice([0, 1, 2, 300])])
        facts.append((f"f{k}", dice.choice("abc"), None if a is None else day(a), None if b is None else day(b)))
    m = spark.createDataFrame(moments, "k long, space string, at timestamp_ntz")
    f = spark.createDataFrame(facts, "fact string, space string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    out = sorted((r["k"], r["fact"]) for r in graph_recall.valid_when(m, f, "at", ["space"], slot).collect())
    want = sorted((k, x) for k, s, t in moments if t for x, r, a, b in facts if r == s and (a is None or a <= t) and (b is None or b > t))
    assert out == want
    assert graph_recall.valid_when(m.limit(0), f, "at", ["space"]).count() == 0
