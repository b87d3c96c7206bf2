"""Hashes of words and windows, memos bounded by bytes, and tables that are written and released."""

import os

import numpy as np

from recallspark.llm import common


def hashes(texts, seed=0):
    blob, start, end, first = common.words_of([t.encode() for t in texts])
    return common.word_hashes(blob, start, end, seed), first


def test_words_hash_by_their_bytes_alone():
    words = ["a", "aa", "ab", "a" * 8, "a" * 9, "b" + "a" * 8, "a" * 63, "a" * 64, "a" * 65, "a" * 200, "a\x00", "é", "é"]
    h, _ = hashes([" ".join(words)])
    assert len(set(h.tolist())) == len(words)
    for k, w in enumerate(words):
        assert hashes([f"x {w}\t{w} y"])[0][1:3].tolist() == [h[k], h[k]]
    assert not set(h.tolist()) & set(hashes([" ".join(words)], 1)[0].tolist())
    assert len(hashes(["", " \n"])[0]) == 0


def test_windows_hash_by_their_words_alone():
    dice = np.random.default_rng(4)
    values = dice.integers(0, 3, 400).astype(np.uint64)
    for n in (1, 2, 3, 5, 8, 13):
        h = common.window_hashes(common.mix(values + np.uint64(9)), n)
        assert len(h) == len(values) - n + 1
        told = {}
        for k in range(len(h)):
            told.setdefault(tuple(values[k : k + n].tolist()), set()).add(int(h[k]))
        assert all(len(x) == 1 for x in told.values()) and len({*map(min, told.values())}) == len(told)
    assert len(common.window_hashes(values[:4], 5)) == 0


def test_shingles_of_short_and_empty_texts():
    h, first = hashes(["a b c d e f", "", "a b", "a b", "b a"])
    found, count = common.shingle_hashes(h, first, 5)
    assert count.tolist() == [2, 0, 1, 1, 1] and found[2] == found[3] != found[4]


def test_memos_start_anew_beyond_their_bytes():
    memo = common.Memo(1000)
    for k in range(20):
        memo.keep(str(k), b"x" * 50, 50)
    assert len(memo) == 20
    memo.room()
    assert not memo and memo.used == 0


def test_written_tables_are_released(spark):
    df = common.materialize(spark.range(7))
    folder = common._written[-1]
    assert df.count() == 7 and os.path.isdir(folder)
    assert common.release(spark) >= 1
    assert not os.path.isdir(folder) and not common._written


def test_a_step_leaves_its_result_alone(spark):
    before = list(common._written)
    with common.scope(spark) as keep:
        extra = common.materialize(spark.range(3))
        first, path = keep(extra)
    assert first.count() == 3 and common._written == [*before, path]
    with common.scope(spark, path) as keep:
        second, other = keep(first.selectExpr("id + 1 as id"))
    assert second.count() == 3 and common._written == [*before, other] and not os.path.isdir(path)
