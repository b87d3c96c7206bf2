"""Phrases of documents against counting every one."""

import random
import re
from collections import Counter

import pytest

from recallspark.llm import phrases
from recallspark.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "text string, lang string, rank int, phrase string"


def brute(docs, least=100, best=2000):
    words, found, out = Counter(), Counter(), []
    for text, lang in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            ws = [w for w in re.split("[ \t]", piece) if w]
            words[lang] += len(ws)
            for size in range(1, 6):
                for k in range(len(ws) - size + 1):
                    found[lang, tuple(ws[k : k + size])] += 1
    cands = {p: f for p, f in found.items() if f >= least and len(p[1]) > 1}
    covered = set()
    for (lang, p), f in cands.items():
        for size in range(2, len(p)):
            for k in range(len(p) - size + 1):
                if f >= found[lang, p[k : k + size]]:
                    covered.add((lang, p[k : k + size]))
    for (lang, p), a in cands.items():
        if (lang, p) not in covered:
            n, cuts = words[lang], [(found[lang, p[:k]], found[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min((1000 * a * n // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            out.append((lang, " ".join(p), a, left, right, n, score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    placed, at = [], Counter()
    for r in out:
        at[r[0]] += 1
        if at[r[0]] <= best:
            placed.append((r[0], at[r[0]], *r[1:]))
    return placed


def rows_of(out, lang="lang"):
    return sorted((r[lang], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out.collect())


@pytest.mark.parametrize("hot", [1 << 17, 40])
def test_phrases_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(phrases, "GROUP", 50)
    dice = random.Random(6)
    docs = [("".join(dice.choice(["The", "the", "cat", "sat", "É", "é", "on", "a", "x\x00y"]) + dice.choice([" ", " ", " ", "\t ", ", ", ".\n", "\x0b", "?"]) for _ in range(dice.choice([0, 3, 60]))), dice.choice(["en", "fr", None, "und"])) for _ in range(300)]
    docs += [("new york city is big " * 9, "en")] * 30 + [(None, "en"), ("", None), ("w " * 3000 + "end", "fr")]
    frame = spark.createDataFrame([(*d, 0, "") for d in docs], KIND).repartition(5)
    for chunk in (1 << 20, 150):
        assert rows_of(phrases.collocations(frame, least=20, best=40, hot=hot, chunk=chunk)) == sorted(brute(docs, 20, 40))


def test_another_seed_where_words_share_a_hash(spark, monkeypatch):
    real, seeds = phrases.word_hashes, []
    docs = [("big cat and dog", "en")] * 120 + [("a b", "en")]
    frame = spark.createDataFrame([(*d, 0, "") for d in docs], KIND)

    def counts(rows, seed, chunk):
        # with the first seed, two words of different parts of the corpus have one hash
        seeds.append(seed)
        out = real_counts(rows, seed, chunk)
        from pyspark.sql import functions as F

        return out.withColumn("h", F.when(F.col("word") == "a", F.lit(7)).when(F.col("word") == "b", F.lit(7)).otherwise(F.col("h"))) if not seed else out

    real_counts = phrases.word_counts
    monkeypatch.setattr(phrases, "word_counts", counts)
    assert rows_of(phrases.collocations(frame)) == sorted(brute(docs))
    assert seeds == [0, 1] and real is phrases.word_hashes


def test_only_places_of_frequent_phrases_are_sent_on(spark, monkeypatch):
    dice, sent, real = random.Random(8), [], phrases.projected

    def sends(*args, **more):
        out = real(*args, **more)
        sent.append(out.count())
        return out

    monkeypatch.setattr(phrases, "projected", sends)
    # all pairs of twelve words reach 100, none of their triples does but the planted ones
    docs = [(" ".join(dice.choice("abcdefghijkl") for _ in range(700)) + " new york city is big", "en") for _ in range(30 * 5)]
    for some in (docs[: 30 * 3], docs):
        frame = spark.createDataFrame([(*d, 0, "") for d in some], KIND).repartition(3)
        assert rows_of(phrases.collocations(frame, chunk=20000)) == sorted(brute(some))
    counts = Counter(t for d in docs for t in zip(*(d[0].split()[k:] for k in range(3))))
    assert len([t for t in counts if counts[t] >= 100]) == 3 and sum(counts[t] for t in counts if counts[t] < 100) > 100_000
    # the three triples and what follows them, from each look at the texts, at most
    assert max(sent) <= 3 * 150


@pytest.mark.parametrize("most, ranges", [(1 << 10, 2), (1 << 10, 1 << 20), (1 << 29, 16)])
def test_phrases_that_share_a_counter(spark, monkeypatch, most, ranges):
    monkeypatch.setattr(phrases, "MOST_BITS", most)
    monkeypatch.setattr(phrases, "RANGES", ranges)
    dice = random.Random(9)
    docs = [(" ".join(dice.choice(["w%d" % k for k in range(40)]) for _ in range(2000)) + " x y z x y", dice.choice(["en", "fr"])) for _ in range(60)]
    frame = spark.createDataFrame([(*d, 0, "") for d in docs], KIND).repartition(5)
    assert rows_of(phrases.collocations(frame, least=5, chunk=5000)) == sorted(brute(docs, 5))


def test_words_are_compared_byte_by_byte():
    import numpy as np

    blob, start, end, piece = phrases.words_in([b"abcdefghi abcdefghi abcdefghj", b"x" * 90 + b" " + b"x" * 89 + b"y", b"a.b a"])
    assert len(start) == 8 and piece.tolist() == [0, 0, 0, 1, 1, 2, 3, 3]
    for i in range(8):
        for j in range(8):
            like = np.arange(8)
            like[i] = j
            assert phrases.same_words(blob, start, end, like) == (blob[start[i] : end[i]] == blob[start[j] : end[j]])


def test_rows_that_share_a_hash_are_sorted(monkeypatch):
    import numpy as np

    dice = np.random.default_rng(1)
    columns = [dice.integers(0, 4, 300) for _ in range(3)]
    want = sorted(Counter(zip(*(c.tolist() for c in columns))).items())
    for poor in (False, True):
        if poor:
            monkeypatch.setattr(phrases, "mix", lambda h: h & np.uint64(1))
        rows, n = phrases.counted(columns)
        assert sorted(zip(zip(*(r.tolist() for r in rows)), n.tolist())) == want


def test_sets_of_bits_miss_no_member(monkeypatch):
    import numpy as np

    dice = np.random.default_rng(2)
    some = dice.integers(-(2**63), 2**63 - 1, 500)
    for most in (1 << 29, 1 << 10):
        monkeypatch.setattr(phrases, "MOST_BITS", most)
        held = phrases.BitSet(len(some))
        held.add(some)
        assert held.has(some).all() and held.bits.nbytes <= most // 8
    assert phrases.BitSet(0).has(some).sum() == 0


def test_products_of_more_than_64_bits(spark):
    words = spark.createDataFrame([("en", 10**15)], "lang string, f long")
    told = [([1], 3 * 10**12), ([2], 7 * 10**11), ([1, 2], 6 * 10**11)]
    out = phrases.scored(words, spark.createDataFrame([("en", h, f) for h, f in told], "lang string, h array<long>, f long")).collect()
    assert [r["score"] for r in out] == [1000 * 6 * 10**11 * 10**15 // (3 * 10**12 * 7 * 10**11)]


def test_phrases_of_none(spark):
    assert phrases.collocations(spark.createDataFrame([], KIND)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None, 1, ""), ("a b", "en", 1, "")], KIND)).count() == 0


def test_registered_phrases(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()]
    assert rows_of(QUERIES["op11_phrases"](spark, SF)) == sorted(brute(docs))
