"""Substring, line and near-duplicate removal against brute force."""

import random
import re
from math import comb

import numpy as np
import pytest

from recallspark.llm import line_dedup, simhash, substring_dedup
from recallspark.llm.components import components, local_components
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows |= {10_000 + k: t for k, t in enumerate(brute.EDGE_TEXTS)}
    dice = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(60))
    for k in range(40):  # shared passages within, copies, loops
        own = [f"w{dice.randrange(10_000)}" for _ in range(dice.randrange(5, 80))]
        at = dice.randrange(len(own))
        rows[20_000 + k] = " ".join([*own[:at], passage, *own[at:]]) if k % 2 else " ".join(own)
    rows[20_100] = rows[20_001]
    rows[20_101] = rows[20_001].upper()
    rows[20_102] = "la " * 50
    rows[20_103] = "la " * 20
    rows[20_104] = "a b " * 30
    rows[20_105] = "b a " * 30
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 0, "y") for d, t in rows.items()], "doc_id long, text string, doc string, pos int, k string").repartition(5)


def test_substring_dedup(spark, docs):
    out = substring_dedup.substring_dedup(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept)) for r in out} == brute.substring_dedup(docs)


def test_substring_dedup_with_null_and_shared_ids(spark):
    text = " ".join(f"t{k}" for k in range(20))
    rows = [(None, text), (1, text), (2, text), (2, text), (2, text + " more"), (3, None)]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in out)) == [(0, 20, 0), (1, 20, 0), (2, 20, 20), (2, 20, 20), (2, 21, 20), (3, 0, 0)]


def test_near_duplicates(spark, docs):
    for words in (4, 5):
        out = simhash.near_duplicates(frame(spark, docs), words=words).collect()
        got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in out}
        assert got == brute.near_duplicates(docs, words)


def test_similar_documents(spark, docs):
    """Brute force over all pairs; shorter fingerprints may miss a pair that lies close to the threshold, never join others."""
    dice = random.Random(11)
    rows = dict(docs)
    for k in range(60):
        own = [f"n{dice.randrange(50_000)}" for _ in range(120)]
        rows[50_000 + 2 * k] = " ".join(own)
        own[dice.randrange(120)] = "changed"
        if k % 2:
            own[60] = "again"
        rows[50_001 + 2 * k] = " ".join(own)
    sets = {}
    for d, t in rows.items():
        w = brute.words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    ids = sorted(rows)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = brute.components(links, ids)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame(spark, rows)).collect()}
    assert len(links) > 50 and set(got) == set(want)
    assert all(want[d] == want[c] for d, c in got.items())
    assert sum(got[d] != want[d] for d in ids) <= 0.02 * len(links) + 1
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.similar_documents(none).count() == 0
    few = spark.createDataFrame([(None, "a b"), (7, "A  b"), (7, "A  b"), (9, None), (None, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.similar_documents(few).collect()) == [(0, 7), (0, 9), (7, 7), (7, 7), (9, 9)]


def test_fingerprint_links_lose_none_within_the_radius(spark):
    dice = random.Random(3)
    seeds = [dice.getrandbits(64) for _ in range(60)]
    prints = set(seeds)
    for s in seeds:
        for flips in (1, 2, 3, 4, 5):
            x = s
            for b in dice.sample(range(64), flips):
                x ^= 1 << b
            prints.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    links = components(simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"))).collect()
    got = {}
    for r in links:
        got.setdefault(r.component, set()).add(r.node % (1 << 64))
    nodes = sorted(prints)
    root = brute.components([(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 4], nodes)
    want = {}
    for n, r in root.items():
        want.setdefault(r, set()).add(n)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(500, 501), (700, 700)], "a long, b long")
    out = {r.node: r.component for r in components(links).collect()}
    assert out == {k: 0 for k in range(301)} | {500: 500, 501: 500}


def test_line_dedup(spark, docs):
    rows = {d: t for d, t in docs.items() if t is not None}
    dice = random.Random(3)
    block = [f"shared line {k}" for k in range(300)]
    for k in range(12):
        rows[30_000 + k] = "\n".join([f"own {k}", f"own again {k}", *block, f"last {k}"])
    for k in range(60):  # short passages between lines of their own
        at = dice.randrange(290)
        rows[31_000 + k] = "\n".join([*(f"{k} a {n}" for n in range(dice.randrange(4))), *block[at : at + dice.randrange(12)], *(f"{k} b {n}" for n in range(dice.randrange(4)))])
    df = frame(spark, rows | {40_000: None})
    out = line_dedup.line_dedup(df).collect()
    assert {r.doc_id: r.text for r in out} == brute.line_dedup(rows) | {40_000: None}
    assert all(r.n_removed == r.n_lines - (0 if r.text is None else len(r.text.split("\n")) if r.text or r.n_removed < r.n_lines else 0) for r in out)
    # boundaries are shift resistant and repeats grow to their neighbours' edges: hardly a line of the block stays in later documents
    assert max(r.text.count("shared line") for r in out if 30_000 < r.doc_id < 30_012) <= 2


def test_line_dedup_by_shuffle_equals_broadcast(spark, docs, monkeypatch):
    df = frame(spark, {d: t for d, t in docs.items() if d % 3})
    once = sorted(line_dedup.line_dedup(df).select("doc_id", "text").collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert sorted(line_dedup.line_dedup(df).select("doc_id", "text").collect()) == once


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.substring_dedup(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0


def test_similar_documents_misses_no_pair_that_fingerprints_miss(spark):
    """With no fingerprint pairs at all, with many failing pairs around, and with few shingles."""
    dice = random.Random(5)
    rows = {}
    for k in range(40):  # 8 against 9 words share 4 of 5 shingles
        own = [f"s{dice.randrange(50_000)}" for _ in range(9)]
        rows[2 * k], rows[2 * k + 1] = " ".join(own[:8]), " ".join(own)
    base = [f"c{k}" for k in range(104)]
    for k in range(60):  # many lie near each other, few pairs reach 0.8
        own = list(base)
        for at in dice.sample(range(3, 101), 3):
            own[at] = f"x{dice.randrange(4)}"
        rows[1000 + k] = " ".join(own)
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows.items()}
    ids = sorted(rows)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = brute.components(links, ids)
    df = spark.createDataFrame([*rows.items()], "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == want
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df, forests=0).collect()} == want


def test_sketches_do_not_depend_on_repeats():
    own, tail = " ".join(f"u{k}" for k in range(100)), " ".join(f"v{k}" for k in range(15))
    once, often = (simhash.sketches_of([f"{own} " + f"{tail} " * n], 5, 10, 36)[0] for n in (2, 20))
    assert (once == often).all()
    near = simhash.sketches_of([f"{own} {tail}"], 5, 10, 36)[0]
    assert simhash.jaccard([f"{own} {tail}"], [f"{own} " + f"{tail} " * 20], 5)[0] >= 0.8
    apart = [(int(x) ^ int(y)).bit_count() for x, y in zip(near[0], often[0])]
    assert sum(apart) <= 97


def test_substring_dedup_tells_words_apart_that_plain_polynomials_do_not(spark):
    word = "a"
    for _ in range(10):  # a Thue-Morse word and its complement
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    before, after = " ".join(f"w{k}" for k in range(12)), " ".join(f"x{k}" for k in range(12))
    rows = [(1, f"{before} {word} {after}"), (2, f"{before} {other} {after}"), (3, " ".join([word] * 13)), (4, " ".join([other] * 13)), (2**62, f"{before} {other} {after}")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(frame(spark, dict(rows))).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 2**62: 25}


def test_substring_dedup_keeps_clashing_columns_apart(spark):
    df = spark.createDataFrame([(1, "a b", "x", 7), (1, "a c", "y", 8)], "doc_id long, text string, _id string, _row long")
    out = substring_dedup.substring_dedup(df, carry=["_id", "_row"]).collect()
    assert sorted((r.doc_id, r.kept, r._id, r._row) for r in out) == [(1, "a b", "x", 7), (1, "a c", "y", 8)]


def test_blocks_of_a_common_shingle_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    common = " ".join(f"c{k}" for k in range(12))
    rows = [(k, f"{common} t{k} u{k % 5}") for k in range(40)]
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame(spark, dict(rows)), forests=0).collect()}
    assert got == brute.components(links, sorted(sets))


def test_buckets_of_many_fingerprints_take_time_in_proportion(monkeypatch):
    import time

    dice = np.random.default_rng(3)
    took = []
    monkeypatch.setattr(simhash, "CHUNK", 50_000)  # as many parts as a bucket of 20 times the size has
    for n in (20_000, 160_000):
        lead = dice.choice([5 ^ m for m in simhash._masks(range(4), 2)], n).astype(np.uint64)
        fps = np.unique(lead << np.uint64(32) | dice.integers(0, 1 << 32, n, dtype=np.uint64))
        start = time.process_time()
        pairs = simhash.bucket_pairs(fps, 5, 4, 4, 36)
        took.append(time.process_time() - start)
        assert len(pairs) and (np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= 4).all()
    assert took[1] < 30 * took[0]


@pytest.mark.parametrize(("bits", "bucket_bits"), [(20, 4), (36, 4), (41, 5), (64, 4)])
def test_a_bucket_connects_what_shares_a_variant(monkeypatch, bits, bucket_bits):
    dice = np.random.default_rng(bits)
    base = dice.integers(0, 1 << (bits - bucket_bits), 60, dtype=np.uint64) | np.uint64(5 << (bits - bucket_bits))
    near = [base]
    for _ in range(4):
        near.append(near[-1] ^ np.uint64(1) << dice.integers(0, bits, 60).astype(np.uint64))
    fps = np.unique(np.concatenate(near))
    masks = simhash._masks(range(bits), 2)
    held = {}
    for k, fp in enumerate(fps.tolist()):
        for m in masks:
            if (fp ^ m) >> (bits - bucket_bits) == 5:
                held.setdefault(fp ^ m, []).append(k)
    links = np.array([(g[0], k) for g in held.values() for k in g[1:]])
    want = local_components(links[:, 0], links[:, 1], len(fps))
    for chunk in (1000, 1_000_000):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        pairs = simhash.bucket_pairs(fps, 5, 4, bucket_bits, bits)
        assert (local_components(pairs[:, 0], pairs[:, 1], len(fps)) == want).all()


def test_chance_neighbours_of_a_sketch_do_not_grow_with_the_texts():
    ball = lambda bits: sum(comb(bits, k) for k in range(5)) / 2**bits
    for texts in (0, 1 << 18, 3_000_000, 10**9):
        tables, bits = simhash.shape_for(texts)
        assert texts * ball(bits) <= (1 << 18) * ball(36) and tables * bits <= 384
    assert simhash.shape_for(1 << 18) == (10, 36)


def test_long_texts_of_one_common_rare_passage_are_not_compared(spark):
    dice = random.Random(8)
    say = lambda n: " ".join(f"w{dice.randrange(10**9)}" for _ in range(n))
    both = say(17)
    texts = {4 * k + 1: f"{say(700)} {both} {say(700)}" for k in range(30)}  # of no text whose shingles are counted, so the passage counts as rare
    words = texts[1].split()
    texts[121] = " ".join(words[:1260] + say(154).split())  # similarity a little over 0.8
    texts[125] = " ".join(words[:1255] + say(159).split())  # and under it
    df = spark.createDataFrame([*texts.items()], "node long, text string")
    sets = {k: {tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for k, t in texts.items()}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    _, parity, size = simhash.sketches_of([*texts.values()], 5, 10, 36)
    marks = spark.createDataFrame([(k, int(n), p.view(np.int64).tolist()) for k, n, p in zip(texts, size, parity)], "node long, size int, parity array<long>")
    found = spark.createDataFrame([], "node long, component long")
    got = {(r.a, r.b) for r in simhash.sharing_pairs(df, marks, found, 5, 0.8).collect()}
    want = {(a, b) for a in texts for b in texts if a < b and near(a, b)}
    assert want == {(1, 121)} and want <= got and len(got) <= 3
