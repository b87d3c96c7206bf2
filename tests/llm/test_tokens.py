"""Token counts, byte-level BPE and packing against the libraries themselves."""

import base64
import math
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from recallspark.llm import byte_bpe, packing, pretokenize, token_counts
from tests.llm.brute import EDGE_TEXTS, sha

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table, edge cases, a repeated row, null ids and clashing columns."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + k, t) for k, t in enumerate(EDGE_TEXTS)] + [(3, "again again"), (3, "again again"), (None, "null id")]
    return [(*r, "x", 1, b"y") for r in rows]


SCHEMA = "doc_id long, text string, id string, n_tokens int, ids binary"


def key(row):
    return tuple((x is None, x) for x in row)


def test_token_counts_equal_the_library(spark, docs):
    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, token_counts.token_counts(spark.createDataFrame(docs, SCHEMA)).collect()), key=key)
    want = []
    for d, t, *_ in docs:
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=key)


def test_byte_bpe_equals_the_library_and_decodes(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    model = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(docs, SCHEMA)
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.bpe_round_trip(df).collect()), key=key)
    want = []
    for d, t, *_ in docs:
        ids = model.encode_ordinary(t or "")
        want.append((d, len(ids), struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()))
    assert got == sorted(want, key=key)
    encoded = byte_bpe.bpe_encode(df)
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in byte_bpe.bpe_decode(encoded).collect()), key=key) == sorted(((w[0], w[3]) for w in want), key=key)


def test_packing_keeps_every_piece_and_fills_sequences(spark, docs):
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = packing.token_pieces(spark.createDataFrame(docs, SCHEMA))
    got = sorted(((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in pieces.collect()), key=key)
    want = []
    for d, t, *_ in docs:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((d, n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert got == sorted(want, key=key)
    packed = packing.pack(pieces, ["doc_id", "piece", "ids"]).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in packed), key=key) == sorted(want, key=key)
    filled = {}
    for r in packed:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in packed)
    assert len(filled) <= math.ceil(total / 4096) * 1.02 + 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none).count() == 0
    assert byte_bpe.bpe_round_trip(none).count() == 0
    assert packing.pack(packing.token_pieces(none), ["doc_id"]).count() == 0


def test_registered_digests(spark):
    from recallspark.llm.catalog import QUERIES

    rows = QUERIES["op8_byte_bpe"](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {d: sha(t) for d, t in texts.items()}


def test_long_texts_of_any_script(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "PART_BYTES", 300)
    monkeypatch.setattr(byte_bpe, "PART_BYTES", 300)
    texts = ["\u6211\u559c\u6b22\u94c1\u9524" * 400, "\u0430\u0431\u0432 " * 500, "don't we'll I've " * 90, "x" * 3000, "1234567890" * 200, "\u4f60\u597d\uff0c" * 300, " \n" * 900, "'s'll" * 400]
    model, plain = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
    path = P.path("byte_bpe_50k.json")
    assert token_counts.count(texts, path).tolist() == [len(model.encode(t, add_special_tokens=False).ids) for t in texts]
    packed = byte_bpe.encode(texts, P.path("byte_bpe_50k.tiktoken"))
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in packed] == [plain.encode_ordinary(t) for t in texts]
    assert all(len(t) < 1500 for part in pretokenize.parts(texts[:1], 300, byte_bpe.merges(P.path("byte_bpe_50k.tiktoken")).fused) for _, t in part)


def test_other_vocabularies_are_refused(spark):
    with pytest.raises(ValueError):
        token_counts.token_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer="word_bpe_49k.json")


def test_configurations_place_every_length():
    histogram = {1: 7, 5: 3, 900: 40, 1300: 11, 2048: 9, 4096: 4, 4000: 2}
    placed = {}
    for filling, times in packing.configurations(histogram):
        assert sum(filling) <= 4096
        for n in filling:
            placed[n] = placed.get(n, 0) + times
    assert placed == histogram and packing.configurations({}) == []


def histograms():
    dice = np.random.default_rng(1)
    count = lambda x: dict(zip(*(a.tolist() for a in np.unique(x, return_counts=True))))
    yield {n: int(dice.integers(1, 51)) for n in range(1, 4097)}
    yield {int(n): int(dice.integers(1, 120)) for n in dice.choice(np.arange(100, 1401), 60, False)}
    yield count(dice.integers(1300, 2701, 20_000))
    yield count(np.clip(dice.lognormal(6, 1, 50_000).astype(int), 1, 4096))
    yield {1400: 1000, 1296: 1000}
    yield {4096: 3, 1: 2}
    yield {2049: 7, 2048: 2, 1: 1}


@pytest.mark.parametrize("histogram", list(histograms()))
def test_packing_is_never_worse_than_best_fit_and_near_its_bound(histogram):
    counts = np.zeros(4097, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    fillings, bound = packing.packed(histogram)
    many = sum(m for _, m in fillings)
    placed = np.zeros(4097, np.int64)
    for filling, times in fillings:
        assert sum(filling) <= 4096
        np.add.at(placed, list(filling), times)
    assert (placed == counts).all()
    assert bound <= many <= sum(m for _, m in packing.best_fit(counts, 4096))
    print("sequences", many, "bound", bound)
    assert many <= 1.015 * bound + 1
    assert packing.least_sequences(counts, 4096) <= bound and bound >= -(-sum(n * c for n, c in histogram.items()) // 4096)


def test_bounds_of_packing_hold_for_small_cases():
    import itertools
    import random

    dice = random.Random(3)
    for _ in range(60):
        sizes = [dice.randrange(1, 11) for _ in range(dice.randrange(1, 7))]
        least = next(k for k in range(1, 8) for way in itertools.product(range(k), repeat=len(sizes)) if all(sum(s for s, w in zip(sizes, way) if w == j) <= 10 for j in range(k)))
        histogram = {s: sizes.count(s) for s in sizes}
        fillings, bound = packing.packed(histogram, 10)
        assert bound <= least <= sum(m for _, m in fillings) <= least + 1
