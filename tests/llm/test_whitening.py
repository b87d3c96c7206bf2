"""Whitening against dense linear algebra on the exact covariance."""

from fractions import Fraction

import numpy as np
import pytest

from recallspark.llm import whitening
from recallspark.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, whitened string"


def integers(rows):
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    return [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v + [0.0] * (d - len(v))]) for i, v in good]


def check(out, rows, most=32):
    x = integers(rows)
    n, d = len(x), len(x[0][1])
    sums = [sum(v[j] for _, v in x) for j in range(d)]
    dev = [[n * c - s for c, s in zip(v, sums)] for _, v in x]
    a = np.array([[float(Fraction(c, n)) for c in r] for r in dev])
    e, u = np.linalg.eigh(a.T @ a / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-11 * e[0]).sum()))
    by = {}
    for r in out:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    want = sorted((i if i is not None else -1, sum(c * c for c in r)) for (i, _), r in zip(x, dev))
    w = np.zeros((n, k))
    for c, rs in by.items():
        assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, int(r["deviation"])) for r in rs) == want
        assert all(r["n"] == n and r["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-4 for r in rs)
        # the values of a component, up to its sign and the order of rows with one id, are the projections on the eigenvector
        good = a @ u[:, c - 1] / np.sqrt(e[c - 1])
        apart = min(np.abs(e[c - 1] - np.delete(e, c - 1))) / e[0]
        got = np.array([r["whitened"] for r in sorted(rs, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, int(r["deviation"])))])
        order = sorted(range(n), key=lambda j: (x[j][0] is None, x[j][0] or 0, sum(y * y for y in dev[j])))
        w[:, c - 1] = got
        if apart > 1e-6:
            assert min(np.abs(got - good[order]).max(), np.abs(got + good[order]).max()) < 1e-12 / apart + 1e-9
    m = w - w.mean(0)
    assert np.abs(m.T @ m / n - np.eye(k)).max() < 1e-9


def made(n, d, fall, seed=1):
    dice = np.random.default_rng(seed)
    turn = np.linalg.qr(dice.standard_normal((d, d)))[0]
    return [(k, v.tolist()) for k, v in enumerate(dice.standard_normal((n, d)) * 8 * fall ** np.arange(d) @ turn + 3)]


def test_flat_spectra_go_to_all_dimensions(spark):
    rows = made(300, 60, 1.0)
    rows += [(None, rows[3][1]), (5, rows[5][1]), (900, None), (901, [None] * 60), (902, [float("nan")] * 60), (903, [float("inf")] + [0.0] * 59), (904, [1.5] * 10), (905, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND).repartition(5)
    check(whitening.whitened(df).collect(), rows)


def test_steep_spectra_settle_in_few_directions(spark, monkeypatch):
    rows = made(400, 40, 0.3, 2)
    called = []
    eye = np.eye
    monkeypatch.setattr(whitening.np, "eye", lambda d: called.append(d) or eye(d))
    check(whitening.whitened(spark.createDataFrame([(*r, "x") for r in rows], KIND).repartition(3), k=4, oversample=6, passes=8).collect(), rows, 4)
    assert 40 not in called  # never all dimensions


def test_few_equal_and_no_rows(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], KIND)
    assert whitening.whitened(frame([])).count() == 0
    assert whitening.whitened(frame([(1, None), (2, [])])).count() == 0
    assert whitening.whitened(frame([(1, [1.0, 2.0])] * 3)).count() == 0
    rows = [(1, [1.0, 2.0, 0.0]), (2, [2.0, 5.0, 0.0]), (3, [-4.0, 1.0, 0.0])]
    check(whitening.whitened(frame(rows)).collect(), rows)


def test_integers_of_more_than_64_bits(spark):
    rows = [(k, [float(np.float32(3e13 * (k % 5) ** 4)), float(k * k % 7), -1e12 * k]) for k in range(40)]
    out = whitening.whitened(spark.createDataFrame([(*r, "x") for r in rows], KIND).repartition(3)).collect()
    x = integers(rows)
    sums = [sum(v[j] for _, v in x) for j in range(3)]
    want = {i: sum((40 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x}
    assert out and all(r["deviation"] is None and want[r["vec_id"]] >= 10**38 or int(r["deviation"]) == want[r["vec_id"]] for r in out)
    assert {r["deviation"] is None for r in out} == {True, False}


def test_registered_whitening(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op12_whitening"](spark, SF).collect(), rows)
