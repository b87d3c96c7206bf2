"""Embedding whitening: a randomised range finder with power passes over all rows, and Rayleigh-Ritz.

Every pass is one Spark job: each task multiplies its centred rows with a few directions (more than the components asked for) and
with themselves again, and sends the sums, one row for each dimension; sums are added up by dimension. The driver holds only matrices
of dimensions by directions. The directions are made orthonormal after each pass, and the Ritz pairs within their span are the
components once their residuals are at rounding. If they are not after a few passes, as with flat spectra, the directions become
all dimensions, where the pairs are exact.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.common import in_task, table

#: Components, directions besides, power passes before all dimensions are taken, and the residual (as a part of the first eigenvalue) of a settled pair.
COMPONENTS, OVERSAMPLE, PASSES, SETTLED = 32, 16, 3, 1e-13
#: A component's least part of the first eigenvalue: below, a direction holds rounding only.
LEAST = 1e-11
#: Entries become floor(SCALE * c) + SHIFT; tasks whose sums of one dimension are added up by one task at first.
SCALE, SHIFT, SALTS = 64, 1_000_000, 64
#: Magnitude up to which numbers are held as 64-bit integers and squares of deviations add up in them.
NARROW = 2**62


def usable(batch: pa.RecordBatch, column: str, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch whose vector holds no null or non-finite entry, and their entries as doubles, short vectors filled up with zeros."""
    lists = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    values = lists.flatten()
    flat = np.asarray(values.cast(pa.float64()).to_numpy(zero_copy_only=False), float)
    row = np.repeat(np.arange(len(size)), size)
    bad = ~np.isfinite(flat) | np.asarray(values.is_null())
    keep = np.asarray(lists.is_valid()) & (np.bincount(row[bad], minlength=len(size)) == 0)
    dense = np.zeros((len(size), max(int(size.max(initial=0)), dims or 0)))
    dense[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return np.flatnonzero(keep), dense[keep]


def whole(entries: np.ndarray, wide: bool) -> np.ndarray:
    """floor(SCALE * c) + SHIFT as 64-bit integers, or as Python's where they would not fit what is made of them."""
    scaled = np.floor(SCALE * entries)
    if wide:
        return np.array([[int(x) + SHIFT if np.isfinite(x) else 0 for x in r] for r in scaled.tolist()], object).reshape(scaled.shape)
    return scaled.astype(np.int64) + SHIFT


class Fit:
    """What all rows share: number of rows, exact sums of each dimension, and whether they need Python's integers."""

    def __init__(self, n: int, sums: list[int], wide: bool):
        self.n, self.wide, self.dims = n, wide, len(sums)
        self.sums = np.array(sums, object if wide else np.int64)

    def deviations(self, entries: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * whole(entries, self.wide) - self.sums

    def centred(self, entries: np.ndarray) -> np.ndarray:
        return self.deviations(entries).astype(float) / self.n

    def squares(self, deviations: np.ndarray) -> list[int]:
        """The exact sum of squares of each row."""
        most = int(np.abs(deviations).max(initial=0))
        if most * most * max(1, self.dims) < NARROW:
            return (deviations.astype(np.int64) ** 2).sum(1).tolist()
        return [sum(x * x for x in r) for r in deviations.tolist()]


def fit(rows: DataFrame, column: str) -> Fit:
    """Counts the usable rows and sums their integers, one small row for each dimension of each task."""

    def sums(batches):
        n, total, most = 0, [], 0
        for b in batches:
            keep, entries = usable(b, column)
            n += len(keep)
            if not entries.size:
                continue
            scaled = np.floor(SCALE * entries)
            top = float(np.abs(scaled).max())
            exact = scaled.astype(np.int64).sum(0).tolist() if top * len(scaled) < NARROW else [sum(map(int, c)) for c in scaled.T.tolist()]
            total += [0] * (len(exact) - len(total))
            total = [a + (exact[k] if k < len(exact) else 0) for k, a in enumerate(total)]
            most = max(most, int(top) + 1)
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *range(len(total))], pa.int32()), pa.array([Decimal(n), Decimal(most), *map(Decimal, total)], kind)], ["i", "x"])

    parts = rows.select(column).mapInArrow(in_task(sums), "i int, x decimal(38,0)")
    found = {r["i"]: r for r in parts.groupBy("i").agg(F.sum("x").alias("x"), F.max("x").alias("most")).collect()}  # a row for each dimension
    n = int(found[-2]["x"]) if -2 in found else 0
    most = int(found[-1]["most"]) if -1 in found else 0
    total = [int(found[k]["x"]) + n * SHIFT for k in range(len([i for i in found if i >= 0]))]
    return Fit(n, total, n * (most + SHIFT) >= NARROW)


def summed(rows: DataFrame, column: str, made, shape: tuple[int, int]) -> np.ndarray:
    """The sum of made(entries), a matrix of the shape, over all batches of usable rows."""
    high, wide = shape

    def parts(batches):
        out = np.zeros(shape)
        for b in batches:
            keep, entries = usable(b, column)
            if len(keep):
                out += made(entries)
        pid = _partition()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(high, dtype=np.int32)), pa.array(np.full(high, pid % SALTS, np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), wide).cast(pa.list_(pa.float64()))], ["i", "salt", "v"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf.i.iloc[:1], "v": [np.sum(np.stack(pdf.v), 0)]})

    own = rows.select(column).mapInArrow(in_task(parts), "i int, salt int, v array<double>")
    once = own.groupBy("i", "salt").applyInPandas(added, "i int, v array<double>")
    total = np.zeros(shape)
    for r in once.groupBy("i").applyInPandas(added, "i int, v array<double>").collect():  # dimensions by directions
        total[r["i"]] = r["v"]
    return total


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def filled(entries: np.ndarray, dims: int) -> np.ndarray:
    return entries if entries.shape[1] == dims else np.hstack([entries, np.zeros((len(entries), dims - entries.shape[1]))])


def components(rows: DataFrame, column: str, known: Fit, k: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance of all rows, k at most, and its trace."""
    d = known.dims

    def times(q: np.ndarray) -> tuple[np.ndarray, float]:
        def made(entries):
            a = known.centred(filled(entries, d))
            return np.hstack([a.T @ (a @ q), (a * a).sum(0)[:, None]]) / known.n

        out = summed(rows, column, made, (d, q.shape[1] + 1))
        return out[:, :-1], float(out[:, -1].sum())

    def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        small = q.T @ vq
        e, u = np.linalg.eigh((small + small.T) / 2)
        e, u = e[::-1][:k], u[:, ::-1][:, :k]
        off = np.linalg.norm(vq @ u - (q @ u) * e, axis=0).max(initial=0)
        return e, q @ u, off / max(e.max(initial=0), np.finfo(float).tiny)

    wide = k + oversample
    if wide < d:
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, wide)))[0]
        for n in range(passes + 1):
            vq, trace = times(q)
            e, u, off = ritz(q, vq)
            if off <= SETTLED or n == passes:
                break
            q = np.linalg.qr(vq)[0]
        if off <= SETTLED:
            return e, u, trace
    vq, trace = times(np.eye(d))
    e, u, _ = ritz(np.eye(d), vq)
    return e, u, trace


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """id_col, component (from 1), n, deviation, whitened, explained, identity_error of every usable row and component.

    Rows with a null vector or a null or non-finite entry are left out; shorter vectors count as filled up with zeros. Entries are
    taken as floor(64 c) + 1000000. deviation (decimal) is exact, and null beyond 38 digits; identity_error is measured on all rows after whitening. Components whose
    eigenvalue is rounding only (constant or dependent dimensions, fewer rows than components) are left out, so equal rows alone
    give no rows, as does an empty table; null and repeated ids stay, each row on its own; of equal eigenvalues any basis may be returned. Other columns are
    not read.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    known = fit(rows, "v")
    kind = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not known.n or not known.dims:
        return rows.sparkSession.createDataFrame([], kind)
    e, u, trace = components(rows, "v", known, k, oversample, passes)
    good = (e > LEAST * max(e[0], 0)) & (e > 0)
    e, u = e[good], u[:, good]
    if not len(e):
        return rows.sparkSession.createDataFrame([], kind)
    d, onto = known.dims, u / np.sqrt(e)

    def squared(entries):
        w = known.centred(filled(entries, d)) @ onto
        return np.vstack([w.T @ w, w.sum(0)]) / known.n

    both = summed(rows, "v", squared, (len(e) + 1, len(e)))
    error = float(np.abs(both[:-1] - np.outer(both[-1], both[-1]) - np.eye(len(e))).max())

    def project(batches):
        for b in batches:
            keep, entries = usable(b, "v")
            if len(keep):
                off = known.deviations(filled(entries, d))
                w = (off.astype(float) / known.n) @ onto
                squares = pa.array([Decimal(x) if x < 10**38 else None for x in known.squares(off)], pa.decimal128(38, 0))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), squares, lists], ["id", "deviation", "w"])

    out = rows.mapInArrow(in_task(project), f"id {rows.schema['id'].dataType.simpleString()}, deviation decimal(38,0), w array<double>")
    out = out.select("id", "deviation", F.posexplode("w").alias("_at", "whitened"))
    explained = F.element_at(F.array(*(F.lit(float(x / trace)) for x in e)), F.col("_at") + 1)
    return out.select(F.col("id").alias(id_col), (F.col("_at") + 1).alias("component"), F.lit(known.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's whitening of all embeddings; a deviation that passes 64 bits is null (decimal in `whitened`)."""
    out = whitened(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
