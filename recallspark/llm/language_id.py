"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies are counted over all training rows; weights are trained by follow-the-regularised-leader with elastic-net
penalties on a bounded sample of them, and a temperature is fitted on a part of the sample kept apart. The model (a few hundred
kilobytes, whatever the input) travels with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.common import in_task, table, texts_of
from recallspark.llm.pretokenize import LETTER, classes

#: Hashed features, longest n-gram, characters worked on at a time.
FEATURES, GRAMS, CHARS = 1 << 15, 3, 400_000
#: Training rows that the weights are fitted on at most (the only bounded part), passes, FTRL's rates and penalties.
SAMPLE, PASSES, ALPHA, BETA, L1, L2 = 3000, 2, 0.5, 1.0, 0.02, 0.01


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams (1 to GRAMS letters, runs of others as one blank), the text each comes from, and whether a text has letters."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])
    letter = classes()[points] == LETTER
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    code = np.where(letter, points, 32).astype(np.uint64)[keep]
    owner = owner[keep]
    hashes, owners = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, GRAMS + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        inside = owner[:m] == owner[n - 1 :]
        mixed = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURES.bit_length() + 1)
        hashes.append(mixed[inside].astype(np.int32))
        owners.append(owner[:m][inside])
    if not hashes:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), has
    return np.concatenate(hashes), np.concatenate(owners), has


def _groups(texts: list[str], limit: int = CHARS):
    first, total = 0, 0
    for k, t in enumerate(texts):
        if k > first and total + len(t) > limit:
            yield first, k
            first, total = k, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (FEATURES + 1, languages); the last row is the bias
    temperature: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        table = (self.weights[:-1] * (self.idf * SCALE)[:, None]).astype(np.float32)
        for lo, hi in _groups(texts):
            h, owner, has = grams(texts[lo:hi])
            logits = np.stack([np.bincount(owner, table[:, c][h], hi - lo) for c in range(len(self.languages))], 1) if len(self.languages) else np.zeros((hi - lo, 1))
            logits = logits / np.maximum(np.bincount(owner, minlength=hi - lo), 1)[:, None] + (self.weights[-1] if len(self.languages) else 0)
            p = _softmax(logits / self.temperature)
            known = has & bool(self.languages)
            best = p.argmax(1)
            names += [self.languages[b] if k else "und" for b, k in zip(best, known)]
            scores.append(np.where(known, p.max(1), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


SCALE = 30.0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(FEATURES, np.int64), 0
    for b in batches:
        texts = texts_of(b, "text")
        rows += len(texts)
        for lo, hi in _groups(texts):
            h, owner, _ = grams(texts[lo:hi])
            for a in range(0, hi - lo, 64):
                own = (owner >= a) & (owner < a + 64) if hi - lo > 64 else slice(None)
                seen = np.zeros((min(64, hi - lo - a), FEATURES), bool)
                seen[owner[own] - a, h[own]] = True
                total += seen.sum(0)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], ["feature", "df"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed distinct features of each text and how often each occurs; at most FEATURES, however long the text."""
    for b in batches:
        found = [np.unique(grams([t])[0], return_counts=True) for t in texts_of(b, "text")]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[k].astype("<i4").tobytes() for f in found], pa.binary()) for k in (0, 1))], ["h", "lang", "features", "counts"])


def _sparse(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(features, FEATURES), np.append(counts / max(counts.sum(), 1) * idf[features] * SCALE, 1.0)


def fit_weights(counted: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray) -> Model:
    """FTRL-proximal with elastic net on four fifths of the rows, then the temperature of least loss on the rest."""
    languages = sorted(set(labels))
    rows = [_sparse(f, c, idf) for f, c in counted]
    y = np.array([languages.index(x) for x in labels], int)
    apart = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    z, n = np.zeros((FEATURES + 1, len(languages))), np.zeros((FEATURES + 1, len(languages)))

    def weights(f) -> np.ndarray:
        shrunk = np.sign(z[f]) * np.maximum(np.abs(z[f]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[f])) / ALPHA + L2)

    for _ in range(PASSES):
        for k in np.flatnonzero(~apart):
            f, x = rows[k]
            w = weights(f)
            g = x[:, None] * (_softmax(x @ w) - (np.arange(len(languages)) == y[k]))
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
    w = weights(slice(None))
    temperature = 1.0
    if apart.any():
        logits = np.stack([rows[k][1] @ w[rows[k][0]] for k in np.flatnonzero(apart)])
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(logits)), y[apart]] + 1e-12).mean()
        temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
    return Model(languages, idf, w, temperature)


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from labelled rows; null labels and null texts take no part. No rows: a model that knows no language.

    Frequencies are counted over all rows; weights come from the `sample` distinct rows (id and text) whose hashes are smallest.
    Only their feature counts go to the driver, no texts. Ties between languages go to the first by name.
    """
    own = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counted = own.select("text").mapInArrow(in_task(_frequencies), "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()  # FEATURES rows at most
    feature, times = (counted.column(c).to_numpy().astype(np.int64) for c in ("feature", "df"))
    df, total = np.zeros(FEATURES), int(times[feature < 0].sum())
    df[feature[feature >= 0]] = times[feature >= 0]
    idf = np.log((1 + total) / (1 + df)) + 1
    hashed = own.withColumn("h", F.xxhash64("id", "text"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(sample)
    some = hashed.join(F.broadcast(chosen), "h", "left_semi").select("h", "lang", "text").mapInArrow(in_task(_counted), "h long, lang string, features binary, counts binary")
    picked = sorted(some.groupBy("h", "lang").agg(F.first("features").alias("features"), F.first("counts").alias("counts")).collect(), key=lambda r: (r["h"], r["lang"]))[:sample]
    read = lambda x: np.frombuffer(x, "<i4").astype(np.int64)
    return fit_weights([(read(r["features"]), read(r["counts"])) for r in picked], [r["lang"] for r in picked], idf)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced). Null text or text without letters is `und`, score 0.

    Repeated rows are predicted each; ties go to the first language by name; an empty table gives no rows; other columns pass.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = model.predict([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return docs.select(*kept).mapInArrow(in_task(run), ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Rows kept out of training: crc32 of the id as text leaves no remainder. A null id is no held-out row."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's prediction for all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
