"""What the operators of this subpackage share: tables, written intermediates, vocabulary files and words of texts."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that one Arrow batch carries at most between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

#: Bytes that part words: the space and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that a worker's memo of words may hold, and what an entry takes beside its text.
MEMO_BYTES, MEMO_ENTRY = 40 << 20, 150
#: Bytes of a word above which it is hashed on its own.
LONG_WORD = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A session without one (tests, one machine) gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="recallspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back, so that later steps neither recompute it nor lose it with an executor.

    What is written stays until `release`, for results are lazy and read it.
    """
    path = f"{shared_dir(df.sparkSession)}/recallspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def release(spark: SparkSession) -> int:
    """Deletes all that `materialize` has written in this process, and says how many tables; results that read them must be done with."""
    paths = [*_written]
    _written.clear()
    return _delete(spark, paths)


@contextlib.contextmanager
def scope(spark: SparkSession, drop: str | None = None):
    """Gives a function that materializes the one result of a step, and its path; at the end all else that the step wrote is deleted, and the path to drop."""
    begun, kept = len(_written), []

    def keep(df: DataFrame) -> tuple[DataFrame, str]:
        out = materialize(df)
        kept.append(_written[-1])
        return out, kept[-1]

    yield keep
    gone = [p for p in _written[begun:] if p not in kept] + [drop] * bool(drop)
    _written[:] = [p for p in _written if p not in gone]
    _delete(spark, gone)


def in_task(run):
    """run (batches -> batches) for a worker that stays: gives freed memory back to the system when its task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library can
                ctypes.CDLL(None).malloc_trim(0)

    return whole


class Memo(dict):
    """A memo of a worker bounded by the bytes of its keys and values; it starts anew once they exceed `limit`."""

    def __init__(self, limit: int = MEMO_BYTES):
        super().__init__()
        self.limit, self.used = limit, 0

    def room(self) -> None:
        """Empties the memo if it is over its limit; called between batches."""
        if self.used > self.limit:
            self.clear()
            self.used = 0

    def keep(self, key: str, value, size: int) -> None:
        self[key] = value
        self.used += len(key) + size + MEMO_ENTRY


def vocabulary(name_or_path: str) -> str:
    """A vocabulary file: a path, or the name of one of the installed public files."""
    if os.path.isabs(name_or_path):
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit words; a bijection."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive 64-bit hashes, by doubling; mixing after each step keeps it free of linear relations."""
    many = len(values) - n + 1
    if many <= 0:
        return np.zeros(0, np.uint64)
    out, used, level, width = np.full(many, n, np.uint64), 0, values, 1
    while True:
        if n & width:
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + level[used : used + many])
            used += width
        if 2 * width > n:
            return out
        level = mix(level[:-width] * np.uint64(0x9E3779B97F4A7C15) + level[width:])
        width *= 2


def shingle_hashes(values: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text in turn, and how many each text has; fewer words than a shingle are one, none have none."""
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    begin = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    long = np.repeat(n >= words, count)
    base = np.repeat(first[:-1] - begin, count) + np.arange(len(out))
    out[long] = window_hashes(values, words)[base[long]]
    for k in range(1, words):
        rows = np.flatnonzero(n == k)
        if len(rows):
            out[begin[rows]] = window_hashes(values, k)[first[rows]]
    return out, count


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Joined texts, start and end of each word there, and the index of each text's first word (one more entry closes the last)."""
    blob = b"\n".join(texts)
    solid = np.zeros(len(blob) + 2, np.int8)
    solid[1:-1] = ~SPACE[np.frombuffer(blob, np.uint8)]
    step = np.diff(solid)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return blob, start, end, np.searchsorted(start, begin)


def word_hashes(blob: bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time through a bijection, words of over LONG_WORD bytes by XXH64."""
    size = end - start
    lanes = np.ndarray((len(blob) + 1,), "<u8", blob + bytes(8), 0, (1,))
    h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed + 1))
    for k in range(0, min(int(size.max(initial=0)), LONG_WORD), 8):
        rows = np.flatnonzero(size > k) if k else slice(None)
        rest = np.minimum(size[rows] - k, 8).astype(np.uint64)
        lane = lanes[start[rows] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        h[rows] = mix(h[rows] * np.uint64(0x9E3779B97F4A7C15) + lane)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = xxhash.xxh64_intdigest(blob[start[k] : end[k]], seed)
    return h


def by_bytes(sizes: list[int], limit: int):
    """Slices of consecutive rows of about limit bytes, at least one row each."""
    first, total = 0, 0
    for k, n in enumerate(sizes):
        if k > first and total + n > limit:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)
