"""Byte-level BPE encoding and decoding.

Class arrays and a scan over transition functions cut texts into pre-tokens (pretokenize.py); each slice goes through a merge
memo, so pairs are merged once per distinct pre-token and worker until the bounded memo starts anew. Token ids travel packed
(little-endian unsigned 32-bit), with the byte offset of each token in its text, and decoding gathers token bytes by array.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.common import Memo, in_task, table, texts_of, vocabulary
from recallspark.llm.pretokenize import fused_pairs, parts, pieces

#: Bytes encoded at a time, and the longest pre-token that the memo keeps.
PART_BYTES, KEPT_CHARS = 1 << 20, 64


class Merges(Memo):
    """Pre-token -> packed ids. A miss merges pairs under the ranks and is kept unless it is long."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # one match takes a whole pre-token: boundaries are found by the scan
        self.merge = tiktoken.Encoding("slices", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.fused = fused_pairs(ranks)
        size = max(ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        for token, k in ranks.items():
            self.length[k] = len(token)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.zeros(int(self.length.sum()), np.uint8)
        for token, k in ranks.items():
            self.flat[self.begin[k] : self.begin[k] + len(token)] = np.frombuffer(token, np.uint8)

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.merge(piece), "<u4").tobytes()
        if len(piece) <= KEPT_CHARS:
            self.keep(piece, out, len(out))
        return out


_merges: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    if path not in _merges:
        _merges[path] = Merges(path)
    return _merges[path]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Packed ids of each text."""
    memo, out = merges(path), [[] for _ in texts]
    for group in parts(texts, PART_BYTES, memo.fused):
        memo.room()
        found, first, _ = pieces([t for _, t in group])
        ids = [*map(memo.__getitem__, found)]
        cut = first.tolist()
        for k, (row, _) in enumerate(group):
            out[row].append(b"".join(ids[cut[k] : cut[k + 1]]))
    return [b"".join(x) for x in out]


def decode(packed: list[bytes], path: str) -> list[bytes]:
    """The bytes that packed ids stand for."""
    memo = merges(path)
    out = []
    for x in packed:
        ids = np.frombuffer(x, "<u4")
        n = memo.length[ids]
        end = np.cumsum(n)
        at = np.arange(int(end[-1]) if len(ids) else 0) + np.repeat(memo.begin[ids] - end + n, n)
        out.append(memo.flat[at].tobytes())
    return out


def offsets(packed: bytes, path: str) -> np.ndarray:
    """Where each token begins in its text, in bytes."""
    n = merges(path).length[np.frombuffer(packed, "<u4")]
    return np.cumsum(n) - n


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, with_offsets: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = encode(texts_of(b, "text"), path)
        columns = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        if with_offsets:
            columns.append(pa.array([offsets(x, path).astype("<u4").tobytes() for x in ids], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "offsets"][: len(columns)])


def decoded_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decode([x or b"" for x in b.column(b.schema.get_field_index("ids")).to_pylist()], path), pa.binary())], [*b.schema.names, "decoded"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), dict(docs.dtypes)[id_col]


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per row of docs: its id, n_tokens, ids and offsets (packed unsigned 32-bit integers: token ids and byte offsets).

    Null text counts as empty (no ids); a null id stays null; repeated rows each give a row; an empty table gives none; other
    columns are not read. No special token is ever made.
    """
    path, (texts, kind) = vocabulary(ranks), _texts(docs, id_col, text_col)
    return texts.mapInArrow(in_task(lambda it: encoded_batches(it, path, True)), f"id {kind}, n_tokens long, ids binary, offsets binary").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The bytes of packed ids: id_col, ids, decoded (binary). Null ids decode to no bytes."""
    path, kind = vocabulary(ranks), dict(encoded.dtypes)[id_col]
    out = encoded.select(F.col(id_col).alias("id"), "ids")
    return out.mapInArrow(in_task(lambda it: decoded_batches(it, path)), f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """bpe_encode and then bpe_decode in one pass over each batch: id_col, n_tokens, ids, decoded. Edge cases as there."""
    path, (texts, kind) = vocabulary(ranks), _texts(docs, id_col, text_col)
    out = texts.mapInArrow(in_task(lambda it: decoded_batches(encoded_batches(it, path, False), path)), f"id {kind}, n_tokens long, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests of the round trip over all documents."""
    out = bpe_round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}
