"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

Texts are grouped into batches of like size in bytes, longer ones are cut at safe boundaries, and each distinct pre-token
of a batch is encoded once by the library; a memo bounded by bytes keeps the lengths of pre-tokens seen before. No shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.common import Memo, in_task, table, texts_of, vocabulary
from recallspark.llm.pretokenize import fused_pairs, parts, pieces

#: Bytes encoded at a time, and the longest pre-token that the memo keeps.
PART_BYTES, KEPT_CHARS = 1 << 20, 64

_encoders: dict[str, tuple] = {}


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


def encoder(path: str) -> tuple:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not path.endswith(".json"):
            raise ValueError(f"{path}: only byte-level BPE vocabularies of the tokenizers library (.json) are counted")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec.get("pre_tokenizer") or {}
        if steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or not steps.get("use_regex", True) or spec.get("normalizer") or (spec.get("model") or {}).get("type", "BPE") != "BPE":
            raise ValueError(f"{path}: texts are cut by the byte-level rules, which are not this vocabulary's")
        model, letters = Tokenizer.from_file(path), byte_letters()
        special = sorted((t.content for t in model.get_added_tokens_decoder().values()), key=len, reverse=True)
        fused = fused_pairs([letters[c] for c in t] for t in model.get_vocab(with_added_tokens=False))
        _encoders[path] = model, special, Memo(), fused
    return _encoders[path]


def count(texts: list[str], path: str) -> np.ndarray:
    """The number of tokens of each text. Special strings in a text are what the library makes of them by default: one token each."""
    model, special, memo, fused = encoder(path)
    total = np.zeros(len(texts), np.int64)
    plain: list[tuple[int, str]] = []
    for row, text in enumerate(texts):
        runs = [text]
        for s in special:
            if s in text:
                runs = [x for r in runs for x in r.split(s)]
        total[row] += len(runs) - 1
        plain += ((row, r) for r in runs)
    for group in parts([t for _, t in plain], PART_BYTES, fused):
        found, first, _ = pieces([t for _, t in group])
        memo.room()
        if new := [*set(found).difference(memo)]:
            lengths = dict(zip(new, map(len, model.encode_batch_fast(new, add_special_tokens=False))))
            for x, n in lengths.items():
                if len(x) <= KEPT_CHARS:
                    memo.keep(x, n, 0)
        known = memo if not new else lengths | {x: memo[x] for x in set(found).difference(lengths)}
        sums = np.concatenate([[0], np.cumsum(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))])
        np.add.at(total, [plain[k][0] for k, _ in group], sums[first[1:]] - sums[first[:-1]])
    return total


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """One row per row of docs: its id, n_bytes (UTF-8), n_tokens and whether they exceed limit.

    Null text counts as empty (0, 0, false); a null id stays null; repeated rows each give a row; an empty table gives none;
    other columns of docs are not read. Begin, end and padding tokens are never counted. A vocabulary with other rules than
    byte-level BPE is refused.
    """
    path = vocabulary(tokenizer)
    encoder(path)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(count(texts_of(b, "text"), path), pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_bytes"))
    out = out.mapInArrow(in_task(lengths), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict[str, str] = {}
