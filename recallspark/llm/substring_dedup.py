"""Substring dedup by de Bruijn compaction.

Every run of 13 words is an edge between its first and last 12 words. Edges are dealt out by their anchor, the five-word run of least
hash within them, so that neighbouring edges mostly meet in one task. There each occurrence of an edge that a document with a
smaller id also holds learns where it stands there (the source: smallest id, first position), and consecutive edges whose sources are
consecutive too compact into a path; a node where the source changes branches and ends it. Paths that meet at a node,
with the source going on, are then joined over all documents into long spans. Source coordinates verify every span: a
digest of its words is compared with one of the source's words. If any differ (a key collision), all is done again with another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.llm.common import by_bytes, in_task, materialize, mix, table, texts_of, window_hashes, word_hashes, words_of

#: Words of a window and of its anchor, bytes of text that meet the buckets as one row each, seeds that are tried.
WINDOW, ANCHOR, PART_BYTES, ATTEMPTS = 13, 5, 1 << 20, 3
#: Bytes of text whose edges make up a bucket (about as many bytes of keys), and buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 1 << 16
#: Bytes of an edge's key that are sent beside its anchor's eight.
KEY_BYTES = 5
#: Places whose words are compared that may be sent to every task; more are joined by a shuffle.
BROADCAST_PLACES = 400_000

_PIECE = np.dtype([("id", "<i8"), ("t", "<i8"), ("pos", "<i4"), ("n", "<i4"), ("src", "<i8"), ("src_t", "<i8"), ("src_pos", "<i4")])
_PACKED = "bucket int, keys binary, anchors binary, starts binary, sizes binary, ids binary, firsts binary, pieces binary"


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """The index of the leftmost least value of each `width` consecutive ones."""
    many = max(len(values) - width + 1, 0)
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best[:many]


def _paths(at: np.ndarray, own: np.ndarray, source_at: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First edge and number of edges of each path: consecutive places of one document with consecutive places of one source."""
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(own) != 0) | (np.diff(source_at) != 1) | (np.diff(source) != 0)]))
    return cut, np.diff(np.append(cut, len(at)))


def _pieces(ids, ts, at, own, source_at, source) -> np.ndarray:
    """Paths as packed records; own and source number documents of ids and ts, places count from each document's start."""
    cut, n = _paths(at, own, source_at, source)
    out = np.empty(len(cut), _PIECE)
    out["id"], out["t"], out["pos"], out["n"] = ids[own[cut]], ts[own[cut]], at[cut], n
    out["src"], out["src_t"], out["src_pos"] = ids[source[cut]], ts[source[cut]], source_at[cut]
    return out


def _edges(buckets: int, window: int, seed: int):
    """Edges of batches of documents, a row for each bucket they meet; copies within a batch are told on the spot and not sent."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), *[pa.binary()] * 7)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["bucket", "keys", "anchors", "starts", "sizes", "ids", "firsts", "pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ts = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            by_id = np.argsort(ids, kind="stable")
            texts = texts_of(b, "text")
            raw = [texts[k].encode() for k in by_id.tolist()]
            ids, ts = ids[by_id], ts[by_id]
            for lo, hi in by_bytes([len(t) for t in raw], PART_BYTES):
                blob, start, end, first = words_of(raw[lo:hi])
                own = np.repeat(np.arange(hi - lo), np.diff(first))
                at = np.flatnonzero(first[1:][own] - np.arange(len(start)) >= window)
                if not len(at):
                    continue
                h = word_hashes(blob, start, end, seed)
                key, g = window_hashes(h, window)[at], window_hashes(h, ANCHOR)
                low = leftmost_least(g, window - ANCHOR + 1)[at]
                own = own[at]
                # of equal edges the first by id stands for all: rows are in order of id, so a stable sort keeps it first
                order = np.argsort(key, kind="stable")
                new = np.concatenate([[True], np.diff(key[order]) != 0])
                head = np.empty(len(order), np.int64)
                head[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                part_ids, part_ts = ids[lo:hi], ts[lo:hi]
                late = np.flatnonzero(part_ids[own] != part_ids[own[head]])
                places = at - first[:-1][own]
                rows = []
                if len(late):
                    found = _pieces(part_ids, part_ts, places[late], own[late], places[head[late]], own[head[late]])
                    rows.append((int(at[0]) % buckets, b"", b"", b"", b"", b"", b"", found.tobytes()))
                sent = np.flatnonzero(part_ids[own] == part_ids[own[head]])
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(at[sent]) != 1) | (np.diff(low[sent]) != 0)]))
                size = np.diff(np.append(cut, len(sent)))
                anchor = g[low[sent[cut]]]
                bucket = (mix(anchor) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                begin = np.flatnonzero(np.diff(bucket[order], prepend=-1) != 0)
                for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(order)]):
                    runs = order[a:z]
                    each = size[runs]
                    edges = sent[np.repeat(cut[runs] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
                    docs = np.unique(own[edges])
                    keys = np.ascontiguousarray(key[edges]).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                    named = np.stack([part_ids[docs], part_ts[docs]], 1)
                    rows.append((int(bucket[runs[0]]), keys.tobytes(), anchor[runs].tobytes(), at[sent[cut[runs]]].astype("<i4").tobytes(), each.astype(np.uint8).tobytes(), named.tobytes(), first[docs].astype("<i4").tobytes(), b""))
                    if len(rows) >= 512:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    return run


def _bucket_paths(rows: list[tuple]) -> np.ndarray | None:
    """Paths of the edges of one bucket that a document with a smaller id holds."""
    parts: list[list[np.ndarray]] = [[] for _ in range(5)]
    docs = 0
    for keys, anchors, starts, sizes, named, firsts in rows:
        each, first = np.frombuffer(sizes, np.uint8).astype(np.int64), np.frombuffer(firsts, "<i4")
        wide = np.zeros((len(keys) // KEY_BYTES, 8), np.uint8)
        wide[:, :KEY_BYTES] = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BYTES)
        at = np.repeat(np.frombuffer(starts, "<i4") - (np.cumsum(each) - each), each) + np.arange(len(wide))
        doc = np.searchsorted(first, at, "right") - 1
        for x, v in zip(parts, (wide.view(np.uint64).ravel(), np.repeat(np.frombuffer(anchors, np.uint64), each), (doc + docs).astype(np.int32), (at - first[doc]).astype(np.int32), np.frombuffer(named, np.int64).reshape(-1, 2))):
            x.append(v)
        docs += len(first)
    key, anchor, doc, at, named = (np.concatenate(x) for x in parts)
    parts.clear()
    both = mix(anchor + key * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    same = np.diff(both[order]) == 0
    many = np.zeros(len(order), bool)
    many[1:] |= same
    many[:-1] |= same
    some = order[many]
    key, anchor, doc, at = key[some], anchor[some], doc[some], at[some]
    if not len(key):
        return None
    ids, ts = named[:, 0], named[:, 1]
    order = np.lexsort((at, ts[doc], ids[doc], key, anchor))
    key, anchor, doc, at = key[order], anchor[order], doc[order], at[order]
    head = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(anchor) != 0)]))
    source = np.repeat(head, np.diff(np.append(head, len(key))))
    late = np.flatnonzero(ids[doc] != ids[doc[source]])
    if not len(late):
        return None
    late = late[np.lexsort((at[late], doc[late]))]
    return _pieces(ids, ts, at[late].astype(np.int64), doc[late], at[source[late]].astype(np.int64), doc[source[late]])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of repeated edges, and where they stand first; a task's buckets stay packed until each has its turn."""

    def out(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[c]).astype(np.int64)) for c in found.dtype.names], list(found.dtype.names))

    held: dict[int, list[tuple]] = {}
    for b in batches:
        for bucket, *row, pieces in zip(*(b.column(c).to_pylist() for c in range(8))):
            if pieces:
                yield out(np.frombuffer(pieces, _PIECE))
            else:
                held.setdefault(bucket, []).append(tuple(row))
    for bucket in [*held]:
        if (found := _bucket_paths(held.pop(bucket))) is not None:
            yield out(found)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the words at places (pos, words) of texts."""
    for b in batches:
        out = []
        for row, t, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b, "text"), b.column(3).to_pylist()):
            blob, start, end, _ = words_of([text.encode()])
            for p in places:
                a, n = p["pos"], p["words"]
                digest = hashlib.blake2b(digest_size=16)
                for lo in range(a, a + n, 4096):
                    digest.update(b"".join([blob[start[k] : end[k]] + b" " for k in range(lo, min(a + n, lo + 4096, len(start)))]))
                out.append((row, t, a, n, digest.digest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((*[pa.int64()] * 4, pa.binary()))], ["id", "t", "pos", "words", "digest"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the words of spans (pos, words) out of texts; other columns pass."""
    for b in batches:
        out = []
        for text, places in zip(texts_of(b, "_text"), b.column(b.schema.get_field_index("_places")).to_pylist()):
            blob, start, end, _ = words_of([text.encode()])
            drop = np.zeros(len(start) + 1, np.int32)
            for p in places or ():
                drop[p["pos"]] += 1
                drop[p["pos"] + p["words"]] -= 1
            keep = np.cumsum(drop[:-1]) == 0
            words = [blob[a:e] for a, e in zip(start[keep].tolist(), end[keep].tolist())]
            out.append((len(start), len(start) - len(words), b" ".join(words).decode()))
        names = [c for c in b.schema.names if c not in ("_text", "_places")]
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], [*names, "_n", "_gone", "_kept"])


def joined_paths(pieces: DataFrame) -> DataFrame:
    """Spans from paths: a path that begins at the node where another of the same document and source ends goes on from it.

    Paths of one document and source lie on one diagonal (place less source place) where they can meet, so their nodes are met in
    order there.
    """
    line = Window.partitionBy("id", "t", "src", "src_t", "_line").orderBy("pos")
    rows = pieces.withColumn("_line", F.col("pos") - F.col("src_pos"))
    rows = rows.withColumn("_new", F.when(F.lag(F.col("pos") + F.col("n")).over(line) == F.col("pos"), 0).otherwise(1))
    rows = rows.withColumn("_span", F.sum("_new").over(line))
    spans = rows.groupBy("id", "t", "src", "src_t", "_line", "_span").agg(F.min("pos").alias("pos"), F.sum("n").alias("n"))
    return spans.select("id", "t", "pos", "n", "src", "src_t", (F.col("pos") - F.col("_line")).alias("src_pos"))


def repeated_spans(texts: DataFrame, window: int) -> DataFrame:
    """id, t, pos, words: the spans of words of each row of texts (id, t, text) that windows of rows with smaller ids cover; t tells rows of one id apart."""
    spark = texts.sparkSession
    texts = texts.where("id is not null").select("id", "t", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(16, -(-size // BUCKET_BYTES)))
    for seed in range(ATTEMPTS):
        edges = texts.mapInArrow(in_task(_edges(buckets, window, seed)), _PACKED)
        pieces = edges.repartition(buckets, "bucket").mapInArrow(in_task(_repeats), "id long, t long, pos long, n long, src long, src_t long, src_pos long")
        spans = materialize(joined_paths(pieces).withColumn("words", F.col("n") + (window - 1)).drop("n"))
        asked = spans.select("id", "t", "pos", "words").unionByName(spans.select(F.col("src").alias("id"), F.col("src_t").alias("t"), F.col("src_pos").alias("pos"), "words")).distinct()
        asked = materialize(asked)
        grouped = asked.groupBy(F.col("id").alias("_i"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("pos", "words")).alias("places"))
        if asked.count() <= BROADCAST_PLACES:
            grouped = F.broadcast(grouped)
        found = texts.join(grouped, (texts.id == F.col("_i")) & (texts.t == F.col("_t"))).select("id", "t", "text", "places")
        found = materialize(found.mapInArrow(in_task(_digests), "id long, t long, pos long, words long, digest binary"))
        theirs = found.withColumnsRenamed({"id": "src", "t": "src_t", "pos": "src_pos", "digest": "theirs"})
        unlike = spans.join(found, ["id", "t", "pos", "words"]).join(theirs, ["src", "src_t", "src_pos", "words"]).where("digest <> theirs")
        if not unlike.limit(1).count():
            return spans.select("id", "t", "pos", "words")
    raise RuntimeError("window keys collided under every seed")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """id_col, the columns of carry, n_words, n_removed and kept (the kept words joined by one space) of every row of docs.

    A word goes if a window of that many consecutive words covers it whose sequence also starts in a row with a smaller id.
    Null text has no words. Rows with a null id keep all and are no one's source. Rows that share an id do not thin each other
    out, nor do repeats within one text; the same (id, text) twice gives two rows. An empty table gives no rows; columns other
    than carry are not read, whatever their names. Ids are whole numbers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.struct(*(carry or [F.lit(0)])).alias("_carried"))
    shared = rows.where("_id is not null").groupBy("_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    # rows that share an id are told apart by their texts
    rows = rows.withColumn("_row", F.xxhash64("_text") if shared else F.lit(0).cast("long"))
    one = rows.select(F.col("_id").alias("id"), F.col("_row").alias("t"), F.col("_text").alias("text"))
    spans = repeated_spans(one.dropDuplicates(["id", "t"]) if shared else one, window)
    marks = spans.groupBy(F.col("id").alias("_i"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("pos", "words")).alias("_places"))
    marked = rows.join(marks, (rows._id == marks._i) & (rows._row == marks._t), "left").select("_id", "_carried", "_text", "_places")
    kind = dict(marked.dtypes)["_carried"]
    out = marked.mapInArrow(in_task(_kept), f"_id long, _carried {kind}, _n long, _gone long, _kept string")
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_carried.{c}").alias(c) for c in carry or []), F.col("_n").alias("n_words"), F.col("_gone").alias("n_removed"), F.col("_kept").alias("kept"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of substring_dedup over all documents."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES: dict[str, str] = {}
