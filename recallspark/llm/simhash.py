"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within r differing bits share a variant within r/2 bits of both. Every distinct fingerprint is sent to each
bucket (leading bits) that one of its variants falls into, so the shuffle is on variants but carries a fingerprint once a
bucket; there its variants of that bucket are made, sorted, and fingerprints that collide on one are verified and linked.
A bucket returns one link per fingerprint (to the smallest it reaches there), never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.common import by_bytes, in_task, materialize, mix, shingle_hashes, table, texts_of, word_hashes, words_of
from recallspark.llm.components import components, local_components, spanning_forest

BITS, RADIUS, SEED = 64, 4, 42
#: Distinct fingerprints that a bucket (variants with the same leading bits) is to hold about, most leading bits, variants held at a time in a task.
BUCKET_ROWS, MOST_BUCKET_BITS, CHUNK = 16_384, 24, 1_000_000
#: Fingerprints of similar_documents and their bits; bits of the parity signature of a text's shingle set.
TABLES, TABLE_BITS, PARITY_BITS = 10, 36, 512
#: Texts up to which those hold, and bits of all tables of more texts; fingerprints that a bucket of theirs holds.
TEXTS, SKETCH_BITS, TABLE_ROWS = 1 << 18, 384, 8 << 20
#: Shingles of a text for each further leading shingle that it must share with another.
MORE = 100
#: Pairs that connect a bucket are taken so many times over: only a saving, as the exact join that follows finds what they miss.
FORESTS = 2
#: Texts that share a leading shingle and meet in one task; more are met in pairs of blocks.
BLOCK = 4096
#: Cells of the count that ranks shingles from rare to common, and bytes of text whose leading shingles a task of the exact join holds.
COUNT_CELLS, TASK_BYTES = 1 << 20, 64 << 20

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def fingerprints_of(texts: list[str], words: int) -> np.ndarray:
    """The SimHash of each text over its word shingles, repeats included; 0 for a text without words."""
    out = np.zeros(len(texts), np.uint64)
    raw = [t.encode().translate(_LOWER) for t in texts]
    for lo, hi in by_bytes([len(t) for t in raw], 1 << 20):
        blob, start, end, first = words_of(raw[lo:hi])
        n = np.diff(first)
        count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
        # words of all texts joined by single spaces, so that a shingle is one slice
        flat = b" ".join([blob[a:b] for a, b in zip(start.tolist(), end.tolist())])
        stop = np.cumsum(end - start + 1)
        begin = stop - (end - start + 1)
        total = int(count.sum())
        base = np.repeat(first[:-1], count) + (np.arange(total) - np.repeat(np.cumsum(count) - count, count))
        last = base + np.repeat(np.minimum(n, words), count) - 1
        h = np.fromiter((xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in zip(begin[base].tolist(), (stop[last] - 1).tolist())), np.uint64, total)
        some = np.flatnonzero(count)
        for k in range(0, len(some), 4096):
            rows = some[k : k + 4096]
            cut = np.concatenate([[0], np.cumsum(count[rows])])
            at = int(count[: rows[0]].sum())
            bits = np.unpackbits(h[at : at + cut[-1]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, cut[:-1], axis=0, dtype=np.int32)
            major = np.packbits(2 * ones > count[rows][:, None], axis=1)
            out[lo + rows] = np.ascontiguousarray(major).view(">u8").ravel().astype(np.uint64)
    return out


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """id_col and fp (the 64 bits as a signed long) of every row. Null and empty texts have fingerprint 0."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(texts_of(b, "text"), words).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(in_task(run), f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _masks(bits: range, most: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)]


def bucket_pairs(fps: np.ndarray, bucket: int, radius: int, bucket_bits: int, bits: int = BITS) -> np.ndarray:
    """Indexes (a, b), a < b, of sorted distinct fingerprints that stand side by side at a variant of this bucket and lie within radius."""
    half, low = radius // 2, bits - bucket_bits
    flips = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(bucket))
    # variants are met by their next bits, so that a part stays within CHUNK
    masks = [np.array(_masks(range(low), half - k), np.uint64) for k in range(half + 1)]
    made = sum(int((flips == k).sum()) * len(m) for k, m in enumerate(masks))
    splits = max(0, (made // CHUNK).bit_length())
    span, n = np.uint64(low - splits), len(fps)
    tail, room = np.uint64((1 << int(span)) - 1), np.uint64(max(1, n - 1).bit_length())
    packed = span + room <= 64
    # fingerprints lie in the order of those bits and masks are told apart by theirs, so a part looks at what is in it only
    classes = []
    for k, m in enumerate(masks):
        rows = np.flatnonzero(flips == k)
        lead = (fps[rows] >> span) & np.uint64((1 << splits) - 1)
        order = np.argsort(lead, kind="stable")
        rows, head = rows[order], m >> span
        begin = np.searchsorted(lead[order], np.arange((1 << splits) + 1, dtype=np.uint64)).tolist()
        classes.append((rows.astype(np.uint64), fps[rows] & tail, begin, [(x, m[head == x] & tail) for x in np.unique(head).tolist()]))
    found = []
    for part in range(1 << splits):
        keys, owner = [], []
        for rows, rest, begin, heads in classes:
            for x, fit in heads:
                lo, hi = begin[part ^ x], begin[(part ^ x) + 1]
                if lo == hi:
                    continue
                key, own = rest[lo:hi, None] ^ fit, rows[lo:hi, None]
                keys.append(((key << room | own) if packed else key).ravel())
                if not packed:
                    owner.append(np.repeat(own, len(fit)))
        if not keys:
            continue
        key = np.concatenate(keys)
        if packed:
            key.sort()
            own, key = key & np.uint64((1 << int(room)) - 1), key >> room
        else:
            order = np.argsort(key, kind="stable")
            own, key = np.concatenate(owner)[order], key[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        x, y = np.minimum(own[same], own[same + 1]).astype(np.int64), np.maximum(own[same], own[same + 1]).astype(np.int64)
        near = np.bitwise_count(fps[x] ^ fps[y]) <= radius
        found.append(np.unique(x[near] * n + y[near]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return np.stack([pairs // max(1, n), pairs % max(1, n)], 1)


def bucket_links(fps: np.ndarray, bucket: int, radius: int, bucket_bits: int) -> np.ndarray:
    """Links (a, b) of fingerprints that share a variant in this bucket; b is the smallest that a reaches here."""
    fps = np.unique(fps)
    pairs = bucket_pairs(fps, bucket, radius, bucket_bits)
    label = local_components(pairs[:, 0], pairs[:, 1], len(fps))
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return np.stack([fps[moved], fps[label[moved]]], 1)


def bits_for(rows: int, radius: int, held: int = BUCKET_ROWS) -> int:
    """So many leading bits that a bucket holds about `held` of that many fingerprints, each of which goes to all buckets within half the radius."""
    for bits in range(4, MOST_BUCKET_BITS):
        if rows * len(_masks(range(bits), radius // 2)) <= held << bits:
            return bits
    return MOST_BUCKET_BITS


def shape_for(texts: int, radius: int = RADIUS) -> tuple[int, int]:
    """Tables and bits of each for so many texts: a fingerprint has no more others within the radius by chance than among TEXTS, so their pairs do not grow with the square of the texts."""
    ball = lambda bits: sum(comb(bits, k) for k in range(radius + 1)) / (1 << bits)
    bits = TABLE_BITS
    while bits < BITS - 4 and texts * ball(bits) > TEXTS * ball(TABLE_BITS):
        bits += 1
    return min(TABLES, SKETCH_BITS // bits), bits


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket_bits: int | None = None) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect exactly those within radius bits of one another."""
    fps = fps.select("fp").distinct()
    bucket_bits = bucket_bits or bits_for(fps.count(), radius)
    reach = F.lit(_masks(range(bucket_bits), radius // 2)).cast("array<int>")
    # high buckets of a signed long: shift as unsigned, then flip up to radius/2 of the leading bits
    lead = F.shiftrightunsigned("fp", BITS - bucket_bits).cast("int")
    sent = fps.select("fp", F.explode(F.transform(reach, lambda m: lead.bitwiseXOR(m))).alias("bucket"))

    def link(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in groups:
            fp, bucket = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for k in np.unique(bucket).tolist():
                held.setdefault(k, []).append(fp[bucket == k])
        for k, parts in held.items():
            out = bucket_links(np.concatenate(parts), k, radius, bucket_bits)
            if len(out):
                out = out.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return sent.repartition(min(1 << bucket_bits, 1 << 16), "bucket").mapInArrow(in_task(link), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = RADIUS, bucket_bits: int | None = None) -> DataFrame:
    """Every row of docs as id_col, fp and component_id, the smallest id reachable over links of at most radius differing bits.

    Texts without words have fingerprint 0 and link like any other. Null ids count as the largest: their row has its
    component's smallest id, or null if there is none. Repeated rows share fingerprint and component. An empty table gives no
    rows; other columns are not read.
    """
    prints = materialize(simhash(docs, id_col, text_col, words))
    found = components(fingerprint_links(prints, radius, bucket_bits))
    least = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    # one row per fingerprint, so copies never meet in a join; then the smallest id of each component
    joined = least.join(found, least.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def sketches_of(texts: list[str], words: int, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's distinct word shingles: tables SimHashes of so many bits (0 for a text without words), the parity of how many fall into each of PARITY_BITS cells, and their number."""
    out, parity, size = np.zeros((len(texts), tables), np.uint64), np.zeros((len(texts), PARITY_BITS // 64), np.uint64), np.zeros(len(texts), np.int32)
    raw = [t.encode().translate(_LOWER) for t in texts]
    place = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    for lo, hi in by_bytes([len(t) for t in raw], 1 << 20):
        h, count = _shingle_sets(raw[lo:hi], words)
        size[lo:hi] = count
        some = np.flatnonzero(count)
        if not len(some):
            continue
        cell = np.bincount(np.repeat(np.arange(hi - lo), count) * PARITY_BITS + (h % np.uint64(PARITY_BITS)).astype(np.int64), minlength=(hi - lo) * PARITY_BITS)
        parity[lo:hi] = np.packbits((cell & 1).astype(np.uint8).reshape(hi - lo, PARITY_BITS), axis=1).view(np.uint64)
        mixed = np.stack([mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k in range(-(-tables * bits // 64))], 1).view(np.uint8)
        ones, begin = np.zeros((len(some), 8 * mixed.shape[1]), np.int32), 0
        for k, n in enumerate(count[some].tolist()):
            # of 255 shingles at a time, the bits are counted in bytes, eight of which are added as one number
            for at in range(begin, begin + n, 255):
                ones[k] += np.unpackbits(mixed[at : min(at + 255, begin + n)], axis=1).view(np.uint64).sum(0).view(np.uint8)
            begin += n
        major = (2 * ones > count[some][:, None])[:, : tables * bits].reshape(len(some), tables, bits)
        out[lo + some] = (major * place).sum(2, dtype=np.uint64)
    return out, parity, size


def most_unlike(total, similarity: float):
    """How many shingles two sets of `total` together may not share at that similarity; their parities differ in no more cells."""
    return total - 2 * np.ceil(similarity * total / (1 + similarity) - 1e-9)


def _shingles(raw: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text in turn, and how many each text has; fewer words than a shingle are one."""
    blob, start, end, first = words_of(raw)
    return shingle_hashes(word_hashes(blob, start, end), first, words)


def jaccard(left: list[str], right: list[str], words: int) -> np.ndarray:
    """The similarity of the shingle sets of each pair of texts; 1 for two texts without words."""
    out = np.ones(len(left))
    raw = [t.encode().translate(_LOWER) for pair in zip(left, right) for t in pair]
    for lo, hi in by_bytes([len(a) + len(b) for a, b in zip(raw[::2], raw[1::2])], 1 << 20):
        h, n = _shingle_sets(raw[2 * lo : 2 * hi], words)
        cut = np.concatenate([[0], np.cumsum(n)])[::2].tolist()
        for k in range(hi - lo):
            own = np.sort(h[cut[k] : cut[k + 1]])
            if len(own):
                both = np.count_nonzero(own[1:] == own[:-1])
                out[lo + k] = both / (len(own) - both)
    return out


def _shingle_sets(raw: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in turn, sorted, and how many each text has."""
    h, count = _shingles(raw, words)
    begin, new = np.cumsum(count) - count, np.ones(len(h), bool)
    for a, n in zip(begin.tolist(), count.tolist()):
        h[a : a + n].sort()
    new[1:] = h[1:] != h[:-1]
    new[begin[count > 0]] = True
    return h[new], np.bincount(np.repeat(np.arange(len(raw)), count)[new], minlength=len(raw))


def shingle_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How often shingles of some of the texts (node, text) fall into each of COUNT_CELLS cells; it only ranks shingles, so a sample will do."""
    slots = 64
    kind = "slot int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(COUNT_CELLS, np.int32)
        for b in batches:
            raw = [t.encode().translate(_LOWER) for t in texts_of(b, "text")]
            for lo, hi in by_bytes([len(t) for t in raw], 1 << 20):
                h = _shingle_sets(raw[lo:hi], words)[0]
                np.add.at(cells, (h % np.uint64(COUNT_CELLS)).astype(np.int64), 1)
        if cells.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots, dtype=np.int32)), pa.array([c.tobytes() for c in np.split(cells, slots)], pa.binary())], ["slot", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[k] = held.get(k, 0) + np.frombuffer(c, np.int32)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), pa.array([c.tobytes() for c in held.values()], pa.binary())], ["slot", "counts"])

    out = np.zeros((slots, COUNT_CELLS // slots), np.int32)
    for r in texts.where("pmod(node, 4) = 0").mapInArrow(in_task(count), kind).repartition(8, "slot").mapInArrow(in_task(add), kind).collect():
        out[r.slot] = np.frombuffer(r.counts, np.int32)
    return out.ravel()


def least_shared(size):
    """How many leading shingles similar texts share, of the size of the smaller one."""
    return 1 + size // MORE


def _prefixes(words: int, similarity: float, common: np.ndarray, buckets: int):
    """The rarest shingles of each text, so many that two texts of that similarity share `least_shared` of them, a row for each bucket of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, comp = b.column(0).to_numpy(), b.column(1).to_numpy()
            raw = [t.encode().translate(_LOWER) for t in texts_of(b, "text")]
            for lo, hi in by_bytes([len(t) for t in raw], 1 << 20):
                h, n = _shingle_sets(raw[lo:hi], words)
                # texts without words share one shingle of their own
                none = np.flatnonzero(n == 0)
                owner = np.concatenate([np.repeat(np.arange(hi - lo), n), none])
                h, n = np.concatenate([h, np.zeros(len(none), np.uint64)]), np.maximum(n, 1)
                if len(none):
                    order = np.argsort(owner, kind="stable")
                    h, owner = h[order], owner[order]
                rare, begin = common[(h % np.uint64(COUNT_CELLS)).astype(np.int64)], np.cumsum(n) - n
                # a text's shingles come sorted, so that with a stable sort by rarity all texts have them in one order
                for a, m in zip(begin.tolist(), n.tolist()):
                    h[a : a + m] = h[a : a + m][np.argsort(rare[a : a + m], kind="stable")]
                pos = np.arange(len(h)) - begin[owner]
                keep = pos < (n - np.ceil(similarity * n - 1e-9) + least_shared(n))[owner]
                h, owner, pos = h[keep], owner[keep], pos[keep]
                bucket = (h >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = []
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    own = order[cut[k] : cut[k + 1]]
                    at = owner[own]
                    rows.append((k, *(x.tobytes() for x in (h[own], node[lo + at], comp[lo + at], n[at].astype(np.int32), pos[own].astype(np.int32)))))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(6)], ["bucket", "h", "node", "comp", "size", "pos"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leading shingles that texts of different components share, with those texts."""
    parts: list[list[np.ndarray]] = [[] for _ in range(5)]
    for b in batches:
        for k, kind in enumerate((np.uint64, np.int64, np.int64, np.int32, np.int32)):
            parts[k] += (np.frombuffer(x, kind) for x in b.column(k + 1).to_pylist())
    if not parts[0]:
        return
    h, node, comp, size, pos = map(np.concatenate, parts)
    parts.clear()
    order = np.argsort(h, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
    count = np.diff(np.append(begin, len(order)))
    apart = np.repeat(np.minimum.reduceat(comp[order], begin) != np.maximum.reduceat(comp[order], begin), count)
    keep, among = order[apart], np.repeat(count, count)[apart]
    for lo in range(0, len(keep), 1 << 16):
        some = keep[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[some].view(np.int64), node[some], comp[some], pos[some], among[lo : lo + (1 << 16)])], ["h", "node", "comp", "pos", "among"])


def _meeting(similarity: float):
    """Pairs a, b of texts of different components that meet at a shingle and may reach the similarity by their sizes, its place in both and their parities; how often, and how often they have to in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in range(8)]
        for b in batches:
            for k in range(7):
                parts[k].append(b.column(k).to_numpy(zero_copy_only=False))
            parts[7].append(np.asarray(b.column(7).flatten().to_numpy(), np.int64).reshape(-1, PARITY_BITS // 64))
        if not parts[0]:
            return
        h, pair, block, node, comp, pos, size, parity = map(np.concatenate, parts)
        parts.clear()
        order = np.lexsort((node, size, pair, h))
        h, pair, block, node, comp, pos, size, parity = (x[order] for x in (h, pair, block, node, comp, pos, size, parity))
        parity, cross = parity.view(np.uint64), (pair >> 32) != (pair & 0xFFFFFFFF)
        held, total = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            pairs, times = np.unique(np.concatenate(held), axis=0, return_counts=True)
            for lo in range(0, len(pairs), 1 << 16):
                some = pairs[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1]), pa.array(some[:, 2]), pa.array(times[lo : lo + (1 << 16)])], ["a", "b", "least", "times"])

        # each text meets the next one of its shingle, then the one after that, as long as their sizes allow
        at, step = np.arange(len(h)), 0
        while len(at):
            step += 1
            at = at[: np.searchsorted(at, len(h) - step)]
            other = at + step
            fit = (h[other] == h[at]) & (pair[other] == pair[at]) & (similarity * size[other] <= size[at] + 1e-9)
            at, other = at[fit], other[fit]
            # of the leading shingles that a pair has to share, fewer than these come before this one
            least = least_shared(size[at])
            most = np.minimum(size[at] - pos[at], size[other] - pos[other]) + least - 1
            good = (comp[at] != comp[other]) & (most * (1 + similarity) >= similarity * (size[at].astype(np.int64) + size[other]) - 1e-9) & (~cross[at] | (block[at] != block[other]))
            x, y = at[good], other[good]
            near = np.bitwise_count(parity[x] ^ parity[y]).sum(1, dtype=np.int64) <= most_unlike(size[x].astype(np.int64) + size[y], similarity)
            x, y, least = node[x[near]], node[y[near]], least[good][near].astype(np.int64)
            if len(x):
                held.append(np.stack([np.minimum(x, y), np.maximum(x, y), least], 1))
                total += len(x)
            if total >= CHUNK:
                yield from out()
                held.clear()
                total = 0
        if held:
            yield from out()

    return run


def sharing_pairs(texts: DataFrame, marks: DataFrame, found: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs a, b of texts (node, text) in different components of found (node, component): all that can have that similarity, none left out.

    With shingles in one order, two sets of similarity s share k among the first n - ceil(s * n) + k of each (n shingles); the
    order is rare first, so few other pairs do, and k is more than one for all but short texts (least_shared), so fewer still by chance. Texts that
    share one meet in a task, in pairs of blocks if they are many, only pairs that their sizes and parities (marks: node, size, parity) allow leave
    it, and of these only pairs that meet k times are compared.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    named = texts.select("node", "text").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("comp"), "text")
    entries = named.mapInArrow(in_task(_prefixes(words, similarity, shingle_counts(texts, words), buckets)), "bucket int, h binary, node binary, comp binary, size binary, pos binary")
    shared = entries.repartition(buckets, "bucket").mapInArrow(in_task(_shared), "h long, node long, comp long, pos int, among long")
    blocks = F.ceil(F.col("among") / BLOCK)
    block = F.pmod(F.xxhash64("node"), blocks)
    met = shared.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = met.withColumn("pair", F.shiftleft(F.least("block", "with"), 32).bitwiseOR(F.greatest("block", "with"))).join(marks, "node")
    met = met.select("h", "pair", "block", "node", "comp", "pos", "size", "parity").repartition("h", "pair")
    found = met.mapInArrow(in_task(_meeting(similarity)), "a long, b long, least long, times long")
    return found.groupBy("a", "b", "least").agg(F.sum("times").alias("times")).where("times >= least").select("a", "b")


def same_text(text_col: str) -> Column:
    """Two hashes that stand for a text; null counts as empty."""
    text = F.coalesce(text_col, F.lit(""))
    return F.struct(F.xxhash64(F.lit(1), text).alias("x"), F.xxhash64(F.lit(2), text).alias("y"))


def _similar_texts(docs: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8, tables: int | None = None, bits: int | None = None, radius: int = RADIUS, bucket_bits: int | None = None, forests: int = FORESTS) -> tuple[DataFrame, DataFrame]:
    """Every row of docs as id and same (two hashes that stand for the text); and for each distinct text its smallest id (least: none, id), nulls last, and root, the component."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), same_text(text_col).alias("same"))
    # one row of each distinct text; its number is given once, as the table is written
    texts = rows.groupBy("same").agg(F.any_value("text").alias("text"), F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"))
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()))
    many = texts.count()
    tables, bits = (given or own for given, own in zip((tables, bits), shape_for(many, radius)))
    bucket_bits = bucket_bits or bits_for(many, radius, TABLE_ROWS)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, parity, size = sketches_of(texts_of(b, "text"), words, tables, bits)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (prints, parity)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array(size)], ["node", "sketch", "parity", "size"])

    sketches = materialize(texts.select("node", "text").mapInArrow(in_task(sketch), "node long, sketch array<long>, parity array<long>, size int"))
    marks = sketches.select("node", "size", "parity")
    places = sketches.select("node", F.posexplode("sketch").alias("table", "fp")).groupBy("table", "fp").agg(F.min("node").alias("node"))
    places = materialize(places)
    reach = [m for m in _masks(range(bucket_bits), radius // 2)]
    lead = F.shiftrightunsigned("fp", bits - bucket_bits).cast("int")
    sent = places.select(F.col("table").cast("int").alias("table"), "fp", F.explode(F.array([lead.bitwiseXOR(F.lit(m)) for m in reach])).alias("bucket"))
    sent = sent.select("fp", F.shiftleft("table", bucket_bits).bitwiseOR(F.col("bucket")).alias("at"))

    def meet(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in groups:
            fp, at = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for k in np.unique(at).tolist():
                held.setdefault(k, []).append(fp[at == k])
        for k in [*held]:
            fps = np.unique(np.concatenate(held.pop(k)))
            at = bucket_pairs(fps, k & (1 << bucket_bits) - 1, radius, bucket_bits, bits)
            # the nearest pairs that connect a group, in the same order in every bucket, so large groups stay linear
            at = at[np.lexsort((mix(fps[at[:, 0]] + mix(fps[at[:, 1]])), np.bitwise_count(fps[at[:, 0]] ^ fps[at[:, 1]])))]
            keep = np.zeros(len(at), bool)
            for _ in range(forests):
                rest = np.flatnonzero(~keep)
                keep[rest[spanning_forest(at[rest, 0], at[rest, 1], len(fps))]] = True
            pairs = fps[at[keep]].view(np.int64)
            for lo in range(0, len(pairs), 1 << 16):
                some = pairs[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k >> bucket_bits, np.int32)), pa.array(some[:, 0]), pa.array(some[:, 1])], ["table", "p", "q"])

    near = sent.repartition(min(tables << bucket_bits, 1 << 16), "at").mapInArrow(in_task(meet), "table int, p long, q long").distinct()
    at = lambda fp, node: places.select(F.col("table").cast("int").alias("table"), F.col("fp").alias(fp), F.col("node").alias(node))
    across = near.join(at("p", "a"), ["table", "p"]).join(at("q", "b"), ["table", "q"]).select("a", "b")
    within = sketches.select("node", F.posexplode("sketch").alias("table", "fp")).join(places.withColumnRenamed("node", "b"), ["table", "fp"]).select(F.col("node").alias("a"), "b")
    pairs = across.unionByName(within).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own, theirs = (marks.select(F.col("node").alias(n), F.col("parity").alias(f"{n}_parity"), F.col("size").alias(f"{n}_size")) for n in ("a", "b"))
    unlike = F.aggregate(F.zip_with("a_parity", "b_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda z, n: z + n)
    total = F.col("a_size") + F.col("b_size")
    allowed = total - 2 * F.ceil(F.lit(similarity) * total / (1 + similarity) - 1e-9)
    # sets of that similarity are about as large, so most pairs by chance go here, whole texts are compared of the others
    alike = F.least("a_size", "b_size") >= F.lit(similarity) * F.greatest("a_size", "b_size") - 1e-9
    pairs = pairs.join(own, "a").join(theirs, "b").where(alike & (unlike <= allowed)).select("a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("left", "right"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(jaccard(left, right, words) >= similarity - 1e-12))

    def verified(pairs: DataFrame) -> DataFrame:
        text = lambda n, t: texts.select(F.col("node").alias(n), F.col("text").alias(t))
        full = pairs.join(text("a", "left"), "a").join(text("b", "right"), "b")
        return full.select("a", "b", "left", "right").mapInArrow(in_task(verify), "a long, b long")

    found = materialize(components(verified(pairs)))
    rest = materialize(verified(sharing_pairs(texts, marks, found, words, similarity)))
    if rest.limit(1).count():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))
    named = texts.select("node", "same", "least").join(found, "node", "left")
    return rows.select("id", "same"), named.select("same", "least", F.coalesce("component", "node").alias("root"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, tables: int | None = None, bits: int | None = None, radius: int = RADIUS, bucket_bits: int | None = None, forests: int = FORESTS) -> DataFrame:
    """Every row of docs as id_col and component_id, the smallest id reachable over pairs of shingle similarity of at least `similarity`.

    One 64-bit fingerprint within 4 bits misses most pairs near 0.8, so several shorter ones are taken (longer ones of more texts); pairs that come within
    `radius` in any of them and can be alike by their sizes and parities are verified by their shingle sets. That links most of a group at little
    cost; an exact join on shingles then verifies all pairs across what is not linked yet. Equal texts are one from the
    start, so copies form no pairs. Texts without words are alike. Null ids count as the largest, null texts as empty; repeated
    rows share their component; an empty table gives no rows; other columns are not read.
    """
    ids, texts = _similar_texts(docs, id_col, text_col, words, similarity, tables, bits, radius, bucket_bits, forests)
    lowest = texts.groupBy("root").agg(F.min("least.id").alias("component_id"))
    named = texts.join(lowest, "root").select("same", "component_id")
    return ids.join(named, "same").select(F.col("id").alias(id_col), "component_id")


def first_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each group of similar_documents: id_col and same (see same_text) of its row with the smallest id (null last), then the smallest same.

    Groups whose smallest ids are equal stay apart; no two of these rows are equal.
    """
    texts = _similar_texts(docs, id_col, text_col)[1]
    first = texts.groupBy("root").agg(F.min(F.struct("least", "same")).alias("f"))
    return first.select(F.col("f.least.id").alias(id_col), "f.same")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's fingerprints and components of all documents."""
    out = near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash_near_dedup": op6_simhash_near_dedup}
ORACLES: dict[str, str] = {}
