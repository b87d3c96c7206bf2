"""Phrase collocations by contiguous pattern growth.

Words are counted, then pairs of frequent words; a pair that is frequent is a prefix. Longer phrases of frequent pairs are counted by hash:
those that share a counter are added up, so a phrase whose counter is low cannot be frequent. Each place where a prefix occurs and may go on
(that counter is high) points to what follows, three words at most, and the places of a prefix go to one task, which grows the prefix to
the right, depth first: the places that go on with the same word are the projection of the longer prefix. Equal continuations are counted
before they are shuffled, so what is sent on are occurrences of frequent phrases, at most one row for each, and few others. The places
of very frequent prefixes are dealt by whole continuations and counted as such. Words are held as 64-bit hashes, which are proven distinct
over all words of the corpus (else another seed is taken); which words and pairs are frequent, and which longer phrases may be, goes to the
tasks as bit sets of bounded size, whose errors cost work but no count.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.llm.common import LONG_WORD, in_task, materialize, mix, table, word_hashes

#: Words of a phrase at most, occurrences of a candidate at least, phrases returned for each language, and the share (in percent) of its occurrences within a longer one that drops a phrase.
LONGEST, LEAST, BEST, COVERED = 5, 100, 2000, 100
#: Places above which a prefix is dealt by whole continuations; bytes of text looked at at once; rows of a group of prefixes; bits of a set, and bits for each member up to that.
HOT, CHUNK, GROUP, MOST_BITS, BITS_EACH = 1 << 17, 12 << 20, 1 << 10, 1 << 29, 64
#: Occurrences of frequent pairs for each counter of longer phrases, up to MOST_BITS counters, and ranges (a power of two) that the counters are dealt in.
SHARED, RANGES = 4, 1024

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_BREAK = re.compile(rb"[.,;:!?\x0a-\x0d]")
#: What each byte is: 0 part of a word, 1 blank, 2 end of a piece.
_KIND = np.zeros(256, np.int8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(_BREAKS)] = 2
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_in(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Joined texts, start and end of each word there, and the piece that it is in."""
    blob = b"\n".join(texts)
    kind = _KIND[np.frombuffer(blob, np.uint8)]
    solid = np.zeros(len(blob) + 2, np.int8)
    solid[1:-1] = kind == 0
    step = np.diff(solid)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return blob, start, end, np.cumsum(kind == 2, dtype=np.int32)[start]


def same_words(blob: bytes, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> bool:
    """Whether each word equals, byte by byte, the word whose number `like` gives for it."""
    size = end - start
    if (size != size[like]).any():
        return False
    lanes = np.ndarray((len(blob) + 1,), "<u8", blob + bytes(8), 0, (1,))
    for k in range(0, min(int(size.max(initial=0)), LONG_WORD), 8):
        rows = np.flatnonzero(size > k)
        shift = np.uint64(64) - np.uint64(8) * np.minimum(size[rows] - k, 8).astype(np.uint64)
        if ((lanes[start[rows] + k] ^ lanes[start[like[rows]] + k]) << shift).any():
            return False
    long = np.flatnonzero(size > LONG_WORD).tolist()
    return all(blob[start[k] : end[k]] == blob[start[like[k]] : end[like[k]]] for k in long)


class BitSet:
    """A set of 64-bit hashes of at most MOST_BITS bits; it may hold hashes that were never added, but none that was is missing."""

    def __init__(self, size: int):
        bits = 1 << max(10, (size * BITS_EACH - 1).bit_length())
        self.mask = np.uint64(min(bits, MOST_BITS) - 1)
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at = hashes.astype(np.uint64) & self.mask
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.uint64) & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def gathered(hashes: DataFrame, n: int):
    """The bit set of a column of 64-bit hashes, as a broadcast. Each task sends its members' positions in it, once each; the driver holds the bits alone."""
    out = BitSet(n)
    spots = hashes.select(F.col(hashes.columns[0]).bitwiseAND(F.lit(int(out.mask))).alias("at"))
    # positions in words of 64 bits, so that the driver gets at most as many numbers as the set has words
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
    view = out.bits.view("<u8")
    for b in words.toArrow().to_batches():
        view[np.asarray(b.column(0), np.int64)] |= np.asarray(b.column(1)).astype(np.int64).view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.astype(np.uint64)) * _PRIME + b.astype(np.uint64))


def firsts(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each code from 0 to n - 1 occurs first."""
    out = np.zeros(n, np.int64)
    out[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return out


def counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns and how often each occurs. Rows meet by a hash, are compared, and are sorted where two share one."""
    hashed = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        hashed = mix(hashed * _PRIME + c.astype(np.uint64))
    codes, found = pd.factorize(hashed)
    at = firsts(codes, len(found))
    if all((c == c[at][codes]).all() for c in columns):
        return [c[at] for c in columns], np.bincount(codes, minlength=len(found))
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    new = np.flatnonzero(np.concatenate([[True], np.any([r[1:] != r[:-1] for r in rows], 0)]))
    return [r[new] for r in rows], np.diff(np.append(new, len(order)))


def _texts(batches, chunk: int):
    """Lists of texts of one language each, A-Z in lower case, of about chunk bytes; longer texts are cut where a piece ends."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            whole, at = (text or "").encode().lower(), 0
            while at < len(whole):
                cut = _BREAK.search(whole, at + chunk)
                end = cut.start() if cut else len(whole)
                held.setdefault(lang, []).append(whole[at:end])
                size[lang] = size.get(lang, 0) + end - at
                at = end
                if size[lang] >= chunk:
                    yield lang, held.pop(lang)
                    size[lang] = 0
    yield from held.items()


def _sliced(lang: str, columns: list[pa.Array], names: list[str]):
    """Record batches of some columns, a slice at a time, with the language before them."""
    for k in range(0, len(columns[0]), 65536):
        part = [c.slice(k, 65536) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0]), pa.string()), *part], ["lang", *names])


def word_counts(docs: DataFrame, seed: int, chunk: int = CHUNK) -> DataFrame:
    """lang, word, h (a hash of the word; null where two words of a part of the corpus share it) and f of every word."""

    def run(batches):
        for lang, texts in _texts(batches, chunk):
            blob, start, end, _ = words_in(texts)
            codes, found = pd.factorize(word_hashes(blob, start, end, seed))
            at = firsts(codes, len(found))
            words = pa.array([blob[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist())], pa.string())
            n = pa.array(np.bincount(codes, minlength=len(found)))
            alike = same_words(blob, start, end, at[codes]) and (found != 0).all()
            yield from _sliced(lang, [words, pa.array(found.view(np.int64)) if alike else pa.nulls(len(found), pa.int64()), n], ["word", "h", "f"])

    return docs.mapInArrow(in_task(run), "lang string, word string, h long, f long").groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


_X = [f"x{k}" for k in range(LONGEST)]


def _known(texts: list[bytes], seed: int, words) -> np.ndarray:
    """The hashes of all words in turn, 0 for those that are not frequent, with a 0 wherever a piece ends."""
    blob, start, end, piece = words_in(texts)
    h = word_hashes(blob, start, end, seed)
    h[~words.value.has(h)] = 0
    out = np.zeros(len(h) + int((piece[1:] != piece[:-1]).sum()) + 1, np.int64)
    out[np.arange(len(h)) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])[: len(h)]] = h.view(np.int64)
    return out


def pair_counts(docs: DataFrame, seed: int, words, chunk: int = CHUNK) -> DataFrame:
    """lang, x0, x1 and f of all pairs of frequent words."""

    def run(batches):
        for lang, texts in _texts(batches, chunk):
            a = _known(texts, seed, words)
            at = np.flatnonzero((a[:-1] != 0) & (a[1:] != 0))
            columns, n = counted([a[at], a[at + 1]])
            yield from _sliced(lang, [*map(pa.array, columns), pa.array(n)], [*_X[:2], "f"])

    return docs.mapInArrow(in_task(run), "lang string, x0 long, x1 long, f long").groupBy("lang", "x0", "x1").agg(F.sum("f").alias("f"))


def _longer(texts: list[bytes], seed: int, words, pairs) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The known words in turn, with room for a phrase behind them; for each length from three words on, the places of phrases of frequent pairs, and their hashes."""
    a = np.append(_known(texts, seed, words), np.zeros(LONGEST, np.int64))
    some = (a[:-1] != 0) & (a[1:] != 0)
    at = np.flatnonzero(some)
    hashes = pair_hash(a[at], a[at + 1])
    some[at] = goes = pairs.value.has(hashes)
    at, hashes, found = at[goes], hashes[goes], []
    for k in range(2, LONGEST):
        goes = some[at + k - 1]
        at = at[goes]
        hashes = mix(hashes[goes] * _PRIME + a[at + k].astype(np.uint64))
        found.append((at, hashes))
    return a, found


def may_reach(docs: DataFrame, seed: int, words, pairs, n: int, least: int, chunk: int = CHUNK):
    """The bit set of all phrases of three words or more, made of frequent pairs (which occur n times in all), whose counter reaches `least`, as a broadcast.
    Tasks send the counters that their texts touch, by ranges; a range is added up row by row, and the driver gets its bits alone."""
    out = BitSet(-(-n // (BITS_EACH * SHARED)))
    mask, span = out.mask, max(64, 8 * len(out.bits) // RANGES)

    def run(batches):
        for _, texts in _texts(batches, chunk):
            _, found = _longer(texts, seed, words, pairs)
            spots, times = np.unique(np.concatenate([h for _, h in found]) & mask, return_counts=True)
            ranges, first = np.unique(spots // np.uint64(span), return_index=True)
            edges = pa.array(np.append(first, len(spots)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(c.astype(np.int32))) for c in (spots % np.uint64(span), times)]
            sent = pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), *lists], ["range", "spots", "n"])
            for k in range(0, len(ranges), 64):
                yield sent.slice(k, 64)

    def added(batches):
        now, total = None, np.zeros(span, np.int64)

        def told():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["range", "bits"])

        for b in batches:
            for k, at in enumerate(b.column(0).to_pylist()):
                if at != now:
                    if now is not None:
                        yield told()
                    now = at
                    total[:] = 0
                # no counter is twice in a row
                total[b.column(1)[k].values.to_numpy()] += b.column(2)[k].values.to_numpy()
        if now is not None:
            yield told()

    sent = docs.mapInArrow(in_task(run), "range int, spots array<int>, n array<int>").repartition("range").sortWithinPartitions("range")
    for b in sent.mapInArrow(in_task(added), "range int, bits binary").toArrow().to_batches():
        for at, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            out.bits[at * span // 8 : (at + 1) * span // 8] = np.frombuffer(bits, np.uint8)
    return docs.sparkSession.sparkContext.broadcast(out)


def projected(docs: DataFrame, seed: int, words, pairs, hot, reach, chunk: int = CHUNK) -> DataFrame:
    """The places where a frequent pair may go on, equal ones counted (n): lang, x0, x1 (the pair), x2 to x4 (what follows; 0 where it cannot go on), and whether the pair is very frequent (hot)."""

    def run(batches):
        for lang, texts in _texts(batches, chunk):
            a, found = _longer(texts, seed, words, pairs)
            # how many words from each place on may be a frequent phrase
            size = np.full(len(a), 2, np.int8)
            for k, (at, hashes) in enumerate(found, 3):
                at = at[reach.value.has(hashes)]
                size[at[size[at] == k - 1]] = k
            at = np.flatnonzero(size > 2)
            columns = [np.where(size[at] > k, a[at + k], 0) for k in range(LONGEST)]
            columns, n = counted(columns)
            high = hot.value.has(pair_hash(columns[0], columns[1]))
            yield from _sliced(lang, [*map(pa.array, columns), pa.array(high), pa.array(n)], [*_X, "hot", "n"])

    kind = ", ".join(["lang string", *(f"{x} long" for x in _X), "hot boolean, n long"])
    return docs.mapInArrow(in_task(run), kind).groupBy("lang", *_X, "hot").agg(F.sum("n").alias("n"))


def _grown(least: int):
    """Grows each prefix of a group to the right, depth first, over its projected places."""

    def run(rows: pa.Table) -> pa.Table:
        langs, names = pd.factorize(rows["lang"].to_numpy(zero_copy_only=False))
        columns = [langs, *(rows[x].to_numpy() for x in _X)]
        order = np.lexsort(columns[::-1])
        columns, n = [c[order] for c in columns], rows["n"].to_numpy()[order]
        total = np.concatenate([[0], np.cumsum(n)])
        new = [np.zeros(len(n), bool)]
        for c in columns:
            new.append(new[-1] | np.concatenate([[True], c[1:] != c[:-1]]))
        # where the ranges of equal prefixes of each length begin
        edges = [np.append(np.flatnonzero(x), len(n)) for x in new[1:]]
        lang, found, times = [], [], []

        def grow(low: int, high: int, size: int) -> None:
            # rows are sorted, so each continuation of a prefix is a range of them
            at = edges[size + 1]
            for k in range(int(np.searchsorted(at, low)), int(np.searchsorted(at, high))):
                a, b = int(at[k]), int(at[k + 1])
                f = int(total[b] - total[a])
                if f >= least and columns[size + 1][a]:
                    lang.append(names[langs[order[a]]])
                    found.append([int(columns[j + 1][a]) for j in range(size + 1)])
                    times.append(f)
                    if size + 1 < LONGEST:
                        grow(a, b, size + 1)

        for a, b in zip(edges[2][:-1].tolist(), edges[2][1:].tolist()):
            if total[b] - total[a] >= least:
                grow(a, b, 2)
        return pa.table([pa.array(lang, pa.string()), pa.array(found, pa.list_(pa.int64())), pa.array(times, pa.int64())], ["lang", "h", "f"])

    return run


def frequent(docs: DataFrame, least: int = LEAST, hot: int = HOT, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """All words (lang, word, h, f) and all phrases of 1 to LONGEST words that occur at least `least` times (lang, h, f): h holds the hashes of the words."""
    for seed in range(100):
        words = materialize(word_counts(docs, seed, chunk))
        same = words.groupBy("h").agg(F.min("word").alias("a"), F.max("word").alias("b"))
        if not same.where("h is null or a <> b").limit(1).count():
            break
    known = words.where(F.col("f") >= least)
    told = gathered(known.select("h").distinct(), known.count())
    pairs = materialize(pair_counts(docs, seed, told, chunk).where(F.col("f") >= least))

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pair_hash(np.asarray(b.column(0)), np.asarray(b.column(1))).view(np.int64))], ["p"])

    sets = []
    for some in (pairs, pairs.where(F.col("f") > hot)):
        sets.append(gathered(some.select("x0", "x1").mapInArrow(hashed, "p long"), some.count()))
    sets.append(may_reach(docs, seed, told, sets[0], pairs.agg(F.sum("f")).first()[0] or 0, least, chunk))
    places = materialize(projected(docs, seed, told, *sets, chunk=chunk))
    cool = places.where("not hot")
    groups = max(1, -(-cool.count() // GROUP))
    cool = cool.withColumn("_group", F.pmod(F.xxhash64("lang", "x0", "x1"), F.lit(groups)))
    grown = cool.groupBy("_group").applyInArrow(_grown(least), "lang string, h array<long>, f long")
    out = known.select("lang", F.array("h").alias("h"), "f").unionByName(pairs.select("lang", F.array("x0", "x1").alias("h"), "f")).unionByName(grown)
    for size in range(3, LONGEST + 1):
        whole = places.where("hot").where(F.col(_X[size - 1]) != 0).groupBy("lang", *_X[:size]).agg(F.sum("n").alias("f"))
        out = out.unionByName(whole.where(F.col("f") >= least).select("lang", F.array(*_X[:size]).alias("h"), "f"))
    return words, materialize(out)


def scored(words: DataFrame, phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """lang, h, a, l, r, n and score of the phrases of two words or more that no longer one covers; all arithmetic is on exact integers."""
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    some = phrases.where(F.size("h") > 1).withColumnRenamed("f", "a")
    part = lambda start, size: F.slice("h", start, size)
    longer = some.where(F.size("h") > 2).select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("h") - 1), part(F.lit(2), F.size("h") - 1))).alias("h"))
    # a longer phrase's count is at most that of any of its parts, so those of one more word decide
    longer = longer.groupBy("lang", "h").agg(F.max("a").alias("over"))
    kept = some.join(longer, ["lang", "h"], "left").where(F.col("over").isNull() | (100 * F.col("over") < covered * F.col("a"))).drop("over")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.size("h") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.size("h") - F.col("k"))})
    side = lambda name, f: phrases.select("lang", F.col("h").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(total, "lang")
    cuts = cuts.withColumn("score", F.expr("CAST(1000 * CAST(a AS decimal(16,0)) * CAST(n AS decimal(18,0)) AS decimal(38,0)) DIV CAST(CAST(l AS decimal(19,0)) * CAST(r AS decimal(18,0)) AS decimal(38,0))"))
    best = cuts.groupBy("lang", "h", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "h", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, best: int = BEST, covered: int = COVERED, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """lang_col, rank (from 1), phrase, a, l, r, n, score: each language's `best` phrases of 2 to LONGEST words by score, then a, then phrase (by bytes).

    Null text is empty, a null language `und`; rows count as often as they occur; texts of any length are read whole, piece by piece; phrases
    never cross a piece; a language without phrases, and an empty table, give no rows; other columns are not read.
    """
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words, phrases = frequent(docs, least, hot, chunk)
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # ties of the last place stay until their texts are known
    some = materialize(scored(words, phrases, covered).withColumn("_rank", F.rank().over(first)).where(F.col("_rank") <= best).drop("_rank"))
    named = some.select("lang", "h", F.posexplode("h").alias("_at", "_h"))
    texts = words.where(F.col("f") >= least).select("h", "word").distinct().withColumnRenamed("h", "_h")
    named = named.join(texts, "_h").groupBy("lang", "h").agg(F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("_words"))
    out = some.join(named, ["lang", "h"]).withColumn("phrase", F.array_join(F.transform("_words", lambda x: x["word"]), " "))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= best)
    return out.select(F.col("lang").alias(lang_col), "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's phrases of every language of all documents."""
    out = collocations(table(spark, sf_dir, "documents"))
    return out.withColumn("rank", F.col("rank").cast("long"))


QUERIES = {"op11_phrases": op11_phrases}
ORACLES: dict[str, str] = {}
