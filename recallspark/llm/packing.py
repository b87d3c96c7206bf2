"""Best-fit packing of token sequences.

The histogram of piece lengths (at most `capacity` rows) goes to the driver. There a configuration linear program over it is
solved by multiplicative weights: a knapsack dynamic program prices fillings under the current weights, each round takes a share
of what the priced fillings allow, and lengths that lag behind gain weight. Covers and their mean are rounded to whole multiples, and what
rounding leaves is placed by best fit, also by histogram; the best of them, never worse than best fit alone, is taken, and the weights
bound how far from the fewest sequences it can be. Spark then ranks pieces of like length and
joins ranks with the fillings' places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.llm.common import Memo, in_task, materialize, table, texts_of, vocabulary

CAPACITY, END_ID = 4096, 1
#: Rounds of the multiplicative weights in a cover, covers at most, the learning rate, longest word that the memo keeps.
ROUNDS, COVERS, RATE, KEPT_CHARS = 24, 3, 0.5, 64
#: Ranks of pieces of like length that meet the fillings as one key.
SLICE = 64
#: Marks that part from the letters before them in every case.
MARKS = ".,;:!?|%*#$&)\"-+="


class Words(Memo):
    """Word (no ASCII blanks) -> packed ids. Blanks part words in the vocabulary's own rules, so words can be encoded one by one."""

    def __init__(self, path: str):
        import os

        super().__init__()

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        letters = [c for c in map(chr, range(256)) if c.isalpha() and c.islower()]
        self.spelt = {ord(c): self.model.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        self.merge = self.model.model.tokenize
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        letters = core.isalpha() and core.islower()
        if letters and core != word:
            return self[core] + self[word[len(core) :]]
        if letters and max(core) < "\u0100":  # one pre-token that the normaliser leaves as it is
            out = np.array([t.id for t in self.merge(word.translate(self.spelt))], "<u4").tobytes()
        else:
            out = np.array(self.model.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= KEPT_CHARS:
            self.keep(word, out, len(out))
        return out

    def ids(self, text: str) -> bytes:
        if not any(s[:2] in text for s in self.special):
            try:
                text.encode("latin-1")
                text = text.lower()  # the vocabulary is lower case; in this range letters change one by one
            except UnicodeEncodeError:
                pass
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    _words[path].room()
    return _words[path]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most capacity tokens: id_col, piece (from 0), start, length, ids (packed little-endian unsigned 32-bit).

    A document is its text's ids (null text: none) and end_id; only longer ones are cut. Null ids stay null, repeated rows give
    their pieces each, an empty table gives none, other columns are not read.
    """
    path, kind = vocabulary(tokenizer), dict(docs.dtypes)[id_col]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            memo, row, piece, ids = words(path), [], [], []
            for k, text in enumerate(texts_of(b, "text")):
                all_ids = memo.ids(text) + end
                for n, at in enumerate(range(0, len(all_ids), 4 * capacity)):
                    row.append(k)
                    piece.append(n)
                    ids.append(all_ids[at : at + 4 * capacity])
            piece = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "piece", "start", "length", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return out.mapInArrow(in_task(cut), f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def priced(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack: the best value within each capacity, and the length to take there (0: none fits)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(int(lengths[0]), capacity + 1):
        n = int(np.searchsorted(lengths, c, "right"))
        total = values[:n] + best[c - lengths[:n]]
        k = n - 1 - int(total[::-1].argmax())
        best[c], take[c] = total[k], lengths[k]
    return best, take


def covers(counts: np.ndarray, capacity: int) -> Iterator[tuple[dict[tuple[int, ...], float], float]]:
    """Solutions of the configuration linear program: fillings (lengths, descending) and how often to use each, in fractions; with each, a bound that no packing beats.

    Multiplicative weights, begun at each length's share of a sequence, price fillings by the knapsack program. Every round uses
    the priced fillings as far as what is left uncovered allows, then raises the weights of lengths that lag behind; after ROUNDS
    rounds a new cover begins with the weights found so far. What a cover leaves (poor fillings are never used) is left to rounding. Any
    weights bound every packing: the weight of all pieces over the most that one sequence can hold of it.
    """
    weight, every = np.ones(capacity + 1), np.flatnonzero(counts)
    while True:
        left, used, bound = counts.astype(float), {}, 0.0
        for t in range(ROUNDS):
            lengths = np.flatnonzero(left > 1e-9)
            if not len(lengths):
                break
            # less a little for each piece: fillings of few long pieces use short ones up more slowly
            values = np.maximum(lengths * weight[lengths] - 0.05, 0)
            best, take = priced(values, lengths, capacity)
            if best[capacity] > 0:
                bound = max(bound, float((values * counts[lengths]).sum() / best[capacity]))
            share, slack = (0.5 if t < ROUNDS // 2 else 1.0), (0 if t < ROUNDS // 3 else capacity * t // (ROUNDS * 16))
            for n in lengths[::-1].tolist():
                if left[n] <= 1e-9:
                    continue
                filling, room = [n], capacity - n
                while room > 0 and take[room] and left[take[room]] > 1e-9:
                    filling.append(int(take[room]))
                    room -= filling[-1]
                if room > slack:
                    continue
                kinds, times = np.unique(filling, return_counts=True)
                most = float((left[kinds] / times).min()) * share
                left[kinds] -= times * most
                key = tuple(sorted(filling, reverse=True))
                used[key] = used.get(key, 0.0) + most
            rest = left[lengths] / counts[lengths]
            weight[lengths] *= np.exp(RATE * (rest - rest.mean()))
        weight[every] /= weight[every].mean()
        yield used, bound


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A bound from lengths alone: long pieces each need a sequence, and what is too long for their rest needs more (the best over all divisions into long, middle and short)."""
    sizes = np.arange(capacity + 1)
    upto, words = np.cumsum(counts), np.cumsum(counts * sizes)
    half = capacity // 2
    a = np.arange(half + 1)  # pieces below a are short
    long, middle = upto[capacity] - upto[capacity - a], upto[capacity - a] - upto[half]
    held = words[capacity - a] - words[half]
    below = words[half] - np.where(a > 0, words[np.maximum(a - 1, 0)], 0)
    more = np.maximum(0, -(-(below - (middle * capacity - held)) // capacity))
    return int((long + middle + more).max())


def rounded(solution: dict[tuple[int, ...], float], counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole multiples of each filling, then by falling fractions one more of it while its pieces last; what is left is placed by best fit."""
    left, out = counts.copy(), {}
    for filling, x in solution.items():
        if x >= 1:
            out[filling] = int(x)
            np.subtract.at(left, list(filling), int(x))
    for filling, x in sorted(solution.items(), key=lambda kv: (int(kv[1]) - kv[1], kv[0])):
        if capacity - sum(filling) <= capacity // 64:
            kinds, times = np.unique(filling, return_counts=True)
            if (left[kinds] >= times).all():
                left[kinds] -= times
                out[filling] = out.get(filling, 0) + 1
    return [*out.items()] + best_fit(left, capacity)


def packed(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Fillings (lengths, descending, of sum at most capacity) and how often to use each, so that every length is placed as often as it occurs; and a number of sequences that no packing goes below.

    Each cover, the mean of those so far, and best fit alone are rounded, and the fewest sequences count; it ends when they meet the bound, or
    after COVERS covers.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for n, count in histogram.items():
        counts[n] = count
    if not counts.sum():
        return [], 0
    many = lambda fillings: sum(m for _, m in fillings)
    best, bound, mean = best_fit(counts, capacity), least_sequences(counts, capacity), {}
    for k, (solution, least) in enumerate(covers(counts, capacity), 1):
        bound = max(bound, int(np.ceil(least - 1e-6 * max(1.0, least) - 1e-9)))
        for filling, x in solution.items():
            mean[filling] = mean.get(filling, 0.0) + x
        for some in [solution, {f: x / k for f, x in mean.items()}][: min(k, 2)]:
            best = min(best, rounded(some, counts, capacity), key=many)
        if many(best) <= bound or k == COVERS:
            return best, bound


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """The fillings of `packed`."""
    return packed(histogram, capacity)[0]


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Places left[n] pieces of each length n, long ones first, each into the fullest sequence that has room; equal sequences are handled as one."""
    left = left.copy()
    open_bins: dict[int, list[list]] = {}
    rooms = np.zeros(capacity + 1, bool)
    for n in np.flatnonzero(left)[::-1].tolist():
        count = int(left[n])
        while count:
            fits = np.flatnonzero(rooms[n:])
            room = n + int(fits[0]) if len(fits) else capacity
            each, bins = (1, open_bins[room]) if len(fits) else (capacity // n, [[(), -(-count // (capacity // n))]])
            filling, many = bins[-1]
            if not len(fits) and many * each > count:
                many, each = (count // each, each) if count >= each else (1, count)
            many = min(many, count // each)
            if len(fits):
                bins[-1][1] -= many
                if not bins[-1][1]:
                    bins.pop()
                rooms[room] = bool(bins)
            count -= many * each
            now = room - n * each
            open_bins.setdefault(now, []).append([(*filling, *[n] * each), many])
            rooms[now] = now > 0
    return [(tuple(f), m) for bins in open_bins.values() for f, m in bins if f]


def places_of(fillings: list[tuple[tuple[int, ...], int]]) -> pa.Table:
    """For each piece of each filling: its length, the ranks among pieces of that length that it takes (from, to), what added to a rank names the sequence, and its offset there."""
    size = np.array([len(f) for f, _ in fillings], np.int64)
    length = np.fromiter((n for f, _ in fillings for n in f), np.int64, int(size.sum()))
    times = np.array([m for _, m in fillings], np.int64)
    first, each = np.repeat(np.cumsum(times) - times, size), np.repeat(times, size)
    ends = np.cumsum(length)
    offset = ends - length - np.repeat((ends - length)[np.cumsum(size) - size], size) if len(length) else length
    order = np.argsort(length, kind="stable")
    total = np.cumsum(each[order])
    heads = np.flatnonzero(np.diff(length[order], prepend=-1) != 0)
    begin = np.empty(len(length), np.int64)
    begin[order] = total - each[order] - np.repeat((total - each[order])[heads], np.diff(np.append(heads, len(order))))
    return pa.table([length, begin, begin + each, first - begin, offset], ["_length", "_from", "_to", "_shift", "_offset"])


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a column length from 1 to capacity) with sequence_id and offset (columns of these names are replaced); keys order pieces of like length.

    No piece is cut or dropped; offsets in a sequence have no gaps; repeated keys get places of their own; no pieces, no rows.
    The histogram that the driver sees has at most capacity rows and its fillings are at most COVERS * ROUNDS * capacity
    of at most capacity pieces, whatever the input; pieces meet the fillings in a join on length and slices of ranks.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    buckets = min(4096, max(16, sum(histogram.values()) // 20_000))
    rows = pieces.select(F.struct(*own).alias("_piece"), F.col("length").alias("_length"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), *(F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)))
    before = rows.groupBy("_length", "_bucket").count().withColumn("_before", F.sum("count").over(Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_length", "_bucket").orderBy(*(f"_key{n}" for n in range(len(keys))))) - 1)
    ranked = ranked.join(before.select("_length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before")), ["_length", "_bucket"])
    ranked = ranked.select("_piece", "_length", (F.col("_rank") + F.col("_before")).alias("_rank")).withColumn("_slice", F.floor(F.col("_rank") / SLICE))
    place = spark.createDataFrame(places_of(configurations(histogram, capacity)))
    slices = F.sequence(F.floor(F.col("_from") / SLICE), F.floor((F.col("_to") - 1) / SLICE))
    out = ranked.join(place.withColumn("_slice", F.explode(slices)), ["_length", "_slice"]).where("_rank >= _from and _rank < _to")
    return out.select(*(F.col(f"_piece.{c}").alias(c) for c in own), (F.col("_rank") + F.col("_shift")).alias("sequence_id"), F.col("_offset").alias("offset"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's pieces of all documents and their places."""
    pieces = token_pieces(table(spark, sf_dir, "documents"))
    pieces = materialize(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(pieces, ["doc_id", "piece", "ids_crc32"])


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLES: dict[str, str] = {}
