"""Document fingerprints: one-permutation MinHash in SQL functions.

Each word shingle is hashed once; its leading bits name a bin, and a bin keeps its smallest hash. Empty bins borrow from a bin
that a hash of (bin, probe) picks until it finds one that isn't empty (optimal densification). Only the low-order byte of each
bin is kept, eight to a long, and likeness corrects for bytes that agree by chance. Nothing is exploded: a document's
fingerprint is one expression over its text. An empty bin that finds none in 200 probes (only where very few bins are filled) borrows
from the filled bin that its own number picks.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.llm.common import table

#: Bins (128, two masks of 64 bits), bits kept of each, words of a shingle, rows of an id range, and ranges at most (above 100 million rows they grow, and their sort spills).
BINS, KEPT, WORDS, RANGE_ROWS, MOST_RANGES = 128, 8, 5, 2000, 50_000
_LOW_BITS = 0x0101010101010101


def _let(value: str, name: str, body: str) -> str:
    """Evaluates value once and names it within body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sql(column: str, words: int) -> str:
    has = lambda j: f"(CASE WHEN {j} < 64 THEN shiftright(lo, {j}) & 1L ELSE shiftright(hi, {j} - 64) & 1L END) = 1L"
    rank = lambda j: f"(CASE WHEN {j} < 64 THEN bit_count(lo & shiftrightunsigned(-1L, 63 - {j})) ELSE bit_count(lo) + bit_count(hi & shiftrightunsigned(-1L, 127 - {j})) END)"
    probe = lambda a, b: f"try_element_at(filter(transform(sequence({a}, {b}), t -> cast(pmod(xxhash64(i, t), {BINS}) AS int)), j -> {has('j')}), 1)"
    borrowed = f"coalesce(element_at(m, {rank('p')}), element_at(m, 1 + cast(pmod(xxhash64(i), size(m)) AS int)))"
    borrowed = _let(f"coalesce({probe(1, 8)}, {probe(9, 200)})", "p", f"CASE WHEN p IS NULL THEN element_at(m, 1 + cast(pmod(xxhash64(i), size(m)) AS int)) ELSE {borrowed} END")
    value = f"(CASE WHEN size(m) = {BINS} THEN m[i] WHEN {has('i')} THEN element_at(m, {rank('i')}) ELSE {borrowed} END)"
    pack = f"transform(sequence(0, {BINS * KEPT // 64 - 1}), k -> aggregate(sequence(8 * k, 8 * k + 7), 0L, (z, i) -> shiftleft(z, 8) | ({value} & 255L)))"
    mask = lambda low: f"aggregate(m, 0L, (z, h) -> CASE WHEN (h {'<' if low else '>='} 0L) THEN z | shiftleft(1L, cast(shiftright(h, 57) + {64 if low else 0} AS int)) ELSE z END)"
    packed = _let(mask(True), "lo", _let(mask(False), "hi", pack))
    least = _let("sort_array(hashes)", "s", "filter(s, (h, x) -> x = 0 OR shiftright(h, 57) <> shiftright(s[x - 1], 57))")
    shingle = ", ".join(f"a[x + {k}]" for k in range(words))
    hashed = f"CASE WHEN size(a) >= {words} THEN transform(sequence(0, size(a) - {words}), x -> xxhash64({shingle})) WHEN size(a) = 0 THEN array(xxhash64(0L)) ELSE array(xxhash64(a)) END"
    split = rf"transform(filter(split(coalesce({column}, ''), r'[\x20\x09-\x0D]+'), w -> w <> ''), w -> xxhash64(w))"
    return _let(_let(split, "a", hashed), "hashes", _let(least, "m", packed))


def fingerprint(column: str, words: int = WORDS) -> Column:
    """The packed fingerprint (array of longs) of a text column. Null text counts as empty; fewer words than a shingle are one shingle; no words have a fingerprint of their own. Equal texts have equal fingerprints."""
    return F.expr(_sql(column, words))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity (0 to 1) of two fingerprints' shingle sets, corrected for bytes that agree by chance."""
    fold = lambda y, k: y.bitwiseOR(F.shiftrightunsigned(y, k))
    unlike = F.zip_with(a, b, lambda x, y: F.bit_count(fold(fold(fold(x.bitwiseXOR(y), 4), 2), 1).bitwiseAND(F.lit(_LOW_BITS))))
    agree = 1 - F.aggregate(unlike, F.lit(0), lambda z, n: z + n) / F.lit(float(BINS))
    chance = 2.0**-KEPT
    return F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_next(docs: DataFrame, id_col: str, carried: list[str], order: str) -> DataFrame:
    """docs with column `next`, a struct of the carried columns of the row that follows by id (after the last: the first).

    Null ids come last; rows that share an id are ordered by the column `order`. Rows are dealt by ranges of ids, and the first
    row of each range also stands at the end of the range before it, so no range needs another and nothing is sorted in one task. Rows
    without an id, and rows of one id, are in one range.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    rows = docs.withColumn("_key", key).withColumn("_guest", F.lit(0))
    keys = rows.select("_key")
    ranges = min(MOST_RANGES, keys.count() // RANGE_ROWS)
    # the first ids of as many ranges of like size; a row's range is found by binary search, so no row walks the cuts
    cuts = sorted({r[0] for r in keys.repartitionByRange(ranges, "_key").groupBy(F.spark_partition_id()).agg(F.min("_key")).select("min(_key)").collect()}) if ranges > 1 else []
    splits = sorted({float(c) for c in cuts[1:]})
    if splits:
        placed = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="_place", outputCol="_range").transform(rows.withColumn("_place", F.col("_key").cast("double"))).drop("_place")
        rows = placed.withColumn("_range", F.col("_range").cast("int"))
    else:
        rows = rows.withColumn("_range", F.lit(0))
    heads = sorted((r["_range"], r["head"]) for r in rows.groupBy("_range").agg(F.min("_key").alias("head")).collect())
    if not heads:
        return docs.withColumn("next", F.struct(*carried))
    before = docs.sparkSession.createDataFrame([(heads[k][1], heads[k - 1][0]) for k in range(len(heads))], "_key long, _before int")
    guests = rows.join(F.broadcast(before), "_key").withColumn("_range", F.col("_before")).withColumn("_guest", F.lit(1)).select(*rows.columns)
    follows = Window.partitionBy("_range").orderBy("_guest", "_key", order)
    out = rows.unionByName(guests).withColumn("next", F.lead(F.struct(*carried)).over(follows))
    return out.where("_guest = 0").drop("_key", "_guest", "_range")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id_col, n_chars, edited (text), packed, edited_packed, near_edited, near_next of every row of docs.

    The edited text has its last floor(n_chars / 4) characters replaced by as many first ones (or all) of the next row by id.
    Null text counts as empty; null ids come last; rows that share an id are ordered by text; a single row is its own next; an
    empty table gives no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    out = with_next(texts.withColumn("packed", fingerprint("text", words)), "id", ["text", "packed"], "text")
    out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    out = out.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next.text", F.lit(1), cut)))
    out = out.select(F.col("id").alias(id_col), "n_chars", "edited", "packed", fingerprint("edited", words).alias("edited_packed"), F.col("next.packed").alias("next_packed"))
    near = {"near_edited": likeness(F.col("packed"), F.col("edited_packed")), "near_next": likeness(F.col("packed"), F.col("next_packed"))}
    return out.withColumns(near).drop("next_packed")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's fingerprints and likenesses of all documents, their edited texts and their successors."""
    out = edited_fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("packed")).alias("fingerprint"), as_text(F.col("edited_packed")).alias("edited_fingerprint"), "near_edited", "near_next")


QUERIES = {"op7_fingerprints": op7_fingerprints}
ORACLES: dict[str, str] = {}
