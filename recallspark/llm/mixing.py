"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, in SQL functions.

Sources share a number of words by weight, none more than a multiple of its own. The words are a number of equal blocks, and
each block is a seat: sources get seats by highest quotients (target / (2 k - 1) for the k-th seat), then the shards of a source
get the source's seats the same way by their size. A shard is a bounded part of a source, its documents in seeded order, its
words cut into blocks; a quota of at least all blocks takes the shard whole, and of the rest every so many-th block is taken, from
a seeded place. One block is cut so that the shard's words come to its share. Highest quotients are found without listing all: a divisor
gives every party its seats but for a few, and only the quotients next to it are ranked, in ranges of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.llm.common import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in order (repeating), share of all words that the mix takes, and how often a document is taken at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of a block and of a shard, rows that one task ranks, and the size of the table of sources up to which it is broadcast.
BLOCK, SHARD, RANKED, BROADCAST_ROWS, BROADCAST_BYTES = 64, 1 << 16, 1 << 19, 100_000, 8 << 20
#: Keys that the rows of a source are dealt to where the table of sources is too large to broadcast.
SALTS = 64


def n_words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place (from 1) within their group in the given order, which must be total but for equal rows.

    Rows are dealt by ranges of group and order, so a group of any size spreads over tasks; a place is the place within the range
    after the rows of the group in earlier ranges, of which each range has one count for each group.
    """
    rows = materialize(rows)
    ranges = max(1, -(-rows.count() // RANKED))
    placed = rows.repartitionByRange(ranges, *(F.asc_nulls_last(c) for c in group), *order).withColumn("_range", F.spark_partition_id())
    placed = materialize(placed)
    counts = placed.groupBy("_range", *group).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").withColumnsRenamed({c: f"_{c}" for c in ["range", *group]} | {"_range": "__range"})
    same = F.col("_range") == F.col("__range")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order))
    out = placed.withColumn(name, place).join(counts, same).withColumn(name, F.col(name) + F.col("_before"))
    return out.drop("_range", "__range", "_before", *(f"_{c}" for c in group))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, int, int]:
    """sources (source, source_size) with their position (from 1, by code point, null last) and target; the words of all; how many sources.

    The targets are min(most * size, level * weight): the level is raised by Newton's steps until the targets add up to the share, each step
    resharing by weight what sources at their bound leave over.
    """
    placed = ranked(sources, [], [F.asc_nulls_last("source")], "position")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("position") - 1, F.lit(len(weights))).cast("int") + 1)
    placed = materialize(placed.withColumn("weight", weight))
    total, n = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    bound, level = most * F.col("source_size"), 0.0
    while total:
        free = bound > level * F.col("weight")
        held, weighing = placed.agg(F.sum(F.when(~free, bound)), F.sum(F.when(free, F.col("weight")))).first()
        if not weighing or (up := (min(share, most) * total - (held or 0)) / weighing) <= level:
            break
        level = up
    return placed.withColumn("target", F.least(bound.cast("double"), F.lit(level) * F.col("weight"))), total, n


def apportioned(parties: DataFrame, group: list[str], groups: int, key: list[str], weight: str, seats: Column, limit: Column | None = None) -> DataFrame:
    """parties with quota: the seats of their group (one value in each group) by highest quotients weight / (2 k - 1), ties to the smaller key.

    quota is at most `limit`. Parties without weight get none. groups: how many groups there are; a few numbers for each are
    broadcast up to BROADCAST_ROWS of them.
    """
    few = F.broadcast if groups <= BROADCAST_ROWS else lambda df: df
    every = parties.groupBy(*group).agg(F.sum(weight).cast("double").alias("_w"), F.max(seats).alias("_seats"), F.count("*").alias("_parties"))
    named = every.withColumnsRenamed({c: f"_{c}" for c in group})
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = parties.join(few(named), same).drop(*(f"_{c}" for c in group))
    first = F.when(F.col("_w") > 0, F.round(F.col(weight) * F.col("_seats") / F.col("_w"))).otherwise(0).cast("long")
    rows = materialize(rows.withColumn("_first", first))
    over = rows.groupBy(*group).agg((F.sum("_first") - F.max("_seats")).alias("_over")).withColumnsRenamed({c: f"_{c}" for c in group})
    near = rows.join(few(over.where("_over <> 0")), same).drop(*(f"_{c}" for c in group))
    # a party's seats change by its part of what is over, one for rounding, and no more
    reach = F.ceil(F.col(weight) / F.col("_w") * (F.abs("_over") + F.col("_parties"))).cast("long") + 1
    seat = F.when(F.col("_over") > 0, F.sequence(F.greatest(F.lit(1).cast("long"), F.col("_first") - reach + 1), F.greatest(F.lit(1).cast("long"), F.col("_first")))).otherwise(F.sequence(F.col("_first") + 1, F.col("_first") + reach))
    near = near.where((F.col(weight) > 0) & ((F.col("_over") < 0) | (F.col("_first") > 0))).select(*group, *key, "_over", F.explode(seat).alias("_seat"), F.col(weight).alias("_weight"))
    quotient = F.col("_weight") / (2 * F.col("_seat") - 1)
    near = near.withColumn("_by", F.when(F.col("_over") > 0, quotient).otherwise(-quotient)).drop("_weight")
    # seats that go: lowest quotients first, the larger key first; seats that come: highest first, the smaller key first
    side = F.when(F.col("_over") > 0, -F.col("_seat")).otherwise(F.col("_seat"))
    keys = [F.when(F.col("_over") > 0, -F.col(c)).otherwise(F.col(c)) for c in key]
    moved = ranked(near.withColumns({"_side": side, **{f"_k{n}": c for n, c in enumerate(keys)}}), group, [F.asc("_by"), *(F.asc(f"_k{n}") for n in range(len(key))), F.asc("_side")], "_place")
    change = moved.where(F.col("_place") <= F.abs("_over")).groupBy(*group, *key).agg(F.sum(-F.signum("_over")).cast("long").alias("_change")).withColumnsRenamed({c: f"_{c}" for c in group + key})
    same_key = same
    for c in key:
        same_key = same_key & (F.col(c) == F.col(f"_{c}"))
    quota = F.greatest(F.col("_first") + F.coalesce("_change", F.lit(0)), F.lit(0))
    out = rows.join(change, same_key, "left").withColumn("quota", F.least(quota, limit) if limit is not None else quota)
    return out.drop("_w", "_seats", "_parties", "_first", "_change", *(f"_{c}" for c in group + key))


def with_source(rows: DataFrame, sources: DataFrame, columns: list[str]) -> DataFrame:
    """rows (source, key) with columns of their source's row. A table of sources of proven small size is broadcast; a larger one meets rows dealt by salts, as one source may hold most rows."""
    n, size = sources.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("source"), F.lit(0)))).first()
    some = sources.select(F.col("source").alias("_source"), *columns)
    same = F.col("source").eqNullSafe(F.col("_source"))
    if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(some), same).drop("_source")
    some = some.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_deal", F.pmod("key", F.lit(SALTS)).cast("int"))
    return dealt.join(some, same & (F.col("_deal") == F.col("_salt"))).drop("_source", "_salt", "_deal")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = 13) -> DataFrame:
    """What a mix takes of each row of docs: id_col, source_col, key, copy, size, source_size, target, repeats, spans, taken.

    A document is taken whole `repeats` times and besides by `spans`, an array of structs (start, end) of its words; taken counts all
    those words. key and copy (from 0, of rows with the same id, source and text) name the row; `texts` cuts the texts. The targets are
    those of `targets`; a source's taken words differ from its target by rounding, at most by a few words a shard. Null text is
    empty; texts without words take no part (taken 0) but are returned; null ids and null sources are values of their own; rows
    that share an id are each a document; an empty table gives no rows; other columns are not read. The same rows give
    the same mix, whatever their order and partitions.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("key"), n_words(F.col(text_col)).alias("size"))
    rows = materialize(rows.groupBy("id", "source", "key", "size").agg(F.count("*").alias("copies")))
    sources, total, n = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, most)
    seats = round(min(share, most) * total / block)
    sources = apportioned(sources.withColumn("mix", F.lit(0)), ["mix"], 1, ["position"], "target", F.lit(seats).cast("long"))
    sources = materialize(sources.withColumn("shards", F.ceil(F.col("source_size") / shard).cast("long")))
    rows = with_source(rows, sources, ["position", "source_size", "target", "quota", "shards"])
    some = materialize(rows.where("size > 0").withColumn("shard", F.pmod("key", "shards")).withColumnRenamed("quota", "seats"))
    blocks = F.ceil(F.col("shard_size") / block).cast("long")
    shards = some.groupBy("position", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("shard_size"), *(F.max(c).alias(c) for c in ("source_size", "target", "seats")))
    shards = apportioned(shards.withColumn("blocks", blocks), ["position"], n, ["shard"], "shard_size", F.col("seats"), most * F.col("blocks"))
    # whole takes, how many blocks besides, and the seeded place from which they are counted
    shards = shards.withColumn("turn", F.pmod(F.xxhash64(F.lit(seed), "position", "shard"), "blocks"))
    chosen = lambda b: F.floor((F.pmod(b + F.col("turn"), F.col("blocks")) + 1) * F.col("some") / F.col("blocks")) > F.floor(F.pmod(b + F.col("turn"), F.col("blocks")) * F.col("some") / F.col("blocks"))
    words = F.col("some") * block - F.when(chosen(F.col("blocks") - 1), F.col("blocks") * block - F.col("shard_size")).otherwise(0)
    spare = F.round(F.col("target") / F.col("source_size") * F.col("shard_size")).cast("long") - F.col("repeats") * F.col("shard_size") - words
    for _ in range(2):  # a shard's last block is a part of one: what quotas lose by that is made up in whole blocks
        shards = shards.withColumns({"repeats": F.floor(F.col("quota") / F.col("blocks")), "some": F.pmod("quota", "blocks")}).withColumn("spare", spare)
        unit = F.least(F.lit(block), F.col("shard_size"))
        more = F.when(F.col("spare") < 0, F.ceil(F.col("spare") / unit)).otherwise(F.floor(F.col("spare") / unit)).cast("long")
        shards = shards.withColumn("quota", F.least(F.col("quota") + more, most * F.col("blocks")))
    spare = F.when(F.col("repeats") < most, F.col("spare")).otherwise(0)
    # counted from its place, the first block is never among those taken and the last one always is, if any are
    shards = shards.withColumns({"spare": spare, "opens": F.pmod(F.col("blocks") - F.col("turn"), "blocks"), "closes": F.pmod(2 * F.col("blocks") - 1 - F.col("turn"), "blocks")})
    shards = shards.select(F.col("position").alias("_position"), F.col("shard").alias("_shard"), *(F.col(c).alias(f"_{c}") for c in ("shard_size", "blocks", "repeats", "some", "turn", "spare", "opens", "closes")))
    order = Window.partitionBy("position", "shard").orderBy("key", "id", "size")
    upto = F.sum(F.col("size") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = some.withColumn("upto", upto).join(shards, (F.col("position") == F.col("_position")) & (F.col("shard") == F.col("_shard")))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    at = F.col("upto") - (F.col("copies") - F.col("copy")) * F.col("size")

    def span(b: Column) -> Column:
        turned = F.pmod(b + F.col("_turn"), F.col("_blocks"))
        taken = F.floor((turned + 1) * F.col("_some") / F.col("_blocks")) > F.floor(turned * F.col("_some") / F.col("_blocks"))
        first, last = b * block, F.least((b + 1) * block, F.col("_shard_size"))
        cut = F.when((b == F.col("_closes")) & (F.col("_spare") < 0), -F.col("_spare")).otherwise(0)
        end = F.when(taken, last - cut).when((b == F.col("_opens")) & (F.col("_spare") > 0), F.least(last, first + F.col("_spare"))).otherwise(first)
        return F.struct(F.greatest(first - F.col("at"), F.lit(0)).alias("start"), F.least(end - F.col("at"), F.col("size")).alias("end"))

    covers = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))
    placed = placed.withColumn("at", at).withColumn("spans", F.filter(F.transform(covers, span), lambda s: s["end"] > s["start"]))
    names = {"id": id_col, "source": source_col}
    columns = ["id", "source", "key", "copy", "size", "source_size", "target", "repeats", "spans"]
    whole = placed.withColumn("repeats", F.col("_repeats")).select(*columns)
    none = rows.where("size = 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    none = none.withColumns({"repeats": F.lit(0).cast("long"), "spans": F.array().cast(whole.schema["spans"].dataType)}).select(*columns)
    taken = F.col("repeats") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda z, s: z + s["end"] - s["start"])
    return whole.unionByName(none).withColumn("taken", taken).withColumnsRenamed(names)


def texts(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 13) -> DataFrame:
    """The mix's texts: id_col, source_col, copy, n (from 0) and text, a row for every whole take (the text as it is) and every span (its words, joined by one space)."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).alias("_text")).distinct()
    both = mix.where("taken > 0").join(own, F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).eqNullSafe(F.col("_source")) & (F.col("key") == F.col("_key")))
    words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    parts = F.concat(F.array_repeat(F.col("_text"), F.col("repeats").cast("int")), F.transform("spans", lambda s: F.array_join(F.slice(words, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), " ")))
    return both.select(id_col, source_col, "copy", F.posexplode(parts).alias("n", "text"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's mix of all documents, repeats and spans counted as words."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op13_source_mix": op13_source_mix}
ORACLES: dict[str, str] = {}
