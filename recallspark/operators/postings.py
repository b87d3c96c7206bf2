"""Lexical search that prunes: postings in blocks of few records with the largest weight of each, skipped by upper bounds.

Records are dealt into ranges of about RANGE records of similar length, and a block holds a term's postings within a range. No record of a
range scores more than the sum of its blocks' largest weights, so a query reads the ranges of highest bounds first and then only those whose
bound reaches its k-th best score so far. Nothing is grouped by term alone but counts, so a common term is many small blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.retrieval import K1, B, tokens
from recallspark.operators.scratch import written

#: Records of a range, ranges that a query reads first, rows of query terms that are broadcast, and parts of a term beyond that.
RANGE, FIRST, BROADCAST_ROWS, SALTS = 64, 4, 200_000, 64
#: Words whose postings a task makes.
WORDS = 1_000_000
#: What rounding to six digits may add to a score.
SLACK = 2e-6


@dataclass
class Postings:
    """posts: range, term, drawer_id, weight. blocks: range, term, most, n. terms: term, df. n: number of records."""

    posts: DataFrame
    blocks: DataFrame
    terms: DataFrame
    n: int


def build(drawers: DataFrame, size: int = RANGE) -> Postings:
    """Postings of all words of all records (drawer_id, text). Null texts have no words but count as records; an empty table has no postings.

    Records are dealt by range into as many tasks as words ask for before their words are counted, so no task counts more than WORDS or so.
    """
    words = drawers.select("drawer_id", tokens(F.col("text")).alias("words")).withColumn("size", F.size("words"))
    # lengths in steps of a fifth, so that weights of a range are alike
    words = words.withColumn("_step", F.floor(4 * F.log2(F.col("size") + 1)).cast("int"))
    steps = words.groupBy("_step").agg(F.count("*").alias("_n"), F.sum("size").alias("_words"))
    steps = written(steps, "steps")  # a row for each step, some hundred at most
    n, total = steps.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_words"), F.lit(0))).first()
    mean = total / n if n else 1.0
    parts = F.ceil(F.col("_n") / size).cast("long")
    placed = words.join(F.broadcast(steps.select("_step", parts.alias("_parts"))), "_step")
    placed = placed.withColumn("range", F.col("_step") * F.lit(1 << 40) + F.pmod(F.xxhash64("drawer_id"), F.col("_parts")))
    tasks = max(drawers.sparkSession.sparkContext.defaultParallelism, -(-total // WORDS))
    placed = placed.select("range", "drawer_id", "size", "words").repartition(tasks, "range")
    posts = placed.select("range", "drawer_id", "size", F.explode("words").alias("term")).groupBy("range", "drawer_id", "size", "term").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / (mean or 1.0)))
    posts = written(posts.select("range", "term", "drawer_id", weight.alias("weight")).sortWithinPartitions("term"), "posts")
    blocks = written(posts.select("range", "term", "weight").repartition(tasks, "range").groupBy("range", "term").agg(F.max("weight").alias("most"), F.count("*").alias("n")), "blocks")
    return Postings(posts, blocks, written(blocks.groupBy("term").agg(F.sum("n").alias("df")), "terms"), n)


def _by_term(blocks: DataFrame, asked: DataFrame, rows: int) -> DataFrame:
    """blocks with the queries that ask for their term; beyond a size that can be broadcast, each term is dealt by salts."""
    if rows <= BROADCAST_ROWS:
        return blocks.join(F.broadcast(asked), "term")
    salted = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return blocks.withColumn("_salt", F.pmod(F.xxhash64("range"), F.lit(SALTS)).cast("int")).join(salted, ["term", "_salt"]).drop("_salt")


def search(index: Postings, queries: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """query_id, drawer_id, score and rank of the k best records of each query (query_id, query) by BM25, equal to scoring every record; besides query_id, read and held: postings read, and all postings of the query's words."""
    idf = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")).distinct()
    asked = written(asked.join(index.terms, "term").select("query_id", "term", idf.alias("idf")), "asked")
    rows = asked.count()
    bounds = _by_term(index.blocks, asked, rows).groupBy("query_id", "range").agg(F.sum(F.col("most") * F.col("idf")).alias("bound"), F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    bounds = written(bounds.withColumn("_place", place), "bounds")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "drawer_id")

    def best(some: DataFrame) -> DataFrame:
        # the words of the ranges to read, then their postings: keys are a range and a term, of RANGE records at most or so
        wanted = some.select("query_id", "range").join(asked, "query_id")
        found = index.posts.join(wanted, ["range", "term"]).groupBy("query_id", "drawer_id").agg(F.round(F.sum(F.col("weight") * F.col("idf")), 6).alias("score"))
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("rank")

    leading = bounds.where(F.col("_place") <= first)
    top = written(best(leading), "leading")
    least = top.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
    rest = bounds.where(F.col("_place") > first).join(least, "query_id", "left").where(F.col("_n").isNull() | (F.col("_n") < k) | (F.col("bound") + SLACK >= F.col("_least")))
    rest = written(rest.select("query_id", "range", "n"), "rest")
    out = top.unionByName(best(rest)).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    read = leading.select("query_id", "n").unionByName(rest.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("read"))
    return out, bounds.groupBy("query_id").agg(F.sum("n").alias("held")).join(read, "query_id")
