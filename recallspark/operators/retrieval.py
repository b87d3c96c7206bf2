"""Hybrid retrieval: vector and BM25 candidates, reciprocal-rank fusion, policy rank, themes, closets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.scratch import written
from recallspark.operators.visibility import Caller, tier

#: Published constants of BM25 and of reciprocal-rank fusion, and the floor of the theme channel.
K1, B, RRF_K, THEME_FLOOR = 1.5, 0.75, 60, 0.55
#: Bytes of vectors in a block of drawers or queries, and drawers that a block has at least.
BLOCK_BYTES, LEAST_BLOCK = 16 << 20, 1024
#: Rows of query terms up to which they are broadcast rather than postings dealt by term.
BROADCAST_ROWS = 200_000
# fixed values: boosts of the first five closets, and the distance they need
CLOSET_BOOSTS, CLOSET_DISTANCE = [0.40, 0.25, 0.15, 0.08, 0.04], 1.5

# fixed values: runs of ASCII letters, digits, underscores and hyphens are tokens, every other character but blanks is one
_TOKEN = "[a-z0-9_-]+|[^\\s\\p{Z}a-z0-9_-]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _scores(per: list[str], k: int):
    """Cosine similarities of a block of drawers and all queries as one matrix product, and the k best of each query and group."""

    def run(drawers: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        groups = {c: drawers[c].to_numpy() for c in per}
        if not len(drawers) or not len(queries):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "drawer_id": pd.Series(dtype="int64"), **{c: pd.Series(dtype=object) for c in per}, "similarity": pd.Series(dtype=float)})
        a = np.stack([np.asarray(v, float) for v in drawers["embedding"]])
        b = np.stack([np.asarray(v, float) for v in queries["v"]])
        norm = np.sqrt((b * b).sum(1))[:, None] * np.sqrt((a * a).sum(1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            near = np.round(np.where(norm > 0, (b @ a.T) / norm, np.nan), 6)
        ids, out = drawers["drawer_id"].to_numpy(), []
        for q, row in zip(queries["query_id"], near):
            order = np.lexsort((ids, -np.where(np.isnan(row), -np.inf, row)))
            if per:
                place = pd.DataFrame({c: groups[c][order] for c in per}).groupby(per, dropna=False, sort=False).cumcount().to_numpy()
                order = order[place < k]
            else:
                order = order[:k]
            out.append(pd.DataFrame({"query_id": q, "drawer_id": ids[order], **{c: groups[c][order] for c in per}, "similarity": row[order]}))
        return pd.concat(out)

    return run


def vector_candidates(drawers: DataFrame, queries: DataFrame, k: int, per: list[str] | None = None) -> DataFrame:
    """query_id, drawer_id, similarity and rank (from 1) of the k nearest drawers of each query (query_id, v), and of each group `per` (its columns come along).

    Drawers and queries are dealt into blocks of bounded bytes, and each pair of blocks is one matrix product; it returns k rows for each query
    and group, so only those are shuffled by query. Drawers and queries without a vector take no part; a zero vector's similarity is null.
    """
    per = per or []
    held = drawers.where("embedding is not null").select("drawer_id", "embedding", *per)
    asked = queries.where("v is not null").select(F.col("query_id").cast("long").alias("query_id"), "v")
    # the columns of vectors aren't read to count rows
    n, some = drawers.count(), asked.select(F.size("v")).first()
    size = 8 * (some[0] if some else 1)
    blocks = max(1, -(-n * size // BLOCK_BYTES), min(drawers.sparkSession.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    q_blocks = max(1, -(-queries.count() * size // BLOCK_BYTES))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    kinds = dict(held.dtypes)
    held = held.withColumn("_block", F.pmod(F.xxhash64("drawer_id"), F.lit(blocks))).withColumn("_q", every(q_blocks))
    asked = asked.withColumn("_block", every(blocks)).withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)))
    found = held.groupBy("_block", "_q").cogroup(asked.groupBy("_block", "_q")).applyInPandas(_scores(per, k), ", ".join(["query_id long", f"drawer_id {kinds['drawer_id']}", *(f"`{c}` {kinds[c]}" for c in per), "similarity double"]))
    found = found.withColumn("similarity", F.when(~F.isnan("similarity"), F.col("similarity")))
    place = Window.partitionBy("query_id", *per).orderBy(F.desc_nulls_last("similarity"), "drawer_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def tokens(text: Column) -> Column:
    """Words of ASCII letters and digits in lower case, and every other character on its own, so that scripts without blanks can be searched."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_TOKEN), F.lit(0))


def bm25(drawers: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, drawer_id, score and rank of the k best drawers of each query (query_id, query) by BM25.

    Only postings of query terms are shuffled: terms are counted per drawer before the join, and the join is on the term. How many
    drawers have a term is counted by partial sums and goes with the queries' terms, so no task sees a whole term.
    """
    terms = written(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")), "terms")
    few = F.broadcast if terms.count() <= BROADCAST_ROWS else lambda df: df
    words = drawers.select("drawer_id", tokens(F.col("text")).alias("words")).withColumn("size", F.size("words"))
    asked = terms.select("term").distinct().withColumn("_asked", F.lit(True))
    # one pass over the texts: postings of the asked terms, and a row without a term for every drawer
    posts = words.select("drawer_id", "size", F.explode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("term")).join(few(asked), "term", "left").where("_asked or term is null")
    posts = written(posts.groupBy("term", "drawer_id", "size").agg(F.count("*").alias("tf")), "posts")
    total = posts.where("term is null").agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    n, mean = float(total["n"]), total["mean"] or 1.0
    posts = posts.where("term is not null")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = terms.join(posts.groupBy("term").agg(F.count("*").alias("df")), "term").select("query_id", "term", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    scores = posts.join(few(known), "term").withColumn("part", part).groupBy("query_id", "drawer_id").agg(F.round(F.sum("part"), 6).alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "drawer_id")
    return scores.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def fuse(vector: DataFrame, lexical: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion with ranks from 0; a drawer missing from a list gets no vote there; ties go to the better vector rank."""
    v = vector.select("query_id", "drawer_id", "similarity", F.col("rank").alias("v_rank"))
    x = lexical.select("query_id", "drawer_id", F.col("rank").alias("l_rank"))
    vote = lambda r: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(r) - 1), F.lit(0.0))
    both = v.join(x, ["query_id", "drawer_id"], "full").withColumn("rrf", F.round(vote("v_rank") + vote("l_rank"), 9))
    place = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.asc_nulls_last("v_rank"), "drawer_id")
    return both.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def policy_rank(fused: DataFrame, drawers: DataFrame, caller: Caller, k: int, boosts: Column | None = None) -> DataFrame:
    """Fused drawers by scope tier first (with the boosts of extensions, if any), then by fused rank."""
    score = tier(caller) if boosts is None else F.round(tier(caller) + boosts, 6)
    both = fused.join(drawers.select("drawer_id", score.alias("tier")), "drawer_id")
    place = Window.partitionBy("query_id").orderBy(F.desc("tier"), "rank")
    return both.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def theme_channel(themes: DataFrame, queries: DataFrame, k: int = 3, floor: float = THEME_FLOOR) -> DataFrame:
    """The nearest theme drawers above a floor; unknown similarity passes."""
    near = vector_candidates(themes.where("wing = 'Wing_Theme'"), queries, k)
    return near.where(F.col("similarity").isNull() | (F.col("similarity") >= floor))


def closet_boost(candidates: DataFrame, closets: DataFrame, k: int) -> DataFrame:
    """distance of candidates (query_id, drawer_id, source_file, similarity), lowered by the boost of the best closet of its source file.

    closets: query_id, source_file, similarity and rank (from 1, with all closets of a file) of the nearest closets, of which 2 * k count.
    """
    near = closets.where((F.col("rank") <= 2 * k) & (F.coalesce("source_file", F.lit("")) != ""))
    first = near.groupBy("query_id", "source_file").agg(F.min(F.struct("rank", (1 - F.col("similarity")).alias("distance"))).alias("best"))
    boost = F.when((F.col("best.rank") <= len(CLOSET_BOOSTS)) & (F.round("best.distance", 6) <= CLOSET_DISTANCE), F.get(F.array(*map(F.lit, CLOSET_BOOSTS)), F.col("best.rank") - 1)).otherwise(0.0)
    own = candidates.join(first.select("query_id", "source_file", boost.alias("boost")), ["query_id", "source_file"], "left")
    lowered = 1 - F.col("similarity") - F.coalesce("boost", F.lit(0.0))
    return own.withColumn("distance", F.round(F.greatest(F.lit(0.0), F.least(F.lit(2.0), lowered)), 6))


def okapi_rank(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """candidates (query_id, drawer_id, text, rank) with bm25 (the published Okapi score within each query's candidates) and bm25_rank (from 1).

    Terms in over half of the candidates count a quarter of the mean weight, as published. Windows are small (their k), so nothing
    is gathered beyond a query's candidates.
    """
    docs = candidates.select("query_id", "drawer_id", tokens(F.col("text")).alias("words")).withColumn("size", F.size("words"))
    totals = docs.groupBy("query_id").agg(F.count("*").cast("double").alias("n"), F.avg("size").alias("mean"))
    posts = docs.select("query_id", "drawer_id", "size", F.explode("words").alias("term")).groupBy("query_id", "drawer_id", "size", "term").agg(F.count("*").alias("tf"))
    df = posts.groupBy("query_id", "term").agg(F.count("*").alias("df")).join(totals, "query_id")
    df = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = df.groupBy("query_id").agg((0.25 * F.avg("idf")).alias("floor"))
    df = df.join(floor, "query_id").withColumn("idf", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")))
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scores = posts.join(asked, ["query_id", "term"]).join(df, ["query_id", "term"]).groupBy("query_id", "drawer_id").agg(F.sum(part).alias("bm25"))
    out = candidates.join(scores, ["query_id", "drawer_id"], "left").withColumn("bm25", F.round(F.coalesce("bm25", F.lit(0.0)), 6))
    place = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "rank")
    return out.withColumn("bm25_rank", F.row_number().over(place))


def rerank(candidates: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """candidates (rank, bm25_rank) by the sum of both reciprocal ranks (from 0), the vector rank breaking ties; a single candidate stays as it is."""
    vote = lambda r: 1.0 / (F.lit(rrf_k) + F.col(r) - 1)
    out = candidates.withColumn("rrf", F.round(vote("rank") + vote("bm25_rank"), 9))
    place = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "rank")
    return out.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


# fixed values: headings of the rendered memory and the memory types under each; other types go under the last
THEMES = "[主题]"
GROUPS = {
    "个人画像与健康": ["profile", "health"],
    "人机互动": ["interaction"],
    "关系": ["relationship"],
    "情绪": ["emotion"],
    "愿景与目标": ["goal"],
    "工作学习": ["work"],
    "生活方式与近况": ["preference", "life"],
}


def render(rows: DataFrame, triples: DataFrame | None = None, per_section: int = 4, width: int = 200) -> DataFrame:
    """query_id and context: sentences of triples (query_id, ordinal, line), themes, then groups of memory types, each with its first lines.

    rows: query_id, place, wing, memory_type, text, memory_time. Lines carry their date where it is known; themes are cut at
    `width` characters, other texts stay whole; blank lines part triples, themes and groups; whatever is empty is left out.
    """
    theme = F.coalesce(F.col("wing") == "Wing_Theme", F.lit(False))
    group = F.lit(len(GROUPS))
    for n, kinds in enumerate(GROUPS.values()):
        group = F.when(F.lower(F.coalesce("memory_type", F.lit(""))).isin(kinds), n + 1).otherwise(group)
    date = F.coalesce(F.concat(F.lit("["), F.date_format("memory_time", "yyyy-MM-dd"), F.lit("] ")), F.lit(""))
    cut = F.when(F.char_length("text") > width, F.concat(F.substring("text", 1, width), F.lit("…"))).otherwise(F.coalesce("text", F.lit("")))
    lines = rows.select("query_id", F.when(theme, 0).otherwise(group).alias("section"), "place", F.concat(F.lit("- "), date, F.when(theme, cut).otherwise(F.coalesce("text", F.lit("")))).alias("line"))
    first = Window.partitionBy("query_id", "section").orderBy("place")
    lines = lines.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_section)
    parts = lines.groupBy("query_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    titles = F.array(F.lit(THEMES), *(F.lit(f"{t}:") for t in GROUPS))
    parts = parts.select("query_id", "section", F.concat_ws("\n", F.get(titles, F.col("section")), "body").alias("part"))
    if triples is not None:
        said = triples.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("part"))
        parts = parts.unionByName(said.select("query_id", F.lit(-1).alias("section"), "part"))
    own = F.array_sort(F.collect_list(F.struct("section", "part")))
    all_parts = parts.groupBy("query_id").agg(own.alias("p"))
    block = lambda test: F.array_join(F.transform(F.filter("p", test), lambda x: x["part"]), "\n")
    blocks = F.array(block(lambda x: x["section"] < 0), block(lambda x: x["section"] == 0), block(lambda x: x["section"] > 0))
    return all_parts.select("query_id", F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n").alias("context"))


def with_themes(themes: DataFrame, records: DataFrame) -> DataFrame:
    """Themes first, then the records of each query that are not among them; place counts anew."""
    rest = records.join(themes.select("query_id", "drawer_id"), ["query_id", "drawer_id"], "left_anti")
    both = themes.select("query_id", "drawer_id", F.col("rank").alias("_at")).withColumn("_side", F.lit(0)).unionByName(rest.select("query_id", "drawer_id", F.col("place").alias("_at")).withColumn("_side", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_side", "_at", "drawer_id"))
    return both.withColumn("place", place).drop("_side", "_at")


def similarity_rank(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query by retrieval score, else similarity, else one less the distance, else zero; drawer ids break ties."""
    score = F.coalesce("retrieval_score", "similarity", 1 - F.col("distance"), F.lit(0.0))
    place = Window.partitionBy("query_id").orderBy(F.desc(score), "drawer_id")
    return rows.withColumn("score", F.round(score, 6)).withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def superseded_cleanly(contexts: DataFrame) -> DataFrame:
    """query_id and clean: whether a context (expected and forbidden terms, arrays) presents the old fact as past; null if that is not asked.

    Clean: some dated line holds a current term, and every line with an old one is dated no later than the newest such line.
    """
    lines = F.split("context", "\n")
    said = lambda terms: F.filter(lines, lambda x: F.exists(terms, lambda t: (t != "") & F.contains(x, t)))
    latest = lambda x: F.array_max(F.regexp_extract_all(x, F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(0)))
    current = F.array_max(F.filter(F.transform(said(F.col("expected")), latest), lambda d: d.isNotNull()))
    old = F.transform(said(F.col("forbidden")), latest)
    clean = F.when(current.isNull(), F.lit(False)).otherwise(F.forall(old, lambda d: d.isNotNull() & (d <= current)))
    asked = (F.size("expected") > 0) & (F.size("forbidden") > 0)
    return contexts.select("query_id", F.when(asked, F.coalesce(clean, F.lit(False))).alias("clean"))
