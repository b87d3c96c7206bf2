"""Line dedup by content-defined chunks, in SQL functions.

A rolling hash over the hashes of adjacent lines closes a chunk where it meets a condition on the last three lines alone, so an
inserted or deleted line moves no boundary but its own; no chunk but a text's last has fewer than two lines. Chunks
are compared over all documents by their bytes; the first place (smallest id, then position) of each stays, and later ones go. A
chunk that goes takes along the lines on either side that also stand beside its first place, as far as they agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.common import materialize, table

#: Of the line pairs, one in SPACING meets the condition; fewer lines than LEAST are never removed on their own.
SPACING, LEAST = 2, 2
#: Seeds of the chunk hash that are tried, and bytes of repeated chunks' places that may be sent to every task; more are joined by a shuffle.
ATTEMPTS, BROADCAST_BYTES = 3, 8 << 20

_LINES = r"split(text, r'\n')"


def _let(value: str, name: str, body: str) -> str:
    """Evaluates value once and names it within body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def chunk_ends(lines: str, spacing: int) -> str:
    """SQL for the last line number (from 1) of each chunk, given an array of lines."""
    meets = f"transform(h, (x, i) -> if(i = 0, false, pmod(xxhash64(h[i - 1], x), {spacing}) = 0))"
    ends = "filter(sequence(1, size(h)), i -> i = size(h) OR (m[i - 1] AND NOT coalesce(get(m, i - 2), false)))"
    return _let(f"transform({lines}, l -> xxhash64(l))", "h", _let(meets, "m", ends))


def _marks(lines: str) -> str:
    """SQL for two hashes of each line, in a row."""
    return f"flatten(transform({lines}, z -> array(xxhash64(z), xxhash64(1, z))))"


def _chunks(lines: str, ends: str) -> str:
    """SQL for structs (c, lines, before, after) of the chunks: their lines and the marks of the chunks on either side."""
    start = lambda c: f"if({c} <= 0, 0, {ends}[{c} - 1])"
    cut = lambda c: f"slice({lines}, {start(c)} + 1, {ends}[{c}] - {start(c)})"
    before = f"if(c = 0, cast(array() AS array<bigint>), {_marks(cut('(c - 1)'))})"
    after = f"if(c + 1 >= size({ends}), cast(array() AS array<bigint>), {_marks(cut('(c + 1)'))})"
    return f"transform({ends}, (e, c) -> struct(c AS c, {cut('c')} AS lines, {before} AS before, {after} AS after))"


def _later_places(chunks: DataFrame) -> DataFrame:
    """k and gone (structs c, before, after) of the chunks whose bytes also stand at an earlier place; before and after are that place's.

    Chunks are grouped by their bytes with partial sums, so copies go no further than their task. Places are then told by hash
    alone; should two different chunks share one, all is done again with another seed.
    """
    for seed in range(ATTEMPTS):
        h = F.xxhash64(F.lit(seed), "lines").alias("h")
        place = F.struct("k", "c", "before", "after").alias("place")
        same = chunks.select(h, F.array_join("lines", "\n").alias("chunk"), place).groupBy("h", "chunk").agg(F.min("place").alias("first"), F.count("*").alias("times"))
        firsts = materialize(same.groupBy("h").agg(F.min("first").alias("first"), F.sum("times").alias("times"), F.count("*").alias("kinds")).where("times > 1"))
        if firsts.where("kinds > 1").limit(1).count():
            continue
        known = firsts.select("h", "first")
        marks = F.size("first.before") + F.size("first.after")
        if (firsts.agg(F.sum(100 + 8 * marks)).first()[0] or 0) <= BROADCAST_BYTES:
            known = F.broadcast(known)
        later = chunks.select("k", "c", h).join(known, "h").where((F.col("k") != F.col("first.k")) | (F.col("c") != F.col("first.c")))
        return later.groupBy("k").agg(F.collect_set(F.struct("c", F.col("first.before").alias("before"), F.col("first.after").alias("after"))).alias("gone"))
    raise RuntimeError("chunk hashes collided under every seed")


def _removed(gone: str, marks: str, ends: str) -> str:
    """SQL for ranges (a, b) of line numbers (from 0, b excluded) that go, given the chunks that go and the marks of all lines."""
    start, stop = f"if(z.c = 0, 0, {ends}[z.c - 1])", f"{ends}[z.c]"
    stays = lambda c: f"NOT exists({gone}, o -> o.c = {c})"
    room_before = f"least(({start}) - if(z.c < 2, 0, {ends}[z.c - 2]), cast(size(z.before) / 2 AS int))"
    room_after = f"least({ends}[z.c + 1] - {stop}, cast(size(z.after) / 2 AS int))"

    def agree(own: str, theirs: str, at: str, most: str) -> str:
        """How many lines agree, the j-th (from 1) being own and theirs[at]."""
        unlike = f"{marks}[2 * ({own})] <> {theirs}[{at}] OR {marks}[2 * ({own}) + 1] <> {theirs}[{at} + 1]"
        return f"if({most} < 1, 0, coalesce(get(filter(sequence(1, {most}), j -> {unlike}), 0) - 1, {most}))"

    before = f"if(z.c > 0 AND {stays('z.c - 1')}, {agree(f'({start}) - j', 'z.before', 'size(z.before) - 2 * j', room_before)}, 0)"
    after = f"if(z.c + 1 < size({ends}) AND {stays('z.c + 1')}, {agree(f'{stop} + j - 1', 'z.after', '2 * j - 2', room_after)}, 0)"
    return f"transform({gone}, z -> struct(({start}) - {before} AS a, {stop} + {after} AS b))"


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spacing: int = SPACING, least: int = LEAST, carry: list[str] | None = None) -> DataFrame:
    """id_col, the columns of carry, text (kept lines), n_lines and n_removed (lines) of every row of docs.

    Chunks of at least `least` lines that repeat anywhere stay only at their first place: smallest id (null first), then
    position; lines beside a chunk that goes, up to its neighbours' ends, go too where two hashes of each say that they also stand beside
    the first place. Null text stays null with no lines; an empty text is one empty line; identical rows (id and text)
    count as one place, so none thins the other out; an empty table gives no rows; columns other than carry are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*(carry or [F.lit(0)])).alias("carried")).withColumn("k", F.struct("id", F.xxhash64("text").alias("t")))
    texts = rows.where("text IS NOT NULL")
    cut = texts.withColumn("x", F.expr(f"struct({_LINES} AS l, {chunk_ends(_LINES, spacing)} AS e)"))
    held = cut.select("k", F.explode(F.expr(f"filter({_chunks('x.l', 'x.e')}, y -> size(y.lines) >= {least})")).alias("y"))
    gone = _later_places(held.select("k", "y.c", "y.lines", "y.before", "y.after"))
    out = texts.join(gone, "k", "left").withColumn("x", F.expr(f"struct({_LINES} AS l, {chunk_ends(_LINES, spacing)} AS e)"))
    ranges = _let(_marks("x.l"), "u", _removed("gone", "u", "x.e"))
    kept = F.expr(f"if(gone IS NULL, x.l, {_let(ranges, 'r', 'filter(x.l, (line, i) -> NOT exists(r, s -> i >= s.a AND i < s.b))')})")
    out = out.select(F.col("k.id").alias("id"), F.size("x.l").alias("n_lines"), kept.alias("kept"), "carried")
    out = out.select("id", "carried", F.expr(r"array_join(kept, '\n')").alias("text"), F.col("n_lines").cast("long"), (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"))
    empty = rows.where("text IS NULL").select("id", "carried", "text", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return out.unionByName(empty).select(F.col("id").alias(id_col), *(F.col(f"carried.{c}") for c in carry or []), "text", "n_lines", "n_removed")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of line_dedup over all documents."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES: dict[str, str] = {}
