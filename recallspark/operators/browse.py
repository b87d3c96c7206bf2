"""Listings for people: roll-ups, rooms and tunnels, dated entries, exports, forget candidates, themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores of forget candidates by how the text meets the phrase, and shortest text that a phrase may contain.
EXACT, CONTAINED, CONTAINS, LEAST = 1.0, 0.9, 0.85, 4


def rollup(drawers: DataFrame, previews: int = 3, width: int = 60) -> DataFrame:
    """wing, room, drawers, preview ids (smallest) and whether there are more; ids are cut to `previews` before they are gathered."""
    place = Window.partitionBy("wing", "room").orderBy("drawer_id")
    n = drawers.withColumn("_n", F.row_number().over(place))
    out = n.groupBy("wing", "room").agg(F.count("*").alias("drawers"), F.array_sort(F.collect_list(F.when(F.col("_n") <= previews, F.col("drawer_id")))).alias("ids"))
    return out.select("wing", "room", "drawers", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("previews"), (F.col("drawers") > previews).alias("truncated"))


def owner_browse(drawers: DataFrame, seen: Column) -> DataFrame:
    return drawers.groupBy("wing").agg(F.count_if(seen).alias("visible"), F.count_if(~seen).alias("withheld"))


def owner_tree(drawers: DataFrame, seen: Column, wings: list[str], titles: int, most: int) -> DataFrame:
    """place, wing, room, drawers and titles (the first ones, with whether there are more) of what an owner may see, with entry_count, withheld_count and truncated on each row.

    At most `most` drawers, by id, are looked at, as a page; truncated says whether there are more, and what may not be seen among them is counted. Wings go in the
    order given, others after them by name; empty ones are not shown.
    """
    some = drawers.orderBy("drawer_id").limit(most).withColumn("_seen", seen)
    counts = some.agg(F.count_if("_seen").alias("entry_count"), F.count_if(~F.col("_seen")).alias("withheld_count"))
    more = drawers.limit(most + 1).agg((F.count("*") > most).alias("truncated"))
    first = Window.partitionBy("wing", "room").orderBy("drawer_id")
    rows = some.where("_seen").withColumn("_n", F.row_number().over(first))
    out = rows.groupBy("wing", "room").agg(F.count("*").alias("drawers"), F.array_sort(F.collect_list(F.when(F.col("_n") <= titles, F.col("drawer_id")))).alias("titles"))
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, wings)), F.col("wing")), F.lit(0)), F.lit(len(wings) + 1))
    return out.select(order.cast("int").alias("place"), "wing", "room", "drawers", "titles", (F.col("drawers") > titles).alias("more"), counts.select("entry_count").scalar().alias("entry_count"), counts.select("withheld_count").scalar().alias("withheld_count"), more.scalar().alias("truncated"))


def rooms(drawers: DataFrame) -> DataFrame:
    """Rooms with their wings; a room of two wings or more is a tunnel. Tunnels come first."""
    pairs = drawers.groupBy("room", "wing").agg(F.count("*").alias("n"))
    out = pairs.groupBy("room").agg(F.sum("n").alias("drawers"), F.count("*").alias("wings"))
    return out.withColumn("tunnel", F.col("wings") >= 2)


def room_edges(drawers: DataFrame) -> DataFrame:
    """Pairs of rooms that share wings, and how many; rooms and wings are small dimensions of the drawers."""
    pairs = drawers.select("room", "wing").distinct()
    other = pairs.withColumnRenamed("room", "other")
    return pairs.join(other, "wing").where("room < other").groupBy("room", "other").agg(F.count("*").alias("shared"))


def entries(drawers: DataFrame, limit: int, before: tuple[str, int] | None = None) -> DataFrame:
    """A page of dated drawers, newest first; `before` is the (time, id) of the last row of the page before."""
    rows = drawers.where("memory_time is not null")
    if before:
        at = F.lit(before[0].replace("T", " ")).cast("timestamp_ntz")
        rows = rows.where((F.col("memory_time") < at) | ((F.col("memory_time") == at) & (F.col("drawer_id") < before[1])))
    return rows.orderBy(F.desc("memory_time"), F.desc("drawer_id")).limit(limit)


def export(drawers: DataFrame, seen: Column) -> DataFrame:
    """All visible drawers in order: dated ones newest first, undated last."""
    return drawers.where(seen).orderBy(F.desc_nulls_last("memory_time"), F.desc("drawer_id"))


def plain(text: Column) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "")


def forget_candidates(rows: DataFrame, phrase: str, text: str = "text") -> DataFrame:
    """Rows that a phrase may mean, with their score; never truncated."""
    said, asked = plain(F.col(text)), plain(F.lit(phrase))
    score = F.when(said == asked, EXACT).when((F.char_length(asked) >= 2) & F.contains(said, asked), CONTAINED).when((F.char_length(said) >= LEAST) & F.contains(asked, said), CONTAINS)
    return rows.withColumn("score", score).where("score is not null")


def theme_groups(drawers: DataFrame, since: Column, window_days: int, least: int, newest: int) -> DataFrame:
    """Groups of recent or undated drawers by space, audience and wing, with the newest ids oldest first, and a hash of space, audience, wing, window and those ids that names the theme."""
    key = ["space_id", "audience", "wing"]
    rows = drawers.where(F.col("memory_time").isNull() | (F.col("memory_time") >= since)).withColumn("audience", F.coalesce("audience", F.lit("owner")))
    place = Window.partitionBy(*key).orderBy(F.desc_nulls_last("memory_time"), F.desc("drawer_id"))
    rows = rows.withColumn("_n", F.row_number().over(place))
    out = rows.groupBy(*key).agg(F.count("*").alias("drawers"), F.array_sort(F.collect_list(F.when(F.col("_n") <= newest, F.struct((-F.col("_n")).alias("n"), F.col("drawer_id").cast("string").alias("id"))))).alias("kept"))
    ids, named = F.array_join("kept.id", ","), F.array_join(F.array_sort("kept.id"), ",")
    theme = F.substring(F.sha2(F.concat_ws("|", *key, F.lit(str(window_days)), named), 256), 1, 16)
    return out.where(F.col("drawers") >= least).select(*key, "drawers", ids.alias("ids"), theme.alias("theme_id"))


def hierarchy(drawers: DataFrame, wings: list[str], previews: int = 3, width: int = 96) -> DataFrame:
    """Wing, room and how many drawers each holds, with previews of the first ones (blanks squeezed, cut with an ellipsis), and whether there are more.

    Wings that are configured but empty have one row without a room; equal previews of a room count once.
    """
    plain_text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\p{Z}]+", " "))
    short = F.when(F.char_length(plain_text) > width, F.concat(F.substring(plain_text, 1, width), F.lit("…"))).otherwise(plain_text)
    rows = drawers.select("wing", "room", "drawer_id", short.alias("preview"))
    counts = rows.groupBy("wing", "room").agg(F.count("*").alias("drawers"))
    once = rows.groupBy("wing", "room", "preview").agg(F.min("drawer_id").alias("first"))
    place = Window.partitionBy("wing", "room").orderBy("first")
    some = once.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= previews + 1).groupBy("wing", "room").agg(F.array_sort(F.collect_list(F.struct("_n", "preview"))).alias("p"))
    shown = F.transform(F.slice("p", 1, previews), lambda x: x["preview"])
    out = counts.alias("c").join(some.alias("s"), F.expr("c.wing <=> s.wing and c.room <=> s.room")).select("c.wing", "c.room", "c.drawers", shown.alias("previews"), (F.size("p") > previews).alias("truncated"))
    configured = drawers.sparkSession.createDataFrame([(w,) for w in wings], "wing string").join(counts.select("wing").distinct(), "wing", "left_anti")
    return out.unionByName(configured.select("wing", F.lit(None).cast("string").alias("room"), F.lit(0).cast("long").alias("drawers"), F.array().cast("array<string>").alias("previews"), F.lit(False).alias("truncated")))


def entries_with_counts(drawers: DataFrame, limit: int, since: Column, until: Column) -> DataFrame:
    """The newest dated drawers of a window, with whether it holds more, and how many drawers have no date and so are in no window."""
    dated = drawers.where((F.col("memory_time") >= since) & (F.col("memory_time") < until))
    more = dated.agg((F.count("*") > limit).alias("m")).scalar()
    undated = drawers.agg(F.count_if(F.col("memory_time").isNull()).alias("u")).scalar()
    return dated.orderBy(F.desc("memory_time"), F.desc("drawer_id")).limit(limit).withColumn("more_in_window", more).withColumn("undated_count", undated)


#: What an export names of each record.
EXPORTED = ["drawer_id", "text", "memory_time", "wing", "room", "memory_type", "importance", "audience", "source_turn_id"]


def capped_edges(drawers: DataFrame, limit: int) -> DataFrame:
    """The pairs of rooms that share most wings, at most `limit`, those of more wings first."""
    return room_edges(drawers).orderBy(F.desc("shared"), "room", "other").limit(limit)
