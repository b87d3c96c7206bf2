"""Graph recall for any number of queries in one plan: frontiers of entities, keyed by query, are joined to statements and merged.

What is known of an entity does not depend on who asks for it, so each entity's best statements are found once (partial limits keep
the few best of each entity before the shuffle), and frontiers of few rows a query join these short lists. Nothing is held against
every statement of a busy entity for every query that names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators import graph
from recallspark.operators.scratch import written

#: Entities that a recall starts or expands from, and the statements read of each.
ENTITIES, EACH = 3, 8
#: Slots that a short interval may touch in a join by time.
LONG = 16


def _ends(statements: DataFrame) -> DataFrame:
    return statements.withColumn("entity_id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))))


def seeds(queries: DataFrame, hints: DataFrame, matched: DataFrame, most: int = ENTITIES) -> DataFrame:
    """query_id, space_id, name and ordinal of the entities that each query (query_id, space_id) starts from, `most` at the most.

    The query's own hints (query_id, name, place) lead, each name once; what its phrase matches (query_id, name, rank) fills the places
    they leave, and a match that a hint names already is not put in anew.
    """
    once = hints.groupBy("query_id", "name").agg(F.min("place").alias("place"))
    led = once.withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "name"))).where(F.col("ordinal") <= most).drop("place")
    used = led.groupBy("query_id").agg(F.count("*").alias("_used"))
    rest = matched.join(used, "query_id", "left").withColumn("_used", F.coalesce("_used", F.lit(0)))
    rest = rest.where(F.col("rank") <= most - F.col("_used")).join(led, ["query_id", "name"], "left_anti")
    both = led.unionByName(rest.select("query_id", "name", (F.col("_used") + F.col("rank")).alias("ordinal")))
    return both.join(queries.select("query_id", "space_id"), "query_id").select("query_id", "space_id", "name", "ordinal")


def of_turns(recalled: DataFrame, statements: DataFrame, entities: DataFrame, most: int = ENTITIES) -> DataFrame:
    """query_id, space_id, name and ordinal of the entities that the turns of each query's records (query_id, space_id, source_turn_id) speak of, by number of statements, then name.

    statements are all that the caller may read, ended ones too: history may name an entity. A statement counts once for a query, however
    many of its records share the turn.
    """
    turns = recalled.where("source_turn_id is not null and source_turn_id <> ''").select("query_id", "space_id", "source_turn_id").distinct()
    told = _ends(statements).groupBy("space_id", "source_turn_id", "entity_id").agg(F.count("*").alias("hits"))
    hits = turns.join(told, ["space_id", "source_turn_id"]).groupBy("query_id", "space_id", "entity_id").agg(F.sum("hits").alias("hits"))
    named = hits.join(entities.select("space_id", "entity_id", "name"), ["space_id", "entity_id"]).groupBy("query_id", "space_id", "name").agg(F.sum("hits").alias("hits"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "name"))
    return named.withColumn("ordinal", place).where(F.col("ordinal") <= most).drop("hits")


def facts(frontier: DataFrame, statements: DataFrame, entities: DataFrame, each: int = EACH, key: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The `each` best statements about every entity of a frontier (query_id, space_id, name, ordinal), with query_id and their place in the query (ordinal, from 1).

    Statements of both directions count; one that two entities of a query share stays with the first. key: what names a query (and a part of it).
    """
    known = frontier.join(entities.select("space_id", "name", "entity_id"), ["space_id", "name"]).withColumnRenamed("ordinal", "_seed")
    asked = known.select("space_id", "entity_id").distinct()
    best = _ends(statements).join(asked, ["space_id", "entity_id"], "left_semi")
    best = best.withColumn("_rank", F.row_number().over(Window.partitionBy("space_id", "entity_id").orderBy(*graph.relevance()))).where(F.col("_rank") <= each)
    # dealt by query once: all that follows is within a query
    found = known.select(*key, "space_id", "entity_id", "_seed").join(best, ["space_id", "entity_id"]).repartition("query_id")
    first = Window.partitionBy(*key, "statement_id").orderBy("_seed", "_rank")
    found = found.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_seed", "_rank"))
    return found.withColumn("ordinal", place).drop("_n", "_seed", "_rank", "entity_id")


def merged(both: DataFrame, recalled: DataFrame, limit: int = graph.MERGE_LIMIT) -> DataFrame:
    """Each query's statements once: those asked about (_side 0), then those expanded to (_side 1); what a recalled record of the query already says comes last. ordinal counts anew."""
    first = Window.partitionBy("query_id", "statement_id").orderBy("_side", "ordinal")
    both = both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    shown = recalled.where("source_turn_id <> ''").groupBy("query_id").agg(F.collect_set("source_turn_id").alias("_shown"))  # a few records a query
    both = both.join(shown, "query_id", "left").withColumn("restates", F.coalesce(F.array_contains("_shown", F.col("source_turn_id")), F.lit(False))).drop("_shown")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("restates", "_side", "ordinal"))
    return both.withColumn("ordinal", place).where(F.col("ordinal") <= limit).drop("_side")


def recall(queries: DataFrame, hints: DataFrame, recalled: DataFrame, statements: DataFrame, entities: DataFrame, mentions: DataFrame, audiences: list[str], as_of, sensitive: bool = False) -> DataFrame:
    """The graph half of a recall: for each query (query_id, space_id, query) its own statements, in order (ordinal), with whether a record restates them.

    recalled: query_id, space_id, source_turn_id of the records that the other half found. What the audiences may not read neither seeds nor
    is returned, and only what holds at as_of is returned. Queries that nothing is known for give no rows.
    """
    told = graph.visible(statements, audiences, sensitive=sensitive)
    now = told.where(graph.valid_at(as_of))
    phrases = queries.select(F.col("query_id").alias("phrase_id"), "space_id", F.col("query").alias("phrase"))
    matched = written(graph.matched_entities(phrases, entities, mentions, audiences, cap=ENTITIES), "matched").withColumnRenamed("phrase_id", "query_id")
    # a few rows for each query
    frontier = seeds(queries, hints, matched).withColumn("_side", F.lit(0)).unionByName(of_turns(recalled, told, entities).withColumn("_side", F.lit(1)))
    both = facts(written(frontier, "frontier"), now, entities, key=("query_id", "_side"))
    return merged(both, recalled)


def valid_when(moments: DataFrame, statements: DataFrame, time: str, key: list[str], slot_seconds: int | None = None) -> DataFrame:
    """moments with the statements of their key that hold at their time: an interval join on [valid_from, valid_to).

    Time is cut into slots of about the mean length of an interval, within the span of the moments; a statement lies in each slot that it touches and a moment in one, so
    both meet by key and slot, and a busy key is as many small groups as it has slots. Statements that hold longer than LONG slots, or have an open
    end, are cut at the span of the moments and kept once for every LONG slots instead, where all of the moments of those slots meet them. Moments without a time give no rows.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    span = moments.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    if span["a"] is None:
        return moments.join(statements.drop(*[c for c in statements.columns if c in moments.columns and c not in key]), key).limit(0)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = statements.withColumns({"_a": F.greatest(F.coalesce(micros("valid_from"), F.lit(span["a"])), F.lit(span["a"])), "_b": F.least(F.coalesce(micros("valid_to") - 1, F.lit(span["b"])), F.lit(span["b"]))}).where("_a <= _b")
    mean = held.agg(F.avg(F.col("_b") - F.col("_a"))).first()[0] or 0
    slot = int(slot_seconds * 1_000_000 if slot_seconds else max(1_000_000, mean))
    fine = lambda c, wide: F.floor((F.col(c) - F.lit(span["a"])) / F.lit(wide)).cast("long")
    short = F.col("_b") - F.col("_a") <= LONG * slot
    slots = F.when(short, F.transform(F.sequence(fine("_a", slot), fine("_b", slot)), lambda x: F.struct(F.lit(0).alias("wide"), x.alias("at")))).otherwise(F.transform(F.sequence(fine("_a", LONG * slot), fine("_b", LONG * slot)), lambda x: F.struct(F.lit(1).alias("wide"), x.alias("at"))))
    dealt = held.withColumn("_slot", F.explode(slots)).drop("_a", "_b")
    asked = moments.where(F.col(time).isNotNull()).withColumn("_at", at)
    asked = asked.withColumn("_slot", F.explode(F.array(F.struct(F.lit(0).alias("wide"), fine("_at", slot).alias("at")), F.struct(F.lit(1).alias("wide"), fine("_at", LONG * slot).alias("at"))))).drop("_at")
    found = asked.join(dealt.drop(*[c for c in dealt.columns if c in moments.columns and c not in key]), [*key, "_slot"])
    return found.where(graph.valid_at(F.col(time))).drop("_slot")
