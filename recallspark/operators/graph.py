"""Operators on the bi-temporal knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.scratch import written

#: Characters by which longer names are looked up before the whole of them is, and the triples that a merge keeps (entities times triples of each).
HEAD, MERGE_LIMIT = 64, 24
#: Phrases that a task searches, rows of names that are broadcast (a long name counts for each HEAD of its characters), and parts of a name beyond that.
PHRASES, NAMES, SALTS = 10_000, 1_200_000, 16


def relevance() -> list[Column]:
    """Most confident first, then latest start and record; ids break ties."""
    return [F.desc_nulls_last("confidence"), F.desc_nulls_last("valid_from"), F.desc_nulls_last("recorded_at"), F.asc("statement_id")]


def time(text: str) -> Column:
    return F.lit(text.replace("T", " ")).cast("timestamp_ntz")


def valid_at(moment: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open validity; null bounds are open."""
    return (F.col(start).isNull() | (F.col(start) <= moment)) & (F.col(end).isNull() | (F.col(end) > moment))


def readable(audiences: list[str], column: str = "audience") -> Column:
    """Whether a row is for one of the audiences; no audiences read nothing."""
    return F.col(column).isin(audiences) if audiences else F.lit(False)


def visible(statements: DataFrame, audiences: list[str] | None, as_of: Column | None = None, sensitive: bool = False, space: str | None = None) -> DataFrame:
    """The statements that a caller may read, in one space or in each on its own; audiences None is the owner, who reads all."""
    out = statements.where(F.col("space_id") == space) if space else statements
    if audiences is not None:
        out = out.where(readable(audiences))
    if not sensitive:
        out = out.where(~F.col("sensitive"))
    return out.where(valid_at(as_of)) if as_of is not None else out


def with_names(statements: DataFrame, entities: DataFrame) -> DataFrame:
    """Display names of both ends in the statement's space; statements of unknown entities go, as in an inner join."""
    s, o = entities.withColumnsRenamed({"entity_id": "subject_id", "name": "subject"}), entities.withColumnsRenamed({"entity_id": "object_id", "name": "object"})
    return statements.join(s, ["space_id", "subject_id"]).join(o, ["space_id", "object_id"])


def top_per_subject(statements: DataFrame, n: int) -> DataFrame:
    """The n most relevant statements of each subject of a space, with their rank from 1."""
    place = Window.partitionBy("space_id", "subject_id").orderBy(*relevance())
    return statements.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def touches(entity: str, direction: str) -> Column:
    out, into = F.col("subject_id") == entity, F.col("object_id") == entity
    return {"outgoing": out, "incoming": into, "both": out | into}[direction]


def entity_read(statements: DataFrame, entity: str, direction: str = "both", limit: int = 200) -> DataFrame:
    """The most relevant statements of one entity."""
    return statements.where(touches(entity, direction)).orderBy(*relevance()).limit(limit)


def read_combined(statements: DataFrame, seeds: list[str], each: int) -> DataFrame:
    """Both directions of several entities, `each` per entity; a statement that two seeds share counts for the first."""
    ends = statements.withColumn("entity_id", F.explode(F.array_distinct(F.array("subject_id", "object_id")))).where(F.col("entity_id").isin(seeds))
    ends = ends.withColumn("seed", F.array_position(F.array(*map(F.lit, seeds)), F.col("entity_id")) - 1)
    ends = ends.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(*relevance()))).where(F.col("rank") <= each)
    first = Window.partitionBy("statement_id").orderBy("seed")
    return ends.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def timeline(statements: DataFrame, entity: str | None = None, since: Column | None = None, until: Column | None = None, current: Column | None = None, after: tuple[str, str] | None = None, limit: int = 100) -> DataFrame:
    """Newest first; `after` is the (recorded_at, statement_id) of the last row of the page before."""
    out = statements
    if entity:
        out = out.where(touches(entity, "both"))
    if since is not None:
        out = out.where(F.col("valid_from").isNull() | (F.col("valid_from") >= since))
    if until is not None:
        out = out.where(F.col("valid_from").isNull() | (F.col("valid_from") < until))
    if current is not None:
        out = out.where(valid_at(current))
    if after:
        at, key = time(after[0]), F.lit(after[1])
        out = out.where((F.col("recorded_at") < at) | ((F.col("recorded_at") == at) & (F.col("statement_id") < key)))
    return out.orderBy(F.desc("recorded_at"), F.desc("statement_id")).limit(limit)


def entities_of_turns(statements: DataFrame, entities: DataFrame, turns: list[str], limit: int) -> DataFrame:
    """Entities named by statements of some turns, by number of statements; one that is both ends of a statement counts once."""
    ends = statements.where(F.col("source_turn_id").isin(turns)).select("space_id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id"))
    counted = ends.groupBy("space_id", "entity_id").agg(F.count("*").alias("hits"))
    return counted.join(entities, ["space_id", "entity_id"]).groupBy("name").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "name").limit(limit)


def expand_one_hop(statements: DataFrame, turns: list[str], as_of: Column, seeds: int, limit: int) -> DataFrame:
    """Current statements about the entities that some turns speak of: history may seed, only what holds now is returned."""
    ends = lambda df: df.withColumn("entity_id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))))
    seed = ends(statements.where(F.col("source_turn_id").isin(turns))).groupBy("entity_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "entity_id").limit(seeds)
    found = ends(statements.where(valid_at(as_of))).join(seed.select("entity_id"), "entity_id", "left_semi")
    return found.drop("entity_id").dropDuplicates(["statement_id"]).orderBy(*relevance()).limit(limit)


def substrings(text: Column, sizes: Column) -> Column:
    """All distinct substrings of a short text whose length is one of sizes (an array)."""
    length = F.char_length(text)
    fits = F.filter(sizes, lambda n: (n > 0) & (n <= length))
    cut = F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), length - n + 1), lambda a: F.substring(text, a, n)))
    return F.array_distinct(F.flatten(cut))


def match_names(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """phrases with the columns of each name of their space (column match) that occurs in the phrase.

    Substrings of a phrase, of lengths that names have, meet the names in a hash join, so no phrase is held against every name. A phrase has some
    hundred substrings, so phrases are dealt by their id before, and up to NAMES rows of names are broadcast: only phrases are shuffled. More names than
    that are dealt by salts with the substrings, so that one that many phrases have is in many tasks.

    Names of more than HEAD characters are looked up by their first HEAD ones and the lengths of names that begin so; only where these stand in a
    phrase are substrings of such lengths made, and these meet the whole names in the same way. No name is too long, and names that begin alike are not tried one by one.
    """
    some = written(names.where(F.char_length("match") > 0), "names")
    length = F.char_length("match")
    told = some.agg(F.collect_set(F.when(length <= HEAD, length)).alias("sizes"), F.count_if(length <= HEAD).alias("rows"), F.count_if(length > HEAD).alias("long"), F.sum(F.when(length > HEAD, F.ceil(length / HEAD))).alias("heads")).first()  # HEAD sizes at most
    tasks = max(phrases.sparkSession.sparkContext.defaultParallelism, -(-phrases.count() // PHRASES))
    dealt = phrases.repartition(tasks, "phrase_id")
    parts = lambda sizes: F.explode(substrings(F.col("phrase"), F.array(*map(F.lit, sizes)).cast("array<int>")))
    if not told["long"]:
        return _met(dealt.withColumn("match", parts(sorted(told["sizes"]))), some, told["rows"])
    short = _met(dealt.withColumn("match", parts(sorted(told["sizes"]))), some.where(length <= HEAD), told["rows"])
    some = some.where(length > HEAD)
    heads = some.select("space_id", F.substring("match", 1, HEAD).alias("match"), length.alias("_size")).distinct()
    begun = _met(dealt.withColumn("match", parts([HEAD])), heads, told["long"])
    at = F.filter(F.sequence(F.lit(1), F.char_length("phrase") - F.col("_size") + 1), lambda a: F.substring(F.col("phrase"), a, F.lit(HEAD)) == F.col("match"))
    whole = F.array_distinct(F.transform(at, lambda a: F.substring(F.col("phrase"), a, F.col("_size"))))
    begun = begun.where(F.char_length("phrase") >= F.col("_size")).withColumn("match", F.explode(whole)).drop("_size")
    return short.unionByName(_met(begun, some, told["heads"]))


def _met(parts: DataFrame, names: DataFrame, rows: int) -> DataFrame:
    """parts with the columns of the names of their space that they equal: so many rows of names are broadcast, or dealt by salts if they are over NAMES."""
    if rows <= NAMES:
        return parts.join(F.broadcast(names), ["space_id", "match"])
    dealt = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return parts.withColumn("_salt", F.pmod(F.xxhash64("phrase_id"), F.lit(SALTS)).cast("int")).join(dealt, ["space_id", "match", "_salt"]).drop("_salt")


def matched_entities(phrases: DataFrame, entities: DataFrame, mentions: DataFrame, audiences: list[str], cap: int = 3, least: float = 0.0, aliases_only: bool = False) -> DataFrame:
    """phrase_id, name, stage and rank of the entities that a phrase may be about, at most cap for each.

    Whole names come first, then names by what follows their first colon, then aliases that the audiences may read; longest
    first within each, names by themselves break ties. An entity counts at its first stage only. Names are matched as they are written,
    aliases in lower case.
    """
    entities = written(entities.select("space_id", "entity_id", "name"), "entities")
    forms = F.array(*(F.struct(F.lit(n).alias("stage"), form.alias("match")) for n, form in enumerate([F.col("name"), tail(F.col("name"))])))
    named = entities.select("space_id", "name", F.char_length("name").alias("length"), F.inline(forms))
    known = mentions.where(readable(audiences) & (F.col("confidence") >= least))
    alias = known.join(entities, ["space_id", "entity_id"]).select("space_id", "name", F.char_length("alias").alias("length"), F.lit(2).alias("stage"), F.col("alias").alias("match"))
    lowered = phrases.withColumn("phrase", F.lower("phrase"))
    place = F.struct("stage", (-F.col("length")).alias("short")).alias("place")
    hits = match_names(lowered, alias).select("phrase_id", "name", place)
    if not aliases_only:
        hits = match_names(phrases, named).select("phrase_id", "name", place).unionByName(hits)
    best = hits.repartition("phrase_id").groupBy("phrase_id", "name").agg(F.min("place").alias("place"))
    order = Window.partitionBy("phrase_id").orderBy("place", "name")
    return best.select("phrase_id", "name", F.col("place.stage").alias("stage"), F.row_number().over(order).alias("rank")).where(F.col("rank") <= cap)


def tail(name: Column) -> Column:
    """What follows the first colon of a name, if any."""
    return F.when(F.instr(name, ":") > 0, F.expr("substring(name, instr(name, ':') + 1)"))


def stats(statements: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    s = statements.agg(F.count("*").alias("statements"), F.count_if(F.col("valid_to").isNull()).alias("active"), F.count_if(F.col("valid_to").isNotNull()).alias("invalidated"), F.count_if("sensitive").alias("sensitive"))
    count = lambda df: df.agg(F.count("*").alias("n")).scalar()
    return s.withColumn("entities", count(entities)).withColumn("mentions", count(mentions))


def degrees(statements: DataFrame, limit: int) -> DataFrame:
    ends = statements.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id"))
    return ends.groupBy("entity_id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "entity_id").limit(limit)


def add_triples(incoming: DataFrame) -> DataFrame:
    """Idempotent adds, in order of recorded_at: what three probes let through, whatever the replay order.

    A projection id names the first statement that brings it; later ones are its replays (or conflicts, see projection_conflicts).
    Of equal (turn, subject, predicate, object) for one audience of a space the first stays, open or not; and while an equal statement is open,
    no other turn adds it again.
    """
    fact = ["space_id", "subject_id", "predicate", "object_id", "audience"]
    order = ["recorded_at", "statement_id"]
    first = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    rows = incoming.withColumn("_n", F.when(F.col("projection_id").isNotNull(), first("space_id", "projection_id")).otherwise(1)).where("_n = 1")
    rows = rows.withColumn("_n", F.when(F.col("source_turn_id").isNotNull(), first(*fact, "source_turn_id")).otherwise(1)).where("_n = 1")
    before = Window.partitionBy(*fact).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_n", F.coalesce(F.count_if(F.col("valid_to").isNull()).over(before), F.lit(0))).where("_n = 0").drop("_n")


def projection_conflicts(incoming: DataFrame) -> DataFrame:
    """Statements whose projection id already names a different (subject, predicate, object, audience) of their space."""
    fact = F.struct("subject_id", "predicate", "object_id", "audience")
    first = Window.partitionBy("space_id", "projection_id").orderBy("recorded_at", "statement_id")
    rows = incoming.where("projection_id is not null").withColumn("_first", F.first(fact).over(first))
    return rows.where(F.col("_first") != fact).drop("_first")


def invalidate(statements: DataFrame, ends: DataFrame, audiences: list[str]) -> DataFrame:
    """Closes open statements of the caller's audiences at the first end of their (space, subject, predicate, object) after their start; others stay as they are."""
    key = ["space_id", "subject_id", "predicate", "object_id"]
    hits = statements.where(F.col("valid_to").isNull() & readable(audiences)).join(ends.select(*key, "ended_at"), key).where("valid_from is null or ended_at > valid_from")
    first = hits.groupBy("statement_id").agg(F.min("ended_at").alias("ended_at"))
    return statements.join(first, "statement_id", "left").withColumn("valid_to", F.coalesce("valid_to", "ended_at")).drop("ended_at")


def supersede(statements: DataFrame, single: list[str]) -> DataFrame:
    """For predicates that hold one value at a time, ends each statement where the subject's next one for the same audience starts, with no gap."""
    then = Window.partitionBy("space_id", "audience", "subject_id", "predicate").orderBy(F.asc_nulls_first("valid_from"), "statement_id")
    follows = F.when(F.col("predicate").isin(single), F.lead("valid_from").over(then))
    return statements.withColumn("valid_to", F.coalesce(F.least("valid_to", follows), "valid_to", follows))


def forget(statements: DataFrame, turns: DataFrame) -> DataFrame:
    """Statements without those of forgotten turns."""
    return statements.join(turns, "source_turn_id", "left_anti")


def orphans(statements: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that no statement speaks of any more."""
    ends = statements.select("space_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id")).distinct()
    return entities.join(ends, ["space_id", "entity_id"], "left_anti")


def move_audience(statements: DataFrame, turns: DataFrame, audience: str) -> DataFrame:
    moved = turns.select("source_turn_id").distinct().withColumn("_moved", F.lit(True))
    return statements.join(moved, "source_turn_id", "left").withColumn("audience", F.when(F.col("_moved"), F.lit(audience)).otherwise(F.col("audience"))).drop("_moved")


def merge_triples(primary: DataFrame, expanded: DataFrame, shown: DataFrame, limit: int = MERGE_LIMIT) -> DataFrame:
    """Primary then expanded statements, each once, in their own order (column ordinal); those of turns already shown as drawers (shown: source_turn_id) come last, and none is dropped for that."""
    both = primary.withColumn("_side", F.lit(0)).unionByName(expanded.withColumn("_side", F.lit(1)))
    both = both.withColumn("_n", F.row_number().over(Window.partitionBy("statement_id").orderBy("_side", "ordinal"))).where("_n = 1")
    turns = shown.select("source_turn_id").distinct().withColumn("restates", F.lit(True))
    both = both.join(turns, "source_turn_id", "left").withColumn("restates", F.coalesce("restates", F.lit(False)))
    return both.orderBy("restates", "_side", "ordinal").limit(limit).drop("_n", "_side")


def ordered(statements: DataFrame, limit: int) -> DataFrame:
    """The most relevant statements with their place (ordinal, from 1); few by their limit, so one task numbers them."""
    return statements.orderBy(*relevance()).limit(limit).withColumn("ordinal", F.row_number().over(Window.orderBy(*relevance())))


def distinct_mentions(mentions: DataFrame) -> DataFrame:
    """Upsert-ignore of aliases: of equal (space, audience, entity, alias), trimmed and in lower case, the first recorded stays; empty ones go."""
    rows = mentions.withColumn("alias", F.lower(F.trim("alias"))).where("alias <> '' and entity_id <> ''")
    rows = rows.withColumn("mention_id", F.concat_ws(":", "audience", "entity_id", "alias"))
    first = Window.partitionBy("space_id", "mention_id").orderBy("recorded_at", "confidence")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def probes(asked: DataFrame, statements: DataFrame) -> DataFrame:
    """asked (space_id, subject_id, predicate, object_id, audience) with whether the statement is known, is open, and was once closed."""
    key = ["space_id", "subject_id", "predicate", "object_id", "audience"]
    seen = statements.groupBy(*key).agg(F.count_if(F.col("valid_to").isNull()).alias("_open"), F.count_if(F.col("valid_to").isNotNull()).alias("_closed"))
    has = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    out = asked.join(seen, key, "left")
    return out.select(*asked.columns, F.col("_open").isNotNull().alias("known"), has("_open").alias("open"), has("_closed").alias("closed"))


def seeded(hints: list[str], matched: DataFrame, most: int = 3) -> DataFrame:
    """phrase_id, name and place of the entities that a recall starts from: hints first, then those that the phrase matches, each once."""
    matched = written(matched, "matched")
    asked = matched.select("phrase_id").distinct().select("phrase_id", F.posexplode(F.array(*map(F.lit, hints)).cast("array<string>")).alias("_at", "name"))
    both = asked.withColumn("_side", F.lit(0)).unionByName(matched.select("phrase_id", F.col("rank").alias("_at"), "name").withColumn("_side", F.lit(1)))
    best = both.groupBy("phrase_id", "name").agg(F.min(F.struct("_side", "_at")).alias("_best"))
    place = F.row_number().over(Window.partitionBy("phrase_id").orderBy("_best", "name"))
    return best.select("phrase_id", "name", place.alias("place")).where(F.col("place") <= most)


def rewritten(phrases: DataFrame, aliases: DataFrame, facts: DataFrame) -> DataFrame:
    """phrase_id and query: the phrase, with the name of its one sure alias if that is not in it and has a fact (space_id, name) that can be seen.

    aliases: phrase_id, name and rank of sure aliases, at least two where there are several.
    """
    one = aliases.groupBy("phrase_id").agg(F.count("*").alias("_n"), F.min("name").alias("name")).where("_n = 1").drop("_n")
    rows = phrases.join(one, "phrase_id", "left").join(facts.select("space_id", "name").distinct().withColumn("_fact", F.lit(True)), ["space_id", "name"], "left")
    carry = F.col("_fact") & ~F.contains("phrase", "name")
    return rows.select("phrase_id", F.when(F.coalesce(carry, F.lit(False)), F.concat_ws(" ", "phrase", "name")).otherwise(F.col("phrase")).alias("query"))
