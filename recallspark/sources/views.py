"""The memory data model over the star-schema tables: statements, entities, mentions, drawers, commitments, command events.

Every view is a lazy DataFrame over Parquet, so filters and column choices of the operators reach the scans. Times without a
zone stay without one; `iso` writes them as the ISO-8601 text of the wire format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: wing ids, and the predicate that each event type stands for
WINGS = ["Wing_Profile", "Wing_Interaction", "Wing_Relationship", "Wing_Emotion", "Wing_Future", "Wing_Event", "Wing_Work", "Wing_Life", "Wing_Health", "Wing_Privacy", "Wing_Theme"]
MEMORY_TYPES = ["profile", "interaction", "relationship", "emotion", "goal", "event", "work", "preference", "health", "privacy", "theme"]
PREDICATES = {"view": "likes", "click": "uses", "purchase": "owns", "signup": "works_at", "error": "has_symptom"}
SENSITIVE = ["has_symptom"]
#: Lines of orders that a task holds.
LINES = 500_000


def iso(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def text_of(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def choose(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bi-temporal statements; one predicate of one subject ends where its next statement begins, some have no start."""
    e = load(spark, sf_dir, "events")
    then = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    predicate = F.create_map(*(F.lit(x) for kv in PREDICATES.items() for x in kv))[F.col("event_type")]
    n = F.col("event_id")
    return e.select(
        text_of("stmt_", n).alias("statement_id"),
        text_of("space_", F.col("user_id") % 4).alias("space_id"),
        text_of("user:", F.col("user_id")).alias("subject_id"),
        predicate.alias("predicate"),
        text_of("item:", F.regexp_extract("props", "[0-9]+", 0)).alias("object_id"),
        F.when(n % 3 == 0, F.lit("owner")).otherwise(text_of("companion:c", n % 2)).alias("audience"),
        F.when(n % 50 != 0, F.col("ts")).alias("valid_from"),
        F.lead("ts").over(then).alias("valid_to"),
        F.col("ts").alias("recorded_at"),
        ((n % 10).cast("double") / 10).alias("confidence"),
        predicate.isin(SENSITIVE).alias("sensitive"),
        text_of("turn_", n % 500).alias("source_turn_id"),
        F.when(n % 40 == 0, text_of("fact_", n % 400)).alias("projection_id"),
    )


def spaces(rows: DataFrame) -> DataFrame:
    """The rows once for each of the four spaces."""
    return rows.withColumn("space_id", F.explode(F.array(*(F.lit(f"space_{k}") for k in range(4)))))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """space_id, entity_id and name of everything a statement speaks of, and of all nations (in every space)."""
    s = load(spark, sf_dir, "events")
    space = text_of("space_", F.col("user_id") % 4).alias("space_id")
    users = s.select(space, text_of("user:", F.col("user_id")).alias("entity_id"))
    items = s.select(space, text_of("item:", F.regexp_extract("props", "[0-9]+", 0)).alias("entity_id"))
    told = users.unionByName(items).distinct().withColumn("name", F.col("entity_id"))
    nations = load(spark, sf_dir, "nation").select(text_of("nation:", F.col("n_nationkey")).alias("entity_id"), F.lower("n_name").alias("name"))
    return told.unionByName(spaces(nations))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of nations by space and audience, with how sure they are."""
    n = load(spark, sf_dir, "nation")
    sure = F.element_at(F.array(F.lit(0.95), F.lit(0.85), F.lit(0.7)), (F.col("n_nationkey") % 3).cast("int") + 1)
    audience = F.when(F.col("n_nationkey") % 5 == 4, F.lit("companion:c1")).otherwise(F.lit("owner"))
    return spaces(n.select(text_of("nation:", F.col("n_nationkey")).alias("entity_id"), F.concat(F.lit("land "), F.substring(F.lower("n_name"), 1, 4)).alias("alias"), sure.alias("confidence"), audience.alias("audience")))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers say in their space: a nation by name or by alias (in capitals), and a user."""
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise(F.concat(F.lit("LAND "), F.substring("n_name", 1, 4)))
    return c.select(F.col("c_custkey").alias("phrase_id"), text_of("space_", F.col("c_custkey") % 4).alias("space_id"), text_of("moved to ", place, " near user:", F.col("c_custkey") % 40).alias("phrase"))


def drawers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory records with their vectors (null where there is none) and visibility metadata, some undated or without an audience."""
    d, v = load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings")
    n = F.col("doc_id")
    hours = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (n % 2000).cast("int"))
    return d.join(v, n == F.col("vec_id"), "left").select(
        n.alias("drawer_id"),
        text_of("space_", n % 2).alias("space_id"),
        choose(F.substring("source", 4, 9).cast("int") % 11, WINGS).alias("wing"),
        F.col("lang").alias("room"),
        F.col("source").alias("source_file"),
        "text",
        "embedding",
        F.when(n % 7 != 0, choose(n % 3, ["owner", "companion:c0", "companion:c1"])).alias("audience"),
        choose(n % 5, ["all_devices", "all_devices", "current_device", "private", "all_devices"]).alias("visibility"),
        choose(n % 6, ["persona", "global", "device", "agent", "session", "other"]).alias("scope"),
        choose(n % 4, ["personal", "household", "personal", "personal"]).alias("layer"),
        F.when(n % 17 == 0, F.lit("do_not_recall")).when(n % 11 == 0, F.lit("private")).otherwise(F.lit("normal")).alias("privacy"),
        F.when(n % 6 == 4, text_of("session_", n % 3)).alias("session_id"),
        F.when(n % 9 == 0, text_of("person_", n % 2)).alias("person_id"),
        text_of("device_", n % 4).alias("source_device_id"),
        F.when(n % 8 == 0, text_of("device_", (n + 1) % 4)).otherwise(F.lit("")).alias("target_device_id"),
        text_of("turn_", n % 500).alias("source_turn_id"),
        F.when(n % 13 != 0, hours).alias("memory_time"),
        choose(F.substring("source", 4, 9).cast("int") % 11, MEMORY_TYPES).alias("memory_type"),
        F.when(n % 23 == 0, F.lit("Archived")).alias("room_status"),
        choose(n % 10, ['{"location": {"room": "and"}}', '{"note": "plain"}', "no json", *["{}"] * 7]).alias("extensions"),
        (n % 5 + 1).cast("int").alias("importance"),
    )


def closets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of source files with their vectors; a file can have several."""
    d, v = load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings")
    return d.where("doc_id % 3 = 1").join(v, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("drawer_id"), F.col("source").alias("source_file"), "embedding")


def command_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status notifications of requests, in order of seq."""
    e = load(spark, sf_dir, "events")
    status = F.create_map(*(F.lit(x) for kv in (("view", "accepted"), ("click", "retrying"), ("purchase", "applied"), ("signup", "failed"), ("error", "failed")) for x in kv))[F.col("event_type")]
    return e.select(text_of("req_", F.col("user_id"), "_", F.col("event_id") % 20).alias("request_id"), F.col("event_id").alias("seq"), status.alias("status"), "ts")


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("event_type in ('error', 'signup')")
    return e.select(F.col("event_id").alias("entry_id"), text_of("space_", F.col("user_id") % 4).alias("space_id"), choose(F.col("event_id") % 4, ["pending", "claimed", "resolved", "pending"]).alias("state"), F.octet_length("props").cast("long").alias("payload_bytes"), F.col("ts").alias("created_at"))


def sync_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device sync deliveries: the same event or the same idempotency hash may arrive several times."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), text_of("ev_", F.col("event_id") % 4000).alias("event_id"), F.sha2(text_of(F.col("user_id"), ":", F.col("props")), 256).alias("idempotency_hash"), "ts")


def commitment_events(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """An intent per line of an order: its status, participant and due date, in order of revision; more: further columns of the lines.

    Orders and lines are dealt by order into as many tasks as lines ask for, so what a task holds does not grow with the tables. What is
    grouped by commitment later stays where it is.
    """
    o, i = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-i.count() // LINES))
    o, i = o.repartition(tasks, "o_orderkey"), i.repartition(tasks, "l_orderkey")
    status = F.when(F.col("l_linestatus") == "F", choose(F.col("l_linenumber") % 3, ["confirmed", "fulfilled", "cancelled"])).otherwise(choose(F.col("l_linenumber") % 2, ["proposed", "confirmed"]))
    return i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("commitment_id"),
        text_of("customer:", F.col("o_custkey")).alias("promisor"),
        F.struct(F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).alias("place"),
        status.alias("status"),
        text_of("supplier:", F.col("l_suppkey")).alias("participant"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_shipdate")).alias("due_at"),
        *(c.alias(name) for name, c in more.items()),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's reply that follows."""
    c = load(spark, sf_dir, "conversations").where("role <> 'system'")
    then = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("next_role", F.lead("role").over(then)).withColumn("next_text", F.lead("text").over(then))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_text"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("assistant_text"))


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents on canonical facts, in order of seq, with whether their projections are done."""
    e = load(spark, sf_dir, "events")
    n = F.col("event_id")
    kind = F.when(F.col("event_type").isin("view", "click"), "add").when(F.col("event_type") == "purchase", "invalidate").when(F.col("event_type") == "signup", "reactivate").when(n % 20 == 0, "forget").otherwise("add")
    result = F.when(F.col("event_type") == "purchase", choose(n % 2, ["invalidated", "superseded"])).when(kind == "forget", choose(F.floor(n / 20) % 2, ["hard", "soft"]))
    states = ["projected", "pending", "not_required"]
    return e.select(
        text_of("fact_", F.col("user_id"), "_", n % 10).alias("fact_id"), text_of("slot_", F.col("user_id")).alias("slot"), n.alias("seq"), kind.alias("kind"), result.alias("result"),
        text_of("intent_", n % 3000).alias("intent_id"), text_of("turn_", n % 500).alias("source"), (n % 7 != 0).alias("applied"), choose(n % 3, states).alias("drawer"), choose(F.floor(n / 3) % 3, states).alias("kg"), "ts",
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an extractor proposes for turns: fragments, statements, invalidations and privacy actions, with the text they quote."""
    e = load(spark, sf_dir, "events")
    n = F.col("event_id")
    named = F.create_map(*(F.lit(x) for kv in PREDICATES.items() for x in kv))[F.col("event_type")]
    return e.select(
        text_of("space_", F.col("user_id") % 4).alias("space_id"), text_of("turn_", n % 500).alias("turn_id"), choose(n % 4, ["fragment", "triple", "invalidation", "privacy"]).alias("kind"), n.alias("idx"),
        F.col("props").alias("content"), F.col("props").alias("user_text"), F.when(n % 3 == 0, F.lit("zz")).when(n % 11 == 0, F.lit(" ")).otherwise(F.substring("props", 3, 6)).alias("evidence_quote"),
        text_of("user:", F.col("user_id")).alias("subject"), F.when(n % 5 != 0, named).alias("predicate"), text_of("item:", F.regexp_extract("props", "[0-9]+", 0)).alias("object"),
        ((n % 10).cast("double") / 10).alias("confidence"), ((n % 8).cast("double") / 8).alias("fact_confidence"), (n % 5 + 1).cast("int").alias("importance"),
        choose(n % 6, ["personal", "household", "personal", "personal", "personal", "personal"]).alias("layer"), choose(n % 7, ["persona", "persona", "device", "persona", "persona", "persona", "persona"]).alias("scope"),
        choose(n % 13, ["current_device", *["all_devices"] * 12]).alias("visibility"), F.when(n % 17 == 0, F.lit("device_1")).otherwise(F.lit("")).alias("target_device_id"), choose(n % 9, ["sensitive", "private", *["normal"] * 7]).alias("privacy"),
        F.when(n % 2 == 0, F.col("ts")).alias("valid_from"), F.col("ts").alias("occurred_at"),
    )


def turn_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who speaks in each turn of a conversation: space, audience, device, layer, person."""
    c = load(spark, sf_dir, "conversations")
    k = 8 * F.col("conv_id") + F.col("turn")
    return c.select(
        text_of("turn_", k).alias("turn_id"), text_of("space_", F.col("conv_id") % 4).alias("space_id"), F.when(F.col("role") == "user", F.lit("owner")).otherwise(text_of("companion:c", F.col("conv_id") % 2)).alias("audience"), text_of("device_", F.col("conv_id") % 5).alias("device_id"),
        F.when(F.col("role") == "system", F.lit("household")).otherwise(F.lit("personal")).alias("layer"), F.when(F.char_length("text") % 8 != 0, text_of("person_", F.col("conv_id") % 3)).alias("person_id"),
    )
