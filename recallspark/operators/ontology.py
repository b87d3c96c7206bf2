"""What each predicate means to the memory: its wing and type, whether a subject holds one value of it, how it is updated, whether it is sensitive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: predicates by the wing and memory type that their facts belong to
WINGS = {
    ("Wing_Relationship", "relationship"): ["child_of", "parent_of", "partner_of", "sibling_of", "friend_of"],
    ("Wing_Work", "work"): ["colleague_of", "works_at", "studies_at", "holds_role"],
    ("Wing_Profile", "profile"): ["lives_in", "born_in"],
    ("Wing_Life", "preference"): ["likes", "dislikes", "prefers"],
    ("Wing_Life", "life"): ["does", "practices", "owns", "uses"],
    ("Wing_Future", "commitment"): ["promised", "committed_to", "planned_to"],
    ("Wing_Emotion", "emotion"): ["has_state", "has_emotion", "has_concern", "worried_about", "struggles_with"],
    ("Wing_Health", "health"): ["has_health_condition", "takes_medication", "has_symptom"],
    ("Wing_Event", "event"): ["attended", "experienced", "achieved"],
}
# fixed values: predicates that differ from the rest (many values, durable, changed by exact statements only, a fact)
SINGLE = {"lives_in": "supersede_explicit", "born_in": "require_correction"}
CURRENT = ["lives_in", "has_state", "has_emotion", "has_symptom", "takes_medication"]
EVENTS = ["attended", "experienced", "achieved"]
SENSITIVE = ["has_symptom", "takes_medication", "has_health_condition"]
INTENTS = {"preference": "preference", "commitment": "commitment", "event": "episode"}


def registry(spark: SparkSession) -> DataFrame:
    """predicate, wing, memory_type, single, temporality, update_policy, sensitive and intent_type of the 32 predicates."""
    rows = [
        (p, wing, kind, p in SINGLE, "event" if p in EVENTS else "current_state" if p in CURRENT else "durable", SINGLE.get(p, "exact_only"), p in SENSITIVE, INTENTS.get(kind, "fact"))
        for (wing, kind), predicates in WINGS.items()
        for p in predicates
    ]
    return spark.createDataFrame(rows, "predicate string, wing string, memory_type string, single boolean, temporality string, update_policy string, sensitive boolean, intent_type string")


def placed(intents: DataFrame) -> DataFrame:
    """intents (subject, predicate, object, wing and memory_type as asked for) with to_wing and to_type, where the fact belongs, or error.

    A whole triple goes where its predicate belongs: an unknown predicate, and a wing or type that says otherwise (but for blank and `auto`), are
    errors. What is no triple has no meaning to go by and must name both.
    """
    r = registry(intents.sparkSession).select(F.col("predicate").alias("_predicate"), F.col("wing").alias("_wing"), F.col("memory_type").alias("_type"))
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    triple = (F.coalesce("subject", F.lit("")) != "") & (F.coalesce("predicate", F.lit("")) != "") & (F.coalesce("object", F.lit("")) != "")
    rows = intents.join(F.broadcast(r), F.col("predicate") == F.col("_predicate"), "left").withColumn("_triple", triple)  # 32 rows
    open_wing, open_type = said("wing").isin("", "auto"), said("memory_type").isin("", "auto")
    error = F.when(F.col("_triple") & F.col("_wing").isNull(), "unsupported predicate").when(F.col("_triple") & ~open_wing & (said("wing") != F.col("_wing")), "wing conflicts")
    error = error.when(F.col("_triple") & ~open_type & (said("memory_type") != F.col("_type")), "type conflicts").when(~F.col("_triple") & (open_wing | open_type), "needs wing and type")
    rows = rows.withColumn("error", error)
    to = lambda own, asked: F.when(F.col("error").isNull(), F.when(F.col("_triple"), F.col(own)).otherwise(said(asked)))
    return rows.withColumns({"to_wing": to("_wing", "wing"), "to_type": to("_type", "memory_type")}).drop("_predicate", "_wing", "_type", "_triple")
