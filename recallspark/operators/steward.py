"""Validation of what an extractor proposes, and its translation into intents.

Claims (one row each: space_id, turn_id, kind, idx and the fields below) are checked in columns, so rejects keep their reason and nothing is
dropped unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: fragments a turn may have, their least importance, the least confidence of a statement
FRAGMENTS, IMPORTANCE, CONFIDENCE = 6, 3, 0.6
# fixed values: predicates by the intent they state; the rest state a fact
INTENTS = {"preference": ["likes", "dislikes", "prefers"], "commitment": ["promised", "committed_to", "planned_to"], "episode": ["attended", "experienced", "achieved"]}
# fixed values: predicates that hold one value, those whose value may be replaced by saying so, and sensitive ones
SINGLE, REPLACEABLE, SENSITIVE = ["lives_in", "born_in"], ["lives_in"], ["has_symptom", "takes_medication", "has_health_condition"]


def verbatim(claims: DataFrame) -> DataFrame:
    """claims with fault: null, or why the quoted evidence is none; it has to stand in the user's text as it is."""
    quote = F.trim(F.coalesce("evidence_quote", F.lit("")))
    fault = F.when(quote == "", F.lit("missing")).when(~F.coalesce(F.contains("user_text", quote), F.lit(False)), F.lit("not verbatim"))
    return claims.withColumn("fault", fault)


def fragment_budget(fragments: DataFrame, most: int = FRAGMENTS, least: int = IMPORTANCE) -> DataFrame:
    """turn_id with how many fragments were proposed, cut by the cap, dropped as unimportant, and written; the cap comes first, in order of idx."""
    place = Window.partitionBy("turn_id").orderBy("idx")
    rows = fragments.withColumn("_n", F.row_number().over(place))
    inside, weighty = F.col("_n") <= most, F.coalesce(F.col("importance") >= least, F.lit(False))
    return rows.groupBy("turn_id").agg(F.count("*").alias("proposed"), F.count_if(~inside).alias("cut"), F.count_if(inside & ~weighty).alias("dropped"), F.count_if(inside & weighty).alias("written"))


def layer_split(claims: DataFrame) -> DataFrame:
    """What each layer's space gets: personal claims as they are, of household ones only fragments."""
    household = F.coalesce(F.col("layer") == "household", F.lit(False))
    return claims.where(~household | (F.col("kind") == "fragment")).withColumn("target", F.when(household, "household").otherwise("personal"))


def guarded_mentions(mentions: DataFrame, triples: DataFrame) -> DataFrame:
    """Mentions of entities that a statement of the same turn speaks of."""
    named = triples.select("turn_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id")).distinct()
    return mentions.join(named, ["turn_id", "entity_id"], "left_semi")


def split_claims(claims: DataFrame, graph: bool = True) -> DataFrame:
    """claims with becomes: a fragment (no statement, a household fact, no graph), a triple, or a reject with its reason.

    A statement is for all devices of the persona alone; a sensitive claim needs a sensitive predicate. A triple is as sure as
    the less sure of claim and statement, and starts when the claim occurred if it says nothing itself.
    """
    text = F.col("predicate").isNull() | F.lit(not graph) | F.coalesce(F.col("layer") == "household", F.lit(False))
    narrow = (F.col("scope") != "persona") | (F.col("visibility") != "all_devices") | (F.coalesce("target_device_id", F.lit("")) != "")
    reason = F.when(~text & narrow, F.lit("restricted scope")).when(~text & (F.col("privacy") == "sensitive") & ~F.col("predicate").isin(SENSITIVE), F.lit("sensitive claim"))
    becomes = F.when(text, F.lit("fragment")).when(reason.isNotNull(), F.lit("reject")).otherwise(F.lit("triple"))
    sure = F.when(becomes == "triple", F.least("confidence", "fact_confidence")).otherwise(F.col("confidence"))
    return claims.withColumns({"becomes": becomes, "reason": reason, "sure": sure, "starts": F.coalesce("valid_from", "occurred_at")})


def intent_of(predicate: Column) -> Column:
    out = F.lit("fact")
    for kind, some in INTENTS.items():
        out = F.when(predicate.isin(some), F.lit(kind)).otherwise(out)
    return out


def intent_id(space: Column, turn: Column, kind: Column, index: Column, payload: Column) -> Column:
    """A name for an intent that replays share: a hash of where it comes from and what it says."""
    body = F.concat_ws("|", space, turn, kind, index.cast("string"), payload)
    return F.concat(F.lit("intent:"), F.substring(F.sha2(body, 256), 1, 32))


def intents(claims: DataFrame) -> DataFrame:
    """One intent for each fragment, triple, invalidation and privacy action (columns kind, idx, content, subject, predicate, object, confidence)."""
    kind = F.col("kind")
    said = F.concat_ws(" ", "subject", "predicate", "object")
    claim = F.when(kind == "fragment", F.col("content")).when(kind == "triple", F.coalesce("content", said))
    claim = claim.when(kind == "invalidation", F.concat(F.lit("invalidate "), said)).otherwise(F.concat_ws(": ", "predicate", "content"))
    form = F.when(kind == "triple", intent_of(F.col("predicate"))).when(kind == "invalidation", F.lit("correction")).when(kind == "privacy", F.lit("forget")).otherwise(F.lit("fact"))
    return claims.select(
        intent_id(F.col("space_id"), F.col("turn_id"), kind, F.col("idx"), claim).alias("intent_id"), "space_id", "turn_id", "kind", "idx",
        form.alias("intent_type"), F.when(kind.isin("fragment", "triple"), F.lit("add")).otherwise(F.lit("invalidate")).alias("operation"), claim.alias("raw_claim"),
        F.when(kind == "fragment", F.lit("$text")).when(kind != "privacy", F.col("subject")).alias("subject"),
        F.when(kind == "fragment", F.lit("remembers_text")).when(kind != "privacy", F.col("predicate")).alias("predicate"),
        F.when(kind == "fragment", F.col("content")).when(kind != "privacy", F.col("object")).alias("object"),
        F.when(kind.isin("fragment", "triple"), F.col("confidence")).otherwise(F.lit(1.0)).alias("confidence"),
    )


def stamped(fragments: DataFrame, turns: DataFrame) -> DataFrame:
    """Fragments with the identity of their turn (space, audience, device); what is private for a narrow audience is normal there; device scope means the turn's device."""
    who = turns.select("turn_id", F.col("space_id").alias("_space"), F.col("audience").alias("_audience"), F.col("device_id").alias("_device"))
    rows = fragments.join(who, "turn_id", "left")
    narrow = (F.col("privacy") == "private") & F.coalesce(F.col("_audience") != "owner", F.lit(False))
    here = (F.col("scope") == "device") & (F.coalesce("target_device_id", F.lit("")) == "")
    return rows.withColumns({
        "space_id": F.col("_space"), "audience": F.coalesce("_audience", F.lit("owner")), "source_device_id": F.col("_device"),
        "privacy": F.when(narrow, F.lit("normal")).otherwise(F.col("privacy")), "target_device_id": F.when(here, F.col("_device")).otherwise(F.col("target_device_id")),
    }).drop("_space", "_audience", "_device")


def plan_updates(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """asked (slot, predicate, object) with plan: noop, reactivate, supersede, supersede and reactivate, or reject, against the facts (slot, object, state).

    An active equal fact needs nothing. An inactive equal one comes back; where a slot holds one value and may be replaced, its
    other value ends first. Without an equal fact only such slots can be updated. Several active values are a conflict.
    """
    own = facts.groupBy("slot", "object").agg(F.max(F.col("state") == "active").alias("_active"), F.max(F.col("state").isin("invalidated", "superseded")).alias("_inactive"))
    live = facts.where("state = 'active'").groupBy("slot").agg(F.count("*").alias("_live"))
    rows = asked.join(own, ["slot", "object"], "left").join(live, "slot", "left")
    live_n, exact = F.coalesce("_live", F.lit(0)), F.coalesce("_inactive", F.lit(False))
    one, may = F.col("predicate").isin(SINGLE), F.col("predicate").isin(REPLACEABLE)
    plan = F.when(F.coalesce("_active", F.lit(False)), F.lit("noop"))
    plan = plan.when(exact & ~one, F.lit("reactivate")).when(exact & one & (live_n == 0), F.lit("reactivate"))
    plan = plan.when(exact & may & (live_n == 1), F.lit("supersede and reactivate")).when(~exact & may & (live_n <= 1), F.when(live_n == 1, F.lit("supersede")).otherwise(F.lit("add")))
    return rows.withColumn("plan", plan.otherwise(F.lit("reject"))).drop("_active", "_inactive", "_live")


def routed(turns: DataFrame, space: str, layer: str) -> DataFrame:
    """turns with route: process, skip (another space's), or dead (a wrong layer, or no identity)."""
    other = F.coalesce(F.col("space_id") != space, F.lit(True))
    wrong = F.coalesce(F.col("layer") != layer, F.lit(True))
    nobody = F.coalesce(F.trim("person_id") == "", F.lit(True))
    return turns.withColumn("route", F.when(other, F.lit("skip")).when(wrong | nobody, F.lit("dead")).otherwise(F.lit("process")))
