"""The ledger of canonical facts: registers of evidence, invalidations, reactivations and forgets, folded without gathering a fact's history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import projection_id

INACTIVE = ["invalidated", "superseded"]


def fold(events: DataFrame) -> DataFrame:
    """The state of each fact after its events (fact_id, slot, seq, kind, result, intent_id, source, applied, drawer, kg).

    kind is add, invalidate (result: invalidated or superseded), reactivate or forget; applied says whether its projections are done.
    An intent that comes again counts once. Adds are evidence and leave the state alone; applied invalidations set it; a
    reactivation counts only on what is invalidated or superseded and is evidence too; forgotten is final. Open events are pending and change
    nothing. drawer and kg are the projection states of the last event, of a forget if there is one.
    """
    once = events.withColumn("_n", F.row_number().over(Window.partitionBy("fact_id", "kind", "intent_id").orderBy("seq"))).where("_n = 1")
    then = Window.partitionBy("fact_id").orderBy("seq")
    until = F.min(F.when(F.col("kind") == "forget", F.col("seq"))).over(Window.partitionBy("fact_id"))
    born = F.min(F.when(F.col("kind") == "add", F.col("seq"))).over(Window.partitionBy("fact_id"))
    rows = once.withColumns({"_until": until, "_born": born}).where("_born is not null and seq >= _born and (_until is null or seq <= _until)")
    # what the last applied invalidation or reactivation before an event left; a reactivation of what is active changes nothing
    turning = F.col("applied") & F.col("kind").isin("invalidate", "reactivate")
    before = F.last(F.when(turning, F.when(F.col("kind") == "invalidate", F.col("result")).otherwise(F.lit("active"))), ignorenulls=True).over(then.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.coalesce(before, F.lit("active"))).withColumn("_counts", (F.col("kind") != "reactivate") | F.col("_before").isin(INACTIVE))
    kind, counts = F.col("kind"), F.col("_counts")
    state = F.struct("seq", F.when(kind == "invalidate", F.col("result")).otherwise(F.lit("active")).alias("state"))
    count = lambda test: F.count_if(counts & test)
    invalid, superseded = ((kind == "invalidate") & (F.col("result") == r) for r in INACTIVE)
    back = kind == "reactivate"
    out = rows.groupBy("fact_id", "slot").agg(
        F.max(F.when(turning & counts, state)).alias("_state"),
        F.max(kind == "forget").alias("_forgotten"),
        count(kind.isin("add", "reactivate")).alias("evidence"),
        (1 + count(back & F.col("applied"))).alias("activations"),
        count(invalid & F.col("applied")).alias("invalidations"),
        count(superseded & F.col("applied")).alias("supersessions"),
        count(back & F.col("applied")).alias("reactivations"),
        count(invalid & ~F.col("applied")).alias("invalidations_pending"),
        count(superseded & ~F.col("applied")).alias("supersessions_pending"),
        count(back & ~F.col("applied")).alias("reactivations_pending"),
        F.count_if(~counts).alias("rejected"),
        F.max_by("drawer", "seq").alias("drawer"),
        F.max_by("kg", "seq").alias("kg"),
        F.max("ts").alias("updated_at"),
    )
    out = out.withColumn("state", F.when(F.col("_forgotten"), F.lit("forgotten")).otherwise(F.coalesce("_state.state", F.lit("active")))).drop("_state", "_forgotten")
    return out.withColumn("projection_id", projection_id(F.col("fact_id"), F.col("activations")))


def stats(facts: DataFrame) -> DataFrame:
    """The ledger in one row: facts by state, events by kind and whether applied, projections of active and forgotten facts, and when the last fact was done with."""
    state, total = F.col("state"), lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total")
    active, done = state == "active", F.col("drawer").isin("projected", "not_required") & F.col("kg").isin("projected", "not_required")
    projected = lambda c, s: F.count_if(active & (F.col(c) == s))
    gone = state == "forgotten"
    return facts.agg(
        F.count("*").alias("assertions_total"),
        *(F.count_if(state == s).alias(f"assertions_{s}") for s in ("active", *INACTIVE, "forgotten")),
        total("evidence"), total("invalidations"), total("supersessions"), total("reactivations"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("reactivations_pending", "invalidations_pending", "supersessions_pending")),
        (F.count_if(gone & (F.col("drawer") == "pending")) + F.count_if(gone & (F.col("kg") == "pending"))).alias("forget_projections_pending"),
        projected("drawer", "pending").alias("drawer_not_projected"), projected("drawer", "projected").alias("drawer_projected"),
        projected("kg", "pending").alias("kg_not_projected"), projected("kg", "projected").alias("kg_projected"),
        F.max(F.when(done, F.col("updated_at"))).alias("last_materialized_at"),
    )


def history(events: DataFrame, facts: int, each: int) -> DataFrame:
    """The last events of the last facts of each slot, oldest first, with whether either was cut."""
    by_fact = events.groupBy("slot", "fact_id").agg(F.max("seq").alias("_last"), F.count("*").alias("_events"))
    by_fact = by_fact.withColumn("_place", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("_last"), "fact_id"))).withColumn("_facts", F.count("*").over(Window.partitionBy("slot")))
    kept = by_fact.where(F.col("_place") <= facts).select("slot", "fact_id", (F.col("_facts") > facts).alias("facts_capped"), (F.col("_events") > each).alias("events_capped"))
    rows = events.join(kept, ["slot", "fact_id"]).withColumn("_n", F.row_number().over(Window.partitionBy("slot", "fact_id").orderBy(F.desc("seq")))).where(F.col("_n") <= each)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("slot", "fact_id").orderBy("seq"))).drop("_n")


def sources_of_forgotten(events: DataFrame) -> DataFrame:
    """fact_id and source of all evidence, invalidations and reactivations of facts that were forgotten for good (result: hard), each once."""
    hard = events.where("kind = 'forget' and result = 'hard'").select("fact_id").distinct()
    parts = [events.where(F.col("kind") == k).select("fact_id", "source") for k in ("add", "invalidate", "reactivate")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("source is not null").distinct()
    return every.join(hard, "fact_id", "left_semi")


def scrubbed(events: DataFrame) -> DataFrame:
    """Events as they are kept after hard forgets: only the tombstones of such facts remain."""
    hard = events.where("kind = 'forget' and result = 'hard'").select("fact_id").distinct().withColumn("_hard", F.lit(True))
    rows = events.join(hard, "fact_id", "left")
    return rows.where(F.col("_hard").isNull() | (F.col("kind") == "forget")).drop("_hard")


def exact_invalidation(asked: DataFrame, statements: DataFrame, drawers: DataFrame, facts: DataFrame) -> DataFrame:
    """What an exact invalidation meets in each store: open statements, drawers of their turns, and active facts, by request (space_id, subject_id, predicate, object_id, audience, fact_id)."""
    key = ["space_id", "subject_id", "predicate", "object_id", "audience"]
    hits = asked.join(statements.where("valid_to is null").select(*key, "statement_id", "source_turn_id"), key, "left")
    graph = hits.groupBy(*key, "fact_id").agg(F.count_distinct("statement_id").alias("statements"))
    of_turn = drawers.groupBy("space_id", "source_turn_id").agg(F.count("*").alias("_drawers"))
    found = hits.select(*key, "source_turn_id").distinct().join(of_turn, ["space_id", "source_turn_id"]).groupBy(*key).agg(F.sum("_drawers").alias("drawers"))
    live = facts.where("state = 'active'").groupBy("fact_id").agg(F.count("*").alias("facts"))
    out = graph.join(found, key, "left").join(live, "fact_id", "left")
    return out.withColumns({"drawers": F.coalesce("drawers", F.lit(0)), "facts": F.coalesce("facts", F.lit(0))})


SLOT = ["space_id", "audience", "subject_id", "predicate"]


def registered(events: DataFrame) -> DataFrame:
    """The outcome of each event (SLOT, object_id, seq, op, intent_id, payload, single) of a slot, in order of seq: outcome and evidence (of the object, after it).

    op register: forgotten facts stay so; a slot that holds a single value refuses another while one is active (slot conflict); an intent that
    comes again must bring the same object and payload (replay, else evidence conflict); an inactive fact takes no new evidence; else the fact is created
    or gets evidence. op invalidate ends an active fact, op forget ends a known one for good; both do nothing (none) where there is none. Refused events
    change nothing. Slots are dealt by key and read in order, an event at a time; an intent belongs to the slot that names it.
    """
    kinds = dict(events.dtypes)
    columns = [*SLOT, "object_id", "seq", "op", "intent_id", "payload", "single"]

    def run(batches):
        slot, facts, intents, evidence = None, {}, {}, {}
        for pdf in batches:
            out, counts = [], []
            for r in pdf.itertuples(index=False):
                if (r.space_id, r.audience, r.subject_id, r.predicate) != slot:
                    slot, facts, intents, evidence = (r.space_id, r.audience, r.subject_id, r.predicate), {}, {}, {}
                state, said = facts.get(r.object_id), (r.object_id, r.payload)
                if r.op == "register":
                    if state == "forgotten":
                        result = "forgotten"
                    elif state is None and r.single and "active" in facts.values():
                        result = "slot conflict"
                    elif r.intent_id in intents:
                        result = "replay" if intents[r.intent_id] == said else "evidence conflict"
                    elif state == "inactive":
                        result = "inactive"
                    else:
                        result = "evidence" if state else "created"
                        facts[r.object_id], intents[r.intent_id] = "active", said
                        evidence[r.object_id] = evidence.get(r.object_id, 0) + 1
                elif r.op == "invalidate":
                    result = "invalidated" if state == "active" else "none"
                    if state == "active":
                        facts[r.object_id] = "inactive"
                else:
                    result = "erased" if state in ("active", "inactive") else "none"
                    if result == "erased":
                        facts[r.object_id] = "forgotten"
                out.append(result)
                counts.append(evidence.get(r.object_id, 0))
            yield pdf[[*SLOT, "object_id", "seq", "op"]].assign(outcome=out, evidence=counts)

    kind = ", ".join([*(f"{c} {kinds[c]}" for c in [*SLOT, "object_id", "seq", "op"]), "outcome string, evidence long"])
    return events.select(*columns).repartition(*SLOT).sortWithinPartitions(*SLOT, "seq").mapInPandas(run, kind)


TARGETS = ["drawer", "kg"]


def fold_forgets(events: DataFrame, key: str) -> DataFrame:
    """key, hard, reason, drawer and kg (pending, projected or not_required), blocks and done of what was forgotten, from events (key, seq, op, hard, reason, targets) of facts or commitments.

    op begin: forgetting is hard once any request is; the reason is the first one's, or the first hard one's where that came later. A target is pending
    from the first request that names it until a mark (op mark, targets) after that; later requests do not open it again, and marks without a request mean
    nothing. blocks: whoever comes again under the key is refused, from the first request on. done: nothing is pending, so evidence may be scrubbed. All of it is minima with partial sums.
    """
    begin, mark = F.col("op") == "begin", F.col("op") == "mark"
    names = lambda t: F.array_contains("targets", t)
    first = events.groupBy(key).agg(
        F.max(F.when(begin, F.col("hard"))).alias("hard"), F.min(F.when(begin, F.struct("seq", "hard", "reason"))).alias("_first"), F.min(F.when(begin & F.col("hard"), F.struct("seq", "reason"))).alias("_hard"),
        *(F.min(F.when(begin & names(t), F.col("seq"))).alias(f"_asked_{t}") for t in TARGETS), *(F.max(F.when(mark & names(t), F.col("seq"))).alias(f"_marked_{t}") for t in TARGETS),
    ).where("_first is not null")
    state = lambda t: F.when(F.col(f"_asked_{t}").isNull(), "not_required").when(F.coalesce(F.col(f"_marked_{t}") > F.col(f"_asked_{t}"), F.lit(False)), "projected").otherwise("pending")
    out = first.select(key, "hard", F.coalesce("_hard.reason", "_first.reason").alias("reason"), *(state(t).alias(t) for t in TARGETS), F.lit(True).alias("blocks"))
    return out.withColumn("done", (F.col("drawer") != "pending") & (F.col("kg") != "pending"))
