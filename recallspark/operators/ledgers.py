"""Event-sourced ledgers: deterministic folds of append-only events into current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: which status of a commitment may follow which
TRANSITIONS = {
    "proposed": ["proposed", "confirmed", "cancelled", "superseded"],
    "confirmed": ["confirmed", "fulfilled", "cancelled", "superseded"],
    "fulfilled": ["fulfilled"],
    "cancelled": ["cancelled"],
    "superseded": ["superseded"],
}
#: Entries and bytes that provisional sources may hold.
PROVISIONAL_ROWS, PROVISIONAL_BYTES = 5, 32 << 10


def status_after(state: Column, incoming: Column) -> Column:
    """applied is final; failed yields to applied only; a late accepted changes nothing that has begun."""
    done = (state == "applied") | ((state == "failed") & (incoming != "applied")) | ((incoming == "accepted") & (state != "accepted"))
    return F.when(state.isNotNull() & done, state).otherwise(incoming)


def command_status(events: DataFrame) -> DataFrame:
    """request_id, status and attempts after all notifications, in order of seq.

    The state needs no ordered fold: an applied notification ends all; before it, the first failed one does; else the last
    that isn't accepted stands. So this is one aggregation with partial sums, whatever the length of a request's history.
    """
    at = lambda s: F.min(F.when(F.col("status") == s, F.col("seq")))
    begun = F.when(F.col("status") != "accepted", F.struct("seq", "status"))
    ends = events.groupBy("request_id").agg(at("applied").alias("applied"), at("failed").alias("failed"), F.max(begun).alias("last"))
    open_until = F.least(F.col("applied"), F.col("failed"))
    keyed = events.join(ends.select("request_id", open_until.alias("until"), "applied"), "request_id")
    counts = (F.col("status") != "accepted") & (F.col("until").isNull() | (F.col("seq") <= F.col("until")) | (F.col("seq") == F.col("applied")))
    tries = keyed.groupBy("request_id").agg(F.count_if(counts).alias("attempts"))
    status = F.when(F.col("applied").isNotNull(), F.lit("applied")).when(F.col("failed").isNotNull(), F.lit("failed")).otherwise(F.coalesce("last.status", F.lit("accepted")))
    return ends.select("request_id", status.alias("status")).join(tries, "request_id")


def dead_letter_stats(entries: DataFrame) -> DataFrame:
    return entries.groupBy("state").agg(F.count("*").alias("entries"), F.sum("payload_bytes").alias("bytes"), F.min(F.when(F.col("state") != "resolved", F.col("created_at"))).alias("oldest"))


def dead_letter_page(entries: DataFrame, state: str, limit: int, offset: int = 0) -> DataFrame:
    return entries.where(F.col("state") == state).orderBy(F.desc("created_at"), F.desc("entry_id")).offset(offset).limit(limit)


def first_deliveries(events: DataFrame) -> DataFrame:
    """Deliveries that neither repeat an event id nor an idempotency hash of an earlier delivery of another event."""
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    once = events.withColumn("_n", first("event_id")).where("_n = 1")
    return once.withColumn("_n", first("idempotency_hash")).where("_n = 1").drop("_n")


def first_decisions(decisions: DataFrame) -> DataFrame:
    """Put-if-absent by (turn_id, version): the first decision stands; conflicts counts later ones on another input."""
    key = ["turn_id", "version"]
    first = decisions.groupBy(*key).agg(F.min(F.struct("seq", "input_hash")).alias("kept"))
    both = decisions.join(first, key)
    return both.groupBy(*key, "kept").agg(F.count_if(F.col("input_hash") != F.col("kept.input_hash")).alias("conflicts")).select(*key, F.col("kept.seq").alias("seq"), F.col("kept.input_hash").alias("input_hash"), "conflicts")


def decided(decisions: DataFrame, tombstones: DataFrame, provisional: str) -> DataFrame:
    """decisions (space_id, turn_id, version, seq, input_hash) with the outcome of putting each if absent, in order of seq.

    redacted: after the turn's tombstone (space_id, turn_id, seq), which wins over everything; attribution conflict: a provisional source and an
    extractor cannot both decide one turn, whichever came first; stored: the first of its version; replay: the same input again; input conflict:
    the identity is used for another input. The firsts are minima with partial sums, so no turn is gathered.
    """
    turn = ["space_id", "turn_id"]
    gone = tombstones.groupBy(*turn).agg(F.min("seq").alias("_gone"))
    first = decisions.groupBy(*turn).agg(F.min(F.struct("seq", "version")).alias("_first"))
    own = decisions.groupBy(*turn, "version").agg(F.min(F.struct("seq", "input_hash")).alias("_own"))
    rows = decisions.join(gone, turn, "left").join(first, turn).join(own, [*turn, "version"])
    outcome = F.when(F.col("_gone").isNotNull() & (F.col("seq") > F.col("_gone")), "redacted")
    outcome = outcome.when((F.col("version") == provisional) != (F.col("_first.version") == provisional), "attribution conflict").when(F.col("seq") == F.col("_own.seq"), "stored")
    outcome = outcome.when(F.col("input_hash").eqNullSafe(F.col("_own.input_hash")), "replay").otherwise("input conflict")
    return rows.withColumn("outcome", outcome).drop("_gone", "_first", "_own")


def applied_commitments(events: DataFrame, identity: list[str]) -> DataFrame:
    """commitment_id, status, revision, rejected, strangers, participants, condition and due_at after ordered intents (commitment_id, place, status, participant, condition, due_at, and the columns of its identity).

    The first intent fixes who promises what: later ones with another identity are refused (strangers) and change nothing. The others fold as in
    `fold_commitments`; a condition or due date replaces only when it is given. All of it needs the intents of a commitment in one place once. A new revision has no projections, so what `projected_commitments` says of older ones no longer counts.
    """
    own = Window.partitionBy("commitment_id")
    rows = events.withColumn("_is", F.first(F.struct(*identity)).over(own.orderBy("place"))).withColumn("_own", F.struct(*identity).eqNullSafe(F.col("_is")))
    rows = rows.withColumn("_odd", F.count_if(~F.col("_own")).over(own)).drop("_is")
    status, k = F.col("status"), F.col("_k")
    lowest = lambda test: F.min(F.when(test, k)).over(own)
    rows = rows.where("_own").withColumn("_k", F.row_number().over(own.orderBy("place"))).withColumn("_sure", lowest(status == "confirmed"))
    rows = rows.withColumn("_end", F.least(lowest(status.isin("cancelled", "superseded") & (k > 1)), lowest((status == "fulfilled") & (k > F.col("_sure")))))
    rows = rows.withColumn("_as", F.max(F.when(k == F.col("_end"), status)).over(own))
    goes_on = (status == "confirmed") | ((status == "proposed") & F.coalesce(k <= F.col("_sure"), F.lit(True)))
    taken = (k == 1) | ((F.col("_end").isNull() | (k < F.col("_end"))) & goes_on) | F.coalesce((k >= F.col("_end")) & (status == F.col("_as")), F.lit(False))
    rows = rows.withColumn("_taken", taken)
    last = lambda c: F.max(F.when(F.col("_taken") & F.col(c).isNotNull(), F.struct("_k", c)))[c].alias(c)
    return rows.groupBy("commitment_id").agg(
        F.coalesce(F.max("_as"), F.when(F.max("_sure").isNotNull(), F.lit("confirmed")).otherwise(F.lit("proposed"))).alias("status"),
        F.count_if("_taken").cast("int").alias("revision"), F.count_if(~F.col("_taken")).cast("int").alias("rejected"), F.max("_odd").cast("int").alias("strangers"),
        F.array_sort(F.collect_set(F.when(F.col("_taken"), F.col("participant")))).alias("participants"), last("condition"), last("due_at"),
    )


def fold_facts(events: DataFrame) -> DataFrame:
    """Canonical facts from (fact_id, slot, seq, kind, evidence) events: add, invalidate, reactivate, forget.

    A forgotten fact never comes back; else the last event decides. evidence counts distinct sources of adds; activations
    counts how often the fact became active.
    """
    then = Window.partitionBy("fact_id").orderBy("seq")
    on = F.col("kind").isin("add", "reactivate")
    began = on & ~F.coalesce(F.lag(on).over(then), F.lit(False))
    rows = events.withColumn("began", began).groupBy("fact_id", "slot").agg(
        F.max(F.struct("seq", "kind")).alias("last"), F.max(F.col("kind") == "forget").alias("forgotten"), F.count_distinct(F.when(F.col("kind") == "add", F.col("evidence"))).alias("evidence"), F.count_if("began").alias("activations")
    )
    state = F.when(F.col("forgotten"), F.lit("forgotten")).when(F.col("last.kind") == "invalidate", F.lit("invalidated")).otherwise(F.lit("active"))
    return rows.select("fact_id", "slot", state.alias("state"), "evidence", "activations", F.col("last.seq").alias("last_seq"))


def active_for_slot(facts: DataFrame) -> DataFrame:
    """Single-slot conflict: of the active facts of a slot, the latest holds and the number of others conflicts."""
    live = facts.where("state = 'active'")
    return live.groupBy("slot").agg(F.max(F.struct("last_seq", "fact_id")).alias("held"), (F.count("*") - 1).alias("conflicts")).select("slot", F.col("held.fact_id").alias("fact_id"), "conflicts")


def fold_commitments(events: DataFrame) -> DataFrame:
    """Current commitments from ordered intents (commitment_id, promisor, place, status, participant, due_at), under TRANSITIONS.

    Forbidden transitions count as rejected and change nothing; others raise the revision, add their participant and replace a
    due date. The fold needs no history in hand: a first intent confirms or proposes; the first later one that cancels or
    supersedes, or fulfils what is confirmed, ends it; before that, intents confirm or, until then, propose again; after it only the
    same end is taken. So window minima say of each intent whether it is taken, and the rest is one aggregation.
    """
    own, status, k = Window.partitionBy("commitment_id", "promisor"), F.col("status"), F.col("_k")
    first = lambda test: F.min(F.when(test, k)).over(own)
    rows = events.withColumn("_k", F.row_number().over(own.orderBy("place"))).withColumn("_sure", first(status == "confirmed"))
    rows = rows.withColumn("_end", F.least(first(status.isin("cancelled", "superseded") & (k > 1)), first((status == "fulfilled") & (k > F.col("_sure")))))
    rows = rows.withColumn("_as", F.max(F.when(k == F.col("_end"), status)).over(own))
    before = F.col("_end").isNull() | (k < F.col("_end"))
    goes_on = (status == "confirmed") | ((status == "proposed") & F.coalesce(k <= F.col("_sure"), F.lit(True)))
    taken = (k == 1) | (before & goes_on) | F.coalesce((k >= F.col("_end")) & (status == F.col("_as")), F.lit(False))
    rows = rows.withColumn("_taken", taken)
    due = F.max(F.when(F.col("_taken") & F.col("due_at").isNotNull(), F.struct("_k", "due_at")))
    return rows.groupBy("commitment_id", "promisor").agg(
        F.coalesce(F.max("_as"), F.when(F.max("_sure").isNotNull(), F.lit("confirmed")).otherwise(F.lit("proposed"))).alias("status"),
        F.count_if("_taken").cast("int").alias("revision"), F.count_if(~F.col("_taken")).cast("int").alias("rejected"),
        F.array_sort(F.collect_set(F.when(F.col("_taken"), F.col("participant")))).alias("participants"), due["due_at"].alias("due_at"),
    )


def commitment_page(commitments: DataFrame, limit: int) -> DataFrame:
    """Active ones first by due date (none last), with the total before the limit."""
    live = F.col("status").isin("proposed", "confirmed")
    page = commitments.orderBy(F.desc(live), F.asc_nulls_last(F.when(live, F.col("due_at"))), F.desc_nulls_last("due_at"), "commitment_id").limit(limit)
    total = commitments.agg(F.count("*").alias("total")).withColumn("_", F.lit(1))
    return page.withColumn("_", F.lit(1)).join(total, "_").drop("_")


def commitment_history(events: DataFrame, last: int) -> DataFrame:
    """The last intents of each commitment, oldest first, numbered from 1."""
    back = Window.partitionBy("commitment_id").orderBy(F.desc("place"))
    some = events.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= last)
    return some.withColumn("n", F.row_number().over(Window.partitionBy("commitment_id").orderBy("place"))).drop("_n")


def without_tombstones(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return rows.join(tombstones.select(key), key, "left_anti")


def materialization(pending: Column, failed: Column) -> Column:
    """ready, materializing or degraded from the counts of pending and failed projections."""
    return F.when(failed > 0, F.lit("degraded")).when(pending > 0, F.lit("materializing")).otherwise(F.lit("ready"))


def provisional_sources(rows: DataFrame, most: int = PROVISIONAL_ROWS, budget: int = PROVISIONAL_BYTES) -> DataFrame:
    """For each turn_group, newest sources (id, bytes) first within a number of rows and a byte budget; one too large is skipped, not a stop.

    Each round takes of every group the newest row below its last pick that still fits: a maximum with partial sums, so no
    group is gathered, however large.
    """
    picked = rows.where(F.col("bytes") <= budget).groupBy("turn_group").agg(F.max(F.struct("id", "bytes")).alias("p")).select("turn_group", "p.id", F.col("p.bytes").alias("used"))
    out = picked
    for _ in range(most - 1):
        last = picked.select("turn_group", F.col("id").alias("_last"), F.col("used").alias("_used"))
        fits = rows.join(last, "turn_group").where((F.col("id") < F.col("_last")) & (F.col("bytes") + F.col("_used") <= budget))
        picked = fits.groupBy("turn_group", "_used").agg(F.max(F.struct("id", "bytes")).alias("p")).select("turn_group", "p.id", (F.col("_used") + F.col("p.bytes")).alias("used"))
        out = out.unionByName(picked)
    return out.select("turn_group", "id")


def fold_dead_letters(events: DataFrame) -> DataFrame:
    """entry_id, state, attempts and rejected after ordered operations (entry_id, seq, op): claim, finish, fail, release, resolve.

    Only an unresolved entry can be claimed, so of several claimants one has it; finish and fail (or release) need a claim; an
    entry that is being replayed cannot be resolved. Operations that find another state change nothing and count as rejected. An
    entry's operations are few; they fold in an expression.
    """
    kind = "struct<state:string,attempts:int,rejected:int>"
    seed = F.from_json(F.lit('{"state": "unresolved", "attempts": 0, "rejected": 0}'), kind)

    def apply(z: Column, e: Column) -> Column:
        op, state = e["op"], z["state"]
        claims, ends = (op == "claim") & (state == "unresolved"), op.isin("finish", "fail", "release") & (state == "replaying")
        settles = (op == "resolve") & (state != "replaying")
        after = F.when(claims, F.lit("replaying")).when(ends, F.when(op == "finish", F.lit("replayed")).otherwise(F.lit("unresolved"))).when(settles, F.lit("resolved")).otherwise(state)
        return F.struct(after.alias("state"), (z["attempts"] + claims.cast("int")).alias("attempts"), (z["rejected"] + (~(claims | ends | settles)).cast("int")).alias("rejected"))

    rows = events.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op"))).alias("ops"))
    return rows.select("entry_id", F.aggregate("ops", seed, apply).alias("z")).select("entry_id", "z.*")


def command_stats(statuses: DataFrame) -> DataFrame:
    """Requests by status, with their attempts."""
    return statuses.groupBy("status").agg(F.count("*").alias("requests"), F.sum("attempts").alias("attempts"), F.max("attempts").alias("most"))


def capacity(rows: DataFrame, most: int = 10_000, most_bytes: int = 64 << 20) -> DataFrame:
    """rows and bytes that provisional sources of a space hold, and whether another may be stored."""
    out = rows.groupBy("space_id").agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return out.withColumn("admits", (F.col("rows") < most) & (F.col("bytes") < most_bytes))


def projected_commitments(commitments: DataFrame, marks: DataFrame) -> DataFrame:
    """commitments (commitment_id, revision) with projected: whether a mark (commitment_id, revision) is for the revision that stands; marks of older ones count for nothing."""
    done = marks.select("commitment_id", "revision").distinct().withColumn("projected", F.lit(True))
    return commitments.join(done, ["commitment_id", "revision"], "left").withColumn("projected", F.coalesce("projected", F.lit(False)))


def unarchived(commitments: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Commitments without a tombstone, or with one that only archives (state archived)."""
    t = tombstones.select("commitment_id", F.col("state").alias("_state"))
    return commitments.join(t, "commitment_id", "left").where("_state is null or _state = 'archived'").drop("_state")


def commitments_of_sources(revisions: DataFrame, commitments: DataFrame, sources: DataFrame) -> DataFrame:
    """The commitments that some source events revised, each once."""
    hit = revisions.join(sources.select("source").distinct(), "source", "left_semi").select("commitment_id").distinct()
    return commitments.join(hit, "commitment_id", "left_semi")


def commitment_listing(commitments: DataFrame, limit: int) -> DataFrame:
    """Active ones first by due date (none last), then the rest by when they were last updated, newest first; with the exact total and whether the page is cut."""
    live = F.col("status").isin("proposed", "confirmed")
    total = commitments.agg(F.count("*").alias("t")).scalar()
    page = commitments.orderBy(F.desc(live), F.asc_nulls_last(F.when(live, F.col("due_at"))), F.desc_nulls_last("updated_at"), "commitment_id").limit(limit)
    return page.withColumn("total", total).withColumn("truncated", F.col("total") > limit)


#: The counters of open work that together say whether a memory is materialised.
OPEN = ["drawer_not_projected", "kg_not_projected", "invalidations_pending", "supersessions_pending", "reactivations_pending", "forget_projections_pending"]


def materialization_status(stats: DataFrame, dead: Column) -> DataFrame:
    """pending (the sum of OPEN) and state: unavailable without numbers, degraded with dead letters, materializing while anything is open, else ready."""
    pending = F.lit(0)
    for c in OPEN:
        pending = pending + F.coalesce(F.col(c), F.lit(0))
    state = F.when(F.col("assertions_total").isNull(), F.lit("unavailable")).when(dead > 0, F.lit("degraded")).when(pending > 0, F.lit("materializing")).otherwise(F.lit("ready"))
    return stats.select(pending.alias("pending"), state.alias("state"))
