"""Invalidations and privacy requests that take effect in drawers, graph and ledger at once, as one commit of a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.operators.commits import Change, Store, append, replace

FACT = ["space_id", "subject_id", "predicate", "object_id", "audience"]


def privacy_outcomes(candidates: DataFrame) -> DataFrame:
    """candidates (target, action, drawer_id) with outcome and whether it was downgraded.

    A topic is archived. A delete erases its one match; where it matches several, nothing is guessed at: all are archived, which takes effect
    at once and can be undone. A drawer that several requests match is erased only if each of them erases it.
    """
    rows = candidates.select("target", "action", "drawer_id").distinct()
    many = rows.groupBy("target", "action").agg(F.count("*").alias("_n"))
    erase = (F.col("action") == "delete") & (F.col("_n") == 1)
    rows = rows.join(many, ["target", "action"]).withColumn("outcome", F.when(erase, F.lit("erase")).otherwise(F.lit("archive")))
    kept = rows.where("outcome = 'archive'").select("drawer_id").distinct().withColumn("_archived", F.lit(True))
    rows = rows.join(kept, "drawer_id", "left").withColumn("outcome", F.when(F.col("_archived"), F.lit("archive")).otherwise(F.col("outcome")))
    return rows.withColumn("downgraded", (F.col("action") == "delete") & (F.col("outcome") == "archive")).drop("_n", "_archived")


def archived(drawers: DataFrame, ids: DataFrame) -> DataFrame:
    """drawers, those of ids no longer recalled."""
    marks = ids.select("drawer_id").distinct().withColumn("_archived", F.lit(True))
    out = drawers.join(marks, "drawer_id", "left").withColumn("privacy", F.when(F.col("_archived"), F.lit("do_not_recall")).otherwise(F.col("privacy")))
    return out.select(*drawers.columns)


def ended(statements: DataFrame, turns: DataFrame, at: Column) -> DataFrame:
    """statements, the open ones of turns (space_id, source_turn_id) ended."""
    marks = turns.select("space_id", "source_turn_id").distinct().withColumn("_ended", F.lit(True))
    out = statements.join(marks, ["space_id", "source_turn_id"], "left").withColumn("valid_to", F.when(F.col("_ended") & F.col("valid_to").isNull(), at).otherwise(F.col("valid_to")))
    return out.select(*statements.columns)


def privacy_requests(store: Store, candidates: DataFrame, at: Column, writer: str, batch: int) -> dict:
    """Carries out privacy requests (target, action, drawer_id) on the tables drawers, statements, facts and receipts in one commit.

    Archived drawers are marked, and what their turns told ends; erased ones go with their turns' statements, and each turn leaves a tombstone in
    facts (source_turn_id, erased), which blocks its replay, and a receipt. Only turns that no archived or other drawer shares are erased.
    """
    outcomes = privacy_outcomes(candidates)

    def changes(m: dict) -> dict[str, Change]:
        drawers, statements = store.read("drawers", m), store.read("statements", m)
        of = lambda kind: drawers.join(outcomes.where(F.col("outcome") == kind).select("drawer_id").distinct(), "drawer_id", "left_semi")
        archive, erase = of("archive"), of("erase")
        stays = drawers.join(erase.select("drawer_id"), "drawer_id", "left_anti").select("space_id", "source_turn_id").distinct()
        gone = erase.select("space_id", "source_turn_id").where("source_turn_id is not null").distinct().join(stays, ["space_id", "source_turn_id"], "left_anti")
        told = archive.select("space_id", "source_turn_id").unionByName(erase.select("space_id", "source_turn_id"))
        left = ended(statements.join(gone, ["space_id", "source_turn_id"], "left_anti").select(*statements.columns), told, at)
        stones = gone.select("space_id", "source_turn_id", F.lit(True).alias("erased"))
        receipts = erase.select(F.lit("drawers").alias("table"), F.sha2(F.col("drawer_id").cast("string"), 256).alias("receipt")).unionByName(gone.select(F.lit("statements").alias("table"), F.sha2(F.concat_ws("|", "space_id", "source_turn_id"), 256).alias("receipt")))
        return {"facts": append(stones), "statements": replace(left), "drawers": replace(archived(drawers, archive).join(erase.select("drawer_id"), "drawer_id", "left_anti").select(*drawers.columns)), "receipts": append(receipts.distinct())}

    return store.update(changes, writer, batch, erases=True)


def exact_invalidations(store: Store, asks: DataFrame, writer: str, batch: int) -> dict:
    """Ends whole triples (FACT, ended_at, fact_id, intent_id) in the graph, archives the drawer of each canonical fact, and records the invalidation in the ledger, in one commit.

    A drawer is found by the turn id `canonical:<fact_id>`; an intent that the ledger holds already does nothing, so a request may come again.
    """

    def changes(m: dict) -> dict[str, Change]:
        drawers, statements, ledger = (store.read(t, m) for t in ("drawers", "statements", "ledger"))
        new = asks.dropDuplicates(["intent_id"]).join(ledger.select("intent_id"), "intent_id", "left_anti")
        first = new.groupBy(*FACT).agg(F.min("ended_at").alias("_at"))
        out = statements.join(first, FACT, "left").withColumn("valid_to", F.coalesce("valid_to", "_at")).select(*statements.columns)
        ids = drawers.join(new.select("space_id", F.concat(F.lit("canonical:"), "fact_id").alias("source_turn_id")).distinct(), ["space_id", "source_turn_id"], "left_semi").select("drawer_id")
        return {"statements": replace(out), "drawers": replace(archived(drawers, ids)), "ledger": append(new.select("fact_id", "intent_id", F.lit("invalidate").alias("kind"), F.lit("invalidated").alias("result")))}

    return store.update(changes, writer, batch)
