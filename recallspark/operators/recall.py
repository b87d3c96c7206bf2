"""Recall as a caller meets it: budgets, owners' recollections, forgetting by preview and confirmation, embedders and stewards."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from recallspark.operators import browse, canonical, graph, steward
from recallspark.operators.visibility import Caller

# fixed values: seconds that a spoken recall and its graph part may take, candidates and rows of a forget preview, life of a token, ids it may hold
VOICE_SECONDS, GRAPH_SECONDS, CANDIDATES, SCANNED, TOKEN_SECONDS, TOKEN_IDS = 0.3, 0.05, 20, 50_000, 600, 100


def answered(plan: DataFrame, seconds: float) -> tuple[list[Row], str | None]:
    """A plan's rows, and null; or none, and `timeout` or what went wrong. Jobs over the budget are interrupted, so other parts of a recall stay whole."""
    context, tag = plan.sparkSession.sparkContext, f"budget-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        rows = plan.collect()
        return ([], "timeout") if late.is_set() else (rows, None)
    except Exception as e:
        return [], "timeout" if late.is_set() else f"{type(e).__name__}: {e}"
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def within(plan: DataFrame, seconds: float) -> tuple[list[Row], bool]:
    """A plan's rows, and False; or none and True if it is not done in time or fails."""
    rows, reason = answered(plan, seconds)
    return rows, reason is not None


def voice(records: DataFrame, facts: DataFrame | None, render: Callable[[list[Row], list[Row]], str], seconds: float = VOICE_SECONDS, graph_seconds: float = GRAPH_SECONDS) -> dict:
    """A spoken recall: records within its whole budget and, beside them, facts within theirs.

    Facts that are late or fail are left out without a word (facts_reason says why); records that are late or fail make the recall degraded, with an empty context,
    so that the caller never waits longer than the budget for it. Few rows each, as a recall's are.
    """
    with ThreadPoolExecutor(2) as pool:
        asked = pool.submit(answered, records, seconds)
        told = pool.submit(answered, facts, min(seconds, graph_seconds)) if facts is not None else None
        rows, reason = asked.result()
        said, dropped = told.result() if told else ([], None)
    if reason is not None:
        return {"context": "", "records": [], "facts": [], "degraded": True, "reason": reason, "facts_reason": dropped}
    return {"context": render(rows, said), "records": rows, "facts": said, "degraded": False, "reason": None, "facts_reason": dropped}


def owner_view(caller: Caller) -> Caller:
    """The caller as the owner who looks through their own memory: every audience, nothing private."""
    return replace(caller, every_audience=True, include_private=False)


class TooMany(ValueError):
    """A preview that would have to be cut; it is refused instead."""


def forget_preview(drawers: DataFrame, phrase: str, most: int = CANDIDATES, scanned: int = SCANNED) -> DataFrame:
    """Candidates for forgetting; too short a phrase, too many rows to look at or too many candidates are refused, never cut."""
    if len([c for c in phrase if c.isalnum()]) < 2:
        raise ValueError("a phrase needs two letters or digits")
    if drawers.limit(scanned + 1).count() > scanned:
        raise TooMany(f"over {scanned} records")
    found = browse.forget_candidates(drawers, phrase)
    if found.limit(most + 1).count() > most:
        raise TooMany(f"over {most} candidates")
    return found


def _sign(secret: bytes, body: bytes) -> str:
    return base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest()).decode().rstrip("=")


def confirmation(secret: bytes, space: str, ids: dict[str, list[str]], now: int, seconds: int = TOKEN_SECONDS) -> str:
    """A token for forgetting these ids (by kind) in a space until it expires; what it holds cannot be changed without the secret."""
    if any(len(x) > TOKEN_IDS for x in ids.values()):
        raise TooMany(f"over {TOKEN_IDS} ids of a kind")
    body = json.dumps({"space": space, "ids": {k: sorted(set(v)) for k, v in sorted(ids.items())}, "until": now + seconds}, sort_keys=True).encode()
    return base64.urlsafe_b64encode(body).decode().rstrip("=") + "." + _sign(secret, body)


def confirmed(secret: bytes, space: str, token: str, now: int) -> dict[str, list[str]]:
    """The ids of a token that is genuine, for this space and not expired; else ValueError."""
    body, _, mark = token.partition(".")
    raw = base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))
    said = json.loads(raw) if hmac.compare_digest(mark, _sign(secret, raw)) else None
    if said is None or said["space"] != space or said["until"] < now:
        raise ValueError("no valid confirmation")
    return said["ids"]


def forgotten(events: DataFrame, statements: DataFrame, entities: DataFrame, drawers: DataFrame, turns: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """What each store holds after turns and facts (fact_id) are forgotten for good, the ledger first, so that a broken-off run can be repeated.

    A turn's statements and drawers go, then entities that nothing speaks of; facts leave a tombstone and no evidence; receipts name what went by
    hashes only.
    """
    stones = facts.select("fact_id").distinct().join(events.groupBy("fact_id").agg(F.max("slot").alias("slot"), F.max("seq").alias("seq")), "fact_id")
    marks = stones.select("fact_id", "slot", (F.col("seq") + 1).alias("seq"), F.lit("forget").alias("kind"), F.lit("hard").alias("result"))
    ledger = canonical.scrubbed(events.unionByName(marks, allowMissingColumns=True))
    kept = graph.forget(statements, turns)
    gone = drawers.join(turns, "source_turn_id", "left_semi")
    receipts = gone.select(F.lit("drawer").alias("kind"), F.sha2(F.col("drawer_id").cast("string"), 256).alias("receipt")).unionByName(stones.select(F.lit("fact").alias("kind"), F.sha2("fact_id", 256).alias("receipt")))
    orphaned = graph.orphans(kept, entities).select("space_id", "entity_id")
    return {"ledger": ledger, "statements": kept, "entities": entities.join(orphaned, ["space_id", "entity_id"], "left_anti"), "drawers": drawers.join(turns, "source_turn_id", "left_anti"), "receipts": receipts}


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], column: str = "text", size: int | None = None) -> DataFrame:
    """rows with embedding, by a function over batches of texts; null texts have none, and a vector of another size than asked for fails."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        some = texts.dropna()
        made = pd.Series(embed(some.tolist()), index=some.index, dtype=object)
        if size is not None and any(len(v) != size for v in made):
            raise ValueError("an embedder returned vectors of another size")
        return made.reindex(texts.index).map(lambda v: None if v is None or isinstance(v, float) else v)

    return rows.withColumn("embedding", vectors(F.col(column)))


def _nothing(turns: DataFrame) -> DataFrame:
    return _said(turns).limit(0)


def _said(turns: DataFrame) -> DataFrame:
    """Each turn as one fragment that quotes it."""
    text = F.trim("user_text")
    return turns.where(text != "").select("turn_id", F.lit("fragment").alias("kind"), F.lit(0).alias("idx"), text.alias("content"), text.alias("evidence_quote"), "user_text", F.lit(1.0).alias("confidence"), F.lit(steward.IMPORTANCE).alias("importance"))


#: Extractors by name: turns (turn_id, user_text) -> claims. A model's goes here too.
STEWARDS: dict[str, Callable[[DataFrame], DataFrame]] = {"noop": _nothing, "verbatim": _said}


def decide(turns: DataFrame, name: str) -> DataFrame:
    """The claims of a registered extractor that quote the user's own text."""
    return steward.verbatim(STEWARDS[name](turns)).where("fault is null").drop("fault")
