"""Streams with keyed state: folds of event logs, first deliveries, and deliveries with retries and deadlines.

State lies with its key, so a batch reads and writes only the keys it touches, and timers act without new input. Events may come late, out of
order and more than once: a key's state is its distinct events, folded in the order of the log, so every order of arrival ends in the state
of the batch fold. The session needs Spark's RocksDB state store (`require`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns that name a fact, and the statements that its log leaves.
FACT = ["space_id", "subject_id", "predicate", "object_id", "audience"]
STATEMENTS = "array<struct<statement_id:string,valid_from:timestamp_ntz,valid_to:timestamp_ntz>>"
#: The three kinds of messages, each read by a query of its own, and how many deliveries one gets.
SUBJECTS, DELIVERIES = ("conversation_turn", "memory_command", "device_sync"), 3


def require(spark: SparkSession) -> None:
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")


def statements_of(log: Iterable) -> list[list]:
    """The statements [id, from, to] that a fact's events (op, statement_id, turn_id, at) leave, in their order.

    An add of a turn that has a statement, ended or not, is a replay and changes nothing; while one is open, no other is added; an invalidation
    ends what is open.
    """
    out, turns = [], set()
    for op, key, turn, at in log:
        still = out and out[-1][2] is None
        if op == "invalidate":
            if still:
                out[-1][2] = at
        elif not still and (not turn or turn not in turns):
            out.append([key, at, None])
            turns.add(turn)
    return out


def statement_log(events: DataFrame) -> DataFrame:
    """FACT columns and statement_id, valid_from, valid_to of the statements that logs (FACT, seq, op, statement_id, turn_id, at) leave.

    Events that repeat (seq) count once. Facts are dealt by key and read in order, one event at a time, so a long history is never gathered.
    """
    kinds = dict(events.dtypes)
    once = events.select(*FACT, "seq", "op", "statement_id", "turn_id", "at").dropDuplicates([*FACT, "seq"])

    def run(batches):
        fact, log, told = None, [], []

        def closed():
            return [(*fact, *s) for s in log]

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key = tuple(row[: len(FACT)])
                if key != fact:
                    told += closed() if fact else []
                    fact, log, turns = key, [], set()
                at = None if pd.isna(row.at) else row.at
                still = log and log[-1][2] is None
                if row.op == "invalidate":
                    if still:
                        log[-1][2] = at
                elif not still and (not row.turn_id or row.turn_id not in turns):
                    log.append([row.statement_id, at, None])
                    turns.add(row.turn_id)
            if told:
                yield pd.DataFrame(told, columns=[*FACT, "statement_id", "valid_from", "valid_to"])
                told = []
        if fact and log:
            yield pd.DataFrame(closed(), columns=[*FACT, "statement_id", "valid_from", "valid_to"])

    kind = ", ".join([*(f"{c} {kinds[c]}" for c in FACT), "statement_id string, valid_from timestamp_ntz, valid_to timestamp_ntz"])
    return once.repartition(*FACT).sortWithinPartitions(*FACT, "seq").mapInPandas(run, kind)


class _Log(StatefulProcessor):
    """Keeps the distinct events of a fact; tells the statements they leave whenever a new one comes."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.events = handle.getMapState("events", "seq long", "op string, statement_id string, turn_id string, at timestamp_ntz", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = False
        for r in rows:
            if not self.events.containsKey((r.seq,)):
                self.events.updateValue((r.seq,), (r.op, r.statement_id, r.turn_id, r.at))
                new = True
        if new:
            log = sorted((k[0], tuple(v)) for k, v in self.events.iterator())
            left = [Row(statement_id=s, valid_from=a, valid_to=b) for s, a, b in statements_of(v for _, v in log)]
            yield Row(**dict(zip(FACT, key)), version=len(log), statements=left)

    def close(self) -> None:
        pass


def fold_statements(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of FACT, version (events seen) and statements, a row for each fact that a batch changes.

    ttl_ms: how long an event is remembered; one that comes again later than that counts as new.
    """
    require(events.sparkSession)
    kinds = dict(events.dtypes)
    kind = ", ".join([*(f"{c} {kinds[c]}" for c in FACT), "version long", f"statements {STATEMENTS}"])
    rows = events.select(*FACT, F.col("seq").cast("long").alias("seq"), "op", "statement_id", "turn_id", "at")
    return rows.groupBy(*FACT).transformWithState(_Log(ttl_ms), kind, "Update", "ProcessingTime" if ttl_ms else "None")


def keep_changes(changes: DataFrame, out: str, checkpoint: str, once: bool = True, every: str = "1 second") -> StreamingQuery:
    """Writes each batch's changes under its number, so that a replayed batch overwrites its own.

    once: stop when all input is read. Streams with timers or a ttl never run out of batches, so they must go on (once=False) until they are stopped.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={number}")

    writer = changes.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def latest(spark: SparkSession, out: str, key: list[str]) -> DataFrame:
    """The last change of each key."""
    rows = spark.read.parquet(out).drop("_batch")
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), "version").alias("_last")).select(*key, "_last.*")


class _First(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: r.seq)
        if not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_by(events: DataFrame, key: str, ttl_ms: int | None = None) -> DataFrame:
    """A stream of events (with seq), each key once: the first to come, of a batch that of the smallest seq. Without a ttl a key is remembered for good."""
    require(events.sparkSession)
    return events.groupBy(key).transformWithState(_First(ttl_ms), events.schema, "Append", "ProcessingTime" if ttl_ms else "None")


_SYNC = "array<struct<event_id:string,idempotency_hash:string,user_text:string>>"
#: Turns that one device-sync message may hold in their order.
MOST_TURNS = 1_000_000


def synced(messages: DataFrame, payload: str = "payload", ttl_ms: int | None = None) -> DataFrame:
    """A stream of the turns that device-sync messages (seq, payload) bring, each once over all batches by event id, and then by idempotency hash; unreadable messages bring none."""
    rows = messages.select("seq", F.posexplode(F.from_json(payload, _SYNC)).alias("n", "e")).select((F.col("seq").cast("long") * MOST_TURNS + F.col("n")).alias("seq"), "e.*")
    return first_by(first_by(rows, "event_id", ttl_ms), "idempotency_hash", ttl_ms)


class _Deliveries(StatefulProcessor):
    """Delivers a key's messages in their order; what fails waits for a timer, and is dead after so many attempts or when its deadline is over."""

    def __init__(self, attempt: Callable[[Row], str | None], deliveries: int, wait_ms: int, deadline_ms: int | None):
        self.attempt, self.deliveries, self.wait_ms, self.deadline_ms = attempt, deliveries, wait_ms, deadline_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long, message_id string", "payload string, attempt int, since long, error string")

    def _deliver(self, key, seq: int, message: str, payload: str, attempt: int, since: int, now: int) -> Iterator[Row]:
        try:
            error = self.attempt(Row(subject=key[0], seq=seq, message_id=message, payload=payload))
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        attempt += 1
        late = self.deadline_ms is not None and now - since + self.wait_ms > self.deadline_ms
        if error is not None and attempt < self.deliveries and not late:
            self.waiting.updateValue((seq, message), (payload, attempt, since, error))
            return
        if self.waiting.containsKey((seq, message)):
            self.waiting.removeKey((seq, message))
        yield Row(subject=key[0], seq=seq, message_id=message, payload=payload, outcome="done" if error is None else "dead", attempts=attempt, error=error)

    def _timer(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.waiting.exists():
            self.handle.registerTimer(now + self.wait_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for r in sorted(rows, key=lambda r: (r.seq, r.message_id)):
            if not self.waiting.containsKey((r.seq, r.message_id)):
                yield from self._deliver(key, r.seq, r.message_id, r.payload, 0, now, now)
        self._timer(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for (seq, message), (payload, attempt, since, _) in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
            yield from self._deliver(key, seq, message, payload, attempt, since, now)
        self._timer(now)

    def close(self) -> None:
        pass


def deliver(messages: DataFrame, attempt: Callable[[Row], str | None], deliveries: int = DELIVERIES, wait_ms: int = 1000, deadline_ms: int | None = None) -> DataFrame:
    """A stream of the outcomes (done or dead, with the attempts and the last error) of messages (subject, seq, message_id, payload).

    attempt(message) returns an error or None, and must bear to be called again for the same message, as a batch can be replayed. Messages of
    one subject are tried in the order of seq; one that fails does not hold up those after it. It is tried again after wait_ms, by a
    timer, whether or not other messages come, and is dead after `deliveries` attempts, or when the next one would pass deadline_ms since the first.
    """
    require(messages.sparkSession)
    kind = "subject string, seq long, message_id string, payload string, outcome string, attempts int, error string"
    rows = messages.select("subject", F.col("seq").cast("long").alias("seq"), F.col("message_id").cast("string").alias("message_id"), F.col("payload").cast("string").alias("payload"))
    return rows.groupBy("subject").transformWithState(_Deliveries(attempt, deliveries, wait_ms, deadline_ms), kind, "Update", "ProcessingTime")


def run_subjects(read: Callable[[str], DataFrame], attempt: dict[str, Callable[[Row], str | None]], out: str, checkpoint: str, every: str = "1 second", **limits) -> dict[str, StreamingQuery]:
    """One query for each kind of message, so that a busy kind holds up no other: outcomes of kind k lie under out/k.

    read(kind) is its stream of messages (subject, seq, message_id, payload); subject within a kind is what keeps its order (a space).
    """
    return {k: keep_changes(deliver(read(k), attempt[k], **limits), f"{out}/{k}", f"{checkpoint}/{k}", once=False, every=every) for k in SUBJECTS if k in attempt}
