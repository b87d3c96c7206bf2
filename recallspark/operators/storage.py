"""Reading and writing memory records: scans, lookups, idempotent appends, inventories, snapshots, retention, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.functions import text

# fixed values: names of an envelope's kinds, and what a turn and a command hold
KINDS = ["conversation_turn", "memory_command", "device_sync"]
ENVELOPE = "struct<schema_version:string,kind:string,payload:string,content_type:string,trace_id:string>"
TURN = "struct<turn_id:string,memory_space_id:string,layer:string,person_id:string,user_text:string,assistant_text:string>"


def page(records: DataFrame, space: str | None, limit: int, after: int | None = None) -> DataFrame:
    """Records of a space (or all) by id; `after` is the last id of the page before, so deep pages cost no more."""
    rows = records.where(F.col("space_id") == space) if space else records
    rows = rows.where(F.col("drawer_id") > after) if after is not None else rows
    return rows.orderBy("drawer_id").limit(limit)


def get_many(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Records of the keys (drawer_id), each once; missing ones are left out."""
    return records.join(keys.select("drawer_id").distinct(), "drawer_id", "left_semi")


def by_source_turn(records: DataFrame, turns: DataFrame) -> DataFrame:
    """One record, that of the smallest id, of each turn asked for."""
    place = Window.partitionBy("space_id", "source_turn_id").orderBy("drawer_id")
    rows = records.join(turns.select("source_turn_id").distinct(), "source_turn_id", "left_semi")
    return rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def capped(records: DataFrame, most: int) -> DataFrame:
    """The first `most` records by id, and in column capped whether there are more; one more row than asked for is read to know it."""
    peek = records.orderBy("drawer_id").limit(most + 1)
    more = peek.agg((F.count("*") > most).alias("c")).scalar()
    return peek.orderBy("drawer_id").limit(most).withColumn("capped", more)


def shaped(fragments: DataFrame, now: Column) -> DataFrame:
    """Drawers to be written from fragments (wing, room, text, metadata): id, clocks filled in, metadata without nulls."""
    get = lambda k: F.try_element_at(F.col("metadata"), F.lit(k))
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    occurred, indexed = F.coalesce(get("occurred_at"), get("memory_time"), stamp), F.coalesce(get("indexed_at"), stamp)
    clocks = F.create_map(F.lit("occurred_at"), occurred, F.lit("indexed_at"), indexed, F.lit("filed_at"), indexed)
    kept = F.map_filter(F.col("metadata"), lambda k, v: v.isNotNull() & ~k.isin("occurred_at", "indexed_at", "filed_at"))
    return fragments.select("*", text.drawer_id(F.col("wing"), F.col("room"), F.col("text")).alias("drawer_key"), F.map_concat(kept, clocks).alias("shaped"))


def fresh(rows: DataFrame, store: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows to be appended: each key's first, unless the store has it."""
    place = Window.partitionBy(key).orderBy(*order)
    once = rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
    return once.join(store.select(key).distinct(), key, "left_anti")


def append_verified(rows: DataFrame, path: str, key: str, order: list[str]) -> int:
    """Appends what `fresh` lets through to the table at path, reads the keys back, and says how many were written."""
    spark = rows.sparkSession
    store = spark.read.schema(rows.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], rows.schema)
    new = fresh(rows, store, key, order)
    before = store.count()
    new.write.mode("append").parquet(path)
    held = spark.read.schema(rows.schema).parquet(path)
    written = held.count() - before
    missing = rows.select(key).join(held.select(key), key, "left_anti").limit(1).count()
    if missing:
        raise RuntimeError(f"{path}: a row that was written cannot be read")
    return written


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_receipts(rows: DataFrame, path: str) -> None:
    """Appends opaque receipts (dead letters, deletions) as JSON lines."""
    rows.write.mode("append").json(path)


def unwrapped(messages: DataFrame) -> DataFrame:
    """messages (value: JSON text) with kind, turn (a struct, for turns) and error: null, or why a message is for the dead letters."""
    e = F.from_json("value", ENVELOPE)
    rows = messages.withColumn("_e", F.when(F.try_parse_json("value").isNotNull(), e))
    rows = rows.withColumn("kind", F.col("_e.kind")).withColumn("turn", F.when(F.col("kind") == KINDS[0], F.from_json("_e.payload", TURN)))
    error = F.when(F.col("_e").isNull(), F.lit("unreadable")).when(~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)), F.lit("unknown kind"))
    error = error.when((F.col("kind") == KINDS[0]) & F.coalesce(F.trim("turn.turn_id") == "", F.lit(True)), F.lit("turn without id"))
    return rows.withColumn("error", error).drop("_e")


COMMANDS = ["remember", "forget", "correct", "add_triple", "invalidate", "commitment"]
COMMAND = "struct<kind:string,request_id:string,memory_space_id:string>"


def commands_of(messages: DataFrame) -> DataFrame:
    """messages (value) of commands with kind, request_id, space_id, body (the payload as a variant) and error; other messages go."""
    rows = unwrapped(messages).where("kind = 'memory_command'").withColumn("_payload", F.from_json("value", ENVELOPE)["payload"])
    c = F.from_json("_payload", COMMAND)
    known = F.coalesce(c["kind"].isin(COMMANDS), F.lit(False))
    error = F.when(~known, F.lit("unknown command")).when(F.coalesce(F.trim(c["request_id"]) == "", F.lit(True)), F.lit("command without id"))
    return rows.select("*", c["kind"].alias("command"), c["request_id"].alias("request_id"), c["memory_space_id"].alias("space_id"), F.try_parse_json("_payload").alias("body")).withColumn("error", error).drop("_payload", "turn")


def retained(messages: DataFrame, newest: Column, days: int = 14, most: int = 5000, most_bytes: int = 512 << 20) -> DataFrame:
    """Messages (space_id, seq, ts, bytes) that a stream with limits keeps: no older than `days`, then the newest while count and bytes of a space allow; old ones go first."""
    rows = messages.where(F.col("ts") >= newest - F.make_dt_interval(F.lit(days)))
    back = Window.partitionBy("space_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_n", F.count("*").over(back)).withColumn("_b", F.sum("bytes").over(back)).where((F.col("_n") <= most) & (F.col("_b") <= most_bytes)).drop("_n", "_b")


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """table and rows of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def manifest(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """table, rows and digest of each table (with the columns that the digest covers).

    The digest does not depend on the order of rows: it is the sums of both halves of their SHA-256's first 128 bits, so that changes do not cancel out. Null and
    empty values, and where one value ends, are told apart.
    """
    out = None
    for name, (df, columns) in sorted(tables.items()):
        parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
        row = F.sha2(F.concat_ws("|", *parts), 256)
        half = lambda at: F.coalesce(F.sum(F.conv(F.substring(row, at, 16), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")  # noqa: E731, B023
        one = df.agg(F.count("*").alias("rows"), F.concat_ws("-", half(1), half(17)).alias("digest")).select(F.lit(name).alias("table"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def manifest_faults(required: DataFrame, found: DataFrame) -> DataFrame:
    """table and fault: what a snapshot's manifest lacks or holds otherwise."""
    f = found.withColumnsRenamed({"rows": "_rows", "digest": "_digest"})
    both = required.join(f, "table", "left")
    fault = F.when(F.col("_rows").isNull(), F.lit("missing")).when((F.col("rows") != F.col("_rows")) | (F.col("digest") != F.col("_digest")), F.lit("changed"))
    return both.withColumn("fault", fault).where("fault is not null").select("table", "fault")


def write_snapshot(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Copies tables to a folder, and the manifest of what was copied last, so a snapshot without one is unfinished."""
    for name, (df, _) in tables.items():
        df.write.parquet(f"{path}/{name}")
    spark = next(iter(tables.values()))[0].sparkSession
    manifest({n: (spark.read.schema(df.schema).parquet(f"{path}/{n}"), c) for n, (df, c) in tables.items()}).write.parquet(f"{path}/manifest")


def verify_snapshot(spark: SparkSession, tables: dict[str, list[str]], path: str) -> DataFrame:
    """The faults of a snapshot against its manifest."""
    held = {n: (spark.read.parquet(f"{path}/{n}"), c) for n, c in tables.items() if exists(spark, f"{path}/{n}")}
    required = spark.read.parquet(f"{path}/manifest")
    return manifest_faults(required, manifest(held) if held else required.limit(0))


def registry(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The roster of spaces from a parsed file: realm, space, owner and layer of each, by realm; repeats and nameless ones go."""
    named = [(str(r["realm"]).strip(), str(r.get("space") or r["realm"]).strip(), r.get("owner"), r.get("layer", "personal")) for r in rows if str(r.get("realm") or "").strip()]
    return spark.createDataFrame(named, "realm string, space string, owner string, layer string").dropDuplicates(["realm"])
