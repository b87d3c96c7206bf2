"""All-or-nothing writes over several tables: immutable Parquet files, and numbered manifests that name the files of every table.

A commit writes new files first and then publishes one manifest by an exclusive rename, so readers see all of it or nothing, and of two
commits on the same base one fails with Conflict. Writers number their batches; a batch that a manifest already counts changes nothing, so a run
that is killed at any step is simply run again. Erasing keys rewrites only the files that hold them, found by bitmaps of their keys' hashes.
Snapshots are manifests with a Merkle tree of their files' SHA-256.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits that a key's hash can take in the bitmaps of a file (of 32,768 each), and files or nodes below a node of a Merkle tree.
BITS, FAN = 1 << 20, 64


class Conflict(RuntimeError):
    """Another commit came first."""


class Stale(RuntimeError):
    """A snapshot from before the last erasure: restoring it would bring back what was forgotten."""


@dataclass
class Change:
    """What a commit does to a table: files that stay (None: all of them) and rows that are added."""

    rows: DataFrame | None = None
    keep: list[str] | None = field(default_factory=list)


def append(rows: DataFrame) -> Change:
    return Change(rows, None)


def replace(rows: DataFrame) -> Change:
    return Change(rows, [])


class Store:
    """Tables under a folder of any file system that Spark writes to and that renames atomically."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # files

    def _path(self, name: str):
        return self._hadoop.Path(name if "://" in name or name.startswith("/") else f"{self.root}/{name}")

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(path)) if self._fs().exists(path) else []

    def _read_text(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, text: str, name: str) -> None:
        """Writes a text under a temporary name and renames it; fails if the name is taken."""
        temporary = self._path(f"tmp/{uuid.uuid4().hex}")
        stream = self._fs().create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._path(name)
        self._fs().mkdirs(target.getParent())
        kind = getattr(self._hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        context = self._hadoop.FileContext.getFileContext(self._fs().getUri(), self._conf)
        try:
            context.rename(self._fs().makeQualified(temporary), self._fs().makeQualified(target), how)
        except Exception as e:
            self._fs().delete(temporary, False)
            if self._fs().exists(target):
                raise Conflict(name) from e
            raise

    def _write(self, table: str, rows: DataFrame) -> list[str]:
        """New files of a table, below the root; nothing refers to them yet."""
        folder = f"data/{table}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return [f"{folder}/{n}" for n in self._names(folder) if n.endswith(".parquet")]

    # manifests

    def manifest(self, version: int | None = None) -> dict:
        """The last published manifest, or that of a version."""
        if version is None:
            numbers = [int(n) for n in self._names("manifests") if n.isdigit()]
            if not numbers:
                return {"version": 0, "tables": {}, "batches": {}, "erased": 0}
            version = max(numbers)
        return json.loads(self._read_text(f"manifests/{version:012d}"))

    def read(self, table: str, at: dict | None = None) -> DataFrame:
        held = (at or self.manifest())["tables"][table]
        schema = StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in held["files"])) if held["files"] else self.spark.createDataFrame([], schema)

    def commit(self, changes: dict[str, Change], writer: str | None = None, batch: int | None = None, base: dict | None = None, erases: bool = False) -> dict:
        """Publishes all changes as the version after base (the last one), and returns its manifest.

        A batch of a writer that base counts already changes nothing. A failure before the manifest is published leaves the old state,
        and files that `sweep` deletes.
        """
        base = base or self.manifest()
        if writer is not None and base["batches"].get(writer, -1) >= batch:
            return base
        tables = dict(base["tables"])
        for name, change in changes.items():
            old = tables.get(name, {"files": [], "schema": None})
            stay = old["files"] if change.keep is None else change.keep
            new = self._write(name, change.rows) if change.rows is not None else []
            schema = old["schema"] if change.rows is None else json.loads(change.rows.schema.json())
            tables[name] = {"files": [*stay, *new], "schema": schema}
        made = {"version": base["version"] + 1, "tables": tables, "batches": base["batches"] | ({writer: batch} if writer is not None else {}), "erased": base["version"] + 1 if erases else base["erased"]}
        self._publish(json.dumps(made), f"manifests/{made['version']:012d}")
        return made

    def update(self, changes: Callable[[dict], dict[str, Change]], writer: str | None = None, batch: int | None = None, tries: int = 5, erases: bool = False) -> dict:
        """Commits what changes(base) makes of the last version, anew where another commit came first."""
        for k in range(tries):
            base = self.manifest()
            if writer is not None and base["batches"].get(writer, -1) >= batch:
                return base
            try:
                return self.commit(changes(base), writer, batch, base, erases)
            except Conflict:
                if k == tries - 1:
                    raise
        return self.manifest()

    def sweep(self, keep: int = 2) -> int:
        """Deletes files that neither the last `keep` manifests nor a snapshot names, and manifests before those; says how many files. No commit may run meanwhile."""
        numbers = sorted(int(n) for n in self._names("manifests") if n.isdigit())
        kept = [self.manifest(n) for n in numbers[-keep:]] + [json.loads(self._read_text(f"snapshots/{n}")) for n in self._names("snapshots")]
        named = {f for m in kept for t in m["tables"].values() for f in t["files"]}
        done = 0
        for table in self._names("data"):
            for part in self._names(f"data/{table}"):
                files = [f"data/{table}/{part}/{n}" for n in self._names(f"data/{table}/{part}") if n.endswith(".parquet")]
                gone = [f for f in files if f not in named]
                done += len(gone)
                if len(gone) == len(files):
                    self._fs().delete(self._path(f"data/{table}/{part}"), True)
                else:
                    for f in gone:
                        self._fs().delete(self._path(f), False)
        for n in numbers[:-keep]:
            self._fs().delete(self._path(f"manifests/{n:012d}"), False)
        return done

    # erasing

    def bitmaps(self, table: str, key: str, files: list[str]) -> DataFrame:
        """file, bucket and bits of the hashes of its keys, for every file."""
        at = F.pmod(F.xxhash64(key), F.lit(BITS))
        rows = self.spark.read.parquet(*(f"{self.root}/{f}" for f in files)).select(F.col("_metadata.file_path").alias("path"), at.alias("at"))
        return rows.groupBy("path", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))

    def index(self, table: str, key: str) -> None:
        """Writes the bitmaps of files that have none yet, so that erasing reads no file it need not."""
        m = self.manifest()
        known = m["tables"].get(f"index-{table}-{key}")
        done = {r[0] for r in self.read(f"index-{table}-{key}", m).select("file").distinct().collect()} if known else set()  # names of files
        new = [f for f in m["tables"][table]["files"] if f not in done]
        if new:
            self.commit({f"index-{table}-{key}": append(self.bitmaps(table, key, new).select(self._below("path"), "bucket", "bits"))}, base=m)

    def _below(self, path: str):
        return F.expr(f"substring({path}, instr({path}, '/data/') + 1)").alias("file")

    def files_with(self, table: str, key: str, keys: DataFrame, m: dict) -> list[str]:
        """The files of a table that hold one of the keys: those whose bitmaps may are read, the others are not."""
        files = m["tables"][table]["files"]
        known = m["tables"].get(f"index-{table}-{key}")
        if known and files:
            at = F.pmod(F.xxhash64(key), F.lit(BITS))
            asked = keys.select(at.alias("at")).distinct().select(F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").cast("int").alias("bit"))
            byte = F.conv(F.hex(F.expr("substring(bits, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
            index = self.read(f"index-{table}-{key}", m)
            some = {r[0] for r in index.join(asked, "bucket").where(F.getbit(byte, F.pmod("bit", F.lit(8))) == 1).select("file").distinct().collect()}
            indexed = {r[0] for r in index.select("file").distinct().collect()}
            files = [f for f in files if f in some or f not in indexed]
        if not files:
            return []
        rows = self.spark.read.parquet(*(f"{self.root}/{f}" for f in files)).select(F.col("_metadata.file_path").alias("path"), key)
        return sorted(r[0] for r in rows.join(keys.select(key).distinct(), key, "left_semi").select(self._below("path")).distinct().collect())

    def erase(self, keys: dict[str, tuple[str, DataFrame]], receipts: str = "receipts", writer: str | None = None, batch: int | None = None) -> dict:
        """Deletes the rows with the keys (by table: its key column, and a frame with it) for good, in one commit over all tables.

        Only files that hold such rows are rewritten; the others keep their names. A receipt of each erased key, its table and the hash of
        the key, is appended in the same commit and read back. Null keys erase nothing. The old files go when `sweep` has dropped the
        versions that name them.
        """

        def changes(m: dict) -> dict[str, Change]:
            out, told = {}, None
            for table, (key, asked) in keys.items():
                asked = asked.select(key).where(F.col(key).isNotNull()).distinct()
                hit = self.files_with(table, key, asked, m)
                if not hit:
                    continue
                schema = StructType.fromJson(m["tables"][table]["schema"])
                rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in hit))
                gone = rows.join(asked, key, "left_semi").select(F.lit(table).alias("table"), F.sha2(F.col(key).cast("string"), 256).alias("receipt")).distinct()
                told = gone if told is None else told.unionByName(gone)
                out[table] = Change(rows.join(asked, key, "left_anti").select(*schema.names), [f for f in m["tables"][table]["files"] if f not in hit])
            if told is not None:
                out[receipts] = append(told)
            return out

        before = self.manifest()
        made = self.update(changes, writer, batch, erases=True)
        if made["version"] > before["version"] and receipts in made["tables"]:
            new = [f for f in made["tables"][receipts]["files"] if f not in before["tables"].get(receipts, {"files": []})["files"]]
            if new and not self.spark.read.parquet(*(f"{self.root}/{f}" for f in new)).limit(1).count() and any(made["tables"][t] != before["tables"][t] for t in keys):
                raise RuntimeError("receipts of an erasure cannot be read")
        return made

    # snapshots

    def tree(self, m: dict) -> DataFrame:
        """level, table, node, file and sha: the Merkle tree of a version. Leaves are files; a node is the SHA-256 of its children's, in order, and the last level has one node for each table."""
        rows = [(t, f, k) for t, held in sorted(m["tables"].items()) for k, f in enumerate(held["files"])]
        paths = [f"{self.root}/{f}" for _, f, _ in rows]
        if not paths:
            return self.spark.createDataFrame([], "level int, table string, node long, file string, sha string")
        named = self.spark.createDataFrame(rows, "table string, file string, node long")
        held = self.spark.read.format("binaryFile").load(paths).select(self._below("path"), F.sha2("content", 256).alias("sha"))
        level = named.join(held, "file", "left").select(F.lit(0).alias("level"), "table", "node", "file", "sha")
        out, most = level, max(len(h["files"]) for h in m["tables"].values())
        n = 0
        while most > 1 or n == 0:
            n, most = n + 1, -(-most // FAN)
            up = level.groupBy("table", F.floor(F.col("node") / FAN).alias("node")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "sha"))), lambda x: x["sha"]), ""), 256).alias("sha"))
            level = up.select(F.lit(n).alias("level"), "table", "node", F.lit(None).cast("string").alias("file"), "sha")
            out = out.unionByName(level)
        return out

    def snapshot(self, name: str) -> str:
        """Keeps the last version under a name, with its tree and root; returns the root. Files are shared with the store, so a snapshot costs what changed since the one before."""
        m = self.manifest()
        nodes = self.tree(m).collect()  # names of files, and a part of as many nodes
        tops = {r["table"]: r["sha"] for r in sorted(nodes, key=lambda r: r["level"])}
        made = m | {"leaves": {r["file"]: r["sha"] for r in nodes if not r["level"]}, "root": hashlib.sha256(json.dumps(tops, sort_keys=True).encode()).hexdigest()}
        self._publish(json.dumps(made), f"snapshots/{name}")
        return made["root"]

    def verify(self, name: str) -> DataFrame:
        """table, file and fault (missing or changed) of a snapshot's files."""
        held = json.loads(self._read_text(f"snapshots/{name}"))
        wanted = self.spark.createDataFrame([(t, f, held["leaves"][f]) for t, x in sorted(held["tables"].items()) for f in x["files"]], "table string, file string, sha string")
        there = [f for x in held["tables"].values() for f in x["files"] if self._fs().exists(self._path(f))]
        found = self.spark.read.format("binaryFile").load([f"{self.root}/{f}" for f in there]).select(self._below("path"), F.sha2("content", 256).alias("_sha")) if there else self.spark.createDataFrame([], "file string, _sha string")
        both = wanted.join(found, "file", "left")
        fault = F.when(F.col("_sha").isNull(), F.lit("missing")).when(F.col("sha") != F.col("_sha"), F.lit("changed"))
        return both.withColumn("fault", fault).where("fault is not null").select("table", "file", "fault")

    def restore(self, name: str) -> dict:
        """Publishes a snapshot's tables as the next version. Refuses a snapshot with faults, and one from before the last erasure."""
        held, now = json.loads(self._read_text(f"snapshots/{name}")), self.manifest()
        if held["version"] < now["erased"]:
            raise Stale(f"{name} is of version {held['version']}; version {now['erased']} erased keys")
        if faults := self.verify(name).limit(3).collect():
            raise RuntimeError(f"{name}: {faults}")
        made = {"version": now["version"] + 1, "tables": held["tables"], "batches": held["batches"], "erased": now["erased"]}
        self._publish(json.dumps(made), f"manifests/{made['version']:012d}")
        return made
