"""State as versioned Parquet tables, each a base and deltas that are merged when read.

A commit writes what changed (whole tables, or deltas of upserts and deletes) to new folders and then one small manifest
that names the folders of every table, so all tables change together or not at all, and a reader sees one version. A
delta's size is that of the change: reading takes the last row of each key among the deltas (few) and puts them in place
of the base's by an anti join, for which the base is not shuffled where Spark's own size check lets the deltas be
broadcast. Deltas are merged among themselves when there are many, and into the base when they have grown to a share of
it, so that the base is rewritten once for every quarter of its size that comes in.

A writer publishes under a claim for its version that one writer alone can make. A claim of a writer that died is taken
over after a while by a claim of the next generation; a writer that finds itself overtaken gives up. All file access goes
through Hadoop's file system API, so the root may be on any store that Spark can write.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.schemas import STATE_KEYS, STATE_TABLES

#: Age after which a claim counts as that of a dead writer. A claim is made when all data are written, just before the manifest.
CLAIM_MS = 60_000
#: Tables that a commit writes at a time.
WRITERS = 4
#: Deltas of a table that are kept apart, and what they may weigh: this many bytes, or a quarter of the base if that is more.
MOST_DELTAS, DELTA_BYTES, DELTA_SHARE = 8, 64 << 20, 4


@dataclass(frozen=True)
class Change:
    """Rows to put in place of those of their keys (one row a key), and rows whose keys are deleted first."""

    upserts: DataFrame | None = None
    deletes: DataFrame | None = None


@dataclass(frozen=True)
class Staged(Change):
    """A change that is written already: its rows are read from its files, which a commit then only has to name."""

    path: str = ""
    size: int = 0
    rows: int = 0
    seq: int = 0


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, now_ms: Callable[[], int] = lambda: int(time.time() * 1000)):
        """read_only fails if there is nothing yet, and never writes."""
        self.spark, self.root, self.read_only, self.now_ms = spark, root.rstrip("/"), read_only, now_ms
        #: Rows that the last commit wrote, by table.
        self.written: dict[str, int] = {}
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._manifest()[0]:
            if read_only:
                raise FileNotFoundError(f"no state under {root}")
            self.commit({name: spark.createDataFrame([], schema) for name, schema in STATE_TABLES.items()})

    # ---- files ----

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _names(self, folder: str) -> dict[str, int]:
        """Names in a folder, with the times of their last change."""
        path = self._path(f"{self.root}/{folder}")
        return {s.getPath().getName(): s.getModificationTime() for s in self._fs.listStatus(path)} if self._fs.exists(path) else {}

    def _manifest(self, version: int | None = None) -> tuple[int, dict]:
        version = max((int(n) for n in self._names("manifests") if n.isdigit()), default=0) if version is None else version
        if not version:
            return 0, {"tables": {}, "batch": None}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version:012d}"))
        try:
            return version, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _claim(self, version: int) -> int:
        """Generation of our claim for a version; raises if another writer is at it or has made it."""
        names = self._names("manifests")
        held = sorted(n for n in names if n.startswith(f".claim-{version:012d}-"))
        if f"{version:012d}" in names or held and self.now_ms() - names[held[-1]] < CLAIM_MS:
            raise RuntimeError("another writer committed first")
        generation = int(held[-1].rsplit("-", 1)[1]) + 1 if held else 0
        if not self._fs.createNewFile(self._path(f"{self.root}/manifests/.claim-{version:012d}-{generation:06d}")):
            raise RuntimeError("another writer committed first")
        return generation

    def _publish(self, version: int, manifest: dict) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        generation = self._claim(version)
        temp = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temp)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        names = self._names("manifests")
        claims = sorted(n for n in names if n.startswith(f".claim-{version:012d}-"))
        mine = f"{version:012d}" not in names and claims[-1:] == [f".claim-{version:012d}-{generation:06d}"]
        if not mine or not self._fs.rename(temp, self._path(f"{self.root}/manifests/{version:012d}")):
            self._fs.delete(temp, False)
            raise RuntimeError("another writer took over" if not mine else "the manifest could not be put in place")
        for c in claims:
            self._fs.delete(self._path(f"{self.root}/manifests/{c}"), False)

    # ---- tables ----

    @staticmethod
    def _schema(name: str):
        return STATE_TABLES[name.split("@")[0]]

    @staticmethod
    def _keys(name: str) -> list[str]:
        return STATE_KEYS[name.split("@")[0]]

    @property
    def version(self) -> int:
        return self._manifest()[0]

    @property
    def viewed(self) -> bool:
        """Whether the index view is in step with embeddings and labels."""
        return bool(self._manifest()[1].get("viewed"))

    def _rows_of(self, name: str, *deltas: str) -> DataFrame:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._schema(name).fields) + ", _op int, _seq bigint"
        return self.spark.read.schema(ddl).parquet(*deltas)

    def _latest(self, name: str, deltas: list[str]) -> DataFrame:
        """The last row of each key among deltas, with _op (1: upsert, 0: delete) and _seq."""
        fields = self._schema(name).fieldNames()
        rows = self._rows_of(name, *deltas)
        return rows.groupBy(*self._keys(name)).agg(F.max_by(F.struct(*fields, "_op", "_seq"), F.struct("_seq", "_op")).alias("r")).select("r.*")

    def _merged(self, name: str, entry: dict | None) -> DataFrame:
        schema = self._schema(name)
        base = self.spark.read.schema(schema).parquet(entry["base"]) if entry and entry["base"] else self.spark.createDataFrame([], schema)
        if not entry or not entry["deltas"]:
            return base
        last, keys = self._latest(name, entry["deltas"]), self._keys(name)
        kept = base.join(last.select(*keys), keys, "left_anti").select(schema.fieldNames())
        return kept.unionByName(last.where("_op = 1").select(schema.fieldNames()))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The table's rows, now or at a version that was not vacuumed; a table that the store lacks is empty."""
        return self._merged(name, self._manifest(version)[1]["tables"].get(name))

    def _write(self, name: str, df: DataFrame, kind: str) -> tuple[str, int, int]:
        """A new folder with df: its path, bytes and rows."""
        path = f"{self.root}/tables/{name}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        rows = self.spark.read.schema(df.schema).parquet(path).count()
        return path, self._fs.getContentSummary(self._path(path)).getLength(), rows

    def _delta(self, name: str, change: Change, seq: int) -> DataFrame:
        schema, parts = self._schema(name), []
        if change.deletes is not None:
            keys = change.deletes.select(*self._keys(name)).distinct()
            parts.append(keys.select(*[(F.col(f.name) if f.name in self._keys(name) else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(0).alias("_op")))
        if change.upserts is not None:
            parts.append(change.upserts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(1).alias("_op")))
        return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).withColumn("_seq", F.lit(seq).cast("bigint"))

    def stage(self, changes: dict[str, Change]) -> dict[str, Staged]:
        """Writes changes without committing them, so that others can be derived from what was written and not from the
        plans behind it. Tables are written side by side: most changes are small, and their jobs would wait for one
        another's start."""
        seq = self.version + 1

        def one(job: tuple[str, Change]) -> tuple[str, Staged]:
            name, change = job
            if isinstance(change, Staged):
                return name, change
            path, size, rows = self._write(name, self._delta(name, change, seq), "delta")
            back = self._rows_of(name, path)
            return name, Staged(back.where("_op = 1").select(self._schema(name).fieldNames()), back.where("_op = 0").select(*self._keys(name)), path, size, rows, seq)

        with ThreadPoolExecutor(max(1, min(WRITERS, len(changes)))) as pool:
            return dict(pool.map(one, changes.items()))

    def _tidied(self, name: str, entry: dict, most: int, share: int) -> dict:
        """entry with its deltas merged among themselves or into the base where they are too many or too heavy."""
        weight = sum(entry["bytes"][d] for d in entry["deltas"])
        if entry["deltas"] and weight > max(DELTA_BYTES, entry["bytes"].get(entry["base"], 0) // share if share else 0):
            path, size, _ = self._write(name, self._merged(name, entry), "base")
            return {"base": path, "deltas": [], "bytes": {path: size}}
        if len(entry["deltas"]) > most:
            path, size, _ = self._write(name, self._latest(name, entry["deltas"]), "delta")
            base = {entry["base"]: entry["bytes"][entry["base"]]} if entry["base"] else {}
            return {"base": entry["base"], "deltas": [path], "bytes": {**base, path: size}}
        return entry

    def has_batch(self, batch_id: int | None) -> bool:
        """Whether this batch, or a later one, was committed."""
        last = self._manifest()[1]["batch"]
        return batch_id is not None and last is not None and batch_id <= last

    def names(self) -> set[str]:
        """Tables that the store has."""
        return set(self._manifest()[1]["tables"])

    def commit(self, tables: dict[str, DataFrame] | None = None, batch_id: int | None = None, changes: dict[str, Change] | None = None, promote: dict[str, str] | None = None, at: int | None = None) -> int:
        """In one step: replaces tables, applies changes, puts tables (promote: name -> other name) in the place of others.
        A batch_id that was committed before changes nothing: replays are harmless. Changes without rows write nothing. at:
        the version that all of this is derived from; if the store is past it, nothing is done and RuntimeError raised."""
        if self.read_only:
            raise PermissionError("the store is read-only")
        version, old = self._manifest()
        if self.has_batch(batch_id):
            return version
        if at is not None and at != version:
            raise RuntimeError("another writer committed first")
        new, self.written = dict(old["tables"]), {}
        for name, df in (tables or {}).items():
            path, size, self.written[name] = self._write(name, df.select(self._schema(name).fieldNames()), "base")
            new[name] = {"base": path, "deltas": [], "bytes": {path: size}}
        staged = self.stage(changes or {})
        if any(s.seq != version + 1 for s in staged.values()):
            raise RuntimeError("another writer committed first")
        for name, s in staged.items():
            self.written[name] = s.rows
            if not s.rows:
                self._fs.delete(self._path(s.path), True)
            else:
                entry = new.get(name) or {"base": None, "deltas": [], "bytes": {}}
                new[name] = self._tidied(name, {"base": entry["base"], "deltas": [*entry["deltas"], s.path], "bytes": {**entry["bytes"], s.path: s.size}}, MOST_DELTAS, DELTA_SHARE)
        for name, other in (promote or {}).items():
            new[name] = new.pop(other)
        if new == old["tables"] and batch_id is None:
            return version
        # The index view is in step if it came along with whatever it depends on.
        given = {*(tables or {}), *(promote or {}), *(n for n, c in staged.items() if c.rows or n == "index_view")}
        viewed = "index_view" in given or bool(old.get("viewed")) and not given & {"embeddings", "labels"}
        self._publish(version + 1, {"tables": new, "batch": old["batch"] if batch_id is None else batch_id, "viewed": viewed})
        return version + 1

    def compact(self, *names: str) -> int:
        """Merges all deltas of these tables (of all, without names) into their bases."""
        entries = self._manifest()[1]["tables"]
        tables = {n: self.table(n) for n in names or entries if entries[n]["deltas"]}
        if self.viewed:  # no row changes, so the view stays in step
            tables.setdefault("index_view", self.table("index_view"))
        return self.commit(tables)

    def vacuum(self) -> int:
        """Deletes folders of tables that the present version does not name, and older manifests; how many folders.
        To be run while no reader of an older version and no writer is at work."""
        version, manifest = self._manifest()
        kept = {p.rsplit("/", 1)[1] for e in manifest["tables"].values() for p in e["bytes"]}
        gone = 0
        for name in self._names("tables"):
            for folder in self._names(f"tables/{name}").keys() - kept:
                self._fs.delete(self._path(f"{self.root}/tables/{name}/{folder}"), True)
                gone += 1
        for n in self._names("manifests"):
            if n.isdigit() and int(n) < version:
                self._fs.delete(self._path(f"{self.root}/manifests/{n}"), False)
        return gone

    # ---- labels and metadata ----

    def rename_label(self, old: str, new: str) -> int:
        """How many rows of labels now have the new name."""
        self.commit(changes={"labels": Change(self.table("labels").where(F.col("label_name") == old).withColumn("label_name", F.lit(new)))})
        return self.written["labels"]

    def remove_labels_by_name(self, names: list[str]) -> int:
        """How many rows of labels went; their vectors stay."""
        self.commit(changes={"labels": Change(deletes=self.table("labels").where(F.col("label_name").isin(list(names))))})
        return self.written["labels"]

    def message_ids_by_label(self, name: str) -> DataFrame:
        return self.table("labels").where(F.col("label_name") == name).select("message_id")

    def embedding(self, message_id: str) -> list[float] | None:
        row = self.table("embeddings").where(F.col("message_id") == message_id).select("vector").first()
        return row and row[0]

    def get_meta(self, key: str) -> str | None:
        row = self.table("meta").where(F.col("key") == key).select("value").first()
        return row and row[0]

    def meta_change(self, values: dict[str, str]) -> Change:
        """These keys of the meta table, to be committed with whatever must change at the same time."""
        return Change(self.spark.createDataFrame(list(values.items()), STATE_TABLES["meta"]))

    def pin_boundary(self, history_id: str, now_ms: int, restart: bool = True) -> None:
        """Boundary, cursor and its time in one commit; at a first start also the start time and status."""
        values = {"boundary_history_id": history_id, "last_processed_history_id": history_id, "last_processed_at": str(now_ms)}
        self.commit(changes={"meta": self.meta_change(values | ({"bootstrap_started_at": str(now_ms), "bootstrap_status": "in_progress"} if restart else {}))})

    def ensure_boundary(self, watch: Callable[[], str], now_ms: int) -> str:
        """The boundary, pinned at the watch's id if there is none yet; a cursor that is missing beside a boundary is set to
        it, so that nothing after the boundary is skipped."""
        boundary = self.get_meta("boundary_history_id")
        if boundary is None:
            boundary = watch()
            self.pin_boundary(boundary, now_ms)
        elif self.get_meta("last_processed_history_id") is None:
            self.commit(changes={"meta": self.meta_change({"last_processed_history_id": boundary, "last_processed_at": str(now_ms), "bootstrap_status": "in_progress"})})
        return boundary

    def set_cursor(self, history_id: str, now_ms: int) -> None:
        self.commit(changes={"meta": self.meta_change({"last_processed_history_id": history_id, "last_processed_at": str(now_ms)})})
