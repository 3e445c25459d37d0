"""The outbox's way out: a data source that writes actions for the mailbox in two phases.

Tasks write their rows to files of their own under `staged`. The driver's commit makes them visible by one rename, of a list
of the files that belong to a delivery, and a delivery's list exists once: a task that failed and ran again, or a delivery
that is repeated after a crash, adds nothing. Rows leave the store's outbox when their delivery is visible; an action is
known by message and batch, and one that was delivered before is not sent again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from labelflow.schemas import OUTBOX
from labelflow.sources.store import Change, SnapshotStore

ACTION = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OUTBOX.fields)


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class MailboxActions(DataSource):
    """Options: root (a folder that tasks and driver share), delivery (its name)."""

    @classmethod
    def name(cls) -> str:
        return "mailbox_actions"

    def schema(self) -> str:
        return ACTION

    def writer(self, schema, overwrite: bool) -> _ActionWriter:
        return _ActionWriter(self.options["root"], self.options["delivery"], schema.fieldNames())


class _ActionWriter(DataSourceWriter):
    def __init__(self, root: str, delivery: str, columns: list[str]):
        self.root, self.delivery, self.columns = root, delivery, columns

    def _at(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.root)

    def write(self, rows) -> _Written:
        """Phase one, in a task: a file that no other attempt has the name of."""
        fs, path = self._at()
        file, n = f"{self.delivery}-{uuid.uuid4().hex}.json", 0
        fs.create_dir(f"{path}/staged", recursive=True)
        with fs.open_output_stream(f"{path}/staged/{file}") as out:
            for row in rows:
                out.write((json.dumps(dict(zip(self.columns, row))) + "\n").encode())
                n += 1
        return _Written(file, n)

    def commit(self, messages: list) -> None:
        """Phase two, on the driver: the delivery's list of files, which are as many as tasks, under its name."""
        fs, path = self._at()
        fs.create_dir(f"{path}/deliveries", recursive=True)
        mine, done = f"{path}/deliveries/.{uuid.uuid4().hex}", f"{path}/deliveries/{self.delivery}"
        if fs.get_file_info(done).type != pafs.FileType.NotFound:
            return self.abort(messages)
        with fs.open_output_stream(mine) as out:
            out.write("".join(f"{m.file}\n" for m in messages if m and m.rows).encode())
        fs.move(mine, done)

    def abort(self, messages: list) -> None:
        fs, path = self._at()
        for m in messages:
            if m is not None:
                fs.delete_file(f"{path}/staged/{m.file}")


def delivered(spark: SparkSession, root: str) -> DataFrame:
    """Actions of all visible deliveries; what an attempt that was never committed left behind is not among them."""
    lists = spark.read.schema("file string").option("recursiveFileLookup", "true").csv(f"{root}/deliveries") if _exists(spark, f"{root}/deliveries") else None
    if lists is None:
        return spark.createDataFrame([], OUTBOX)
    rows = spark.read.schema(ACTION).json(f"{root}/staged")
    name = F.element_at(F.split(rows.metadataColumn("_metadata")["file_path"], "/"), -1)
    return rows.withColumn("_file", name).join(lists.select(F.col("file").alias("_file")), "_file", "left_semi").select(OUTBOX.fieldNames())


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def deliver(store: SnapshotStore, root: str) -> int:
    """Sends what is in the outbox and takes it out; how many actions went. Safe to repeat after a failure at any point."""
    spark = store.spark
    spark.dataSource.register(MailboxActions)
    version = store.version
    asked = store.table("outbox", version)
    new = asked.join(delivered(spark, root).select("message_id", "batch"), ["message_id", "batch"], "left_anti").select(OUTBOX.fieldNames())
    new.write.format("mailbox_actions").mode("append").options(root=root, delivery=f"v{version:012d}").save()
    store.commit(changes={"outbox": Change(deletes=asked)})
    return store.written["outbox"]
