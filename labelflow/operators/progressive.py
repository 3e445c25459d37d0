"""The progressive build: a work list worked off in batches that are admitted by the vectors they will cost.

A row costs a vector if its message has none yet and stands in the list for the first time. A batch takes the next rows
until it has cost what it may; rows without cost go along and do not count. Which row is in which batch is computed once,
by sums over the list's positions, and stored with the list; a batch's effects and the position after it are one commit,
so a build that is interrupted anywhere goes on with the first batch that had no effect.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.operators import live, maturity, worklist
from labelflow.operators.index_view import IndexView
from labelflow.schemas import BATCH_ROWS, PROGRESS_EVERY, STATE_SCHEMA_VERSION
from labelflow.sources.store import Change, SnapshotStore

#: Positions that one task adds up; sums of this many chunks are added up a level higher.
CHUNK = 4096


def running_total(rows: DataFrame, value: str, total: str, chunk: int = CHUNK) -> DataFrame:
    """rows (pos, ...), pos dense from 0, with the sum of value up to and including each pos. No task gets more than chunk
    rows: chunks are added up on their own, and their sums in the same way."""
    placed = rows.withColumn("_chunk", F.expr(f"pos div {chunk}"))
    top = placed.agg(F.max("_chunk")).first()[0] or 0
    sums = placed.groupBy(F.col("_chunk").alias("pos")).agg(F.sum(value).alias("_sum"))
    if top:
        sums = running_total(sums, "_sum", "_upto", chunk) if top >= chunk else sums.withColumn("_upto", F.sum("_sum").over(Window.orderBy("pos")))
    else:
        sums = sums.withColumn("_upto", F.col("_sum"))
    before = sums.select(F.col("pos").alias("_chunk"), (F.col("_upto") - F.col("_sum")).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_chunk").orderBy("pos"))
    return placed.withColumn("_inside", inside).join(before, "_chunk").withColumn(total, F.col("_before") + F.col("_inside")).select(*rows.columns, total)


def admitted(planned: DataFrame, embedded: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """planned (pos dense from 0, message_id, ...) with cost (0 or 1) and batch; a batch costs at most rows. embedded:
    (message_id, ...) of those that have a vector."""
    first = planned.groupBy("message_id").agg(F.min("pos").alias("pos")).join(embedded.select("message_id").distinct(), "message_id", "left_anti")
    priced = planned.join(first.select("pos", F.lit(1).alias("_new")), "pos", "left").withColumn("cost", F.coalesce("_new", F.lit(0))).drop("_new")
    # greatest: rows before the first one that costs anything are in batch 0
    return running_total(priced, "cost", "_total").withColumn("batch", F.expr(f"greatest(_total - 1, 0) div {rows}")).drop("_total")


def batches(work: DataFrame, every: int = PROGRESS_EVERY) -> DataFrame:
    """(batch, n_rows, to_embed, last_pos, progress) of an admitted list. progress: the position that is reported after the
    batch, snapped down to a multiple of every, where it passes one; null elsewhere, and after the last batch."""
    per = work.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cost").alias("to_embed"), F.max("pos").alias("last_pos"))
    snapped = lambda c: c - c % every
    before = per.select((F.col("batch") + 1).alias("batch"), (F.col("last_pos") + 1).alias("_before"))
    after = per.select((F.col("batch") - 1).alias("batch"), F.lit(True).alias("_more"))
    at, was = snapped(F.col("last_pos") + 1), snapped(F.coalesce("_before", F.lit(0)))
    return per.join(before, "batch", "left").join(after, "batch", "left").select("batch", "n_rows", "to_embed", "last_pos", F.when(F.col("_more") & (at > was), at).alias("progress"))


class ProgressiveBuild:
    """Builds the labelled set of a store batch by batch. embed: see operators.live. Messages that have a vector are left
    alone; of several places of a message the first counts; messages that no longer exist lose their label."""

    def __init__(self, store: SnapshotStore, embed: live.Embed, rows: int = BATCH_ROWS, clock: Callable[[], float] = time.monotonic):
        self.store, self.embed, self.rows, self.clock = store, embed, rows, clock

    def _position(self) -> int | None:
        at = self.store.get_meta("work_position")
        return None if at is None else int(at)

    def plan(self, listing: Callable[[], DataFrame]) -> int:
        """Number of batches. The work list is asked for and stored only if none is: a second start goes on with the first
        one's list."""
        if self._position() is None:
            planned = listing().withColumn("message_id", F.col("message_id").cast("string")).persist()
            work = admitted(planned, self.store.table("embeddings"), self.rows).sort("pos").persist()
            try:
                n = work.agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
                self.store.commit({"work_list": work}, changes={"meta": self.store.meta_change({"work_position": "0", "work_batches": str(n), "bootstrap_status": "in_progress"})})
            finally:
                work.unpersist()
                planned.unpersist()
        return int(self.store.get_meta("work_batches"))

    def done(self) -> bool:
        at = self._position()
        return at is not None and at >= int(self.store.get_meta("work_batches"))

    def run_batch(self) -> int:
        """Works off the next batch; how many messages got a vector."""
        if self.done():
            return 0
        at = self._position()
        if at is None:
            raise RuntimeError("there is no work list yet")
        view = IndexView(self.store).in_step()
        embeddings = self.store.table("embeddings")
        todo = worklist.first_wins(self.store.table("work_list").where(F.col("batch") == at)).join(embeddings.select("message_id"), "message_id", "left_anti")
        vectors = self.embed(todo.select("message_id")).select("message_id", "vector").persist()
        try:
            alive = todo.join(vectors.select("message_id"), "message_id", "left_semi").select("message_id", "label_id", "label_name", "source")
            gone = todo.join(vectors.select("message_id"), "message_id", "left_anti")
            view.apply({"labels": Change(alive, gone), "embeddings": Change(vectors), "meta": self.store.meta_change({"work_position": str(at + 1)})})
            return self.store.written["embeddings"]
        finally:
            vectors.unpersist()

    def run_for(self, seconds: float) -> int:
        """Batches until the time is used up, one at least; how many vectors."""
        until, n = self.clock() + seconds, self.run_batch()
        while not self.done() and self.clock() < until:
            n += self.run_batch()
        return n

    def is_mature(self) -> bool:
        """Whether the index has enough of each label that the work list offers; never before there is a list."""
        if self._position() is None:
            return False
        available = worklist.available_counts(self.store.table("work_list")).withColumnRenamed("label_name", "label")
        return maturity.is_open(maturity.gate(available), IndexView(self.store).in_step().counts()).first()[0]

    def finalise(self, account: str, fingerprint: str, excluded_hash: str) -> bool:
        """Marks the state complete, with what it is bound to, in one commit once all batches are done; whether it is."""
        if not self.done():
            return False
        if self.store.get_meta("bootstrap_status") != "complete":
            values = {"account_id": account, "ml_fingerprint": fingerprint, "excluded_hash": excluded_hash, "schema_version": STATE_SCHEMA_VERSION, "bootstrap_status": "complete"}
            self.store.commit(changes={"meta": self.store.meta_change(values)})
        return True
