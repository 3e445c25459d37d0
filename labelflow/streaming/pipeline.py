"""The change-log consumer as Structured Streaming.

Offsets live in the checkpoint and are committed after foreachBatch returns; a batch's effects go into the snapshot
store under its batch id, so a replayed batch changes nothing: process, persist, then acknowledge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from labelflow.operators import changes, lifecycle, live
from labelflow.operators.index_view import IndexView
from labelflow.schemas import BACKOFF_MOST_S, HISTORY
from labelflow.sources.mailbox import stream_history
from labelflow.sources.shared import new_folder
from labelflow.sources.store import Change, SnapshotStore


class ChangeConsumer:
    """Applies each micro-batch of events to the store: corrections always, but for the echoes of our own labels; new
    messages are parked while the gate is shut and classified once it is open. messages: current mailbox rows
    (message_id, labels).

    With embed (see operators.live), new messages go the whole way: vector, vote against the index view, outbox; the store
    keeps what was applied (seen for good, and an echo to come), rejects with their vectors, and the vectors of corrected
    messages. classify instead maps new (message_id, seq) to rows of labels. A batch commits deltas as large as its own
    effects; tables that it does not change are not written."""

    def __init__(self, store: SnapshotStore, registry: Callable[[], DataFrame], messages: Callable[[], DataFrame], gate_open: Callable[[], bool], classify: Callable[[DataFrame], DataFrame] | None = None, now_ms: Callable[[], int] = lambda: 0, embed: live.Embed | None = None):
        self.store, self.registry, self.messages, self.gate_open, self.classify, self.now_ms, self.embed = store, registry, messages, gate_open, classify, now_ms, embed

    def _verdicts(self, fresh: DataFrame, registry: DataFrame) -> tuple[dict[str, Change], DataFrame | None]:
        """Changes by the classification of fresh (message_id, seq), and results to unpersist."""
        if self.embed is None:
            return {"labels": Change(self.classify(fresh))}, None
        index = IndexView(self.store).rows().select(F.col("message_id").alias("id"), "vector", F.col("index_label").alias("label"))
        results = live.classify_new(fresh, index, registry, self.embed).persist()
        rejects, vectors = live.learnt(results)
        applied = results.where("applied").select("message_id")
        orders = live.outbox(results).withColumn("batch", F.lit(self.store.version + 1).cast("bigint"))
        return {"labels": Change(rejects), "embeddings": Change(vectors), "outbox": Change(orders), "applied": Change(applied), "echoes": Change(applied)}, results

    def drain(self) -> int:
        """Classifies what is parked if the gate is open, without waiting for events; how many messages were parked."""
        pending = self.store.table("pending_new")
        if self.embed is None and self.classify is None or not self.gate_open() or not (n := pending.count()):
            return 0
        IndexView(self.store).in_step()
        changes, results = self._verdicts(pending.select("message_id", F.col("first_seen_history_id").cast("bigint").alias("seq")), self.registry())
        try:
            IndexView(self.store).apply({**changes, "pending_new": Change(deletes=pending)})
        finally:
            if results is not None:
                results.unpersist()
        return n

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch body. Reads the registry afresh, so that renamed and new labels are seen."""
        if batch.isEmpty():
            self.drain()
            return
        view = IndexView(self.store).in_step()
        batch, held = batch.persist(), []
        keep = lambda df: held.append(df.persist()) or held[-1]
        try:
            labels, pending, echoes, embeddings = (self.store.table(t) for t in ("labels", "pending_new", "echoes", "embeddings"))
            registry, messages = self.registry(), self.messages()
            relevant = changes.relevant_changes(batch, registry).withColumn("message_id", F.col("message_id").cast("string"))
            mine, _ = changes.suppress_echoes(relevant, echoes)
            outcomes = keep(changes.label_outcomes(changes.change_sets(mine), messages, registry).withColumn("message_id", F.col("message_id").cast("string")))
            learnt = outcomes.where("op in ('upsert', 'skip')")
            upserts = learnt.select("message_id", "label_id", "label_name", F.when(F.col("op") == "upsert", "user").otherwise("auto").alias("source"))
            done = {"echoes": Change(deletes=echoes.join(relevant.select("message_id"), "message_id", "left_semi")), "pending_new": Change(deletes=pending.join(learnt.select("message_id"), "message_id", "left_semi"))}
            ids = lambda df: df.select("message_id")
            seen = ids(changes.apply_outcomes(labels, outcomes)).unionByName(ids(pending)).unionByName(ids(self.store.table("applied")))
            fresh = changes.new_inbox_ids(batch.withColumn("message_id", F.col("message_id").cast("string")), seen)
            fresh = keep(changes.without_user_label(fresh.join(messages.select("message_id", "labels"), "message_id"), registry).select("message_id", "seq"))
            if not self.gate_open():
                parked = fresh.select("message_id", F.col("seq").cast("string").alias("first_seen_history_id"), F.lit("immature").alias("reason"))
                done["pending_new"] = Change(parked, done["pending_new"].deletes)
            elif self.embed is not None or self.classify is not None:
                # What was parked is classified with the new messages and leaves only in this very commit.
                parked = ids(pending.join(learnt, "message_id", "left_anti")).join(pending, "message_id").select("message_id", F.col("first_seen_history_id").cast("bigint").alias("seq"))
                verdicts, results = self._verdicts(fresh.unionByName(parked), registry)
                held += [results] if results is not None else []
                upserts = upserts.unionByName(verdicts.pop("labels").upserts.select(upserts.columns))
                done |= {**verdicts, "pending_new": Change(deletes=pending)}
                if "echoes" in verdicts:
                    done["echoes"] = Change(verdicts["echoes"].upserts, echoes.join(relevant.select("message_id"), "message_id", "left_semi"))
            done["labels"] = Change(upserts, outcomes.where("op in ('remove', 'gone')"))
            if self.embed is not None:
                vectors = live.new_vectors(learnt, embeddings, self.embed)
                done["embeddings"] = Change(done["embeddings"].upserts.unionByName(vectors) if "embeddings" in done else vectors)
            last = batch.agg(F.max("seq")).first()[0]
            done["meta"] = self.store.meta_change({"last_processed_history_id": str(last), "last_processed_at": str(self.now_ms())})
            view.apply(done, batch_id)
        finally:
            for df in [batch, *held]:
                df.unpersist()

    def start(self, spark: SparkSession, path: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
        """Runs over the files at path; without seconds it takes what is there and ends."""
        writer = stream_history(spark, path).writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def run_with_retries(start: Callable[[], StreamingQuery], is_transient: Callable[[Exception], bool], sleep: Callable[[float], None], most: int = 10) -> None:
    """Restarts a query after transient failures, waiting 5, 10, 20, 40, 60, 60 ... seconds; others are raised."""
    wait = 0
    for attempt in range(most + 1):
        try:
            start().awaitTermination()
            return
        except Exception as e:
            if attempt == most or not is_transient(e):
                raise
            wait = 5 if wait == 0 else min(2 * wait, BACKOFF_MOST_S)
            sleep(wait)


#: Error classes and root causes of a query's failure that a restart may mend.
TRANSIENT = ("java.net.", "java.io.InterruptedIOException", "java.nio.channels.", "org.apache.hadoop.ipc.", "io.grpc.StatusRuntimeException", "TASK_FAILED_WHILE_COMMITTING", "CONCURRENT_")


def transient(error: BaseException) -> bool:
    """Whether a failed query is worth a restart: Python's connection and time-out errors, and Spark's whose error class or
    any cause named in their text is of the network or the store."""
    if isinstance(error, (ConnectionError, TimeoutError)):
        return True
    condition = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    return any(condition.startswith(t) or t in str(error) for t in TRANSIENT)


def recovery(cursor: str | None, last_processed_at: str | None, now_ms: int, spark: SparkSession) -> str:
    """REPLAY or RESYNC at a restart."""
    row = spark.createDataFrame([(cursor, last_processed_at, now_ms)], "c string, a string, n bigint")
    return row.select(lifecycle.gap_decision(F.col("c"), F.col("a"), F.col("n"))).first()[0]


def _as_stream(spark: SparkSession, events: DataFrame, message: str) -> tuple[DataFrame, str]:
    """Events written as a file log, read back as a stream, and the work folder."""
    work = new_folder(spark, "streams")
    rows = events.select("seq", "type", F.col("message_id").cast("string").alias("message_id"), "label_ids")
    rows.repartitionByRange(4, "seq").write.parquet(f"{work}/log")
    return spark.readStream.schema(HISTORY).option("maxFilesPerTrigger", 2).parquet(f"{work}/log"), work


def replay_new_inbox(spark: SparkSession, events: DataFrame, seen: DataFrame) -> DataFrame:
    """new_inbox_ids by micro-batches: each batch's first events are appended, and the least seq of all counts, so files
    may come in any order and batches may be repeated."""
    stream, work = _as_stream(spark, events, "message_id")

    def step(batch: DataFrame, batch_id: int) -> None:
        changes.new_inbox_ids(batch).write.mode("overwrite").parquet(f"{work}/out/batch={batch_id}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("message_id string, seq bigint, batch bigint").parquet(f"{work}/out").groupBy(F.col("message_id").cast("bigint").alias("message_id")).agg(F.min("seq").alias("seq"))
    return found.join(seen.select("message_id"), "message_id", "left_anti")


def keep_last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Last label of a message by seq, whatever order it comes in."""
    last = state.get if state.exists else (-1, "")
    for b in batches:
        i = b["seq"].idxmax()
        if b["seq"][i] > last[0]:
            last = (int(b["seq"][i]), str(b["label_id"][i]))
    state.update(last)
    yield pd.DataFrame({"message_id": [key[0]], "label_id": [last[1]], "seq": [last[0]]})


def replay_label_state(spark: SparkSession, events: DataFrame, registry: DataFrame) -> DataFrame:
    """(message_id, label_id, seq): last added label of each message, kept as keyed state of a stream."""
    stream, work = _as_stream(spark, events, "message_id")
    added = changes.relevant_changes(stream, registry).where("type = 'labelsAdded'").select("message_id", "label_id", "seq")
    kept = added.groupBy("message_id").applyInPandasWithState(keep_last, "message_id string, label_id string, seq bigint", "seq bigint, label_id string", "update", GroupStateTimeout.NoTimeout)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out/batch={batch_id}")

    kept.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("message_id string, label_id string, seq bigint, batch bigint").parquet(f"{work}/out")
    return out.groupBy(F.col("message_id").cast("bigint").alias("message_id")).agg(F.max_by("label_id", "seq").alias("label_id"), F.max("seq").alias("seq"))
