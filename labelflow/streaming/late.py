"""Late rows of a stream as a side output, and their way into the gap set.

A row is late if the newest event time that came in before the full hour of its own arrival is more than the delay ahead
of its event time. The watermark moves on at full hours of arrival, whatever the cut into micro-batches, so a replay and
another cut give the same rows. The log must be in order of arrival, by the hour. Every row gets one route: on_time, late,
or undated (no event time or no arrival), so the outputs add up to what was read; repeated rows each get their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelflow.operators import lifecycle
from labelflow.schemas import RECOVERY_WINDOW_MS
from labelflow.sources.store import Change, SnapshotStore


def arrival_hours(rows: DataFrame, event: str, arrived: str) -> DataFrame:
    """(hour, newest): the newest event time of each hour of arrival. As long as the log is in hours."""
    dated = rows.where(F.col(event).isNotNull() & F.col(arrived).isNotNull())
    return dated.groupBy(F.date_trunc("hour", arrived).cast("timestamp_ntz").alias("hour")).agg(F.max(F.col(event).cast("timestamp_ntz")).alias("newest"))


def carried(hours: DataFrame) -> DataFrame:
    """hours cut down to what later rows need: the last hour, and the newest event time of all hours before it."""
    last = hours.agg(F.max_by(F.struct("hour", "newest"), "hour").alias("last"))
    last = last.select(F.col("last.hour").alias("hour"), F.col("last.newest").alias("newest")).where("hour is not null")
    before = hours.join(last.select(F.col("hour").alias("_last")), F.col("hour") < F.col("_last"))
    return last.unionByName(before.agg(F.max("hour").alias("hour"), F.max("newest").alias("newest")).where("hour is not null"))


def routed(rows: DataFrame, hours: DataFrame, event: str, arrived: str, delay_ms: int = RECOVERY_WINDOW_MS) -> DataFrame:
    """rows with their route; hours: those of these rows and what was carried from earlier ones. rows must have no columns
    route and _hour; others may have any names."""
    ahead = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    marks = hours.select(F.col("hour").alias("_hour"), (F.max("newest").over(ahead) - F.expr(f"INTERVAL '{delay_ms / 1000}' SECOND")).alias("_mark"))
    placed = rows.withColumn("_hour", F.date_trunc("hour", arrived).cast("timestamp_ntz")).join(marks, "_hour", "left")
    time = F.col(event).cast("timestamp_ntz")
    route = F.when(time.isNull() | F.col(arrived).isNull(), "undated").when(time < F.col("_mark"), "late").otherwise("on_time")
    return placed.withColumn("route", route).select(*[rows[c] for c in rows.columns], "route")


class LateSplit:
    """Routes the micro-batches of a log under a work folder: rows to out/batch=N/route=R, and beside them the hours that
    batch N + 1 needs, so a batch that is run again reads the same state and writes the same rows over its own."""

    def __init__(self, spark: SparkSession, work: str, event: str, arrived: str, delay_ms: int = RECOVERY_WINDOW_MS):
        self.spark, self.work, self.event, self.arrived, self.delay_ms = spark, work.rstrip("/"), event, arrived, delay_ms
        self.schema = None

    def _hours(self, path: str) -> DataFrame:
        return self.spark.read.schema("hour timestamp_ntz, newest timestamp_ntz").parquet(path)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        here = f"{self.work}/hours/{batch_id}"
        hours = arrival_hours(batch, self.event, self.arrived)
        if batch_id:
            hours = hours.unionByName(self._hours(f"{self.work}/hours/{batch_id - 1}/carried"))
        hours.groupBy("hour").agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{here}/all")
        hours = self._hours(f"{here}/all")
        out = routed(batch, hours, self.event, self.arrived, self.delay_ms)
        out.write.mode("overwrite").partitionBy("route").parquet(f"{self.work}/out/batch={batch_id}")
        carried(hours).write.mode("overwrite").parquet(f"{here}/carried")

    def run(self, log: str, schema) -> None:
        """Takes the files of a log that are new since the last run."""
        stream = self.spark.readStream.schema(schema).parquet(log)
        stream.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        self.schema = schema

    def rows(self) -> DataFrame:
        """All rows with their route; a filter on the route reads that output alone."""
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        return self.spark.read.schema(f"{ddl}, batch int, route string").parquet(f"{self.work}/out").drop("batch")


def park_late(store: SnapshotStore, late: DataFrame, last_processed_at_ms: int | None, boundary: str) -> int:
    """Parks messages of late rows (message_id, sent_s) that nobody knows yet and that were sent after the cursor's time,
    as the gap set of a resync; how many. A message that is parked already keeps its row, one without an id is left out."""
    ids = late.where("message_id is not null").select(F.col("message_id").cast("string").alias("message_id"), "sent_s")
    gap = lifecycle.gap_message_ids(ids, store.table("labels"), last_processed_at_ms).select("message_id").distinct()
    new = gap.join(store.table("pending_new"), "message_id", "left_anti").join(store.table("applied"), "message_id", "left_anti")
    store.commit(changes={"pending_new": Change(new.select("message_id", F.lit(boundary).alias("first_seen_history_id"), F.lit("late").alias("reason")))})
    return store.written["pending_new"]
