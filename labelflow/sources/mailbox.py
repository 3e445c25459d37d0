"""Reading a mailbox that is kept as tables: labels, messages, change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.schemas import HISTORY


def user_labels(labels: DataFrame) -> DataFrame:
    return labels.where("type = 'user'").select("label_id", "label_name")


def message_ids(messages: DataFrame, label_id: str, most: int = 0) -> DataFrame:
    """Ids with a label, newest first; most = 0 means all."""
    out = messages.where(F.array_contains("labels", label_id)).select("message_id", "sent_s").orderBy(F.desc("sent_s"), "message_id")
    return out.limit(most) if most else out


def unlabelled_inbox(messages: DataFrame, user: DataFrame, after_s: int | None = None) -> DataFrame:
    """Inbox messages without any user label, optionally those sent after a time; the time filter reaches the scan."""
    rows = messages.where(F.array_contains("labels", "INBOX"))
    if after_s is not None:
        rows = rows.where(F.col("sent_s") > after_s)
    held = rows.select("message_id", F.explode("labels").alias("label_id")).join(user.select("label_id"), "label_id", "left_semi")
    return rows.join(held.select("message_id"), "message_id", "left_anti")


def history_since(events: DataFrame, cursor: int, oldest: int | None = None) -> DataFrame:
    """Events after a cursor. oldest: the first seq the log still has; a cursor before it has expired."""
    if oldest is not None and cursor < oldest - 1:
        raise LookupError(f"history before {oldest} is gone; cursor is {cursor}")
    return events.where(F.col("seq") > cursor)


def stream_history(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The change log as a stream of Parquet files; the checkpoint is the cursor."""
    return spark.readStream.schema(HISTORY).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def excluded_names(spark: SparkSession, setting: str | None) -> DataFrame:
    """(label_name) of the job parameter that names excluded labels, one a line: names are trimmed, empty ones dropped."""
    lines = spark.createDataFrame([(setting or "",)], "s string").select(F.explode(F.split("s", "\\R")).alias("label_name"))
    return lines.select(F.trim("label_name").alias("label_name")).where("label_name <> ''").distinct()
