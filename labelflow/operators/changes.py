"""The change log: new messages, label corrections, movements.

Events are rows (seq, type, message_id, label_ids); seq gives their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.schemas import SKIP

#: System labels: equal to or starting with one of these (fixed values).
SYSTEM_LABELS = ["CATEGORY_", "IMPORTANT", "INBOX", "SENT", "DRAFT", "SPAM", "TRASH", "UNREAD", "STARRED", "CHAT"]


def is_system_label(label_id: Column) -> Column:
    return label_id.rlike("^(?:" + "|".join(SYSTEM_LABELS) + ")")


def explode_history(records: DataFrame) -> DataFrame:
    """Events of change-log records (id, messagesAdded, labelsAdded, labelsRemoved: arrays of struct(message_id,
    label_ids)); within a record in this order. seq has room for 100,000 items of a kind in a record and for ids up to
    9.2e12; a record beyond that is an error, never a wrong order."""
    parts = [records.select("id", F.lit(k).alias("k"), F.posexplode(c), F.lit(c).alias("type")) for k, c in enumerate(("messagesAdded", "labelsAdded", "labelsRemoved"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    seq = F.when((F.col("pos") < 100_000) & F.col("id").between(0, 9_200_000_000_000), F.col("id") * 1_000_000 + F.col("k") * 100_000 + F.col("pos"))
    return out.select(F.coalesce(seq, F.raise_error(F.lit("a change-log record has more items or a larger id than seq can order")).cast("bigint")).alias("seq"), "type", "col.message_id", "col.label_ids")


def new_inbox_ids(events: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(message_id, seq) of messages added to the inbox that were not seen before, once each, at their first event."""
    out = events.where((F.col("type") == "messagesAdded") & F.array_contains("label_ids", "INBOX"))
    if seen is not None:
        out = out.join(seen.select("message_id"), "message_id", "left_anti")
    return out.groupBy("message_id").agg(F.min("seq").alias("seq"))


def relevant_changes(events: DataFrame, registry: DataFrame) -> DataFrame:
    """(message_id, seq, type, label_id, label_name): a row per changed label that is known and not excluded."""
    flat = events.where(F.col("type").isin("labelsAdded", "labelsRemoved")).select("message_id", "seq", "type", F.explode("label_ids").alias("label_id"))
    return flat.join(registry.where("not is_excluded").select("label_id", "label_name"), "label_id")


def change_sets(changes: DataFrame) -> DataFrame:
    """Per message the labels added and removed, and the last added one."""
    added = F.col("type") == "labelsAdded"
    return changes.groupBy("message_id").agg(
        F.sort_array(F.collect_set(F.when(added, F.col("label_id")))).alias("added"),
        F.sort_array(F.collect_set(F.when(~added, F.col("label_id")))).alias("removed"),
        F.max(F.when(added, F.struct("seq", "label_id", "label_name"))).alias("last_added"),
        F.max(F.when(~added, F.struct("seq", "label_id", "label_name"))).alias("last_removed"),
        F.max("seq").alias("seq"),
    )


def suppress_echoes(changes: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes without those of messages that we labelled ourselves, and the tokens left: a token takes all changes of
    its message in the batch and is spent."""
    return changes.join(tokens.select("message_id"), "message_id", "left_anti"), tokens.join(changes.select("message_id"), "message_id", "left_anti")


def label_outcomes(sets: DataFrame, messages: DataFrame, user_labels: DataFrame) -> DataFrame:
    """What each change set does: message_id, op (upsert, skip, remove, gone), label_id, label_name.

    An added label wins over removals whatever their order, the last added over earlier ones. Without an added label,
    the message becomes a reject if no user label (excluded ones count) is left on it, else its row just goes. Messages
    that no longer exist lose their row.
    """
    mine = messages.select("message_id", F.explode_outer("labels").alias("label_id")).join(user_labels.select("label_id", F.lit(True).alias("u")), "label_id", "left")
    left = mine.groupBy("message_id").agg(F.max(F.coalesce("u", F.lit(False))).alias("labelled"))
    op = (
        F.when(F.col("labelled").isNull(), "gone").when(F.size("added") > 0, "upsert").when(~F.col("labelled"), "skip").otherwise("remove")
    )
    rows = sets.join(left, "message_id", "left").withColumn("op", op)
    up = F.col("op") == "upsert"
    return rows.select("message_id", "seq", "op", F.when(up, F.col("last_added.label_id")).when(F.col("op") == "skip", F.lit(SKIP)).alias("label_id"), F.when(up, F.col("last_added.label_name")).when(F.col("op") == "skip", F.lit(SKIP)).alias("label_name"), F.col("last_removed.label_name").alias("from_name"))


def movements(outcomes: DataFrame) -> DataFrame:
    """(source, destination, n): how many messages went from a label (or the inbox) to another (or the inbox)."""
    moved = outcomes.where(F.col("op").isin("upsert", "skip"))
    return moved.groupBy(F.coalesce("from_name", F.lit("inbox")).alias("source"), F.when(F.col("op") == "upsert", F.col("label_name")).otherwise(F.lit("inbox")).alias("destination")).agg(F.count(F.lit(1)).alias("n"))


def apply_outcomes(labels: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The labels table after the outcomes: upserts and rejects replace, removals and vanished messages delete."""
    rest = labels.join(outcomes.select("message_id"), "message_id", "left_anti")
    new = outcomes.where(F.col("op").isin("upsert", "skip")).select("message_id", "label_id", "label_name", F.when(F.col("op") == "upsert", "user").otherwise("auto").alias("source"))
    return rest.unionByName(new)


def unknown_label_ids(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Changed label ids that the registry does not know and that are not the system's: it is to be read again."""
    flat = events.where(F.col("type").isin("labelsAdded", "labelsRemoved")).select(F.explode("label_ids").alias("label_id")).distinct()
    return flat.where(~is_system_label(F.col("label_id"))).join(registry.select("label_id"), "label_id", "left_anti")


def without_user_label(messages: DataFrame, user_labels: DataFrame) -> DataFrame:
    """Messages on which no user label stands, excluded labels among those."""
    held = messages.select("message_id", F.explode("labels").alias("label_id")).join(user_labels.select("label_id"), "label_id", "left_semi")
    return messages.join(held.select("message_id"), "message_id", "left_anti")


def events_for_ids(ids: DataFrame) -> DataFrame:
    """Made-up inbox events for parked messages."""
    return ids.select(F.col("seq"), F.lit("messagesAdded").alias("type"), "message_id", F.array(F.lit("INBOX")).alias("label_ids"))
