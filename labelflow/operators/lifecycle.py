"""Decisions at start-up, recovery from gaps, resynchronisation, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.operators.worklist import last_wins
from labelflow.schemas import BACKOFF_FIRST_S, BACKOFF_MOST_S, RECOVERY_WINDOW_MS, SKIP, STATE_SCHEMA_VERSION


def startup_decision(schema_version: str = STATE_SCHEMA_VERSION) -> Column:
    """From columns bootstrap_status, schema_version, account_id, want_account, fingerprint, want_fingerprint,
    excluded_hash, want_excluded_hash. A state that was never completed is built again before anything else is judged.
    A state without a schema version passes that test; one that is bound to no account, or to another, does not."""
    c = F.col
    differs = lambda a, b: ~c(a).eqNullSafe(c(b))
    return (
        F.when(c("bootstrap_status").isNull() | (c("bootstrap_status") == "in_progress"), "BOOTSTRAP")
        .when(c("schema_version") != schema_version, "INCOMPATIBLE")
        .when(F.coalesce("account_id", F.lit("")).isin("") | differs("account_id", "want_account"), "INCOMPATIBLE")
        .when(differs("fingerprint", "want_fingerprint"), "REBUILD")
        .when(differs("excluded_hash", "want_excluded_hash"), "RECONCILE")
        .otherwise("WARM")
    )


def gap_decision(cursor: Column, last_processed_at: Column, now_ms: Column) -> Column:
    """REPLAY if there is a cursor and it is at most the recovery window old; missing, malformed or future times
    RESYNC."""
    gap = now_ms - last_processed_at.try_cast("bigint")
    return F.when(cursor.isNotNull() & (gap >= 0) & (gap <= RECOVERY_WINDOW_MS), "REPLAY").otherwise("RESYNC")


def next_backoff(seconds: Column) -> Column:
    return F.when(seconds == 0, BACKOFF_FIRST_S).otherwise(F.least(seconds * 2, F.lit(BACKOFF_MOST_S)))


def resync_snapshot(known: DataFrame, desired: DataFrame, embeddings: DataFrame) -> DataFrame:
    """known (message_id, label_id) against the capped snapshot desired (message_id, label_id, label_name, source,
    pos): message_id, label_id, action. Rows outside the snapshot are dropped even if the mailbox still labels them;
    the last of a message's labels counts; vectors that exist are kept."""
    want = last_wins(desired).select("message_id", F.col("label_id").alias("new_id"))
    both = known.select("message_id", F.col("label_id").alias("old_id")).join(want, "message_id", "full_outer").join(embeddings.select("message_id", F.lit(True).alias("has_vector")), "message_id", "left")
    action = F.when(F.col("new_id").isNull(), "drop").when(F.col("has_vector").isNull(), "embed").when(F.col("new_id").eqNullSafe(F.col("old_id")), "keep").otherwise("relabel")
    return both.select("message_id", F.coalesce("new_id", "old_id").alias("label_id"), action.alias("action"))


def gap_message_ids(inbox: DataFrame, known_before: DataFrame, last_processed_at_ms: int | None) -> DataFrame:
    """(message_id, sent_s) of unlabelled inbox messages (message_id, sent_s) since the cursor that were not known
    before it, never cut short. Without a cursor there is no gap to fill."""
    if last_processed_at_ms is None:
        return inbox.where("false")
    return inbox.where(F.col("sent_s") > last_processed_at_ms // 1000).join(known_before.select("message_id"), "message_id", "left_anti")


def without_gap_rejects(labels: DataFrame, gap: DataFrame) -> DataFrame:
    """labels without reject rows that the resync itself gave to gap messages."""
    mine = labels.where(F.col("label_id") == SKIP).join(gap.select("message_id"), "message_id", "left_semi").select("message_id")
    return labels.join(mine, "message_id", "left_anti")


def heartbeat_due(last_processed_at: Column, now_ms: Column) -> Column:
    return now_ms - last_processed_at.try_cast("bigint") >= RECOVERY_WINDOW_MS // 2


def to_embed(planned: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Messages of a work list that have no vector yet."""
    return planned.join(embeddings.select("message_id"), "message_id", "left_anti")
