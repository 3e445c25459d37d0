"""From messages to labels: what the service does with new mail, and the batch jobs that build and mend its state.

Messages are rows (message_id, ...); `embed` turns rows with a message_id into (message_id, vector) and leaves out messages
that no longer exist. Functions of tables return new tables; those that take a store make one commit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.functions import text
from labelflow.functions.vector import Embedder, embed_rows
from labelflow.operators import keyed, knn, lifecycle, registry, vote
from labelflow.operators.index_view import IndexView, label_counts
from labelflow.operators.keyed import index_join
from labelflow.schemas import SKIP
from labelflow.sources.store import Change, SnapshotStore

Embed = Callable[[DataFrame], DataFrame]


def message_vectors(messages: DataFrame, embedder: Embedder) -> Embed:
    """An embedder of parsed messages: body normalised, one text per message, one vector per text."""

    def run(ids: DataFrame) -> DataFrame:
        body = text.normalise_body(F.col("body_html"))
        said = text.text_representation(F.col("from_name"), F.col("from_address"), F.col("subject"), body, F.col("list_id"))
        mine = messages.join(ids.select("message_id").distinct(), "message_id", "left_semi").select("message_id", said.alias("said"))
        return embed_rows(mine, "said", embedder, ("message_id",))

    return run


def new_vectors(ids: DataFrame, embeddings: DataFrame, embed: Embed) -> DataFrame:
    """(message_id, vector) of those ids that have no vector in embeddings yet."""
    return embed(lifecycle.to_embed(ids.select("message_id").distinct(), embeddings)).select("message_id", "vector")


def missing_vectors(ids: DataFrame, embeddings: DataFrame, embed: Embed) -> DataFrame:
    """embeddings with the vectors of ids that lacked one; those that exist are never made again."""
    return embeddings.unionByName(new_vectors(ids, embeddings, embed).select(embeddings.columns))


def classify_new(fresh: DataFrame, index: DataFrame, labels: DataFrame, embed: Embed) -> DataFrame:
    """message_id, label, label_id, confidence, action, applied and vector of every fresh message that still exists.
    index: (id, vector, label), which the fresh messages are no part of; labels: the registry."""
    q = embed(fresh).select(F.col("message_id").alias("id"), "vector")
    near = knn.neighbours_blocked(q, index.join(q.select("id"), "id", "left_anti"), exclude_self=True)
    verdicts = vote.apply_gate(vote.classify(q, index, near), labels)
    return verdicts.join(q.withColumnRenamed("id", "query_id"), "query_id").select(F.col("query_id").alias("message_id"), "label", F.when(F.col("applied"), F.col("label_id")).alias("label_id"), "confidence", "action", "applied", "vector")


def outbox(results: DataFrame) -> DataFrame:
    """(message_id, add_label, remove_label): what the mailbox is to be told; a labelled message leaves the inbox."""
    return results.where("applied").select("message_id", F.col("label_id").alias("add_label"), F.lit("INBOX").alias("remove_label"))


def back_to_inbox(ids: DataFrame) -> DataFrame:
    """Outbox rows that put messages into the inbox again."""
    return ids.select("message_id", F.lit("INBOX").alias("add_label"), F.lit(None).cast("string").alias("remove_label"))


def learnt(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of labels and embeddings that the results add: messages without a label are rejects to learn from."""
    kept = results.where("action = 'no_label'")
    return kept.select("message_id", F.lit(SKIP).alias("label_id"), F.lit(SKIP).alias("label_name"), F.lit("auto").alias("source")), kept.select("message_id", "vector")


def bootstrap(planned: DataFrame, labels: DataFrame, embeddings: DataFrame, embed: Embed) -> tuple[DataFrame, DataFrame]:
    """labels and embeddings after a work list (pos, message_id, label_id, label_name, source), or a batch of it: messages
    that no longer exist get neither, the last place of a message counts, and a list may be worked off again."""
    vectors = missing_vectors(planned, embeddings, embed)
    alive = planned.join(vectors.select("message_id"), "message_id", "left_semi")
    return keyed.upsert(labels, alive.withColumn("seq", F.col("pos")), "message_id"), vectors


def rebuild(labels: DataFrame, embed: Embed) -> DataFrame:
    """embeddings of all labelled messages by a new model; those that no longer exist have none and stop voting."""
    return embed(labels.select("message_id"))


def rebuild_beside(store: SnapshotStore, embed: Embed, fingerprint: str, most_rounds: int = 10) -> int:
    """Vectors of all labelled messages by a new model, made beside the live ones and put in their place by one manifest,
    together with the fingerprint. Messages that are labelled meanwhile are caught up with, round by round; a commit that
    comes between the last round and the swap makes it go round again. How many vectors there are."""
    beside = f"embeddings@{fingerprint}"
    if beside not in store.names():
        store.commit({beside: rebuild(store.table("labels"), embed)})
    for _ in range(most_rounds):
        version = store.version
        late = new_vectors(store.table("labels", version), store.table(beside, version), embed)
        store.commit(changes={beside: Change(late)})
        if store.written.get(beside) or store.version != version:
            continue
        vectors = store.table(beside)
        view = index_join(vectors, store.table("labels", version)).select("message_id", "index_label")
        try:
            store.commit({"index_view": view, "index_counts": label_counts(view)}, changes={"meta": store.meta_change({"ml_fingerprint": fingerprint})}, promote={"embeddings": beside}, at=version)
            return vectors.count()
        except RuntimeError:
            continue
    raise RuntimeError("labels change faster than they are caught up with")


def back_in_inbox(store: SnapshotStore, diff: DataFrame) -> int:
    """Puts a registry diff into effect: renamed labels in the store, rows of deleted ones as rejects, and their messages
    into the inbox again through the outbox, all in one commit; they count as seen. How many messages went back."""
    labels = store.table("labels")
    after, gone = registry.reconcile(labels, diff)
    gone = gone.persist()
    try:
        touched = labels.join(diff.select(F.col("old_name").alias("label_name")), "label_name", "left_semi").select("message_id")
        version = store.version
        orders = back_to_inbox(gone).withColumn("batch", F.lit(version + 1).cast("bigint"))
        IndexView(store).apply({"labels": Change(after.join(touched, "message_id", "left_semi")), "outbox": Change(orders), "applied": Change(gone)})
        return gone.count()
    finally:
        gone.unpersist()


def resync(store: SnapshotStore, desired: DataFrame, embed: Embed, boundary: str, now_ms: int, inbox: DataFrame | None = None, last_processed_at_ms: int | None = None) -> DataFrame:
    """A read-only resync in one commit: labels become the capped snapshot desired (see apply_resync), vectors that lack
    are added, boundary and cursor are pinned anew. Messages of inbox (message_id, sent_s) that came into the gap after
    last_processed_at_ms, both as they were before, are parked and not kept as rejects. Returns them: (message_id, sent_s)."""
    known, embeddings, view = store.table("labels"), store.table("embeddings"), IndexView(store).in_step()
    gap = lifecycle.gap_message_ids(inbox, known, last_processed_at_ms).persist() if inbox is not None else None
    labels, _ = apply_resync(known, embeddings, desired, embed)
    if gap is not None:
        labels = lifecycle.without_gap_rejects(labels, gap)
    same = known.select("message_id", "label_id", "label_name", "source")
    changes = {
        "labels": Change(labels.select(same.columns).exceptAll(same), known.join(labels, "message_id", "left_anti")), "embeddings": Change(new_vectors(desired, embeddings, embed)),
        "meta": store.meta_change({"boundary_history_id": boundary, "last_processed_history_id": boundary, "last_processed_at": str(now_ms)}),
    }
    if gap is not None:
        parked = gap.join(store.table("pending_new"), "message_id", "left_anti")
        changes["pending_new"] = Change(parked.select("message_id", F.lit(boundary).alias("first_seen_history_id"), F.lit("gap").alias("reason")))
    view.apply(changes)
    return known.sparkSession.createDataFrame([], "message_id string, sent_s bigint") if gap is None else gap


def reconcile_exclusions(store: SnapshotStore, included: DataFrame, listing: DataFrame, embed: Embed, excluded_hash: str) -> None:
    """apply_exclusions as one commit of deltas, with the new hash of the excluded names."""
    known, embeddings = store.table("labels"), store.table("embeddings")
    labels, vectors = apply_exclusions(known, embeddings, included, listing, embed)
    added = vectors.join(embeddings.select("message_id"), "message_id", "left_anti")
    changed = labels.select(known.columns).exceptAll(known)
    IndexView(store).apply({"labels": Change(changed, known.join(labels, "message_id", "left_anti")), "embeddings": Change(added), "meta": store.meta_change({"excluded_hash": excluded_hash})})


def apply_exclusions(labels: DataFrame, embeddings: DataFrame, included: DataFrame, listing: DataFrame, embed: Embed) -> tuple[DataFrame, DataFrame]:
    """labels and embeddings after a change of the included labels (label_id, label_name): rows of names that are no
    longer included go, their vectors stay; messages of labels that are new come from listing (pos, message_id, label_id).
    Rejects stay."""
    named = labels.where((F.col("label_id") != SKIP) & F.col("label_name").isNotNull())
    change = registry.exclusion_changes(named, included)
    removed = keyed.delete(labels, change.where("change = 'removed'"), "label_name")
    added = included.join(change.where("change = 'added'"), "label_name", "left_semi")
    new = listing.join(added, "label_id").select("pos", "message_id", "label_id", "label_name", F.lit("user").alias("source"))
    return bootstrap(new, removed, embeddings, embed)


def apply_resync(labels: DataFrame, embeddings: DataFrame, desired: DataFrame, embed: Embed) -> tuple[DataFrame, DataFrame]:
    """labels and embeddings after a read-only resync: the capped snapshot desired (pos, message_id, label_id, label_name,
    source) and nothing else; vectors are kept, also of rows that go, and made where they lack."""
    return bootstrap(desired, labels.where("false"), embeddings, embed)
