"""The voting set kept up to date by deltas: embeddings joined with labels as a view that is never joined anew.

A change of either side goes through the join as signed rows (message_id, index_label, sign): +1 for what votes now and
did not, -1 for what no longer does; a message with a new label has one of each. Counts per label follow by adding the
signs up. Only keys and labels are read, and only those of messages that changed come out; no vector is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.functions.text import index_label
from labelflow.sources.store import Change, SnapshotStore


def signed_rows(view: DataFrame, embeddings: DataFrame, labels: DataFrame, embedded: Change, labelled: Change) -> DataFrame:
    """(message_id, index_label, sign) by which the view over embeddings and labels changes when they do: view, embeddings
    and labels are the tables before; of a message that is deleted and upserted at once the upsert counts."""
    ids = lambda df: df.select("message_id").distinct()
    none = view.where("false")
    vec_up, vec_gone = (ids(none if d is None else d) for d in (embedded.upserts, embedded.deletes))
    lab_up = (none.select("message_id", F.lit("").alias("label_id"), F.lit("").alias("label_name")) if labelled.upserts is None else labelled.upserts).select("message_id", index_label(F.col("label_id"), F.col("label_name")).alias("new_label"))
    lab_gone = ids(none if labelled.deletes is None else labelled.deletes)
    touched = vec_up.union(vec_gone).union(ids(lab_up)).union(lab_gone).distinct()
    flag = lambda df, name: df.select("message_id", F.lit(True).alias(name))
    # From here on all sides are as large as the change: those of the stored tables are cut down to it first.
    old_label = labels.join(touched, "message_id", "left_semi").select("message_id", index_label(F.col("label_id"), F.col("label_name")).alias("old_label"))
    state = (
        touched.join(old_label, "message_id", "left").join(lab_up, "message_id", "left").join(flag(lab_gone, "lab_gone"), "message_id", "left")
        .join(flag(ids(embeddings.join(touched, "message_id", "left_semi")), "had"), "message_id", "left").join(flag(vec_up, "up"), "message_id", "left").join(flag(vec_gone, "gone"), "message_id", "left")
    )
    votes = F.col("up").isNotNull() | (F.col("had").isNotNull() & F.col("gone").isNull())
    label = F.coalesce("new_label", F.when(F.col("lab_gone").isNull(), F.col("old_label")))
    after = state.where(votes).select("message_id", label.alias("index_label"), F.lit(1).alias("sign")).where("index_label is not null")
    before = view.join(touched, "message_id", "left_semi").select("message_id", "index_label", F.lit(-1).alias("sign"))
    return before.unionByName(after).groupBy("message_id", "index_label").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")


def view_changes(signed: DataFrame, counts: DataFrame) -> dict[str, Change]:
    """What signed rows do to the stored view and to its counts; a label whose count falls to 0 goes."""
    added = signed.where("sign > 0").select("message_id", "index_label")
    gone = signed.where("sign < 0").select("message_id")
    moved = signed.groupBy(F.col("index_label").alias("label")).agg(F.sum("sign").cast("bigint").alias("more"))
    now = moved.join(counts, "label", "left").select("label", (F.coalesce("examples", F.lit(0)) + F.col("more")).alias("examples"), "more")
    return {"index_view": Change(added, gone), "index_counts": Change(now.where("examples > 0 and more <> 0").select("label", "examples"), now.where("examples = 0").select("label"))}


def label_counts(view: DataFrame) -> DataFrame:
    """(label, examples) of a view."""
    return view.groupBy(F.col("index_label").alias("label")).agg(F.count(F.lit(1)).alias("examples"))


class IndexView:
    """The view in a store: what the classifier reads, and the changes that an index takes."""

    def __init__(self, store: SnapshotStore):
        self.store = store

    def in_step(self) -> IndexView:
        """Makes the view anew if the tables were changed without it."""
        if not self.store.viewed:
            self.reload()
        return self

    def rows(self) -> DataFrame:
        """(message_id, vector, index_label) of all that vote."""
        return self.store.table("embeddings").join(self.store.table("index_view"), "message_id").select("message_id", "vector", "index_label")

    def counts(self) -> DataFrame:
        return self.store.table("index_counts")

    def size(self) -> int:
        return self.counts().agg(F.coalesce(F.sum("examples"), F.lit(0))).first()[0]

    def contains(self, ids: DataFrame) -> DataFrame:
        """(message_id, indexed) of ids."""
        held = self.store.table("index_view").join(ids.select("message_id").distinct(), "message_id", "left_semi").select("message_id", F.lit(True).alias("held"))
        return ids.select("message_id").join(held, "message_id", "left").select("message_id", F.coalesce("held", F.lit(False)).alias("indexed"))

    def apply(self, changes: dict[str, Change], batch_id: int | None = None) -> int:
        """Commits changes of embeddings and labels (and other tables) together with the view's."""
        s = self.in_step().store
        if s.has_batch(batch_id):
            return s.version
        staged = s.stage(changes)
        if not any(staged[n].rows for n in ("embeddings", "labels") if n in staged):
            return s.commit(batch_id=batch_id, changes=staged)
        signed = signed_rows(s.table("index_view"), s.table("embeddings"), s.table("labels"), staged.get("embeddings", Change()), staged.get("labels", Change())).persist()
        try:
            return s.commit(batch_id=batch_id, changes={**staged, **view_changes(signed, s.table("index_counts"))})
        finally:
            signed.unpersist()

    def add(self, rows: DataFrame) -> int:
        """Puts rows (message_id, vector, label_id, label_name, source) in, one a message; those of known ids are replaced."""
        return self.apply({"embeddings": Change(rows.select("message_id", "vector")), "labels": Change(rows.select("message_id", "label_id", "label_name", "source"))})

    def remove(self, ids: DataFrame) -> int:
        """Takes messages out; their vectors stay stored."""
        return self.apply({"labels": Change(deletes=ids)})

    def rename_label(self, old: str, new: str) -> int:
        """How many rows have the new name."""
        rows = self.store.table("labels").where(F.col("label_name") == old).withColumn("label_name", F.lit(new))
        self.apply({"labels": Change(rows)})
        return self.store.written["labels"]

    def reload(self) -> int:
        """Makes the view anew from the two tables, as at a start."""
        joined = self.store.table("embeddings").select("message_id").join(self.store.table("labels"), "message_id").select("message_id", index_label(F.col("label_id"), F.col("label_name")).alias("index_label"))
        return self.store.commit({"index_view": joined, "index_counts": label_counts(joined)})

    def reset(self, rows: DataFrame) -> int:
        """Replaces all by rows as in add, in one step."""
        label = rows.select("message_id", index_label(F.col("label_id"), F.col("label_name")).alias("index_label"))
        return self.store.commit({"embeddings": rows.select("message_id", "vector"), "labels": rows.select("message_id", "label_id", "label_name", "source"), "index_view": label, "index_counts": label_counts(label)})
