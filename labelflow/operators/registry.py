"""The label registry and its reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.schemas import SKIP


def registry_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(label_id, old_name, new_name, change): labels gone (excluded ones are not told) or renamed; new ones are not."""
    now = new.select("label_id", F.col("label_name").alias("new_name"))
    return (
        old.join(now, "label_id", "left").select("label_id", F.col("label_name").alias("old_name"), "new_name", "is_excluded")
        .withColumn("change", F.when(F.col("new_name").isNull() & ~F.col("is_excluded"), "deleted").when(F.col("new_name") != F.col("old_name"), "renamed"))
        .where("change is not null").drop("is_excluded")
    )


def max_label_width(registry: DataFrame) -> DataFrame:
    return registry.where("not is_excluded").agg(F.coalesce(F.max(F.length("label_name")), F.lit(0)).alias("width"))


def reconcile(labels: DataFrame, diff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labels table after a diff, and the message ids to put back into the inbox: renames go by the old name, rows
    of deleted labels become automatic rejects."""
    d = diff.select(F.col("old_name").alias("label_name"), "new_name", "change")
    joined = labels.join(d, "label_name", "left")
    gone = F.coalesce(F.col("change") == "deleted", F.lit(False))
    out = joined.select(
        "message_id", F.when(gone, F.lit(SKIP)).otherwise(F.col("label_id")).alias("label_id"),
        F.when(gone, F.lit(SKIP)).when(F.col("change") == "renamed", F.col("new_name")).otherwise(F.col("label_name")).alias("label_name"),
        F.when(gone, F.lit("auto")).otherwise(F.col("source")).alias("source"),
    )
    return out, joined.where(gone).select("message_id")


def exclusion_changes(present: DataFrame, included: DataFrame) -> DataFrame:
    """(label_name, change): names in the store that are no longer included, and included ones that it lacks."""
    return (
        present.select("label_name").distinct().join(included.select("label_name"), "label_name", "left_anti").withColumn("change", F.lit("removed"))
        .unionByName(included.select("label_name").distinct().join(present.select("label_name"), "label_name", "left_anti").withColumn("change", F.lit("added")))
    )
