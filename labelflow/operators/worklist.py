"""Bootstrap work list: capped buckets per label, interleaved, rejects first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.schemas import MAX_PER_LABEL, SKIP, SKIP_FRONTLOAD


def capped(listing: DataFrame, cap: int = MAX_PER_LABEL) -> DataFrame:
    """Rows (label_id, message_id, recency) with rn, the newest cap of each label (0: all); a cap is the feature here."""
    w = Window.partitionBy("label_id").orderBy(F.desc("recency"), "message_id")
    out = listing.withColumn("rn", F.row_number().over(w))
    return out.where(F.col("rn") <= cap) if cap else out


def plan(listing: DataFrame, unlabelled: DataFrame, labels: DataFrame, cap: int = MAX_PER_LABEL, frontload: int = SKIP_FRONTLOAD) -> DataFrame:
    """(pos, message_id, label_id, label_name, source): the first rejects, then labels A, B, C, A, B, C, ... with the
    remaining rejects as the last bucket. labels: (label_id, label_name, ordinal) of those included. A message that has
    a label is no reject. pos is dense and follows the sort key, without one task sorting everything."""
    named = capped(listing.join(labels, "label_id"), cap).select("message_id", "label_id", "label_name", F.lit("user").alias("source"), F.lit(1).alias("part"), F.col("rn").alias("turn"), "ordinal")
    pool = unlabelled.join(named.select("message_id"), "message_id", "left_anti").withColumn("label_id", F.lit(SKIP))
    pool = capped(pool, cap).select("message_id", "label_id", F.lit(SKIP).alias("label_name"), F.lit("auto").alias("source"), F.when(F.col("rn") <= frontload, 0).otherwise(1).alias("part"), F.when(F.col("rn") <= frontload, F.col("rn")).otherwise(F.col("rn") - frontload).alias("turn"), F.lit(1 << 30).alias("ordinal"))
    rows = named.unionByName(pool)
    # Positions: rows of earlier turns are counted per (part, turn), a table as long as the longest bucket.
    size = rows.groupBy("part", "turn").agg(F.count(F.lit(1)).alias("n"))
    before = size.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("part", "turn").orderBy("ordinal", "message_id"))
    return rows.withColumn("_at", place).join(before, ["part", "turn"]).select((F.col("base") + F.col("_at") - 1).alias("pos"), "message_id", "label_id", "label_name", "source")


def available_counts(planned: DataFrame) -> DataFrame:
    return planned.groupBy("label_name").agg(F.count(F.lit(1)).alias("available"))


def first_wins(planned: DataFrame) -> DataFrame:
    """One row per message, the first in the list: what the progressive build keeps."""
    return planned.groupBy("message_id").agg(F.min_by(F.struct("label_id", "label_name", "source", "pos"), "pos").alias("r")).select("message_id", "r.*")


def last_wins(planned: DataFrame) -> DataFrame:
    """One row per message, the last in the list: what a blocking build or a resync keeps."""
    return planned.groupBy("message_id").agg(F.max_by(F.struct("label_id", "label_name", "source", "pos"), "pos").alias("r")).select("message_id", "r.*")


def next_batch(planned: DataFrame, embedded: DataFrame, rows: int) -> DataFrame:
    """The next rows to embed; those that have a vector do not count."""
    return planned.join(embedded.select("message_id"), "message_id", "left_anti").orderBy("pos").limit(rows)
