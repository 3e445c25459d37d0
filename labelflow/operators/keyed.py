"""Keyed-table kernels: what a mutable single-valued table does, as joins of a base and a delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.functions.text import index_label
from labelflow.schemas import SKIP


def latest(delta: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Last write of each key by seq."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return delta.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def earliest(delta: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """First write of each key by seq."""
    w = Window.partitionBy(key).orderBy(F.asc(seq))
    return delta.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, delta: DataFrame, key: str, seq: str | None = "seq") -> DataFrame:
    """base with delta's rows in place of those of the same key; with seq the last of several wins."""
    new = (latest(delta, key, seq).drop(seq) if seq else delta).select(base.columns)
    return base.join(new.select(key), key, "left_anti").select(base.columns).unionByName(new)


def insert_ignore(base: DataFrame, delta: DataFrame, key: str, seq: str | None = "seq") -> DataFrame:
    """base with delta's rows of new keys; the first of several wins."""
    new = (earliest(delta, key, seq).drop(seq) if seq else delta).select(base.columns)
    return base.unionByName(new.join(base.select(key), key, "left_anti").select(base.columns))


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti").select(base.columns)


def rename(base: DataFrame, old: Column | str, new: Column | str, column: str = "label_name") -> DataFrame:
    return base.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def index_join(embeddings: DataFrame, labels: DataFrame) -> DataFrame:
    """The voting set: (message_id, vector, index_label) of ids that have both; orphans on either side do not vote."""
    return embeddings.join(labels, "message_id").select("message_id", "vector", index_label(F.col("label_id"), F.col("label_name")).alias("index_label"))


def index_label_counts(embeddings: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, examples) over joined ids; no vector is read."""
    joined = embeddings.select("message_id").join(labels, "message_id")
    return joined.groupBy(index_label(F.col("label_id"), F.col("label_name")).alias("label")).agg(F.count(F.lit(1)).alias("examples"))


def assembly_stats(embeddings: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: n_train, n_skip, n_total of the voting set."""
    joined = embeddings.select("message_id").join(labels, "message_id")
    return joined.agg(F.count_if(F.col("label_id") != SKIP).alias("n_train"), F.count_if(F.col("label_id") == SKIP).alias("n_skip"), F.count(F.lit(1)).alias("n_total"))


def label_names(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("label_id") != SKIP) & F.col("label_name").isNotNull()).select("label_name").distinct()


def ids_by_label(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(message_id, label_name) of messages under any of the names (label_name); rejects have none. Null names match nothing."""
    return labels.where(F.col("label_id") != SKIP).join(names.select("label_name"), "label_name", "left_semi").select("message_id", "label_name")


def vectors_of(ids: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(message_id, vector) of every row of ids, in place of a point look-up; null where there is no vector."""
    return ids.select("message_id").join(embeddings.select("message_id", "vector"), "message_id", "left")


def membership(ids: DataFrame, embeddings: DataFrame, labels: DataFrame) -> DataFrame:
    """(message_id, indexed) of every row of ids: whether it votes, which takes a vector and a label. No vector is read."""
    voting = embeddings.select("message_id").join(labels.select("message_id"), "message_id", "left_semi").distinct().withColumn("_in", F.lit(True))
    return ids.select("message_id").join(voting, "message_id", "left").select("message_id", F.coalesce("_in", F.lit(False)).alias("indexed"))
