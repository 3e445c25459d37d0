"""The data model on the star-schema tables: which table plays which part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.schemas import SKIP

#: Every so many ids is a query of the neighbour search; the index is every row.
QUERY_STEP = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """(id, vector, label): label 9 is the reject label; shift moves each vector along the axis of its label."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), shift).otherwise(0.0)) if shift else F.col("embedding")
    return e.select(F.col("vec_id").alias("id"), v.alias("vector"), F.when(F.col("label") == 9, SKIP).otherwise(F.concat(F.lit("L"), F.col("label").cast("string"))).alias("label"))


def queries(index: DataFrame) -> DataFrame:
    return index.where(F.col("id") % QUERY_STEP == 0).select("id", "vector")


def state_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels: (message_id, label_id, label_name, source); quality 0 is the reject, others are named by toxicity."""
    q = F.col("quality") == 0
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("message_id"), F.when(q, F.lit(SKIP)).otherwise(F.concat(F.lit("T"), F.col("toxic").cast("string"))).alias("label_id"),
        F.when(q, F.lit(SKIP)).otherwise(F.when(F.col("toxic") == 0, F.lit("clean")).otherwise(F.lit(""))).alias("label_name"), F.when(q, "auto").otherwise("user").alias("source"),
    )


def state_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("message_id"), F.col("embedding").alias("vector"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log: signups are new inbox messages, clicks add a label, errors remove one."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "click", "error"))
    kind = F.when(F.col("event_type") == "signup", "messagesAdded").when(F.col("event_type") == "click", "labelsAdded").otherwise("labelsRemoved")
    label = F.concat(F.lit("L"), (F.col("event_id") % 7).cast("string"))
    return e.select(F.col("event_id").alias("seq"), kind.alias("type"), F.col("user_id").alias("message_id"), F.array(F.when(F.col("event_type") == "signup", F.lit("INBOX")).otherwise(label)).alias("label_ids"))


def registry(spark: SparkSession) -> DataFrame:
    """Labels L0 to L5 (L6 is unknown), L5 excluded."""
    return spark.range(6).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("label_id"), F.concat(F.lit("name"), F.col("id").cast("string")).alias("label_name"), (F.col("id") == 5).alias("is_excluded"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a mailbox: label = priority, recency = order date, message = order."""
    return table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("label_id"), F.col("o_orderkey").alias("message_id"), F.col("o_orderdate").alias("recency"), "o_orderstatus")
