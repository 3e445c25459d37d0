"""Similarity-weighted votes of neighbours, and what is done with the winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.schemas import HIGH, MEDIUM, MIN_EXAMPLES, SKIP


def eligible_labels(index: DataFrame, least: int = MIN_EXAMPLES) -> DataFrame:
    """(label, examples) of labels with enough examples; the reject label is subject to the same rule."""
    return index.groupBy("label").agg(F.count(F.lit(1)).alias("examples")).where(F.col("examples") >= least)


def eligible_neighbours(neighbours: DataFrame, index: DataFrame) -> DataFrame:
    """Neighbours that may vote. k is taken before this filter, so fewer than k may be left."""
    return neighbours.join(eligible_labels(index).select("label"), "label", "left_semi")


def vote_scores(voters: DataFrame) -> DataFrame:
    """query_id, label, score (sum of similarities in rank order), first_rank."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "similarity")))
    return voters.groupBy("query_id", "label").agg(ordered.alias("v")).select(
        "query_id", "label", F.aggregate("v", F.lit(0.0), lambda s, x: s + x["similarity"]).alias("score"), F.col("v")[0]["rank"].alias("first_rank")
    )


def vote_confidence(scores: DataFrame) -> DataFrame:
    """query_id, label, confidence: the largest score's share of the (signed) total; of equal scores the label of the
    nearest neighbour wins; a total of 0 gives '' and 0."""
    won = scores.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("first_rank")).alias("near"), "label")).alias("w"), F.array_sort(F.collect_list(F.struct("first_rank", "score"))).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda s, x: s + x["score"])
    return won.select("query_id", F.when(total == 0, F.lit("")).otherwise(F.col("w.label")).alias("label"), F.when(total == 0, F.lit(0.0)).otherwise(F.col("w.score") / F.nullif(total, F.lit(0.0))).alias("confidence"))


def decide_action(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "label").when(confidence >= MEDIUM, "label_with_review").otherwise("no_label")


def classify(queries: DataFrame, index: DataFrame, neighbours: DataFrame) -> DataFrame:
    """query_id, label, confidence, action and all k neighbours (whether they voted or not); a row for every query.

    A winning reject label gives '' and 0; so does a query without voters.
    """
    verdict = vote_confidence(vote_scores(eligible_neighbours(neighbours, index)))
    seen = neighbours.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "similarity", "label"))), lambda x: F.struct(x["similarity"].alias("similarity"), x["label"].alias("label"))).alias("neighbours"))
    lost = F.col("label").isNull() | (F.col("label") == SKIP) | (F.col("label") == "")
    return (
        queries.select(F.col("id").alias("query_id")).join(verdict, "query_id", "left").join(seen, "query_id", "left")
        .select("query_id", F.when(lost, F.lit("")).otherwise(F.col("label")).alias("label"), F.when(lost, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"), F.when(lost, F.lit("no_label")).otherwise(decide_action(F.col("confidence"))).alias("action"), "neighbours")
    )


def apply_gate(verdicts: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds applied: the action applies a label, the label is registered and not excluded. The registry is small by
    nature; Spark broadcasts it when its size allows."""
    known = registry.select(F.col("label_name").alias("label"), F.col("label_id"), "is_excluded")
    return verdicts.join(known, "label", "left").withColumn("applied", F.col("action").isin("label", "label_with_review") & F.col("label_id").isNotNull() & ~F.coalesce("is_excluded", F.lit(False)))
