"""The maturity gate: new work waits until the labelled set is broad enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.schemas import MATURITY_TARGET, MIN_EXAMPLES, SKIP, SKIP_TARGET


def gate(available: DataFrame) -> DataFrame:
    """(label, target) from (label, available): as many as the target or as there are, for labels with enough of them;
    the reject label has its own target and is always there."""
    named = available.where((F.col("label") != SKIP) & (F.col("available") >= MIN_EXAMPLES)).select("label", F.least("available", F.lit(MATURITY_TARGET)).alias("target"))
    skip = available.where(F.col("label") == SKIP).agg(F.coalesce(F.sum("available"), F.lit(0)).alias("n")).select(F.lit(SKIP).alias("label"), F.least("n", F.lit(SKIP_TARGET)).alias("target"))
    return named.unionByName(skip)


def is_open(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: open if every target is met by counts (label, examples); without targets it is."""
    met = targets.join(counts, "label", "left").select((F.coalesce("examples", F.lit(0)) >= F.col("target")).alias("met"))
    return met.agg(F.coalesce(F.bool_and("met"), F.lit(True)).alias("open"))


def split_counts(index: DataFrame) -> DataFrame:
    """(label, examples, skip): per label its examples, with the number of rejects beside."""
    per = index.groupBy("label").agg(F.count(F.lit(1)).alias("examples"))
    skip = index.agg(F.count_if(F.col("label") == SKIP).alias("skip"))
    return per.where(F.col("label") != SKIP).crossJoin(skip)
