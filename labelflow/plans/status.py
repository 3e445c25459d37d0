"""State report: one row of numbers, and its text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.operators.keyed import index_join
from labelflow.schemas import SKIP


def status(embeddings: DataFrame, labels: DataFrame, pending: DataFrame) -> DataFrame:
    """n_embeddings, n_labels, index_size, skip_size, n_names, pending."""
    joined = index_join(embeddings, labels)
    named = F.col("index_label") != SKIP
    out = joined.agg(F.count(F.lit(1)).alias("index_size"), F.count_if(~named).alias("skip_size"), F.count_distinct(F.when(named, F.col("index_label"))).alias("n_names"))
    for name, df in (("n_embeddings", embeddings), ("n_labels", labels), ("pending", pending)):
        out = out.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))
    return out.select("n_embeddings", "n_labels", "index_size", "skip_size", "n_names", "pending")


def report(embeddings: DataFrame, labels: DataFrame, pending: DataFrame, excluded: list[str]) -> str:
    """The report as text, names in order; the counts per label are as many as there are labels."""
    s = status(embeddings, labels, pending).first()
    per = index_join(embeddings, labels).groupBy("index_label").count().where(F.col("index_label") != SKIP).orderBy("index_label").collect()
    width = max([len(r["index_label"]) for r in per], default=0)
    head = [f"index size: {s['index_size']} ({s['skip_size']} rejects)", f"stored: {s['n_embeddings']} vectors, {s['n_labels']} labels", f"pending: {s['pending']}", f"excluded: {', '.join(sorted(excluded)) or '-'}"]
    return "\n".join(head + [f"  {r['index_label'].ljust(width)}  {r['count']}" for r in per])
