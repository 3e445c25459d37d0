"""Corpus pipeline: rules, toxicity, exact and near duplicates out, the rest packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; run() writes
each one's result as Parquet to the shared folder and reads it back as the next one's docs. All but the last return the
columns of documents, in their order and unchanged, whatever the names of extra ones. All stages take null and repeated
doc_ids, null, empty and very long texts and empty tables; each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.llm import exact_dedup, jaccard_join, packing, quality_rules, toxicity
from labelflow.llm.common import discard, materialise, read_table, with_row_id


def _plain(docs: DataFrame) -> DataFrame:
    """docs with names of our own for all columns but doc_id and text, so that none clashes with an operator's."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"_in{i}" for i, c in enumerate(docs.columns)])


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the base rule or a learned rule rejects go. Null and empty texts have no words and go;
    repeated rows get the same verdict each; without labels the base rule alone decides."""
    plain = _plain(docs)
    rules = quality_rules.fit(plain, read_table(spark, sf_dir, "labels"))
    return quality_rules.apply(plain, rules, tuple(plain.columns)).where("kept").select(plain.columns).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents predicted toxic (score 0.5 or more) go. Null and empty texts score the bias alone; repeated
    rows get the same score each; without labels every score is 0.5 and nothing is known, so nothing goes."""
    plain = _plain(docs)
    model = toxicity.fit(plain, read_table(spark, sf_dir, "labels"))
    if not model[0].any() and not model[1]:
        return docs
    return toxicity.score(plain, model, keep=tuple(plain.columns)).where("predicted = 0").select(plain.columns).toDF(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of identical texts the row with the largest doc_id stays, of repeated rows the first. Null and empty
    texts are identical; a null doc_id is less than any other."""
    placed = with_row_id(_plain(docs), "_pos")
    kept = exact_dedup.exact_duplicates(placed, keep=("_pos",)).where("kept")
    return placed.join(kept.select("_pos"), "_pos", "left_semi").drop("_pos").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 (five words, similarity 0.8 or more): of each group of linked rows the least doc_id stays, of repeated
    rows the first; a null doc_id stays only where no other row of its group has one. Rows without words link with
    nothing and stay, each on its own."""
    placed = with_row_id(_plain(docs), "_pos")
    groups = jaccard_join.similar_sets(placed, 5, (80, 100), ("doc_id", "_pos"))
    first = groups.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_pos")).alias("k")).select(F.col("k._pos").alias("_pos"))
    return placed.join(first, "_pos", "left_semi").drop("_pos").toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: sequences of at most 1024 tokens; a row per piece. Null and empty texts are an end token alone, longer
    documents are cut, repeated rows are packed each on its own."""
    import public_tokenizers

    return packing.pack_documents(_plain(docs), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("best_fit_packing", pack),
]

#: SQL can express neither the learned stages nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_shared_path"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
