"""Queries opN_* of the driver's registry, with the parameters used in production, and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.llm.common import read_table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_roundtrip(spark, sf_dir):
    from labelflow.llm.bpe import encode_decode

    return encode_decode(read_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), payload=False)


def op2_toxicity(spark, sf_dir):
    from labelflow.llm import quality_classifier, toxicity

    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), (5, 0))
    return quality_classifier.with_held_out(toxicity.score(docs, model, 0.5), 5, 0).select("doc_id", "held_out", "score", "predicted")


def op3_quality_classifier(spark, sf_dir):
    from labelflow.llm import quality_classifier

    docs = read_table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"), (4, 2))
    return quality_classifier.with_held_out(quality_classifier.score(docs, model, 0.7), 4, 2).select("doc_id", "held_out", "score", "predicted")


def op4_ngram_jaccard_join(spark, sf_dir):
    from labelflow.llm.jaccard_join import similar_sets

    return similar_sets(read_table(spark, sf_dir, "documents"), width=4, threshold=(85, 100)).drop("_group")


def op5_best_fit_packing(spark, sf_dir):
    from labelflow.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 1024, 2).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_training_order(spark, sf_dir):
    """The shards' records: where each sequence stands (shard, record, slot) and what it starts with."""
    from labelflow.llm import training_order
    from labelflow.llm.common import shared_path

    path = shared_path(spark, "training_order")
    training_order.write_shards(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), path)
    return training_order.read_shards(spark, path)


def op7_language_model(spark, sf_dir):
    from labelflow.llm import language_model, quality_classifier
    from labelflow.llm.common import remainder_column

    docs = read_table(spark, sf_dir, "documents")
    model, _ = language_model.fit(docs.where(remainder_column("doc_id", 7) != 2))
    scored = language_model.score(docs, model)
    return quality_classifier.with_held_out(scored, 7, 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality_rules(spark, sf_dir):
    from labelflow.llm import quality_rules

    docs = read_table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.apply(docs, rules).select("doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept")


def op9_license_scan(spark, sf_dir):
    """documents as files source/lang/doc_id."""
    from labelflow.llm.license_scan import scan

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return scan(docs)


def op10_exact_dedup(spark, sf_dir):
    from labelflow.llm.exact_dedup import exact_duplicates

    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark, sf_dir):
    from labelflow.llm.lexical_search import rank_documents

    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 50)


def op12_compaction(spark, sf_dir):
    from labelflow.llm.compaction import write_and_compact

    return write_and_compact(read_table(spark, sf_dir, "clicks"))


def op13_sentencepiece(spark, sf_dir):
    from labelflow.llm.piece_bpe import encode_decode

    return encode_decode(read_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), payload=False)


QUERIES = {f.__name__: f for f in (op1_bpe_roundtrip, op2_toxicity, op3_quality_classifier, op4_ngram_jaccard_join, op5_best_fit_packing, op6_training_order, op7_language_model, op8_quality_rules, op9_license_scan, op10_exact_dedup, op11_lexical_search, op12_compaction, op13_sentencepiece)}

ORACLE_SQL = {
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op11_lexical_search": r"""
        WITH said AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM said GROUP BY ALL),
        docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
        total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM docs),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
        m AS (SELECT doc_id, 100 - 50 + (50 * n * big_n) // big_l AS m FROM docs, total),
        s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
              FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY rank <= 50
    """,
}
