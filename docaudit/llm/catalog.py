"""Registered queries of the corpus operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from . import (
    exact_dedup, jaccard_join, language_model, lexical_search, merkle, mixing, oracles, packing, quality_classifier,
    quality_rules, secret_scan, sentence_pieces, substring_dedup, warc,
)
from .common import table


def op1_source_mix(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), packing.default_tokenizer())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_language_model(spark, sf_dir):
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.score(docs, quality_classifier.train(docs, labels))


def op9_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("target_uri")


def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sentence_pieces(spark, sf_dir):
    model = sentence_pieces.default_model()
    encoded = sentence_pieces.encode_texts(table(spark, sf_dir, "documents"), model)
    return sentence_pieces.decode_texts(encoded, model).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_merkle_manifest(spark, sf_dir):
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in [
    op1_source_mix, op2_exact_dedup, op3_packing, op4_jaccard_join, op5_language_model, op6_quality_rules,
    op7_substring_dedup, op8_quality_classifier, op9_secret_scan, op10_warc,
    op11_lexical_search, op12_sentence_pieces, op13_merkle_manifest,
]}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES = {
    "op2_exact_dedup": """
        WITH normal AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM normal""",
    "op10_warc": """
        WITH digested AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id
            FROM pages)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
        FROM digested""",
    "op11_lexical_search": oracles.RANKED_SEARCH,
    "op13_merkle_manifest": oracles.merkle_manifest(),
}
