"""Registered queries of the numbered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation_repair, credentials, decontamination, fingerprints, hard_negatives, html_extract, language_id,
               line_dedup, ngram_lm, packing, simhash, substring_dedup, url_filter)
from .common import id_remainder, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncmer fingerprint of every document and of its edited text."""
    return fingerprints.fingerprint_with_next(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more, taken out of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs))
    return out.select("row.doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html_extract.extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and trigram score of every document, from the texts that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return ngram_lm.score_documents(docs.select(
        "doc_id", "text", (id_remainder(F.col("doc_id"), 7) != 2).alias("train")), order=3)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the texts that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = language_id.learn(docs.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), language_id.predict(spark, model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.share").alias("score"),
                      F.col("p.langs").alias("langs"), F.col("p.shares").alias("shares"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage like a benchmark item, with the item and the window."""
    out = decontamination.contaminated_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("_doc", "_text_hash")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, base spans and those that corpus-wide ownership adds."""
    return credentials.digest(credentials.find_secrets(table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive among the embeddings, some labels moved on by one."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 13 words that a document of a smaller id holds too, taken out of every document."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation, after damage to some of its rows."""
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_fingerprints, op2_line_dedup, op3_html_extraction, op4_lm_scoring, op5_packing, op6_simhash, op7_url_filter,
    op8_language_id, op9_decontamination, op10_secret_scan, op11_hard_negatives, op12_substring_dedup,
    op13_conversation_repair)}
