"""The registered queries of this subpackage, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm import (
    byte_bpe,
    fingerprints,
    html_text,
    language_id,
    licenses,
    mixing,
    near_dedup,
    neighbours,
    prefix_trie,
    quality,
    secret_scan,
    spelling,
    token_counts,
)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprints.fingerprint_report(documents(spark, folder))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_hex("f0", "f1").alias("fingerprint"),
        fingerprints.as_hex("e0", "e1").alias("edited_fingerprint"), "near_edited", "near_next", "n_within",
    )


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, folder))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_digest(documents(spark, folder))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, model)
    return found.select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
        F.size("spans").cast("bigint").alias("n_spans"),
    )


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, folder))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder))


def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{folder}/pages.parquet"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    references = quality.collected(quality.language_references(docs))
    return quality.quality_rules(docs, references)


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    written = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["edits"]))
    return licenses.license_scan(documents(spark, folder)).withColumn("spans", F.array_join(written, ","))


def op11_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    found = neighbours.nearest_neighbours(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    found = spelling.variants(documents(spark, folder))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    found = prefix_trie.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))
    return found.drop("k1", "k2")


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_near_dedup": op2_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scan": op4_secret_scan,
    "op5_language_id": op5_language_id,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_mixing": op7_mixing,
    "op8_html_text": op8_html_text,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
    "op11_neighbours": op11_neighbours,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_prefix_trie": op13_prefix_trie,
}

#: None of them can be told in SQL as a whole; the tests hold each against a brute-force version.
ORACLE: dict[str, str] = {}
