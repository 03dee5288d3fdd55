"""A training corpus from ``documents``: each stage works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and rereads it
as the next one's ``docs``. All but the last keep the columns of ``docs``, extra ones included. An empty
table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm import byte_bpe, language_id, mixing, near_dedup, secret_scan
from pressroom.session import cut_lineage


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; ``lang`` becomes the predicted one.

    Texts that are null or without a letter (``und``) are rejected. Where no row is labelled, nothing is
    learned and nothing can be rejected but those. Rows with the same text have the same prediction.
    """
    known = docs.where(~language_id.held_out(F.col("doc_id")))
    model = language_id.train(known)
    found = language_id.text_language(model)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), found(F.col("text")).alias("found"))
    kept = marked.where(F.col("found")["has_letters"])
    lang = F.coalesce(F.when(F.col("found")["lang_pred"] != language_id.UNKNOWN, F.col("found")["lang_pred"]), F.col("row")["lang"])
    return kept.select(*[lang.alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints are linked: the one with the smallest doc_id.

    Rows that share a doc_id are judged each by its own text; repeated rows leave one. Rows without a doc_id all stay. Null
    and empty texts have the same fingerprint, so one of them stays.
    """
    return near_dedup.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and n_chars counted anew.

    A null text stays null and has no count, an empty one stays empty; equal texts are treated alike, so repeated rows stay equal.
    """
    clean = secret_scan.redacted(docs)
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n_chars)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics hold their target shares of the tokens.

    Null sources and languages are values of their own. Texts without a token, null and empty ones, are never drawn. Rows
    that share a doc_id are drawn together as far as their chances are the same.
    """
    return mixing.sampled(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, lang, source, n_tokens and ids. Null and empty texts have none; every row gives one row."""
    rows = docs.select(F.struct("doc_id", "lang", "source").alias("kept"), "text")
    made = byte_bpe.encode_texts(rows, "byte_bpe_multi_50k.tiktoken", key="kept")
    return made.select("kept.*", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", with_language),
    ("near_dedup", without_near_copies),
    ("secret_scan", without_secrets),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: No stage but the first can be told in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
