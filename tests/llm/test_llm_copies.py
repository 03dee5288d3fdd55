"""The stage that keeps one of each group of near-duplicates, against all pairs of fingerprints."""

from __future__ import annotations

import corpus_pipeline
from pressroom.llm import near_dedup, queries
from test_llm_corpus import plain_components, plain_simhash


def test_one_of_each_group_stays(spark, small):
    docs = queries.documents(spark, small)
    prints = {r.doc_id: plain_simhash(r.text) for r in docs.collect()}
    want = plain_components(prints.items())
    got = corpus_pipeline.without_near_copies(spark, docs, small)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(k for k, p in prints.items() if want[p] == k)


def test_edited_copies_of_long_texts_leave_the_corpus(spark):
    """A word in a thousand changed moves few bits; the texts around them are left alone."""
    words = [f"w{i * i % 7919}" for i in range(3_000)]
    rows = [(i, " ".join([*words[: 70 * i], f"new{i}", *words[70 * i + 1 :]])) for i in range(20)]
    rows += [(100 + i, " ".join(f"v{i}x{j}" for j in range(200))) for i in range(20)] + [(200, None), (201, " ")]
    prints = {key: plain_simhash(text) for key, text in rows}
    want = plain_components(prints.items())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in near_dedup.one_of_each(docs).collect())
    assert kept == sorted(k for k, p in prints.items() if want[p] == k)
    assert len([k for k in kept if k < 20]) < 5 and set(range(100, 120)) < set(kept) and 201 not in kept


def test_rows_that_share_a_key_are_judged_by_their_texts(spark):
    a, b = "a stone bridge over the quiet river", "something else that is like no other text"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in near_dedup.one_of_each(docs).collect()) == [(3, a), (5, b)]
