"""Mixing within a stated share of the tokens."""

from __future__ import annotations

import pytest
from pressroom.llm import mixing


def test_one_rare_source_does_not_shrink_the_sample(spark):
    words = "stone river grain morning boat".split()
    sources = [f"s{max(0, i % 15 - 5)}" for i in range(300)]  # one holds two fifths
    rows = [(i, " ".join(words * 40), ("en", "de", "fr")[i // 15 % 5 % 3], s) for i, s in enumerate(sources)]
    rows.append((1_000, "two words", "en", None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    table = mixing.mix(docs).toPandas()
    mass = table.n_tokens * table.chance
    assert mass.sum() / table.n_tokens.sum() == pytest.approx(0.4, rel=0.01)
    assert table[table.source == "(none)"].chance.tolist() == [1.0]
    for margin in ("source", "lang"):
        held = table.groupby(margin).n_tokens.sum()
        wanted = held**0.85
        ratio = (mass.groupby(table[margin]).sum() / wanted)[held > 2]
        assert ratio.max() / ratio.min() == pytest.approx(1, abs=0.01)


def test_what_is_left_over_is_reported(spark):
    rows = [(i, "a stone bridge", "en" if i % 2 else "de", f"s{i % 2}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    targets = {
        "lang": spark.createDataFrame([("en", 0.9), ("de", 0.1)], "lang string, target double"),
        "source": spark.createDataFrame([("s0", 0.5), ("s1", 0.5)], "source string, target double"),
    }
    with pytest.warns(UserWarning, match="off its target"):
        mixing.mix(docs, targets=targets).count()
