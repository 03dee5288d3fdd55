"""Spelling variants against comparing every two words."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import edge
import numpy as np
import pytest

from pressroom.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_words(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lowered(run)
            h = crc32(f"{'' if key is None else key}:{word}".encode())
            counts[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts):
    form, near = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if one_edit(w, o)]
        near[w] = len(others)
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    found = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        found.append((w, form[w], root, n, near[w], counts[form[w]] if form[w] else None))
    return sorted(found, key=repr)


def variants(docs, **options):
    return sorted((tuple(r) for r in spelling.variants(docs, **options).select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("index_rows, query_rows", [(16_384, 65_536), (3, 4)])
def test_crowded_vocabulary(spark, index_rows, query_rows):
    """Few letters, so that words have many near words; small blocks are cut into pieces."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abé"))
    words = ["".join(letters[rng.integers(0, 3, rng.integers(4, 8))]) for _ in range(400)]
    docs = [(i, " ".join(rng.choice(words, 60).tolist()) + "; Abcde-ABCDE") for i in range(80)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, word string, n int").repartition(3)
    want = plain_variants(plain_words(docs))
    assert any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want)
    assert variants(frame, index_rows=index_rows, query_rows=query_rows) == want


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in edge.rows()]
    assert variants(edge.documents(spark)) == plain_variants(plain_words(docs))
    assert variants(edge.none(spark)) == []


def test_whole_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = plain_words([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = {r["word"]: r for r in spelling.variants(docs).collect()}
    assert {w: r["n"] for w, r in got.items()} == counts
    some = sorted(counts)[::25]
    for w in some:
        others = [o for o in counts if one_edit(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form = best if best is not None and counts[best] >= 2 * counts[w] else None
        assert (got[w]["n_near"], got[w]["form"]) == (len(others), form)


def test_long_words(spark):
    long = "ab" * 3_000
    docs = [(i, f"{long} {long}c {long[:-1]} x{long}") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["word"]: r["n_near"] for r in spelling.variants(frame, least=100).collect()}
    assert got == {long: 3, f"{long}c": 1, long[:-1]: 1, f"x{long}": 1}
