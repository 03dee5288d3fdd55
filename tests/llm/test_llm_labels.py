"""Many labels, and scores in pieces, in language ID and the quality rules."""

from __future__ import annotations

import itertools
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from pressroom.llm import language_id, quality, queries


def plain_distance(p, q):
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0.0, total / 2))


def plain_class(c):
    if ord(c) >= 65_536:
        return "letter"
    kinds = [("newline", c == "\n"), ("blank", c.isspace()), ("lower", c.islower()), ("upper", c.isupper()), ("letter", c.isalpha()), ("digit", c.isdigit()),
             ("stop", c in ".,;:!?'\"()-"), ("bar", c in "|¦_=~"), ("symbol", c.isprintable()), ("other", True)]
    return next(name for name, true in kinds if true)


def plain_rules(docs):
    """nearest_lang, both distances and the verdict of every (text, lang), from counters of whole texts."""
    classes, words = {}, {}
    for text, lang in docs:
        if text is not None and lang is not None:
            classes.setdefault(lang, Counter()).update(map(plain_class, text))
            words.setdefault(lang, Counter()).update(w if len(w) <= 6 else "" for w in re.findall(r"[^\W\d_]+", text.lower()))
    common = {lang: sorted((w for w in c if w), key=lambda w: (-c[w], w))[:40] for lang, c in words.items()}
    found = []
    for text, _ in docs:
        text = text or ""
        mine, own = Counter(map(plain_class, text)), Counter(re.findall(r"[^\W\d_]+", text.lower()))
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        best = (None, None, None)
        if own:
            scored = []
            for lang in sorted(classes):
                by_class = plain_distance([mine[c] / len(text) for c in quality.CLASSES], [classes[lang][c] / sum(classes[lang].values()) for c in quality.CLASSES])
                used, every = [own[w] for w in common[lang]], sum(words[lang].values())
                theirs = [words[lang][w] / every for w in common[lang]]
                by_word = plain_distance([*[u / sum(own.values()) for u in used], 1 - sum(used) / sum(own.values())], [*theirs, 1 - sum(theirs)])
                scored.append((max(by_class, by_word), lang, by_class, by_word))
            best = min(scored)[1:] if scored else best
        limits, noise = quality.Limits(), 1 / math.sqrt(max(n, 1))
        far = (best[1] or 0) > limits.classes + limits.class_noise * noise or (best[2] or 0) > limits.words + limits.word_noise * noise
        found.append((best, not (far and len(text) >= limits.min_chars and n >= limits.min_words)))
    return found


def test_distances_and_verdicts_of_whole_documents(spark, small):
    docs = queries.documents(spark, small).collect()
    want = {r.doc_id: w for r, w in zip(docs, plain_rules([(r.text, r.lang) for r in docs]))}
    got = queries.op9_quality_rules(spark, small).collect()
    assert len(got) == len(docs) and len({r.nearest_lang for r in got}) > 3 and not all(w[1] for w in want.values())
    for r in got:
        (lang, by_class, by_word), fine = want[r.doc_id]
        assert r.nearest_lang == lang and r.kept == (fine and not r.base_failed)
        assert (r.class_distance, r.word_distance) == (pytest.approx(by_class, abs=1e-9), pytest.approx(by_word, abs=1e-6))


def many(spark, labels):
    rows = [(i, f"wort{i % labels} abc {'xyz'[i % 3]}{i % labels} und noch ein wort", f"l{i % labels:04d}") for i in range(labels + 40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)


def test_more_labels_than_are_learned(spark):
    docs = many(spark, 1_500)
    references = quality.collected(quality.language_references(docs))
    assert len(references) == 1_000 and {f"l{i:04d}" for i in range(40)} <= set(references)  # those with most text
    assert quality.quality_rules(docs, references).where("nearest_lang IS NOT NULL").count() == 1_540
    model = language_id.train(docs)
    assert len(model.languages) == 1_000 and model.languages[:40] == tuple(f"l{i:04d}" for i in range(40))
    found = language_id.identify(docs.limit(20), model).collect()
    assert all(r.lang_pred in model.languages for r in found)


def test_time_of_a_text_hardly_depends_on_the_labels():
    rng = np.random.default_rng(2)

    def tables(n):
        shares = rng.dirichlet(np.ones(41), n)
        return quality.stacked({f"l{i}": (rng.dirichlet(np.ones(len(quality.CLASSES))), [f"w{(i * 7 + j) % 900}" for j in range(40)], shares[i]) for i in range(n)})

    text = " ".join(f"w{i % 700}" for i in range(1_000))
    few, all_ = tables(4), tables(1_000)
    start = time.perf_counter()
    for _ in range(20):
        quality.divergence(text, all_)
    assert (time.perf_counter() - start) / 20 < 0.02  # a loop over the languages took 0.07
    lang, by_class, by_word = quality.divergence(text, few)
    assert 0 <= max(by_class, by_word) <= 1 and lang in few.languages


def test_scores_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    model = language_id.Model(("a", "b", "c"), np.log(rng.random((language_id.BUCKETS, 3))).astype(np.float32), np.ones((15, 3), dtype=bool))
    text = " ".join("".join(rng.choice(list("abcdé"), int(rng.integers(1, 30)))) for _ in range(60)) + " " + "z" * 500
    buckets, first, _, _ = language_id.trigrams(text)
    whole = language_id.run_scores(model, buckets, first)
    for step in (3, 21, 300):
        monkeypatch.setattr(language_id, "LETTERS", step)
        assert language_id.run_scores(model, buckets, first) == pytest.approx(whole, rel=1e-5)


def test_skipping_the_pass_changes_no_label():
    """Where no stretch gains a penalty, the single best language is the best of all paths; elsewhere the pass runs."""
    rng = np.random.default_rng(9)
    skipped = 0
    for _ in range(400):
        scores = rng.normal(size=(6, 3)) * rng.choice([1, 4, 10])
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 15 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = int(scores.sum(axis=0).argmax())
        skipped += language_id.largest_gain(scores, best) < 15
        assert value(language_id.best_path(scores, 15.0)) == pytest.approx(max(map(value, itertools.product(range(3), repeat=6))))
    assert 100 < skipped < 400
