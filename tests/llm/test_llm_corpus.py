"""Operators that look across documents, against brute force; and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import edge
import numpy as np
import pandas as pd
import pytest
import xxhash
from conftest import plan_of
from pressroom.llm import components, fingerprints, language_id, mixing, near_dedup, queries
from pyspark.sql import functions as F


def smallest(nodes, pairs):
    """Smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


# --- near-duplicates ------------------------------------------------------------------------------


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """doc_id to component, of (doc_id, fingerprint) rows."""
    least = {}
    for key, print_ in rows:
        if key is not None:
            least[print_] = min(key, least.get(print_, key))
    prints = list(least)
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3]
    found = smallest(prints, pairs)
    group = defaultdict(list)
    for p in prints:
        group[found[p]].append(least[p])
    return {p: min(group[found[p]]) for p in prints}


@pytest.mark.parametrize("crowd", [1_000, 1])
def test_near_duplicates_of_documents(spark, small, crowd):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    prints = {r.doc_id: plain_simhash(r.text) for r in docs.collect()}
    want = plain_components(prints.items())
    got = near_dedup.near_duplicates(docs, crowd).collect()
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got} == {d: (p, want[p]) for d, p in prints.items()}
    assert len(got) == len(prints)


def test_near_duplicates_of_odd_rows(spark):
    prints = [(r[0], plain_simhash(r[1])) for r in edge.rows()]
    want = plain_components(prints)
    got = near_dedup.near_duplicates(edge.documents(spark)).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter(
        (d, p, None if d is None else want[p]) for d, p in prints
    )
    assert near_dedup.near_duplicates(edge.none(spark)).count() == 0
    kept = near_dedup.one_of_each(edge.documents(spark))
    assert kept.columns == edge.documents(spark).columns
    keyed = sorted(d for d, p in set(prints) if d is not None and want[p] == d)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(keyed))
    assert sum(r.doc_id is None for r in kept.collect()) == 2


@pytest.mark.parametrize("crowd", [1_000, 20, 2])
def test_links_of_crowds_and_chains(spark, crowd):
    rng = random.Random(11)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(3):  # families around one centre, and chains of three bits a step
        centre = rng.getrandbits(64)
        prints |= {centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(rng.sample(range(64), 9), 2)}
        for _ in range(12):
            prints.add(centre := centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([3, 4]))))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = near_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), crowd)
    pairs = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= 3]
    got = {(r.a, r.b) for r in links.collect()}
    assert all(((a ^ b) % 2**64).bit_count() <= 3 for a, b in got)
    want = smallest(signed, pairs)
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert {p: roots.get(p, p) for p in signed} == want


def test_components_of_long_chains(spark):
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    links = list(zip(ids, ids[1:])) + [(1_000, 1_001), (1_001, 1_000), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(300)}, 1_000: 1_000, 1_001: 1_000}


# --- fingerprints ---------------------------------------------------------------------------------


def test_fingerprints_of_documents(spark, small):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, small).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for i, (key, text) in enumerate(docs):
        following_key, following = docs[(i + 1) % len(docs)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[key]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
        away = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
        assert row.near_edited == pytest.approx(1 - away(row.fingerprint, row.edited_fingerprint) / 128)
        assert row.near_next == pytest.approx(1 - away(row.fingerprint, got[following_key].fingerprint) / 128)
        if key % 50 == 0:
            assert row.n_within == sum(away(row.fingerprint, other.fingerprint) <= 3 for other in got.values())
        else:
            assert row.n_within is None
    table = pd.DataFrame([r.asDict() for r in got.values()])
    assert (table.near_edited > table.near_next).mean() > 0.95


def plain_votes(text):
    """Fingerprint of a text through Spark's hash of each term, voted on here."""
    words = re.split(r"[ \t\n\x0b\f\r]+", text)
    words = [w for w in words if w]
    return list(zip(words, words[1:] + [None]))


def test_votes_against_brute_force(spark):
    texts = ["a", "two words", " The house  by\nthe river ", "", "東京 é 😀 东", edge.LONG[:3_000]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r.id: (r.f0 % 2**64, r.f1 % 2**64) for r in fingerprints.simhash(rows, ["id"], "text").collect()}
    for i, text in enumerate(texts):
        pairs = plain_votes(text)
        table = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
        hashed = table.select(F.xxhash64("a", "b").alias("x"), F.xxhash64(F.lit(1), "a", "b").alias("y"), "a", "b").collect()
        for half in (0, 1):
            votes = [0] * 64
            for r in hashed:
                weight = len(r.a) + len(r.b or "")
                for bit in range(64):
                    votes[bit] += weight if (r[half] % 2**64) >> bit & 1 else -weight
            assert got[i][half] == sum(1 << b for b in range(64) if votes[b] > 0)


def test_order_of_scattered_ids(spark):
    rng = random.Random(4)
    ids = sorted({rng.randrange(-(2**62), 2**62) for _ in range(40)} | set(range(-3, 9_000, 700)) | {2**63 - 1, -(2**63)})
    got = {r.id: r.next for r in fingerprints.following(spark.createDataFrame([(i,) for i in ids], "id bigint")).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1]))


def test_fingerprints_of_odd_rows(spark):
    keyed = sorted(((r[0], r[1] or "") for r in edge.rows() if r[0] is not None))
    want = Counter()
    for i, (key, text) in enumerate(keyed):
        following, half = keyed[(i + 1) % len(keyed)][1], len(text) // 2
        want[key, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()] += 1
    for r in edge.rows():
        if r[0] is None:
            want[None, len(r[1]), hashlib.sha256(r[1][: len(r[1]) - len(r[1]) // 2].encode()).hexdigest()] += 1
    got = fingerprints.fingerprint_report(edge.documents(spark)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all((r.near_next is None) == (r.doc_id is None) for r in got)
    empty = [r for r in got if r.n_chars == 0]
    assert empty and all((r.f0, r.f1) == (0, 0) for r in empty)
    assert fingerprints.fingerprint_report(edge.none(spark)).count() == 0
    one = fingerprints.edited_fingerprints(edge.documents(spark).where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_block_tables_find_everything_in_the_radius(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(5)]
    prints = {b ^ sum(1 << x for x in rng.sample(range(128), n)) for b in base for n in (0, 1, 2, 3, 4, 6) for _ in range(6)}
    halves = lambda p: tuple(h - 2**64 if h >= 2**63 else h for h in (p % 2**64, p >> 64))
    table = spark.createDataFrame([halves(p) for p in prints], "f0 bigint, f1 bigint")
    for radius in (0, 1, 3, 6):
        got = [(r.q0 % 2**64 | (r.q1 % 2**64) << 64, r.f0 % 2**64 | (r.f1 % 2**64) << 64) for r in fingerprints.within_radius(table, table, radius).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= radius}


def test_fingerprint_plans_are_native(spark, small):
    text = plan_of(queries.op1_fingerprints(spark, small))
    text += plan_of(fingerprints.edited_fingerprints(queries.documents(spark, small)))
    assert not re.search("Python|Pandas|Arrow(?!Columnar)|CartesianProduct|NestedLoop", text)


# --- languages ------------------------------------------------------------------------------------


def test_best_path_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.normal(size=(5, 3)) * rng.choice([1, 10])
        penalty = float(rng.choice([0.5, 3, 10]))
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(map(value, itertools.product(range(3), repeat=5)))
        assert value(language_id.best_path(scores, penalty)) == pytest.approx(best)


def trained(rows):
    return language_id.build(pd.concat(language_id.count_rows([pd.DataFrame(rows, columns=["lang", "text"])])))


def test_spans_and_scripts_of_mixed_text():
    model = trained([("en", "the house and the river of them that was with this " * 40), ("de", "der die und das nicht ein schlich keit und zu den " * 40), ("ru", "и в не на он что как это по но из мы " * 40)])
    text = "the river and the house of them, und das ist nicht der ein schlich keit, это он и мы как"
    lang, score, spans = language_id.label(text, model, 5.0)
    assert [s[2] for s in spans] == ["en", "de", "ru"] and 0 < score < 1
    assert text[slice(*spans[0][:2])] == "the river and the house of them"
    assert text[slice(*spans[2][:2])] == "это он и мы как"
    assert language_id.label("щ", model, 5.0)[0] == "ru"  # the script leaves one language
    assert language_id.label("12 !", model, 5.0) == ("und", 0.0, [])


def test_language_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas().set_index("doc_id")
    got = queries.op5_language_id(spark, small).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.doc_id.map(docs.lang)).mean() >= 0.97
    assert got.score.between(0, 1).all() and len(got) == len(docs)


def test_languages_of_odd_rows(spark):
    docs = edge.documents(spark)
    model = language_id.train(docs)
    assert model.languages == ("en", "fr")
    got = language_id.identify(docs, model).collect()
    lettered = {r[0]: any(c.isalpha() for c in r[1] or "") for r in edge.rows() if r[0] != 3}
    assert len(got) == len(edge.rows())
    assert all((r.lang_pred != "und") == lettered[r.doc_id] for r in got if r.doc_id in lettered)
    nothing = language_id.train(edge.none(spark))
    assert nothing.languages == ()
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(edge.none(spark), model).count() == 0


# --- mixing ---------------------------------------------------------------------------------------


def plain_rake(cells, targets):
    weights = dict(cells)
    for _ in range(200):
        for place, target in enumerate(targets):
            sums = defaultdict(float)
            for cell, w in weights.items():
                sums[cell[place]] += w
            weights = {c: w * target.get(c[place], 0) / sums[c[place]] if sums[c[place]] else 0 for c, w in weights.items()}
    return weights


def test_mixing_against_brute_force(spark, small):
    table = mixing.mix(queries.documents(spark, small)).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    assert sorted(table.doc_id) == sorted(docs.doc_id)
    words = dict(zip(docs.doc_id, docs.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))))
    assert (table.n_tokens == table.doc_id.map(words)).all()
    cells = table.groupby(["source", "lang", "topic"]).n_tokens.sum().to_dict()
    targets = []
    for margin in mixing.MARGINS:
        held = table.groupby(margin).n_tokens.sum() ** 0.85
        targets.append((held / held.sum()).to_dict())
    want = plain_rake(cells, targets)
    factor = {c: want[c] / cells[c] for c in cells}
    most = max(factor.values())
    for r in table.itertuples():
        assert r.chance == pytest.approx(factor[r.source, r.lang, r.topic] / most, rel=2e-3)
    assert not (table.taken & (table.chance == 0)).any() and table.taken.mean() == pytest.approx(table.chance.mean(), abs=0.12)
    taken = mixing.sampled(queries.documents(spark, small))
    assert taken.columns == list(docs.columns)
    assert sorted(r.doc_id for r in taken.collect()) == sorted(table[table.taken].doc_id)


def test_mixing_to_given_targets(spark, small):
    target = spark.createDataFrame([("en", 0.25), ("de", 0.75)], "lang string, target double")
    table = mixing.mix(queries.documents(spark, small), targets={"lang": target}).toPandas()
    mass = (table.n_tokens * table.chance).groupby(table.lang).sum()
    assert mass["de"] / mass.sum() == pytest.approx(0.75, abs=1e-3) and mass["fr"] == 0
    assert not table[table.lang == "es"].taken.any()


def test_mixing_of_odd_rows(spark):
    got = mixing.mix(edge.documents(spark)).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3] or "(none)") for r in edge.rows())
    assert all(not r.taken and r.chance == 0 for r in got if r.n_tokens == 0)
    assert mixing.mix(edge.none(spark)).count() == 0
    assert mixing.sampled(edge.none(spark)).count() == 0


# --- pipeline -------------------------------------------------------------------------------------


def test_stages_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "secret_scan", "mixing", "byte_bpe"]
    named = stages["language_id"](spark, docs, small).cache()
    assert named.columns == docs.columns and named.count() == docs.where(F.col("text").rlike("\\p{L}")).count()
    single = stages["near_dedup"](spark, named, small).cache()
    prints = {r.doc_id: plain_simhash(r.text) for r in named.collect()}
    want = plain_components(prints.items())
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, p in prints.items() if want[p] == d)
    assert sorted(tuple(r) for r in single.collect()) == sorted(tuple(r) for r in named.collect() if want[prints[r.doc_id]] == r.doc_id)
    clean = stages["secret_scan"](spark, single, small).cache()
    assert clean.schema == docs.schema and clean.count() == single.count()
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id]) == ("[SECRET]" not in r.text)
        assert not re.search("[0-9a-f]{32}", r.text)
    taken = stages["mixing"](spark, clean, small).cache()
    assert taken.columns == docs.columns and 0 < taken.count() < clean.count()
    last = stages["byte_bpe"](spark, taken, small)
    from pressroom.llm import byte_bpe

    model = byte_bpe.load_encoding("byte_bpe_multi_50k.tiktoken")[0]
    texts = {r.doc_id: r.text for r in taken.collect()}
    got = {r.doc_id: r.ids for r in last.collect()}
    assert got == {d: model.encode_ordinary(t) for d, t in texts.items()}
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, small).collect()) == sorted(tuple(r) for r in last.collect())


def test_stages_of_odd_rows(spark):
    docs = edge.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, "")
        assert (name == "byte_bpe") != (made.columns == docs.columns)
        assert made.count() <= docs.count()
        assert stage(spark, edge.none(spark), "").count() == 0
    bare = spark.createDataFrame([(i, None, None, None, None) for i in range(3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [stage(spark, bare, "").count() for _, stage in corpus_pipeline.STAGES] == [0, 1, 3, 0, 3]
