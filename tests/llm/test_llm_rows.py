"""Operators that work row by row, against plain versions of what they promise."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
from collections import Counter

import edge
import pandas as pd
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pressroom.llm import byte_bpe, html_text, licenses, quality, queries, secret_scan, token_counts

PIECES = [" ", "\n", "  ", "a", "the ", "ing", "é", "東", "'s", "123", "<|endoftext|>", "!?", "\t", " ", "😀", "x" * 40, " of"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=160).map("".join)


def run(df, key="doc_id"):
    return [r.asDict() for r in df.collect()]


# --- token counts ---------------------------------------------------------------------------------


def tokens_of(text):
    model = token_counts.load_tokenizer("byte_bpe_50k.json")
    return len(model.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(8, 60), st.integers(1, 7))
def test_chunks_count_the_same_tokens(text, chunk, overlap):
    model = token_counts.load_tokenizer("byte_bpe_50k.json")
    encode = lambda part: model.encode(part, add_special_tokens=False)
    assert token_counts.count_tokens(text, encode, chunk, min(overlap, chunk - 1))[0] == tokens_of(text)


def test_token_counts_of_odd_rows(spark):
    got = run(token_counts.token_counts(edge.documents(spark), chunk=2_000))
    want = [(r[0], len((r[1] or "").encode()), tokens_of(r[1] or "")) for r in edge.rows()]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == Counter(want)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert any(r["n_chunks"] > 1 for r in got)
    assert token_counts.token_counts(edge.none(spark)).count() == 0


# --- byte-level BPE -------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(2, 40), st.integers(1, 9))
def test_tree_gives_the_ids_of_the_whole_text(text, leaf, window):
    model, _, lengths = byte_bpe.load_encoding("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode_tree(text, model.encode_ordinary, lengths, leaf, window)
    assert ids == model.encode_ordinary(text)
    assert byte_bpe.decode_tree(ids, model.decode_bytes, 3) == text.encode()


def test_round_trip_of_odd_rows(spark):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    model = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in edge.rows():
        ids = model.encode_ordinary(r[1] or "")
        hashed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[r[0], len(ids), hashed, hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    got = run(byte_bpe.round_trip(edge.documents(spark)))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert all(r["lossless"] for r in got)
    assert byte_bpe.round_trip(edge.none(spark)).count() == 0


# --- secrets --------------------------------------------------------------------------------------


def plain_base(text):
    found = []
    pattern = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[1]) > 7]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) > 15]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) > 31]
    return [s for _, _, s in sorted(found)]


SECRET_PIECES = ["password", "TOKEN", "api_key", "apiKey", "secret", '"', "'", " ", ":", "=", "abc", "0f" * 9, "AKIA", "ABCD" * 3, "=x", "\n", "ſecret", "Z9_"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SECRET_PIECES), max_size=30).map("".join))
def test_base_spans(text):
    base, every = secret_scan.find_spans(text, 4.5)
    assert secret_scan.listed(base) == ",".join(plain_base(text))
    assert [s for s in every if s[2] != "novel"] == base


def test_novel_strings_need_context_and_novelty():
    find = lambda text: [(text[a:b], k) for a, b, k in secret_scan.find_spans(text, 4.5)[1]]
    value = "sk_live_9aF3kD02mQ7xZp1LwB8r"
    assert find(f"client auth {value} here") == [(value, "novel")]
    assert find(f"shelf mark {value} here") == []
    assert find("session access_account_action_address_admin_123") == []
    assert find(f"again key {value}, {value} {value}")[:1] == []  # known from its surroundings
    long = "".join(random.Random(3).choices(string.ascii_letters + string.digits, k=20_000))
    assert find("bearer " + long) == [(long, "novel")]


def test_secrets_of_odd_rows(spark):
    got = run(secret_scan.secret_digest(edge.documents(spark)))
    want = Counter((r[0], hashlib.sha256(",".join(plain_base(r[1] or "")).encode()).hexdigest()) for r in edge.rows())
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    found = next(r for r in got if r["n_assign"])
    assert (found["n_assign"], found["n_access"], found["n_hex"]) == (1, 1, 1)
    assert found["base_sha256"] == hashlib.sha256(found["spans"].encode()).hexdigest()
    assert secret_scan.secret_digest(edge.none(spark)).count() == 0
    clean = secret_scan.redacted(edge.documents(spark))
    assert clean.columns == edge.documents(spark).columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[9] == "[SECRET] token: abc [SECRET] [SECRET]".replace("[SECRET] token", '[SECRET]" token')
    assert texts[2] is None and texts[5] == edge.LONG


# --- licenses -------------------------------------------------------------------------------------


def plain_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


LICENSE_PIECES = ["MIT", "License", "apache", "GNU", "General", "public", " ", "\n", ", ", "license", "x1", "é", "-", "KelvinK"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(LICENSE_PIECES), max_size=40).map("".join))
def test_base_phrases(text):
    assert licenses.scan(text, 0.08)[:5] == plain_license(text)


def test_notices_with_edits_are_found_where_they_stand():
    rng = random.Random(5)
    for notice, label in licenses.NOTICES.items():
        edits = licenses.allowed_edits(notice, 0.08)
        changed = list(notice)
        for at in rng.sample(range(1, len(notice) - 1), edits):
            changed[at] = "q"
        text = "Some words.\n\n" + "".join(changed).upper().replace(" ", "\n  ", 1) + " and more"
        spans = licenses.scan(text, 0.08)[7]
        assert any(found == label and a >= 10 and b <= len(text) - 7 for a, b, found, _ in spans), notice
    assert licenses.scan("a licence to drive, released to the public by the city", 0.08)[5] == ""


def test_fuzzy_search_equals_search_without_seeds():
    import regex

    rng = random.Random(9)
    for notice, label in list(licenses.NOTICES.items())[:6]:
        edits = licenses.allowed_edits(notice, 0.08)
        for changes in range(edits + 3):
            letters = list(notice)
            for _ in range(changes):
                at = rng.randrange(len(letters))
                letters[at : at + rng.randint(0, 1)] = rng.choice(["", "z", letters[at] + "k"])
            text = "before it " + "".join(letters) + " after it"
            hit = regex.search(f"(?:{regex.escape(notice)}){{e<={edits}}}", text) is not None
            assert (label in [s[2] for s in licenses.fuzzy_spans(text, 0.08)]) == hit or not hit


def test_neighbouring_notices_are_each_found():
    near, exact = "released undr the mit license", "released under the mit license"
    assert licenses.fuzzy_spans(f"{near} {exact}", 0.08) == [(0, 29, "mit", 1), (30, 60, "mit", 0)]
    text = "\n".join([exact, near] * 200)
    spans = licenses.fuzzy_spans(text, 0.08)
    assert [text[a:b] for a, b, _, _ in spans] == [exact, near] * 200


def test_fewest_edits_equals_the_whole_table():
    def table(window, notice):
        column = list(range(len(notice) + 1))
        best = column[-1]
        for letter in window:
            beside = [0]
            for i, wanted in enumerate(notice, 1):
                beside.append(min(column[i - 1] + (wanted != letter), column[i] + 1, beside[i - 1] + 1))
            column, best = beside, min(best, beside[-1])
        return best

    rng = random.Random(3)
    for _ in range(1000):
        notice = "".join(rng.choices("abc", k=rng.randint(1, 12)))
        window = "".join(rng.choices("abcd", k=rng.randint(0, 25)))
        assert licenses.fewest_edits(window, licenses.letter_masks(notice), len(notice)) == table(window, notice)


def test_licenses_of_odd_rows(spark):
    got = run(licenses.license_scan(edge.documents(spark)))
    want = Counter((r[0], *plain_license(r[1] or "")) for r in edge.rows())
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    both = next(r for r in got if r["base_labels"])
    assert both["labels"] == "apache,mit" and both["score"] == 1.0
    assert licenses.license_scan(edge.none(spark)).count() == 0


# --- quality --------------------------------------------------------------------------------------


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return n, sum(map(len, words)), symbols, repeated, len(inside), n < 50 or 100 * len(inside) > 50 * n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c d", "\n", " ", "#", "é|", " ", "\r", "\x1f"]), max_size=120).map("".join))
def test_quality_counts(text):
    assert quality.judge(text, {}, quality.Limits())[:6] == plain_quality(text)


def test_distance():
    import numpy as np

    assert quality.distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality.distance(np.array([0.3, 0.7]), np.array([0.3, 0.7])) == 0


def test_quality_of_odd_rows(spark):
    docs = edge.documents(spark)
    references = quality.collected(quality.language_references(docs))
    assert set(references) == {"en", "fr"}
    en = [r[1] for r in edge.rows() if r[2] == "en" and r[1] is not None]
    letters = sum(len(t) for t in en)
    place = quality.CLASSES.index("newline")
    assert references["en"][0][place] == pytest.approx(sum(t.count("\n") for t in en) / letters)
    assert references["en"][2].sum() == pytest.approx(1)
    got = run(quality.quality_rules(docs, references))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in got) == Counter((r[0], *plain_quality(r[1] or "")) for r in edge.rows())
    assert not any(r["kept"] and r["base_failed"] for r in got)
    empty = quality.collected(quality.language_references(edge.none(spark)))
    assert empty == {} and quality.quality_rules(edge.none(spark), empty).count() == 0


def test_quality_verdicts_on_labelled_documents(spark, small):
    got = queries.op9_quality_rules(spark, small).select("doc_id", "kept", "base_failed")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    table = got.join(labels, "doc_id").toPandas()
    junk, clean = table[table.quality == 0], table[(table.quality == 1) & ~table.base_failed]
    assert junk.kept.mean() <= 0.1 and clean.kept.mean() >= 0.98


# --- pages ----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{x:1}</style><script>var a="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><h2>Site no</h2></header><nav><ul><li><a href="/a>b">no</a><li><a href="/">no</a></ul></nav>
<div class="cookie-notice">We no cookies here, and a long notice of many words stands in this place.</div>
<article class="post"><h1>The &lt;title&gt;</h1><p>First  block<br>goes\non &eacute;&#233;.<p><b>Second</b> <a href="x">one</a>
<ul><li>item one</li><li>item two</ul><aside>no aside</aside><form><label>no</label><input></form><div class="ad">no advert</div>
<!-- no <p>comment</p> --><p>Last.</p><section id="comments"><article><p>A reader says no to all of this at length.</p></article></section></article>
<div id="sidebar"><p>no</p></div><footer>&copy; no</footer>"""


def test_main_text_of_a_page():
    want = ["The <title>", "First block goes on éé.", "Second one", "item one", "item two", "Last."]
    assert html_text.main_blocks(PAGE) == want
    assert html_text.main_blocks(PAGE.replace("<article class=\"post\">", "<div class=\"entry-content\">")) == want


def test_tree_agrees_with_its_table():
    assert all(html_text.is_main(row[:-1], html_text.tree()) == bool(row[-1]) for row in html_text.LABELLED)


def test_a_page_without_structure():
    body = " ".join(edge.WORDS * 3)
    page = f"<div><a href=a>Home</a></div><div><a href=b>News</a></div><p>{body}</p><p>{body}</p><div><a href=c>Next</a></div>"
    assert html_text.main_blocks(page) == [body, body]


def test_main_text_of_generated_pages(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    import html as entities

    for r in queries.op8_html_text(spark, small).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<", "<a href='", "'>", "</a>", "<script>", "</script>", "<!--", "-->", "x ", "&amp;", "<article>", "</div>", "<div class=\"ad", "\">"]), max_size=40).map("".join))
def test_malformed_pages_do_not_fail(page):
    assert all(b and b == " ".join(b.split()) for b in html_text.main_blocks(page))


def test_odd_pages(spark):
    schema = "page_id bigint, url string, html string, kept string, made string, text string"
    rows = [(1, None, None, *"abc"), (1, "u", "", *"abc"), (None, "u", "<p>x", *"abc"), (2, "u", PAGE, *"abc"), (2, "u", PAGE, *"abc")]
    got = run(html_text.extract(spark.createDataFrame(rows, schema)))
    assert sorted(r["n_blocks"] for r in got) in ([0, 0, 0, 6, 6], [0, 0, 1, 6, 6])
    assert {r["text"] for r in got if r["page_id"] == 1} == {""}
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    assert isinstance(pd.DataFrame(got), pd.DataFrame)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_pieces_count_the_same_tokens(texts):
    model, counts = token_counts.load_tokenizer("byte_bpe_50k.json"), token_counts.Counts()
    assert [counts.of(t, model) for t in [*texts, *texts]] == [tokens_of(t) for t in [*texts, *texts]]


def test_other_tokenizers_encode_whole_texts():
    assert token_counts.splits_are_certain("byte_bpe_50k.json")
    assert not token_counts.splits_are_certain("word_bpe_49k.json")
