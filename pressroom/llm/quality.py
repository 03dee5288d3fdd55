"""Quality rules: counts with fixed limits, and divergence from what each language usually looks like.

Two histograms describe a text: the classes of its characters, and how often it uses each of its language's
common words. The references are the same histograms over all documents of a language; its common words
are the ``common`` most frequent ones of at most ``longest`` letters, counted over all documents. A text is
as far from a language as the larger of its two Jensen-Shannon distances, and it is judged by the nearest
language. Short texts have noisy histograms, so a text under ``min_chars`` characters or ``min_words`` words
is not judged by them, and the limits of the others carry a part that falls with the root of the words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.rows import WORD, bound_batches, over_texts
from pressroom.operators.skew import first_rows
from pressroom.session import cut_lineage

WORDS = re.compile(WORD)
LETTERS = re.compile(r"[^\W\d_]+")
# The classes of characters, the first that fits.
CLASSES = ("newline", "blank", "lower", "upper", "letter", "digit", "stop", "bar", "symbol", "other")
STOPS = ".,;:!?'\"()-"
BARS = "|¦_=~"


@dataclass(frozen=True)
class Limits:
    """Largest distances of a kept text: a part for any length, and one that shrinks as 1 / sqrt(words)."""

    classes: float = 0.14
    class_noise: float = 0.8
    words: float = 0.2
    word_noise: float = 1.6
    min_chars: int = 200
    min_words: int = 50


def class_table() -> np.ndarray:
    """Class of every code point below 65,536; the others are letters."""
    kinds = {name: i for i, name in enumerate(CLASSES)}
    table = np.empty(65_536, dtype=np.uint8)
    for code in range(65_536):
        c = chr(code)
        if c == "\n":
            name = "newline"
        elif c.isspace():
            name = "blank"
        elif c.islower():
            name = "lower"
        elif c.isupper():
            name = "upper"
        elif c.isalpha():
            name = "letter"
        elif c.isdigit():
            name = "digit"
        elif c in STOPS:
            name = "stop"
        elif c in BARS:
            name = "bar"
        elif c.isprintable():
            name = "symbol"
        else:
            name = "other"
        table[code] = kinds[name]
    return table


CLASS_OF: list[np.ndarray] = []


def class_counts(text: str) -> np.ndarray:
    """How many characters of each class."""
    if not CLASS_OF:
        CLASS_OF.append(class_table())
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    counts = np.bincount(CLASS_OF[0][codes[codes < 65_536]], minlength=len(CLASSES))
    counts[CLASSES.index("letter")] += int((codes >= 65_536).sum())
    return counts


def short_words(text: str, longest: int) -> Counter:
    """Counts of lower-case words of at most ``longest`` letters; the key "" counts the longer ones."""
    counts: Counter = Counter()
    for word, n in Counter(LETTERS.findall(text.lower())).items():
        counts[word if len(word) <= longest else ""] += n
    return counts


def partial_counts(batches: Iterable[pd.DataFrame], longest: int) -> Iterator[pd.DataFrame]:
    """(lang, kind, name, n) of each batch: character classes and short words."""
    for batch in batches:
        classes: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"], batch["text"]):
            classes[lang] = classes.get(lang, 0) + class_counts(text)
            words.setdefault(lang, Counter()).update(short_words(text, longest))
        rows = [(lang, "class", name, int(n)) for lang, counts in classes.items() for name, n in zip(CLASSES, counts)]
        rows += [(lang, "word", word, n) for lang, counts in words.items() for word, n in counts.items()]
        yield pd.DataFrame(rows, columns=["lang", "kind", "name", "n"])


def language_references(
    docs: DataFrame, common: int = 40, longest: int = 6, text: str = "text", lang: str = "lang", most_languages: int = 1_000
) -> DataFrame:
    """(lang, kind, name, share) over all documents with a text and a language.

    ``class`` rows hold the shares of the character classes, ``word`` rows those of the common words and,
    under the name "", of all other words. At most ``common + 1 + len(CLASSES)`` rows per language. Of more than
    ``most_languages`` labels, those with most characters are references, of equal ones the first in order.
    """
    bound_batches(docs.sparkSession)
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    parts = known.mapInPandas(
        lambda batches: partial_counts(batches, longest), "lang string, kind string, name string, n bigint"
    )
    counts = cut_lineage(parts.groupBy("lang", "kind", "name").agg(F.sum("n").alias("n")).where("n > 0"))
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    largest = totals.where("kind = 'class'").orderBy(F.desc("total"), "lang").limit(most_languages).select("lang")
    counts, totals = (table.join(F.broadcast(largest), "lang", "left_semi") for table in (counts, totals))
    words = counts.where("kind = 'word' AND name != ''")
    per_language = first_rows(words, ["lang"], [F.col("n").desc(), F.col("name")], common, "_rank").drop("_rank")
    rest = totals.where("kind = 'word'").join(
        per_language.groupBy("lang").agg(F.sum("n").alias("used")), "lang", "left"
    ).select("lang", "kind", F.lit("").alias("name"), (F.col("total") - F.coalesce("used", F.lit(0))).alias("n"))
    kept = counts.where("kind = 'class'").unionByName(per_language).unionByName(rest)
    return kept.join(totals, ["lang", "kind"]).select("lang", "kind", "name", (F.col("n") / F.col("total")).alias("share"))


def collected(references: DataFrame) -> dict[str, tuple[np.ndarray, list[str], np.ndarray]]:
    """Per language: class shares, common words, and their shares with that of the rest last."""
    table = references.toPandas()
    found = {}
    for lang, rows in table.groupby("lang"):
        classes = dict(rows[rows.kind == "class"][["name", "share"]].values)
        words = dict(rows[rows.kind == "word"].sort_values("name")[["name", "share"]].values)
        rest = words.pop("", 0.0)
        shares = np.array([*words.values(), rest], dtype=float)
        found[lang] = np.array([classes.get(name, 0.0) for name in CLASSES], dtype=float), list(words), shares
    return found


@dataclass(frozen=True)
class Stacked:
    """The references of all languages as tables of one row each, so that a text is compared with all of them at once."""

    languages: tuple[str, ...]
    classes: np.ndarray  # languages x classes
    places: dict[str, int]  # of each common word of any language in a text's counts
    words: np.ndarray  # languages x common words: their places; the last place is never counted
    shares: np.ndarray  # languages x (common words, and the rest)


def stacked(references: dict) -> Stacked | None:
    """The references of ``collected`` as tables; None without any."""
    if not references:
        return None
    places: dict[str, int] = {}
    for _, common, _ in references.values():
        for word in common:
            places.setdefault(word, len(places))
    width = max(len(common) for _, common, _ in references.values())
    words = np.full((len(references), width), len(places))
    shares = np.zeros((len(references), width + 1))
    for i, (_, common, own) in enumerate(references.values()):
        words[i, : len(common)] = [places[word] for word in common]
        shares[i, : len(common)], shares[i, -1] = own[:-1], own[-1]
    return Stacked(tuple(references), np.array([usual for usual, _, _ in references.values()]), places, words, shares)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray | float:
    """Jensen-Shannon distance of distributions along the last axis, base 2: 0 for equal ones, 1 for disjoint ones."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum(0.0, parts.sum(axis=-1) / 2))


def divergence(text: str, references: Stacked | None) -> tuple[str | None, float | None, float | None]:
    """Nearest language with the distances of the characters and of the common words; nulls without any letter."""
    counts = class_counts(text)
    words = Counter(LETTERS.findall(text.lower()))
    total = sum(words.values())
    if not references or not total:
        return None, None, None
    held = np.zeros(len(references.places) + 1)
    for word, n in words.items():
        place = references.places.get(word)
        if place is not None:
            held[place] = n
    used = held[references.words]
    mine = np.concatenate([used, total - used.sum(axis=1, keepdims=True)], axis=1) / total
    by_class, by_word = distance(counts / counts.sum(), references.classes), distance(mine, references.shares)
    best = int(np.maximum(by_class, by_word).argmin())
    return references.languages[best], float(by_class[best]), float(by_word[best])


def repeated_words(words: list[str]) -> int:
    """Words in windows of three that stand twice or more in the text, first ones included."""
    if len(words) < 4:
        return 0
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(word, len(index)) for word in words], dtype=np.int64)
    pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            repeated += line in seen
            seen.add(line)
    return repeated


def judge(text: str, references: Stacked | None, limits: Limits) -> tuple:
    words = WORDS.findall(text)
    n, repeats = len(words), repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    lang, by_class, by_word = divergence(text, references)
    noise = 1 / np.sqrt(max(n, 1))
    far = bool(
        (by_class or 0.0) > limits.classes + limits.class_noise * noise
        or (by_word or 0.0) > limits.words + limits.word_noise * noise
    )
    kept = not failed and not (far and len(text) >= limits.min_chars and n >= limits.min_words)
    symbols = sum(map(text.count, "#*$%&|<>"))
    return n, sum(map(len, words)), symbols, duplicate_lines(text), repeats, failed, kept, lang, by_class, by_word


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, nearest_lang string, class_distance double, word_distance double"
)


def quality_rules(
    docs: DataFrame,
    references: dict,
    limits: Limits = Limits(),
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Counts and verdict of every text against ``references`` (from ``collected``).

    A null or empty text has no words, fails the base rule and has null distances, as has a text without
    letters. Without references only the base rule decides. Every row gives one row, repeated and null
    keys too; an empty table gives no rows. Other columns are not read. Texts are read whole.
    """

    tables = stacked(references)

    def judged(value: str) -> tuple:
        return judge(value, tables, limits)

    return over_texts(docs, judged, SCHEMA, key, text)
