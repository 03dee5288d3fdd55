"""Language identification of text that may change its language.

Training counts hashed letter trigrams per language, and which scripts a language is written in. A text
is cut into runs of letters; the script of a run narrows the languages it may be in, its trigrams score
those that remain, and a Viterbi pass over the runs, with a penalty for every change of language, labels
spans. Most texts need no pass: when no stretch of runs gains as much from other languages as one
change costs, the single best language is the best path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.llm.rows import bound_batches, over_texts, text_function

BUCKETS = 2**15
#: Numbers of a text's scores that are made at once.
LETTERS = 2**22
# Scripts and the code points they cover; letters elsewhere are of script 0.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3FFFF)],
}
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its lower-case letter (a blank for anything else), and its script."""
    lower = np.full(0x110000, 32, dtype=np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            small = c.lower()
            lower[code] = ord(small) if len(small) == 1 else code
    script = np.zeros(0x110000, dtype=np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            script[low : high + 1] = number
    return lower, script


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: the trigram bucket of each letter, and the start, end and script of each run of letters.

    Starts count letters within ``buckets``; ends are places in the text.
    """
    lower, script = letter_tables()
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    small = np.empty(len(codes) + 2, dtype=np.uint32)
    small[0] = small[-1] = 32
    small[1:-1] = lower[codes]
    at = np.flatnonzero(small != 32)
    mixed = (small[at - 1] * np.uint32(0x9E3779B1)) ^ (small[at] * np.uint32(0x85EBCA6B)) ^ (small[at + 1] * np.uint32(0xC2B2AE35))
    buckets = ((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1) > 1)
    if len(at) and (not len(first) or first[0] != 0):
        first = np.concatenate([[0], first])
    last = np.append(first[1:], len(at)) - 1
    return buckets, first, at[last] if len(at) else first, script[codes[at[first] - 1]] if len(at) else first


@dataclass(frozen=True)
class Model:
    """Log-probabilities of the buckets per language, and the scripts each language uses."""

    languages: tuple[str, ...]
    logs: np.ndarray  # buckets x languages
    scripts: np.ndarray  # scripts x languages, true where the language uses the script


def count_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, feature, n) of each batch: trigram buckets, and from BUCKETS on, scripts of runs."""
    width = BUCKETS + len(SCRIPTS) + 1
    for batch in batches:
        counts: dict[str, np.ndarray] = {}
        for lang, text in zip(batch["lang"], batch["text"]):
            buckets, _, _, scripts = trigrams(text)
            total = counts.setdefault(lang, np.zeros(width, dtype=np.int64))
            total += np.bincount(np.concatenate([buckets, scripts.astype(np.int64) + BUCKETS]), minlength=width)
        for lang, total in counts.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "feature": used, "n": total[used]})


def build(counts: pd.DataFrame, smoothing: float = 0.5, script_share: float = 0.01) -> Model:
    """The model of (lang, feature, n) counts."""
    languages = tuple(sorted(counts["lang"].unique()))
    table = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    at = counts["feature"].to_numpy(dtype=np.int64), counts["lang"].map(place).to_numpy(dtype=np.int64)
    table[at] = counts["n"].to_numpy(dtype=np.float64)
    grams, scripts = table[:BUCKETS] + smoothing, table[BUCKETS:]
    shares = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), shares >= script_share)


def train(
    docs: DataFrame,
    per_language: int = 2_000,
    most_languages: int = 1_000,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> Model:
    """A model of the labelled rows of ``docs``.

    Per language, about ``per_language`` rows are read, chosen by a hash of the key: each row is taken with
    the same chance, ``per_language`` over the language's count. Texts are not shuffled. Of more than
    ``most_languages`` labels, those with most rows are learned, of equal counts the first in order; the others are no
    language of the model. The driver receives the counts of these languages and at most ``BUCKETS`` counts for each. A
    table without labelled rows gives a model without languages.
    """
    labelled = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    bound_batches(docs.sparkSession)
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    counts = counted.orderBy(F.desc("rows"), "lang").limit(most_languages).collect()
    if not counts:
        return build(pd.DataFrame({"lang": [], "feature": [], "n": []}))
    share = {row["lang"]: per_language / row["rows"] for row in counts}

    @F.pandas_udf("double")
    def wanted(langs: pd.Series) -> pd.Series:
        return langs.map(share).fillna(0.0).astype("float64")

    chance = F.pmod(F.xxhash64(F.col("key")), F.lit(1_000_000)) / 1_000_000
    chosen = labelled.where(chance < wanted("lang")).select("lang", "text")
    summed = (
        chosen.mapInPandas(count_rows, "lang string, feature bigint, n bigint")
        .groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    )
    return build(summed.toPandas())


def largest_gain(scores: np.ndarray, best: int) -> float:
    """The most that a stretch of runs could gain, each run in its best language other than ``best``."""
    others = scores.copy()
    others[:, best] = -np.inf
    sums = np.append(0.0, np.cumsum(others.max(axis=1) - scores[:, best]))
    return float((sums[1:] - np.minimum.accumulate(sums)[:-1]).max())


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Label of every run: the path of largest score, less ``penalty`` for every change."""
    runs, n = scores.shape
    best = int(scores.sum(axis=0).argmax())
    # A path has at least as many changes as stretches off the best language; none of them can pay for its own.
    if n == 1 or largest_gain(scores, best) < penalty:
        return np.full(runs, best)
    here, back = scores[0].copy(), np.empty((runs, n), dtype=np.int16)
    stay = np.arange(n)
    for i in range(1, runs):
        top = int(here.argmax())
        moved = here[top] - penalty > here
        back[i] = np.where(moved, top, stay)
        here = np.where(moved, here[top] - penalty, here) + scores[i]
    labels = np.empty(runs, dtype=np.int64)
    labels[-1] = int(here.argmax())
    for i in range(runs - 1, 0, -1):
        labels[i - 1] = back[i, labels[i]]
    return labels


def run_scores(model: Model, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-probability of every run of letters under every language, ``LETTERS`` numbers at a time."""
    scores = np.zeros((len(first), len(model.languages)))
    step = max(1, LETTERS // len(model.languages))
    for low in range(0, len(buckets), step):
        part = buckets[low : low + step]
        a, b = int(np.searchsorted(first, low, side="right")) - 1, int(np.searchsorted(first, low + len(part)))
        scores[a:b] += np.add.reduceat(model.logs[part], np.maximum(first[a:b], low) - low, axis=0)
    return scores


def label(text: str, model: Model, penalty: float) -> tuple[str, float, list[tuple[int, int, str]]]:
    """(language, score, spans of (start, end, language)) of a text."""
    buckets, first, ends, scripts = trigrams(text)
    if not len(first) or not model.languages:
        return UNKNOWN, 0.0, []
    scores = run_scores(model, buckets, first)
    allowed = model.scripts[scripts]
    allowed |= ~allowed.any(axis=1, keepdims=True)
    letters = np.diff(np.append(first, len(buckets)))
    scores = np.where(allowed, scores, scores.min(axis=1, keepdims=True) - penalty * letters[:, None])
    labels = best_path(scores, penalty)
    held = np.bincount(labels, weights=letters, minlength=len(model.languages))
    found = int(held.argmax())
    totals = scores.sum(axis=0)
    margin = totals[found] - np.delete(totals, found).max() if len(totals) > 1 else np.inf
    sure = 1 / (1 + np.exp(-max(min(margin, 50.0), -50.0))) if len(totals) > 1 else 1.0
    starts = np.flatnonzero(np.diff(labels, prepend=-1))
    begins = ends - letters
    spans = [
        (int(begins[a]), int(ends[b - 1]), model.languages[labels[a]])
        for a, b in zip(starts, np.append(starts[1:], len(labels)))
    ]
    return model.languages[found], float(held[found] / held.sum() * sure), spans


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether the row is kept from training, by the CRC-32 of its key as text; a null key counts as ''."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def identify(
    docs: DataFrame, model: Model, penalty: float = 15.0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, lang_pred, score and spans (array of struct(start, end, lang), code points) of every text.

    ``score`` is the share of letters that the language holds, times the probability of its whole-text score
    against the next language's. A text that is null or has no letter is ``und`` with score 0 and no spans,
    as is every text under a model without languages. Ties go to the first language in order. Every row
    gives one row, repeated and null keys too; an empty table gives no rows. Other columns are not read.
    """
    schema = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    return over_texts(docs, lambda value: label(value, model, penalty), schema, key, text)


def text_language(model: Model, penalty: float = 15.0):
    """A function of a text column: struct of lang_pred, score, and has_letters (false for a null text).

    Declared nondeterministic, so that a filter on one field and a projection of another run it once.
    """

    def found(text: str) -> tuple[str, float, bool]:
        lang, score, spans = label(text, model, penalty)
        return lang, score, bool(spans) or any(map(str.isalpha, text))

    return text_function(found, "lang_pred string, score double, has_letters boolean").asNondeterministic()
