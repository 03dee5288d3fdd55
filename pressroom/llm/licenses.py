"""License notices in text: base phrases on words, and short notices with a bounded number of edits.

A notice that may hold up to k edits is cut into k + 1 pieces; at least one of them stands in the text
unchanged. An Aho-Corasick automaton over all pieces of all notices finds those seeds in one pass. Each
seed tells where its notice can start, up to k characters. Starts within 2k of each other share a window,
too short for two notices. The edit table of the window gives the fewest edits; when these are at most k, the
regex library matches the notice with as many insertions, deletions and substitutions and reports the span.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame

from pressroom.llm.rows import ascii_lowered, over_texts

# The words, and the base phrases with their labels.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
# Short notices and the labels they give. All are in lower case with single blanks.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "licensed under the apache license, version 2.0": "apache",
    "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0": "apache",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license, v. 2.0": "mpl",
    "redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
    "licensed under the eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution 4.0 international license": "cc-by",
    "licensed under a creative commons attribution-sharealike 4.0 international license": "cc-by-sa",
}


def allowed_edits(notice: str, share: float) -> int:
    return max(1, int(len(notice) * share))


def letter_masks(notice: str) -> dict[str, int]:
    """For each letter, the bits of the places where it stands."""
    masks: dict[str, int] = {}
    for place, letter in enumerate(notice):
        masks[letter] = masks.get(letter, 0) | 1 << place
    return masks


def fewest_edits(window: str, masks: dict[str, int], size: int) -> int:
    """The fewest edits that turn some stretch of ``window`` into the notice of ``size`` letters.

    A column of the edit table is held as two numbers, one bit per letter, for steps up and steps down.
    """
    every, last = (1 << size) - 1, 1 << (size - 1)
    up, down, edits, best = every, 0, size, size
    for letter in window:
        same = masks.get(letter, 0)
        equal = (((same & up) + up) ^ up) | same | down
        rise, fall = (down | ~(equal | up)) & every, up & equal
        edits += bool(rise & last) - bool(fall & last)
        best = min(best, edits)
        rise, fall = (rise << 1) & every, (fall << 1) & every
        moved = same | down
        up, down = (fall | ~(moved | rise)) & every, rise & moved
    return best


@lru_cache(maxsize=4)
def automaton(share: float):
    """(Aho-Corasick automaton of all seeds; of each notice its pattern per number of edits, and its letters)."""
    import ahocorasick
    import regex

    seeds: dict[str, list] = {}
    patterns = []
    for number, (notice, label) in enumerate(NOTICES.items()):
        edits = allowed_edits(notice, share)
        exact = [regex.compile(f"(?:{regex.escape(notice)}){{e<={most}}}") for most in range(edits + 1)]
        patterns.append((exact, edits, len(notice), label, letter_masks(notice)))
        cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
        for low, high in zip(cuts, cuts[1:]):
            seeds.setdefault(notice[low:high], []).append((number, low))
    machine = ahocorasick.Automaton()
    for seed, uses in seeds.items():
        machine.add_word(seed, (len(seed), uses))
    machine.make_automaton()
    return machine, patterns


GAP = re.compile(r"[\x20\t-\r]+")


def places_of(lower: str) -> list[int]:
    """Where each character of ``GAP.sub(" ", lower)`` stood, and the length at the end."""
    places, done = [], 0
    for gap in GAP.finditer(lower):
        places.extend(range(done, gap.start() + 1))
        done = gap.end()
    places.extend(range(done, len(lower) + 1))
    return places


def close_runs(places: list[int], width: int) -> list[tuple[int, int]]:
    """First and last of each run of ascending places, none wider than ``width``."""
    runs: list[tuple[int, int]] = []
    for place in places:
        if runs and place - runs[-1][0] <= width:
            runs[-1] = runs[-1][0], place
        else:
            runs.append((place, place))
    return runs


def fuzzy_spans(lower: str, share: float) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) of every notice found in lower-case text; of overlapping finds of one label the closest stays."""
    machine, patterns = automaton(share)
    plain = GAP.sub(" ", lower)
    starts: dict[int, set[int]] = {}
    for last, (length, uses) in machine.iter(plain):
        for number, offset in uses:
            starts.setdefault(number, set()).add(last - length + 1 - offset)
    found = []
    for number, places in starts.items():
        exact, edits, size, label, masks = patterns[number]
        for first, final in close_runs(sorted(places), 2 * edits):
            low, high = max(0, first - edits), min(len(plain), final + size + edits)
            for most in range(fewest_edits(plain[low:high], masks, size), edits + 1):
                if match := exact[most].search(plain, low, high):
                    found.append((match.start(), match.end(), label, sum(match.fuzzy_counts), size))
                    break
    kept: list[tuple] = []
    held: dict[str, list[tuple[int, int]]] = {}
    for item in sorted(found, key=lambda f: (f[3] / f[4], f[0], f[1], f[2])):
        same = held.setdefault(item[2], [])
        at = bisect_left(same, item[:2])
        if (at == 0 or same[at - 1][1] <= item[0]) and (at == len(same) or item[1] <= same[at][0]):
            same.insert(at, item[:2])
            kept.append(item)
    if kept and len(plain) != len(lower):
        places = places_of(lower)
        kept = [(places[a], places[b - 1] + 1, label, edits, size) for a, b, label, edits, size in kept]
    return sorted((a, b, label, edits) for a, b, label, edits, _ in kept)


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    places = []
    for i, word in enumerate(words):
        if word == "license":
            for phrase, label in PHRASES.items():
                start = i - len(phrase) + 1
                if start >= 0 and tuple(words[start : i + 1]) == phrase:
                    places.append((start, label))
    return sorted(places)


def scan(text: str, share: float) -> tuple:
    lower = ascii_lowered(text)
    words = WORD.findall(lower)
    places = base_places(words) if "license" in lower else []
    spans = fuzzy_spans(lower, share)
    base = sorted({label for _, label in places})
    every = sorted({*base, *(label for _, _, label, _ in spans)})
    longest = {label: 1.0 for label in base}
    for start, end, label, edits in spans:
        longest[label] = max(longest.get(label, 0.0), 1 - edits / max(1, end - start))
    return (
        len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
        ",".join(base), ",".join(every), float(max(longest.values(), default=0.0)), spans,
    )


SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, spans array<struct<start:int,end:int,label:string,edits:int>>"
)


def license_scan(docs: DataFrame, edit_share: float = 0.08, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Notices of every text: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` are the fuzzy finds in code points of the text, end exclusive; a notice of n characters may
    hold ``edit_share * n`` edits, rounded down, at least one. ``score`` is 1 for a base phrase, else one
    less the edits per character of the closest find, 0 without any. A null or empty text has no words and
    no labels. Every row gives one row, repeated and null keys too; an empty table gives no rows.
    Other columns are not read. Texts are scanned whole.
    """
    return over_texts(docs, lambda value: scan(value, edit_share), SCHEMA, key, text)
