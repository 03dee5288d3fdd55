"""Secrets in text: fixed patterns, and strings that a primed compressor finds new.

Three patterns give the base spans. Beyond them, a long run of key characters that stands soon after a
sensitive word is a candidate. Its novelty is the number of bytes it adds when the code around it is
compressed with a dictionary of identifiers: names that the dictionary or the surroundings know add
little, random strings add nearly all their information. Candidates that add at least
``min_bits`` bits per character and mix letters with digits or cases are reported as kind ``novel``.

Paths, host names and identifiers are new to any dictionary, too, but are made of words. A candidate is cut at its separators, and
segments that read as words take no part: what is left must be ``LEFT`` characters or more, and is what is measured. UUIDs are
names by convention and are not reported.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.rows import bound_batches, over_texts, text_function

# The base patterns, their shortest matches, and the order of kinds.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_CHARS, ACCESS_CHARS = 8, 16

# Words that make what follows sensitive.
SENSITIVE = re.compile(
    r"(?i:api|key|token|secret|passw|passphrase|auth|bearer|credential|private|signature|session|webhook)", re.ASCII
)
# Identifiers common in code and configuration.
IDENTIFIERS = (
    "access account action address admin alias algorithm application array asset async attribute authentication "
    "authorization authorize backend backup balance base64 batch bearer boolean branch browser bucket buffer build "
    "cache callback certificate channel character check class client cluster column command comment commit common "
    "component config configuration connection connector console constant container content context control "
    "controller cookie counter credential current database default delete description device dictionary directory "
    "disable document domain element email enable encoding encrypt endpoint engine entity environment error event "
    "exception export expression feature field filter format function generator global group handler hash header "
    "identifier image import index initialize input instance integer interface internal keyboard label language "
    "length library license listener local location logger login manager master member memory message metadata "
    "method module monitor network notification number object operation option output package parameter parent "
    "parser password path pattern payload permission platform plugin pointer policy position prefix primary private "
    "process production profile project property protocol provider proxy public python query queue random reader "
    "record reference region register release remote repository request resource response result return role router "
    "runtime schema scope script secret section security sequence server service session settings signature source "
    "staging standard status storage stream string structure subscription suffix system table target template "
    "temporary testing thread timeout timestamp token transaction transform update upload user username validate "
    "value variable version volume webhook widget window worker workflow wrapper writer example placeholder changeme"
)
# Runs of key characters, with dots inside but not at their ends.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=.-]{20})[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
CANDIDATE_CHARS = 20
#: What letters of one case, capitalised words and numbers do not have: letters with digits, or capitals inside a word.
MIXED = re.compile(r"[a-z][A-Z]|[A-Za-z].*[0-9]|[0-9].*[A-Za-z]")
SEGMENT = re.compile(r"[A-Za-z0-9]+")
#: Words within a segment: capitalised or of one case, and numbers.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: What words have: a vowel, and no long run of consonants.
SPOKEN = re.compile(r"(?=.*[aeiouy])(?!.*[^aeiouy]{5})[a-z]{3,}", re.I)
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
#: Characters in segments that are no words, at least; share of a segment in words from which on it reads as words.
LEFT, WORDY = 12, 0.7
#: Characters between a sensitive word and the candidate; characters of code on either side.
REACH, AROUND = 48, 256
#: Longest stretch of one candidate that is compressed at once; longer ones are measured piece by piece.
PIECE = 4_096


@lru_cache(maxsize=1)
def compressor():
    import zstandard

    variants = [IDENTIFIERS, IDENTIFIERS.replace(" ", "_"), IDENTIFIERS.upper().replace(" ", "_")]
    variants += [IDENTIFIERS.replace(" ", "."), IDENTIFIERS.title().replace(" ", "")]
    primed = zstandard.ZstdCompressionDict("\n".join(variants).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)


def novelty(text: str, start: int, end: int) -> float:
    """Bits per character that ``text[start:end]`` adds to its surroundings."""
    primed, before, after = compressor(), text[max(0, start - AROUND) : start], text[end : end + AROUND]
    added = 0
    for low in range(start, end, PIECE):
        high = min(end, low + PIECE)
        context = text[max(0, low - AROUND) : low] if low > start else before
        without = len(primed.compress((context + after).encode()))
        added += max(0, len(primed.compress((context + text[low:high] + after).encode())) - without)
    return 8 * added / (end - start)


def reads_as_words(segment: str) -> bool:
    """Whether most of the segment is words, of four letters on average if there are several, and at most one short number."""
    parts = WORD.findall(segment)
    numbers = [p for p in parts if p.isdigit()]
    letters = [p for p in parts if not p.isdigit()]
    if len(numbers) > 1 or any(len(p) > 4 for p in numbers) or not letters:
        return False
    spoken = sum(len(p) for p in letters if SPOKEN.fullmatch(p))
    held = sum(map(len, letters))
    return spoken >= WORDY * held and (len(letters) == 1 or held >= 4 * len(letters))


def unknown(candidate: str) -> str:
    """The candidate without the segments that read as words, and without separators then; nothing for a UUID."""
    if UUID.fullmatch(candidate):
        return ""
    segments = SEGMENT.findall(candidate)
    plain = [s for s in segments if not reads_as_words(s)]
    return candidate if len(plain) == len(segments) else "".join(plain)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three fixed patterns, by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2])))


def novel_spans(text: str, base: list[tuple[int, int, str]], min_bits: float) -> list[tuple[int, int, str]]:
    """Spans of kind ``novel``, none of which overlaps a base span."""
    if not SENSITIVE.search(text):
        return []
    found, i = [], 0
    for match in CANDIDATE.finditer(text):
        start, end = match.span()
        while i < len(base) and base[i][1] <= start:
            i += 1
        if any(a < end and start < b for a, b, _ in base[i : i + 1]):
            continue
        if end - start < CANDIDATE_CHARS or not SENSITIVE.search(text, max(0, start - REACH), start) or not MIXED.search(match[0]):
            continue
        left = unknown(match[0])
        if len(left) < LEFT:
            continue
        before = text[max(0, start - AROUND) : start]
        if novelty(before + left + text[end : end + AROUND], len(before), len(before) + len(left)) >= min_bits:
            found.append((start, end, "novel"))
    return found


def find_spans(text: str, min_bits: float) -> tuple[list, list]:
    base = base_spans(text)
    every = base + novel_spans(text, base, min_bits)
    return base, sorted(every, key=lambda span: (span[0], KINDS.index(span[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secret_spans(
    docs: DataFrame, min_bits: float = 4.5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, ``base`` and ``spans``: arrays of struct(start, end, kind), code points, end exclusive.

    A null or empty text has empty arrays. Every row gives one row, repeated and null keys too; an
    empty table gives no rows. Other columns are not read. Texts are scanned whole.
    """
    kind = "array<struct<start:int,end:int,kind:string>>"
    return over_texts(docs, lambda value: find_spans(value, min_bits), f"base {kind}, spans {kind}", key, text)


def secret_digest(docs: DataFrame, min_bits: float = 4.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans of ``secret_spans`` as counts and strings: key, n_assign, n_access, n_hex, base_sha256, spans, n_novel."""
    found = secret_spans(docs, min_bits, key, text)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans: str):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    return found.select(
        key, *[count(kind) for kind in KINDS[:3]], F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"), count(KINDS[3]),
    )


def redact(text: str, spans: list, mark: str) -> str:
    """``text`` with every maximal stretch of overlapping spans replaced by ``mark``."""
    parts, done = [], 0
    for start, end, _ in spans:
        if start >= done:
            parts += [text[done:start], mark]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def redacted(docs: DataFrame, mark: str = "[SECRET]", min_bits: float = 4.5, text: str = "text") -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced by ``mark``; all columns and rows stay, null texts stay null."""

    def clean(value: str) -> tuple[str]:
        return (redact(value, find_spans(value, min_bits)[1], mark),)

    bound_batches(docs.sparkSession)
    made = text_function(clean, "clean string")
    value = F.when(F.col(text).isNotNull(), made(F.col(text))["clean"]).alias(text)
    return docs.select(*[value if name == text else F.col(f"`{name}`") for name in docs.columns])


def digest_of(spans: list[tuple[int, int, str]]) -> str:
    """Hash of the listed spans, as the digest has it."""
    return hashlib.sha256(listed(spans).encode()).hexdigest()
