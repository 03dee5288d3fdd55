"""Token counts of whole texts, huge ones included.

A text of more than ``chunk`` characters is encoded in overlapping chunks with offsets. Two neighbours
are spliced at a position inside their overlap where both begin a token and where the split is proven
not to depend on anything around it: the character before is not white space and the character itself
is a blank or a newline. No match of the byte-level split pattern holds white space after another
character, and no match looks back, so a token always begins there. When an overlap holds no such
position, it is doubled; at the left end of the chunk the two chunks become one.

Shorter texts are cut at all such positions. Pieces repeat a lot, so a worker keeps the counts of
the last ``KNOWN`` short ones and has the library encode only the new ones.

The proof needs byte-level splitting by pattern, no normalization, and added tokens without white space;
the texts of a tokenizer file without these are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.rows import over_texts

CHUNK = 16_384
OVERLAP = 256
#: Pieces whose counts a worker keeps, and the longest of them.
KNOWN = 600_000
SHORT = 48
CUT = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of one worker process; ``path`` is a file or the name of a public one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(find(path))


@lru_cache(maxsize=4)
def splits_are_certain(path: str) -> bool:
    """Whether the tokenizer file is of the kind that the splits are proven for."""
    with open(find(path), encoding="utf-8") as file:
        parts = json.load(file)
    steps = parts["pre_tokenizer"] or {}
    plain = steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space", True)
    added = all(
        not re.search(r"\s", token["content"]) and not (token["lstrip"] or token["rstrip"] or token["single_word"])
        for token in parts["added_tokens"]
    )
    return plain and added and parts["normalizer"] is None and parts["truncation"] is None


class Counts(dict):
    """Token counts of the short pieces met so far."""

    def of(self, text: str, model) -> int:
        pieces = CUT.split(text)
        if len(self) > KNOWN:
            self.clear()
        missing = list({piece for piece in pieces if piece not in self})
        found = dict(zip(missing, map(len, model.encode_batch_fast(missing, add_special_tokens=False)))) if missing else {}
        total = sum(found[piece] if piece in found else self[piece] for piece in pieces)
        self.update((piece, n) for piece, n in found.items() if len(piece) <= SHORT)
        return total


@lru_cache(maxsize=4)
def known_counts(path: str) -> Counts:
    """The counts that one worker process keeps for a tokenizer."""
    return Counts()


def find(path: str) -> str:
    """A file's place: ``path`` itself, or that of the public tokenizer file of this name."""
    if os.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def splice_point(text: str, left: int, right: int, begun_left: set[int], begun_right: set[int]) -> int | None:
    """The last position in (left, right) where both encodings begin a token and a split is certain."""
    for at in range(right - 1, left, -1):
        if text[at] in " \n" and not text[at - 1].isspace() and at in begun_left and at in begun_right:
            return at
    return None


def count_tokens(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Number of tokens, and of chunks encoded. ``encode(text)`` gives a token list with ``offsets``."""
    if len(text) <= chunk:
        return len(encode(text)), 1
    done, chunks = 0, 1
    counted_from, start, end = 0, 0, chunk
    current = [a for a, _ in encode(text[:end]).offsets]
    while end < len(text):
        width, point = overlap, None
        following_end = min(len(text), end + chunk - overlap)
        while True:
            begin = max(start, end - width)
            following = [begin + a for a, _ in encode(text[begin:following_end]).offsets]
            chunks += 1
            if begin == start:
                break
            point = splice_point(text, max(begin, counted_from), end, set(current), set(following))
            if point is not None:
                break
            width *= 2
        if point is not None:
            done += sum(counted_from <= a < point for a in current)
            counted_from = point
        current, start, end = following, begin, following_end
    return done + sum(a >= counted_from for a in current), chunks


def token_counts(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 512,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Bytes and tokens per row: key, n_bytes, n_tokens, over_limit, n_chunks.

    Counts are those of the tokenizer file over the whole text, without begin, end or padding tokens.
    A null or empty text has 0 bytes and 0 tokens. Every row gives one row, repeated and null keys
    too; an empty table gives no rows. Other columns are not read.
    """

    def count(value: str) -> tuple[int, int]:
        model = load_tokenizer(tokenizer)
        if not splits_are_certain(tokenizer):
            return len(model.encode(value, add_special_tokens=False)), 1
        if len(value) <= chunk:
            return known_counts(tokenizer).of(value, model), 1
        return count_tokens(value, lambda part: model.encode(part, add_special_tokens=False), chunk, overlap)

    lengths = docs.select(key, text, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_bytes"))
    key_and_bytes = lengths.select(F.struct(key, "n_bytes").alias("kept"), text)
    counted = over_texts(key_and_bytes, count, "n_tokens bigint, n_chunks bigint", "kept", text)
    return counted.select(
        F.col("kept")[key].alias(key), F.col("kept")["n_bytes"].alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks",
    )
