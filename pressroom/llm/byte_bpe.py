"""Byte-level BPE over a tree: halves are encoded on their own and joined.

Encodings with ``join`` form a monoid. A join keeps the left tokens up to a certain split in the left
text, the right tokens from a certain split in the right text, and encodes the window between the two
again. The window grows from ``window`` characters on each side, doubling, until both ends are certain
splits (a blank or newline after a character that is not white space: no match of the split pattern
spans it, looks back over it, or differs for what follows) or the ends of the texts. Tokens outside are
then exactly those of the whole text. Decoding concatenates the bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from pressroom.llm.rows import over_texts
from pressroom.llm.token_counts import find

LEAF = 8_192
WINDOW = 32


@lru_cache(maxsize=4)
def load_encoding(path: str):
    """The encoding of one worker process, with the decimal form and byte length of every id."""
    import public_tokenizers
    import tiktoken

    with open(find(path), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = max(ranks.values()) + 1
    lengths = [0] * size
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return model, [str(i) for i in range(size)], lengths


def certain(text: str, at: int) -> bool:
    return text[at] in " \n" and not text[at - 1].isspace()


def left_edge(text: str, low: int, middle: int, window: int) -> int:
    """Start of the window: the last certain split in the left part that a growing window meets, or its start."""
    seen = middle
    while seen > low:
        reach = max(low, middle - window)
        for at in range(seen - 1, max(reach, low), -1):
            if certain(text, at):
                return at
        seen, window = reach + 1 if reach > low else low, window * 2
    return low


def right_edge(text: str, middle: int, high: int, window: int) -> int:
    """End of the window: the first certain split in the right part that a growing window meets, or its end."""
    seen = middle + 1
    while seen < high:
        reach = min(high, middle + window)
        for at in range(seen, reach):
            if certain(text, at):
                return at
        seen, window = reach, window * 2
    return high


def join(text: str, low: int, middle: int, high: int, left: list, right: list, encode, lengths: list, window: int) -> list:
    """Ids of ``text[low:high]`` from those of ``text[low:middle]`` and ``text[middle:high]``."""
    start, stop = left_edge(text, low, middle, window), right_edge(text, middle, high, window)
    spare = len(text[start:middle].encode())
    keep = len(left)
    while spare > 0:
        keep -= 1
        spare -= lengths[left[keep]]
    spare = len(text[middle:stop].encode())
    skip = 0
    while spare > 0:
        spare -= lengths[right[skip]]
        skip += 1
    return left[:keep] + encode(text[start:stop]) + right[skip:]


def encode_tree(text: str, encode, lengths: list, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
    """Ids of the whole text. ``encode`` gives the ids of a part, ``lengths`` the bytes of each id."""

    def part(low: int, high: int) -> list[int]:
        if high - low <= leaf:
            return encode(text[low:high])
        middle = (low + high) // 2
        return join(text, low, middle, high, part(low, middle), part(middle, high), encode, lengths, window)

    return part(0, len(text))


def decode_tree(ids: list[int], decode, leaf: int = LEAF) -> bytes:
    """Bytes of ``ids``, concatenated up the tree."""
    if len(ids) <= leaf:
        return decode(ids)
    middle = len(ids) // 2
    return decode_tree(ids[:middle], decode, leaf) + decode_tree(ids[middle:], decode, leaf)


def encode_texts(
    docs: DataFrame, ranks: str, leaf: int = LEAF, window: int = WINDOW, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key and ``ids`` (array of int) of every text; a null text has none.

    A batch's ids are kept as 32-bit numbers, so they take about as much memory as the texts.
    """

    def ids_of(value: str) -> tuple[np.ndarray]:
        model, _, lengths = load_encoding(ranks)
        return (np.array(encode_tree(value, model.encode_ordinary, lengths, leaf, window), dtype=np.int32),)

    return over_texts(docs, ids_of, "ids array<int>", key, text)


def round_trip(
    docs: DataFrame,
    ranks: str = "byte_bpe_multi_50k.tiktoken",
    leaf: int = LEAF,
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode every text and decode it again: key, n_tokens, ids_sha256, decoded_sha256, lossless.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the decoded bytes. A null
    or empty text has no tokens and the hash of nothing twice. Every row gives one row, repeated and
    null keys too; an empty table gives no rows. Other columns are not read.
    """

    def digest(value: str) -> tuple:
        model, names, lengths = load_encoding(ranks)
        ids = encode_tree(value, model.encode_ordinary, lengths, leaf, window)
        decoded = decode_tree(ids, model.decode_bytes, leaf)
        listed = ",".join([names[i] for i in ids])
        return (
            len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(),
            decoded == value.encode(),
        )

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, lossless boolean"
    return over_texts(docs, digest, schema, key, text)
