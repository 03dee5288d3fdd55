"""Spelling variants: words one edit apart, each with the more frequent form it stands for.

Words that differ by one inserted, deleted or replaced code point agree either in their first or in their last
half: of an index word of length n, either the first (n - 1) // 2 code points or the last n - 1 - (n - 1) // 2 are those of
any word near it. So every word is stored in two blocks, by its length and either half, and looks up the
blocks of its length and of those one shorter and longer.

In a block, a bitset per position and letter tells which words have that letter there. A query runs over its
letters once and keeps four sets as bits over all words of the block: those without an error so far, and
those with one replaced, one additional or one missing letter, whose positions are shifted by one from there on. Python's
whole numbers serve as bitsets of any width.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.llm.blocks import Rows, meet
from pressroom.llm.rows import ascii_lower
from pressroom.session import cut_lineage

RUN = "[a-zÀ-ÿ]+"
SHORTEST = 5
LEAST = 3
#: One in so many occurrences loses a code point.
THINNED = 97
INDEX_ROWS, QUERY_ROWS = 16_384, 65_536


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the words of all texts, lower-cased and thinned, with ``least`` occurrences or more.

    A word is a run of letters; where the CRC-32 of ``<key>:<run>`` is a multiple of 97, the code point at that number modulo the
    run's length is left out. Counts are combined before the shuffle. A null text has no words, a null key is written as nothing.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    runs = docs.select(name.alias("key"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= shortest)
    mark = F.crc32(F.concat_ws(":", "key", "run").cast("binary"))
    place = (F.col("mark") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.col("mark") % THINNED == 0, short).otherwise(F.col("run"))
    counted = runs.withColumn("mark", mark).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= shortest) & (F.col("n") >= least))


def halves(word: Column, length: Column) -> Column:
    """The two blocks in which an index word of ``length`` meets ``word``: (side, length, half)."""
    first = F.floor((length - 1) / 2).cast("int")
    last = length - 1 - first
    return F.array(
        F.struct(F.lit(0).alias("side"), length.alias("length"), F.substring(word, F.lit(1), first).alias("half")),
        F.struct(F.lit(1).alias("side"), length.alias("length"), F.substring(word, F.length(word) - last + 1, last).alias("half")),
    )


def bitsets(letters: Sequence[str]) -> dict[str, int]:
    """For each letter, the numbers of the words that have it at this position, as bits."""
    if len(letters) < 256:
        found: dict[str, int] = defaultdict(int)
        for number, letter in enumerate(letters):
            found[letter] |= 1 << number
        return found
    codes = np.array(letters)
    return {str(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}


def near_in(index: Rows) -> Callable[[Rows], list[tuple]]:
    """A function that finds the words of the block one edit away from each query word."""
    stored, counts = index["word"], index["n"]
    length = len(stored[0])
    half = (length - 1) // 2
    letters = [bitsets(place) for place in zip(*stored)]
    every = (1 << len(stored)) - 1

    def near(word: str) -> int:
        """Bits of the stored words that are one replaced, additional or missing letter away (or equal, in case of the first)."""
        exact, replaced, longer, shorter = every, 0, 0, 0
        if len(word) == length:
            for i, letter in enumerate(word):
                here = letters[i].get(letter, 0)
                replaced = (replaced & here) | exact
                exact &= here
                if not replaced:  # holds all that is exact
                    return 0
            return replaced
        if len(word) < length:
            for i, letter in enumerate(word):
                longer = (longer | exact) & letters[i + 1].get(letter, 0)
                exact &= letters[i].get(letter, 0)
                if not exact | longer:
                    return 0
            return longer | exact
        for i, letter in enumerate(word):
            shorter = (shorter & letters[i - 1].get(letter, 0) if i else 0) | exact
            exact &= letters[i].get(letter, 0) if i < length else 0
            if not shorter:
                return 0
        return shorter

    def answer(queries: Rows) -> list[tuple]:
        rows = []
        for side, word in zip(queries["side"], queries["word"]):
            found, n, best, best_n = near(word), 0, None, 0
            while found:
                low = found & -found
                found ^= low
                number = low.bit_length() - 1
                other = stored[number]
                if other == word or side and other[:half] == word[:half]:  # met by the first half already
                    continue
                n += 1
                if counts[number] > best_n or counts[number] == best_n and other < best:
                    best, best_n = other, counts[number]
            if n:
                rows.append((word, n, best, best_n))
        return rows

    return answer


def nearest_words(vocabulary: DataFrame, shortest: int = SHORTEST, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(word, n, n_near, best, best_n) of every (word, n): how many words are one edit away, and the most frequent of these.

    Words are distinct and have ``shortest`` code points or more, at least two. A block adds at most one row per query word; pairs of words
    are never rows.
    """
    word, length = F.col("word"), F.length("word")
    index = vocabulary.select("word", "n", F.inline(halves(word, length)))
    lengths = F.filter(F.array(length - 1, length, length + 1), lambda x: x >= shortest)
    asked = vocabulary.select("word", "n", F.explode(lengths).alias("_length"))
    asked = asked.select("word", "n", F.inline(halves(word, F.col("_length"))))
    schema = "word string, n_near bigint, best string, best_n bigint"
    found = meet(index, asked, ["side", "length", "half"], ["word"], near_in, schema, index_rows, query_rows)
    # Of the largest count, the first word in order: a struct's smallest, with the count's sign turned.
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top"))
    joined = vocabulary.join(merged, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("top.best").alias("best"), (-F.col("top.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the chain of forms ends; the word itself if it has no form.

    The known stretch of every chain doubles with each join, each written to the shared folder. A form occurs at least twice as
    often as its word, so a chain has 63 steps at most, and 6 rounds do.
    """
    current = forms.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(8):
        current = cut_lineage(current)
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = current.join(ahead, "root").select("word", F.col("root").alias("before"), F.col("next").alias("root"))
        if not moved.where("before != root").head(1):
            return current
        current = moved.select("word", "root")
    raise RuntimeError("forms make a circle")


def variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, ratio: int = 2,
    index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs``.

    ``form`` is the near word of largest count (of ties the first in code-point order), if it occurs at least ``ratio`` times as often;
    ``root`` is where following forms ends. Repeated rows count each; empty and null texts add nothing; an empty table gives
    no rows. Other columns are not read.
    """
    vocabulary = cut_lineage(words(docs, key, text, shortest, least))
    near = nearest_words(vocabulary, shortest, index_rows, query_rows)
    stands = F.col("best_n") >= F.lit(ratio) * F.col("n")
    table = cut_lineage(near.select("word", "n", "n_near", F.when(stands, F.col("best")).alias("form"), F.when(stands, F.col("best_n")).alias("form_n")))
    return table.join(roots(table), "word")
