"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint has 64 bits; a bit is set when more than half of the text's shingle hashes have it. Two
fingerprints are linked when at most ``RADIUS`` = 3 bits differ. Cut into two segments of 32 bits, a
linked pair has a segment that differs in one bit at most. So every distinct fingerprint is stored
once per segment, and looks up the 33 values around each of its segments; complete distances are
verified on what it meets. Equal fingerprints are one node, so copies cost nothing here.

A segment value shared by more than ``crowd`` fingerprints would make a quadratic number of pairs. The
fingerprints that meet one are linked through centres instead: any two at distance 3 or less have a value
within one bit of the first and two of the second. Each fingerprint names all values within two bits of
itself, and all that name a value are linked to the smallest that is within one bit of it. This
names 2,081 values per fingerprint, and makes as many links at most, whatever the size of the group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.llm.components import components
from pressroom.llm.rows import ascii_lowered, over_texts
from pressroom.operators.skew import first_rows, skew_join
from pressroom.session import cut_lineage

RADIUS = 3
SEED = 42
SHINGLE = 3
#: Shingles whose bits are counted at once.
BLOCK = 65_536
CROWD = 1_000


def fingerprint(text: str) -> tuple[int]:
    """The SimHash of a text as a signed 64-bit number: of shingles of three words, repeats included."""
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", ascii_lowered(text).encode())
    if not words:
        return (0,)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    joined = b" ".join(words)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - SHINGLE + 1)]
    stops = ends[min(SHINGLE, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for low in range(0, len(starts), BLOCK):
        places = zip(starts[low : low + BLOCK].tolist(), stops[low : low + BLOCK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in places], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(starts)).astype(np.uint8)
    return (int(np.packbits(bits, bitorder="little").view("<i8")[0]),)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``fp`` of every text; a text without words (or null) has fingerprint 0."""
    return over_texts(docs, fingerprint, "fp bigint", key, text)


def segment(fp: Column, half: int) -> Column:
    """A segment's value with its number above it, so that one number is the whole lookup key."""
    value = fp.bitwiseAND(F.lit(0xFFFFFFFF)) if half == 0 else F.shiftrightunsigned(fp, 32)
    return value.bitwiseOR(F.lit(half << 32))


def stored(nodes: DataFrame) -> DataFrame:
    return nodes.select("fp", F.explode(F.array(segment(F.col("fp"), 0), segment(F.col("fp"), 1))).alias("slot"))


def probes(nodes: DataFrame) -> DataFrame:
    """The slots within one bit of each segment of every fingerprint."""
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << bit).cast("bigint") for bit in range(32)])
    return stored(nodes).select("fp", F.explode(F.transform(flips, lambda f: F.col("slot").bitwiseXOR(f))).alias("slot"))


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links_by_centre(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all of ``nodes`` within ``RADIUS``, through shared centres."""
    one = [1 << i for i in range(64)]
    two = [one[i] | one[j] for i, j in combinations(range(64), 2)]

    def around(masks: list[int]) -> DataFrame:
        signed = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("bigint") for m in masks])
        return nodes.select("fp", F.explode(F.transform(signed, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))

    near = around([0, *one])
    heads = near.groupBy("centre").agg(F.min("fp").alias("head"))
    named = near.unionByName(around(two))
    return named.join(heads, "centre").select(F.col("fp").alias("a"), F.col("head").alias("b")).where("a != b").distinct()


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that have the components of all linked pairs."""
    slots, looked = stored(nodes), probes(nodes)
    crowded = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > crowd).select("slot")
    sparse = slots.join(crowded, "slot", "left_anti")
    pairs = looked.withColumnRenamed("fp", "a").join(sparse.withColumnRenamed("fp", "b"), "slot")
    pairs = pairs.where((F.col("a") < F.col("b")) & (differing("a", "b") <= RADIUS)).select("a", "b")
    meeting = cut_lineage(looked.join(crowded, "slot", "left_semi").select("fp").distinct())
    return pairs.unionByName(links_by_centre(meeting)) if meeting.head(1) else pairs


def near_duplicates(docs: DataFrame, crowd: int = CROWD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp and component_id: the smallest key reachable over links, itself included.

    Copies and repeated keys share their component. A null key has a fingerprint but no component, and
    joins nothing. A null text counts as empty. Every row gives one row; an empty table gives none.
    Other columns are not read.
    """
    prints = cut_lineage(fingerprints(docs, key, text))
    nodes = cut_lineage(prints.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(nodes, crowd)).withColumnRenamed("node", "fp")
    linked = cut_lineage(nodes.join(roots, "fp"))
    groups = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = linked.join(groups, "root").select("fp", "component_id")
    every = nodes.join(found, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # A fingerprint may be that of a large share of all rows.
    joined = skew_join(prints, every, ["fp"], [key], "left")
    component = F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id")
    return joined.select(key, "fp", component)


def one_of_each(docs: DataFrame, crowd: int = CROWD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all columns: the one of the smallest key, then of the smallest digest.

    Keys are taken together with their texts, so rows that share a key are judged each by its own text. Rows without a
    key all stay. Null and empty texts have fingerprint zero and are one component; an empty table gives none.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    keyed = docs.where(F.col(key).isNotNull()).select(F.struct(F.col(key).alias("key"), digest.alias("digest")).alias("_both"), F.col(text).alias("_text"))
    found = near_duplicates(keyed, crowd, "_both", "_text")
    keepers = found.where("_both = component_id").select(F.col("_both.key").alias("_key"), F.col("_both.digest").alias("_digest")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = whole.where(F.col("row")[key].isNotNull())
    marked = marked.select("row", F.col("row")[key].alias("_key"), F.md5(F.coalesce(F.col("row")[text], F.lit(""))).alias("_digest"))
    kept = marked.join(keepers, ["_key", "_digest"], "left_semi")
    single = first_rows(kept, ["_key", "_digest"], [F.col("row")[text]], 1, "_rank").select("row.*")
    return single.unionByName(whole.where(F.col("row")[key].isNull()).select("row.*"))
