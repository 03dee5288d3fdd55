"""The conversation trie against one built turn by turn."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from pressroom.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, k1 string, a string, turns string, n string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in said.items()}
    whole = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    for prefix in members:
        if prefix:
            kids[prefix[:-1]].append(prefix)
    leaves, saved, rows = {}, {}, []
    for prefix in sorted(members, key=len, reverse=True):
        held = members[prefix]
        leaves[prefix] = sum(leaves[k] for k in kids[prefix]) or 1
        saved[prefix] = (len(prefix[-1][1]) * (len(held) - 1) if prefix else 0) + sum(saved[k] for k in kids[prefix])
        ends = ",".join(str(c) for c in held if len(whole[c]) == len(prefix))
        parent = members[prefix[:-1]][0] if prefix else None
        rows.append((held[0], len(prefix), parent, len(held), len(kids[prefix]), leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def trie(frame, **options):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame, **options).select(*COLUMNS).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y", None) for r in rows], SCHEMA).repartition(3)


def conversations(seed, count=700, words=3, longest=7):
    """Conversations of few different turns, so that many share prefixes of every length."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(5 * count, count, replace=False).tolist():
        rows += [(c, t, "user" if t % 2 else "bot", "w" * int(rng.integers(words))) for t in range(int(rng.integers(1, longest)))]
    return rows


@pytest.mark.parametrize("block", [16, 128, 4_096])
def test_blocks_and_levels(spark, block):
    rows = conversations(block)
    assert trie(frame(spark, rows), block=block) == plain_trie(rows)


def test_hot_conversation_and_long_ones(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 900, 3) for t in range(3)]  # one content, a large share of all
    rows += [(c, t, "user", f"same {t}" if t < c % 40 else f"{c}") for c in range(1, 60) for t in range(c)]
    assert trie(frame(spark, rows), block=16) == plain_trie(rows)


def test_nulls_ties_and_absent_bases(spark):
    rows = [
        (100, 0, "user", "hi"), (100, 1, "bot", None), (100, None, None, "first"), (101, 0, "user", ""), (101, 1, None, ""),
        (7, 0, "user", "no base"), (None, 0, "user", "nobody"), (-150, 2, "user", "x"), (-100, 0, "bot", "y"), (-100, 1, "bot", "z"),
        (103, 5, "user", "hi"), (103, 5, "user", "hi"), (104, 1, "bot", "\U0001f600é"), (105, 1, "bot", "\U0001f600é"),
    ] + [(c, 0, "user", "one turn") for c in range(200, 260)]
    assert trie(frame(spark, rows)) == plain_trie(rows)
    short = [(c, 0, "user", "one turn") for c in range(1, 40)]  # without a base, many have no turn left
    assert trie(frame(spark, short)) == plain_trie(short) and trie(frame(spark, short))[0][-1] != prefix_trie.NOTHING


def test_member_lists_in_pieces(spark):
    rows = [(c, 0, "user", "all the same") for c in range(1, 400)]
    named = prefix_trie.rebuilt(frame(spark, rows)).selectExpr("conv_id", "cast(size(turns) as bigint) e1", "2L e2")
    got = {r["e1"]: r["ends_sha256"] for r in prefix_trie.member_lists(named, chunk=10).collect()}
    by_size = defaultdict(list)
    for r in named.collect():
        by_size[r["e1"]].append(r["conv_id"])
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in by_size.items()}


def test_whole_small_table(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet")
    assert trie(rows) == plain_trie([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


def test_empty_table(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []


def test_extents_by_halving():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 17, 64, 100):
        lcp = np.append(-1, rng.integers(0, 4, size - 1))
        minima = prefix_trie.Minima(lcp)
        rows, depths = np.repeat(np.arange(size), 5), np.tile(np.arange(5), size)
        for row, depth, low, high in zip(rows, depths, minima.left(rows, depths), minima.right(rows, depths)):
            at = row
            while lcp[at] >= depth:
                at -= 1
            assert low == at
            at = row
            while at + 1 < size and lcp[at + 1] >= depth:
                at += 1
            assert high == at
