"""The prefix trie of conversations, from sorted sequences and their longest common prefixes.

A turn is two digests and a length, a conversation the array of its turns. Equal conversations are one sequence. All
sequences are sorted over the cluster and cut into blocks of neighbours. In a block, the longest common prefixes (LCP) of
neighbours go into a sparse table of range minima; every candidate prefix, a sequence and a depth, then searches its own left
and right extent by halving steps over the table. The interval it finds holds its members. Nodes are numbered by their
leftmost member and depth, an order in which every subtree is one stretch, so that sums over subtrees are differences.

Prefixes of a block's first and last sequence may have members in other blocks. These two sequences, with what the block knows of their
prefixes, are the input of the next level, which works the same way on far fewer rows, until all lie in one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pressroom.llm.rows import bound_batches
from pressroom.operators.skew import skew_join
from pressroom.session import cut_lineage

SHARED, GROUP = 6, 100
#: Sequences in a block, and turns after which it ends once it has ``FEWEST``.
BLOCK, TURNS, FEWEST = 4_096, 1_000_000, 64
#: Conversation ids whose text is made in one piece.
CHUNK = 65_536
NOTHING = hashlib.sha256(b"").hexdigest()
FAR = 2**63 - 1
TURN = "array<struct<a:bigint,b:bigint,n:bigint>>"
#: What a block knows of each prefix (by depth) of a sequence: members, their smallest id, finished children, the
#: leaves and savings below these, and the digests of the sequence that ends there.
FACTS = ["convs", "least", "kids", "leaves", "saved", "x1", "x2", "stops"]
LISTS = ["a", "b", "n", *FACTS]
NODE = (
    "k1 bigint, k2 bigint, depth bigint, p1 bigint, p2 bigint, open_parent boolean, parent bigint, conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, e1 bigint, e2 bigint, ends boolean"
)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def common(left: np.ndarray, right: np.ndarray) -> int:
    """Number of leading turns (rows of two digests) that are equal."""
    n = min(len(left), len(right))
    differing = (left[:n] != right[:n]).any(axis=1)
    return int(differing.argmax()) if differing.any() else n


class Minima:
    """A sparse table: the minimum of every stretch whose length is a power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.tables = [values]
        while len(self.tables[-1]) > 1 << (len(self.tables) - 1):
            step = 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(self.tables[-1][:-step], self.tables[-1][step:]))

    def left(self, rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """The smallest l for each row such that all values in (l, row] are at least its depth."""
        at = rows.copy()
        for power in range(len(self.tables) - 1, -1, -1):
            step, table = 1 << power, self.tables[power]
            start = at - step + 1  # values start .. at
            can = (start >= 0) & (table[np.clip(start, 0, len(table) - 1)] >= depths)
            at = np.where(can, at - step, at)
        return np.maximum(at, 0)

    def right(self, rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """The largest r for each row such that all values in (row, r] are at least its depth."""
        at, size = rows.copy(), len(self.tables[0])
        for power in range(len(self.tables) - 1, -1, -1):
            step, table = 1 << power, self.tables[power]
            start = at + 1  # values start .. at + step
            can = (start + step <= size) & (table[np.clip(start, 0, len(table) - 1)] >= depths)
            at = np.where(can, at + step, at)
        return at


def solved(rows: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, list[dict]]:
    """The finished nodes of a block of sorted sequences, and the rows of the next level (none if this is the only block)."""
    turns = [np.stack([np.asarray(x, dtype=np.int64) for x in row], axis=1) for row in zip(rows["a"], rows["b"], rows["n"])]
    n = len(turns)
    lcp = np.array([-1, *(common(x[:, :2], y[:, :2]) for x, y in zip(turns, turns[1:]))], dtype=np.int64)
    sizes = np.array([len(t) for t in turns]) + 1  # depths 0 .. length
    row = np.repeat(np.arange(n), sizes)
    first = np.cumsum(sizes) - sizes
    depth = np.arange(len(row)) - first[row]
    facts = {c: np.concatenate([np.asarray(x, dtype=np.int64) for x in rows[c]]) for c in FACTS}

    # A prefix's name: its turns' digests, mixed with their places, in one sum of bits. Depth 0 is 0.
    names = []
    for lane in (0, 1):
        marks = np.zeros(len(row), dtype=np.uint64)
        held = depth > 0
        digests = np.concatenate([t[:, lane] for t in turns]).view(np.uint64)
        marks[held] = mixed(digests + depth[held].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        running = np.bitwise_xor.accumulate(marks)
        names.append((running ^ running[first][row]).view(np.int64))
    chars = np.zeros(len(row), dtype=np.int64)
    chars[depth > 0] = np.concatenate([t[:, 2] for t in turns])

    minima = Minima(lcp)
    low, high = minima.left(row, depth), minima.right(row, depth)
    heads = np.flatnonzero(low == row)  # one cell per node, in the order of a walk through the trie
    number = np.cumsum(low == row) - 1
    node = number[first[low] + depth]  # of every cell
    count = len(heads)

    def summed(values: np.ndarray) -> np.ndarray:
        total = np.zeros(count, dtype=np.int64)
        np.add.at(total, node, values)
        return total

    convs, finished = summed(facts["convs"]), summed(facts["kids"])
    least = np.full(count, FAR, dtype=np.int64)
    np.minimum.at(least, node, facts["least"])
    end_of = np.full(count, -1, dtype=np.int64)
    ended = np.flatnonzero(facts["stops"])
    end_of[node[ended]] = ended
    parent = np.where(depth[heads] > 0, node[np.maximum(heads - 1, 0)], -1)
    kids = finished + np.bincount(parent[parent >= 0], minlength=count)
    own_leaf = (kids == 0).astype(np.int64) + summed(facts["leaves"])
    own_saved = (convs - 1) * chars[heads] + summed(facts["saved"])
    # A subtree ends with the last node whose leftmost member is within the interval.
    stop = np.searchsorted(row[heads], high[heads], side="right")
    begin = np.arange(count)
    leaves = np.append(0, np.cumsum(own_leaf))[stop] - np.append(0, np.cumsum(own_leaf))[begin]
    saved = np.append(0, np.cumsum(own_saved))[stop] - np.append(0, np.cumsum(own_saved))[begin]

    open_node = np.zeros(count, dtype=bool) if last else (low[heads] == 0) | (high[heads] == n - 1)
    done = np.flatnonzero(~open_node)
    above = parent[done]
    open_parent = (above >= 0) & open_node[above]
    ends = end_of[done]
    made = pd.DataFrame({
        "k1": names[0][heads[done]], "k2": names[1][heads[done]], "depth": depth[heads[done]],
        "p1": names[0][np.maximum(heads[done] - 1, 0)], "p2": names[1][np.maximum(heads[done] - 1, 0)], "open_parent": open_parent,
        "parent": pd.array(np.where(above >= 0, least[above], 0), dtype="Int64"), "conv_id": least[done], "n_convs": convs[done],
        "n_children": kids[done], "n_leaves": leaves[done], "saved_tokens": saved[done],
        "e1": facts["x1"][ends], "e2": facts["x2"][ends], "ends": ends >= 0,
    })
    made.loc[(above < 0) | open_parent, "parent"] = pd.NA
    if last:
        return made, []

    # What the next level needs: sums over finished children are attached to their open parents.
    kept = {"convs": convs, "least": least, "kids": finished.copy(), "leaves": summed(facts["leaves"]), "saved": summed(facts["saved"])}
    hanging = done[open_parent]
    np.add.at(kept["kids"], parent[hanging], 1)
    np.add.at(kept["leaves"], parent[hanging], leaves[hanging])
    np.add.at(kept["saved"], parent[hanging], saved[hanging])
    kept |= {c: np.where(end_of >= 0, facts[c][end_of], 0) for c in ("x1", "x2", "stops")}
    out = []
    for i in sorted({0, n - 1}):
        cells = np.arange(first[i], first[i] + sizes[i])
        mine = node[cells]
        new = (depth[cells] > lcp[1:].min(initial=FAR)) if i else np.ones(len(cells), dtype=bool)
        values = {c: np.where(new, v[mine], FAR if c == "least" else 0) for c, v in kept.items()}
        out.append({**{c: rows[c].iloc[i] for c in "abn"}, **values})
    return made, out


def blocks(batches: Iterable[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """Neighbouring rows of a sorted partition, ``block`` at a time or fewer with very many turns."""
    held: list[pd.DataFrame] = []
    rows = turns = 0
    for batch in batches:
        for low in range(0, len(batch), FEWEST):
            part = batch.iloc[low : low + FEWEST]
            held.append(part)
            rows, turns = rows + len(part), turns + int(part["a"].map(len).sum())
            if rows >= block or turns >= TURNS and block < 2**62:
                yield pd.concat(held, ignore_index=True)
                held, rows, turns = [], 0, 0
    if rows:
        yield pd.concat(held, ignore_index=True)


def level(rows: DataFrame, last: bool, block: int) -> DataFrame:
    """Finished nodes and, with a null depth, rows of the next level, of rows that are sorted by their turns."""
    schema = f"{NODE}, " + ", ".join(f"{c} array<bigint>" for c in LISTS)
    names = StructType.fromDDL(schema).names

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in blocks(batches, 2**62 if last else block):
            made, left = solved(part, last)
            if left:
                yield pd.DataFrame(left).assign(**dict.fromkeys(names[: -len(LISTS)]))[names]
            for low in range(0, len(made), 50_000):
                yield made.iloc[low : low + 50_000].assign(**dict.fromkeys(LISTS))[names]

    turns = F.arrays_zip("a", "b", "n")
    return rows.sortWithinPartitions(turns).select(*LISTS).mapInPandas(run, schema)


def rebuilt(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): every conversation after its first turns were replaced by those of the first of its hundred."""
    said = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    named = rows.select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    known = named.where("conv_id IS NOT NULL").select("conv_id", "turn", *said)
    digests = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(SHARED), "role", "text").alias("b")]
    turns = known.select("conv_id", F.struct("turn", "role", *digests, F.char_length("text").cast("bigint").alias("n")).alias("t"))
    bare = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["n"].alias("n")))
    whole = cut_lineage(turns.groupBy("conv_id").agg(bare.alias("turns")))
    heads = whole.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED - 1).alias("head"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).cast("int")
    joined = whole.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), taken.alias("h")).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(TURN)), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def member_lists(named: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(e1, e2, ends_sha256): per sequence, the digest of its conversation ids in ascending order, joined by commas.

    Pieces of the list are made in parallel; a long list's pieces then run through one digest in order, never whole in memory.
    """
    pieces = named.groupBy("e1", "e2", F.floor(F.col("conv_id") / chunk).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    written = cut_lineage(pieces.select("e1", "e2", "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")))
    counted = written.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("pieces"), F.min("ids").alias("ids"))
    short = counted.where("pieces = 1").select("e1", "e2", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, digest = None, None
        for batch in batches:
            out = []
            for e1, e2, ids in zip(batch["e1"], batch["e2"], batch["ids"]):
                if (e1, e2) != here:
                    if here:
                        out.append((*here, digest.hexdigest()))
                    here, digest = (e1, e2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["e1", "e2", "ends_sha256"])
        if here:
            yield pd.DataFrame([(*here, digest.hexdigest())], columns=["e1", "e2", "ends_sha256"])

    long = written.join(counted.where("pieces > 1").select("e1", "e2"), ["e1", "e2"], "left_semi")
    ordered = long.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "piece")
    return short.unionByName(ordered.mapInPandas(run, "e1 bigint, e2 bigint, ends_sha256 string"))


def prefix_trie(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, from the empty one: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and k1, k2, the digests of the prefix.

    Turns of a conversation are in the order of ``turn``, null first; equal ones in the order of role and digest. Null roles and
    texts count as empty. Rows without a conversation are left out; repeated rows are turns of their own. An empty table gives no
    rows. Other columns are not read. A conversation is one row of 24 bytes a turn, without its texts.
    """
    bound_batches(rows.sparkSession)
    named = rebuilt(rows, key, turn, role, text)
    named = cut_lineage(named.select("conv_id", "turns", F.xxhash64("turns").alias("e1"), F.xxhash64(F.lit(SHARED), "turns").alias("e2")))
    distinct = named.groupBy("turns", "e1", "e2").agg(F.count(F.lit(1)).alias("held"), F.min("conv_id").alias("conv_id"))
    depths = F.sequence(F.lit(0), F.size("turns"))
    nothing = F.transform(depths, lambda d: F.lit(0).cast("bigint"))

    def at_end(value: Column) -> Column:
        return F.transform(depths, lambda d: F.when(d == F.size("turns"), value).otherwise(F.lit(0)).cast("bigint"))

    facts = {
        "convs": F.transform(depths, lambda d: F.col("held")), "least": F.transform(depths, lambda d: F.col("conv_id")),
        "kids": nothing, "leaves": nothing, "saved": nothing, "x1": at_end(F.col("e1")), "x2": at_end(F.col("e2")), "stops": at_end(F.lit(1)),
    }
    lists = [F.col(f"turns.{c}").alias(c) for c in "abn"]
    current = cut_lineage(distinct.select(*lists, *[c.alias(name) for name, c in facts.items()]))
    finished, last = [], False
    while not last:
        count = current.count()
        last = count <= block
        parts = ceil(2 * count / block)
        dealt = current.coalesce(1) if last else current.repartitionByRange(parts, F.arrays_zip("a", "b", "n"))
        found = cut_lineage(level(dealt, last, block))
        finished.append(found.where("depth IS NOT NULL").drop(*LISTS))
        current = found.where("depth IS NULL").select(*LISTS)
    nodes = finished[0]
    for more in finished[1:]:
        nodes = nodes.unionByName(more)
    # Parents that lay in several blocks were finished at a later level; these are few, two chains per block.
    later = [more.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("p_depth"), F.col("conv_id").alias("found")) for more in finished[1:]]
    if later:
        parents = later[0]
        for more in later[1:]:
            parents = parents.unionByName(more)
        known = nodes.where("NOT open_parent")
        asked = nodes.where("open_parent").withColumn("p_depth", F.col("depth") - 1)
        joined = skew_join(asked, parents, ["p1", "p2", "p_depth"], ["k1", "k2"])
        nodes = known.unionByName(joined.withColumn("parent", F.col("found")).select(*known.columns))
    members = member_lists(named.select("e1", "e2", "conv_id"))
    ending, passing = nodes.where("ends").join(members, ["e1", "e2"]), nodes.where("NOT ends").withColumn("ends_sha256", F.lit(NOTHING))
    every = ending.unionByName(passing, allowMissingColumns=True)
    return every.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "k1", "k2"
    )
