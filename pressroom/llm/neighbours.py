"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are scaled to length 1, so that the largest cosine is the smallest distance, and projected on ``DIMENSIONS`` Gaussian
directions. The squared projected distance of two vectors, over their squared distance, is chi-square
distributed with as many degrees of freedom. A search takes points in the order of their projected distance, a leaf of the tree at
a time, verifies them on the original vectors, and stops when a point as near as the last one found would, with probability
``SURE``, have been projected nearer than the next leaf. Every true neighbour is missed with a chance of 1 - ``SURE`` at most.

Equal vectors are one point with its smallest ids. The upper levels of one kd-tree, fitted on a bounded sample of projections, deal
all points to cells; a kd-tree over each cell is searched best first. A query visits its own cell, and then those
other cells whose box is nearer than its stopping distance, which its first neighbours give.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.llm.blocks import Build, Rows, meet
from pressroom.llm.rows import bound_batches
from pressroom.operators.skew import first_rows
from pressroom.session import cut_lineage

NEAREST = 5
DIMENSIONS = 16
SURE = 0.95
SEED = 42
#: Points per cell aimed at, the most cells, and projections read to lay them out.
CELL, MOST_CELLS, SAMPLE = 4_096, 8_192, 65_536
LEAF = 256
INDEX_ROWS, QUERY_ROWS = 16_384, 16_384


def chi_square(x: float, dimensions: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for j in range(1, dimensions // 2):
        term *= half / j
        total += term
    return 1 - float(np.exp(-half)) * total


@lru_cache
def stretch(sure: float, dimensions: int) -> float:
    """Squared projected distance, in squared distances, that is not exceeded with probability ``sure``."""
    low, high = 0.0, 100.0 * dimensions
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dimensions) < sure else (low, middle)
    return high


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def padded(rows: Sequence, width: int) -> np.ndarray:
    """Vectors as doubles, short ones filled with zeros; extreme ones scaled by a power of two, which changes no cosine."""
    made = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        made[i, : len(row)] = row
    largest = np.abs(made).max(axis=1, initial=0.0)
    extreme = (largest > 1e100) | (largest < 1e-100)
    if extreme.any():
        made[extreme] = np.ldexp(made[extreme], -np.frexp(largest[extreme])[1][:, None])
    return made


@lru_cache(maxsize=4)
def directions(width: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(width, dimensions))


def projected(vectors: np.ndarray, dimensions: int) -> np.ndarray:
    return (vectors / lengths(vectors)[:, None]) @ directions(vectors.shape[1], dimensions)


@dataclass(frozen=True)
class Cells:
    """The upper levels of a kd-tree: node i has children 2i + 1 and 2i + 2; beyond the splits come the cells."""

    axes: np.ndarray
    splits: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), dtype=np.int64)
        rows = np.arange(len(points))
        for _ in range(int(log2(len(self.axes) + 1))):
            at = 2 * at + 1 + (points[rows, self.axes[at]] > self.splits[at])
        return at - len(self.axes)


def laid_out(sample: np.ndarray, cells: int) -> Cells:
    """Cells that halve the sample, each time where it is widest. ``cells`` is a power of two."""
    axes, splits = np.zeros(cells - 1, dtype=np.int64), np.zeros(cells - 1)
    parts = {0: sample}
    for node in range(cells - 1):
        points = parts.pop(node)
        if len(points):
            axes[node] = axis = int(np.ptp(points, axis=0).argmax())
            splits[node] = split = float(np.median(points[:, axis]))
            right = points[:, axis] > split
            parts[2 * node + 1], parts[2 * node + 2] = points[~right], points[right]
        else:
            parts[2 * node + 1] = parts[2 * node + 2] = points
    return Cells(axes, splits)


class Tree:
    """A kd-tree over projected points: halves where the points are widest, with the box of every node.

    ``order`` has the points leaf by leaf; a leaf is the stretch ``spans[node]`` of it.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.low, self.high, self.children, self.spans, parts = [], [], [], [], []
        self.add(points, np.arange(len(points)), leaf, parts)
        self.low, self.high, self.order = np.array(self.low), np.array(self.high), np.concatenate(parts)

    def add(self, points: np.ndarray, rows: np.ndarray, leaf: int, parts: list[np.ndarray]) -> int:
        number, inside = len(self.children), points[rows]
        low, high = inside.min(axis=0), inside.max(axis=0)
        self.low.append(low), self.high.append(high), self.children.append(None)
        start = self.spans[-1][1] if self.spans else 0
        self.spans.append((start, start))
        if len(rows) > leaf:
            order = rows[np.argsort(inside[:, int((high - low).argmax())], kind="stable")]
            half = len(order) // 2
            self.children[number] = [self.add(points, part, leaf, parts) for part in (order[:half], order[half:])]
        else:
            parts.append(rows)
            self.spans[number] = (start, start + len(rows))
        return number

    def away(self, nodes: list[int], point: np.ndarray) -> np.ndarray:
        """Squared distance of a point from the boxes of nodes."""
        return (np.maximum(np.maximum(self.low[nodes] - point, point - self.high[nodes]), 0.0) ** 2).sum(axis=1)


class Found:
    """The best ids of a search, by cosine and then by id; each id once."""

    def __init__(self, most: int, limit: float) -> None:
        self.most, self.limit, self.best = most, limit, []

    def floor(self) -> float:
        """The cosine that a point must reach to be among the best."""
        return -self.best[-1][0] if len(self.best) == self.most else -np.inf

    def add(self, scores: np.ndarray, ids: list[list[int]], stretched: float) -> None:
        new = [(-score, i) for score, some in zip(scores.tolist(), ids) for i in some]
        held: dict[int, float] = {}
        for score, i in sorted(self.best + new):
            held.setdefault(i, score)
        self.best = [(score, i) for i, score in list(held.items())[: self.most]]
        if len(self.best) == self.most:
            self.limit = min(self.limit, (max(0.0, 2 + 2 * self.best[-1][0]) + 1e-9) * stretched)


#: More than rounding can move a cosine.
ROUNDING = 1e-9


def searcher(width: int, dimensions: int = DIMENSIONS, sure: float = SURE, nearest: int = NEAREST) -> Build:
    """What builds the tree of a block and answers its queries: k1, k2 and ``found``, the ``nearest`` + 1 best of (score, id).

    Queries bring ``bound``, the squared projected distance at which they may stop, or null.
    """
    stretched = stretch(sure, dimensions)

    def build(index: Rows) -> Callable[[Rows], list[tuple]]:
        vectors = padded(index["v"], width)
        tree = Tree(projected(vectors, dimensions))
        vectors, ids = vectors[tree.order], [list(index["ids"][i]) for i in tree.order.tolist()]
        sizes = lengths(vectors)
        scaled = vectors / sizes[:, None]

        def search(vector: np.ndarray, point: np.ndarray, bound: float) -> list[tuple[float, int]]:
            size = float(np.sqrt((vector * vector).sum()))
            asked = vector / size
            found = Found(nearest + 1, np.inf if np.isnan(bound) else bound)
            waiting = [(float(tree.away([0], point)[0]), 0)]
            while waiting:
                away, node = heapq.heappop(waiting)
                if away > found.limit:  # the chi-square test: what comes is too far to be as near as the last one found
                    break
                if tree.children[node]:
                    for there, child in zip(tree.away(tree.children[node], point).tolist(), tree.children[node]):
                        if there <= found.limit:
                            heapq.heappush(waiting, (there, child))
                    continue
                low, high = tree.spans[node]
                rough = scaled[low:high] @ asked
                floor = found.floor()
                if len(rough) > nearest + 1:  # no more than these of the leaf can be among the best
                    floor = max(floor, float(np.partition(rough, -nearest - 1)[-nearest - 1]))
                rows = low + np.flatnonzero(rough >= floor - ROUNDING)
                if len(rows):
                    # Summed along each row alone, so that a cosine is the same in any block.
                    scores = (vectors[rows] * vector).sum(axis=1) / (sizes[rows] * size)
                    found.add(scores, [ids[i] for i in rows.tolist()], stretched)
            return [(-score, i) for score, i in found.best]

        def answer(queries: Rows) -> list[tuple]:
            asked = padded(queries["v"], width)
            bounds = np.array(queries["bound"], dtype=np.float64)
            found = [search(*each) for each in zip(asked, projected(asked, dimensions), bounds)]
            return [(a, b, [{"score": s, "id": i} for s, i in rows]) for a, b, rows in zip(queries["k1"], queries["k2"], found)]

        return answer

    return build


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def points(rows: DataFrame, key: str, vector: str, nearest: int) -> DataFrame:
    """Distinct vectors ``v`` of ``rows`` with two digests of it and the ``nearest`` + 1 smallest ids."""
    distinct = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).distinct()
    few = first_rows(distinct, ["v"], ["id"], nearest + 1, "_rank")
    held = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return held.select(*digests(F.col("v")), "v", "ids")


def digests(vector: Column) -> list[Column]:
    return [F.xxhash64(vector).alias("k1"), F.xxhash64(F.lit(SEED), vector).alias("k2")]


def merged(found: DataFrame, most: int) -> DataFrame:
    """(k1, k2, found): the best of all answers to a query, each id once. A query has at most ``most`` of each block."""
    every = F.transform(F.flatten(F.collect_list("found")), lambda x: F.struct((-x["score"]).alias("s"), x["id"].alias("id")))
    rows = found.groupBy("k1", "k2").agg(F.sort_array(every).alias("all"))
    none = F.slice(F.col("all"), 1, 0)
    once = F.aggregate(
        "all", none,
        lambda kept, x: F.when((F.size(kept) >= most) | F.exists(kept, lambda y: y["id"] == x["id"]), kept).otherwise(F.concat(kept, F.array(x))),
    )
    return rows.select("k1", "k2", F.transform(once, lambda x: F.struct((-x["s"]).alias("score"), x["id"].alias("id"))).alias("found"))


def nearest_neighbours(
    rows: DataFrame, every: int = 50, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST,
    dimensions: int = DIMENSIONS, sure: float = SURE, cell: int = CELL, most_cells: int = MOST_CELLS, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, id, score): the ``nearest`` rows of largest cosine to each row whose key is divisible by ``every``.

    All rows are candidates but the query's own key. Cosines are those of the original vectors in double precision; of equal
    ones the smaller key comes first. Null keys, and vectors that are null, zero, empty or hold null or non-finite components, take no part.
    Repeated rows count once; a key with several vectors is answered for each of them together, and is reported with its best one. Short vectors count as
    filled with zeros. A query without candidates gives no rows, as does an empty table. Other columns are not read.

    The driver receives at most ``sample`` projections (chosen by digest) and the boxes of at most ``most_cells`` cells.
    """
    bound_batches(rows.sparkSession)
    typed = rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(F.col("key").isNotNull() & usable(F.col("v")))
    typed = typed.select("key", F.transform("v", lambda x: x + F.lit(0.0).cast("float")).alias("v"))  # no negative zeros
    nodes = cut_lineage(points(typed, "key", "v", nearest))
    total, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked = typed.where(F.col("key") % every == 0).select(F.col("key").alias("query_id"), *digests(F.col("v")), "v").distinct()
    if not total:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("id"), F.lit(0.0).alias("score")).limit(0)

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(projected(padded(vectors, width), dimensions))) if len(vectors) else pd.Series([], dtype=object)

    wanted = F.pmod(F.col("k1"), F.lit(total)) < sample if total > sample else F.lit(True)
    chosen = nodes.where(wanted).select(project("v").alias("p")).limit(2 * sample).toPandas()["p"]
    count = 2 ** max(0, min(int(log2(most_cells)), ceil(log2(max(1, total / cell)))))
    cells = laid_out(np.stack(chosen.to_numpy()) if len(chosen) else np.zeros((0, dimensions)), count)

    @F.pandas_udf("struct<cell:int,p:array<double>>")
    def placed(vectors: pd.Series) -> pd.DataFrame:
        made = projected(padded(vectors, width), dimensions)
        return pd.DataFrame({"cell": cells.of(made), "p": list(made)})

    index = cut_lineage(nodes.withColumn("_at", placed("v")).select("k1", "k2", "v", "ids", F.col("_at.cell").alias("cell"), F.col("_at.p").alias("p")))
    ends = [f(F.get("p", F.lit(i))).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(dimensions)]
    boxes = index.groupBy("cell").agg(*ends).toPandas().sort_values("cell")
    numbers = boxes.pop("cell").to_numpy()
    low, high = boxes.to_numpy(dtype=np.float64)[:, :dimensions], boxes.to_numpy(dtype=np.float64)[:, dimensions:]

    @F.pandas_udf("array<int>")
    def others(vectors: pd.Series, homes: pd.Series, bounds: pd.Series) -> pd.Series:
        made = projected(padded(vectors, width), dimensions)
        limits = bounds.fillna(np.inf).to_numpy(dtype=np.float64)
        reached = []
        for point, home, limit in zip(made, homes, limits):
            away = (np.maximum(np.maximum(low - point, point - high), 0.0) ** 2).sum(axis=1)
            reached.append(numbers[(away <= limit) & (numbers != home)].tolist())
        return pd.Series(reached, dtype=object)

    build = searcher(width, dimensions, sure, nearest)
    schema = "k1 bigint, k2 bigint, found array<struct<score:double,id:bigint>>"
    blocks = index.select("cell", "k1", "k2", "v", "ids", F.lit(None).cast("double").alias("bound"))
    columns = ["k1", "k2", "v", "ids", "bound"]

    def answers(queries: DataFrame) -> DataFrame:
        return meet(blocks, queries.select("cell", *columns), ["cell"], ["k1", "k2"], build, schema, INDEX_ROWS, QUERY_ROWS)

    distinct = asked.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    queries = blocks.join(distinct, ["k1", "k2"], "left_semi").withColumn("ids", F.lit(None).cast("array<bigint>"))
    first = cut_lineage(merged(answers(queries), nearest + 1))
    last = F.get("found", F.lit(nearest))["score"]
    limit = F.when(last.isNotNull(), (F.greatest(F.lit(0.0), 2 - 2 * last) + 1e-9) * stretch(sure, dimensions))
    known = queries.drop("bound").join(first.select("k1", "k2", limit.alias("bound")), ["k1", "k2"])
    routed = known.withColumn("cell", F.explode(others("v", "cell", "bound")))
    every_answer = cut_lineage(merged(first.unionByName(answers(routed)), nearest + 1))
    joined = asked.select("query_id", "k1", "k2").join(every_answer, ["k1", "k2"])
    # A key with several vectors has several rows here; otherwise this is one row per query.
    single = joined.select("query_id", F.filter("found", lambda x: x["id"] != F.col("query_id")).alias("found"))
    ranked = single.select("query_id", F.posexplode(F.slice("found", 1, nearest)).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
