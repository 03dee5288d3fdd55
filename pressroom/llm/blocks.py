"""Queries against an index that is cut into blocks, none of which is ever whole in one place unless it is small.

Index rows and queries share their columns. Those of one block meet in one task, the index rows first, so a
worker holds the index rows of one block and streams the queries past them. A block with more than ``index_rows``
index rows is cut by a hash, and its queries visit every piece; a block with more than ``query_rows``
queries has its index rows repeated, once per part of the queries. No pair of rows is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pressroom.llm.rows import bound_batches
from pressroom.session import cut_lineage

#: Large blocks whose list is broadcast; a longer list is joined by a shuffle.
MOST_LARGE = 500_000
Rows = dict[str, list]
#: Builds an index of its rows (columns as lists), which then answers queries (alike) with a list of result rows.
Build = Callable[[Rows], Callable[[Rows], list[tuple]]]


def runs_of(batch: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, Rows]]:
    """The stretches of rows of equal ``keys`` in a batch."""
    columns = {c: batch[c].tolist() for c in batch.columns}
    marks = list(zip(*[columns[k] for k in keys]))
    low = 0
    while low < len(marks):
        high = low + 1
        while high < len(marks) and marks[high] == marks[low]:
            high += 1
        yield marks[low], {c: values[low:high] for c, values in columns.items()}
        low = high


def answered(build: Build, keys: Sequence[str], names: Sequence[str]) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, ask = None, None, None
        for batch in batches:
            found: list[tuple] = []
            for (*block, kind), part in runs_of(batch, [*keys, "_kind"]):
                if block != here:
                    here, held, ask = block, None, None
                if kind == 0:
                    held = part if held is None else {c: held[c] + part[c] for c in held}
                elif held is not None:
                    ask = ask or build(held)
                    found += ask(part)
            if found:
                yield pd.DataFrame(found, columns=names)

    return run


def parts_of(rows: Column, most: int) -> Column:
    return F.greatest(F.ceil(rows / most), F.lit(1)).cast("bigint")


def meet(
    index: DataFrame, queries: DataFrame, keys: Sequence[str], spread: Sequence[str], build: Build, schema: str,
    index_rows: int = 16_384, query_rows: int = 65_536,
) -> DataFrame:
    """What ``build`` answers to every query in each piece of its block. ``keys`` (not null) name the block, ``spread`` cuts it.

    A query whose block has no index rows gives nothing. Partial answers of several pieces are the caller's to merge.
    """
    bound_batches(index.sparkSession)
    marked = index.select(*keys, F.lit(1).alias("_i")).unionByName(queries.select(*keys, F.lit(0).alias("_i")))
    counted = marked.groupBy(*keys).agg(F.sum("_i").alias("_held"), F.count(F.lit(1)).alias("_rows"))
    large = counted.where((F.col("_held") > index_rows) | (F.col("_rows") - F.col("_held") > query_rows))
    asked = F.col("_rows") - F.col("_held")
    large = cut_lineage(large.select(*keys, parts_of(F.col("_held"), index_rows).alias("_pieces"), parts_of(asked, query_rows).alias("_parts")))
    blocks = large.count()  # one per ``index_rows`` or ``query_rows`` rows at most
    one = F.lit(1).cast("bigint")

    def cut(rows: DataFrame, own: str, own_count: str, other: str, other_count: str, kind: int) -> DataFrame:
        rows = rows.withColumn("_kind", F.lit(kind))
        if not blocks:
            return rows.withColumn(own, one - 1).withColumn(other, one - 1)
        rows = rows.join(F.broadcast(large) if blocks <= MOST_LARGE else large, list(keys), "left")
        own_part = F.pmod(F.xxhash64(*spread), F.coalesce(own_count, one))
        every = F.sequence(one - 1, F.coalesce(other_count, one) - 1)
        return rows.withColumn(own, own_part).withColumn(other, F.explode(every)).drop("_pieces", "_parts")

    dealt = cut(index, "_piece", "_pieces", "_part", "_parts", 0).unionByName(cut(queries, "_part", "_parts", "_piece", "_pieces", 1))
    block = [*keys, "_piece", "_part"]
    return dealt.repartition(*block).sortWithinPartitions(*block, "_kind").mapInPandas(answered(build, block, StructType.fromDDL(schema).names), schema)
