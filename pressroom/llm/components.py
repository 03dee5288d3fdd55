"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.session import cut_lineage


def star(links: DataFrame, large: bool) -> DataFrame:
    """One star step: every node's larger (or smaller) neighbours move to the smallest node next to it."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    met = ends.join(least, "a")
    moved = met.where("b > a" if large else "b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("least").alias("b")))
    return moved.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links`` (columns a and b), root being its component's smallest node.

    Alternates large-star and small-star steps, each written to the shared folder, until nothing moves;
    the number of rounds grows with the logarithm of the longest chain. The driver receives one row
    per round. Nodes without links are not listed; repeated links and self-links are allowed.
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = cut_lineage(links), None
    for _ in range(rounds):
        current = cut_lineage(star(star(current, large=True), large=False))
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = mark
    raise RuntimeError(f"components still moved after {rounds} rounds")
