"""Readers and writers of the log tables.

Histories come in two shapes. A *list* history has one row per user and split with aligned lists, as
the files store it. A *long* history has one row per entry:

``user_id, split, pos, article_id, impression_time, read_time, scroll_percentage``

``pos`` orders the entries of one user and split (any orderable type); a row with a null ``pos``
stands for a history without entries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressroom import schemas

LIST_COLUMNS = {
    "article_id_fixed": "article_id",
    "impression_time_fixed": "impression_time",
    "read_time_fixed": "read_time",
    "scroll_percentage_fixed": "scroll_percentage",
}


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ARTICLES).parquet(path)


def read_docvec(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DOCVEC).parquet(path)


def _read_splits(spark: SparkSession, root: str, splits: Sequence[str], name: str, schema) -> DataFrame:
    parts = [
        spark.read.schema(schema).parquet(f"{root}/{split}/{name}.parquet").withColumn("split", F.lit(split))
        for split in splits
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def read_behaviors(spark: SparkSession, root: str, splits: Sequence[str]) -> DataFrame:
    """Impressions of the named splits, one folder per split, with a ``split`` column."""
    return _read_splits(spark, root, splits, "behaviors", schemas.BEHAVIORS)


def read_history(spark: SparkSession, root: str, splits: Sequence[str]) -> DataFrame:
    """List histories of the named splits, with a ``split`` column."""
    return _read_splits(spark, root, splits, "history", schemas.HISTORY)


def zipped_lists() -> Column:
    """The aligned lists as one list of entries; a missing list gives null fields."""
    empty = {f.name: F.array().cast(f.dataType) for f in schemas.HISTORY.fields if f.name in LIST_COLUMNS}
    return F.arrays_zip(*[F.coalesce(F.col(c), empty[c]).alias(c) for c in LIST_COLUMNS])


def entry_fields(entry: str) -> list[Column]:
    return [F.col(f"{entry}.{c}").alias(name) for c, name in LIST_COLUMNS.items()]


def long_history(history: DataFrame) -> DataFrame:
    """Long form of a list history. Empty and null lists keep one row with a null ``pos``."""
    entries = history.select("user_id", "split", F.posexplode_outer(zipped_lists()).alias("pos", "_e"))
    return entries.select("user_id", "split", "pos", *entry_fields("_e"))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Materialise a feature table as Parquet."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write ``df`` partitioned by ``by``, replacing only the partitions it holds.

    Rows are dealt so that tasks hold about one advisory size each: small partitions take one file, and a large one is
    split over several tasks rather than written by one. A job that is lost half-way leaves the old partitions, as files move to
    their place when all are written; running it again gives the same table.
    """
    sized = df.hint("rebalance", *[F.col(c) for c in by])
    sized.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


#: Lines in a part file of an ordered text.
FILE_LINES = 200_000


def write_ordered_lines(lines: DataFrame, path: str, order: Sequence[str], value: str = "value", file_lines: int = FILE_LINES) -> None:
    """Write the lines in the order of ``order``: each part file holds one range, and the names of the files follow the ranges.

    Reading the part files by name gives the whole in order. The ranges come from a sample, so no task sorts the whole.
    """
    files = max(1, -(-lines.count() // file_lines))
    ranged = lines.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ranged.select(F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the part files of ``write_ordered_lines``, numbered from 1 over all files.

    Large files are read in several blocks; a window holds the lines of one block.
    """
    block = ["file", "block"]
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("at"), "value")
    # One row per block: the lines before it.
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("at"))
    return rows.withColumn("at", inside).join(starts, block).select((F.col("start") + F.col("at")).alias("line"), "value")


def write_lines(lines: DataFrame, path: str) -> None:
    """Write a one-column string frame as text files."""
    lines.write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Write the (few-row) metric table as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The metric table that ``write_metrics`` wrote."""
    return spark.read.schema(schema).json(path)
