"""Keys that hold a large share of the rows.

``hot_keys`` finds them with one partially aggregated count: keys above ``min_rows`` rows, and of these
the ``MOST_HOT`` with most rows. The list has a fixed greatest length, so it may be broadcast whatever the
size of the log; a key left out of it holds less than one row in ``MOST_HOT``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 200_000
MOST_HOT = 500_000
BROADCAST_BYTES = 512 * 2**20


def hottest(counted: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS, most: int = MOST_HOT) -> DataFrame:
    """The hot keys of a table that has ``_rows`` per key already; null keys match nothing and are never hot."""
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    above = counted.where(known & (F.col("_rows") > min_rows)).select(*keys, "_rows")
    # Ties go by key, so that every use of the list has the same keys.
    return above.orderBy(F.desc("_rows"), *keys).limit(most)


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS, most: int = MOST_HOT) -> DataFrame:
    """``keys`` and ``_rows`` of the hot keys of ``df``."""
    return hottest(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, min_rows, most)


def salts_for(rows: str, min_rows: int) -> Column:
    return F.greatest(F.ceil(F.col(rows) / max(min_rows, 1)), F.lit(1)).cast("int")


def with_salts(df: DataFrame, hot: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Add ``_salts``: one per ``min_rows`` rows of a hot key, 1 for other keys. No shuffle of ``df``."""
    salts = hot.select(*keys, salts_for("_rows", min_rows).alias("_salts"))
    marked = df.join(F.broadcast(salts), list(keys), "left")
    return marked.withColumn("_salts", F.coalesce("_salts", F.lit(1)))


def skew_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    min_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
    counted: bool = False,
) -> DataFrame:
    """Equi-join that splits the hot keys of ``big`` over one task per ``min_rows`` of their rows.

    Rows of a hot key get a salt from a hash of ``spread_by``; only the hot keys of ``small`` are
    repeated, once per salt. All other keys keep salt 0, so the join costs one shuffle of each side. In a
    left join rows with a null key match nothing, so their salt is the hash itself and they go
    everywhere. Pass ``hot`` (keys and ``_rows``) when the hot keys are already known, or cheaper to count
    elsewhere. With ``counted``, ``small`` itself has ``_rows``, the rows of ``big`` with its key; the column is dropped.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    if hot is None:
        hot = hot_keys(big.select(*keys), keys, min_rows)
    spread = F.xxhash64(*spread_by)
    salt = F.when(F.col("_salts") > 1, F.pmod(spread, F.col("_salts").cast("bigint"))).otherwise(F.lit(0))
    if how == "left":
        unmatched = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
        salt = F.when(unmatched, spread).otherwise(salt)
    salted_big = with_salts(big, hot, keys, min_rows).withColumn("_salt", salt.cast("bigint")).drop("_salts")
    every = F.sequence(F.lit(0).cast("bigint"), F.col("_salts").cast("bigint") - 1)
    # Salts of a key beyond the hot list find no rows; salt 0 is always there.
    marked = small.withColumn("_salts", salts_for("_rows", min_rows)) if counted else with_salts(small, hot, keys, min_rows)
    salted_small = marked.withColumn("_salt", F.explode(every)).drop("_salts", "_rows")
    return salted_big.join(salted_small, [*keys, "_salt"], how).drop("_salt")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """First ``n`` rows per key in ``order``, numbered from 1 in ``rank``.

    Spark turns the filtered row number into a group limit that runs before the shuffle, so at most
    ``n`` rows per key leave each input task, however large the key is.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
