"""Small scalar expressions shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def id_hash(*parts: Column | str | int) -> Column:
    """32-bit number drawn from the md5 of the joined parts.

    Depends on the values only, so a sample or a draw is the same under any partitioning.
    """
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def two_level(low_first: Column, low_second: Column) -> Column:
    """Class 1-4 from two threshold tests; a null test counts as failed."""
    return (
        F.when(low_first, F.when(low_second, 1).otherwise(2))
        .otherwise(F.when(low_second, 3).otherwise(4))
        .cast("int")
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, for comparing results across engines."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
