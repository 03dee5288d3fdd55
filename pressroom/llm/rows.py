"""Running a function over the text of every row.

Spark hands a Python worker Arrow batches, which ``bound_batches`` keeps to ``BATCH_ROWS`` rows and
``BATCH_BYTES`` bytes; a worker holds one such batch and its result, whatever the table size. The functions are pure: a
task that is lost with its executor gives the same rows when it runs again.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Words are runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_ROWS = 500
BATCH_BYTES = 16 * 2**20
PREFIX = "spark.sql.execution.arrow."


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to what a worker should hold at once; lower ones stay."""
    if not 0 < int(spark.conf.get(f"{PREFIX}maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set(f"{PREFIX}maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set(f"{PREFIX}maxBytesPerBatch", f"{BATCH_BYTES}b")


def ascii_lowered(text: str) -> str:
    """A-Z in lower case, every other character as it is: bytes know no other letters."""
    return text.encode().lower().decode()


def text_function(function: Callable[[str], tuple], schema: str) -> Callable[[Column], Column]:
    """A struct column of ``schema`` with ``function`` of each text; a null text counts as empty."""
    kind = StructType.fromDDL(schema)
    names = kind.names

    @F.pandas_udf(kind)
    def apply(texts: pd.Series) -> pd.DataFrame:
        rows = [function(text if isinstance(text, str) else "") for text in texts]
        return pd.DataFrame(rows, columns=names, dtype=object)

    return apply


def over_texts(docs: DataFrame, function: Callable[[str], tuple], schema: str, key: str, text: str) -> DataFrame:
    """``key`` and the columns of ``schema``. Other columns of ``docs`` are not read, so names cannot clash."""
    bound_batches(docs.sparkSession)
    made = text_function(function, schema)
    rows = docs.select(F.col(key).alias("key"), made(F.col(text)).alias("made"))
    names = _parse_datatype_string(schema).names
    return rows.select(F.col("key").alias(key), *[F.col("made")[name].alias(name) for name in names])


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(text, upper, upper.lower())
