"""Session settings the jobs rely on, and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str, shuffle_partitions: int, app_name: str = "pressroom") -> SparkSession:
    """A session for tests and benchmarks. On a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> None:
    """Hours and days are read in UTC, whatever zone the cluster defaults to."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one named in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one, once, and names it in its own settings.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = spark.conf.get("pressroom.local.folder", None) or tempfile.mkdtemp(prefix="pressroom-shared-")
    spark.conf.set("pressroom.local.folder", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and continue from the files.

    Used where several passes read one expensive intermediate: the passes then survive lost executors
    without recomputing what is behind it, and the table's size is known to the optimizer. The files
    are removed when the application ends.
    """
    spark = df.sparkSession
    place = scratch(spark)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder, removed with all that was written there when the application ends."""
    place = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)  # only what exists is removed at the end
    system.deleteOnExit(path)
    return f"{place}/data"
