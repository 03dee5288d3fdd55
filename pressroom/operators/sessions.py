"""Gap sessions over reading histories.

A session ends when the next reading comes more than the gap later. All readings of one user that
fall in the same clock cell of one gap's width are less than a gap apart, so they belong to one
session. That lets the readings be combined per cell before any shuffle; only the cells, at most
one per hour and user whatever the traffic, are ordered and stitched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_MICROS = 3_600_000_000
MIN_IMPRESSIONS = 2


def _hour_of(micros: Column) -> Column:
    return F.hour(F.timestamp_micros(micros)).cast("int")


def _numbered(rows: DataFrame, first: str, last: str, position: str, gap_micros: int) -> DataFrame:
    """Add ``session_no``, counted per user. A new split, an unknown instant or a long gap starts a session.

    The window is by user alone, so that everything later grouped by user needs no further shuffle.
    """
    ordered = Window.partitionBy("user_id").orderBy("split", position)
    gap = F.when(F.lag("split").over(ordered) == F.col("split"), F.col(first) - F.lag(last).over(ordered))
    fresh = rows.withColumn("_new", (gap.isNull() | (gap > gap_micros)).cast("int"))
    return fresh.withColumn("session_no", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))


def hour_cells(history: DataFrame, gap_micros: int = GAP_MICROS, also: Sequence[Column] = ()) -> DataFrame:
    """Readings combined per user, split and clock cell of one gap's width; ``also`` are further aggregates of the rows.

    Rows without an instant make a cell whose ``_cell`` is null.
    """
    # The instant stays a column for ``also``.
    cells = history.withColumn("_us", F.unix_micros("impression_time")).withColumn("_cell", F.floor(F.col("_us") / gap_micros))
    return cells.groupBy("user_id", "split", "_cell").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_us").alias("_first"),
        F.max("_us").alias("_last"),
        F.sum(F.col("_us") - F.col("_cell") * gap_micros).alias("_offset"),
        *also,
    )


def sessions_of_cells(cells: DataFrame, gap_micros: int = GAP_MICROS) -> DataFrame:
    """Sessions per user and split from ``hour_cells``. Columns as ``user_sessions``."""
    known = cells.where(F.col("_cell").isNotNull()).select("user_id", "split", "_cell", "_n", "_first", "_last", "_offset")
    numbered = _numbered(known, "_first", "_last", "_cell", gap_micros)
    # Exact sum of microseconds: cell starts times counts exceed 64 bits.
    wide = (F.col("_cell") * gap_micros).cast("decimal(20,0)") * F.col("_n").cast("decimal(18,0)")
    sessions = numbered.groupBy("user_id", "split", "session_no").agg(
        F.sum("_n").alias("n_impressions"),
        F.min("_first").alias("start_us"),
        F.max("_last").alias("end_us"),
        F.sum(wide + F.col("_offset")).alias("_total"),
    )
    mean = F.floor(F.col("_total") / F.col("n_impressions")).cast("bigint")
    return sessions.withColumn("session_hour", _hour_of(mean)).drop("_total")


def user_sessions(history: DataFrame, gap_micros: int = GAP_MICROS) -> DataFrame:
    """Sessions per user and split, from history entries in time order. Null instants are ignored.

    Columns: ``user_id, split, session_no, n_impressions, start_us, end_us, session_hour``, where the
    hour is that of the mean instant.
    """
    known = history.where(F.col("impression_time").isNotNull()).select("user_id", "split", "impression_time")
    return sessions_of_cells(hour_cells(known, gap_micros), gap_micros)


#: Entries of a list that are put in order by one task.
CHUNK = 4_096


def user_sessions_from_lists(history: DataFrame, gap_micros: int = GAP_MICROS, chunk: int = CHUNK) -> DataFrame:
    """The same from one row per user and split with a timestamp list, in list order.

    For lists that are not sorted by time; null instants start a session of their own. See ``sessions_of_entries``.
    """
    entries = history.select(
        "user_id", "split", F.posexplode_outer("impression_time_fixed").alias("_pos", "_at")
    ).select("user_id", "split", "_pos", F.unix_micros("_at").alias("_us"))
    return sessions_of_entries(entries, gap_micros, chunk)


def sessions_of_entries(entries: DataFrame, gap_micros: int = GAP_MICROS, chunk: int = CHUNK) -> DataFrame:
    """Sessions of (user_id, split, _pos, _us), positions counting from 0, or null for a history without entries.

    Entries are numbered within chunks of ``chunk`` positions. A chunk's summary, its first and last instant and the sessions
    that begin inside it, is all the next chunk needs: the summaries are stitched in order, and partial sessions that meet at a
    boundary add up. So a user with very many entries is as many tasks' work as there are chunks; only the summaries are
    one window.
    """
    piece = ["user_id", "split", "_chunk"]
    cut = entries.withColumn("_chunk", F.coalesce(F.floor(F.col("_pos") / chunk), F.lit(0)))
    inside = Window.partitionBy(*piece).orderBy("_pos")
    gap = F.col("_us") - F.lag("_us").over(inside)
    # The chunk's first entry is left to the stitching.
    fresh = F.when(F.row_number().over(inside) == 1, 0).otherwise((gap.isNull() | (gap > gap_micros)).cast("int"))
    numbered = cut.withColumn("_new", fresh)
    numbered = numbered.withColumn("_local", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    partial = numbered.groupBy(*piece, "_local").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_us").alias("_start"),
        F.max("_us").alias("_end"),
        F.sum(F.col("_us").cast("decimal(20,0)")).alias("_total"),
        F.count("_us").alias("_known"),
        F.min(F.struct("_pos", "_us")).alias("_first"),
        F.max(F.struct("_pos", "_us")).alias("_last"),
    )
    summaries = partial.groupBy(*piece).agg(
        F.max("_local").alias("_began"), F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )
    ordered = Window.partitionBy("user_id").orderBy("split", "_chunk")
    since = F.when(F.lag("split").over(ordered) == F.col("split"), F.col("_first._us") - F.lag("_last._us").over(ordered))
    begins = (since.isNull() | (since > gap_micros)).cast("int")
    stitched = summaries.withColumn("_opens", begins)
    upto = F.sum(F.col("_opens") + F.col("_began")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    # Sessions before the chunk, and the one its first entry belongs to.
    offsets = stitched.select(*piece, (upto - F.col("_began")).alias("_offset"))
    joined = partial.join(offsets, piece).withColumn("session_no", F.col("_offset") + F.col("_local"))
    sessions = joined.groupBy("user_id", "split", "session_no").agg(
        F.sum("_n").alias("n_impressions"),
        F.min("_start").alias("start_us"),
        F.max("_end").alias("end_us"),
        F.sum("_total").alias("_total"),
        F.sum("_known").alias("_known"),
    )
    mean = F.floor(F.try_divide(F.col("_total"), F.col("_known"))).cast("bigint")
    return sessions.withColumn("session_hour", _hour_of(mean)).drop("_total", "_known")


def meaningful(sessions: DataFrame, min_impressions: int = MIN_IMPRESSIONS) -> DataFrame:
    """Sessions with enough impressions; single visits are treated as accidental."""
    return sessions.where(F.col("n_impressions") >= min_impressions)


def session_hour_propensity(sessions: DataFrame) -> DataFrame:
    """Share of a user's sessions in each hour: ``user_id, session_hour, n_sessions, propensity``."""
    per_hour = sessions.groupBy("user_id", "session_hour").agg(F.count(F.lit(1)).alias("n_sessions"))
    total = F.sum("n_sessions").over(Window.partitionBy("user_id"))
    return per_hour.withColumn("propensity", (F.col("n_sessions") / total).cast("float"))


def time_profile(sessions: DataFrame) -> DataFrame:
    """One row per user with a float share for each hour, columns ``0`` to ``23``.

    One aggregation by user; users without a session are absent.
    """
    total = F.count(F.lit(1))
    shares = [
        (F.count_if(F.col("session_hour") == hour) / total).cast("float").alias(str(hour)) for hour in range(24)
    ]
    return sessions.groupBy("user_id").agg(*shares)
