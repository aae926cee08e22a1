"""Calendar positions, dense grids, returns and memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dealt, on_each, proven_few
from .intervals import points_in_intervals

#: Sessions of a calendar at most, which bounds what is broadcast; over two thousand years of days.
MOST_SESSIONS = 1 << 20


def calendar(sessions: DataFrame, date: str = "session") -> DataFrame:
    """session and its position from 0. One row a session, so a window over all is small."""
    return sessions.select(F.col(date).alias("session")).distinct().select("session", (F.row_number().over(Window.orderBy("session")) - 1).alias("pos"))


def dense_grid(prices: DataFrame, cal: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """symbol, pos, session, price (NULL in gaps) and the benchmark's price, on every session.

    The calendar rides on each symbol as one array, so no cross join is made;
    off-calendar prices vanish. Symbols are dealt first: they are so few bytes
    that adaptive execution would put all of them, and so the grid, in one task
    (a hash of theirs, as dealing by what is distinct already is left out).
    """
    dense = on_each(dealt(prices.select("symbol").distinct(), F.hash("symbol")), cal.select("pos", "session"), MOST_SESSIONS)
    out = dense.join(prices.select("symbol", "session", "price"), ["symbol", "session"], "left")
    if bench is not None:
        out = out.join(proven_few(bench.select("session", F.col("price").alias("bench")), MOST_SESSIONS), "session", "left")
    return out


def adjacent_returns(grid: DataFrame) -> DataFrame:
    """Simple returns between neighbouring sessions, never across a gap: r and (with a benchmark) b."""
    w = Window.partitionBy("symbol").orderBy("pos")
    out = grid.withColumn("r", F.col("price") / F.lag("price").over(w) - 1)
    return out.withColumn("b", F.col("bench") / F.lag("bench").over(w) - 1) if "bench" in grid.columns else out


def active_members(dates: DataFrame, members: DataFrame, universe: str | None = None) -> DataFrame:
    """as_of_date and symbol of members whose half-open interval holds the date.

    Intervals are dealt before they meet their dates: by their bytes, adaptive execution would put all of them, and so every row, in one task.
    """
    m = members if universe is None else members.where(F.col("universe_id") == universe)
    spans = dealt(m.select("symbol", "effective_from", "effective_to").distinct(), F.hash("symbol"))
    return points_in_intervals(dates, spans, "as_of_date", "effective_from", "effective_to").select("as_of_date", "symbol").distinct()


def missing_sessions(prices: DataFrame, cal: DataFrame) -> DataFrame:
    """Per symbol, the sessions between its first and last price that it has none on."""
    spans = prices.groupBy("symbol").agg(F.min("session").alias("first"), F.max("session").alias("last"))
    until = spans.select("symbol", "first", F.date_add("last", 1).alias("after"))
    due = points_in_intervals(cal, until, "session", "first", "after").select("symbol", "session")
    return due.join(prices.select("symbol", "session"), ["symbol", "session"], "left_anti")


def off_calendar(prices: DataFrame, cal: DataFrame) -> DataFrame:
    """Prices whose date is no session."""
    return prices.join(cal.select("session"), "session", "left_anti")


def session_offset(cal: DataFrame, dates: DataFrame, lag: int, date: str = "as_of_date") -> DataFrame:
    """The date and the session ``lag`` positions on (NULL beyond the calendar)."""
    later = cal.select((F.col("pos") - lag).alias("pos"), F.col("session").alias("execution_date"))
    return dates.join(cal.withColumnRenamed("session", date), date).join(later, "pos", "left").select(date, "pos", "execution_date")
