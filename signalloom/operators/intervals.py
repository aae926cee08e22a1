"""Points in half-open intervals, joined on bins of time rather than by comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days of a bin. An interval takes as many rows as it has bins with points, a bin holds as many days at most.
BIN_DAYS = 128


def points_in_intervals(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, *, days: int = BIN_DAYS) -> DataFrame:
    """Each row of ``intervals`` beside each distinct ``point`` (a date) with start <= point < end; a null end is open.

    Both sides meet by the bin's number, so the join has an equal key: the distinct
    points of a bin, at most ``days``, are one row, and an interval is put into
    the bins between its ends that hold points.
    """
    bin_of = lambda c: F.floor(F.unix_date(c) / days).cast("int")
    held = points.select(F.col(point).alias("_p")).where("_p IS NOT NULL").distinct().groupBy(bin_of("_p").alias("_bin")).agg(F.sort_array(F.collect_list("_p")).alias("_points"))
    # One row: the bins that there are, so that open intervals end somewhere; all days of ten thousand years have 28,538.
    span = held.agg(F.sort_array(F.collect_list("_bin")).alias("_bins"))
    first, last = bin_of(start), F.coalesce(bin_of(F.date_sub(end, 1)), F.lit(2**31 - 1))
    dealt = intervals.join(F.broadcast(span)).withColumn("_bin", F.explode(F.filter("_bins", lambda b: (b >= first) & (b <= last))))
    met = dealt.join(held, "_bin").withColumn(point, F.explode("_points"))
    return met.where((F.col(start) <= F.col(point)) & (F.col(end).isNull() | (F.col(point) < F.col(end)))).select(point, *intervals.columns)
