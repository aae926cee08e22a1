"""Price histories derived from the star-schema test tables.

Sessions are the Mondays of ISO weeks; a symbol's price is the mean unit price
of its week, rounded so that any engine starts from equal numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import ClassVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import on_each, proven_few
from ..operators import grid as G
from ..operators.panel import PanelConfig, build_panel, forward_targets, label_sessions

#: Tables that were asked for, by application, folder, universe and name.
_KEPT: dict[tuple[str, str, str, str], DataFrame] = {}
CONFIG = PanelConfig(lookback_sessions=26, min_observations=13, target_horizon_sessions=4, entry_lag_sessions=1, annualization_sessions=52)
TARGET = "forward_excess_return"


def release() -> None:
    """Let go of the tables that applications share, as before a cold measurement."""
    for df in _KEPT.values():
        df.unpersist(blocking=True)
    _KEPT.clear()


def six(x: F.Column) -> F.Column:
    """Six decimals by plain arithmetic, with a nudge, so that exact halves round alike whatever the order of a sum."""
    return F.floor(x * 1e6 + 0.5001) / 1e6


def week_lines(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """symbol, session and unit price of each line of suppliers, brands or nations."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    session = F.date_trunc("week", "l_shipdate").cast("date").alias("session")
    unit = (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit")
    if by == "supplier":
        return lines.select(F.col("l_suppkey").alias("symbol"), session, unit)
    if by == "brand":
        parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("symbol"))
        return lines.select("l_partkey", session, unit).join(parts, F.col("l_partkey") == F.col("p_partkey")).select("symbol", "session", "unit")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("symbol"))
    owners = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "symbol")
    return lines.select("l_orderkey", session, unit).join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select("symbol", "session", "unit")


def week_prices(lines: DataFrame) -> DataFrame:
    """symbol, session and price, the mean of a week's lines."""
    return lines.groupBy("symbol", "session").agg(six(F.avg("unit")).alias("price"))


def benchmark(prices: DataFrame) -> DataFrame:
    """session and the mean price of all symbols that have one."""
    return prices.groupBy("session").agg(six(F.avg("price")).alias("price"))


def decision_dates(cal: DataFrame) -> DataFrame:
    """Every fourth session after the first year."""
    return cal.where("pos >= 52 AND (pos - 52) % 4 = 0").select(F.col("session").alias("as_of_date"))


def memberships(symbols: DataFrame, cal: DataFrame, by: str) -> DataFrame:
    """One open interval, or two with a gap between for keys divisible by 3 (brands are all open)."""
    day = lambda i: F.max(F.when(F.col("pos") == i, F.col("session")))
    days = cal.agg(day(0).alias("s0"), day(150).alias("s150"), day(200).alias("s200"))
    one = F.array(F.struct(F.col("s0").alias("effective_from"), F.lit(None).cast("date").alias("effective_to")))
    two = F.array(F.struct(F.col("s0").alias("effective_from"), F.col("s150").alias("effective_to")), F.struct(F.col("s200").alias("effective_from"), F.lit(None).cast("date").alias("effective_to")))
    gap = F.lit(False) if by == "brand" else F.col("symbol") % 3 == 0
    rows = on_each(symbols, days, 1).select("symbol", F.explode(F.when(gap, two).otherwise(one)).alias("m"))
    return rows.select(F.lit(by).alias("universe_id"), "symbol", "m.effective_from", "m.effective_to", F.lit("derived").alias("source"))


@dataclass
class Universe:
    """A universe of derived prices with its calendar, benchmark, memberships and decision dates."""

    spark: SparkSession
    sf_dir: str
    by: str = "supplier"

    #: Least cross-section and quantiles, the same for every folder: a small one gives thin results.
    least: ClassVar[int] = 20
    quantiles: ClassVar[int] = 5

    @cached_property
    def lines(self) -> DataFrame:
        return week_lines(self.spark, self.sf_dir, self.by)

    @cached_property
    def prices(self) -> DataFrame:
        return self._kept("prices", lambda: week_prices(self.lines))

    @cached_property
    def calendar(self) -> DataFrame:
        return G.calendar(self.prices)

    @cached_property
    def bench(self) -> DataFrame:
        return benchmark(self.prices)

    @cached_property
    def grid(self) -> DataFrame:
        return G.dense_grid(self.prices, self.calendar, self.bench)

    @cached_property
    def members(self) -> DataFrame:
        return memberships(self.prices.select("symbol").distinct(), self.calendar, self.by)

    @cached_property
    def dates(self) -> DataFrame:
        return decision_dates(self.calendar)

    @cached_property
    def active(self) -> DataFrame:
        return G.active_members(self.dates, self.members)

    @cached_property
    def panel(self) -> DataFrame:
        return self._kept("panel", lambda: build_panel(self.prices, self.calendar, self.bench, self.members, self.dates, CONFIG))

    @cached_property
    def targets(self) -> DataFrame:
        """as_of_date, symbol, label_end_date, forward_return and target of the panel's rows, for what reads nothing else of it."""
        return self._kept("targets", self._targets)

    def _targets(self) -> DataFrame:
        # From the lines: neither the panel nor prices of other weeks than those that labels begin or end in.
        cal = self._kept("sessions", lambda: G.calendar(self.lines))
        dates = decision_dates(cal)
        ends = label_sessions(cal, CONFIG).join(proven_few(dates, G.MOST_SESSIONS), "as_of_date", "left_semi")
        due = ends.select(F.explode(F.array("label_start_date", "label_end_date")).alias("session")).distinct()
        prices = self._kept("label_prices", lambda: week_prices(self.lines.join(proven_few(due, G.MOST_SESSIONS), "session", "left_semi")))
        active = G.active_members(dates, memberships(self.lines.select("symbol").distinct(), cal, self.by))
        return forward_targets(prices, benchmark(prices), ends, active)

    def _kept(self, what: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that an application builds once for all queries on it, in memory or else on disk.

        Prices are aggregates, far smaller than the lines they come from, which
        are so read once and not by every use of the prices.
        """
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.by, what)
        if key not in _KEPT:
            _KEPT[key] = build().persist(StorageLevel.MEMORY_AND_DISK)
        return _KEPT[key]
