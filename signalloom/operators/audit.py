"""Coverage of inputs by date and by security, warnings, and feasibility of a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import active_members


def _cells(grid: DataFrame, active: DataFrame, lookback: int, horizon: int, lag: int) -> DataFrame:
    """One row an active (date, security) with flags: prices at the window's ends, paired history, label prices."""
    w = Window.partitionBy("symbol").orderBy("pos")
    pair = F.col("price").isNotNull() & F.col("bench").isNotNull()
    both = (pair & F.lag(pair).over(w)).cast("long")
    flagged = grid.withColumn("_both", F.coalesce(both, F.lit(0)))
    flagged = flagged.select(
        "symbol", F.col("session").alias("as_of_date"), F.col("price").isNotNull().alias("decision_price"),
        F.coalesce(F.lag(F.col("price"), lookback).over(w).isNotNull(), F.lit(False)).alias("start_price"),
        F.sum("_both").over(w.rowsBetween(-lookback + 1, 0)).alias("paired"),
        F.coalesce(F.lead("price", lag).over(w).isNotNull() & F.lead("price", lag + horizon).over(w).isNotNull(), F.lit(False)).alias("label_prices"),
    )
    return active.join(flagged, ["as_of_date", "symbol"], "left")


def _counts(cells: DataFrame, key: str, least: int) -> DataFrame:
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return cells.groupBy(key).agg(
        F.count("*").alias("active_count"), flag(F.col("decision_price").isNotNull()).alias("known_count"), flag(F.col("decision_price")).alias("decision_price_count"),
        flag(F.col("start_price")).alias("start_price_count"), flag(F.col("paired") >= least).alias("eligible_count"), flag(F.col("paired") == 0).alias("no_history_count"),
        flag(F.col("label_prices")).alias("label_price_count"), flag(F.col("label_prices") & (F.col("paired") >= least)).alias("usable_count"),
    )


def coverage(grid: DataFrame, dates: DataFrame, members: DataFrame, *, lookback: int, least: int, horizon: int, lag: int) -> tuple[DataFrame, DataFrame]:
    """Counters by date and by security."""
    cells = _cells(grid, active_members(dates, members), lookback, horizon, lag)
    return _counts(cells, "as_of_date", least), _counts(cells, "symbol", least)


def warnings(by_date: DataFrame, least_cross_section: int) -> list[str]:
    """Coded conditions that hold on some date."""
    c = F.col
    checks = {
        "no_active_members": c("active_count") == 0, "unknown_members": c("known_count") < c("active_count"), "missing_decision_prices": c("decision_price_count") < c("active_count"),
        "missing_window_start_prices": c("start_price_count") < c("active_count"), "thin_cross_section": c("eligible_count") < least_cross_section, "missing_label_prices": c("label_price_count") < c("active_count"),
    }
    row = by_date.agg(*[F.coalesce(F.bool_or(x), F.lit(False)).alias(k) for k, x in checks.items()]).first()
    return [k for k in checks if row[k]]


def preflight_dates(panel: DataFrame, target: str, realized: str, least: int) -> DataFrame:
    """Per date: rows, targets, returns, and whether each suffices for a cross-section."""
    out = panel.groupBy("as_of_date").agg(F.count("*").alias("row_count"), F.count(target).alias("target_count"), F.count(realized).alias("return_count"))
    return out.withColumn("ic_evaluable", F.col("target_count") >= least).withColumn("spread_evaluable", F.col("return_count") >= least)


def preflight(assigned: DataFrame, target: str, *, least: int, lags: int, least_dates: int = 1) -> dict:
    """Purge counts a fold, support for the planned inference, and warnings; nothing is fitted."""
    folds = assigned.groupBy("fold").agg(
        F.count_if(F.col("role") == "training").alias("training"), F.count_if(F.col("role") == "evaluation").alias("evaluation"),
        F.count_if(F.col("exclusion_reason") == "label_overlap").alias("purged"), F.count_if(F.col("exclusion_reason").isin("missing_label", "missing_target")).alias("missing"),
        F.countDistinct(F.when(F.col("role") == "training", F.col("as_of_date"))).alias("training_dates"),
    ).orderBy("fold")
    daily = assigned.where("role = 'evaluation'").groupBy("fold", "as_of_date").agg(F.count(target).alias("n"))
    dates = daily.where(F.col("n") >= least).count()
    rows = [r.asDict() for r in folds.collect()]
    found = []
    if dates < 2:
        found.append("insufficient_hac_dates")
    elif lags > dates - 1:
        found.append("unsupported_hac_lags")
    elif dates <= 2 * (lags + 1):
        found.append("short_hac_period")
    if dates < least_dates:
        found.append("acceptance_date_count_unreachable")
    feasible = bool(rows) and all(r["training"] and r["evaluation"] for r in rows)
    return {"folds": rows, "evaluable_dates": dates, "hac_supported": dates >= 2 and lags <= dates - 1, "warnings": found, "feasible": feasible}
