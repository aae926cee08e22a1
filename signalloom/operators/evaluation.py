"""Baselines and the evaluation of scores: daily, by fold, by phase, paired."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import average_rank, clean_double, dealt, name_of, numbered, pct_rank, pearson
from ..functions.statistics import newey_west
from .signals import spread_masses

KEYS = ["phase", "fold", "as_of_date", "model"]


def baseline_signs(daily_ic: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per feature: mean training IC and its direction; a mean of about zero can't be learned from."""
    out = daily_ic.groupBy(*(keys or []), "feature").agg(F.avg("rank_ic").alias("mean_rank_ic"))
    return out.withColumn("direction", F.when(F.abs("mean_rank_ic") > 1e-12, F.signum("mean_rank_ic").cast("int")))


def best_metric(signs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The feature with the largest absolute mean IC, ties by name."""
    order = Window.partitionBy(*(keys or [])).orderBy(F.desc(F.abs("mean_rank_ic")), "feature")
    return signs.where(F.col("direction").isNotNull()).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def signed_ranks(panel: DataFrame, signs: dict[str, int], date: str = "as_of_date") -> DataFrame:
    """Per row and feature: its percentile rank, or one minus it for a negative direction."""
    out = dealt(panel, date)
    for f, sign in signs.items():
        rank = pct_rank(f, date)
        out = out.withColumn(f"_rank_{f}", rank if sign > 0 else 1 - rank)
    return out


def equal_weight_scores(panel: DataFrame, signs: dict[str, int], date: str = "as_of_date", symbol: str = "symbol") -> DataFrame:
    """The mean of a row's available signed ranks, and how many there are; null without any."""
    ranked = signed_ranks(panel.select(date, symbol, *signs), signs, date)
    count, score = mean_rank([F.col(f"_rank_{f}") for f in signs])
    return ranked.select(date, symbol, count.alias("feature_count"), score.alias("score"))


def mean_rank(ranks: list[Column]) -> tuple[Column, Column]:
    """How many of the ranks there are, and their mean; null without any."""
    some = F.filter(F.array(*ranks), lambda x: x.isNotNull())
    total = F.aggregate(some, F.lit(0.0), lambda a, x: a + x)
    return F.size(some), F.when(F.size(some) > 0, total / F.size(some))


def _daily(rows: DataFrame, least: int, quantiles: int, universe: str) -> DataFrame:
    """Metrics a (phase, fold, date, model) from score, target and realized_return; masks of IC and spread are independent."""
    counts = rows.groupBy(*KEYS).agg(
        F.max(universe).alias("universe_count"), F.count("score").alias("score_count"),
        F.count(F.when(F.col("score").isNotNull(), F.col("target"))).alias("ic_pairs"),
        F.count(F.when(F.col("score").isNotNull(), F.col("realized_return"))).alias("spread_pairs"),
        F.countDistinct("score").alias("distinct_scores"),
    )
    pairs = rows.where("score IS NOT NULL AND target IS NOT NULL")
    ranked = dealt(pairs, *KEYS).withColumn("_x", average_rank("score", *KEYS)).withColumn("_y", average_rank("target", *KEYS))
    ic = ranked.groupBy(*KEYS).agg(F.when(F.count("*") >= least, pearson("_x", "_y")).alias("rank_ic"))
    spread = spread_masses(rows, KEYS, "score", "realized_return", quantiles)
    spread = spread.select(*KEYS, F.when((F.col("pairs") >= least) & (F.col("scores") > 1), F.col("spread")).alias("spread"))
    out = counts.join(ic, KEYS, "left").join(spread, KEYS, "left")
    share = lambda c: F.col(c) / F.col("universe_count")
    return out.select(
        *KEYS, "universe_count", "score_count", "rank_ic", "spread",
        share("score_count").alias("score_coverage"), share("ic_pairs").alias("ic_coverage"), share("spread_pairs").alias("spread_coverage"),
        (1 - F.try_divide(F.col("distinct_scores"), F.col("score_count"))).alias("tied_fraction"),
    )


def _clean(predictions: DataFrame) -> DataFrame:
    return predictions.select(*KEYS, "symbol", *[clean_double(c).alias(c) for c in ("score", "target", "realized_return")])


def native_daily_metrics(predictions: DataFrame, least: int, quantiles: int) -> DataFrame:
    """Every model on the rows that it scores."""
    rows = _clean(predictions).withColumn("_all", F.count("*").over(Window.partitionBy(*KEYS)))
    return _daily(rows, least, quantiles, "_all")


def common_daily_metrics(predictions: DataFrame, models: list[str], least: int, quantiles: int) -> DataFrame:
    """Models on the symbols that all of them score; coverages divide by the universe before that."""
    rows = _clean(predictions).where(F.col("model").isin(models)).withColumn("_all", F.count("*").over(Window.partitionBy(*KEYS)))
    scored = F.count("score").over(Window.partitionBy("phase", "fold", "as_of_date", "symbol"))
    return _daily(rows.withColumn("_scored", scored).where(F.col("_scored") == len(models)), least, quantiles, "_all")


def common_scope_violations(predictions: DataFrame, models: list[str]) -> DataFrame:
    """How often models may not be compared on common rows: check, violations.

    All models must know the same outcomes of a row, have each row once, and have
    rows on each date of a fold.
    """
    rows = _clean(predictions).where(F.col("model").isin(models))
    row = ["phase", "fold", "as_of_date", "symbol"]
    kinds = lambda c: F.countDistinct(c) + F.when((F.count(c) > 0) & (F.count(c) < F.count("*")), 1).otherwise(0)
    by_row = rows.groupBy(*row).agg(F.count("*").alias("n"), F.countDistinct("model").alias("m"), kinds("target").alias("t"), kinds("realized_return").alias("r"))
    faults = by_row.agg(F.count_if(F.col("t") > 1).alias("targets"), F.count_if(F.col("r") > 1).alias("returns"), F.coalesce(F.sum(F.col("n") - F.col("m")), F.lit(0)).alias("repeats"))
    by_date = rows.groupBy(*row[:3]).agg(F.countDistinct("model").alias("m")).agg(F.coalesce(F.sum(F.lit(len(models)) - F.col("m")), F.lit(0)).alias("absent"))
    both = faults.crossJoin(by_date)  # one row each
    names = {"differing_targets": "targets", "differing_returns": "returns", "repeated_rows": "repeats", "absent_models": "absent"}
    return both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(v).cast("long").alias("violations")) for k, v in names.items()])).alias("x")).select("x.*")


def _rolled(daily: DataFrame, keys: list[str], lags: int | None) -> DataFrame:
    sums = (
        F.count("*").alias("date_count"), F.count("rank_ic").alias("ic_date_count"), F.avg("rank_ic").alias("mean_rank_ic"), F.median("rank_ic").alias("median_rank_ic"),
        F.stddev_samp("rank_ic").alias("std_rank_ic"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_date_rate"),
        F.avg("spread").alias("mean_spread"), F.count("spread").alias("spread_date_count"),
        F.avg("score_coverage").alias("mean_score_coverage"), F.avg("ic_coverage").alias("mean_ic_coverage"), F.avg("spread_coverage").alias("mean_spread_coverage"),
    )
    out = daily.groupBy(*keys).agg(*sums) if lags is None else newey_west(daily, keys, "as_of_date", "rank_ic", lags, sums).drop("n", "n_values", "mean")
    return out.withColumn("information_ratio", F.when(F.col("std_rank_ic") > 0, F.col("mean_rank_ic") / F.col("std_rank_ic")))


def fold_metrics(daily: DataFrame) -> DataFrame:
    return _rolled(daily, ["phase", "fold", "model"], None)


def phase_summary(daily: DataFrame, lags: int) -> DataFrame:
    return _rolled(daily, ["phase", "model"], lags)


def paired_deltas(daily: DataFrame, schedule: DataFrame, candidate: str, reference: str) -> DataFrame:
    """Per scheduled date: both models' ICs and their difference where both exist."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("rank_ic")))
    wide = daily.groupBy("as_of_date").agg(pick(candidate).alias("candidate_ic"), pick(reference).alias("reference_ic"))
    return schedule.select("as_of_date").distinct().join(wide, "as_of_date", "left").withColumn("delta", F.col("candidate_ic") - F.col("reference_ic"))


def paired_summary(deltas: DataFrame) -> DataFrame:
    """Counts, coverage of the schedule and the mean paired delta."""
    return deltas.agg(
        F.count("*").alias("scheduled_count"), F.count("candidate_ic").alias("candidate_count"), F.count("reference_ic").alias("reference_count"),
        F.count("delta").alias("paired_count"), (F.count("delta") / F.count("*")).alias("paired_coverage"), F.avg("delta").alias("mean_paired_delta"),
    )


def frozen_family(summary: DataFrame, families: list[str]) -> DataFrame:
    """The family with the largest mean IC, ties by the configured order."""
    order = reduce(lambda c, x: c.when(F.col("model") == x[1], x[0]), enumerate(families), F.when(F.lit(False), 0))
    return summary.where(F.col("model").isin(families) & F.col("mean_rank_ic").isNotNull()).orderBy(F.desc("mean_rank_ic"), order).limit(1)


def walk_forward_report(rows: DataFrame, features: list[str], target: str, least: int, quantiles: int) -> DataFrame:
    """Per fold and feature: mean training and test IC, the direction-adjusted test IC and the test spread."""
    from .signals import rank_ic

    # Roles and features as numbers: each row is shuffled and sorted for every fold and feature.
    part = F.when(F.col("role") == "training", 0).when(F.col("role") == "test", 1).alias("part")
    long = numbered(rows.where("role != 'purged'"), ["fold", part, "as_of_date", target], features)
    ic = rank_ic(long, ["fold", "part", "_f", "as_of_date"], "value", target, least)
    mean = lambda n: F.avg(F.when(F.col("part") == n, F.col("rank_ic")))
    out = ic.groupBy("fold", "_f").agg(mean(0).alias("train_ic"), mean(1).alias("test_ic"))
    out = out.withColumn("adjusted_ic", F.signum("train_ic") * F.col("test_ic"))
    spread = spread_masses(long.where("part = 1"), ["fold", "_f", "as_of_date"], "value", target, quantiles).where(F.col("pairs") >= quantiles)
    out = out.join(spread.groupBy("fold", "_f").agg(F.avg("spread").alias("mean_spread")), ["fold", "_f"], "left")
    return out.select("fold", name_of(features), "train_ic", "test_ic", "adjusted_ic", "mean_spread")


def walk_forward_rollup(report: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Per feature over the folds of ``walk_forward_report``: selection, mean and median test IC, and how often the direction held.

    ``selected`` (fold, feature, selected) tells which features each fold's training rows selected.
    """
    rows = report if selected is None else report.join(selected, ["fold", "feature"], "left")
    chosen = F.lit(None).cast("boolean") if selected is None else F.coalesce("selected", F.lit(False))
    ic, adjusted = F.col("test_ic"), F.when(F.col("train_ic") != 0, F.col("adjusted_ic"))
    share = lambda c: F.avg((c > 0).cast("double"))
    return rows.groupBy("feature").agg(
        F.count("*").alias("fold_count"), F.sum(chosen.cast("long")).alias("selection_count"), F.avg(chosen.cast("double")).alias("selection_rate"),
        F.count(ic).alias("test_fold_count"), F.avg(ic).alias("mean_test_ic"), F.median(ic).alias("median_test_ic"), share(ic).alias("positive_fold_rate"),
        F.avg(adjusted).alias("mean_directional_ic"), share(adjusted).alias("direction_consistency_rate"), F.avg("mean_spread").alias("mean_test_spread"),
    )


def acceptance(facts: dict, limits: dict) -> list[dict]:
    """The thirteen checks of a final evaluation; a null fails."""
    above = lambda k, x: facts.get(k) is not None and facts[k] > x
    least = lambda k, x: facts.get(k) is not None and facts[k] >= x
    checks = {
        "development_mean_ic": above("development_mean_ic", 0), "development_median_ic": above("development_median_ic", 0),
        "locked_mean_ic": above("locked_mean_ic", 0), "locked_median_ic": above("locked_median_ic", 0), "locked_mean_spread": above("locked_mean_spread", 0),
        "locked_paired_gain": above("locked_paired_gain", limits["minimum_gain"]), "development_win_rate": least("development_win_rate", limits["win_rate"]),
        "coverage_ratio": least("coverage_ratio", limits["coverage_ratio"]), "locked_score_coverage": least("locked_score_coverage", limits["score_coverage"]),
        "paired_dates": least("paired_dates", limits["ic_dates"]), "spread_dates": least("spread_dates", limits["spread_dates"]),
        "spread_coverage": least("spread_coverage", limits["spread_coverage"]),
        "paired_hac_p": facts.get("paired_hac_p") is not None and facts["paired_hac_p"] <= limits["p_value"],
    }
    return [{"check": k, "passed": bool(v)} for k, v in checks.items()]
