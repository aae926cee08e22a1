"""Screening statistics of signals: quality, rank correlation, spreads, redundancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import average_rank, clean_double, dealt, name_of, numbered, pearson, unpivoted
from ..functions.statistics import bh_q_values, newey_west, scheduled_inference


def feature_quality(panel: DataFrame, features: list[str], date: str = "as_of_date") -> DataFrame:
    """Rows, coverage (overall, mean and least by date), distinct values and zero variance of each feature."""
    long = unpivoted(panel, [date], features)
    daily = long.groupBy("feature", date).agg(F.count("*").alias("rows"), F.count("value").alias("some"))
    coverage = daily.groupBy("feature").agg(
        F.sum("rows").alias("row_count"), F.sum("some").alias("nonnull_count"), (F.sum("some") / F.sum("rows")).alias("coverage"),
        F.avg(F.col("some") / F.col("rows")).alias("mean_date_coverage"), F.min(F.col("some") / F.col("rows")).alias("min_date_coverage"),
    )
    kinds = long.groupBy("feature").agg(F.countDistinct("value").alias("distinct_count"))
    return coverage.join(kinds, "feature").withColumn("zero_variance", F.col("distinct_count") <= 1)


def rank_ic(long: DataFrame, keys: list[str], value: str, target: str, least: int) -> DataFrame:
    """Per key: complete pairs and their Spearman correlation; skipped below ``least`` pairs or where a side is constant."""
    pairs = long.select(*keys, clean_double(value).alias("_x"), clean_double(target).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    ranked = dealt(pairs, *keys).withColumn("_rx", average_rank("_x", *keys)).withColumn("_ry", average_rank("_y", *keys))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("pairs"), pearson("_rx", "_ry").alias("rank_ic"))
    return out.where((F.col("pairs") >= least) & F.col("rank_ic").isNotNull())


def daily_rank_ic(panel: DataFrame, features: list[str], target: str, least: int, date: str = "as_of_date") -> DataFrame:
    ranked = rank_ic(numbered(panel, [date, target], features), ["_f", date], "value", target, least)
    return ranked.select(name_of(features), date, "pairs", "rank_ic")


def spread_masses(scored: DataFrame, keys: list[str], score: str, outcome: str, quantiles: int) -> DataFrame:
    """Per key: pairs, distinct scores and the top-minus-bottom mean outcome.

    Equal scores share a boundary fractionally: each group of equal scores takes
    part in a bucket by the mass that reaches into it.
    """
    pairs = scored.select(*keys, clean_double(score).alias("_s"), clean_double(outcome).alias("_o")).where("_s IS NOT NULL AND _o IS NOT NULL")
    groups = pairs.groupBy(*keys, "_s").agg(F.avg("_o").alias("m"), F.count("*").alias("c"))
    of = Window.partitionBy(*keys)
    end = F.sum("c").over(of.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
    placed = groups.withColumn("end", end).withColumn("start", F.col("end") - F.col("c")).withColumn("n", F.sum("c").over(of))
    placed = placed.withColumn("k", F.expr(f"greatest(1L, n div {quantiles})"))
    bottom = F.least(F.greatest(F.col("k") - F.col("start"), F.lit(0)), F.col("c"))
    top = F.least(F.greatest(F.col("end") - (F.col("n") - F.col("k")), F.lit(0)), F.col("c"))
    return placed.groupBy(*keys).agg(F.max("n").alias("pairs"), F.count("*").alias("scores"), (F.sum((top - bottom) * F.col("m")) / F.max("k")).alias("spread"))


def quantile_spreads(panel: DataFrame, features: list[str], outcome: str, quantiles: int, least: int, date: str = "as_of_date") -> DataFrame:
    out = spread_masses(unpivoted(panel, [date, outcome], features), ["feature", date], "value", outcome, quantiles)
    return out.where(F.col("pairs") >= max(quantiles, least)).select("feature", date, "pairs", "spread")


def ic_summary(daily: DataFrame, lags: int, schedule: DataFrame | None = None, date: str = "as_of_date") -> DataFrame:
    """Mean, deviation, share above zero and inference over the schedule (else over the dates that there are) with q-values."""
    stats = daily.groupBy("feature").agg(
        F.avg("rank_ic").alias("mean_rank_ic"), F.stddev_samp("rank_ic").alias("std_rank_ic"),
        F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_rate"), F.count("*").alias("date_count"),
    )
    if schedule is None:
        inference = newey_west(daily, ["feature"], date, "rank_ic", lags).select("feature", F.lit(None).cast("long").alias("scheduled_count"), "hac_t", "hac_p")
        inference = inference.withColumn("inference_status", F.lit("schedule_unavailable")).withColumn("effective_lags", F.lit(None).cast("int"))
    else:
        inference = scheduled_inference(daily, schedule, ["feature"], date, "rank_ic", lags).select("feature", F.col("n").alias("scheduled_count"), "hac_t", "hac_p", "inference_status", "effective_lags")
    return bh_q_values(stats.join(inference, "feature"), "hac_p")


def redundancy(panel: DataFrame, features: list[str], least: int, date: str = "as_of_date", symbol: str = "symbol") -> DataFrame:
    """Per pair of features: Fisher-z mean and mean absolute daily Spearman over pair-complete rows.

    Pairs of features of a row are exploded from the row itself, which takes no
    join; ranks are taken anew on each pair's complete rows. These rows are
    sorted twice, so they carry a pair's number, not its names.
    """
    ordered = list(features)
    names = [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :]]
    pairs = [F.struct(F.lit(n).alias("pair"), clean_double(a).alias("x"), clean_double(b).alias("y")) for n, (a, b) in enumerate(names)]
    if not pairs:
        return panel.sparkSession.createDataFrame([], "left string, right string, mean_spearman double, mean_abs_spearman double, date_count long")
    long = panel.select(date, F.explode(F.array(*pairs)).alias("p")).select(date, "p.*").where("x IS NOT NULL AND y IS NOT NULL")
    keys = ["pair", date]
    ranked = dealt(long, *keys).withColumn("rx", average_rank("x", *keys)).withColumn("ry", average_rank("y", *keys))
    daily = ranked.groupBy(*keys).agg(F.count("*").alias("n"), pearson("rx", "ry").alias("rho")).where((F.col("n") >= least) & F.col("rho").isNotNull())
    limit = 1 - 1e-12
    z = F.atanh(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("rho"))))
    out = daily.groupBy("pair").agg(F.tanh(F.avg(z)).alias("mean_spearman"), F.avg(F.abs("rho")).alias("mean_abs_spearman"), F.count("*").alias("date_count"))
    name = lambda side: F.get(F.array(*[F.lit(n[side]) for n in names]), F.col("pair"))
    return out.select(name(0).alias("left"), name(1).alias("right"), "mean_spearman", "mean_abs_spearman", "date_count")


def select_features(summary: list[dict], quality: list[dict], pairs: list[dict], *, least_coverage: float, least_ic: float, threshold: float) -> list[dict]:
    """Greedy selection on the driver: by absolute mean IC, then coverage, then name; each with a reason if dropped."""
    ic = {r["feature"]: r["mean_rank_ic"] for r in summary}
    rho = {frozenset((r["left"], r["right"])): r["mean_abs_spearman"] for r in pairs}
    by_order = sorted(quality, key=lambda r: (-abs(ic[r["feature"]]) if ic.get(r["feature"]) is not None else 1.0, -r["coverage"], r["feature"]))
    kept: list[str] = []
    out = []
    for r in by_order:
        f = r["feature"]
        mean = ic.get(f)
        twin = next((k for k in kept if (rho.get(frozenset((f, k))) or 0.0) >= threshold), None)
        reason = (
            "zero_variance" if r["zero_variance"]
            else "low_coverage" if r["coverage"] < least_coverage
            else "insufficient_rank_ic" if mean is None or abs(mean) < least_ic
            else f"redundant_with:{twin}" if twin else None
        )
        if reason is None:
            kept.append(f)
        out.append({"feature": f, "selected": reason is None, "reason": reason})
    return out


def metric_screen(panel: DataFrame, features: list[str], target: str, train_end, *, least: int, lags: int, least_coverage: float = 0.8, least_ic: float = 0.0, threshold: float = 0.9, date: str = "as_of_date") -> dict:
    """Tables and the selection over rows up to ``train_end``; only a few rows a feature reach the driver."""
    rows = panel.where(F.col(date) <= F.lit(train_end))
    quality = feature_quality(rows, features, date)
    daily = daily_rank_ic(rows, features, target, least, date)
    summary = ic_summary(daily, lags, rows.select(date).distinct(), date)
    pairs = redundancy(rows, features, least, date)
    lists = [[r.asDict() for r in t.collect()] for t in (summary, quality, pairs)]
    selection = select_features(*lists, least_coverage=least_coverage, least_ic=least_ic, threshold=threshold)
    return {"quality": quality, "daily_ic": daily, "ic_summary": summary, "redundancy": pairs, "selection": selection, "selected": [r["feature"] for r in selection if r["selected"]]}
