"""Inference over daily series: Newey-West, Benjamini-Hochberg, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numeric import on_each, two_sided_p_sql

#: Dates of a schedule at most.
MOST_DATES = 1 << 20


def newey_west(df: DataFrame, keys: list[str], order: str, value: str, lags: int, more: tuple = ()) -> DataFrame:
    """Per key: n, mean, hac_t of contiguous non-null values in order, and ``more`` aggregates of the same pass.

    The long-run variance weighs autocovariances by Bartlett's kernel and divides
    by n; hac_t is NULL where a value is missing, n is below 2 or lags exceed
    n - 1, or the variance isn't positive.
    """
    of = Window.partitionBy(*keys)
    centred = df.withColumn("_d", F.col(value) - F.avg(value).over(of)).withColumn("_n", F.count("*").over(of))
    ordered = Window.partitionBy(*keys).orderBy(order)
    products = [F.sum(F.col("_d") * F.col("_d")).alias("_g0")]
    for k in range(1, lags + 1):
        centred = centred.withColumn(f"_l{k}", F.lag("_d", k).over(ordered))
        products.append(F.coalesce(F.sum(F.col("_d") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_g{k}"))
    sums = centred.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("n_values"), F.avg(value).alias("mean"), *products, *more)
    variance = F.col("_g0")
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.col(f"_g{k}")
    variance = variance / F.col("n") / F.col("n")
    supported = (F.col("n_values") == F.col("n")) & (F.col("n") >= 2) & (F.lit(lags) <= F.col("n") - 1)
    t = F.when(supported & (variance > 0), F.col("mean") / F.sqrt(F.when(variance > 0, variance)))
    kept = [c for c in sums.columns if not c.startswith("_g")]
    return sums.withColumn("hac_t", t).select(*kept, "hac_t", F.expr(two_sided_p_sql("hac_t")).alias("hac_p"))


def scheduled_inference(values: DataFrame, schedule: DataFrame, keys: list[str], order: str, value: str, lags: int) -> DataFrame:
    """``newey_west`` over a schedule: every key has a row for each scheduled date, missing or not.

    Adds a status: missing_scheduled_values, insufficient_observations,
    insufficient_lag_support, undefined_variance or ok, in this order.
    """
    dates = schedule.select(order).distinct()
    every = on_each(values.select(*keys).distinct(), dates, MOST_DATES).join(values.select(*keys, order, value), [*keys, order], "left")
    out = newey_west(every, keys, order, value, lags)
    status = (
        F.when(F.col("n_values") < F.col("n"), "missing_scheduled_values")
        .when(F.col("n") < 2, "insufficient_observations")
        .when(F.lit(lags) > F.col("n") - 1, "insufficient_lag_support")
        .when(F.col("hac_t").isNull(), "undefined_variance")
        .otherwise("ok")
    )
    ok = F.col("inference_status") == "ok"
    return out.withColumn("inference_status", status).withColumn("effective_lags", F.when(ok, F.lit(lags)))


def bh_q_values(df: DataFrame, p: str, *, keys: list[str] | None = None, name: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q-values; null p-values get none and don't count."""
    keys = keys or []
    some = F.col(p).isNotNull()
    within = Window.partitionBy(*keys, some)
    order = within.orderBy(p)
    # Equal p-values share the largest rank among them, as the running minimum makes them equal anyway.
    rank = F.row_number().over(order)
    scaled = F.col(p) * F.count("*").over(within) / rank
    running = F.min("_scaled").over(within.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_rank", rank).withColumn("_scaled", scaled).withColumn(name, F.when(some, F.least(running, F.lit(1.0)))).drop("_rank", "_scaled")
