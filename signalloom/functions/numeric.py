"""Column functions with the engine's null rules: missing is NULL, NaN is never stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def clean_double(c: Column | str) -> Column:
    """A double, with NaN and infinities as NULL."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d where d is positive and finite."""
    return F.when((d > 0) & (d < F.lit(float("inf"))), n / d)


def pct_rank(value: str, *keys: str) -> Column:
    """Percentile rank with average ties; nulls have no rank and don't count.

    Nulls come last, so ranks of several values share the keys' partitions and each takes one sort.
    """
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(value))
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.when(F.col(value).isNotNull(), _average_rank(order) / F.count(value).over(every))


def average_rank(value: str, *keys: str) -> Column:
    """Rank with average ties among rows of the keys; the value is never null."""
    return _average_rank(Window.partitionBy(*keys).orderBy(value))


def _average_rank(order: WindowSpec) -> Column:
    """From the first to the last place of a row's peers, in the one order."""
    first, last = F.rank().over(order), F.count("*").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return first + (last - first) / F.lit(2.0)


def dealt(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` by the keys, in as many partitions as are configured: what sorts several times in a task is not put into fewer ones."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pearson(x: str, y: str) -> Column:
    """Aggregate: correlation of complete pairs, NULL where a side is constant."""
    spread = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(spread, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def unpivoted(panel: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    """Long form: the kept columns, feature and value."""
    return panel.select(*keep, *[clean_double(f).alias(f) for f in features]).unpivot(keep, features, "feature", "value")


def numbered(panel: DataFrame, keep: list[str | Column], features: list[str]) -> DataFrame:
    """As ``unpivoted``, with a feature's place in the list as ``_f`` for its name: rows that are shuffled and sorted stay short."""
    cells = [F.struct(F.lit(i).alias("_f"), clean_double(f).alias("value")) for i, f in enumerate(features)]
    return panel.select(*keep, F.explode(F.array(*cells)).alias("_cell")).select("*", "_cell._f", "_cell.value").drop("_cell")


def name_of(features: list[str]) -> Column:
    """The name behind a number of ``numbered``."""
    return F.get(F.array(*map(F.lit, features)), F.col("_f")).alias("feature")


def on_each(df: DataFrame, few: DataFrame, most: int) -> DataFrame:
    """Every row of ``df`` beside every row of a table of at most ``most`` rows; more are an error.

    The few rows ride on each row as one array, and one row is all that is
    broadcast, its size proven before it is.
    """
    packed = few.limit(most + 1).agg(F.collect_list(F.struct(*few.columns)).alias("_few"))
    message = F.lit(f"more than {most} rows of {', '.join(few.columns)}")
    proven = packed.select(F.when(F.size("_few") <= most, F.col("_few")).otherwise(F.raise_error(message)).alias("_few"))
    return df.join(F.broadcast(proven)).select(*df.columns, F.explode("_few").alias("_one")).select(*df.columns, "_one.*")


def proven_few(few: DataFrame, most: int) -> DataFrame:
    """A table of at most ``most`` rows, its size proven, to be broadcast in a join; more are an error."""
    packed = few.limit(most + 1).agg(F.collect_list(F.struct(*few.columns)).alias("_few"))
    message = F.lit(f"more than {most} rows of {', '.join(few.columns)}")
    proven = packed.select(F.explode(F.when(F.size("_few") <= most, F.col("_few")).otherwise(F.raise_error(message))).alias("_one"))
    return F.broadcast(proven.select("_one.*"))


def look_up(df: DataFrame, few: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``df`` with the other columns of ``few``, a table of at most ``most`` rows with one a key; rows without one are dropped.

    The table rides on each row as one map, whose size is proven before it is
    broadcast, so keys that few values share shuffle nothing.
    """
    others = [c for c in few.columns if c not in keys]
    pairs = few.limit(most + 1).agg(F.collect_list(F.struct(F.struct(*keys).alias("k"), F.struct(*others).alias("v"))).alias("_few"))
    message = F.lit(f"more than {most} rows of {', '.join(few.columns)}")
    proven = pairs.select(F.when(F.size("_few") <= most, F.map_from_entries("_few")).otherwise(F.raise_error(message)).alias("_few"))
    found = df.join(F.broadcast(proven)).withColumn("_one", F.try_element_at("_few", F.struct(*[F.col(k).cast(few.schema[k].dataType).alias(k) for k in keys])))
    return found.where("_one IS NOT NULL").select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in others])


def erfc_sql(x: str) -> str:
    """SQL text of the complementary error function for x >= 0, by its Chebyshev fit (relative error 1.2e-7).

    Neither Spark nor DuckDB has one, so both sides share this text.
    """
    # Coefficients of the published fit.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = f"(1.0e0 / (1.0e0 + 0.5e0 * ({x})))"
    poly = f"{c[-1]}e0"
    for k in reversed(c[:-1]):
        poly = f"({k}e0 + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def two_sided_p_sql(t: str) -> str:
    """SQL text of the two-sided normal p-value of a statistic."""
    return f"least(1.0e0, greatest(0.0e0, {erfc_sql(f'abs({t}) / 1.4142135623730951e0')}))"
