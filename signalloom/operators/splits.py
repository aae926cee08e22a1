"""Time splits as tables: the fold is a column, rows meet folds in one join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import on_each, proven_few
from .grid import MOST_SESSIONS

#: Folds at most.
MOST_FOLDS = 1000


def date_index(panel: DataFrame, date: str = "as_of_date") -> DataFrame:
    """Distinct dates and their index from 0."""
    return panel.select(date).distinct().select(date, (F.row_number().over(Window.orderBy(date)) - 1).alias("i"))


def walk_forward(panel: DataFrame, *, folds: int, test_dates: int, least_train: int, date: str = "as_of_date") -> DataFrame:
    """fold, test_start, test_end of consecutive test blocks at the end of the dates."""
    dates = date_index(panel, date)
    total = F.count("*").over(Window.partitionBy())
    fold = F.expr(f"(i - (total - {folds * test_dates})) div {test_dates}")
    tests = dates.withColumn("total", total).where(F.col("i") >= F.col("total") - folds * test_dates).withColumn("fold", (fold + 1).cast("int"))
    blocks = tests.groupBy("fold").agg(F.min(date).alias("test_start"), F.max(date).alias("test_end"), F.min("i").alias("first"))
    return blocks.where(F.col("first") >= least_train).drop("first")


def walk_forward_rows(panel: DataFrame, blocks: DataFrame, date: str = "as_of_date") -> DataFrame:
    """Rows of each fold with a role: training rows end before the test begins (strictly), test rows are all rows of the block."""
    rows = on_each(panel, blocks, MOST_FOLDS).where(F.col(date) <= F.col("test_end"))
    test = F.col(date) >= F.col("test_start")
    training = (F.col(date) < F.col("test_start")) & (F.col("label_end_date") < F.col("test_start"))
    return rows.withColumn("role", F.when(test, "test").when(training, "training").otherwise("purged"))


def lockbox(panel: DataFrame, target: str, *, dates: int, least_rows: int, date: str = "as_of_date") -> DataFrame:
    """The last mature dates, reserved: as_of_date, labelled rows and whether there are enough."""
    daily = panel.groupBy(date).agg(F.count(F.when(F.col("label_end_date").isNotNull(), F.col(target))).alias("labelled"))
    mature = daily.withColumn("last", F.max(F.when(F.col("labelled") > 0, F.col(date))).over(Window.partitionBy())).where(F.col(date) <= F.col("last"))
    late = mature.withColumn("r", F.row_number().over(Window.orderBy(F.desc(date)))).where(F.col("r") <= dates)
    return late.select(date, "labelled", (F.col("labelled") >= least_rows).alias("enough"))


def outer_folds(panel: DataFrame, target: str, lock_start, *, folds: int, evaluation_dates: int, date: str = "as_of_date") -> DataFrame:
    """fold, evaluation_start, evaluation_end: blocks at the end of the dates that hold a safely labelled row before the lockbox."""
    locked = F.lit(lock_start).cast("date") if not isinstance(lock_start, F.Column) else lock_start
    safe = panel.where(F.col(target).isNotNull() & (F.col("label_end_date") < locked) & (F.col(date) < locked))
    dates = date_index(safe, date).withColumn("total", F.count("*").over(Window.partitionBy()))
    tail = dates.where(F.col("i") >= F.col("total") - folds * evaluation_dates)
    fold = F.expr(f"(i - (total - {folds * evaluation_dates})) div {evaluation_dates}") + 1
    return tail.withColumn("fold", fold.cast("int")).groupBy("fold").agg(F.min(date).alias("evaluation_start"), F.max(date).alias("evaluation_end"))


def fold_assignments(panel: DataFrame, blocks: DataFrame, lock_start, target: str, *, locked_dates: DataFrame | None = None, date: str = "as_of_date") -> DataFrame:
    """A row's role and reason in each fold, decided in this order.

    In the lockbox or later; a label that reaches into the lockbox; in the fold's
    evaluation dates; a date between them; before them (training, or why not);
    after them.
    """
    locked = F.lit(lock_start).cast("date")
    safe = panel.where(F.col(target).isNotNull() & (F.col("label_end_date") < locked) & (F.col(date) < locked)).select(F.col(date).alias("safe_date")).distinct()
    rows = on_each(panel, blocks, MOST_FOLDS).join(proven_few(safe, MOST_SESSIONS), F.col(date) == F.col("safe_date"), "left")
    start, end, label = F.col("evaluation_start"), F.col("evaluation_end"), F.col("label_end_date")
    lacking = F.when(label.isNull(), "missing_label").when(F.col(target).isNull(), "missing_target")
    reason = (
        F.when(F.col(date) >= locked, "locked_test")
        .when(label >= locked, "locked_test_overlap")
        .when(F.col(date).between(start, end) & F.col("safe_date").isNotNull(), lacking)
        .when(F.col(date).between(start, end), "gap_date")
        .when(F.col(date) < start, F.coalesce(lacking, F.when(label >= start, "label_overlap")))
        .otherwise("future_of_evaluation")
    )
    out = rows.withColumn("exclusion_reason", reason)
    role = F.when(F.col("exclusion_reason").isNotNull(), "excluded").when(F.col(date) >= start, "evaluation").otherwise("training")
    return out.withColumn("role", role).drop("safe_date")


def phase_schedule(panel: DataFrame, blocks: DataFrame, date: str = "as_of_date") -> DataFrame:
    """All panel dates from the first evaluation start to the last end, gaps between folds included."""
    span = blocks.agg(F.min("evaluation_start").alias("a"), F.max("evaluation_end").alias("b"))
    return on_each(panel.select(date).distinct(), span, 1).where(F.col(date).between(F.col("a"), F.col("b"))).select(date)


def training_weights(rows: DataFrame, keys: list[str], date: str = "as_of_date") -> DataFrame:
    """Weights that give each date the same total, with mean 1.

    Rows are counted by date first; windows see one row a date.
    """
    counts = rows.groupBy(*keys, date).agg(F.count("*").alias("_n"))
    every = Window.partitionBy(*keys)
    weights = counts.select(*keys, date, (F.sum("_n").over(every) / F.count("*").over(every) / F.col("_n")).alias("weight"))
    return rows.join(proven_few(weights, MOST_SESSIONS), [*keys, date])


def maturity_mask(panel: DataFrame, target: str, cutoff) -> DataFrame:
    """A screening copy without the targets that are known only after the cutoff."""
    return panel.withColumn(target, F.when(F.col("label_end_date") <= F.lit(cutoff), F.col(target)))


def training_cross_sections(assigned: DataFrame, target: str, date: str = "as_of_date") -> DataFrame:
    """All rows of dates with a training row; outcomes only on training rows."""
    some = assigned.where("role = 'training'").select("fold", date).distinct()
    training = F.col("role") == "training"
    out = assigned.join(proven_few(some, MOST_SESSIONS), ["fold", date], "left_semi")
    return out.withColumn(target, F.when(training, F.col(target))).withColumn("label_end_date", F.when(training, F.col("label_end_date")))


def evaluation_cross_sections(panel: DataFrame, blocks: DataFrame, target: str, label_before=None, date: str = "as_of_date") -> DataFrame:
    """All rows in each fold's date range; outcomes only where the label is known (and early enough)."""
    rows = on_each(panel, blocks, MOST_FOLDS).where(F.col(date).between(F.col("evaluation_start"), F.col("evaluation_end")))
    known = F.col("label_end_date").isNotNull()
    if label_before is not None:
        known = known & (F.col("label_end_date") < F.lit(label_before).cast("date"))
    return rows.withColumn(target, F.when(known, F.col(target)))
