"""Contracts between runs: fold assignments, the evidence that scores carry, and which outcomes they may hold.

Every check counts its violations in Spark; tables of any size are judged
without leaving it, and only the counts reach the driver.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contracts import ContractError
from ..functions.numeric import clean_double, on_each, proven_few
from ..registry import IDENTITY
from .splits import MOST_FOLDS

# Roles, reasons and columns of the assignment table.
ROLES = ("training", "evaluation", "excluded")
BOUNDS = ("train_end_date", "train_label_end_max", "evaluation_start", "evaluation_end")
ASSIGNMENT = ("phase", "fold", "split_id", "row_id", "role", "exclusion_reason", *BOUNDS)
#: Excluded rows that are scored all the same, as their reason concerns outcomes alone.
SCORED = ("missing_label", "missing_target", "locked_test_overlap")


def assignment_table(assigned: DataFrame, row_id: Column, phase: str = "development") -> DataFrame:
    """Rows of ``fold_assignments`` with their fold's bounds, one a fold and row.

    A fold holds a share of all rows, so its bounds are summed up first and
    meet the rows as a table of one row a fold; no task gathers a fold.
    """
    last = lambda c: F.max(F.when(F.col("role") == "training", F.col(c)))
    ends = assigned.groupBy("fold").agg(last("as_of_date").alias("train_end_date"), last("label_end_date").alias("train_label_end_max"))
    return assigned.join(proven_few(ends, MOST_FOLDS), "fold", "left").select(
        F.lit(phase).alias("phase"), "fold", F.concat(F.lit(f"{phase}_fold_"), (F.col("fold") - 1).cast("string")).alias("split_id"), row_id.alias("row_id"), "role", "exclusion_reason",
        "train_end_date", "train_label_end_max", "evaluation_start", "evaluation_end",
    )


def _untidy(c: str) -> Column:
    return F.coalesce((F.trim(c) != F.col(c)) | (F.col(c) == ""), F.lit(True))


def _named(counts: DataFrame) -> DataFrame:
    """One row of counts as rows (check, violations)."""
    pairs = [F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations")) for c in counts.columns]
    return counts.select(F.inline(F.array(*pairs)))


def assignment_violations(table: DataFrame, schedule: DataFrame, *, folds: int, fold_dates: int, start: date, lock_start: date, phase: str = "development") -> DataFrame:
    """(check, violations) of an assignment table against the schedule (as_of_date) and the configured split."""
    excluded = F.col("role") == "excluded"
    bound_sets = F.struct(*BOUNDS)
    rows = table.agg(
        F.count_if(F.coalesce(F.col("phase") != phase, F.lit(True))).alias("wrong_phase"),
        F.count_if(F.coalesce(F.col("fold") < 1, F.lit(True))).alias("bad_fold"),
        F.count_if(_untidy("split_id") | _untidy("row_id") | _untidy("role")).alias("untidy_text"),
        F.count_if(F.coalesce(~F.col("role").isin(*ROLES), F.lit(True))).alias("unknown_role"),
        F.count_if(F.coalesce(excluded, F.lit(False)) != F.col("exclusion_reason").isNotNull()).alias("reason_without_exclusion"),
        F.count_if(F.coalesce(F.col("split_id") != F.concat(F.lit(f"{phase}_fold_"), (F.col("fold") - 1).cast("string")), F.lit(True))).alias("wrong_split_id"),
    )
    keys = table.groupBy("row_id").agg(F.count("*").alias("n"), F.countDistinct("fold").alias("k"))
    keys = keys.agg(F.sum(F.col("n") - F.col("k")).alias("duplicate_rows"), F.count_if(F.col("k") != folds).alias("incomplete_rows"))
    few = table.groupBy("fold").agg(F.countDistinct(bound_sets).alias("kinds"), *[F.min(c).alias(c) for c in BOUNDS])
    due = schedule.select(F.col("as_of_date").alias("due")).distinct()
    held = few.join(due, F.col("due").between(F.col("evaluation_start"), F.col("evaluation_end")), "left").groupBy(*few.columns).agg(
        F.count("due").alias("dates"), F.coalesce(F.bool_or(F.col("due") == F.col("evaluation_start")), F.lit(False)).alias("has_start"), F.coalesce(F.bool_or(F.col("due") == F.col("evaluation_end")), F.lit(False)).alias("has_end")
    )
    a, b, c, d = (F.col(x) for x in BOUNDS)
    ordered = (F.lit(start) <= a) & (a < b) & (b < c) & (c <= d) & (d < F.lit(lock_start))
    held = held.withColumn("before", F.lag("evaluation_end").over(Window.orderBy("fold")))  # one row a fold
    bounds = held.agg(
        (F.count_if(F.col("fold").between(1, folds)) - folds + 2 * F.count_if(~F.col("fold").between(1, folds))).alias("fold_numbers"),
        F.count_if(F.col("kinds") != 1).alias("varying_bounds"), F.count_if(F.coalesce(~ordered, F.lit(True))).alias("disordered_bounds"),
        F.count_if(F.col("evaluation_start") <= F.col("before")).alias("overlapping_folds"), F.count_if(~F.col("has_start") | ~F.col("has_end")).alias("bounds_off_schedule"),
        F.count_if(F.col("dates") != fold_dates).alias("wrong_date_count"), F.min("evaluation_start").alias("first"), F.max("evaluation_end").alias("last"),
    ).withColumn("fold_numbers", F.abs("fold_numbers"))
    span = due.agg(F.min("due").alias("due_first"), F.max("due").alias("due_last"))
    both = on_each(bounds, span, 1).withColumn("schedule_span", F.when((F.col("first") == F.col("due_first")) & (F.col("last") == F.col("due_last")), 0).otherwise(1))
    return _named(on_each(on_each(rows, keys, 1), both.drop("first", "last", "due_first", "due_last"), 1))


def assignment_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """fold, row_id and what differs, of two assignment tables: a row that one lacks, or the columns that disagree (nulls agree)."""
    rest = [c for c in ASSIGNMENT if c not in ("fold", "row_id")]
    pack = lambda df, name: df.select("fold", "row_id", F.struct(*rest).alias(name))
    both = pack(left, "l").join(pack(right, "r"), ["fold", "row_id"], "full")
    names = F.filter(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in rest]), lambda x: x.isNotNull())
    what = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").otherwise(F.array_join(names, ","))
    return both.select("fold", "row_id", what.alias("difference")).where("difference <> ''")


def evidence_violations(predictions: DataFrame, table: DataFrame, schedule: DataFrame) -> DataFrame:
    """(check, violations) of one model's scores against assignments: fold bounds, scheduled dates and row ids."""
    bounds = table.groupBy("fold").agg(*[F.min(c).alias(f"b_{c}") for c in BOUNDS])
    met = predictions.join(proven_few(bounds, MOST_FOLDS), "fold", "left")
    pairs = (("fit_end_date", "train_end_date"), ("train_label_end_max", "train_label_end_max"), ("evaluation_start", "evaluation_start"))
    rows = met.agg(*[F.count_if(~F.col(mine).eqNullSafe(F.col(f"b_{theirs}"))).alias(f"{mine}_differs") for mine, theirs in pairs])
    ids = predictions.select("fold", "row_id", F.lit(True).alias("scored")).join(table.select("fold", "row_id", "role", "exclusion_reason"), ["fold", "row_id"], "full")
    allowed = (F.col("role") == "evaluation") | ((F.col("role") == "excluded") & F.col("exclusion_reason").isin(*SCORED))
    ids = ids.agg(F.count_if(F.col("scored") & ~F.coalesce(allowed, F.lit(False))).alias("scored_not_allowed"), F.count_if((F.col("role") == "evaluation") & F.col("scored").isNull()).alias("evaluation_not_scored"))
    due = on_each(schedule.select("as_of_date").distinct(), bounds, 1000).where(F.col("as_of_date").between(F.col("b_evaluation_start"), F.col("b_evaluation_end"))).select("fold", "as_of_date", F.lit(True).alias("due"))
    dates = predictions.select("fold", "as_of_date", F.lit(True).alias("seen")).distinct().join(due, ["fold", "as_of_date"], "full")
    dates = dates.agg(F.count_if(F.col("due").isNull()).alias("dates_off_schedule"), F.count_if(F.col("seen").isNull()).alias("dates_missing"))
    keys = predictions.groupBy("fold", "as_of_date", "symbol").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_keys"))
    return _named(on_each(on_each(on_each(rows, ids, 1), dates, 1), keys, 1))


def feature_violations(predictions: DataFrame, features: list[str], candidates: list[str] | None = None) -> DataFrame:
    """(check, violations) of the metadata of one model's scores: counts, selected features (JSON) and the candidate.

    ``candidates`` are the ids of the model's grid; a baseline has none, and then no id either.
    """
    chosen = F.from_json("selected_features", "array<string>")
    rows = predictions.withColumn("_chosen", chosen)
    known = F.array(*map(F.lit, features))
    wrong = (F.size("_chosen") != F.col("selected_feature_count")) | (F.size(F.array_distinct("_chosen")) != F.size("_chosen")) | (F.size(F.array_except("_chosen", known)) > 0) | (F.size("_chosen") < 1)
    candidate = F.col("candidate_id").isNotNull() if candidates is None else F.coalesce(~F.col("candidate_id").isin(candidates), F.lit(True))
    counts = rows.agg(
        F.count_if(F.coalesce((F.col("feature_count") < 0) | (F.col("selected_feature_count") < 1) | (F.col("feature_count") > F.col("selected_feature_count")), F.lit(True))).alias("bad_counts"),
        F.count_if(F.coalesce(F.col("zero_observed_features") != (F.col("feature_count") == 0), F.lit(True))).alias("zero_flag_differs"),
        F.count_if(F.coalesce(F.col("zero_observed_features") & clean_double("score").isNotNull(), F.lit(False))).alias("scored_without_features"),
        F.count_if(F.coalesce(wrong, F.lit(True))).alias("bad_selected_features"), F.count_if(candidate).alias("bad_candidate"),
    )
    kinds = rows.groupBy("fold").agg(F.countDistinct(F.coalesce(F.array_join(F.array_sort("_chosen"), ","), F.lit(""))).alias("f"), F.countDistinct(F.coalesce("candidate_id", F.lit(""))).alias("c"))
    kinds = kinds.agg(F.count_if(F.col("f") != 1).alias("features_vary_in_fold"), F.count_if(F.col("c") != 1).alias("candidate_varies_in_fold"))
    return _named(on_each(counts, kinds, 1))


def outcome_violations(predictions: DataFrame, table: DataFrame) -> DataFrame:
    """(check, violations): outcomes that a row's assignment doesn't authorise, or that it owes. Nothing is repaired."""
    met = predictions.join(table.select("fold", "row_id", "role", "exclusion_reason"), ["fold", "row_id"], "left")
    target, returns = F.col("target").isNotNull(), F.col("realized_return").isNotNull()
    reason = F.col("exclusion_reason")
    return _named(met.agg(
        F.count_if((F.col("role") == "evaluation") & ~target).alias("evaluation_without_target"), F.count_if((reason == "missing_target") & target).alias("target_that_is_missing"),
        F.count_if(reason.isin("missing_label", "locked_test_overlap") & (target | returns)).alias("unauthorised_outcome"),
    ))


def enforce(violations: DataFrame, what: str) -> None:
    """Raise on any violation, with all of them."""
    if found := [f"{r['check']}: {r['violations']}" for r in violations.where("violations > 0").orderBy("check").collect()]:
        raise ContractError(f"{what}: {', '.join(found)}")


# Flags that a development run can't have set.
FINAL_FLAGS = ("model_gate_passed", "final_outcomes_evaluated", "lockbox_evaluated")


def check_scope(manifest: dict, acceptance: list | None = None) -> None:
    """A development run: no final phase, no acceptance, no flag of one."""
    if manifest.get("phase", "development") != "development" or acceptance:
        raise ContractError("only development runs are compared")
    if flags := [f for f in FINAL_FLAGS if manifest.get(f, False) is not False]:
        raise ContractError(f"a development run can't have {', '.join(flags)}")


def check_identity(*manifests: dict) -> dict:
    """The identity that all runs share: complete, tidy, with digests and ordered bounds."""
    for m in manifests:
        if missing := [k for k in IDENTITY if not m.get(k)]:
            raise ContractError(f"identity lacks {', '.join(missing)}")
        for k in IDENTITY:
            values = m[k] if isinstance(m[k], (list, tuple)) else [m[k]]
            if any(not isinstance(v, str) or not v or v != v.strip() for v in values):
                raise ContractError(f"{k} must be tidy text")
        if bad := [k for k in IDENTITY if k.endswith("sha256") and (len(m[k]) != 64 or set(m[k]) - set("0123456789abcdef"))]:
            raise ContractError(f"{', '.join(bad)} must be lower-case SHA-256")
        days = [date.fromisoformat(m[k]) for k in ("development_start", "development_end", "locked_start", "locked_end")]
        if not days[0] < days[1] < days[2] <= days[3]:
            raise ContractError("bounds of a run must be ordered")
    first = {k: manifests[0][k] for k in IDENTITY}
    if differing := sorted({k for m in manifests[1:] for k in IDENTITY if m[k] != first[k]}):
        raise ContractError(f"runs differ in {', '.join(differing)}")
    return first
