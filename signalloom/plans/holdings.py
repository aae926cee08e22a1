"""One account valued from a development run's saved scores, behind gates that read no outcome."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..operators import comparison as CP
from ..operators import grid as G
from ..operators import portfolio as PF

#: What of a prediction a ledger may read: nothing that is known only later.
SCORES = (
    "phase", "fold", "as_of_date", "symbol", "row_id", "model", "score", "fit_end_date", "train_label_end_max", "evaluation_start",
    "feature_count", "selected_feature_count", "zero_observed_features",
)


@dataclass(frozen=True)
class HoldingsConfig:
    """Decisions after the close of their dates, and sessions from ``start`` to the liquidation at ``end``."""

    decisions: tuple[date, ...]
    start: date
    end: date
    benchmark: str
    account: PF.LongOnlyConfig = PF.LongOnlyConfig()

    def __post_init__(self):
        if not self.decisions or any(a >= b for a, b in zip(self.decisions, self.decisions[1:], strict=False)):
            raise ValueError("decisions must be increasing and not empty")
        if not self.start < self.end or not self.start <= self.decisions[0] or not self.benchmark.strip():
            raise ValueError("sessions must begin before they end, by the first decision, with a benchmark")


def score_projection(predictions: DataFrame, model: str) -> DataFrame:
    """The rows of a model without outcomes; columns and keys are checked."""
    C.require_columns(predictions, SCORES, "predictions")
    rows = predictions.where(F.col("model") == model).select(*SCORES)
    single = model == "best_metric" or model.startswith("metric:")
    zero = F.col("feature_count") == 0
    checks = {
        "not development": F.coalesce(F.col("phase") != "development", F.lit(True)),
        "symbol not canonical": F.coalesce(F.upper(F.trim("symbol")) != F.col("symbol"), F.lit(True)) | (F.col("symbol") == ""),
        "fold below 1": F.coalesce(F.col("fold") < 1, F.lit(True)), "row_id missing": F.coalesce(F.trim("row_id"), F.lit("")) == "",
        "feature counts": F.coalesce((F.col("feature_count") < 0) | (F.col("selected_feature_count") < 1) | (F.col("feature_count") > F.col("selected_feature_count")), F.lit(True)),
        "zero flag": F.coalesce(F.col("zero_observed_features") != zero, F.lit(True)),
        "score without features": F.coalesce(F.col("zero_observed_features") & F.col("score").isNotNull(), F.lit(False)),
        "score not finite": F.col("score").isNotNull() & C.strict_numeric(rows, "score")[1],
    }
    if single:
        checks["more than one feature"] = F.col("selected_feature_count") != 1
    counts = rows.agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("as_of_date", "symbol")).alias("repeated"), (F.count("*") - F.countDistinct("row_id")).alias("repeated_ids"), *[F.count_if(c).alias(k) for k, c in checks.items()]).first().asDict()
    varying = rows.groupBy("fold").agg(F.countDistinct("selected_feature_count").alias("n")).where("n <> 1").count()
    if not counts.pop("rows"):
        raise C.ContractError(f"no predictions of {model}")
    if bad := {k: n for k, n in {**counts, "selection varies in a fold": varying}.items() if n}:
        raise C.ContractError(f"predictions of {model}: {bad}")
    return rows


def window_prices(prices: DataFrame, cal: DataFrame, config: HoldingsConfig) -> DataFrame:
    """symbol, session, price within the valuation window; only dates are looked at beyond it.

    Every date must be a session, and the benchmark must have a price on each.
    """
    C.require_columns(prices, ["date", "symbol", "adjusted_close"], "prices")
    day, _ = C.daily_date(prices, "date")
    inside = prices.where(day.between(F.lit(config.start), F.lit(config.end)))
    rows = C.validate_prices(inside).select("symbol", F.col("date").alias("session"), F.col("adjusted_close").alias("price"))
    due = cal.where(F.col("session").between(F.lit(config.start), F.lit(config.end))).select("session")
    if n := G.off_calendar(rows, due).count():
        raise C.ContractError(f"{n} prices on days that are no sessions")
    held = rows.where(F.col("symbol") == config.benchmark.strip().upper()).select("session")
    if n := due.join(held, "session", "left_anti").count():
        raise C.ContractError(f"the benchmark lacks {n} sessions")
    return rows


def executions(cal: DataFrame, config: HoldingsConfig, lock_start: date) -> DataFrame:
    """as_of_date and execution_date of every decision; all must be sessions of the window, and trade before its end."""
    spark = cal.sparkSession
    ends = cal.where(F.col("session").isin(config.start, config.end)).count()
    if ends != 2 or config.end >= lock_start:
        raise C.ContractError("the window must begin and end on sessions before the final scope")
    dates = spark.createDataFrame([(d,) for d in config.decisions], "as_of_date date")
    found = G.session_offset(cal, dates, config.account.entry_lag_sessions).select("as_of_date", "execution_date")
    if found.where(F.col("execution_date") < F.lit(config.end)).count() != len(config.decisions):
        raise C.ContractError("decisions must be sessions and trade before the liquidation")
    return found


def evaluate_long_only(
    predictions: DataFrame, assignments: DataFrame, schedule: DataFrame, prices: DataFrame, sessions: DataFrame, *, model: str, models: list[str], config: HoldingsConfig,
    manifest: dict, folds: int, fold_dates: int,
) -> dict:
    """Value one account from the scores of a development run.

    ``models`` are those that the run was configured with. Returns the tables
    days, trades, rejections, positions, targets, coverage and summary, and the
    identity of what went in. Nothing is fitted and no outcome is read.
    """
    if model not in models:
        raise C.ContractError(f"{model} isn't a model of the run")
    CP.check_scope(manifest)
    identity = CP.check_identity(manifest)
    lock = date.fromisoformat(identity["locked_start"])
    scores = score_projection(predictions, model).persist()
    CP.enforce(CP.assignment_violations(assignments, schedule, folds=folds, fold_dates=fold_dates, start=date.fromisoformat(identity["development_start"]), lock_start=lock), "assignments")
    CP.enforce(CP.evidence_violations(scores, assignments, schedule), "scores")
    cal = G.calendar(sessions)
    plan = executions(cal, config, lock)
    marks = window_prices(prices, cal, config)
    chosen = scores.join(plan, "as_of_date")
    if (n := chosen.select("as_of_date").distinct().count()) != len(config.decisions):
        raise C.ContractError(f"{len(config.decisions) - n} decisions have no scores")
    k = config.account.top_k
    targets = PF.top_k_weights(chosen, k, ["as_of_date", "execution_date", "fold"])
    coverage = chosen.groupBy("as_of_date", "execution_date").agg(F.count("*").alias("scoring_universe_count"), F.count("score").alias("scored_count"), (F.count("score") / F.count("*")).alias("score_coverage"))
    taken = targets.groupBy("as_of_date").agg(F.count("*").alias("selected_count"), F.sum("weight").alias("w"))
    coverage = coverage.join(taken, "as_of_date", "left").select(*coverage.columns, F.coalesce("selected_count", F.lit(0)).alias("selected_count"), (1 - F.coalesce("w", F.lit(0.0))).alias("planned_cash_weight"))
    account = F.lit(model).alias("account")
    frames = PF.ledger_input(targets.select(account, "as_of_date", "symbol", "weight"), marks, cal, config.end, config.account, decisions=plan.select(account, "as_of_date"), start=config.start)
    made = PF.journal(frames, config.account).persist()
    names = {"days": "day", "trades": "trade", "rejections": "rejection", "positions": "position"}
    out = {name: PF.of_kind(made, kind) for name, kind in names.items()}
    summary = PF.ledger_summary(out["days"], config.account.initial_cash)
    evidence = identity | {"model": model, "scores_sha256": C.fingerprint(chosen.select(*SCORES)), "prices_sha256": C.fingerprint(marks), "calendar_sha256": C.fingerprint(cal)}
    return out | {"targets": targets, "coverage": coverage, "summary": summary, "identity": evidence}
