"""Ledgers from saved scores: gates, trades, and contracts between runs."""

from __future__ import annotations

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from signalloom.functions.contracts import ContractError
from signalloom.operators import comparison as CP
from signalloom.operators import evaluation as E
from signalloom.operators import portfolio as PF
from signalloom.plans import holdings as H

START = date(2023, 3, 1)
STOCKS = ("AX", "BY", "CZ")


def day(i):
    return START + timedelta(days=i)


def manifest(**more):
    out = dict.fromkeys(("study", "hypothesis", "dataset_version", "universe_id", "target", "features"), "v") | dict.fromkeys(("panel_sha256", "config_sha256", "source_sha256"), "a" * 64)
    return out | {"development_start": day(0).isoformat(), "development_end": day(30).isoformat(), "locked_start": day(40).isoformat(), "locked_end": day(60).isoformat()} | more


@pytest.fixture
def world(spark):
    """Two folds of two decisions each (days 10, 12 and 14, 16), three stocks, labels two days later."""
    folds = {1: (10, 12), 2: (14, 16)}
    rows, scores = [], []
    for fold, (a, b) in folds.items():
        bounds = (day(a - 4), day(a - 2), day(a), day(b))
        for i in range(4, 18, 2):
            for k, s in enumerate(STOCKS):
                role, why = ("training", None) if i <= a - 4 else ("evaluation", None) if a <= i <= b else ("excluded", "label_overlap" if i < a else "future_of_evaluation")
                rows.append(("development", fold, f"development_fold_{fold - 1}", f"{i}{s}", role, why, *bounds))
                if role == "evaluation":
                    score = None if (i, s) == (12, "CZ") else float((k + i // 2) % 3)
                    for model in ("ridge", "metric:beta"):
                        scores.append(("development", fold, day(i), s, f"{i}{s}", model, score, *bounds[:2], bounds[2], 0 if score is None else 1, 1, score is None, 99.0, -99.0))
    kinds = "phase string, fold int, split_id string, row_id string, role string, exclusion_reason string, train_end_date date, train_label_end_max date, evaluation_start date, evaluation_end date"
    assigned = spark.createDataFrame(rows, kinds)
    predictions = spark.createDataFrame(scores, "phase string, fold int, as_of_date date, symbol string, row_id string, model string, score double, fit_end_date date, train_label_end_max date, evaluation_start date, feature_count int, selected_feature_count int, zero_observed_features boolean, target double, realized_return double")
    prices = [(day(i), s, 20.0 * (k + 1) * math.exp(0.05 * math.sin(i * (k + 1.3)))) for i in range(30) for k, s in enumerate((*STOCKS, "IDX"))]
    prices = spark.createDataFrame(prices, "date date, symbol string, adjusted_close double")
    schedule = spark.createDataFrame([(day(i),) for i in (10, 12, 14, 16)], "as_of_date date")
    sessions = prices.select(F.col("date").alias("session")).distinct()
    config = H.HoldingsConfig(tuple(day(i) for i in (10, 12, 14, 16)), day(9), day(20), "IDX", PF.LongOnlyConfig(top_k=1, initial_cash=500.0, buy_rate=0.002, sell_rate=0.001))
    return {"predictions": predictions, "assignments": assigned, "schedule": schedule, "prices": prices, "sessions": sessions, "config": config, "manifest": manifest()}


def run(world, **changes):
    return H.evaluate_long_only(**(world | changes), model="ridge", models=["ridge", "metric:beta"], folds=2, fold_dates=2)


def test_account_by_hand(world):
    out = run(world)
    price = {(r["date"], r["symbol"]): r["adjusted_close"] for r in world["prices"].collect()}
    held = {10: "AX", 12: "BY", 14: "CZ", 16: "BY"}  # the best score of each decision, traded a session later
    held[10] = max(STOCKS, key=lambda s: (STOCKS.index(s) + 5) % 3)
    held[12] = max(("AX", "BY"), key=lambda s: (STOCKS.index(s) + 6) % 3)
    held[14] = max(STOCKS, key=lambda s: (STOCKS.index(s) + 7) % 3)
    held[16] = max(STOCKS, key=lambda s: (STOCKS.index(s) + 8) % 3)
    nav, units, now, want = 500.0, 0.0, None, {}
    for i in range(9, 21):
        if now:
            nav = units * price[day(i), now]
        target = held.get(i - 1, now)
        if i == 20:
            nav, now = nav * (1 - 0.001), None
        elif target != now:
            nav = nav * (1 - 0.001) / (1 + 0.002) if now else nav / (1 + 0.002)
            now, units = target, nav / price[day(i), target]
        want[day(i)] = nav
    got = {r["session"]: r["nav"] for r in out["days"].collect()}
    assert set(got) == set(want) and all(math.isclose(got[d], want[d], rel_tol=1e-12) for d in want)
    trades = out["trades"].orderBy("session", "side").collect()
    assert [t["session"] for t in trades if t["reason"] == "terminal_liquidation"] == [day(20)] and all(math.isclose(t["units"] * t["price"], t["value"]) for t in trades)
    assert {(t["decision_date"], t["session"]) for t in trades if t["decision_date"]} <= {(day(i), day(i + 1)) for i in held}
    assert out["positions"].where("session = date'2023-03-21'").count() == 0 and out["positions"].count() == 9
    cover = {r["as_of_date"]: r for r in out["coverage"].collect()}
    assert cover[day(12)]["scored_count"] == 2 and cover[day(12)]["scoring_universe_count"] == 3 and cover[day(10)]["planned_cash_weight"] == 0
    assert out["summary"].first()["status"] == "ok" and set(out["identity"]) >= {"model", "scores_sha256"} and "target" not in out["targets"].columns


def test_outcomes_and_later_prices_change_nothing(world):
    base = run(world)
    changed = run(world, predictions=world["predictions"].withColumn("target", F.lit(None).cast("double")), prices=world["prices"].withColumn("adjusted_close", F.when(F.col("date") > F.lit(day(20)), -1.0).otherwise(F.col("adjusted_close"))))
    assert sorted(map(str, base["days"].collect())) == sorted(map(str, changed["days"].collect()))


def test_decisions_without_scores_turn_to_cash(world):
    none = world["predictions"].withColumn("score", F.when(F.col("as_of_date") != F.lit(day(14)), F.col("score"))).withColumn("feature_count", F.col("score").isNotNull().cast("int")).withColumn("zero_observed_features", F.col("score").isNull())
    out = run(world, predictions=none)
    days = {r["session"]: r for r in out["days"].collect()}
    assert days[day(15)]["reason"] == "scheduled_rebalance" and days[day(15)]["holdings"] == 0 and days[day(15)]["cash"] == days[day(15)]["nav"] and days[day(17)]["holdings"] == 1
    assert {r["as_of_date"]: r["planned_cash_weight"] for r in out["coverage"].collect()}[day(14)] == 1


def test_missing_prices_reject_and_block(world):
    without = lambda s, i: world["prices"].where(~((F.col("symbol") == s) & (F.col("date") == F.lit(day(i)))))
    first = run(world)["trades"].orderBy("session").first()
    out = run(world, prices=without(first["symbol"], 11))
    assert [(r["symbol"], r["session"], r["reason"]) for r in out["rejections"].collect()] == [(first["symbol"], day(11), "missing_execution_price")]
    assert out["positions"].where(F.col("session") == F.lit(day(11))).count() == 0
    blocked = run(world, prices=without(first["symbol"], 12))
    last = blocked["days"].orderBy(F.desc("session")).first()
    assert last["status"] == "blocked_missing_valuation" and last["session"] == day(12) and last["rejected"] == first["symbol"] and blocked["summary"].first()["total_return"] is None


@pytest.mark.parametrize(
    "change",
    [
        {"manifest": manifest(phase="locked")}, {"manifest": manifest(model_gate_passed=True)}, {"manifest": manifest(panel_sha256="x")}, {"manifest": manifest(development_end=day(50).isoformat())}, {"manifest": manifest(study=" v")},
        {"config": H.HoldingsConfig((day(10), day(11)), day(9), day(20), "IDX")}, {"config": H.HoldingsConfig((day(10),), day(9), day(45), "IDX")}, {"config": H.HoldingsConfig((day(16),), day(9), day(17), "IDX")}, {"config": H.HoldingsConfig((day(10),), day(9), day(20), "NONE")},
    ],
)
def test_gates(world, change):
    with pytest.raises(ContractError):
        run(world, **change)


def test_gates_on_tables(world):
    p, a, x = world["predictions"], world["assignments"], world["prices"]
    bad = [
        {"predictions": p.withColumn("phase", F.lit("locked"))}, {"predictions": p.withColumn("symbol", F.lower("symbol"))}, {"predictions": p.unionByName(p)}, {"predictions": p.where("model = 'x'")},
        {"predictions": p.withColumn("feature_count", F.lit(5))}, {"predictions": p.withColumn("fit_end_date", F.date_add("fit_end_date", 1))}, {"predictions": p.where(F.col("as_of_date") != F.lit(day(12)))}, {"predictions": p.withColumn("score", F.lit(float("inf")))},
        {"assignments": a.withColumn("split_id", F.lit("s"))}, {"assignments": a.where("NOT (fold = 2 AND row_id = '4AX')")}, {"assignments": a.withColumn("evaluation_end", F.date_add("evaluation_end", 30))},
        {"prices": x.where(~((F.col("symbol") == "IDX") & (F.col("date") == F.lit(day(15)))))}, {"prices": x.withColumn("adjusted_close", -F.col("adjusted_close"))}, {"sessions": world["sessions"].where(F.col("session") != F.lit(day(13)))},
    ]
    for change in bad:
        with pytest.raises(ContractError):
            run(world, **change)
    with pytest.raises(ValueError):
        H.HoldingsConfig((day(2), day(1)), day(0), day(9), "IDX")


def test_feature_metadata(spark):
    kinds = "fold int, selected_features string, feature_count int, selected_feature_count int, zero_observed_features boolean, score double, candidate_id string"
    good = [(1, '["a", "b"]', 1, 2, False, 0.5, "ridge:1"), (1, '["a", "b"]', 0, 2, True, None, "ridge:1"), (2, '["b"]', 1, 1, False, 0.1, "ridge:2")]
    counts = lambda rows, grid=("ridge:1", "ridge:2"): {r["check"] for r in CP.feature_violations(spark.createDataFrame(rows, kinds), ["a", "b"], grid and list(grid)).where("violations > 0").collect()}
    assert counts(good) == set()
    assert counts([*good, (1, '["a"]', 1, 1, False, 0.5, "ridge:1")]) == {"features_vary_in_fold"}
    assert counts([*good, (2, '["b"]', 1, 1, False, 0.5, "ridge:1")]) == {"candidate_varies_in_fold"}
    assert counts([(1, '["a", "z"]', 1, 2, False, 0.5, "ridge:1")]) == counts([(1, "no", 1, 2, False, 0.5, "ridge:1")]) == {"bad_selected_features"}
    assert counts([(1, '["a"]', 2, 1, False, 0.5, "ridge:1")]) == {"bad_counts"} and counts([(1, '["a"]', 0, 1, True, 0.5, "ridge:9")]) == {"scored_without_features", "bad_candidate"}
    assert counts([(1, '["a"]', 1, 1, False, 0.5, None)], None) == set() and counts(good, None) == {"bad_candidate"}


def test_identity_and_scope():
    assert CP.check_identity(manifest(), manifest())["study"] == "v"
    for bad in (manifest(target="w"), manifest(study="")):
        with pytest.raises(ContractError):
            CP.check_identity(manifest(), bad)
    with pytest.raises(ContractError):
        CP.check_scope(manifest(), [{"check": "x"}])


def test_rollup_with_selection(spark):
    report = spark.createDataFrame([(1, "a", 0.2, 0.1, 0.1, 0.01), (2, "a", -0.2, 0.3, -0.3, None), (3, "a", 0.0, -0.2, -0.0, 0.03), (1, "b", None, None, None, None)], "fold int, feature string, train_ic double, test_ic double, adjusted_ic double, mean_spread double")
    selected = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "a", True)], "fold int, feature string, selected boolean")
    rows = {r["feature"]: r for r in E.walk_forward_rollup(report, selected).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["fold_count"], a["selection_count"], a["test_fold_count"], a["median_test_ic"]) == (3, 2, 3, 0.1) and math.isclose(a["positive_fold_rate"], 2 / 3) and a["direction_consistency_rate"] == 0.5 and math.isclose(a["mean_directional_ic"], -0.1)
    assert b["test_fold_count"] == 0 and b["mean_test_ic"] is None and b["selection_rate"] == 0
