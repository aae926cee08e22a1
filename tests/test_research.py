"""Whole runs on small synthetic panels."""

from __future__ import annotations

import json
import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from signalloom.cli import main
from signalloom.plans import research as R
from signalloom.registry import ExperimentRegistry

START = date(2024, 1, 1)


def day(i):
    return START + timedelta(days=i)


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for i in range(30):
        for k in range(8):
            a, b = math.sin(1.7 * i + 2.3 * k), math.cos(0.9 * i + 1.1 * k * k)
            y = None if i >= 28 else 0.6 * a - 0.2 * b + 0.3 * math.sin(12.9 * i * k + 4.1 * k)
            rows.append((day(i), f"S{k}", day(i + 2) if i < 28 else None, a, b, 3 * a + 0.001 * b, None if (i + k) % 9 == 0 else b * b, y))
    return spark.createDataFrame(rows, "as_of_date date, symbol string, label_end_date date, momentum double, value double, twin double, patchy double, forward_excess_return double").persist()


CONFIG = R.BenchmarkConfig(
    features=("momentum", "value", "twin", "patchy"), hac_lags=1, min_cross_section=5, minimum_coverage=0.5, quantiles=2, outer_folds=1, outer_dates=4,
    inner_folds=1, inner_dates=3, minimum_train_dates=5, locked_dates=3, ridge_alphas=(0.1, 10.0), redundancy_threshold=0.98,
)


def manifest():
    out = dict.fromkeys(("study", "hypothesis", "dataset_version", "universe_id", "target", "features"), "v") | dict.fromkeys(("panel_sha256", "config_sha256", "source_sha256"), "0" * 64)
    return out | {"development_start": "2024-01-01", "development_end": "2024-01-20", "locked_start": "2024-01-26", "locked_end": "2024-01-31"}


def test_benchmark_learns_and_ignores_reserved_outcomes(spark, panel, tmp_path):
    registry = ExperimentRegistry(str(tmp_path / "r.db"))
    out = R.run_benchmark(panel, CONFIG, registry=registry, manifest=manifest())
    assert out["frozen"] == "ridge" and out["acceptance"] is None and [r["status"] for r in registry.runs()] == ["complete"]
    best = out["summary"].where("model = 'ridge'").first()
    assert best["mean_rank_ic"] > 0.5 and best["date_count"] == 4
    assert "twin" not in out["details"][0]["selected"] or "momentum" not in out["details"][0]["selected"]
    start = out["preflight"]["lock_start"]
    changed = panel.withColumn("forward_excess_return", F.when(F.col("label_end_date") >= F.lit(start).cast("date"), F.col("forward_excess_return") * -50).otherwise(F.col("forward_excess_return")))
    again = R.run_benchmark(changed, CONFIG)
    key = lambda o: sorted(map(tuple, o["predictions"].select("as_of_date", "symbol", "model", F.round("score", 10)).collect()))
    assert key(out) == key(again)
    final = R.run_benchmark(panel, CONFIG, registry=registry, manifest=manifest(), final=True)
    assert len(final["acceptance"]) == 13 and {r["phase"] for r in final["predictions"].select("phase").distinct().collect()} == {"development", "locked"}
    schedule = out["predictions"].select("as_of_date").distinct()
    both = R.compare_bundles(out["predictions"], again["predictions"].drop("target", "realized_return").join(out["predictions"].select("phase", "fold", "as_of_date", "symbol", "model", "target", "realized_return"), ["phase", "fold", "as_of_date", "symbol", "model"]).select(out["predictions"].columns), schedule, least=5, quantiles=2)
    delta = both["paired"]["common", "legacy_model"].first()
    assert delta["paired_count"] == 4 and abs(delta["mean_paired_delta"]) < 1e-9


def test_research_run(panel):
    out = R.run_research(panel, ["momentum", "value", "twin", "patchy"], "forward_excess_return", day(20), least=5, lags=1, quantiles=2, folds=1, test_dates=4, least_train=5, pca_share=0.9)
    reasons = {r["feature"]: r["reason"] for r in out["selection"]}
    assert sorted(r for r in reasons.values() if r) and any((r or "").startswith("redundant_with") for r in reasons.values())
    assert out["pca_scores"].count() == 240 and out["walk_forward"].count() == 4
    assert {r["selection_rate"] for r in out["walk_forward_rollup"].collect()} == {0.0, 1.0}
    late = panel.withColumn("forward_excess_return", F.when(F.col("label_end_date") > F.lit(day(20)), F.lit(9.0)).otherwise(F.col("forward_excess_return")))
    other = R.run_research(late, ["momentum", "value"], "forward_excess_return", day(20), least=5, lags=1, quantiles=2)
    same = R.run_research(panel, ["momentum", "value"], "forward_excess_return", day(20), least=5, lags=1, quantiles=2)
    assert sorted(map(str, other["ic_summary"].collect())) == sorted(map(str, same["ic_summary"].collect()))


def test_configs_reject():
    good = {"features": ("a",), "hac_lags": 1}
    for bad in ({"features": ()}, {"features": ("a", "a")}, {"hac_lags": None}, {"quantiles": 1}, {"families": ("forest",)}, {"baseline": "x"}, {"ridge_alphas": (0.0,)}, {"locked_dates": 0}):
        with pytest.raises((ValueError, TypeError)):
            R.BenchmarkConfig(**good | bad)
    for bad in ({"lookback_sessions": 0}, {"min_observations": 1}, {"entry_lag_sessions": 0}, {"features": ("x",)}):
        with pytest.raises(ValueError):
            R.PanelConfig(**bad)


def test_command_line(spark, panel, tmp_path, capsys):
    panel.write.parquet(str(tmp_path / "panel.parquet"))
    config = {"features": list(CONFIG.features), "hac_lags": 1, "min_cross_section": 5, "minimum_coverage": 0.5, "quantiles": 2, "outer_folds": 1, "outer_dates": 4, "inner_folds": 1, "inner_dates": 3, "minimum_train_dates": 5, "locked_dates": 3}
    (tmp_path / "c.json").write_text(json.dumps(config))
    (tmp_path / "c2.json").write_text(json.dumps(config | {"features": ["momentum"], "ridge_alphas": [1.0]}))
    (tmp_path / "bad.json").write_text(json.dumps(config | {"locked_dates": 300}))
    assert main(["preflight", "--panel", str(tmp_path / "panel.parquet"), "--config", str(tmp_path / "c.json")]) == 0
    assert main(["preflight", "--panel", str(tmp_path / "panel.parquet"), "--config", str(tmp_path / "bad.json")]) == 2
    assert '"feasible": false' in capsys.readouterr().out
    prices = [(day(i), s, 100.0 + i * (k + 1) + (i * 7 % 5)) for i in range(12) for k, s in enumerate(("AAA", "BBB", "BENCH"))]
    spark.createDataFrame(prices, "date date, symbol string, adjusted_close double").write.parquet(str(tmp_path / "p.parquet"))
    spark.createDataFrame([("default", s, day(0), None, "t") for s in ("AAA", "BBB")], "universe_id string, symbol string, effective_from date, effective_to date, source string").write.parquet(str(tmp_path / "m.parquet"))
    spark.createDataFrame([(day(8),)], "as_of_date date").write.parquet(str(tmp_path / "d.parquet"))
    (tmp_path / "pc.json").write_text(json.dumps({"lookback_sessions": 5, "min_observations": 3, "target_horizon_sessions": 1, "features": ["beta", "sharpe_ratio"]}))
    args = ["audit", "--prices", str(tmp_path / "p.parquet"), "--memberships", str(tmp_path / "m.parquet"), "--dates", str(tmp_path / "d.parquet"), "--config", str(tmp_path / "pc.json")]
    assert main([*args, "--least", "2"]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"dates": 1, "warnings": []}
    assert main([*args, "--output", str(tmp_path / "audit")]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["warnings"] == ["thin_cross_section"]
    assert (tmp_path / "audit/by_date.csv").exists() and (tmp_path / "audit/manifest.json").exists()
    assert main(["ablate", "features", "--panel", str(tmp_path / "panel.parquet"), "--config", str(tmp_path / "c2.json"), "--output", str(tmp_path / "ablation"), "--more", "value"]) == 0
    assert {p.name for p in (tmp_path / "ablation").glob("*.csv")} == {f"{a}_{t}.csv" for a in ("base", "more") for t in ("fold_metrics", "summary")}
    with pytest.raises(SystemExit):
        main(["run", *args[1:], "--output", "x", "--train-end", "2024-01-05", "--folds", "1"])


def test_development_run_is_verified(spark, tmp_path):
    """From prices to a bundle that matches its entry; a changed file, row or entry is found."""
    price = lambda i, k: 30.0 * (k + 1) * math.exp(0.02 * math.sin(0.7 * i * (k + 1)) + 0.05 * math.cos(0.11 * i + k))
    rows = [(day(i), s, price(i, k)) for i in range(110) for k, s in enumerate([*(f"S{j}" for j in range(7)), "BENCH"])]
    prices = spark.createDataFrame(rows, "date date, symbol string, adjusted_close double")
    members = spark.createDataFrame([("default", f"S{j}", day(0), None, "t") for j in range(7)], "universe_id string, symbol string, effective_from date, effective_to date, source string")
    dates = spark.createDataFrame([(day(i),) for i in range(12, 106, 2)], "as_of_date date")
    settings = R.PanelConfig(lookback_sessions=10, min_observations=6, target_horizon_sessions=2, annualization_sessions=50)
    config = R.BenchmarkConfig(features=("trailing_return", "beta"), hac_lags=1, min_cross_section=4, minimum_coverage=0.5, quantiles=2, outer_folds=1, outer_dates=4, inner_folds=1, inner_dates=3, minimum_train_dates=5, locked_dates=3, ridge_alphas=(1.0,))
    registry, path = ExperimentRegistry(str(tmp_path / "r.db")), str(tmp_path / "bundle")
    out = R.develop(prices, members, dates, settings, config, registry=registry, manifest=manifest(), path=path)
    assert R.verify_development(spark, path, registry)["frozen"] == out["frozen"] == "ridge" and registry.records()[0]["result"]["files"] == out["files"]
    with pytest.raises(FileExistsError):
        R.develop(prices, members, dates, settings, config, registry=registry, manifest=manifest(), path=path)
    assert [r["status"] for r in registry.runs()] == ["complete", "failed"] and not [p for p in tmp_path.iterdir() if p.name.startswith(".bundle")]
    other = ExperimentRegistry(str(tmp_path / "other.db"))
    with pytest.raises(ValueError):
        R.verify_development(spark, path, other)
    (tmp_path / "bundle/summary.csv").write_text((tmp_path / "bundle/summary.csv").read_text() + "x\n")
    (tmp_path / "bundle/.summary.csv.crc").unlink()
    with pytest.raises(ValueError):
        R.verify_development(spark, path, registry)


def test_saved_scores_carry_their_evidence(spark, panel, tmp_path):
    from dataclasses import replace

    from signalloom.functions.contracts import ContractError
    from signalloom.operators import comparison as CP
    from signalloom.operators.portfolio import LongOnlyConfig
    from signalloom.plans import holdings as H

    config = replace(CONFIG, features=("momentum", "patchy"), ridge_alphas=(1.0,))
    out = R.run_benchmark(panel, config)
    folds = {"folds": 1, "fold_dates": 4}
    for model, grid in (("ridge", config.candidates("ridge")), ("equal_weight_rank", None)):
        scores = out["predictions"].where(F.col("model") == model)
        for found in (CP.evidence_violations(scores, out["assignments"], out["schedule"]), CP.outcome_violations(scores, out["assignments"]), CP.feature_violations(scores, list(config.features), grid)):
            assert found.where("violations > 0").collect() == []
    dates = [r["as_of_date"] for r in out["schedule"].orderBy("as_of_date").collect()]
    prices = spark.createDataFrame([(day(i), s, 10.0 + (i * (k + 2)) % 7) for i in range(30) for k, s in enumerate([*(f"S{j}" for j in range(8)), "BENCH"])], "date date, symbol string, adjusted_close double")
    sessions = prices.select(F.col("date").alias("session")).distinct()
    plan = H.HoldingsConfig(tuple(dates), dates[0], dates[-1] + timedelta(days=2), "BENCH", LongOnlyConfig(top_k=2, initial_cash=100.0))
    bounds = manifest() | {"locked_start": "2024-01-28", "locked_end": "2024-01-30"}
    made = H.evaluate_long_only(out["predictions"], out["assignments"], out["schedule"], prices, sessions, model="ridge", models=["ridge"], config=plan, manifest=bounds, **folds)
    assert made["summary"].first()["status"] == "ok" and made["days"].count() == 6 and made["trades"].count() > 4
    both = R.compare_bundles(out["predictions"], out["predictions"], out["schedule"], least=5, quantiles=2, assignments=out["assignments"], candidate_assignments=out["assignments"], manifests=(bounds, bounds))
    assert both["paired"]["native", "legacy_model"].first()["mean_paired_delta"] == 0
    where = str(tmp_path / "comparison")
    files = R.write_comparison(where, both, 1, {"arms": 3})
    from signalloom.sources import sinks

    told, tables = sinks.read_bundle(spark, where)
    assert told["files"] == files and told["claim"] == "descriptive" and set(tables) == {"native_daily", "common_daily", "paired_summary", "fold_metrics", "phase_summary"}
    assert tables["paired_summary"].count() == 4 and tables["phase_summary"].where("scope = 'common'").count() == 3 and tables["native_daily"].count() == both["daily"]["native"].count()
    with pytest.raises(FileExistsError):
        R.write_comparison(where, both, 1)
    with pytest.raises(ContractError):
        R.compare_bundles(out["predictions"], out["predictions"], out["schedule"], assignments=out["assignments"], candidate_assignments=out["assignments"].where("fold < 1"))


def test_tuning_of_trees_and_ridge_on_inner_folds(panel):
    from dataclasses import replace

    small = replace(CONFIG, features=("momentum", "value"), outer_folds=1, ridge_alphas=(0.5, 50.0), families=("ridge", "hist_gradient_boosting"), hist_max_iter=1, hist_min_samples_leaf=3, hist_max_leaf_nodes=(2, 3))
    out = R.run_benchmark(panel, small)
    for d in out["details"]:
        by = {}
        for t in d["trials"]:
            by.setdefault(t["family"], []).append(t)
        for family, trials in by.items():
            assert [t["candidate_id"] for t in trials] == small.candidates(family) and sum(t["selected"] for t in trials) == 1
            assert max(trials, key=lambda t: (round(t["mean_rank_ic"], 12), -t["candidate_order"]))["selected"]
    assert {r["model"] for r in out["predictions"].select("model").distinct().collect()} >= {"ridge", "hist_gradient_boosting"}


def test_target_ablation(panel):
    from dataclasses import replace

    out = R.target_ablation(panel, replace(CONFIG, features=("momentum", "value"), ridge_alphas=(1.0,)))
    both = {k: {r["model"]: r["mean_rank_ic"] for r in v["summary"].collect()} for k, v in out.items()}
    assert set(both) == {"return", "rank"} and all(x["ridge"] > 0.5 for x in both.values())


def test_candidates_and_warnings(spark):
    from signalloom.functions import contracts as C
    from signalloom.operators import audit, models

    assert models.candidate_grid("ridge", {"alpha": [1, 2], "b": ["x"]}) == [('ridge:{"alpha":1,"b":"x"}', {"alpha": 1, "b": "x"}), ('ridge:{"alpha":2,"b":"x"}', {"alpha": 2, "b": "x"})]
    kinds = "active_count long, known_count long, decision_price_count long, start_price_count long, eligible_count long, label_price_count long"
    assert audit.warnings(spark.createDataFrame([(5, 5, 5, 5, 5, 5)], kinds), 5) == []
    assert audit.warnings(spark.createDataFrame([(5, 5, 5, 5, 5, 5), (5, 4, 4, 5, 3, 5)], kinds), 5) == ["unknown_members", "missing_decision_prices", "thin_cross_section"]
    rows = [("development", 1, day(0), "A", "ridge", 0.5, None, None)]
    frame = "phase string, fold int, as_of_date date, symbol string, model string, score double, target double, realized_return double"
    C.validate_predictions(spark.createDataFrame(rows, frame))
    for bad in (rows * 2, [("development", 1, day(0), " A", "ridge", 0.5, None, None)], [("development", 1, day(0), "A", "ridge", float("inf"), None, None)]):
        with pytest.raises(C.ContractError):
            C.validate_predictions(spark.createDataFrame(bad, frame))


def test_guards(spark):
    from signalloom.functions import contracts as C
    from signalloom.operators import grid, panel
    from signalloom.sources import tables

    rows = spark.createDataFrame([(day(0), "A", "1.5", 2.0), (day(0), "B", None, float("nan"))], "as_of_date date, symbol string, f string, y double")
    out = {r["symbol"]: (r["f"], r["y"]) for r in C.validate_signal_panel(rows, ["f"], "y", 2).collect()}
    assert out == {"A": (1.5, 2.0), "B": (None, None)} and C.validate_training(rows, ["f"], "y").count() == 2
    for change, least in ((rows, 1), (rows, True), (rows.unionByName(rows), 2), (rows.withColumn("f", F.lit("x")), 2), (rows.withColumn("f", F.lit(True)), 2), (rows.drop("y"), 2), (rows.withColumn("symbol", F.lit(" ")).limit(1), 2)):
        with pytest.raises(C.ContractError):
            C.validate_signal_panel(change, ["f"], "y", least)
    ic = spark.createDataFrame([("f", day(0), 0.1), ("f", day(1), None)], "feature string, as_of_date date, rank_ic double")
    assert C.validate_daily_ic(ic).count() == 2
    for bad in (ic.unionByName(ic), ic.withColumn("feature", F.lit(None).cast("string"))):
        with pytest.raises(C.ContractError):
            C.validate_daily_ic(bad)
    assert C.validate_schedule(["2024-01-01", day(1)]) == [day(0), day(1)]
    for bad in ({day(0)}, [], [day(1), day(0)], [day(0), day(0)], "2024-01-01", [3]):
        with pytest.raises(C.ContractError):
            C.validate_schedule(bad)
    prices = spark.createDataFrame([(day(i), 10.0 + i % 4) for i in range(70) if i != 50], "session date, price double")
    cal = grid.calendar(spark.createDataFrame([(day(i),) for i in range(70)], "session date"))
    found = {r["factor"]: r for r in panel.compute_price_factors(prices, cal, day(65), ("ma_distance_63s", "return_21s")).collect()}
    assert list(found) == ["ma_distance_63s", "return_21s"] and found["return_21s"]["status"] == "missing_required_prices" and found["return_21s"]["observed_price_count"] == 21
    ok = panel.compute_price_factors(prices.withColumn("price", F.when(F.col("session") <= F.lit(day(45)), F.col("price")).otherwise(-1.0)), cal, day(45), ("return_21s",)).first()
    assert ok["status"] == "ok" and math.isclose(ok["value"], (10 + 45 % 4) / (10 + 24 % 4) - 1) and ok["window_start"] == day(24)
    for frame, at in ((prices, day(80)), (prices.unionByName(prices), day(65)), (prices.withColumn("session", F.date_add("session", 100)), day(65))):
        with pytest.raises(C.ContractError):
            panel.compute_price_factors(frame, cal, at)
    moves = tables.move_counts(spark.createDataFrame([(0.6,), (-0.7,), (float("inf"),), (0.1,), (None,)], "r double")).first()
    assert (moves["returns"], moves["large"], moves["nonfinite"]) == (4, 2, 1)
    dated = prices.withColumnRenamed("session", "date")
    tables.require_factor_dates(dated, dated)
    with pytest.raises(C.ContractError):
        tables.require_factor_dates(dated, dated.limit(3))
