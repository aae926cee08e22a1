"""Whole runs: research on a panel, a nested benchmark, and comparisons of its arms."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..operators import audit as A
from ..operators import comparison as CP
from ..operators import evaluation as E
from ..operators import grid as G
from ..operators import models as M
from ..operators import signals as S
from ..operators import splits as SP
from ..operators import tuning as TU
from ..operators.boosting import Boosting, fit_boosted
from ..operators.panel import FACTORS, PanelConfig, add_factors, build_panel, price_factors
from ..registry import ExperimentRegistry

FAMILIES = ("ridge", "ridge_pca", "hist_gradient_boosting")

# The settings of the public demonstration.
DEMO_PANEL = PanelConfig(lookback_sessions=252, min_observations=126, target_horizon_sessions=20, entry_lag_sessions=1)
DEMO_SPLIT = {"outer_folds": 3, "outer_dates": 63, "inner_folds": 2, "inner_dates": 42, "locked_dates": 63}


@dataclass(frozen=True)
class BenchmarkConfig:
    """Settings of a nested benchmark; lags of the inference must be stated."""

    # The defaults.
    features: tuple[str, ...]
    hac_lags: int
    target: str = "forward_excess_return"
    realized_return: str = "forward_excess_return"
    min_cross_section: int = 50
    minimum_coverage: float = 0.8
    minimum_rank_ic: float = 0.0
    redundancy_threshold: float = 0.9
    quantiles: int = 5
    outer_folds: int = 3
    outer_dates: int = 63
    inner_folds: int = 2
    inner_dates: int = 42
    minimum_train_dates: int = 12
    locked_dates: int = 63
    ridge_alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)
    pca_variance: float = 0.95
    hist_learning_rates: tuple[float, ...] = (0.05,)
    hist_max_leaf_nodes: tuple[int, ...] = (7,)
    hist_l2_regularization: tuple[float, ...] = (1.0,)
    hist_max_iter: int = 200
    hist_min_samples_leaf: int = 20
    families: tuple[str, ...] = ("ridge",)
    baseline: str = "equal_weight_rank"
    seed: int = 42
    limits: dict = field(default_factory=lambda: {"minimum_gain": 0.0, "win_rate": 0.5, "coverage_ratio": 0.95, "score_coverage": 0.8, "ic_dates": 20, "spread_dates": 20, "spread_coverage": 0.8, "p_value": 0.05})

    def __post_init__(self):
        if not self.features or len(set(self.features)) != len(self.features):
            raise ValueError("features must be unique and not empty")
        if isinstance(self.hac_lags, bool) or not isinstance(self.hac_lags, int) or self.hac_lags < 0:
            raise ValueError("hac_lags must be a nonnegative integer")
        if not 2 <= self.quantiles <= self.min_cross_section:
            raise ValueError("quantiles must lie between 2 and the least cross-section")
        if not set(self.families) <= set(FAMILIES) or not self.families:
            raise ValueError(f"families must be among {FAMILIES}")
        if self.baseline not in ("equal_weight_rank", "best_metric"):
            raise ValueError("unknown baseline")
        if any(not a > 0 for a in self.ridge_alphas) or len(set(self.ridge_alphas)) != len(self.ridge_alphas):
            raise ValueError("alphas must be positive and unique")
        counts = (self.outer_folds, self.outer_dates, self.inner_folds, self.inner_dates, self.minimum_train_dates, self.locked_dates)
        if any(n < 1 for n in counts):
            raise ValueError("split counts must be positive")
        grids = (self.hist_learning_rates, self.hist_max_leaf_nodes, self.hist_l2_regularization)
        if any(not g or len(set(g)) != len(g) for g in grids):
            raise ValueError("grids of trees must be unique and not empty")
        if any(not r > 0 for r in self.hist_learning_rates) or any(n < 2 for n in self.hist_max_leaf_nodes) or any(x < 0 for x in self.hist_l2_regularization) or self.hist_max_iter < 1 or self.hist_min_samples_leaf < 1:
            raise ValueError("trees need positive rates, two leaves, a penalty from 0, and rounds and rows from 1")

    def grid(self, family: str) -> list[tuple[str, dict]]:
        """The candidates of a family in order, by id."""
        if family == "hist_gradient_boosting":
            return M.candidate_grid(family, {"learning_rate": [*self.hist_learning_rates], "max_leaf_nodes": [*self.hist_max_leaf_nodes], "l2_regularization": [*self.hist_l2_regularization]})
        return M.candidate_grid(family, {"alpha": [*self.ridge_alphas]} | ({"variance_to_keep": [self.pca_variance]} if family == "ridge_pca" else {}))

    def candidates(self, family: str) -> list[str]:
        """The ids of a family's grid."""
        return [name for name, _ in self.grid(family)]


def panel_from_tables(prices: DataFrame, memberships: DataFrame, dates: DataFrame, config: PanelConfig, factors: tuple[str, ...] = ()) -> DataFrame:
    """Validate the inputs, build the panel of one universe and add factors on request. Decision dates must be sessions of the benchmark."""
    rows = C.validate_prices(prices).select("symbol", F.col("date").alias("session"), F.col("adjusted_close").alias("price"))
    members = C.validate_memberships(memberships).where(F.col("universe_id") == config.universe_id)
    decisions = C.validate_as_of_dates(dates)
    bench = rows.where(F.col("symbol") == config.benchmark_symbol.upper()).select("session", "price")
    cal = G.calendar(bench)
    if n := decisions.join(cal, decisions["as_of_date"] == cal["session"], "left_anti").count():
        raise C.ContractError(f"{n} decision dates are no sessions")
    stocks = rows.where(F.col("symbol") != config.benchmark_symbol.upper())
    panel = build_panel(stocks, cal, bench, members, decisions, config)
    return add_factors(panel, price_factors(G.dense_grid(stocks, cal), factors)) if factors else panel


def run_research(panel: DataFrame, features: list[str], target: str, train_end, *, cutoff=None, least: int = 50, lags: int = 2, quantiles: int = 5, folds: int | None = None, test_dates: int = 4, least_train: int = 12, pca_share: float | None = None) -> dict:
    """Screen up to ``train_end``, with targets known by the cutoff; optionally components and a walk-forward report with its roll-up."""
    panel = C.validate_signal_panel(panel, features, target, least)
    masked = SP.maturity_mask(panel, target, cutoff or train_end)
    out = S.metric_screen(masked, features, target, train_end, least=least, lags=lags)
    out["spreads"] = S.quantile_spreads(masked.where(F.col("as_of_date") <= F.lit(train_end)), features, target, quantiles, least)
    if pca_share and out["selected"]:
        out["pca_scores"], out["pca"] = M.pca_baseline(panel, out["selected"], train_end, pca_share)
    if folds:
        blocks = SP.walk_forward(panel, folds=folds, test_dates=test_dates, least_train=least_train)
        rows = SP.walk_forward_rows(panel, blocks)
        out["walk_forward"] = E.walk_forward_report(rows, features, target, least, quantiles)
        picked = []
        for b in blocks.collect():
            train = rows.where((F.col("fold") == b["fold"]) & (F.col("role") == "training"))
            screen = S.metric_screen(train, features, target, train.agg(F.max("as_of_date")).first()[0], least=least, lags=lags)
            picked += [(b["fold"], r["feature"], r["selected"]) for r in screen["selection"]]
        selected = panel.sparkSession.createDataFrame(picked, "fold int, feature string, selected boolean")
        out["walk_forward_rollup"] = E.walk_forward_rollup(out["walk_forward"], selected)
    return out


def audit_inputs(prices: DataFrame, memberships: DataFrame, dates: DataFrame, config: PanelConfig, least: int) -> dict:
    """Coverage by date and by security, and coded warnings; no panel is built."""
    rows = C.validate_prices(prices).select("symbol", F.col("date").alias("session"), F.col("adjusted_close").alias("price"))
    members = C.validate_memberships(memberships).where(F.col("universe_id") == config.universe_id)
    bench = rows.where(F.col("symbol") == config.benchmark_symbol.upper()).select("session", "price")
    cal = G.calendar(bench)
    grid = G.dense_grid(rows.where(F.col("symbol") != config.benchmark_symbol.upper()), cal, bench)
    by_date, by_security = A.coverage(grid, C.validate_as_of_dates(dates), members, lookback=config.lookback_sessions, least=config.min_observations, horizon=config.target_horizon_sessions, lag=config.entry_lag_sessions)
    return {"by_date": by_date, "by_security": by_security, "warnings": A.warnings(by_date, least)}


def _fit_block(train: DataFrame, evaluation: DataFrame, config: BenchmarkConfig, phase: str, fold: int, start) -> tuple[DataFrame, dict]:
    """Screen, baselines, tuned models: predictions of one evaluation block with their evidence. Training rows carry outcomes of their own labels only."""
    screen = S.metric_screen(train, list(config.features), config.target, train.agg(F.max("as_of_date")).first()[0], least=config.min_cross_section, lags=config.hac_lags, least_coverage=config.minimum_coverage, least_ic=config.minimum_rank_ic, threshold=config.redundancy_threshold)
    chosen = screen["selected"]
    if not chosen:
        raise ValueError(f"fold {fold}: no feature passes the screen")
    signs = {r["feature"]: r["direction"] for r in E.baseline_signs(screen["daily_ic"]).collect() if r["direction"] and r["feature"] in chosen}
    # By model: its scores with how many features a row has, the features it uses, and the candidate it is.
    scored = {"equal_weight_rank": (E.equal_weight_scores(evaluation, signs), sorted(signs), None)}
    best = E.best_metric(E.baseline_signs(screen["daily_ic"]).where(F.col("feature").isin(chosen))).first()
    if best:
        rank = F.col(f"_rank_{best['feature']}")
        scored["best_metric"] = (E.signed_ranks(evaluation, {best["feature"]: best["direction"]}).withColumn("score", rank).withColumn("feature_count", rank.isNotNull().cast("int")), [best["feature"]], None)
    keep = list(dict.fromkeys(("as_of_date", "symbol", "label_end_date", config.target, config.realized_return)))
    ranked = M.rank_features(train.select(*keep, *chosen), chosen)
    labelled = ranked.where(F.col(config.target).isNotNull() & F.col("label_end_date").isNotNull()).persist()
    later = M.rank_features(evaluation.select("as_of_date", "symbol", *chosen), chosen)
    inside = labelled.withColumn("fold", F.lit(fold))
    inner = TU.nested_rows(inside, TU.nested_blocks(inside, folds=config.inner_folds, test_dates=config.inner_dates, least_train=2))
    details = {"fold": fold, "selected": chosen, "selection": screen["selection"], "trials": []}
    weighted = SP.training_weights(labelled, [])
    for family in config.families:
        grid, trees = config.grid(family), family == "hist_gradient_boosting"
        name, settings = grid[0]
        # A grid of one leaves nothing to choose.
        if len(grid) > 1:
            figures = {"least": config.min_cross_section, "quantiles": config.quantiles, "family": family}
            if trees:
                trials = TU.tune_boosted(inner, chosen, config.target, config.realized_return, [c for _, c in grid], rounds=config.hist_max_iter, leaf=config.hist_min_samples_leaf, **figures)
            else:
                trials = TU.tune_linear(inner, chosen, config.target, config.realized_return, [c for _, c in grid], **figures)
            told = [r.asDict() for r in trials.orderBy("candidate_order").collect()]
            details["trials"] += told
            name, settings = grid[next((r["candidate_order"] for r in told if r["selected"]), 0)]
        if trees:
            fitted = fit_boosted(weighted, [], chosen, config.target, [Boosting(**settings)], rounds=config.hist_max_iter, least=config.hist_min_samples_leaf)
            scored[family] = (fitted.score(later).drop("candidate"), chosen, name)
        else:
            model = M.fit_ridge(weighted, chosen, config.target, [settings["alpha"]], components=settings.get("variance_to_keep"))[0]
            scored[family] = (model.score(later), chosen, name)
    outcome = evaluation.select("as_of_date", "symbol", C.row_id().alias("row_id"), F.col(config.target).alias("target"), F.col(config.realized_return).alias("_r"))
    ends = labelled.agg(F.max("as_of_date"), F.max("label_end_date")).first()
    rows = None
    for model, (frame, used, candidate) in scored.items():
        one = outcome.join(frame.select("as_of_date", "symbol", "score", "feature_count"), ["as_of_date", "symbol"], "left").withColumn("feature_count", F.coalesce("feature_count", F.lit(0)).cast("int"))
        one = one.select(
            F.lit(phase).alias("phase"), F.lit(fold).alias("fold"), "as_of_date", "symbol", F.lit(model).alias("model"), "score", "target", F.col("_r").alias("realized_return"), "row_id",
            F.lit(candidate).cast("string").alias("candidate_id"), F.lit(ends[0]).cast("date").alias("fit_end_date"), F.lit(ends[1]).cast("date").alias("train_label_end_max"), F.lit(start).cast("date").alias("evaluation_start"),
            F.lit(json.dumps(used)).alias("selected_features"), "feature_count", F.lit(len(used)).alias("selected_feature_count"), (F.col("feature_count") == 0).alias("zero_observed_features"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows, details


def preflight_benchmark(panel: DataFrame, config: BenchmarkConfig) -> dict:
    """Whether the splits are feasible and what they purge; nothing is fitted."""
    lock = SP.lockbox(panel, config.target, dates=config.locked_dates, least_rows=config.min_cross_section).collect()
    if len(lock) < config.locked_dates or not all(r["enough"] for r in lock):
        return {"feasible": False, "warnings": ["locked_dates_unavailable"], "folds": []}
    start = min(r["as_of_date"] for r in lock)
    blocks = SP.outer_folds(panel, config.target, start, folds=config.outer_folds, evaluation_dates=config.outer_dates)
    assigned = SP.fold_assignments(panel, blocks, start, config.target)
    out = A.preflight(assigned, config.target, least=config.min_cross_section, lags=config.hac_lags)
    out["feasible"] &= len(out["folds"]) == config.outer_folds and all(r["training_dates"] >= config.minimum_train_dates for r in out["folds"])
    return out | {"lock_start": start.isoformat()}


def run_benchmark(panel: DataFrame, config: BenchmarkConfig, *, registry: ExperimentRegistry | None = None, manifest: dict | None = None, final: bool = False, finish: bool = True) -> dict:
    """Development folds, and on request the final block, governed by the registry.

    Outcomes of the locked dates reach nothing before the final stage: training
    and evaluation rows carry outcomes only where their labels end before it.
    Without ``finish`` the registry's entry stays running, for the caller to end.
    """
    # The panel is read by each fold.
    panel = panel.persist()
    state = preflight_benchmark(panel, config)
    if not state["feasible"]:
        raise ValueError(f"infeasible: {state}")
    run = registry.start(manifest["study"], manifest["hypothesis"], "final" if final else "development") if registry else None
    try:
        if registry:
            (registry.reserve_final if final else registry.record_plan)(run, manifest)
        start = F.lit(state["lock_start"]).cast("date")
        blocks = SP.outer_folds(panel, config.target, state["lock_start"], folds=config.outer_folds, evaluation_dates=config.outer_dates)
        assigned = SP.fold_assignments(panel, blocks, state["lock_start"], config.target)
        outs, details = [], []
        for b in blocks.orderBy("fold").collect():
            train = SP.training_cross_sections(assigned.where(F.col("fold") == b["fold"]), config.target)
            evaluation = panel.where(F.col("as_of_date").between(b["evaluation_start"], b["evaluation_end"]))
            known = F.col("label_end_date").isNotNull() & (F.col("label_end_date") < start)
            for c in dict.fromkeys((config.target, config.realized_return)):
                evaluation = evaluation.withColumn(c, F.when(known, F.col(c)))
            rows, found = _fit_block(train, evaluation, config, "development", b["fold"], b["evaluation_start"])
            outs.append(rows)
            details.append(found)
        if final:
            train = panel.where((F.col("as_of_date") < start) & (F.col("label_end_date") < start))
            rows, found = _fit_block(train, panel.where(F.col("as_of_date") >= start), config, "locked", 0, state["lock_start"])
            outs.append(rows)
            details.append(found)
        predictions = outs[0]
        for o in outs[1:]:
            predictions = predictions.unionByName(o)
        predictions = predictions.persist()
        broken = {r["check"]: r["violations"] for r in E.common_scope_violations(predictions, [config.baseline, *config.families]).where("violations > 0").collect()}
        if broken:
            raise C.ContractError(f"models can't be compared: {broken}")
        native = E.native_daily_metrics(predictions, config.min_cross_section, config.quantiles)
        common = E.common_daily_metrics(predictions, [config.baseline, *config.families], config.min_cross_section, config.quantiles)
        summary = E.phase_summary(common, config.hac_lags)
        frozen = E.frozen_family(summary.where("phase = 'development'"), list(config.families)).first()
        out = {"predictions": predictions, "native_daily": native, "common_daily": common, "fold_metrics": E.fold_metrics(common), "summary": summary, "frozen": frozen["model"] if frozen else None, "details": details, "preflight": state, "acceptance": None, "assignments": CP.assignment_table(assigned, C.row_id()), "schedule": SP.phase_schedule(panel, blocks)}
        if final and frozen:
            out["acceptance"] = E.acceptance(_facts(out, config), config.limits)
        if registry and finish:
            registry.complete(run, {"frozen": out["frozen"]})
        return out | {"run": run}
    except BaseException as e:
        if registry:
            registry.fail(run, repr(e))
        raise


def _facts(out: dict, config: BenchmarkConfig) -> dict:
    """What the final checks look at."""
    family, base = out["frozen"], config.baseline
    row = lambda phase: out["summary"].where((F.col("phase") == phase) & (F.col("model") == family)).first()
    dev, locked = row("development"), row("locked")
    daily = out["common_daily"].where("phase = 'locked'")
    paired = E.paired_deltas(daily, daily, family, base)
    facts = E.paired_summary(paired).first()
    from ..functions.statistics import newey_west

    hac = newey_west(paired.where("delta IS NOT NULL").withColumn("k", F.lit(1)), ["k"], "as_of_date", "delta", config.hac_lags).first()
    folds = out["fold_metrics"].where("phase = 'development'").groupBy("fold").agg(
        (F.max(F.when(F.col("model") == family, F.col("mean_rank_ic"))) - F.max(F.when(F.col("model") == base, F.col("mean_rank_ic")))).alias("gain")
    )
    wins = folds.agg(F.avg((F.col("gain") > config.limits["minimum_gain"]).cast("double"))).first()[0]
    native = out["native_daily"].where("phase = 'locked'").groupBy("model").agg(F.avg("score_coverage").alias("c"), F.avg("spread_coverage").alias("s"), F.count("spread").alias("n")).collect()
    of = {r["model"]: r for r in native}
    return {
        "development_mean_ic": dev and dev["mean_rank_ic"], "development_median_ic": dev and dev["median_rank_ic"], "locked_mean_ic": locked and locked["mean_rank_ic"], "locked_median_ic": locked and locked["median_rank_ic"],
        "locked_mean_spread": locked and locked["mean_spread"], "locked_paired_gain": facts["mean_paired_delta"], "development_win_rate": wins, "coverage_ratio": of[family]["c"] / of[base]["c"] if of[base]["c"] else None,
        "locked_score_coverage": of[family]["c"], "paired_dates": facts["paired_count"], "spread_dates": of[family]["n"], "spread_coverage": of[family]["s"], "paired_hac_p": hac["hac_p"] if hac else None,
    }


def _tables(out: dict, details: DataFrame) -> dict[str, DataFrame]:
    return {k: out[k] for k in ("predictions", "native_daily", "common_daily", "fold_metrics", "summary", "assignments")} | {"selection": details}


def develop(prices: DataFrame, memberships: DataFrame, dates: DataFrame, panel_config: PanelConfig, config: BenchmarkConfig, *, registry: ExperimentRegistry, manifest: dict, path: str, factors: tuple[str, ...] = ()) -> dict:
    """A development run from input tables to a verified bundle: audit, panel, preflight, plan, fits, tables, report last.

    A run that fails leaves a failed entry and no bundle.
    """
    from ..sources import sinks

    audit = audit_inputs(prices, memberships, dates, panel_config, config.min_cross_section)
    panel = panel_from_tables(prices, memberships, dates, panel_config, factors).persist()
    panel = C.validate_panel(panel, list(config.features), config.target, config.realized_return)
    out = run_benchmark(panel, config, registry=registry, manifest=manifest, finish=False)
    try:
        rows = [(d["fold"], r["feature"], r["selected"], r["reason"]) for d in out["details"] for r in d["selection"]]
        tables = _tables(out, panel.sparkSession.createDataFrame(rows, "fold int, feature string, selected boolean, reason string"))
        report = {"run": out["run"], "phase": "development", "manifest": manifest, "preflight": out["preflight"], "warnings": audit["warnings"], "frozen": out["frozen"], "panel_sha256": C.fingerprint(panel.select("row_id", *config.features, config.target))}
        digests = sinks.write_bundle(path, tables, report)
        registry.complete(out["run"], {"frozen": out["frozen"], "files": digests})
    except BaseException as e:
        registry.fail(out["run"], repr(e))
        raise
    return out | {"report": report, "files": digests, "audit": audit}


def verify_development(spark, path: str, registry: ExperimentRegistry) -> dict:
    """The report of a bundle that matches its completed entry: the files' digests, the plan, and development rows alone."""
    from ..sources import sinks

    names = {r["path"].rpartition("/")[2] for r in spark.read.format("binaryFile").load(f"{path}/*").select("path").collect()}
    report = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest.json", wholetext=True).collect())) if "manifest.json" in names else None
    if not report or report.get("phase") != "development":
        raise C.ContractError("no development report")
    entry = next((r for r in registry.records() if r["id"] == report["run"]), None)
    if not entry or entry["status"] != "complete" or entry["phase"] != "development" or entry["manifest"] != report["manifest"]:
        raise C.ContractError("the registry holds no such completed development run")
    seen = {name: sinks.digest(spark, f"{path}/{name}") for name in names - {"manifest.json"}}
    if not seen == report["files"] == entry["result"]["files"] or entry["result"]["frozen"] != report["frozen"]:
        raise C.ContractError("the bundle's files aren't those of the run")
    for name in ("predictions", "native_daily", "common_daily", "fold_metrics", "summary", "assignments"):
        if spark.read.csv(f"{path}/{name}.csv", header=True).where("phase <> 'development' OR phase IS NULL").count():
            raise C.ContractError(f"{name} holds rows of another phase")
    return report


def compare_bundles(reference: DataFrame, candidate: DataFrame, schedule: DataFrame, *, model: str = "ridge", baseline: str = "equal_weight_rank", least: int = 50, quantiles: int = 5, assignments: DataFrame | None = None, candidate_assignments: DataFrame | None = None, manifests: tuple[dict, ...] = ()) -> dict:
    """Three arms on one footing: the reference run's baseline and model, and the candidate's model.

    Keys and outcomes of the arms must agree exactly, nulls included; so must the
    runs' identities and assignments, where given, and scores must carry the
    evidence that the assignments demand.
    """
    for m in manifests:
        CP.check_scope(m)
    if manifests:
        CP.check_identity(*manifests)
    if assignments is not None and candidate_assignments is not None and (n := CP.assignment_differences(assignments, candidate_assignments).count()):
        raise C.ContractError(f"{n} assignments differ")
    keys = ["phase", "fold", "as_of_date", "symbol"]
    arm = lambda df, m, name: df.where(F.col("model") == m).withColumn("model", F.lit(name))
    arms = [arm(reference, baseline, "legacy_equal_rank"), arm(reference, model, "legacy_model"), arm(candidate, model, "candidate_model")]
    if all("row_id" in a.columns for a in arms) and assignments is not None:
        for a in arms:
            CP.enforce(CP.evidence_violations(a, assignments, schedule), "scores")
            CP.enforce(CP.outcome_violations(a, assignments), "outcomes")
    outcome = [a.select(*keys, "target", "realized_return") for a in arms]
    if not all(C.same_rows(outcome[0], o) for o in outcome[1:]):
        raise C.ContractError("the arms' rows or outcomes differ")
    every = arms[0].unionByName(arms[1]).unionByName(arms[2])
    names = ["legacy_equal_rank", "legacy_model", "candidate_model"]
    daily = {"native": E.native_daily_metrics(every, least, quantiles), "common": E.common_daily_metrics(every, names, least, quantiles)}
    deltas = {(scope, ref): E.paired_summary(E.paired_deltas(d, schedule, "candidate_model", ref)) for scope, d in daily.items() for ref in names[:2]}
    return {"daily": daily, "paired": deltas}


def write_comparison(path: str, comparison: dict, lags: int, metadata: dict | None = None) -> dict[str, str]:
    """What ``compare_bundles`` found as a bundle: daily figures of both scopes, their folds and phases, and paired differences.

    A comparison describes development runs; it holds no other phase and makes no claim beyond them.
    """
    from ..sources import sinks

    scoped = {scope: daily.withColumn("scope", F.lit(scope)) for scope, daily in comparison["daily"].items()}
    if n := sum(d.where("phase <> 'development' OR phase IS NULL").count() for d in scoped.values()):
        raise C.ContractError(f"{n} rows of another phase")
    both = lambda f: f("native").unionByName(f("common"))
    paired = None
    for (scope, reference), summary in comparison["paired"].items():
        one = summary.select(F.lit(scope).alias("scope"), F.lit(reference).alias("reference"), "*")
        paired = one if paired is None else paired.unionByName(one)
    tables = {
        "native_daily": scoped["native"], "common_daily": scoped["common"], "paired_summary": paired,
        "fold_metrics": both(lambda s: E.fold_metrics(scoped[s]).withColumn("scope", F.lit(s))),
        "phase_summary": both(lambda s: E.phase_summary(scoped[s], lags).withColumn("scope", F.lit(s))),
    }
    return sinks.write_bundle(path, tables, {"phase": "development", "kind": "comparison", "claim": "descriptive", "metadata": metadata or {}})


def target_ablation(panel: DataFrame, config: BenchmarkConfig) -> dict[str, dict]:
    """The benchmark trained on returns and on within-date ranks of them, both judged by returns."""
    from dataclasses import replace

    from ..functions.numeric import pct_rank

    ranked = panel.withColumn("_target_rank", pct_rank(config.target, "as_of_date"))
    return {"return": run_benchmark(panel, config), "rank": run_benchmark(ranked, replace(config, target="_target_rank", realized_return=config.realized_return))}


def feature_ablation(panel: DataFrame, config: BenchmarkConfig, more: tuple[str, ...] = tuple(FACTORS)) -> dict[str, dict]:
    """The benchmark with and without further features on one panel."""
    from dataclasses import replace

    return {"base": run_benchmark(panel, config), "more": run_benchmark(panel, replace(config, features=(*config.features, *more)))}
