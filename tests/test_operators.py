"""Operators on small frames with numbers worked by hand, and invariances."""

from __future__ import annotations

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from signalloom.functions import contracts as C
from signalloom.functions import statistics as ST
from signalloom.functions.numeric import on_each, pct_rank
from signalloom.operators import evaluation as E
from signalloom.operators import grid as G
from signalloom.operators import models as M
from signalloom.operators import panel as P
from signalloom.operators import portfolio as PF
from signalloom.operators import signals as S
from signalloom.operators import splits as SP
from signalloom.registry import ExperimentRegistry, RegistryError
from signalloom.sources import sinks, tables
from signalloom.streaming import events

DAY = date(2025, 1, 1)


def days(n):
    return [DAY + timedelta(days=i) for i in range(n)]


def series(spark, values: dict[str, list]):
    rows = [(s, d, float(p)) for s, ps in values.items() for d, p in zip(days(len(ps)), ps, strict=True) if p is not None]
    return spark.createDataFrame(rows, "symbol string, session date, price double")


def small_panel(spark, prices, bench, at, **config):
    px = series(spark, prices)
    bx = series(spark, {"BENCH": bench}).drop("symbol")
    cal = G.calendar(bx)
    members = spark.createDataFrame([("u", s, DAY, None, "t") for s in prices], "universe_id string, symbol string, effective_from date, effective_to date, source string")
    dates = spark.createDataFrame([(days(at + 1)[-1],)], "as_of_date date")
    settings = {"lookback_sessions": 5, "min_observations": 4, "target_horizon_sessions": 1, "annualization_sessions": 5, **config}
    return P.build_panel(px, cal, bx, members, dates, P.PanelConfig(**settings))


def wave(n, a, b, level=50.0):
    """A price series by rule."""
    return [level * math.exp(0.03 * math.sin(a * i) + 0.02 * math.cos(b * i * i)) for i in range(n)]


def by_definition(stock, bench, lookback, year):
    """The ten metrics of the last session in plain Python, from prices without gaps."""
    import numpy as np

    p, q = np.array(stock[-lookback - 1 :]), np.array(bench[-lookback - 1 :])
    x, y = p[1:] / p[:-1] - 1, q[1:] / q[:-1] - 1
    root, mean, sd = math.sqrt(year), x.mean() * year, x.std(ddof=1)
    beta = np.cov(x, y)[0, 1] / y.var(ddof=1)
    return {
        "trailing_return": p[-1] / p[0] - 1, "annualized_volatility": sd * root, "sharpe_ratio": mean / (sd * root),
        "sortino_ratio": mean / (math.sqrt((np.minimum(x, 0) ** 2).mean()) * root), "max_drawdown": (p / np.maximum.accumulate(p) - 1).min(),
        "benchmark_correlation": np.corrcoef(x, y)[0, 1], "beta": beta, "capm_alpha": mean - beta * y.mean() * year,
        "information_ratio": (x - y).mean() * year / ((x - y).std(ddof=1) * root), "historical_var_5pct": max(0.0, -np.quantile(x, 0.05)),
    }


@pytest.mark.parametrize("lookback", [4, 7, 30])
def test_trailing_metrics_by_definition(spark, lookback):
    stock, bench = wave(14, 1.1, 0.7), wave(14, 0.4, 1.3, 200.0)
    gappy = [None if i == 11 else v for i, v in enumerate(wave(14, 0.9, 0.2))]
    rows = {r["symbol"]: r for r in small_panel(spark, {"A": stock, "B": gappy}, bench, 13, lookback_sessions=lookback, min_observations=3, annualization_sessions=12).collect()}
    want = by_definition(stock, bench, lookback, 12)
    assert all(math.isclose(rows["A"][m], v, rel_tol=1e-9, abs_tol=1e-12) for m, v in want.items()) and set(want) == set(P.METRICS)
    assert rows["A"]["feature_window_start"] == days(14)[max(0, 13 - lookback)] and rows["A"]["observation_count"] == min(lookback, 13)
    # A gap takes two returns away, and what is left must reach the least count.
    n = min(lookback, 13) - 2
    assert rows["B"]["observation_count"] == n and rows["B"]["feature_status"] == ("ok" if n >= 3 else "insufficient_history")
    assert (rows["B"]["max_drawdown"] is None) == (n < 3) and rows["B"]["decision_price_available"]
    assert rows["A"]["target_status"] == "insufficient_future_benchmark_history" and rows["A"]["label_start_date"] is None


def test_a_stock_that_is_the_benchmark(spark):
    p = wave(6, 2.2, 0.3)
    row = small_panel(spark, {"A": p}, p, 5).first()
    assert row["information_ratio"] is None and math.isclose(row["beta"], 1) and math.isclose(row["benchmark_correlation"], 1)


def test_future_prices_change_no_feature(spark):
    bench, past = wave(8, 0.6, 0.8), wave(6, 1.9, 0.1)
    a = small_panel(spark, {"A": [*past, 1, 2]}, bench, 5).first()
    b = small_panel(spark, {"A": [*past, 900, 3]}, bench, 5).first()
    assert all(a[m] == b[m] for m in P.METRICS) and a["forward_return"] != b["forward_return"]


def test_price_factors_by_definition(spark):
    p = wave(300, 0.13, 0.011)
    px = series(spark, {"A": p})
    rows = P.price_factors(G.dense_grid(px, G.calendar(px))).orderBy("session").collect()
    for i in (20, 21, 61, 62, 251, 252, 299):
        for name, value in (("return_21s", p[i] / p[i - 21] - 1 if i >= 21 else None), ("momentum_252s_skip_21s", p[i - 21] / p[i - 252] - 1 if i >= 252 else None), ("ma_distance_63s", p[i] * 63 / sum(p[i - 62 : i + 1]) - 1 if i >= 62 else None)):
            assert (rows[i][name] is None and value is None and rows[i][f"{name}_status"] == "insufficient_history") or math.isclose(rows[i][name], value, rel_tol=1e-9)
    gap = series(spark, {"A": [v if i != 289 else None for i, v in enumerate(p)], "B": [1] * 300})
    row = P.price_factors(G.dense_grid(gap, G.calendar(gap)), ("return_21s",)).where("symbol = 'A'").orderBy(F.desc("session")).first()
    assert row["return_21s_status"] == "missing_required_prices" and row["return_21s_observed_price_count"] == 21 and row["return_21s"] is None
    with pytest.raises(ValueError):
        P.price_factors(gap, ("nope",))


def test_spreads_share_ties_whatever_the_rows_order(spark):
    """Against the mean over all orders in which equal scores could stand."""
    from itertools import permutations

    scores, outcomes = [3.0, 1.0, 1.0, 2.0, 1.0, 2.0], [0.5, -1.5, 4.0, 2.5, 7.0, -3.0]
    for q in (2, 3):
        k, spreads = len(scores) // q, []
        for order in permutations(range(6)):
            if all(scores[a] <= scores[b] for a, b in zip(order, order[1:], strict=False)):
                ranked = [outcomes[i] for i in order]
                spreads.append(sum(ranked[-k:]) / k - sum(ranked[:k]) / k)
        df = spark.createDataFrame([(DAY, s, r) for s, r in zip(scores, outcomes, strict=True)], "d date, s double, r double")
        got = S.spread_masses(df, ["d"], "s", "r", q).first()
        assert len(spreads) == 12 and math.isclose(got["spread"], sum(spreads) / len(spreads)) and (got["pairs"], got["scores"]) == (6, 3)


def test_rank_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, None), (2, 1.0)], "k int, x double")
    got = sorted(((r["k"], r["x"], r["p"]) for r in df.withColumn("p", pct_rank("x", "k")).collect()), key=str)
    assert got == sorted([(1, 5.0, 0.5), (1, 5.0, 0.5), (1, 7.0, 1.0), (1, None, None), (2, 1.0, 1.0)], key=str)


def test_benjamini_hochberg(spark):
    ps = {f"f{i}": (0.37 * i * i % 1) ** 3 for i in range(1, 13)} | {"same": (0.37 * 16 % 1) ** 3, "none": None}
    df = spark.createDataFrame(list(ps.items()), "f string, p double")
    q = {r["f"]: r["q_value"] for r in ST.bh_q_values(df, "p").collect()}
    some = sorted(p for p in ps.values() if p is not None)
    for f, p in ps.items():
        # The least of p * m / rank over the values from p on.
        want = None if p is None else min(1.0, *(x * len(some) / (i + 1) for i, x in enumerate(some) if x >= p))
        assert (q[f] is None and want is None) or math.isclose(q[f], want)


def test_newey_west_and_schedule(spark):
    xs = [0.2, -0.1, 0.5, 0.3]
    df = spark.createDataFrame([("f", d, x) for d, x in zip(days(4), xs, strict=True)], "feature string, as_of_date date, rank_ic double")
    mean = sum(xs) / 4
    d = [x - mean for x in xs]
    gamma = [sum(d[i] * d[i - k] for i in range(k, 4)) / 4 for k in (0, 1)]
    t = mean / math.sqrt((gamma[0] + gamma[1]) / 4)
    row = ST.newey_west(df, ["feature"], "as_of_date", "rank_ic", 1).first()
    assert math.isclose(row["hac_t"], t) and math.isclose(row["hac_p"], math.erfc(abs(t) / math.sqrt(2)), rel_tol=1e-6)
    due = spark.createDataFrame([(x,) for x in days(5)], "as_of_date date")
    row = ST.scheduled_inference(df, due, ["feature"], "as_of_date", "rank_ic", 1).first()
    assert row["inference_status"] == "missing_scheduled_values" and row["hac_t"] is None and row["effective_lags"] is None
    row = ST.scheduled_inference(df, due.limit(4), ["feature"], "as_of_date", "rank_ic", 4).first()
    assert row["inference_status"] == "insufficient_lag_support"


def test_top_k_shares_boundary_ties(spark):
    df = spark.createDataFrame([(DAY, s, x) for s, x in [("A", 2.0), ("B", 1.0), ("C", 1.0), ("D", None), ("E", float("nan"))]], "as_of_date date, symbol string, score double")
    assert {r["symbol"]: r["weight"] for r in PF.top_k_weights(df, 2).collect()} == {"A": 0.5, "B": 0.25, "C": 0.25}
    assert {r["symbol"]: r["weight"] for r in PF.top_k_weights(df, 5).collect()} == {"A": 0.2, "B": 0.2, "C": 0.2}


def test_cost_equation():
    assert math.isclose(PF.nav_fraction({"A": 1.0}, {}, 0.01, 0.01), 1 / 1.01)
    x = PF.nav_fraction({"A": 0.5, "B": 0.5}, {"A": 0.9, "C": 0.1}, 0.01, 0.02)
    cost = sum((0.01 if t > 0 else -0.02) * t for t in (0.5 * x - 0.9, 0.5 * x, -0.1))
    assert math.isclose(x + cost, 1)
    assert math.isclose(PF.nav_fraction({}, {"A": 1.0}, 0.0, 0.01), 0.99)
    assert math.isclose(PF.side_rate(commission=0.001, spread=0.0005), 0.0015)
    for bad in ({"a": 0.6, "b": 0.4}, {"a": -0.1}, {"a": float("nan")}, {"a": True}):
        with pytest.raises(ValueError):
            PF.side_rate(**bad)


def test_ledger_trades_next_session_and_blocks(spark):
    px = series(spark, {"A": [100, 100, 110, 110, 121], "B": [50, 50, 50, None, 50]})
    cal = G.calendar(px)
    weights = spark.createDataFrame([("good", DAY, "A", 1.0), ("bad", DAY, "B", 1.0)], "account string, as_of_date date, symbol string, weight double")
    config = PF.LongOnlyConfig(top_k=1, initial_cash=1000.0, buy_rate=0.01)
    daily = PF.ledger(PF.ledger_input(weights, px, cal, days(5)[-1], config), config)
    rows = [r for r in daily.orderBy("session").collect() if r["account"] == "good"]
    assert rows[0]["session"] == days(2)[1] and math.isclose(rows[0]["nav"], 1000 / 1.01) and rows[0]["reason"] == "scheduled_rebalance"
    assert rows[-1]["reason"] == "terminal_liquidation" and math.isclose(rows[-1]["nav"], 1000 / 1.01 * 1.21) and rows[-1]["holdings"] == 0
    out = {r["account"]: r for r in PF.ledger_summary(daily, 1000.0).collect()}
    assert out["bad"]["status"] == "blocked_missing_valuation" and out["bad"]["total_return"] is None and math.isclose(out["good"]["total_return"], 1.21 / 1.01 - 1)


def test_contracts_reject(spark):
    good = spark.createDataFrame([(DAY, " a ", "1.5"), (DAY, "b", "2")], "date date, symbol string, adjusted_close string")
    assert {r["symbol"] for r in C.validate_prices(good).collect()} == {"A", "B"}
    for bad in ("nan", "inf", "0", "-1", "x", None):
        with pytest.raises(C.ContractError):
            C.validate_prices(good.unionByName(spark.createDataFrame([(DAY, "c", bad)], good.schema)))
    with pytest.raises(C.ContractError):
        C.validate_prices(good.unionByName(good))
    member = "universe_id string, symbol string, effective_from date, effective_to date, source string"
    d = days(10)
    assert C.validate_memberships(spark.createDataFrame([("u", "a", d[0], d[3], "s"), ("u", "a", d[3], None, "s")], member)).count() == 2
    for rows in ([("u", "a", d[0], d[4], "s"), ("u", "a", d[3], None, "s")], [("u", "a", d[0], None, "s"), ("u", "a", d[3], None, "s")], [("u", "a", d[3], d[3], "s")], [("", "a", d[0], None, "s")]):
        with pytest.raises(C.ContractError):
            C.validate_memberships(spark.createDataFrame(rows, member))
    with pytest.raises(C.ContractError):
        C.validate_as_of_dates(spark.createDataFrame([(d[0],), (d[0],)], "as_of_date date"))
    with pytest.raises(C.ContractError):
        C.validate_as_of_dates(spark.createDataFrame([("2025-01-01 10:00",)], "as_of_date string"))


def test_panel_contract(spark):
    kinds = "as_of_date date, symbol string, label_end_date date, f double, y double"
    d = days(3)
    out = C.validate_panel(spark.createDataFrame([(d[0], "a", d[1], 1.0, 2.0), (d[0], "b", None, None, None)], kinds), ["f"], "y")
    assert all(r["row_id"].startswith("qmr_") and len(r["row_id"]) == 68 for r in out.collect())
    for row in ((d[1], "a", d[1], 1.0, 2.0), (d[0], "a", None, 1.0, 2.0), (d[0], "a", d[1], float("inf"), 2.0)):
        with pytest.raises(C.ContractError):
            C.validate_panel(spark.createDataFrame([row], kinds), ["f"], "y")


def test_half_open_memberships(spark):
    d = days(6)
    members = spark.createDataFrame([("a", d[1], d[3]), ("a", d[4], None)], "symbol string, effective_from date, effective_to date")
    got = G.active_members(spark.createDataFrame([(x,) for x in d], "as_of_date date"), members).orderBy("as_of_date").collect()
    assert [r["as_of_date"] for r in got] == [d[1], d[2], d[4], d[5]]


def test_purge_is_strict_and_reserved_outcomes_do_not_matter(spark):
    d = days(12)
    rows = [(x, s, d[i + 2] if i + 2 < 12 else None, 0.1 * i + k) for i, x in enumerate(d) for k, s in enumerate("ab")]
    kinds = "as_of_date date, symbol string, label_end_date date, y double"
    panel = spark.createDataFrame(rows, kinds)
    blocks = SP.walk_forward(panel, folds=1, test_dates=3, least_train=2)
    assert [tuple(r) for r in blocks.collect()] == [(1, d[9], d[11])]
    roles = SP.walk_forward_rows(panel, blocks).groupBy("as_of_date").agg(F.first("role").alias("r")).orderBy("as_of_date").collect()
    assert [r["r"] for r in roles] == ["training"] * 7 + ["purged"] * 2 + ["test"] * 3
    changed = panel.withColumn("y", F.when(F.col("as_of_date") >= F.lit(d[8]), F.col("y") + 1000).otherwise(F.col("y")))
    for p in (panel, changed):
        lock = SP.lockbox(p, "y", dates=2, least_rows=2).orderBy("as_of_date").collect()
        assert [r["as_of_date"] for r in lock] == [d[8], d[9]] and all(r["enough"] for r in lock)
    sets = [SP.fold_assignments(p, SP.outer_folds(p, "y", d[8], folds=1, evaluation_dates=2), d[8], "y").drop("y") for p in (panel, changed)]
    assert C.same_rows(*sets)
    assert sets[0].where("role = 'training'").agg(F.max("label_end_date")).first()[0] < sets[0].agg(F.min("evaluation_start")).first()[0]


def test_ridge_matches_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(60, 2)), rng.random(60) + 0.5
    x[:7, 1] = np.nan
    y = x[:, 0] - 0.5 * np.nan_to_num(x[:, 1]) + rng.normal(size=60)
    rows = [(float(a), None if math.isnan(b) else float(b), float(t), float(v)) for (a, b), t, v in zip(x, y, w, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, y double, weight double")
    model = M.fit_ridge(df, ["a", "b"], "y", [2.0])[0]
    full = np.column_stack([x[:, 0], np.where(np.isnan(x[:, 1]), np.nanmedian(x[:, 1]), x[:, 1]), np.isnan(x[:, 1])]).astype(float)
    z = (full - full.mean(axis=0)) / full.std(axis=0)
    zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
    c = np.linalg.solve(zc.T @ (w[:, None] * zc) + 2 * np.eye(3), zc.T @ (w * yc))
    want = z @ c + np.average(y, weights=w) - np.average(z, axis=0, weights=w) @ c
    got = [r["score"] for r in model.score(df).collect()]
    assert np.allclose(sorted(got), sorted(want), atol=1e-8)
    assert model.score(spark.createDataFrame([(None, None)], "a double, b double")).first()["score"] is None
    whole = M.fit_ridge(df, ["a", "b"], "y", [2.0], components=1.0)[0]
    assert np.allclose(whole.coefficients, model.coefficients, atol=1e-8)


def test_greedy_selection():
    quality = [{"feature": f, "coverage": c, "zero_variance": z} for f, c, z in [("a", 1.0, False), ("b", 1.0, False), ("c", 0.2, False), ("d", 1.0, True), ("e", 1.0, False)]]
    summary = [{"feature": f, "mean_rank_ic": x} for f, x in [("a", 0.1), ("b", -0.3), ("c", 0.9), ("d", 0.9), ("e", None)]]
    pairs = [{"left": "a", "right": "b", "mean_abs_spearman": 0.95}]
    out = {r["feature"]: r["reason"] for r in S.select_features(summary, quality, pairs, least_coverage=0.8, least_ic=0.0, threshold=0.9)}
    assert out == {"a": "redundant_with:b", "b": None, "c": "low_coverage", "d": "zero_variance", "e": "insufficient_rank_ic"}


def test_common_scope_divides_by_universe(spark):
    rows = [("development", 1, DAY, s, m, None if (m, s) == ("x", "S0") else float(k), float(k), float(k)) for m in ("x", "y") for k, s in enumerate(["S0", "S1", "S2", "S3"])]
    df = spark.createDataFrame(rows, "phase string, fold int, as_of_date date, symbol string, model string, score double, target double, realized_return double")
    native = {r["model"]: r for r in E.native_daily_metrics(df, 2, 2).collect()}
    common = {r["model"]: r for r in E.common_daily_metrics(df, ["x", "y"], 2, 2).collect()}
    assert native["y"]["score_count"] == 4 and common["y"]["score_count"] == 3 and common["y"]["score_coverage"] == 0.75 and math.isclose(common["x"]["rank_ic"], 1)


def test_acceptance_needs_every_check():
    limits = {"minimum_gain": 0.0, "win_rate": 0.5, "coverage_ratio": 0.95, "score_coverage": 0.8, "ic_dates": 20, "spread_dates": 20, "spread_coverage": 0.8, "p_value": 0.05}
    facts = dict.fromkeys(("development_mean_ic", "development_median_ic", "locked_mean_ic", "locked_median_ic", "locked_mean_spread", "locked_paired_gain", "development_win_rate", "coverage_ratio", "locked_score_coverage", "spread_coverage"), 1.0)
    facts |= {"paired_dates": 20, "spread_dates": 20, "paired_hac_p": 0.05}
    assert len(E.acceptance(facts, limits)) == 13 and all(c["passed"] for c in E.acceptance(facts, limits))
    assert [c["check"] for c in E.acceptance(facts | {"paired_hac_p": None}, limits) if not c["passed"]] == ["paired_hac_p"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Adj Close,Close\n2025-01-02,10,11\n2025-01-03,,12\n")
    prices, gaps, digests = tables.import_files(spark, {"abc": str(tmp_path / "a.csv")})
    assert [tuple(r)[1:] for r in prices.collect()] == [("ABC", 10.0)] and gaps.first()["reason"] == "missing_adjusted_close" and len(digests["abc"]) == 64
    (tmp_path / "b.csv").write_text("x,x\n1,2\n")
    for bad in ("b.csv", "c.txt"):
        with pytest.raises(C.ContractError):
            tables.read_table(spark, str(tmp_path / bad))
    (tmp_path / "j.json").write_text('{"a": 1, "a": 2}')
    with pytest.raises(C.ContractError):
        tables.read_json_object(tmp_path / "j.json")
    with pytest.raises(C.ContractError):
        tables.local_path("https://x/y")
    rets = spark.createDataFrame(list(zip(days(3), [0.5, 0.011, -0.02], strict=True)), "date date, ret double")
    assert [round(r["level"], 3) for r in tables.index_levels(rets).orderBy("date").collect()] == [100, 101.1, 99.078]
    stocks = spark.createDataFrame([("2025-01-01", 1.0, None), ("2025-01-02", 2.0, 3.0)], "Date string, B double, A double")
    long, missing = tables.wide_archive(stocks, 2)
    assert long.count() == 3 and missing.first()["symbol"] == "A"
    factors = spark.createDataFrame([("1/2/2025", 0.5, 0.01)], "Date string, `Mkt-RF` double, RF double")
    assert math.isclose(tables.factor_returns(factors).first()["ret"], 0.0051)
    with pytest.raises(C.ContractError):
        tables.factor_returns(factors.withColumn("RF", F.lit(-99.99)))


def test_sinks_are_whole_or_absent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    digests = sinks.write_bundle(str(tmp_path / "run"), {"t": df, "empty": df.limit(0)}, {"v": float("nan")})
    assert (tmp_path / "run/t.csv").read_text() == "x,y\n1,a\n" and tables.read_json_object(tmp_path / "run/manifest.json")["v"] is None
    tables.verify_files({str(tmp_path / "run" / k): v for k, v in digests.items()})
    with pytest.raises(FileExistsError):
        sinks.write_bundle(str(tmp_path / "run"), {}, {})
    sinks.write_bundle(str(tmp_path / "typed"), {"t": df}, {}, {"t": "x int, y string"})
    with pytest.raises(ValueError):
        sinks.write_bundle(str(tmp_path / "broken"), {"t": df}, {}, {"t": "x long, y string"})
    rows = spark.createDataFrame([(d, s, float(i)) for i, (d, s) in enumerate((d, s) for s in "BA" for d in days(3))], "as_of_date date, symbol string, v double").repartition(4)
    sinks.write_run(str(tmp_path / "whole"), rows, {"report": rows}, {"config": {"a": 1}})
    assert (tmp_path / "whole/report.csv").read_text().splitlines()[1:3] == ["2025-01-01,A,3.0", "2025-01-01,B,0.0"] and list(tables.read_json_object(tmp_path / "whole/manifest.json")["files"]) == ["config.json", "report.csv"]
    assert [tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "whole/panel.parquet")).collect()] == [(d, s) for d in days(3) for s in "AB"]
    with pytest.raises(Exception):
        sinks.write_run(str(tmp_path / "broken"), rows, {"report": rows.withColumn("z", F.raise_error(F.lit("no")))}, {})
    with pytest.raises(Exception):
        sinks.write_bundle(str(tmp_path / "broken"), {"t": df.withColumn("z", F.raise_error(F.lit("no")))}, {})
    assert not [p for p in tmp_path.iterdir() if "broken" in p.name]
    with pytest.raises(ValueError):
        sinks.check_schema(df, "x int, y int")
    assert C.fingerprint(df) == C.fingerprint(df.select("y", "x")) != C.fingerprint(df.limit(0))


def test_few_rows_are_proven_to_be_few(spark):
    rows, few = spark.range(3).toDF("x"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, on_each(rows, few, 2).collect())) == [(x, k, v) for x in range(3) for k, v in ((1, "a"), (2, "b"))]
    assert on_each(rows, few.limit(0), 2).collect() == [] and on_each(rows, few.limit(0), 2).columns == ["x", "k", "v"]
    with pytest.raises(Exception, match="more than 1 rows"):
        on_each(rows, few, 1).collect()


def test_training_weights_need_no_window_over_rows(spark):
    rows = spark.createDataFrame([(1, days(3)[k % 3], k) for k in range(9)] + [(2, DAY, 9), (2, DAY, 10)], "fold int, as_of_date date, n int").where("n <> 2")
    out = {(r["fold"], r["n"]): r["weight"] for r in SP.training_weights(rows, ["fold"]).collect()}
    assert math.isclose(out[1, 5], 8 / 3 / 2) and math.isclose(out[1, 0], 8 / 3 / 3) and out[2, 9] == 1 and len(out) == 10
    per_date = SP.training_weights(rows, []).groupBy("as_of_date").agg(F.sum("weight").alias("w")).collect()
    assert all(math.isclose(r["w"], 10 / 3) for r in per_date)


def test_registry(tmp_path):
    reg = ExperimentRegistry(str(tmp_path / "r.db"))
    manifest = dict.fromkeys(("study", "hypothesis", "dataset_version", "universe_id", "target", "features"), "v") | dict.fromkeys(("panel_sha256", "config_sha256", "source_sha256"), "0" * 64)
    manifest |= {"development_start": "2020-01-01", "development_end": "2020-06-01", "locked_start": "2020-07-01", "locked_end": "2020-09-01"}
    dev = reg.start("v", "h")
    reg.record_plan(dev, manifest)
    final = reg.start("v", "h", "final")
    with pytest.raises(RegistryError):
        reg.reserve_final(final, manifest)
    reg.complete(dev, {"ok": 1})
    with pytest.raises(RegistryError):
        reg.reserve_final(final, manifest | {"target": "other"})
    reg.reserve_final(final, manifest)
    reg.fail(final, "broken")
    with pytest.raises(RegistryError):
        reg.reserve_final(reg.start("v", "h", "final"), manifest)
    with pytest.raises(RegistryError):
        reg.start("v", "another")
    assert [r["status"] for r in reg.runs()] == ["complete", "failed", "running"]


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "events"))
    stream = events.event_windows(events.read_events(spark, str(tmp_path / "events")), late="4000 days")
    got = events.run_to_table(stream, "windows", str(tmp_path / "state"))
    want = events.event_windows(source)
    rounded = [F.round("total", 4).alias("total") if c == "total" else F.col(c) for c in want.columns]
    assert C.same_rows(got.select(rounded), want.select(rounded))
