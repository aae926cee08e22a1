"""One query an operator over the derived tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..functions import statistics as ST
from ..functions.numeric import on_each, proven_few
from ..operators import audit as A
from ..operators import comparison as CP
from ..operators import evaluation as E
from ..operators import grid as G
from ..operators import models as M
from ..operators import panel as P
from ..operators import portfolio as PF
from ..operators import signals as S
from ..operators import splits as SP
from ..sources import tables as T
from . import sql
from .derived import CONFIG, TARGET, Universe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Signals that the screening queries look at, with the directions that fixed scores use.
SIGNALS = ("trailing_return", "annualized_volatility", "sharpe_ratio", "beta", "max_drawdown")
SIGNS = {"trailing_return": 1, "annualized_volatility": -1, "beta": 1}
MODELS = ("equal_weight_rank", "metric:trailing_return", "metric:beta")
LAGS, LOCKED, FOLDS, BLOCK = 2, 8, 3, 6


def query(name: str, oracle: str | None = None, by: str = "supplier"):
    """Register a function of a universe as a query."""

    def keep(f: Callable[[Universe], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Universe(spark, sf_dir, by))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return keep


def r6(*names: str) -> list[F.Column]:
    """Rounded to six decimals; adding zero turns a negative zero into zero."""
    return [(F.round(F.col(n), 6) + F.lit(0.0)).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0e0 AS {n}" for n in names)


# Sources and contracts

for _by in ("supplier", "brand", "nation"):
    query(f"prices_{dict(supplier='supp', brand='brand', nation='nation')[_by]}_week", sql.PRICES[_by], _by)(lambda u: u.prices)

query("calendar_positions", f"WITH {sql.base()} SELECT session, pos FROM cal")(lambda u: u.calendar)
query("dense_grid", f"WITH {sql.base()} SELECT symbol, pos, session, price, bench FROM grid")(lambda u: u.grid.select("symbol", "pos", "session", "price", "bench"))
query("adjacent_returns", f"WITH {sql.base()} SELECT symbol, pos, {s6('r', 'b')} FROM ret")(lambda u: G.adjacent_returns(u.grid).select("symbol", "pos", *r6("r", "b")))
query("active_members", f"WITH {sql.base()} SELECT as_of_date, symbol FROM act")(lambda u: u.active)


def _broken_prices(u: Universe) -> DataFrame:
    """Prices with planted faults: repeated keys, blanks and nonpositive values by rule."""
    p = u.prices
    price = F.when(F.col("symbol") % 7 == 0, -F.col("price")).otherwise(F.col("price"))
    name = F.when(F.col("symbol") % 11 == 0, F.lit(" ")).otherwise(F.col("symbol").cast("string"))
    base = p.select(F.col("session").alias("date"), name.alias("symbol"), price.alias("adjusted_close"))
    return base.unionByName(base.where(F.col("symbol") == "5"))


_BROKEN = f"WITH {sql.base()}, b0 AS (SELECT session AS date, CASE WHEN symbol % 11 = 0 THEN ' ' ELSE CAST(symbol AS VARCHAR) END AS symbol, CASE WHEN symbol % 7 = 0 THEN -price ELSE price END AS adjusted_close FROM pw), b AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE symbol = '5')"
query("price_contract_violations", f"""{_BROKEN} SELECT (SELECT count(*) FROM b) AS rows, (SELECT count(*) FROM b WHERE date IS NULL) AS bad_dates, (SELECT count(*) FROM b WHERE trim(symbol) = '') AS bad_symbols,
    (SELECT count(*) FROM b WHERE NOT adjusted_close > 0) AS bad_prices, (SELECT count(*) FROM (SELECT 1 FROM b GROUP BY date, upper(trim(symbol)) HAVING count(*) > 1)) AS duplicate_keys""")(lambda u: C.price_violations(_broken_prices(u)))
query("duplicate_keys", f"{_BROKEN} SELECT date, symbol, count(*) AS count FROM b GROUP BY date, symbol HAVING count(*) > 1")(lambda u: C.duplicate_keys(_broken_prices(u), ["date", "symbol"]))


def _overlapping(u: Universe) -> DataFrame:
    """Memberships with every second interval begun 500 days earlier."""
    early = F.when((F.col("symbol") % 2 == 0) & (F.col("effective_from") > F.lit(date(1996, 1, 1))), F.date_sub("effective_from", 500)).otherwise(F.col("effective_from"))
    return C.membership_overlaps(u.members.withColumn("effective_from", early)).select("symbol", "effective_from", "previous_to")


query("membership_overlaps", f"""WITH {sql.base()}, m AS (SELECT symbol, CASE WHEN symbol % 2 = 0 AND effective_from > DATE '1996-01-01' THEN effective_from - 500 ELSE effective_from END AS effective_from, effective_to FROM mem),
    o AS (SELECT *, lag(effective_to) OVER (PARTITION BY symbol ORDER BY effective_from, effective_to NULLS LAST) AS previous_to, row_number() OVER (PARTITION BY symbol ORDER BY effective_from, effective_to NULLS LAST) AS n FROM m)
    SELECT symbol, CAST(effective_from AS DATE) AS effective_from, previous_to FROM o WHERE n > 1 AND (previous_to IS NULL OR effective_from < previous_to)""")(_overlapping)
query("calendar_missing_sessions", f"""WITH {sql.base()} SELECT s.symbol, c.session FROM (SELECT symbol, min(session) AS a, max(session) AS z FROM pw GROUP BY symbol) s JOIN cal c ON c.session BETWEEN a AND z
    WHERE NOT EXISTS (SELECT 1 FROM pw WHERE pw.symbol = s.symbol AND pw.session = c.session)""")(lambda u: G.missing_sessions(u.prices, u.calendar))
query("off_calendar_prices", f"WITH {sql.base()} SELECT session, symbol, price FROM pw WHERE session NOT IN (SELECT session FROM cal WHERE pos % 10 <> 3)")(lambda u: G.off_calendar(u.prices, u.calendar.where("pos % 10 <> 3")).select("session", "symbol", "price"))

_COVER = f"""WITH {sql.base()},
h AS (SELECT symbol, session AS as_of_date, price IS NOT NULL AS dp, coalesce(lag(price, 26) OVER o IS NOT NULL, false) AS sp,
      coalesce(lead(price, 1) OVER o IS NOT NULL AND lead(price, 5) OVER o IS NOT NULL, false) AS lp,
      CAST(price IS NOT NULL AND bench IS NOT NULL AND coalesce(lag(price IS NOT NULL AND bench IS NOT NULL) OVER o, false) AS INTEGER) AS both_there, pos FROM grid WINDOW o AS (PARTITION BY symbol ORDER BY pos)),
h2 AS (SELECT *, sum(both_there) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS paired FROM h),
c AS (SELECT act.as_of_date, act.symbol, dp, sp, lp, paired FROM act LEFT JOIN h2 USING (as_of_date, symbol))
SELECT {{key}}, count(*) AS active_count, count(dp) AS known_count, count(*) FILTER (dp) AS decision_price_count, count(*) FILTER (sp) AS start_price_count, count(*) FILTER (paired >= 13) AS eligible_count,
       count(*) FILTER (paired = 0) AS no_history_count, count(*) FILTER (lp) AS label_price_count, count(*) FILTER (lp AND paired >= 13) AS usable_count FROM c GROUP BY {{key}}"""


def _coverage(u: Universe) -> tuple[DataFrame, DataFrame]:
    return A.coverage(u.grid, u.dates, u.members, lookback=26, least=13, horizon=4, lag=1)


query("coverage_by_date", _COVER.format(key="as_of_date"))(lambda u: _coverage(u)[0])
query("coverage_by_security", _COVER.format(key="symbol"))(lambda u: _coverage(u)[1])

# The panel

_FEATURES = ["feature_window_start", "observation_count", "feature_status", "window_start_price_available", "decision_price_available", "feature_eligible"]
query("panel_features", f"WITH {sql.panel()} SELECT as_of_date, symbol, {s6(*P.METRICS)}, {', '.join(_FEATURES)} FROM feat")(lambda u: P.trailing_metrics(u.grid, u.calendar, u.active, CONFIG).select("as_of_date", "symbol", *r6(*P.METRICS), *_FEATURES))
query("panel_drawdown", f"WITH {sql.panel()} SELECT as_of_date, symbol, {s6('max_drawdown')} FROM feat")(lambda u: P.trailing_metrics(u.grid, u.calendar, u.active, CONFIG).select("as_of_date", "symbol", *r6("max_drawdown")))
_LABELS = ["label_start_date", "label_end_date", "target_available", "target_status"]
_RETURNS = ["forward_return", "benchmark_forward_return", "forward_excess_return"]
query("panel_labels", f"WITH {sql.panel()} SELECT as_of_date, symbol, {', '.join(_LABELS)}, {s6(*_RETURNS)} FROM lab")(lambda u: P.forward_labels(u.grid, u.calendar, u.bench, u.active, CONFIG).select("as_of_date", "symbol", *_LABELS, *r6(*_RETURNS)))
query("panel_target_rank", f"WITH {sql.panel()} SELECT as_of_date, symbol, {s6('forward_excess_rank')} FROM lab")(lambda u: P.forward_labels(u.grid, u.calendar, u.bench, u.active, CONFIG).select("as_of_date", "symbol", *r6("forward_excess_rank")))
query("panel_status_counts", f"WITH {sql.panel()} SELECT feature_status, target_status, count(*) AS n FROM panel GROUP BY ALL")(lambda u: u.panel.groupBy("feature_status", "target_status").agg(F.count("*").alias("n")))
_FULL = ["as_of_date", "symbol", *_FEATURES, *_LABELS]
query("panel_full", f"WITH {sql.panel()} SELECT {', '.join(_FULL)}, {s6(*P.METRICS, *_RETURNS, 'forward_excess_rank')} FROM panel")(lambda u: u.panel.select(*_FULL, *r6(*P.METRICS, *_RETURNS, "forward_excess_rank")))
query("row_ids", f"WITH {sql.base()} SELECT as_of_date, symbol, 'qmr_' || sha256(CAST(CAST(epoch(as_of_date) AS BIGINT) * 1000000000 AS VARCHAR) || '|' || CAST(symbol AS VARCHAR)) AS row_id FROM act")(lambda u: u.active.select("as_of_date", "symbol", C.row_id(name="symbol").alias("row_id")))

for _name in P.FACTORS:
    query(f"factor_{_name.split('_skip')[0]}", f"WITH {sql.base('brand')}, {sql.factor(_name)} SELECT symbol, session, round(CASE WHEN status = 'ok' THEN v END, 6) + 0.0e0 AS value, status, seen AS observed, CASE WHEN status <> 'insufficient_history' THEN ws END AS window_start, we AS window_end FROM f", "brand")(
        lambda u, n=_name: P.price_factors(u.grid, (n,)).select("symbol", "session", (F.round(n, 6) + F.lit(0.0)).alias("value"), F.col(f"{n}_status").alias("status"), F.col(f"{n}_observed_price_count").alias("observed"), F.col(f"{n}_window_start").alias("window_start"), F.col(f"{n}_window_end").alias("window_end"))
    )


def _factor_counts(u: Universe) -> DataFrame:
    made = P.price_factors(u.grid)
    kinds = [F.struct(F.lit(n).alias("factor"), F.col(f"{n}_status").alias("status")) for n in P.FACTORS]
    return made.select(F.explode(F.array(*kinds)).alias("x")).groupBy("x.factor", "x.status").agg(F.count("*").alias("n"))


query("factor_status_counts", f"WITH {sql.base('brand')}, " + ", ".join(sql.factor(n).replace("f0 AS", f"g{i} AS").replace("FROM f0", f"FROM g{i}").replace("\nf AS", f"\nh{i} AS") for i, n in enumerate(P.FACTORS)) + " " + " UNION ALL ".join(f"SELECT '{n}' AS factor, status, count(*) AS n FROM h{i} GROUP BY status" for i, n in enumerate(P.FACTORS)), "brand")(_factor_counts)
query("panel_with_factors", f"WITH {sql.panel('brand')}, {sql.factor('return_21s')} SELECT panel.as_of_date, panel.symbol, {s6('beta')}, round(CASE WHEN status = 'ok' THEN v END, 6) + 0.0e0 AS return_21s, status AS return_21s_status FROM panel LEFT JOIN f ON f.session = panel.as_of_date AND f.symbol = panel.symbol", "brand")(
    lambda u: P.add_factors(u.panel, P.price_factors(u.grid)).select("as_of_date", "symbol", *r6("beta", "return_21s"), "return_21s_status")
)

# Screening

_LONG = f"WITH {sql.panel()}, {sql.long(SIGNALS, 'as_of_date, forward_excess_return')}"
_IC = f"{_LONG}, {sql.ic('ic', 'long', 'feature, as_of_date', 'value', 'forward_excess_return')}"
_SCHEDULED = f"{_IC}, sch AS (SELECT DISTINCT as_of_date FROM panel), sic AS (SELECT feature, as_of_date, rank_ic FROM (SELECT DISTINCT feature FROM ic) CROSS JOIN sch LEFT JOIN ic USING (feature, as_of_date))"


def _ic(u: Universe) -> DataFrame:
    return S.daily_rank_ic(u.panel, list(SIGNALS), TARGET, u.least)


query("feature_quality", f"""{_LONG}, d AS (SELECT feature, as_of_date, count(*) AS n, count(value) AS k FROM long GROUP BY ALL),
    q AS (SELECT feature, count(DISTINCT value) AS distinct_count FROM long GROUP BY feature)
    SELECT feature, CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(k) AS BIGINT) AS nonnull_count, round(sum(k) / sum(n), 6) AS coverage, round(avg(k / n), 6) AS mean_date_coverage, round(min(k / n), 6) AS min_date_coverage,
           any_value(distinct_count) <= 1 AS zero_variance FROM d JOIN q USING (feature) GROUP BY feature""")(lambda u: S.feature_quality(u.panel, list(SIGNALS)).select("feature", "row_count", "nonnull_count", *r6("coverage", "mean_date_coverage", "min_date_coverage"), "zero_variance"))
query("daily_rank_ic", f"{_IC} SELECT feature, as_of_date, pairs, {s6('rank_ic')} FROM ic")(lambda u: _ic(u).select("feature", "as_of_date", "pairs", *r6("rank_ic")))
query("newey_west_t", f"{_IC}, {sql.hac('h', 'ic', 'feature', 'as_of_date', 'rank_ic', LAGS)} SELECT feature, n, {s6('mean', 'hac_t', 'hac_p')} FROM h")(lambda u: ST.newey_west(_ic(u), ["feature"], "as_of_date", "rank_ic", LAGS).select("feature", "n", *r6("mean", "hac_t", "hac_p")))
_SUMMARY = f"""{_SCHEDULED}, {sql.hac('h', 'sic', 'feature', 'as_of_date', 'rank_ic', LAGS)},
    st AS (SELECT feature, avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS std_rank_ic, avg(CAST(rank_ic > 0 AS DOUBLE)) AS positive_rate, count(*) AS date_count FROM ic GROUP BY feature),
    j AS (SELECT st.*, h.n AS scheduled_count, hac_t, hac_p, CASE WHEN n_values < n THEN 'missing_scheduled_values' WHEN n < 2 THEN 'insufficient_observations' WHEN {LAGS} > n - 1 THEN 'insufficient_lag_support' WHEN hac_t IS NULL THEN 'undefined_variance' ELSE 'ok' END AS inference_status FROM st JOIN h USING (feature)),
    {sql.bh('b', 'j')}"""
query("ic_summary", f"{_SUMMARY} SELECT feature, {s6('mean_rank_ic', 'std_rank_ic', 'positive_rate')}, date_count, scheduled_count, {s6('hac_t', 'hac_p', 'q_value')}, inference_status, CASE WHEN inference_status = 'ok' THEN {LAGS} END AS effective_lags FROM b")(
    lambda u: S.ic_summary(_ic(u), LAGS, u.panel.select("as_of_date")).select("feature", *r6("mean_rank_ic", "std_rank_ic", "positive_rate"), "date_count", "scheduled_count", *r6("hac_t", "hac_p", "q_value"), "inference_status", "effective_lags")
)
query("bh_q_values", f"{_IC}, {sql.hac('h', 'ic', 'feature', 'as_of_date', 'rank_ic', LAGS)}, {sql.bh('b', 'h')} SELECT feature, {s6('hac_p', 'q_value')} FROM b")(lambda u: ST.bh_q_values(ST.newey_west(_ic(u), ["feature"], "as_of_date", "rank_ic", LAGS), "hac_p").select("feature", *r6("hac_p", "q_value")))
query("quantile_spreads", f"{_LONG}, {sql.spread('s', 'long', 'feature, as_of_date', 'value', 'forward_excess_return')} SELECT feature, as_of_date, pairs, {s6('spread')} FROM s WHERE pairs >= 20")(lambda u: S.quantile_spreads(u.panel, list(SIGNALS), TARGET, u.quantiles, u.least).select("feature", "as_of_date", "pairs", *r6("spread")))
_PAIRS = " UNION ALL ".join(f"SELECT as_of_date, '{a}' AS lft, '{b}' AS rgt, {a} AS x, {b} AS y FROM panel" for i, a in enumerate(SIGNALS) for b in SIGNALS[i + 1 :])
query("redundancy_pairs", f"""WITH {sql.panel()}, pairs0 AS ({_PAIRS}), pr AS (SELECT * FROM pairs0 WHERE x IS NOT NULL AND y IS NOT NULL), {sql.ic('ic', 'pr', 'lft, rgt, as_of_date', 'x', 'y')}
    SELECT lft AS "left", rgt AS "right", round(tanh(avg(atanh(greatest(-0.999999999999e0, least(0.999999999999e0, rank_ic))))), 6) AS mean_spearman, round(avg(abs(rank_ic)), 6) AS mean_abs_spearman, count(*) AS date_count FROM ic GROUP BY lft, rgt""")(
    lambda u: S.redundancy(u.panel, list(SIGNALS), u.least).select("left", "right", *r6("mean_spearman", "mean_abs_spearman"), "date_count")
)


def _selection(u: Universe) -> DataFrame:
    # The panel feeds four tables here.
    panel = u.panel.select("as_of_date", "symbol", "label_end_date", TARGET, *SIGNALS).persist()
    picked = S.metric_screen(panel, list(SIGNALS), TARGET, date(2000, 1, 1), least=u.least, lags=LAGS, least_coverage=0.5, threshold=0.9)
    panel.unpersist()
    return u.spark.createDataFrame(picked["selection"], "feature string, selected boolean, reason string")


_SCREEN = f"""WITH RECURSIVE {sql.panel()}, tp AS (SELECT * FROM panel WHERE as_of_date <= DATE '2000-01-01'), {sql.long(SIGNALS, 'as_of_date, forward_excess_return', 'tp')}, {sql.ic('ic', 'long', 'feature, as_of_date', 'value', 'forward_excess_return')},
ql AS (SELECT feature, count(value) / count(*) AS coverage, count(DISTINCT value) <= 1 AS flat FROM long GROUP BY feature), mi AS (SELECT feature, avg(rank_ic) AS mean FROM ic GROUP BY feature),
pairs0 AS ({" UNION ALL ".join(f"SELECT as_of_date, '{a}' AS lft, '{b}' AS rgt, {a} AS x, {b} AS y FROM tp" for i, a in enumerate(SIGNALS) for b in SIGNALS[i + 1 :])}), pr AS (SELECT * FROM pairs0 WHERE x IS NOT NULL AND y IS NOT NULL), {sql.ic('pic', 'pr', 'lft, rgt, as_of_date', 'x', 'y')},
cl AS (SELECT lft, rgt FROM pic GROUP BY lft, rgt HAVING avg(abs(rank_ic)) >= 0.9), twins AS (SELECT feature, list(other) AS others FROM (SELECT lft AS feature, rgt AS other FROM cl UNION ALL SELECT rgt, lft FROM cl) GROUP BY feature),
od AS (SELECT feature, coalesce(others, []) AS others, row_number() OVER (ORDER BY CASE WHEN mean IS NULL THEN 1 ELSE -abs(mean) END, coverage DESC, feature) AS k,
  CASE WHEN flat THEN 'zero_variance' WHEN coverage < 0.5 THEN 'low_coverage' WHEN mean IS NULL THEN 'insufficient_rank_ic' END AS base FROM ql LEFT JOIN mi USING (feature) LEFT JOIN twins USING (feature)),
gr AS (SELECT CAST(0 AS BIGINT) AS k, '' AS feature, CAST(NULL AS VARCHAR) AS reason, CAST([] AS VARCHAR[]) AS kept UNION ALL
  SELECT k, feature, reason, CASE WHEN reason IS NULL THEN list_append(kept, feature) ELSE kept END FROM (SELECT od.k, od.feature, coalesce(base, 'redundant_with:' || list_filter(gr.kept, lambda x: list_contains(others, x))[1]) AS reason, gr.kept FROM gr JOIN od ON od.k = gr.k + 1))
SELECT feature, reason IS NULL AS selected, reason FROM gr WHERE k > 0"""
query("metric_screen", _SCREEN)(_selection)

# Splits

_SPLIT = f"""WITH {sql.panel()},
di AS (SELECT as_of_date, row_number() OVER (ORDER BY as_of_date) - 1 AS i, count(*) OVER () AS total FROM (SELECT DISTINCT as_of_date FROM panel)),
wf0 AS (SELECT CAST((i - (total - 18)) // 6 + 1 AS INTEGER) AS fold, as_of_date, i FROM di WHERE i >= total - 18),
wf AS (SELECT fold, min(as_of_date) AS test_start, max(as_of_date) AS test_end FROM wf0 GROUP BY fold HAVING min(i) >= 10),
ld AS (SELECT as_of_date, count(CASE WHEN label_end_date IS NOT NULL THEN forward_excess_return END) AS labelled FROM panel GROUP BY as_of_date),
lb AS (SELECT as_of_date, labelled, labelled >= 20 AS enough FROM (SELECT *, row_number() OVER (ORDER BY as_of_date DESC) AS r FROM ld WHERE as_of_date <= (SELECT max(as_of_date) FROM ld WHERE labelled > 0)) WHERE r <= {LOCKED}),
lk AS (SELECT min(as_of_date) AS lock_start FROM lb),
sd AS (SELECT as_of_date, row_number() OVER (ORDER BY as_of_date) - 1 AS i, count(*) OVER () AS total FROM (SELECT DISTINCT as_of_date FROM panel, lk WHERE forward_excess_return IS NOT NULL AND label_end_date < lock_start AND as_of_date < lock_start)),
ob AS (SELECT fold, min(as_of_date) AS evaluation_start, max(as_of_date) AS evaluation_end FROM (SELECT CAST((i - (total - {FOLDS * BLOCK})) // {BLOCK} + 1 AS INTEGER) AS fold, as_of_date FROM sd WHERE i >= total - {FOLDS * BLOCK}) GROUP BY fold),
fa0 AS (SELECT panel.as_of_date, panel.symbol, fold, evaluation_start, forward_excess_return, label_end_date,
  CASE WHEN panel.as_of_date >= lock_start THEN 'locked_test' WHEN label_end_date >= lock_start THEN 'locked_test_overlap'
       WHEN panel.as_of_date BETWEEN evaluation_start AND evaluation_end AND sd.as_of_date IS NOT NULL THEN CASE WHEN label_end_date IS NULL THEN 'missing_label' WHEN forward_excess_return IS NULL THEN 'missing_target' END
       WHEN panel.as_of_date BETWEEN evaluation_start AND evaluation_end THEN 'gap_date'
       WHEN panel.as_of_date < evaluation_start THEN CASE WHEN label_end_date IS NULL THEN 'missing_label' WHEN forward_excess_return IS NULL THEN 'missing_target' WHEN label_end_date >= evaluation_start THEN 'label_overlap' END
       ELSE 'future_of_evaluation' END AS exclusion_reason
  FROM panel CROSS JOIN ob CROSS JOIN lk LEFT JOIN sd ON sd.as_of_date = panel.as_of_date),
fa AS (SELECT *, CASE WHEN exclusion_reason IS NOT NULL THEN 'excluded' WHEN as_of_date >= evaluation_start THEN 'evaluation' ELSE 'training' END AS role FROM fa0)"""


# Splits read ``u.targets``, or the panel where a query reads more of it anyway.


def _walk(panel: DataFrame) -> DataFrame:
    return SP.walk_forward(panel, folds=3, test_dates=6, least_train=10)


def _lock(u: Universe, panel: DataFrame) -> DataFrame:
    return SP.lockbox(panel, TARGET, dates=LOCKED, least_rows=u.least)


def _lock_start(u: Universe, panel: DataFrame):
    return _lock(u, panel).agg(F.min("as_of_date")).first()[0]


def _blocks(u: Universe, panel: DataFrame) -> DataFrame:
    return SP.outer_folds(panel, TARGET, _lock_start(u, panel), folds=FOLDS, evaluation_dates=BLOCK)


def _assigned(u: Universe, panel: DataFrame) -> DataFrame:
    start = _lock_start(u, panel)
    return SP.fold_assignments(panel, SP.outer_folds(panel, TARGET, start, folds=FOLDS, evaluation_dates=BLOCK), start, TARGET)


query("walk_forward_folds", f"{_SPLIT} SELECT fold, test_start, test_end FROM wf")(lambda u: _walk(u.targets))
query("walk_forward_roles", f"{_SPLIT} SELECT fold, CASE WHEN as_of_date >= test_start THEN 'test' WHEN label_end_date < test_start THEN 'training' ELSE 'purged' END AS role, count(*) AS n FROM panel JOIN wf ON as_of_date <= test_end GROUP BY ALL")(lambda u: SP.walk_forward_rows(u.targets, _walk(u.targets)).groupBy("fold", "role").agg(F.count("*").alias("n")))
query("lockbox_dates", f"{_SPLIT} SELECT as_of_date, labelled, enough FROM lb")(lambda u: _lock(u, u.targets))
query("outer_folds", f"{_SPLIT} SELECT fold, evaluation_start, evaluation_end FROM ob")(lambda u: _blocks(u, u.targets))
query("fold_assignments", f"{_SPLIT} SELECT as_of_date, symbol, fold, role, exclusion_reason FROM fa")(lambda u: _assigned(u, u.targets).select("as_of_date", "symbol", "fold", "role", "exclusion_reason"))
query("phase_schedule", f"{_SPLIT} SELECT DISTINCT as_of_date FROM panel WHERE as_of_date BETWEEN (SELECT min(evaluation_start) FROM ob) AND (SELECT max(evaluation_end) FROM ob)")(lambda u: SP.phase_schedule(u.targets, _blocks(u, u.targets)))
query("training_weights", f"{_SPLIT}, t AS (SELECT * FROM fa WHERE role = 'training') SELECT fold, as_of_date, symbol, round(count(*) OVER (PARTITION BY fold) / (SELECT count(DISTINCT as_of_date) FROM t t2 WHERE t2.fold = t.fold) / count(*) OVER (PARTITION BY fold, as_of_date), 6) AS weight FROM t")(
    lambda u: SP.training_weights(_assigned(u, u.targets).where("role = 'training'"), ["fold"]).select("fold", "as_of_date", "symbol", *r6("weight"))
)
query("maturity_mask", f"WITH {sql.panel()} SELECT as_of_date, symbol, round(CASE WHEN label_end_date <= DATE '1999-06-01' THEN forward_excess_return END, 6) + 0.0e0 AS forward_excess_return FROM panel")(lambda u: SP.maturity_mask(u.targets, TARGET, date(1999, 6, 1)).select("as_of_date", "symbol", *r6(TARGET)))
query("training_cross_sections", f"{_SPLIT} SELECT fold, as_of_date, symbol, round(CASE WHEN role = 'training' THEN forward_excess_return END, 6) + 0.0e0 AS forward_excess_return, CASE WHEN role = 'training' THEN label_end_date END AS label_end_date FROM fa WHERE EXISTS (SELECT 1 FROM fa f2 WHERE f2.fold = fa.fold AND f2.as_of_date = fa.as_of_date AND f2.role = 'training')")(
    lambda u: SP.training_cross_sections(_assigned(u, u.targets), TARGET).select("fold", "as_of_date", "symbol", *r6(TARGET), "label_end_date")
)
query("evaluation_cross_sections", f"{_SPLIT} SELECT fold, as_of_date, symbol, round(CASE WHEN label_end_date < lock_start THEN forward_excess_return END, 6) + 0.0e0 AS forward_excess_return FROM panel JOIN ob ON as_of_date BETWEEN evaluation_start AND evaluation_end, lk")(
    lambda u: SP.evaluation_cross_sections(u.targets, _blocks(u, u.targets), TARGET, _lock_start(u, u.targets)).select("fold", "as_of_date", "symbol", *r6(TARGET))
)
_REPORT = f"""{_SPLIT}, wr AS (SELECT *, CASE WHEN as_of_date >= test_start THEN 'test' WHEN label_end_date < test_start THEN 'training' ELSE 'purged' END AS role FROM panel JOIN wf ON as_of_date <= test_end),
wr1 AS (SELECT * FROM wr WHERE role <> 'purged'), {sql.long(SIGNALS, 'fold, role, as_of_date, forward_excess_return', 'wr1', 'wl')}, {sql.ic('ic', 'wl', 'fold, role, feature, as_of_date', 'value', 'forward_excess_return')},
wt AS (SELECT * FROM wl WHERE role = 'test'), {sql.spread('s', 'wt', 'fold, feature, as_of_date', 'value', 'forward_excess_return')},
sm AS (SELECT fold, feature, avg(spread) AS mean_spread FROM s WHERE pairs >= 5 GROUP BY fold, feature),
tt AS (SELECT fold, feature, avg(CASE WHEN role = 'training' THEN rank_ic END) AS train_ic, avg(CASE WHEN role = 'test' THEN rank_ic END) AS test_ic FROM ic GROUP BY fold, feature),
ta AS (SELECT *, sign(train_ic) * test_ic AS adjusted_ic FROM tt LEFT JOIN sm USING (fold, feature))"""
query("walk_forward_report", f"{_REPORT} SELECT fold, feature, {s6('train_ic', 'test_ic', 'adjusted_ic', 'mean_spread')} FROM ta")(
    lambda u: E.walk_forward_report(SP.walk_forward_rows(u.panel, _walk(u.panel)), list(SIGNALS), TARGET, u.least, u.quantiles).select("fold", "feature", *r6("train_ic", "test_ic", "adjusted_ic", "mean_spread"))
)
_ROLLUP = ["mean_test_ic", "median_test_ic", "positive_fold_rate", "mean_directional_ic", "direction_consistency_rate", "mean_test_spread"]
query("walk_forward_rollup", f"""{_REPORT}, ru AS (SELECT feature, count(*) AS fold_count, count(test_ic) AS test_fold_count, avg(test_ic) AS mean_test_ic, median(test_ic) AS median_test_ic, avg(CAST(test_ic > 0 AS DOUBLE)) AS positive_fold_rate,
    avg(CASE WHEN train_ic <> 0 THEN adjusted_ic END) AS mean_directional_ic, avg(CASE WHEN train_ic <> 0 THEN CAST(adjusted_ic > 0 AS DOUBLE) END) AS direction_consistency_rate, avg(mean_spread) AS mean_test_spread FROM ta GROUP BY feature)
    SELECT feature, fold_count, test_fold_count, {s6(*_ROLLUP)} FROM ru""")(
    lambda u: E.walk_forward_rollup(E.walk_forward_report(SP.walk_forward_rows(u.panel, _walk(u.panel)), list(SIGNALS), TARGET, u.least, u.quantiles)).select("feature", "fold_count", "test_fold_count", *r6(*_ROLLUP))
)
query("preflight_dates", f"WITH {sql.panel()} SELECT as_of_date, count(*) AS row_count, count(forward_excess_return) AS target_count, count(forward_return) AS return_count, count(forward_excess_return) >= 20 AS ic_evaluable, count(forward_return) >= 20 AS spread_evaluable FROM panel GROUP BY as_of_date")(lambda u: A.preflight_dates(u.targets, TARGET, "forward_return", u.least))

# Baselines and evaluation

_RANKED = ", ".join(f"{sql.pct(f, 'as_of_date')} AS rank_{f}" for f in SIGNS)
_SIGNED = ", ".join(f"rank_{f}" if s > 0 else f"1 - rank_{f}" for f, s in SIGNS.items())
_SCORES = f"""{_SPLIT}, rk AS (SELECT as_of_date, symbol, label_end_date, forward_excess_return, forward_return, {_RANKED} FROM panel),
eq AS (SELECT *, list_filter([{_SIGNED}], lambda x: x IS NOT NULL) AS kept FROM rk),
sc AS (SELECT *, len(kept) AS feature_count, CASE WHEN len(kept) > 0 THEN list_sum(kept) / len(kept) END AS equal_score FROM eq)"""
_PREDICTIONS = f"""{_SCORES},
pe AS (SELECT 'development' AS phase, fold, as_of_date, symbol, forward_excess_return AS target, forward_return AS realized_return, equal_score, rank_trailing_return, rank_beta FROM sc JOIN ob ON as_of_date BETWEEN evaluation_start AND evaluation_end),
pd AS (SELECT phase, fold, as_of_date, symbol, 'equal_weight_rank' AS model, equal_score AS score, target, realized_return FROM pe UNION ALL
       SELECT phase, fold, as_of_date, symbol, 'metric:trailing_return', rank_trailing_return, target, realized_return FROM pe UNION ALL
       SELECT phase, fold, as_of_date, symbol, 'metric:beta', rank_beta, target, realized_return FROM pe)"""


def predictions(u: Universe) -> DataFrame:
    """Scores of the fixed baselines over the outer folds' date ranges, for everyone in them."""
    wide = E.signed_ranks(u.panel.select("as_of_date", "symbol", TARGET, "forward_return", *SIGNS), dict.fromkeys(SIGNS, 1))
    _, equal = E.mean_rank([F.col(f"_rank_{f}") if sign > 0 else 1 - F.col(f"_rank_{f}") for f, sign in SIGNS.items()])
    rows = on_each(wide.withColumn("equal_weight_rank", equal), _blocks(u, u.panel), SP.MOST_FOLDS).where(F.col("as_of_date").between(F.col("evaluation_start"), F.col("evaluation_end")))
    scores = {"equal_weight_rank": F.col("equal_weight_rank"), "metric:trailing_return": F.col("_rank_trailing_return"), "metric:beta": F.col("_rank_beta")}
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), s.alias("score")) for m, s in scores.items()])).alias("m")
    out = rows.select(F.lit("development").alias("phase"), "fold", "as_of_date", "symbol", kinds, F.col(TARGET).alias("target"), F.col("forward_return").alias("realized_return"))
    return out.select("phase", "fold", "as_of_date", "symbol", "m.model", "m.score", "target", "realized_return")


def _daily_ctes(name: str, source: str, universe: str) -> str:
    keys = "phase, fold, as_of_date, model"
    return f"""{sql.ic(name + '_ic', source, keys, 'score', 'target', None)}, {sql.spread(name + '_sp', source, keys, 'score', 'realized_return')},
{name}_n AS (SELECT {keys}, max({universe}) AS universe_count, count(score) AS score_count, count(CASE WHEN score IS NOT NULL THEN target END) AS ic_pairs, count(CASE WHEN score IS NOT NULL THEN realized_return END) AS spread_pairs, count(DISTINCT score) AS distinct_scores FROM {source} GROUP BY {keys}),
{name} AS (SELECT {keys}, universe_count, score_count, CASE WHEN i.pairs >= 20 THEN rank_ic END AS rank_ic, CASE WHEN s.pairs >= 20 AND scores > 1 THEN spread END AS spread,
  score_count / universe_count AS score_coverage, ic_pairs / universe_count AS ic_coverage, spread_pairs / universe_count AS spread_coverage, CASE WHEN score_count > 0 THEN 1 - distinct_scores / score_count END AS tied_fraction
  FROM {name}_n LEFT JOIN {name}_ic i USING ({keys}) LEFT JOIN {name}_sp s USING ({keys}))"""


_NATIVE = f"{_PREDICTIONS}, pn AS (SELECT *, count(*) OVER (PARTITION BY phase, fold, as_of_date, model) AS everyone FROM pd), {_daily_ctes('dm', 'pn', 'everyone')}"
_COMMON = f"{_PREDICTIONS}, pn AS (SELECT *, count(*) OVER (PARTITION BY phase, fold, as_of_date, model) AS everyone, count(score) OVER (PARTITION BY phase, fold, as_of_date, symbol) AS scored FROM pd), pc AS (SELECT * FROM pn WHERE scored = 3), {_daily_ctes('dm', 'pc', 'everyone')}"
_DAILY = ["rank_ic", "spread", "score_coverage", "ic_coverage", "spread_coverage", "tied_fraction"]
_ROLLED = """count(*) AS date_count, count(rank_ic) AS ic_date_count, avg(rank_ic) AS mean_rank_ic, median(rank_ic) AS median_rank_ic, stddev_samp(rank_ic) AS std_rank_ic, avg(CAST(rank_ic > 0 AS DOUBLE)) AS positive_date_rate,
  avg(spread) AS mean_spread, count(spread) AS spread_date_count, avg(score_coverage) AS mean_score_coverage, CASE WHEN stddev_samp(rank_ic) > 0 THEN avg(rank_ic) / stddev_samp(rank_ic) END AS information_ratio"""
_ROLLED_COLUMNS = ["mean_rank_ic", "median_rank_ic", "std_rank_ic", "positive_date_rate", "mean_spread", "mean_score_coverage", "information_ratio"]


def native(u: Universe) -> DataFrame:
    return E.native_daily_metrics(predictions(u), u.least, u.quantiles)


query("baseline_signs", f"{_IC} SELECT feature, {s6('avg_ic').replace('avg_ic', 'mean_rank_ic')}, CAST(CASE WHEN abs(mean_rank_ic) > 1e-12 THEN sign(mean_rank_ic) END AS INTEGER) AS direction FROM (SELECT feature, avg(rank_ic) AS mean_rank_ic FROM ic GROUP BY feature)")(lambda u: E.baseline_signs(_ic(u)).select("feature", *r6("mean_rank_ic"), "direction"))
query("best_metric", f"{_IC} SELECT feature, {s6('mean_rank_ic')} FROM (SELECT feature, avg(rank_ic) AS mean_rank_ic FROM ic GROUP BY feature) WHERE abs(mean_rank_ic) > 1e-12 ORDER BY abs(mean_rank_ic) DESC, feature LIMIT 1")(lambda u: E.best_metric(E.baseline_signs(_ic(u))).select("feature", *r6("mean_rank_ic")))
query("baseline_scores", f"{_SCORES} SELECT as_of_date, symbol, round(rank_trailing_return, 6) AS trailing_return, round(1 - rank_annualized_volatility, 6) AS annualized_volatility, round(rank_beta, 6) AS beta FROM sc")(
    lambda u: E.signed_ranks(u.panel, SIGNS).select("as_of_date", "symbol", *[F.round(f"_rank_{f}", 6).alias(f) for f in SIGNS])
)
query("equal_weight_scores", f"{_SCORES} SELECT as_of_date, symbol, CAST(feature_count AS INTEGER) AS feature_count, round(equal_score, 6) AS score FROM sc")(lambda u: E.equal_weight_scores(u.panel, SIGNS).select("as_of_date", "symbol", "feature_count", *r6("score")))
query("native_daily_metrics", f"{_NATIVE} SELECT phase, fold, as_of_date, model, universe_count, score_count, {s6(*_DAILY)} FROM dm")(lambda u: native(u).select(*E.KEYS, "universe_count", "score_count", *r6(*_DAILY)))
query("common_daily_metrics", f"{_COMMON} SELECT phase, fold, as_of_date, model, universe_count, score_count, {s6(*_DAILY)} FROM dm")(lambda u: E.common_daily_metrics(predictions(u), list(MODELS), u.least, u.quantiles).select(*E.KEYS, "universe_count", "score_count", *r6(*_DAILY)))
query("fold_metrics", f"{_NATIVE} SELECT phase, fold, model, date_count, ic_date_count, spread_date_count, {s6(*_ROLLED_COLUMNS)} FROM (SELECT phase, fold, model, {_ROLLED} FROM dm GROUP BY phase, fold, model)")(lambda u: E.fold_metrics(native(u)).select("phase", "fold", "model", "date_count", "ic_date_count", "spread_date_count", *r6(*_ROLLED_COLUMNS)))
query("phase_summary", f"{_NATIVE}, {sql.hac('h', 'dm', 'phase, model', 'as_of_date', 'rank_ic', LAGS)} SELECT phase, model, date_count, ic_date_count, {s6(*_ROLLED_COLUMNS, 'hac_t')} FROM (SELECT phase, model, {_ROLLED} FROM dm GROUP BY phase, model) JOIN h USING (phase, model)")(lambda u: E.phase_summary(native(u), LAGS).select("phase", "model", "date_count", "ic_date_count", *r6(*_ROLLED_COLUMNS, "hac_t")))
_DELTAS = f"""{_NATIVE}, sch AS (SELECT DISTINCT as_of_date FROM panel WHERE as_of_date BETWEEN (SELECT min(evaluation_start) FROM ob) AND (SELECT max(evaluation_end) FROM ob)),
wd AS (SELECT as_of_date, max(CASE WHEN model = 'equal_weight_rank' THEN rank_ic END) AS candidate_ic, max(CASE WHEN model = 'metric:beta' THEN rank_ic END) AS reference_ic FROM dm GROUP BY as_of_date),
dl AS (SELECT as_of_date, candidate_ic, reference_ic, candidate_ic - reference_ic AS delta FROM sch LEFT JOIN wd USING (as_of_date))"""


def _deltas(u: Universe) -> DataFrame:
    return E.paired_deltas(native(u), SP.phase_schedule(u.panel, _blocks(u, u.panel)), "equal_weight_rank", "metric:beta")


query("paired_deltas", f"{_DELTAS} SELECT as_of_date, {s6('candidate_ic', 'reference_ic', 'delta')} FROM dl")(lambda u: _deltas(u).select("as_of_date", *r6("candidate_ic", "reference_ic", "delta")))
query("paired_summary", f"{_DELTAS} SELECT count(*) AS scheduled_count, count(candidate_ic) AS candidate_count, count(reference_ic) AS reference_count, count(delta) AS paired_count, round(count(delta) / count(*), 6) AS paired_coverage, round(avg(delta), 6) AS mean_paired_delta FROM dl")(
    lambda u: E.paired_summary(_deltas(u)).select("scheduled_count", "candidate_count", "reference_count", "paired_count", *r6("paired_coverage", "mean_paired_delta"))
)
query("frozen_family", f"{_NATIVE} SELECT model, round(avg(rank_ic), 6) AS mean_rank_ic FROM dm GROUP BY model HAVING avg(rank_ic) IS NOT NULL ORDER BY avg(rank_ic) DESC LIMIT 1")(lambda u: E.frozen_family(E.phase_summary(native(u), LAGS), list(MODELS)).select("model", *r6("mean_rank_ic")))

# Contracts between runs

_TABLE = f"""{_SPLIT}, asg AS (SELECT 'development' AS phase, fold, 'development_fold_' || (fold - 1) AS split_id, as_of_date || '|' || symbol AS row_id, role, exclusion_reason,
  max(CASE WHEN role = 'training' THEN as_of_date END) OVER (PARTITION BY fold) AS train_end_date, max(CASE WHEN role = 'training' THEN label_end_date END) OVER (PARTITION BY fold) AS train_label_end_max, evaluation_start, fe.evaluation_end, as_of_date, symbol, forward_excess_return, forward_return
  FROM (SELECT fa.*, forward_return FROM fa JOIN panel USING (as_of_date, symbol)) f JOIN (SELECT fold, evaluation_end FROM ob) fe USING (fold)),
af AS (SELECT * REPLACE (CASE WHEN symbol % 17 = 0 AND fold = 2 AND role = 'training' THEN 'excluded' ELSE role END AS role, CASE WHEN symbol % 13 = 0 AND fold = 1 AND exclusion_reason IS NULL THEN 'odd' ELSE exclusion_reason END AS exclusion_reason,
  CASE WHEN symbol % 19 = 0 THEN ' ' || row_id ELSE row_id END AS row_id) FROM asg WHERE NOT (symbol % 23 = 0 AND fold = 3))"""


def _table(u: Universe) -> DataFrame:
    row = F.concat(F.col("as_of_date").cast("string"), F.lit("|"), F.col("symbol").cast("string"))
    return CP.assignment_table(_assigned(u, u.targets), row)


def _faulty(u: Universe) -> DataFrame:
    """Assignments with planted faults, by rules on symbol and fold."""
    name = F.split("row_id", "[|]")[1].cast("long")
    rows = _table(u).withColumn("s", name).where(~((F.col("s") % 23 == 0) & (F.col("fold") == 3)))
    rows = rows.withColumn("exclusion_reason", F.when((F.col("s") % 13 == 0) & (F.col("fold") == 1) & F.col("exclusion_reason").isNull(), "odd").otherwise(F.col("exclusion_reason")))
    rows = rows.withColumn("role", F.when((F.col("s") % 17 == 0) & (F.col("fold") == 2) & (F.col("role") == "training"), "excluded").otherwise(F.col("role")))
    return rows.withColumn("row_id", F.when(F.col("s") % 19 == 0, F.concat(F.lit(" "), "row_id")).otherwise(F.col("row_id"))).drop("s")


def _violations(u: Universe) -> DataFrame:
    blocks = _blocks(u, u.targets)
    return CP.assignment_violations(_faulty(u), SP.phase_schedule(u.targets, blocks), folds=FOLDS, fold_dates=BLOCK, start=date(1995, 1, 1), lock_start=date(2001, 6, 1))


query("assignment_violations", f"""{_TABLE}, du AS (SELECT DISTINCT as_of_date FROM panel WHERE as_of_date BETWEEN (SELECT min(evaluation_start) FROM ob) AND (SELECT max(evaluation_end) FROM ob)),
fb AS (SELECT fold, min(train_end_date) AS a, min(train_label_end_max) AS b, min(evaluation_start) AS c, min(evaluation_end) AS d, count(DISTINCT (train_end_date, train_label_end_max, evaluation_start, evaluation_end)) AS kinds FROM af GROUP BY fold),
fd AS (SELECT *, (SELECT count(*) FROM du WHERE as_of_date BETWEEN c AND d) AS dates, lag(d) OVER (ORDER BY fold) AS before FROM fb),
rk2 AS (SELECT row_id, count(*) AS n, count(DISTINCT fold) AS k FROM af GROUP BY row_id)
SELECT unnest(['wrong_phase', 'bad_fold', 'untidy_text', 'unknown_role', 'reason_without_exclusion', 'wrong_split_id', 'duplicate_rows', 'incomplete_rows', 'fold_numbers', 'varying_bounds', 'disordered_bounds', 'overlapping_folds', 'bounds_off_schedule', 'wrong_date_count', 'schedule_span']) AS "check",
 unnest([0, 0, (SELECT count(*) FROM af WHERE trim(row_id) <> row_id), 0, (SELECT count(*) FROM af WHERE (role = 'excluded') <> (exclusion_reason IS NOT NULL)), 0,
  (SELECT coalesce(CAST(sum(n - k) AS BIGINT), 0) FROM rk2), (SELECT count(*) FROM rk2 WHERE k <> {FOLDS}), abs((SELECT count(*) FROM fb) - {FOLDS}), (SELECT count(*) FROM fb WHERE kinds <> 1),
  (SELECT count(*) FROM fb WHERE NOT coalesce(DATE '1995-01-01' <= a AND a < b AND b < c AND c <= d AND d < DATE '2001-06-01', false)), (SELECT count(*) FROM fd WHERE c <= before), (SELECT count(*) FROM fb WHERE c NOT IN (SELECT as_of_date FROM du) OR d NOT IN (SELECT as_of_date FROM du)),
  (SELECT count(*) FROM fd WHERE dates <> {BLOCK}), CASE WHEN (SELECT min(c) FROM fb) = (SELECT min(as_of_date) FROM du) AND (SELECT max(d) FROM fb) = (SELECT max(as_of_date) FROM du) THEN 0 ELSE 1 END]) AS violations""")(_violations)
query("assignment_differences", f"""{_TABLE} SELECT fold, row_id, CASE WHEN r.phase IS NULL THEN 'only_left' WHEN l.phase IS NULL THEN 'only_right' ELSE array_to_string(list_filter([CASE WHEN l.role <> r.role THEN 'role' END, CASE WHEN l.exclusion_reason IS DISTINCT FROM r.exclusion_reason THEN 'exclusion_reason' END], lambda x: x IS NOT NULL), ',') END AS difference
  FROM asg l FULL JOIN af r USING (fold, row_id) WHERE l.phase IS NULL OR r.phase IS NULL OR l.role <> r.role OR l.exclusion_reason IS DISTINCT FROM r.exclusion_reason""")(lambda u: CP.assignment_differences(_table(u), _faulty(u)))


def _evidence(u: Universe) -> DataFrame:
    """Scores of the rows that a model may score, with planted faults."""
    rows = _assigned(u, u.targets).where((F.col("role") == "evaluation") | F.col("exclusion_reason").isin("missing_label", "missing_target") & F.col("as_of_date").between(F.col("evaluation_start"), F.col("evaluation_end")))
    row = F.concat(F.col("as_of_date").cast("string"), F.lit("|"), F.col("symbol").cast("string"))
    ends = _table(u).groupBy("fold").agg(F.min("train_end_date").alias("fit_end_date"), F.min("train_label_end_max").alias("train_label_end_max"))
    made = rows.where("symbol % 29 <> 0").join(proven_few(ends, SP.MOST_FOLDS), "fold").withColumn("fit_end_date", F.when(F.col("symbol") % 31 == 0, F.date_sub("fit_end_date", 7)).otherwise(F.col("fit_end_date")))
    odd = F.when(F.col("symbol") % 37 == 0, F.col("fold") % FOLDS + 1).otherwise(F.col("fold")).cast("int")
    return made.select(odd.alias("fold"), "as_of_date", "symbol", row.alias("row_id"), "fit_end_date", "train_label_end_max", "evaluation_start", F.col(TARGET).alias("target"), F.when(F.col("symbol") % 5 != 0, F.col("forward_return")).alias("realized_return"))


_EVIDENCE = f"""{_TABLE}, ev AS (SELECT CAST(CASE WHEN symbol % 37 = 0 THEN fold % {FOLDS} + 1 ELSE fold END AS INTEGER) AS fold, as_of_date, symbol, row_id, CAST(CASE WHEN symbol % 31 = 0 THEN train_end_date - 7 ELSE train_end_date END AS DATE) AS fit_end_date, train_label_end_max, evaluation_start, forward_excess_return AS target, CASE WHEN symbol % 5 <> 0 THEN forward_return END AS realized_return
  FROM asg WHERE symbol % 29 <> 0 AND (role = 'evaluation' OR exclusion_reason IN ('missing_label', 'missing_target') AND as_of_date BETWEEN evaluation_start AND evaluation_end)),
eb AS (SELECT fold, min(train_end_date) AS te, min(train_label_end_max) AS tl, min(evaluation_start) AS es, min(evaluation_end) AS ee FROM asg GROUP BY fold),
du AS (SELECT DISTINCT fold, as_of_date FROM panel JOIN eb ON as_of_date BETWEEN es AND ee),
ej AS (SELECT ev.fold AS scored, asg.fold AS there, role, exclusion_reason FROM ev FULL JOIN asg ON ev.fold = asg.fold AND ev.row_id = asg.row_id)"""
query("evidence_violations", f"""{_EVIDENCE} SELECT unnest(['fit_end_date_differs', 'train_label_end_max_differs', 'evaluation_start_differs', 'scored_not_allowed', 'evaluation_not_scored', 'dates_off_schedule', 'dates_missing', 'repeated_keys']) AS "check",
 unnest([(SELECT count(*) FROM ev JOIN eb USING (fold) WHERE fit_end_date IS DISTINCT FROM te), (SELECT count(*) FROM ev JOIN eb USING (fold) WHERE train_label_end_max IS DISTINCT FROM tl), (SELECT count(*) FROM ev JOIN eb USING (fold) WHERE evaluation_start IS DISTINCT FROM es),
  (SELECT count(*) FROM ej WHERE scored IS NOT NULL AND NOT coalesce(role = 'evaluation' OR role = 'excluded' AND exclusion_reason IN ('missing_label', 'missing_target', 'locked_test_overlap'), false)), (SELECT count(*) FROM ej WHERE role = 'evaluation' AND scored IS NULL),
  (SELECT count(*) FROM (SELECT DISTINCT fold, as_of_date FROM ev) e WHERE NOT EXISTS (SELECT 1 FROM du WHERE du.fold = e.fold AND du.as_of_date = e.as_of_date)), (SELECT count(*) FROM du WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.fold = du.fold AND ev.as_of_date = du.as_of_date)),
  (SELECT coalesce(CAST(sum(n - 1) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM ev GROUP BY fold, as_of_date, symbol))]) AS violations""")(lambda u: CP.evidence_violations(_evidence(u), _table(u), SP.phase_schedule(u.targets, _blocks(u, u.targets))))
query("outcome_violations", f"""{_EVIDENCE}, oj AS (SELECT ev.*, role, exclusion_reason FROM ev LEFT JOIN asg ON ev.fold = asg.fold AND ev.row_id = asg.row_id) SELECT unnest(['evaluation_without_target', 'target_that_is_missing', 'unauthorised_outcome']) AS "check",
 unnest([(SELECT count(*) FROM oj WHERE role = 'evaluation' AND target IS NULL), (SELECT count(*) FROM oj WHERE exclusion_reason = 'missing_target' AND target IS NOT NULL), (SELECT count(*) FROM oj WHERE exclusion_reason IN ('missing_label', 'locked_test_overlap') AND (target IS NOT NULL OR realized_return IS NOT NULL))]) AS violations""")(lambda u: CP.outcome_violations(_evidence(u), _table(u)))

# Portfolio

_WEIGHTS = f"""{_SCORES}, tk AS (SELECT as_of_date, symbol, floor(equal_score * 100 + 0.5001e0) / 100 AS score FROM sc WHERE equal_score IS NOT NULL),
tr AS (SELECT *, rank() OVER (PARTITION BY as_of_date ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY as_of_date, score) AS c FROM tk),
tw AS (SELECT as_of_date, symbol, score, greatest(0, least(5 - (r - 1), c)) / 5.0e0 / c AS weight FROM tr)"""


def _weights(u: Universe) -> DataFrame:
    scores = E.equal_weight_scores(u.panel, SIGNS).withColumn("score", F.floor(F.col("score") * 100 + 0.5001) / 100)
    return PF.top_k_weights(scores, 5)


query("top_k_weights", f"{_WEIGHTS} SELECT as_of_date, symbol, score, {s6('weight')} FROM tw WHERE weight > 0")(lambda u: _weights(u).select("as_of_date", "symbol", "score", *r6("weight")))
query("execution_dates", f"WITH {sql.base()} SELECT d.as_of_date, d.pos, c.session AS execution_date FROM dec d LEFT JOIN cal c ON c.pos = d.pos + 1")(lambda u: G.session_offset(u.calendar, u.dates, 1).select("as_of_date", "pos", "execution_date"))

_ACCOUNT = PF.LongOnlyConfig(top_k=5, buy_rate=0.0015, sell_rate=0.0015)


def _journal(u: Universe, account: PF.LongOnlyConfig) -> DataFrame:
    """Accounts of three scores on brands, liquidated at the calendar's end; weeks without a mark carry the last one."""
    panel = u.panel
    scores = {"equal_weight": E.equal_weight_scores(panel, SIGNS), "trailing_return": panel.select("as_of_date", "symbol", F.col("trailing_return").alias("score")), "beta": panel.select("as_of_date", "symbol", F.col("beta").alias("score"))}
    weights = [PF.top_k_weights(s, account.top_k).withColumn("account", F.lit(a)) for a, s in scores.items()]
    every = weights[0].unionByName(weights[1]).unionByName(weights[2])
    from pyspark.sql import Window

    marks = G.dense_grid(u.prices, u.calendar).withColumn("price", F.last("price", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("pos")))
    terminal = u.calendar.agg(F.max("session")).first()[0]
    return PF.journal(PF.ledger_input(every, marks, u.calendar, terminal, account), account)


def _days(u: Universe, account: PF.LongOnlyConfig = _ACCOUNT) -> DataFrame:
    return PF.of_kind(_journal(u, account), "day")


query("ledger_daily", None, "brand")(_days)
query("ledger_summary", None, "brand")(lambda u: PF.ledger_summary(_days(u), _ACCOUNT.initial_cash))
query("ledger_trades", None, "brand")(lambda u: PF.of_kind(_journal(u, _ACCOUNT), "trade"))
query("ledger_positions", None, "brand")(lambda u: PF.of_kind(_journal(u, _ACCOUNT), "position"))
# An account without costs has a closed form: its growth between two executions is that of its weights.
_FREE = f"""WITH {sql.panel('brand')}, last AS (SELECT max(pos) AS pos FROM cal),
mk AS (SELECT symbol, pos, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos) AS price FROM grid),
fs AS (SELECT as_of_date, symbol, m.account, m.score FROM (SELECT as_of_date, symbol, unnest([{{'account': 'trailing_return', 'score': trailing_return}}, {{'account': 'beta', 'score': beta}}]) AS m FROM panel) WHERE m.score IS NOT NULL),
fr AS (SELECT *, rank() OVER (PARTITION BY account, as_of_date ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY account, as_of_date, score) AS c FROM fs),
fw AS (SELECT account, symbol, cal.pos + 1 AS p0, greatest(0, least(5 - (r - 1), c)) / 5.0e0 / c AS w FROM fr JOIN cal ON cal.session = as_of_date WHERE greatest(0, least(5 - (r - 1), c)) > 0 AND cal.pos + 1 < (SELECT pos FROM last)),
fp AS (SELECT account, p0, coalesce(lead(p0) OVER (PARTITION BY account ORDER BY p0), (SELECT pos FROM last)) AS p1 FROM (SELECT DISTINCT account, p0 FROM fw)),
fg AS (SELECT fw.account, fp.p0, p1, m1.pos, 1 - sum(w) + sum(w * m1.price / m0.price) AS growth FROM fw JOIN fp USING (account, p0) JOIN mk m0 ON m0.symbol = fw.symbol AND m0.pos = fp.p0 JOIN mk m1 ON m1.symbol = fw.symbol AND m1.pos BETWEEN fp.p0 AND p1 GROUP BY fw.account, fp.p0, p1, m1.pos),
fc AS (SELECT account, p0, coalesce(exp(sum(ln(growth)) OVER (PARTITION BY account ORDER BY p0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS before FROM fg WHERE pos = p1),
fv AS (SELECT account, session, round(ln(before * growth), 6) + 0.0e0 AS log_growth FROM fg JOIN fc USING (account, p0) JOIN cal USING (pos) WHERE pos < p1 OR p1 = (SELECT pos FROM last))"""
_NO_COSTS = PF.LongOnlyConfig(top_k=5)
query("ledger_without_costs", f"{_FREE} SELECT account, session, log_growth FROM fv", "brand")(lambda u: _days(u, _NO_COSTS).where("account <> 'equal_weight'").select("account", "session", (F.round(F.ln(F.col("nav") / _NO_COSTS.initial_cash), 6) + F.lit(0.0)).alias("log_growth")))
query("ledger_balance", f"{_FREE} SELECT account, count(*) AS sessions, 0 AS broken_nav, 0 AS broken_cash FROM fv GROUP BY account", "brand")(lambda u: PF.balance(_journal(u, _ACCOUNT), _ACCOUNT.initial_cash).where("account <> 'equal_weight'"))

# Models

_INPUTS = ["trailing_return", "beta", "max_drawdown"]


def training(u: Universe) -> DataFrame:
    """Labelled rows before 2000 with features ranked over whole cross-sections, and equal-date weights."""
    ranked = M.rank_features(u.panel.select("as_of_date", "symbol", "label_end_date", TARGET, *_INPUTS), _INPUTS)
    rows = ranked.where((F.col("label_end_date") < F.lit(date(2000, 1, 1))) & F.col(TARGET).isNotNull())
    return SP.training_weights(rows, [])


_TRAIN = f"""WITH {sql.panel()}, rk AS (SELECT as_of_date, symbol, label_end_date, forward_excess_return AS y, {', '.join(f'{sql.pct(f, "as_of_date")} AS {f}' for f in _INPUTS)} FROM panel),
tr0 AS (SELECT * FROM rk WHERE label_end_date < DATE '2000-01-01' AND y IS NOT NULL),
tr AS (SELECT *, (SELECT count(*) FROM tr0) / (SELECT count(DISTINCT as_of_date) FROM tr0) / count(*) OVER (PARTITION BY as_of_date) AS wt FROM tr0),
im AS (SELECT {', '.join(f'coalesce({f}, (SELECT median({f}) FROM tr0)) AS x{i}' for i, f in enumerate(_INPUTS))}, y, wt FROM tr)"""


def _gram(u: Universe) -> DataFrame:
    """The weighted Gram entries of the imputed inputs, one row each."""
    rows = training(u)
    medians, _ = M.imputation(rows, _INPUTS)
    xs = M.design(_INPUTS, medians, [])
    terms = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col("weight") * xs[i] * (xs[j] if j < len(xs) else F.col(TARGET))).alias("v")) for i in range(len(xs)) for j in range(i, len(xs) + 1)]
    return rows.select(F.explode(F.array(*terms)).alias("t")).groupBy("t.i", "t.j").agg(F.round(F.sum("t.v"), 6).alias("value"))


query("ridge_gram", f"{_TRAIN} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum(wt * x{i} * {f'x{j}' if j < len(_INPUTS) else 'y'}), 6) AS value FROM im" for i in range(len(_INPUTS)) for j in range(i, len(_INPUTS) + 1)))(_gram)


def _model_scores(u: Universe, components: float | None = None) -> DataFrame:
    rows = training(u)
    model = M.fit_ridge(rows, _INPUTS, TARGET, [1.0], components=components)[0]
    later = M.rank_features(u.panel.select("as_of_date", "symbol", *_INPUTS), _INPUTS).where(F.col("as_of_date") >= F.lit(date(2000, 1, 1)))
    return model.score(later).select("as_of_date", "symbol", "feature_count", "score")


query("ridge_scores")(lambda u: _model_scores(u))


def _complete_scores(u: Universe) -> DataFrame:
    """Ridge fitted on training rows with all inputs, which needs no imputation: a system of three unknowns."""
    complete = F.lit(True)
    for f in _INPUTS:
        complete = complete & F.col(f).isNotNull()
    rows = training(u).drop("weight").where(complete)
    model = M.fit_ridge(SP.training_weights(rows, []), _INPUTS, TARGET, [1.0])[0]
    later = M.rank_features(u.panel.select("as_of_date", "symbol", *_INPUTS), _INPUTS).where((F.col("as_of_date") >= F.lit(date(2000, 1, 1))) & complete)
    return model.score(later).select("as_of_date", "symbol", *r6("score"))


def _cramer(column: int) -> str:
    """The determinant of the 3 by 3 system with its right side in a column, or in none."""
    cell = lambda i, j: f"b{i}" if j == column else f"a{min(i, j)}{max(i, j)}"
    minor = lambda j, k: f"({cell(1, j)} * {cell(2, k)} - {cell(1, k)} * {cell(2, j)})"
    return f"({cell(0, 0)} * {minor(1, 2)} - {cell(0, 1)} * {minor(0, 2)} + {cell(0, 2)} * {minor(0, 1)})"


_THREE = range(3)
_COMPLETE = f"""{_TRAIN.split('tr AS (')[0]}cc AS (SELECT as_of_date, y, {', '.join(f'{f} AS x{i}' for i, f in enumerate(_INPUTS))} FROM tr0 WHERE {' AND '.join(f'{f} IS NOT NULL' for f in _INPUTS)}),
cw AS (SELECT *, (SELECT count(*) FROM cc) / (SELECT count(DISTINCT as_of_date) FROM cc) / count(*) OVER (PARTITION BY as_of_date) AS w FROM cc),
cm AS (SELECT {', '.join(f'avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}' for i in _THREE)} FROM cc),
cz AS (SELECT y, w, {', '.join(f'(x{i} - m{i}) / s{i} AS z{i}' for i in _THREE)} FROM cw, cm),
cv AS (SELECT sum(w) AS sw, sum(w * y) / sum(w) AS my, {', '.join(f'sum(w * z{i}) / sum(w) AS c{i}' for i in _THREE)} FROM cz),
cs AS (SELECT {', '.join(f"sum(w * (z{i} - c{i}) * (z{j} - c{j})){' + 1' if i == j else ''} AS a{i}{j}" for i in _THREE for j in range(i, 3))}, {', '.join(f'sum(w * (z{i} - c{i}) * (y - my)) AS b{i}' for i in _THREE)} FROM cz, cv),
cb AS (SELECT {', '.join(f'{_cramer(i)} / {_cramer(9)} AS k{i}' for i in _THREE)} FROM cs)
SELECT as_of_date, symbol, round(my + {' + '.join(f'k{i} * (({f} - m{i}) / s{i} - c{i})' for i, f in enumerate(_INPUTS))}, 6) + 0.0e0 AS score FROM rk, cm, cv, cb WHERE as_of_date >= DATE '2000-01-01' AND {' AND '.join(f'{f} IS NOT NULL' for f in _INPUTS)}"""
query("ridge_complete_scores", _COMPLETE)(_complete_scores)
query("ridge_pca_scores")(lambda u: _model_scores(u, 0.95))
query("pca_baseline")(lambda u: M.pca_baseline(u.panel, list(SIGNALS), date(2000, 1, 1))[0])


def _tree_scores(u: Universe) -> DataFrame:
    score = M.fit_trees(training(u), _INPUTS, TARGET)
    later = M.rank_features(u.panel.select("as_of_date", "symbol", *_INPUTS), _INPUTS).where(F.col("as_of_date") >= F.lit(date(2000, 1, 1)))
    return score(later).select("as_of_date", "symbol", "feature_count", "score")


query("gbt_scores")(_tree_scores)

# Archive adapters


def _wide(u: Universe) -> DataFrame:
    """Brand prices with a column a ticker."""
    names = [r[0] for r in u.prices.select("symbol").distinct().orderBy("symbol").collect()]
    return u.prices.groupBy(F.col("session").alias("Date")).pivot("symbol", names).agg(F.first("price"))


query("unpivot_archive", f"WITH {sql.base('brand')}, nm AS (SELECT DISTINCT symbol FROM pw ORDER BY symbol LIMIT 10) SELECT session AS date, symbol, price AS adjusted_close FROM pw WHERE symbol IN (SELECT symbol FROM nm)", "brand")(lambda u: T.wide_archive(_wide(u), 10)[0])
query("archive_gaps", f"WITH {sql.base('brand')}, nm AS (SELECT DISTINCT symbol FROM pw ORDER BY symbol LIMIT 10) SELECT session AS date, symbol, 'missing_adjusted_close' AS reason FROM grid WHERE price IS NULL AND symbol IN (SELECT symbol FROM nm)", "brand")(lambda u: T.wide_archive(_wide(u), 10)[1])
query("archive_coverage", f"WITH {sql.base()}, y AS (SELECT session, year(session) AS year FROM cal), e AS (SELECT year, count(*) AS expected FROM y GROUP BY year), o AS (SELECT symbol, year, count(*) AS observed FROM pw JOIN y USING (session) GROUP BY ALL) SELECT s.symbol, CAST(e.year AS INTEGER) AS year, expected, coalesce(observed, 0) AS observed, expected - coalesce(observed, 0) AS missing, round((expected - coalesce(observed, 0)) / expected, 6) AS missing_rate FROM (SELECT DISTINCT symbol FROM pw) s CROSS JOIN e LEFT JOIN o ON o.symbol = s.symbol AND o.year = e.year")(
    lambda u: T.archive_coverage(u.prices.withColumnRenamed("session", "date"), u.calendar, True).select("symbol", "year", "expected", "observed", "missing", *r6("missing_rate"))
)
query("index_levels", f"WITH {sql.base()}, x AS (SELECT session AS date, CASE WHEN pos = 0 THEN 1.0e0 ELSE 1 + b END AS f FROM (SELECT DISTINCT session, pos, bench / lag(bench) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS b FROM grid WHERE symbol = (SELECT min(symbol) FROM pw))) SELECT date, round(100 * product(f) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS level FROM x")(_levels := lambda u: T.index_levels(_bench_returns(u)).select("date", *r6("level")))


def _bench_returns(u: Universe) -> DataFrame:
    from pyspark.sql import Window

    return u.bench.select(F.col("session").alias("date"), (F.col("price") / F.lag("price").over(Window.orderBy("session")) - 1).alias("ret"))


query("large_moves", f"WITH {sql.base()} SELECT session, symbol, {s6('r')} FROM ret WHERE abs(r) > 0.5 ORDER BY session, symbol LIMIT 20")(lambda u: T.large_moves(G.adjacent_returns(u.grid)).select("session", "symbol", *r6("r")))
query("coverage_profile", f"WITH {sql.base()}, e AS (SELECT count(*) AS expected FROM cal) SELECT symbol, expected, count(*) AS observed, expected - count(*) AS missing, round((expected - count(*)) / expected, 6) AS missing_rate FROM pw, e GROUP BY symbol, expected")(
    lambda u: T.archive_coverage(u.prices.withColumnRenamed("session", "date"), u.calendar).select("symbol", "expected", "observed", "missing", *r6("missing_rate"))
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel, splits, baseline scores and their native daily metrics."""
    return native(Universe(spark, sf_dir))


from . import model_queries  # noqa: E402, F401  (adds its queries)
