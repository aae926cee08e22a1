"""Queries on nested folds, models and clusters, each with its DuckDB equivalent where SQL has one.

Importing this module adds them to ``queries``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_sums
from ..operators import companion as CO
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import splits as SP
from ..operators import tuning as TU
from ..operators.boosting import Boosting, fit_boosted
from . import sql
from .derived import TARGET, Universe
from ..shared import shared_folder
from ..streaming import events
from .queries import _INPUTS, _PREDICTIONS, _SPLIT, _THREE, MODELS, QUERIES, SIGNALS, ORACLE_SQL, _assigned, _cramer, predictions, query, r6, s6, training

INNER, INNER_DATES, INNER_LEAST = 2, 6, 5
ALPHAS = (0.1, 1.0, 10.0, 100.0)

# Nested folds


def _cross(u: Universe) -> DataFrame:
    """Training cross-sections of the outer folds with inputs ranked by date."""
    ranked = M.rank_features(u.panel.select("as_of_date", "symbol", "forward_return", *_INPUTS), _INPUTS)
    roles = _assigned(u, u.panel).select("as_of_date", "symbol", "fold", "role", "label_end_date", TARGET)
    rows = SP.training_cross_sections(roles.join(ranked, ["as_of_date", "symbol"]), TARGET)
    return rows.withColumn("forward_return", F.when(F.col("role") == "training", F.col("forward_return"))).drop("role")


def nested(u: Universe) -> DataFrame:
    cross = _cross(u)
    return TU.nested_rows(cross, TU.nested_blocks(cross, folds=INNER, test_dates=INNER_DATES, least_train=INNER_LEAST))


_NESTED = f"""{_SPLIT}, rk AS (SELECT as_of_date, symbol, forward_return, {', '.join(f'{sql.pct(f, "as_of_date")} AS {f}' for f in _INPUTS)} FROM panel),
cx AS (SELECT fold, as_of_date, symbol, CASE WHEN role = 'training' THEN forward_excess_return END AS y, CASE WHEN role = 'training' THEN label_end_date END AS label_end_date, CASE WHEN role = 'training' THEN forward_return END AS z, {', '.join(_INPUTS)}
  FROM fa JOIN rk USING (as_of_date, symbol) WHERE EXISTS (SELECT 1 FROM fa t WHERE t.fold = fa.fold AND t.as_of_date = fa.as_of_date AND t.role = 'training')),
nd AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY as_of_date) - 1 AS i, count(*) OVER (PARTITION BY fold) AS total FROM (SELECT DISTINCT fold, as_of_date FROM cx)),
nb AS (SELECT fold AS "outer", CAST((i - (total - {INNER * INNER_DATES})) // {INNER_DATES} + 1 AS INTEGER) AS "inner", min(as_of_date) AS test_start, max(as_of_date) AS test_end FROM nd WHERE i >= total - {INNER * INNER_DATES} AND i >= {INNER_LEAST} GROUP BY ALL HAVING count(*) = {INNER_DATES}),
nr AS (SELECT nb.*, cx.* EXCLUDE (fold), CASE WHEN as_of_date >= test_start THEN 'test' WHEN label_end_date < test_start THEN 'training' ELSE 'purged' END AS role FROM nb JOIN cx ON cx.fold = nb."outer" AND as_of_date <= test_end)"""
_SOME = " + ".join(f"({f} IS NOT NULL)::INT" for f in _INPUTS)

query("nested_folds", f'{_NESTED} SELECT "outer", "inner", test_start, test_end FROM nb')(lambda u: TU.nested_blocks(_cross(u), folds=INNER, test_dates=INNER_DATES, least_train=INNER_LEAST).select("outer", "inner", "test_start", "test_end"))
query("preflight_windows", f"""{_NESTED} SELECT "outer", "inner", count(DISTINCT CASE WHEN role = 'training' THEN as_of_date END) AS train_dates, count(DISTINCT CASE WHEN role = 'test' THEN as_of_date END) AS test_dates,
  count_if(role = 'training')::BIGINT AS train_rows, count_if(role = 'training' AND y IS NOT NULL)::BIGINT AS supervised_rows, count_if(role = 'purged' AND label_end_date >= test_start)::BIGINT AS purged_rows, count_if(role = 'purged' AND label_end_date IS NULL)::BIGINT AS unlabelled_rows,
  count_if(role = 'test')::BIGINT AS test_rows, count_if(role = 'test' AND y IS NOT NULL)::BIGINT AS test_labelled_rows, count_if(role = 'test' AND y IS NULL)::BIGINT AS feature_only_rows, count_if(role = 'test' AND {_SOME} = 0)::BIGINT AS empty_test_rows,
  round(avg(CASE WHEN role = 'training' THEN ({_SOME}) / 3.0e0 END), 6) AS train_coverage, round(avg(CASE WHEN role = 'test' THEN ({_SOME}) / 3.0e0 END), 6) AS test_coverage FROM nr GROUP BY ALL""")(
    lambda u: TU.window_counts(nested(u), TARGET, _INPUTS).withColumns({c: F.round(c, 6) for c in ("train_coverage", "test_coverage")})
)


def _trials(u: Universe) -> DataFrame:
    """Ridge on rows with all inputs, whose systems have three unknowns, over the grid of penalties."""
    complete = F.lit(True)
    for f in _INPUTS:
        complete = complete & F.col(f).isNotNull()
    found = TU.tune_linear(nested(u).where(complete), _INPUTS, TARGET, "forward_return", [{"alpha": a} for a in ALPHAS], least=u.least, quantiles=u.quantiles)
    return found.select("outer", "candidate_id", "candidate_order", *r6("mean_rank_ic", "mean_spread"), "dates", "selected")


_K = '"outer", "inner"'
_TRIALS = f"""{_NESTED}, nc AS (SELECT * FROM nr WHERE {' AND '.join(f'{f} IS NOT NULL' for f in _INPUTS)}),
ct AS (SELECT {_K}, as_of_date, y, {', '.join(f'{f} AS x{i}' for i, f in enumerate(_INPUTS))} FROM nc WHERE role = 'training' AND y IS NOT NULL),
cw AS (SELECT *, count(*) OVER (PARTITION BY {_K}) / g.days / count(*) OVER (PARTITION BY {_K}, as_of_date) AS w FROM ct JOIN (SELECT {_K}, count(DISTINCT as_of_date) AS days FROM ct GROUP BY {_K}) g USING ({_K})),
cm AS (SELECT {_K}, {', '.join(f'avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}' for i in _THREE)} FROM ct GROUP BY {_K}),
cz AS (SELECT {_K}, y, w, {', '.join(f'(x{i} - m{i}) / s{i} AS z{i}' for i in _THREE)} FROM cw JOIN cm USING ({_K})),
cv AS (SELECT {_K}, sum(w * y) / sum(w) AS my, {', '.join(f'sum(w * z{i}) / sum(w) AS c{i}' for i in _THREE)} FROM cz GROUP BY {_K}),
al AS (SELECT unnest([{', '.join(map(str, ALPHAS))}])::DOUBLE AS alpha, unnest(range(0, {len(ALPHAS)}))::INTEGER AS candidate),
cs AS (SELECT {_K}, {', '.join(f"sum(w * (z{i} - c{i}) * (z{j} - c{j})) AS q{i}{j}" for i in _THREE for j in range(i, 3))}, {', '.join(f'sum(w * (z{i} - c{i}) * (y - my)) AS b{i}' for i in _THREE)} FROM cz JOIN cv USING ({_K}) GROUP BY {_K}),
ca AS (SELECT cs.*, candidate, {', '.join(f"q{i}{j}{' + alpha' if i == j else ''} AS a{i}{j}" for i in _THREE for j in range(i, 3))} FROM cs, al),
cb AS (SELECT {_K}, candidate, {', '.join(f'{_cramer(i)} / {_cramer(9)} AS k{i}' for i in _THREE)} FROM ca),
ts AS (SELECT {_K}, candidate, as_of_date, y, z, my + {' + '.join(f'k{i} * (({f} - m{i}) / s{i} - c{i})' for i, f in enumerate(_INPUTS))} AS score FROM nc JOIN cm USING ({_K}) JOIN cv USING ({_K}) JOIN cb USING ({_K}) WHERE role = 'test'),
{sql.ic('ti', 'ts', _K + ', candidate, as_of_date', 'score', 'y')}, {sql.spread('sp', 'ts', _K + ', candidate, as_of_date', 'score', 'z')},
tm AS (SELECT "outer", candidate, avg(rank_ic) AS mean_rank_ic, count(*) AS dates FROM ti GROUP BY ALL), tp AS (SELECT "outer", candidate, avg(spread) AS mean_spread FROM sp WHERE pairs >= 20 GROUP BY ALL),
tt AS (SELECT DISTINCT "outer", candidate FROM ts)
SELECT "outer", CASE candidate {' '.join(f"WHEN {i} THEN 'ridge:{{\"alpha\":{a}}}'" for i, a in enumerate(ALPHAS))} END AS candidate_id, candidate AS candidate_order, {s6('mean_rank_ic', 'mean_spread')}, coalesce(dates, 0) AS dates,
  coalesce(row_number() OVER (PARTITION BY "outer" ORDER BY round(mean_rank_ic, 12) DESC NULLS LAST, candidate) = 1 AND mean_rank_ic IS NOT NULL, false) AS selected FROM tt LEFT JOIN tm USING ("outer", candidate) LEFT JOIN tp USING ("outer", candidate)"""
query("trial_scores", _TRIALS)(_trials)


# Boosted trees

ROUNDS = 20


def _boosted(u: Universe) -> DataFrame:
    """Trees of two candidates on the training rows, and their scores of later rows."""
    model = fit_boosted(training(u), [], _INPUTS, TARGET, [Boosting(), Boosting(0.1, 4, 0.0)], rounds=ROUNDS)
    later = M.rank_features(u.panel.select("as_of_date", "symbol", *_INPUTS), _INPUTS).where(F.col("as_of_date") >= F.lit(date(2000, 1, 1)))
    return model.score(later.select("as_of_date", "symbol", *_INPUTS)).select("as_of_date", "symbol", "candidate", "feature_count", "score")


query("hgb_scores")(_boosted)


# Scope of a comparison


def _odd_predictions(u: Universe) -> DataFrame:
    """Predictions with planted faults: other targets, repeated rows, a model without rows on some dates."""
    beta = F.col("model") == "metric:beta"
    rows = predictions(u).where(~(beta & (F.month("as_of_date") % 3 == 0)))
    rows = rows.withColumn("target", F.when(beta & (F.col("symbol") % 11 == 0), F.col("target") + 1).otherwise(F.col("target")))
    rows = rows.withColumn("realized_return", F.when(~beta | (F.col("symbol") % 7 != 0), F.col("realized_return")))
    return rows.unionByName(rows.where((F.col("symbol") % 13 == 0) & (F.col("model") == "equal_weight_rank")))


query("common_scope_violations", f"""{_PREDICTIONS}, po AS (SELECT * REPLACE (CASE WHEN model = 'metric:beta' AND symbol % 11 = 0 THEN target + 1 ELSE target END AS target, CASE WHEN model <> 'metric:beta' OR symbol % 7 <> 0 THEN realized_return END AS realized_return) FROM pd WHERE NOT (model = 'metric:beta' AND month(as_of_date) % 3 = 0)),
pp AS (SELECT * FROM po UNION ALL SELECT * FROM po WHERE symbol % 13 = 0 AND model = 'equal_weight_rank'),
pr AS (SELECT count(*) AS n, count(DISTINCT model) AS m, count(DISTINCT coalesce(target::VARCHAR, 'none')) AS t, count(DISTINCT coalesce(realized_return::VARCHAR, 'none')) AS r FROM pp GROUP BY phase, fold, as_of_date, symbol),
pm AS (SELECT count(DISTINCT model) AS m FROM pp GROUP BY phase, fold, as_of_date)
SELECT unnest(['differing_targets', 'differing_returns', 'repeated_rows', 'absent_models']) AS "check", unnest([(SELECT count(*) FROM pr WHERE t > 1), (SELECT count(*) FROM pr WHERE r > 1), (SELECT sum(n - m) FROM pr)::BIGINT, (SELECT sum({len(MODELS)} - m) FROM pm)::BIGINT]) AS violations""")(
    lambda u: E.common_scope_violations(_odd_predictions(u), list(MODELS))
)

# Companion analysis

_LONG = f"WITH {sql.panel()}, {sql.long(SIGNALS, 'as_of_date')}"
query("feature_describe", f"""{_LONG} SELECT feature, count(value) AS count, {s6('mean', 'std', 'min', 'q25', 'q50', 'q75', 'max')} FROM (SELECT feature, value, avg(value) OVER f AS mean, stddev_samp(value) OVER f AS std, min(value) OVER f AS min, quantile_cont(value, 0.25) OVER f AS q25, quantile_cont(value, 0.5) OVER f AS q50, quantile_cont(value, 0.75) OVER f AS q75, max(value) OVER f AS max
  FROM long WINDOW f AS (PARTITION BY feature)) GROUP BY ALL""")(lambda u: CO.describe(u.panel, list(SIGNALS)).select("feature", "count", *r6("mean", "std", "min", "q25", "q50", "q75", "max")))
query("feature_correlations", f"""WITH {sql.panel()} {" UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, count(*) AS n, round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) + 0.0e0 AS r FROM panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(SIGNALS) for b in SIGNALS[i + 1 :])}""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))(
    lambda u: CO.correlations(u.panel, list(SIGNALS)).select("left", "right", "n", *r6("r"))
)
query("feature_linkage")(lambda u: CO.feature_linkage(u.panel, list(SIGNALS)).select("step", "left", "right", "size", *r6("height")))


def _rows(u: Universe) -> DataFrame:
    """Complete rows of the signals, standardised, with whether the outcome beat the benchmark."""
    labelled = u.panel.where(F.col(TARGET).isNotNull())
    return CO.standardised(labelled.withColumn("beat", (F.col(TARGET) > 0).cast("int")), ["as_of_date", "symbol", "beat"], list(SIGNALS))


def _key() -> F.Column:
    return F.concat(F.col("as_of_date").cast("string"), F.lit("|"), F.col("symbol").cast("string"))


query("kmeans_silhouette")(lambda u: CO.k_means(_rows(u), len(SIGNALS), _key()).select("k", "n", *r6("inertia", "silhouette")))
query("holdout_split", f"""WITH {sql.panel()} SELECT ('0x' || substr(md5(as_of_date || '|' || symbol), 1, 8))::BIGINT % 5 = 0 AS held_out, CAST(forward_excess_return > 0 AS INTEGER) AS beat, count(*) AS n FROM panel
  WHERE forward_excess_return IS NOT NULL AND {' AND '.join(f'{f} IS NOT NULL' for f in SIGNALS)} GROUP BY ALL""")(lambda u: CO.dealt(_rows(u), _key()).groupBy("held_out", "beat").agg(F.count("*").alias("n")))
query("logistic_holdout")(lambda u: CO.held_out_report(CO.dealt(_rows(u), _key()), len(SIGNALS), "beat").select("held_out", "n", "positives", "correct", *r6("loss")))

# Events


def _windows(spark, sf_dir: str) -> DataFrame:
    """Hours of the event stream, drained into files and read from them."""
    folder, keys, values = shared_folder(spark, "windows"), ["window_start", "event_type"], ["n", "total"]
    # Events of any age count: files come in no order of time.
    events.drain(events.event_windows(events.read_events(spark, f"{sf_dir}/events.parquet"), late="36500 days"), folder, shared_folder(spark, "offsets"))
    return events.latest(spark, folder, keys, values).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", *r6("total"))


QUERIES["events_windowed"] = _windows
ORACLE_SQL["events_windowed"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 6) + 0.0e0 AS total FROM events GROUP BY ALL"


# Sums that don't depend on an order


def _totals(spark, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("gross", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    return exact_sums(lines, ["l_returnflag", "l_linestatus"], "gross").withColumn("total", F.round("total", 4))


QUERIES["exact_totals"] = _totals
ORACLE_SQL["exact_totals"] = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(fsum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS total FROM lineitem GROUP BY ALL"
