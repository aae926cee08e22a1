"""DuckDB text of the derived tables and operators, for the queries' equivalents."""

from __future__ import annotations

from ..functions.numeric import two_sided_p_sql
from ..operators.panel import FACTORS, METRICS

LEAST, QUANTILES = 20, 5
_UNIT = "floor(avg(l_extendedprice / l_quantity) * 1e6 + 0.5001e0) / 1e6"
_WEEK = "CAST(date_trunc('week', l_shipdate) AS DATE)"
PRICES = {
    "supplier": f"SELECT l_suppkey AS symbol, {_WEEK} AS session, {_UNIT} AS price FROM lineitem GROUP BY ALL",
    "brand": f"SELECT p_brand AS symbol, {_WEEK} AS session, {_UNIT} AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "nation": f"SELECT c_nationkey AS symbol, {_WEEK} AS session, {_UNIT} AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
}


def base(by: str = "supplier") -> str:
    """CTEs: pw, bench, cal, grid, ret, mem, dec, act."""
    gap = "false" if by == "brand" else "symbol % 3 = 0"
    day = lambda i: f"(SELECT session FROM cal WHERE pos = {i})"
    return f"""
pw AS ({PRICES[by]}),
bench AS (SELECT session, floor(avg(price) * 1e6 + 0.5001e0) / 1e6 AS price FROM pw GROUP BY session),
cal AS (SELECT session, CAST(row_number() OVER (ORDER BY session) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT session FROM pw)),
grid AS (SELECT s.symbol, c.pos, c.session, pw.price, b.price AS bench
         FROM (SELECT DISTINCT symbol FROM pw) s CROSS JOIN cal c LEFT JOIN pw ON pw.symbol = s.symbol AND pw.session = c.session LEFT JOIN bench b ON b.session = c.session),
ret AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS r, bench / lag(bench) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS b FROM grid),
mem AS (SELECT '{by}' AS universe_id, symbol, {day(0)} AS effective_from, CASE WHEN {gap} THEN {day(150)} END AS effective_to, 'derived' AS source FROM (SELECT DISTINCT symbol FROM pw)
        UNION ALL SELECT '{by}', symbol, {day(200)}, NULL, 'derived' FROM (SELECT DISTINCT symbol FROM pw) WHERE {gap}),
dec AS (SELECT session AS as_of_date, pos FROM cal WHERE pos >= 52 AND (pos - 52) % 4 = 0),
act AS (SELECT DISTINCT d.as_of_date, d.pos, m.symbol FROM dec d JOIN mem m ON m.effective_from <= d.as_of_date AND (m.effective_to IS NULL OR d.as_of_date < m.effective_to))"""


def pct(x: str, part: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part}, ({x} IS NOT NULL) ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0e0) / count({x}) OVER (PARTITION BY {part}) END"


def panel(by: str = "supplier") -> str:
    """``base`` and the CTE panel, with w (windows), agg, dd, lab on the way."""
    metric = {
        "trailing_return": "last_price / first_price - 1",
        "annualized_volatility": "CASE WHEN sd_r > 2.220446049250313e-16 THEN sd_r * sqrt(52) END",
        "sharpe_ratio": "CASE WHEN sd_r * sqrt(52) > 0 THEN mean_r * 52 / (sd_r * sqrt(52)) END",
        "sortino_ratio": "CASE WHEN sqrt(down) * sqrt(52) > 0 THEN mean_r * 52 / (sqrt(down) * sqrt(52)) END",
        "max_drawdown": "dd.worst",
        "benchmark_correlation": "CASE WHEN sd_r > 2.220446049250313e-16 AND sqrt(var_b) > 2.220446049250313e-16 THEN cov / (sd_r * sqrt(var_b)) END",
        "beta": "CASE WHEN var_b > 2.220446049250313e-16 THEN cov / var_b END",
        "capm_alpha": "CASE WHEN var_b > 2.220446049250313e-16 THEN mean_r * 52 - cov / var_b * (mean_b * 52) END",
        "information_ratio": "CASE WHEN sd_d * sqrt(52) > 0 THEN mean_d * 52 / (sd_d * sqrt(52)) END",
        "historical_var_5pct": "greatest(0, -q05)",
    }
    columns = ", ".join(f"CASE WHEN n >= 13 THEN {metric[m]} END AS {m}" for m in METRICS)
    paired = "g.pos > greatest(0, a.pos - 26) AND g.r IS NOT NULL AND g.b IS NOT NULL"
    return f"""{base(by)},
w AS (SELECT a.as_of_date, a.symbol, a.pos AS at_pos, greatest(0, a.pos - 26) AS start, g.pos, g.price,
             CASE WHEN {paired} THEN g.r END AS x, CASE WHEN {paired} THEN g.b END AS y
      FROM act a JOIN ret g ON g.symbol = a.symbol AND g.pos BETWEEN greatest(0, a.pos - 26) AND a.pos),
agg AS (SELECT as_of_date, symbol, min(start) AS start, max(CASE WHEN pos = start THEN price END) AS first_price, max(CASE WHEN pos = at_pos THEN price END) AS last_price,
               count(x) AS n, avg(x) AS mean_r, stddev_samp(x) AS sd_r, avg(y) AS mean_b, var_samp(y) AS var_b, covar_samp(x, y) AS cov,
               avg(CASE WHEN x < 0 THEN x * x WHEN x >= 0 THEN 0 END) AS down, avg(x - y) AS mean_d, stddev_samp(x - y) AS sd_d, quantile_cont(x, 0.05) AS q05
        FROM w GROUP BY as_of_date, symbol),
dd AS (SELECT as_of_date, symbol, min(price / peak - 1) AS worst FROM (SELECT *, max(price) OVER (PARTITION BY as_of_date, symbol ORDER BY pos) AS peak FROM w WHERE price IS NOT NULL) GROUP BY as_of_date, symbol),
feat AS (SELECT agg.as_of_date, agg.symbol, cal.session AS feature_window_start, {columns}, n AS observation_count,
                CASE WHEN n >= 13 THEN 'ok' ELSE 'insufficient_history' END AS feature_status,
                first_price IS NOT NULL AS window_start_price_available, last_price IS NOT NULL AS decision_price_available, n >= 13 AS feature_eligible
         FROM agg JOIN cal ON cal.pos = agg.start LEFT JOIN dd USING (as_of_date, symbol)),
lab0 AS (SELECT a.as_of_date, a.symbol, CASE WHEN x1.session IS NOT NULL THEN x0.session END AS label_start_date, x1.session AS label_end_date
         FROM act a LEFT JOIN cal x0 ON x0.pos = a.pos + 1 LEFT JOIN cal x1 ON x1.pos = a.pos + 5),
lab1 AS (SELECT l.*, p0.price AS e0, p1.price AS e1, b0.price AS c0, b1.price AS c1,
                CASE WHEN label_end_date IS NULL THEN 'insufficient_future_benchmark_history' WHEN p0.price IS NULL OR p1.price IS NULL THEN 'missing_symbol_price'
                     WHEN b0.price IS NULL OR b1.price IS NULL THEN 'missing_benchmark_price' ELSE 'ok' END AS target_status
         FROM lab0 l LEFT JOIN pw p0 ON p0.symbol = l.symbol AND p0.session = l.label_start_date LEFT JOIN pw p1 ON p1.symbol = l.symbol AND p1.session = l.label_end_date
              LEFT JOIN bench b0 ON b0.session = l.label_start_date LEFT JOIN bench b1 ON b1.session = l.label_end_date),
lab2 AS (SELECT as_of_date, symbol, label_start_date, label_end_date, target_status = 'ok' AS target_available, target_status,
                CASE WHEN target_status = 'ok' THEN e1 / e0 - 1 END AS forward_return, CASE WHEN target_status = 'ok' THEN c1 / c0 - 1 END AS benchmark_forward_return FROM lab1),
lab AS (SELECT *, {pct("forward_excess_return", "as_of_date")} AS forward_excess_rank FROM (SELECT *, forward_return - benchmark_forward_return AS forward_excess_return FROM lab2)),
panel AS (SELECT * FROM feat JOIN lab USING (as_of_date, symbol))"""


def long(features: tuple[str, ...] | list[str], keep: str, source: str = "panel", name: str = "long") -> str:
    parts = " UNION ALL ".join(f"SELECT {keep}, '{f}' AS feature, {f} AS value FROM {source}" for f in features)
    return f"{name} AS ({parts})"


def ic(name: str, source: str, keys: str, x: str, y: str, least: int | None = LEAST) -> str:
    """CTEs name_r and name: pairs and rank_ic; with a least number of pairs, only valid ones."""
    mean = lambda v: f"rank() OVER (PARTITION BY {keys} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}, {v}) - 1) / 2.0e0"
    having = f"WHERE pairs >= {least} AND rank_ic IS NOT NULL" if least is not None else ""
    return f"""{name}_r AS (SELECT {keys}, {mean(x)} AS rx, {mean(y)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
{name} AS (SELECT * FROM (SELECT {keys}, count(*) AS pairs, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS rank_ic FROM {name}_r GROUP BY {keys}) {having})"""


def spread(name: str, source: str, keys: str, score: str, outcome: str, q: int = QUANTILES) -> str:
    return f"""{name}_g AS (SELECT {keys}, {score} AS s, avg({outcome}) AS m, count(*) AS c FROM {source} WHERE {score} IS NOT NULL AND {outcome} IS NOT NULL GROUP BY {keys}, {score}),
{name}_p AS (SELECT *, sum(c) OVER (PARTITION BY {keys} ORDER BY s ROWS UNBOUNDED PRECEDING) AS e, sum(c) OVER (PARTITION BY {keys}) AS n FROM {name}_g),
{name}_k AS (SELECT *, greatest(1, n // {q}) AS k FROM {name}_p),
{name} AS (SELECT {keys}, CAST(max(n) AS BIGINT) AS pairs, count(*) AS scores,
           CAST(sum((least(greatest(e - (n - k), 0), c) - least(greatest(k - (e - c), 0), c)) * m) AS DOUBLE) / CAST(max(k) AS DOUBLE) AS spread FROM {name}_k GROUP BY {keys})"""


def hac(name: str, source: str, keys: str, order: str, value: str, lags: int) -> str:
    """n, n_values, mean, hac_t, hac_p by key."""
    group = f"GROUP BY {keys}" if keys else ""
    lagged = ", ".join(f"lag(d, {k}) OVER (PARTITION BY {keys} ORDER BY {order}) AS l{k}" for k in range(1, lags + 1))
    sums = "".join(f", coalesce(sum(d * l{k}), 0) AS g{k}" for k in range(1, lags + 1))
    var = "g0" + "".join(f" + 2 * {1 - k / (lags + 1)!r} * g{k}" for k in range(1, lags + 1))
    return f"""{name}_d AS (SELECT *, {value} - avg({value}) OVER (PARTITION BY {keys}) AS d FROM {source}),
{name}_l AS (SELECT *, {lagged} FROM {name}_d),
{name}_s AS (SELECT {keys}, count(*) AS n, count({value}) AS n_values, avg({value}) AS mean, sum(d * d) AS g0{sums} FROM {name}_l {group}),
{name}_t AS (SELECT *, CASE WHEN n_values = n AND n >= 2 AND {lags} <= n - 1 AND ({var}) > 0 THEN mean / sqrt(({var}) / n / n) END AS hac_t FROM {name}_s),
{name} AS (SELECT {keys}, n, n_values, mean, hac_t, {two_sided_p_sql("hac_t")} AS hac_p FROM {name}_t)"""


def bh(name: str, source: str, p: str = "hac_p") -> str:
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {p} IS NOT NULL ORDER BY {p}) AS r, count({p}) OVER () AS m FROM {source}),
{name} AS (SELECT * EXCLUDE (r, m), CASE WHEN {p} IS NOT NULL THEN least(1, min({p} * m / r) OVER (PARTITION BY {p} IS NOT NULL ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) END AS q_value FROM {name}_r)"""


def factor(name: str) -> str:
    """CTE f over the dense grid of brands."""
    start, end, required = FACTORS[name]
    over = "OVER (PARTITION BY symbol ORDER BY pos)"
    frame = f"OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {start} PRECEDING AND {end} PRECEDING)" if end else f"OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {start} PRECEDING AND CURRENT ROW)"
    value = f"price / avg(price) {frame} - 1" if name == "ma_distance_63s" else f"{f'lag(price, {end}) {over}' if end else 'price'} / lag(price, {start}) {over} - 1"
    return f"""f0 AS (SELECT symbol, session, pos, count(price) {frame} AS seen, {value} AS v, lag(session, {start}) {over} AS ws, {f'lag(session, {end}) {over}' if end else 'session'} AS we FROM grid),
f AS (SELECT symbol, session, pos, CASE WHEN pos - {start} < 0 THEN 'insufficient_history' WHEN seen < {required} THEN 'missing_required_prices' ELSE 'ok' END AS status, v, seen, ws, we FROM f0)"""
