"""The point-in-time panel: trailing metrics, forward labels, price factors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contracts import ContractError
from ..functions.numeric import EPSILON, dealt, pct_rank, proven_few, safe_ratio
from .grid import MOST_SESSIONS, active_members, adjacent_returns, off_calendar

# The trailing metrics.
METRICS = (
    "trailing_return", "annualized_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown",
    "benchmark_correlation", "beta", "capm_alpha", "information_ratio", "historical_var_5pct",
)

# Start lag, end lag and number of prices of each factor.
FACTORS = {"return_21s": (21, 0, 22), "momentum_252s_skip_21s": (252, 21, 232), "ma_distance_63s": (62, 0, 63)}
FACTOR_VERSION = "1"

_LABELS = ("label_start_date", "label_end_date", "target_available", "target_status", "forward_return", "benchmark_forward_return", "forward_excess_return", "forward_excess_rank")


@dataclass(frozen=True)
class PanelConfig:
    dataset_version: str = "v1"
    universe_id: str = "default"
    benchmark_symbol: str = "BENCH"
    lookback_sessions: int = 252
    min_observations: int = 126
    target_horizon_sessions: int = 20
    entry_lag_sessions: int = 1
    annualization_sessions: int = 252
    annual_risk_free_rate: float = 0.0
    features: tuple[str, ...] = METRICS

    def __post_init__(self):
        counts = (self.lookback_sessions, self.target_horizon_sessions, self.annualization_sessions)
        if any(isinstance(x, bool) or not isinstance(x, int) or x < 1 for x in counts):
            raise ValueError("lookback, horizon and annualization must be positive integers")
        if not 2 <= self.min_observations <= self.lookback_sessions:
            raise ValueError("min_observations must lie between 2 and the lookback")
        if self.entry_lag_sessions < 1:
            raise ValueError("entry_lag_sessions must be at least 1")
        if not self.features or len(set(self.features)) != len(self.features) or not set(self.features) <= set(METRICS):
            raise ValueError("features must be unique known metrics")


def trailing_metrics(grid: DataFrame, cal: DataFrame, active: DataFrame, config: PanelConfig) -> DataFrame:
    """Ten metrics over the lookback of each active (as_of_date, symbol)."""
    rows = active.join(_framed(grid, active, config), ["as_of_date", "symbol"], "left")
    return rows.select(*_features(config))


def _framed(grid: DataFrame, active: DataFrame, config: PanelConfig, *more: Column) -> DataFrame:
    """The metrics of every symbol on the decision dates, and further columns of the grid.

    The grid is dense, so a lookback is a frame of rows: one shuffle by symbol,
    into all partitions that are configured, as frames cost far more than a
    row's bytes tell, and each grid row moves once. Two frames of a symbol's sessions serve all
    metrics. Rows of decision dates are taken, and their metrics made, before
    they meet the active members, so that no list of a lookback is shuffled.
    """
    n_year, rf = float(config.annualization_sessions), float(config.annual_risk_free_rate)
    paired = F.col("r").isNotNull() & F.col("b").isNotNull()
    rows = adjacent_returns(dealt(grid, "symbol")).withColumn("x", F.when(paired, F.col("r"))).withColumn("y", F.when(paired, F.col("b")))
    short = F.when(F.col("x").isNotNull(), F.least(F.col("x") - rf / n_year, F.lit(0.0)))
    rows = rows.withColumn("s", short * short).withColumn("d", F.col("x") - F.col("y"))
    by_symbol = Window.partitionBy("symbol").orderBy("pos")
    prices, returns = by_symbol.rowsBetween(-config.lookback_sessions, 0), by_symbol.rowsBetween(1 - config.lookback_sessions, 0)
    framed = rows.select(
        "symbol", F.col("session").alias("as_of_date"), F.col("price").alias("last_price"),
        F.first("session").over(prices).alias("feature_window_start"), F.first("price").over(prices).alias("first_price"), F.collect_list("price").over(prices).alias("path"),
        F.count("x").over(returns).alias("n"), F.avg("x").over(returns).alias("mean_r"), F.stddev_samp("x").over(returns).alias("sd_r"), F.avg("y").over(returns).alias("mean_b"),
        F.var_samp("y").over(returns).alias("var_b"), F.covar_samp("x", "y").over(returns).alias("cov"), F.avg("s").over(returns).alias("down"),
        F.avg("d").over(returns).alias("mean_d"), F.stddev_samp("d").over(returns).alias("sd_d"), F.sort_array(F.collect_list("x").over(returns)).alias("xs"), *more,
    )
    zero = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))
    fall = lambda a, p: F.struct(F.greatest(a["peak"], p).alias("peak"), F.least(a["worst"], p / F.greatest(a["peak"], p) - 1).alias("worst"))
    drawdown = F.when(F.size("path") > 0, F.aggregate("path", zero, fall, lambda a: a["worst"]))
    # The 5 % quantile by linear interpolation, of the sorted returns.
    place = (F.col("n") - 1) * 0.05
    low, high = F.get("xs", F.floor(place).cast("int")), F.get("xs", F.ceil(place).cast("int"))
    q05 = F.when(F.col("n") > 0, low + (high - low) * (place - F.floor(place)))
    root = float(n_year) ** 0.5
    excess = F.col("mean_r") * n_year - rf
    sd_b = F.sqrt("var_b")
    beta = F.when(F.col("var_b") > EPSILON, F.try_divide("cov", "var_b"))
    made = {
        "trailing_return": F.col("last_price") / F.col("first_price") - 1,
        "annualized_volatility": F.when(F.col("sd_r") > EPSILON, F.col("sd_r") * root),
        "sharpe_ratio": safe_ratio(excess, F.col("sd_r") * root),
        "sortino_ratio": safe_ratio(excess, F.sqrt("down") * root),
        "max_drawdown": drawdown,
        "benchmark_correlation": F.when((F.col("sd_r") > EPSILON) & (sd_b > EPSILON), F.try_divide("cov", F.col("sd_r") * sd_b)),
        "beta": beta,
        "capm_alpha": F.col("mean_r") * n_year - (rf + beta * (F.col("mean_b") * n_year - rf)),
        "information_ratio": safe_ratio(F.col("mean_d") * n_year, F.col("sd_d") * root),
        "historical_var_5pct": F.greatest(F.lit(0.0), -q05),
    }
    enough = F.col("n") >= config.min_observations
    rest = framed.columns[len(framed.columns) - len(more) :]
    return _decided(framed, active).select(
        "as_of_date", "symbol", "feature_window_start", *[F.when(enough, made[f]).alias(f) for f in config.features], "n", enough.alias("enough"),
        F.col("first_price").isNotNull().alias("starts"), F.col("last_price").isNotNull().alias("ends"), *rest,
    )


def _features(config: PanelConfig) -> list[Column]:
    """The features' columns of active rows beside their frames, if they have any."""
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    return [
        F.col("as_of_date"), F.col("symbol"), F.col("as_of_date").alias("feature_available_at"), F.col("feature_window_start"), F.col("as_of_date").alias("feature_window_end"),
        *map(F.col, config.features),
        F.coalesce("n", F.lit(0)).cast("long").alias("observation_count"),
        F.when(F.col("enough"), "ok").otherwise("insufficient_history").alias("feature_status"),
        known("starts").alias("window_start_price_available"), known("ends").alias("decision_price_available"), known("enough").alias("feature_eligible"),
    ]


def _decided(rows: DataFrame, active: DataFrame) -> DataFrame:
    """The rows of dates on which anyone is active."""
    return rows.join(proven_few(active.select("as_of_date").distinct(), MOST_SESSIONS), "as_of_date", "left_semi")


def forward_labels(grid: DataFrame, cal: DataFrame, bench: DataFrame, active: DataFrame, config: PanelConfig) -> DataFrame:
    """Entry and exit sessions, availability, status, forward returns and their rank."""
    if "bench" not in grid.columns:
        grid = grid.join(bench.select("session", F.col("price").alias("bench")), "session", "left")
    ends = _decided(grid.select("symbol", F.col("session").alias("as_of_date"), *_ends(config)), active)
    return _labelled(active.join(ends, ["as_of_date", "symbol"], "left"), cal, config).select("as_of_date", "symbol", *_LABELS)


def _ends(config: PanelConfig) -> list[Column]:
    """Prices at both ends of the label: the grid is dense, so they are so many rows on."""
    w, begin, length = Window.partitionBy("symbol").orderBy("pos"), config.entry_lag_sessions, config.target_horizon_sessions
    return [F.lead(c, n).over(w).alias(f"{p}{name}") for c, p in (("price", ""), ("bench", "bench_")) for name, n in (("entry", begin), ("exit", begin + length))]


def _labelled(active: DataFrame, cal: DataFrame, config: PanelConfig) -> DataFrame:
    """Active rows, beside the prices of ``_ends``, with their labels."""
    rows = active.join(proven_few(label_sessions(cal, config), MOST_SESSIONS), "as_of_date", "left")
    return dealt(_returned(rows), "as_of_date").withColumn("forward_excess_rank", pct_rank("forward_excess_return", "as_of_date"))


def label_sessions(cal: DataFrame, config: PanelConfig) -> DataFrame:
    """as_of_date, label_start_date and label_end_date of every session; a window that leaves the calendar has neither."""
    begin, length = config.entry_lag_sessions, config.target_horizon_sessions
    at = cal.select(F.col("session").alias("as_of_date"), F.col("pos").alias("at"))
    ends = at.join(cal.select((F.col("pos") - begin).alias("at"), F.col("session").alias("s0")), "at", "left")
    ends = ends.join(cal.select((F.col("pos") - begin - length).alias("at"), F.col("session").alias("label_end_date")), "at", "left")
    return ends.select("as_of_date", F.when(F.col("label_end_date").isNotNull(), F.col("s0")).alias("label_start_date"), "label_end_date")


def _returned(rows: DataFrame) -> DataFrame:
    """Status, availability and returns beside both sessions of a label and the prices on them."""
    status = (
        F.when(F.col("label_end_date").isNull(), "insufficient_future_benchmark_history")
        .when(F.col("entry").isNull() | F.col("exit").isNull(), "missing_symbol_price")
        .when(F.col("bench_entry").isNull() | F.col("bench_exit").isNull(), "missing_benchmark_price")
        .otherwise("ok")
    )
    out = rows.withColumn("target_status", status)
    ok = F.col("target_status") == "ok"
    out = out.withColumn("target_available", ok).withColumn("forward_return", F.when(ok, F.col("exit") / F.col("entry") - 1))
    out = out.withColumn("benchmark_forward_return", F.when(ok, F.col("bench_exit") / F.col("bench_entry") - 1))
    return out.withColumn("forward_excess_return", F.col("forward_return") - F.col("benchmark_forward_return"))


def forward_targets(prices: DataFrame, bench: DataFrame, ends: DataFrame, active: DataFrame) -> DataFrame:
    """label_end_date, forward_return and forward_excess_return of active rows as ``forward_labels`` has them, without a grid.

    ``ends``: ``label_sessions`` of the decision dates. A price meets the dates
    whose labels begin or end on its session by a broadcast; other prices aren't needed.
    """
    side = lambda name: F.struct(F.col(f"label_{'start' if name == 'entry' else 'end'}_date").alias("session"), F.lit(name == "entry").alias("first"))
    sides = ends.where("label_end_date IS NOT NULL").select("as_of_date", F.inline(F.array(side("entry"), side("exit"))))
    met = prices.select("symbol", "session", "price").join(proven_few(sides, 2 * MOST_SESSIONS), "session")
    price = lambda first: F.max(F.when(F.col("first") if first else ~F.col("first"), F.col("price")))
    seen = met.groupBy("as_of_date", "symbol").agg(price(True).alias("entry"), price(False).alias("exit"))
    levels = ends
    for end, name in (("label_start_date", "bench_entry"), ("label_end_date", "bench_exit")):
        levels = levels.join(bench.select(F.col("session").alias(end), F.col("price").alias(name)), end, "left")
    rows = active.join(seen, ["as_of_date", "symbol"], "left").join(proven_few(levels, MOST_SESSIONS), "as_of_date", "left")
    return _returned(rows).select("as_of_date", "symbol", "label_end_date", "forward_return", "forward_excess_return")


def build_panel(prices: DataFrame, cal: DataFrame, bench: DataFrame, members: DataFrame, dates: DataFrame, config: PanelConfig) -> DataFrame:
    """One row for each (as_of_date, active symbol). ``prices``: symbol, session, price; a decision date must be a session."""
    from .grid import dense_grid

    grid = dense_grid(prices, cal, bench)
    active = active_members(dates, members)
    # One pass over the grid for features and labels.
    rows = active.join(_framed(grid, active, config, *_ends(config)), ["as_of_date", "symbol"], "left")
    rows = _labelled(rows, cal, config)
    fixed = {
        "dataset_version": config.dataset_version, "universe_id": config.universe_id, "benchmark_symbol": config.benchmark_symbol,
        "lookback_sessions": config.lookback_sessions, "min_observations": config.min_observations, "target_horizon_sessions": config.target_horizon_sessions,
        "entry_lag_sessions": config.entry_lag_sessions, "annualization_sessions": config.annualization_sessions, "annual_risk_free_rate": config.annual_risk_free_rate,
    }
    return rows.select(*[F.lit(v).alias(k) for k, v in fixed.items()], *_features(config), *_LABELS)


def price_factors(grid: DataFrame, names: tuple[str, ...] = tuple(FACTORS)) -> DataFrame:
    """Factor columns (value, status, window, counts) on every (symbol, session) of a dense grid."""
    if not names or len(set(names)) != len(names) or not set(names) <= set(FACTORS):
        raise ValueError("factor names must be unique and known")
    w = Window.partitionBy("symbol").orderBy("pos")
    out = grid
    for name in names:
        start, end, required = FACTORS[name]
        frame = w.rowsBetween(-start, -end)
        seen, enough = F.count("price").over(frame), F.col("pos") - start >= 0
        if name == "ma_distance_63s":
            top = F.max("price").over(frame)
            value = F.col("price") / top / F.avg(F.col("price")).over(frame) * top - 1
        else:
            value = F.lag("price", end).over(w) / F.lag("price", start).over(w) - 1
        status = F.when(~enough, "insufficient_history").when(F.col(f"{name}_observed_price_count") < required, "missing_required_prices").otherwise("ok")
        ok = F.col(f"{name}_status") == "ok"
        out = out.withColumn(f"{name}_observed_price_count", seen).withColumn(f"{name}_status", status)
        out = out.withColumn(name, F.when(ok, value)).withColumn(f"{name}_available_at", F.when(ok, F.col("session").cast("timestamp")))
        out = out.withColumn(f"{name}_window_start", F.when(enough, F.lag("session", start).over(w))).withColumn(f"{name}_window_end", F.lag("session", end).over(w) if end else F.col("session"))
        out = out.withColumn(f"{name}_required_price_count", F.lit(required).cast("long")).withColumn(f"{name}_formula_version", F.lit(FACTOR_VERSION))
    columns = [c for n in names for c in (n, f"{n}_available_at", f"{n}_status", f"{n}_window_start", f"{n}_window_end", f"{n}_required_price_count", f"{n}_observed_price_count", f"{n}_formula_version")]
    return out.select("symbol", "session", *columns)


def compute_price_factors(prices: DataFrame, cal: DataFrame, as_of, names: tuple[str, ...] = tuple(FACTORS)) -> DataFrame:
    """The factors of one series (session, price) at one decision date, one row a name in the order asked for.

    Values after the decision don't matter, but their dates must be sessions as
    all others, and so must the decision date.
    """
    if n := off_calendar(prices, cal).count():
        raise ContractError(f"{n} prices on days that are no sessions")
    if prices.groupBy("session").count().where("count > 1").count():
        raise ContractError("repeated sessions in a series")
    if not cal.where(F.col("session") == F.lit(as_of)).count():
        raise ContractError("the decision date is no session")
    known = prices.where(F.col("session") <= F.lit(as_of)).select(F.lit("_").alias("symbol"), "session", "price")
    # A series without an earlier price has a grid all the same.
    grid = cal.where(F.col("session") <= F.lit(as_of)).select(F.lit("_").alias("symbol"), "pos", "session").join(known, ["symbol", "session"], "left")
    row = price_factors(grid, names).where(F.col("session") == F.lit(as_of))
    parts = ("available_at", "status", "window_start", "window_end", "required_price_count", "observed_price_count", "formula_version")
    records = [F.struct(F.lit(n).alias("factor"), F.lit(i).alias("n"), F.col(n).alias("value"), *[F.col(f"{n}_{p}").alias(p) for p in parts]) for i, n in enumerate(names)]
    return row.select(F.inline(F.array(*records))).orderBy("n").drop("n")


def add_factors(panel: DataFrame, factors: DataFrame) -> DataFrame:
    """The panel with factor columns at each decision date; names must not collide."""
    new = [c for c in factors.columns if c not in ("symbol", "session")]
    if clash := set(new) & set(panel.columns):
        raise ValueError(f"factor columns shadow panel columns: {sorted(clash)}")
    return panel.join(factors.withColumnRenamed("session", "as_of_date"), ["as_of_date", "symbol"], "left")
