"""Contracts of inputs: normalise, count violations in one pass, raise with the counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import clean_double

_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class ContractError(ValueError):
    """An input breaks its contract; the message counts the violations."""


def require_columns(df: DataFrame, columns: list[str], what: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ContractError(f"{what} lack columns {missing}")


def text(c: str) -> Column:
    return F.trim(F.col(c).cast("string"))


def symbol(c: str) -> Column:
    return F.upper(text(c))


def daily_date(df: DataFrame, c: str) -> tuple[Column, Column]:
    """The date and whether the value isn't a day: only dates, midnight timestamps and ISO text are days."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.DateType):
        return F.col(c), F.lit(False)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(c).cast("date"), F.col(c).isNotNull() & (F.date_trunc("day", F.col(c)) != F.col(c))
    if isinstance(kind, T.StringType):
        day = F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr(f"try_cast(trim(`{c}`) AS DATE)"))
        return day, F.col(c).isNotNull() & day.isNull()
    raise ContractError(f"{c} must hold daily dates, not {kind.simpleString()}")


def positive_price(df: DataFrame, c: str) -> tuple[Column, Column]:
    """The price as a double and whether it isn't finite and positive."""
    kind = df.schema[c].dataType
    if not isinstance(kind, (*_PLAIN, T.StringType)):
        raise ContractError(f"{c} must be numeric, not {kind.simpleString()}")
    value = clean_double(F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    return value, value.isNull() | (value <= 0)


def strict_numeric(df: DataFrame, c: str) -> tuple[Column, Column]:
    """A nullable finite number, and whether the value breaks that."""
    kind = df.schema[c].dataType
    if not isinstance(kind, _PLAIN):
        raise ContractError(f"{c} must be numeric, not {kind.simpleString()}")
    value = clean_double(c)
    return value, F.col(c).isNotNull() & value.isNull()


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def _enforce(df: DataFrame, checks: dict[str, Column], keys: list[str], what: str) -> None:
    row = df.agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in checks.items()]).first().asDict()
    row["duplicate keys"] = duplicate_keys(df, keys).count()
    if broken := {k: v for k, v in row.items() if v}:
        raise ContractError(f"{what}: {broken}")


def price_violations(prices: DataFrame) -> DataFrame:
    """Counts of what ``validate_prices`` refuses, one row."""
    require_columns(prices, ["date", "symbol", "adjusted_close"], "prices")
    day, bad_day = daily_date(prices, "date")
    price, bad_price = positive_price(prices, "adjusted_close")
    name = symbol("symbol")
    made = prices.select(day.alias("date"), name.alias("symbol"), bad_day.alias("bad_day"), bad_price.alias("bad_price"))
    twice = duplicate_keys(made, ["date", "symbol"]).agg(F.count("*").alias("duplicate_keys"))
    counts = made.agg(
        F.count("*").alias("rows"), F.count_if(F.col("date").isNull() | F.col("bad_day")).alias("bad_dates"),
        F.count_if(F.coalesce(F.col("symbol"), F.lit("")) == "").alias("bad_symbols"), F.count_if("bad_price").alias("bad_prices"),
    )
    return counts.join(F.broadcast(twice))


def validate_prices(prices: DataFrame) -> DataFrame:
    """Normalised prices (date, symbol, adjusted_close and other columns); raises on violations."""
    row = price_violations(prices).first().asDict()
    if broken := {k: v for k, v in row.items() if v and k != "rows"}:
        raise ContractError(f"prices: {broken}")
    day, _ = daily_date(prices, "date")
    price, _ = positive_price(prices, "adjusted_close")
    return prices.withColumns({"date": day, "symbol": symbol("symbol"), "adjusted_close": price})


def membership_overlaps(members: DataFrame) -> DataFrame:
    """Intervals that begin before their predecessor ends, or after one that never ends."""
    w = Window.partitionBy("universe_id", "symbol").orderBy("effective_from", F.col("effective_to").asc_nulls_last())
    prior = members.withColumn("previous_to", F.lag("effective_to").over(w)).withColumn("_n", F.row_number().over(w))
    bad = (F.col("_n") > 1) & (F.col("previous_to").isNull() | (F.col("effective_from") < F.col("previous_to")))
    return prior.where(bad).drop("_n")


def validate_memberships(members: DataFrame) -> DataFrame:
    require_columns(members, ["universe_id", "symbol", "effective_from", "effective_to", "source"], "memberships")
    begin, bad_begin = daily_date(members, "effective_from")
    end, bad_end = daily_date(members, "effective_to")
    out = members.withColumns({"universe_id": text("universe_id"), "symbol": symbol("symbol"), "source": text("source"), "effective_from": begin, "effective_to": end, "_bad": bad_begin | bad_end})
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = {
        "bad dates": F.col("_bad") | F.col("effective_from").isNull(), "empty text": empty("universe_id") | empty("symbol") | empty("source"),
        "empty intervals": F.coalesce(F.col("effective_to") <= F.col("effective_from"), F.lit(False)),
    }
    _enforce(out, checks, ["universe_id", "symbol", "effective_from"], "memberships")
    out = out.drop("_bad")
    if n := membership_overlaps(out).count():
        raise ContractError(f"memberships: {n} overlaps")
    return out


def validate_as_of_dates(dates: DataFrame) -> DataFrame:
    require_columns(dates, ["as_of_date"], "decision dates")
    day, bad = daily_date(dates, "as_of_date")
    out = dates.select(day.alias("as_of_date"), bad.alias("_bad"))
    _enforce(out, {"bad dates": F.col("_bad") | F.col("as_of_date").isNull()}, ["as_of_date"], "decision dates")
    if out.isEmpty():
        raise ContractError("decision dates are empty")
    return out.drop("_bad").orderBy("as_of_date")


def row_id(date: str = "as_of_date", name: str = "symbol") -> Column:
    """A stable id of a panel row from its date (nanoseconds since the epoch) and symbol; the session's zone must be UTC."""
    nanos = (F.unix_micros(F.col(date).cast("timestamp")) * 1000).cast("string")
    return F.concat(F.lit("qmr_"), F.sha2(F.concat(nanos, F.lit("|"), F.col(name)), 256))


def validate_panel(panel: DataFrame, features: list[str], target: str, realized: str | None = None) -> DataFrame:
    """A benchmark panel in canonical form with row_id; raises on violations of keys, numbers, labels or availability."""
    realized = realized or target
    require_columns(panel, ["as_of_date", "symbol", "label_end_date", *features, target, realized], "panel")
    day, bad_day = daily_date(panel, "as_of_date")
    label, bad_label = daily_date(panel, "label_end_date")
    out = panel.withColumns({"as_of_date": day, "symbol": symbol("symbol"), "label_end_date": label, "_bad": bad_day | bad_label})
    numbers = dict.fromkeys([*features, target, realized])
    checks = {f"{c} not finite": strict_numeric(panel, c)[1] for c in numbers}
    checks |= {
        "bad dates": F.col("_bad") | F.col("as_of_date").isNull(),
        "label not after decision": F.coalesce(F.col("label_end_date") <= F.col("as_of_date"), F.lit(False)),
        "target without label": F.col(target).isNotNull() & F.col("label_end_date").isNull(),
    }
    if "decision_time" in panel.columns:
        checks["decision on another day"] = F.coalesce(F.col("decision_time").cast("date") != F.col("as_of_date"), F.lit(True))
    deadline = F.col("decision_time") if "decision_time" in panel.columns else F.col("as_of_date").cast("timestamp")
    for f in features:
        known = f"{f}_available_at" if f"{f}_available_at" in panel.columns else "feature_available_at" if "feature_available_at" in panel.columns else None
        if known:
            checks[f"{f} not available in time"] = F.col(f).isNotNull() & F.coalesce(F.col(known).cast("timestamp") > deadline, F.lit(True))
    _enforce(out, checks, ["as_of_date", "symbol"], "panel")
    return out.drop("_bad").withColumns({c: clean_double(c) for c in numbers}).withColumn("row_id", row_id())


def observations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as finite doubles: numbers and numeric text are read, missing and non-finite numbers are null; other types and text are errors."""
    made, bad = {}, {}
    for c in columns:
        kind = df.schema[c].dataType
        if not isinstance(kind, (*_PLAIN, T.StringType)):
            raise ContractError(f"{c} must be numeric, not {kind.simpleString()}")
        made[c] = clean_double(F.expr(f"try_cast(`{c}` AS DOUBLE)"))
        if isinstance(kind, T.StringType):
            bad[c] = F.col(c).isNotNull() & (F.trim(c) != "") & made[c].isNull()
    if bad and (found := {c: n for c, n in df.agg(*[F.count_if(x).alias(c) for c, x in bad.items()]).first().asDict().items() if n}):
        raise ContractError(f"text that isn't a finite number: {found}")
    return df.withColumns(made)


def validate_signal_panel(panel: DataFrame, features: list[str], target: str, least: int) -> DataFrame:
    """A panel for screening: a least cross-section of 2 or more, its columns, unique (as_of_date, symbol), days, numeric signals."""
    if isinstance(least, bool) or not isinstance(least, int) or least < 2:
        raise ContractError("the least cross-section must be an integer of 2 or more")
    require_columns(panel, ["as_of_date", "symbol", *features, target], "panel")
    day, bad = daily_date(panel, "as_of_date")
    rows = observations(panel, list(dict.fromkeys([*features, target]))).withColumn("as_of_date", day).withColumn("_bad", bad)
    _enforce(rows, {"bad dates": F.col("_bad") | F.col("as_of_date").isNull(), "bad symbols": F.coalesce(text("symbol"), F.lit("")) == ""}, ["as_of_date", "symbol"], "panel")
    return rows.drop("_bad")


def validate_daily_ic(daily: DataFrame, date: str = "as_of_date") -> DataFrame:
    """Rank correlations by feature and date: both there, unique together, values finite or null."""
    require_columns(daily, ["feature", date, "rank_ic"], "daily correlations")
    rows = observations(daily, ["rank_ic"])
    _enforce(rows, {"no feature": F.coalesce(text("feature"), F.lit("")) == "", "no date": F.col(date).isNull()}, ["feature", date], "daily correlations")
    return rows


def validate_schedule(dates) -> list:
    """An ordered sequence of distinct increasing days; sets have no order and are refused."""
    import datetime

    if isinstance(dates, (set, frozenset, dict, str)):
        raise ContractError("a schedule must be an ordered sequence")
    days = [datetime.date.fromisoformat(d) if isinstance(d, str) else d for d in dates]
    if not days or any(not isinstance(d, datetime.date) or isinstance(d, datetime.datetime) for d in days):
        raise ContractError("a schedule must hold days")
    if any(a >= b for a, b in zip(days, days[1:], strict=False)):
        raise ContractError("a schedule must increase")
    return days


def validate_training(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Training rows of a baseline: unique (as_of_date, symbol), numbers or null."""
    require_columns(rows, ["as_of_date", "symbol", *features, target], "training rows")
    clean = observations(rows, list(dict.fromkeys([*features, target])))
    _enforce(clean, {"no key": F.col("as_of_date").isNull() | F.col("symbol").isNull()}, ["as_of_date", "symbol"], "training rows")
    return clean


def validate_predictions(predictions: DataFrame) -> None:
    keys = ["phase", "fold", "as_of_date", "symbol", "model"]
    require_columns(predictions, [*keys, "score", "target", "realized_return"], "predictions")
    checks = {f"{c} not finite": strict_numeric(predictions, c)[1] for c in ("score", "target", "realized_return")}
    checks |= {f"{c} not trimmed": F.coalesce((F.trim(c) != F.col(c)) | (F.col(c) == ""), F.lit(True)) for c in ("phase", "symbol", "model")}
    _enforce(predictions, checks, keys, "predictions")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same bag of rows; nulls equal nulls."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows whatever their order: counts and sums of two row hashes."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in sorted(df.columns)]
    digest = F.sha2(F.concat_ws("\x1f", *cells), 256)
    halves = [F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    row = df.select(*[h.alias(f"h{i}") for i, h in enumerate(halves)]).agg(F.count("*"), *[F.sum(f"h{i}") for i in range(5)]).first()
    import hashlib

    return hashlib.sha256("|".join([*sorted(df.columns), *map(str, row)]).encode()).hexdigest()


def iso_day(value: str) -> bool:
    return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", value))
