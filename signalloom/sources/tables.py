"""Scans: tables, decision dates, JSON, flat and wide exports."""

from __future__ import annotations

import csv
import hashlib
import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.contracts import ContractError, daily_date, require_columns, validate_as_of_dates
from ..functions.numeric import clean_double, on_each

#: Years of an archive at most.
MOST_YEARS = 10_000


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV (also gzipped) or Parquet, by suffix."""
    low = path.lower()
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith((".csv", ".csv.gz")):
        check_header(spark, path)
        return spark.read.csv(path, header=True, inferSchema=True, mode="FAILFAST")
    raise ContractError(f"unsupported table: {path}")


def check_header(spark: SparkSession, path: str) -> list[str]:
    """The first row's names; a repeated name is an error, which the CSV reader would hide by renaming."""
    first = spark.read.text(path).first()
    names = next(csv.reader([first[0]])) if first else []
    if len(set(names)) != len(names):
        raise ContractError(f"{path}: repeated column names")
    return names


def read_as_of_dates(spark: SparkSession, path: str) -> DataFrame:
    return validate_as_of_dates(read_table(spark, path))


def read_json_object(path: str | Path) -> dict:
    """A JSON object without repeated keys, NaN or infinities."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ContractError(f"{path}: repeated key")
        return out

    def constant(name):
        raise ContractError(f"{path}: {name} isn't JSON")

    def number(x):
        if not math.isfinite(value := float(x)):
            raise ContractError(f"{path}: {x} overflows")
        return value

    found = json.loads(Path(path).read_text(), object_pairs_hook=pairs, parse_constant=constant, parse_float=number)
    if not isinstance(found, dict):
        raise ContractError(f"{path}: not an object")
    return found


def local_path(path: str, root: str | None = None) -> Path:
    """A plain local path: no URL, share or device, and no link out of ``root``."""
    if "://" in path or path.startswith(("\\\\", "//")) or path.startswith("/dev/"):
        raise ContractError(f"not a local path: {path}")
    found = Path(path)
    resolved = found.resolve()
    if root is not None and not resolved.is_relative_to(Path(root).resolve()):
        raise ContractError(f"{path} leaves {root}")
    return resolved


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def verify_files(pins: dict[str, str]) -> None:
    """Compare files with pinned digests."""
    if wrong := [p for p, digest in pins.items() if file_sha256(p) != digest]:
        raise ContractError(f"changed files: {wrong}")


def flat_export(frame: DataFrame, symbol: str) -> tuple[DataFrame, DataFrame]:
    """A vendor's flat export as prices and a table of gaps. The plain close never stands in for the adjusted one."""
    require_columns(frame, ["Date", "Adj Close"], "export")
    day, bad = daily_date(frame, "Date")
    rows = frame.select(day.alias("date"), F.lit(symbol.strip().upper()).alias("symbol"), clean_double(F.col("`Adj Close`")).alias("adjusted_close"), bad.alias("_bad"))
    counts = rows.agg(F.count_if(F.col("_bad") | F.col("date").isNull()), F.count("*") - F.countDistinct("date")).first()
    if any(counts):
        raise ContractError(f"export of {symbol}: {counts[0]} bad dates, {counts[1]} repeated")
    gaps = rows.where("adjusted_close IS NULL").select("date", "symbol", F.lit("missing_adjusted_close").alias("reason"))
    return rows.where("adjusted_close IS NOT NULL").drop("_bad"), gaps


def import_files(spark: SparkSession, files: dict[str, str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Flat exports of several symbols as one table of prices, one of gaps, and the files' digests before and after."""
    before = {s: file_sha256(local_path(p)) for s, p in files.items()}
    both = [flat_export(read_table(spark, p), s) for s, p in sorted(files.items())]
    prices, gaps = both[0]
    for p, g in both[1:]:
        prices, gaps = prices.unionByName(p), gaps.unionByName(g)
    if before != {s: file_sha256(p) for s, p in files.items()}:
        raise ContractError("files changed during the import")
    return prices, gaps, before


def wide_archive(stocks: DataFrame, count: int | None = None, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A column a ticker to long prices and gaps, for the first ``count`` tickers by name and the dates asked for."""
    tickers = sorted(c for c in stocks.columns if c != "Date")[:count]
    day, bad = daily_date(stocks, "Date")
    rows = stocks.select(day.alias("date"), bad.alias("_bad"), *[clean_double(F.col(f"`{t}`")).alias(t) for t in tickers])
    if rows.where(F.col("_bad") | F.col("date").isNull()).count():
        raise ContractError("archive dates must be ISO days")
    rows = rows.drop("_bad")
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    long = rows.unpivot(["date"], tickers, "symbol", "adjusted_close")
    gaps = long.where("adjusted_close IS NULL").select("date", "symbol", F.lit("missing_adjusted_close").alias("reason"))
    return long.where("adjusted_close IS NOT NULL"), gaps


def index_levels(returns: DataFrame, date: str = "date", ret: str = "ret", base: float = 100.0) -> DataFrame:
    """Index levels from simple returns; the first date's return doesn't count. One row a date."""
    w = Window.orderBy(date)
    factor = F.when(F.row_number().over(w) == 1, F.lit(1.0)).otherwise(1 + F.col(ret))
    steps = returns.withColumn("_f", factor)
    return steps.select(date, (base * F.product("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("level"))


def factor_returns(factors: DataFrame) -> DataFrame:
    """Market returns (Mkt-RF + RF, percent) by date; refuses sentinels, nonfinite values and losses of all."""
    total = (F.col("`Mkt-RF`").cast("double") + F.col("RF").cast("double")) / 100
    day = F.to_date(F.when(F.col("Date").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.col("Date")), "M/d/yyyy")
    out = factors.select(day.alias("date"), total.alias("ret"), F.col("`Mkt-RF`").isin(-99.99, -999.0).alias("_m"), F.col("RF").isin(-99.99, -999.0).alias("_r"))
    bad = F.col("date").isNull() | F.col("_m") | F.col("_r") | clean_double("ret").isNull() | (F.col("ret") <= -1)
    if n := out.where(F.coalesce(bad, F.lit(True))).count():
        raise ContractError(f"{n} bad factor rows")
    return out.select("date", "ret")


def archive_coverage(prices: DataFrame, sessions: DataFrame, by_year: bool = False) -> DataFrame:
    """Expected, observed and missing prices a symbol (and year)."""
    keys = ["symbol", "year"] if by_year else ["symbol"]
    days = sessions.select(F.col("session").alias("date"), F.year("session").alias("year"))
    due = days.groupBy(*keys[1:]).agg(F.count("*").alias("expected"))
    seen = prices.join(days, "date").groupBy(*keys).agg(F.count("*").alias("observed"))
    every = on_each(prices.select("symbol").distinct(), due, MOST_YEARS)
    out = every.join(seen, keys, "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return out.withColumn("missing", F.col("expected") - F.col("observed")).withColumn("missing_rate", F.col("missing") / F.col("expected"))


def require_factor_dates(prices: DataFrame, factors: DataFrame) -> None:
    """Every date with a price must have a factor row."""
    if n := prices.select("date").distinct().join(factors.select("date"), "date", "left_anti").count():
        raise ContractError(f"{n} dates have prices and no factors")


def move_counts(returns: DataFrame, limit: float = 0.5) -> DataFrame:
    """How many adjacent-session returns there are, lie beyond the limit, or aren't finite."""
    clean = clean_double("r")
    return returns.agg(F.count("r").alias("returns"), F.count_if(F.abs(clean) > limit).alias("large"), F.count_if(F.col("r").isNotNull() & clean.isNull()).alias("nonfinite"))


def large_moves(returns: DataFrame, limit: float = 0.5, first: int | None = 20) -> DataFrame:
    """Adjacent-session returns beyond the limit, the first ones by date and symbol."""
    out = returns.where(F.abs("r") > limit).select("session", "symbol", "r")
    return out.orderBy("session", "symbol").limit(first) if first else out
