"""Sums of doubles that are rounded once, whatever the order and the partitions of the rows."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .numeric import clean_double

#: Bits of the lower half of a double's 53 bits: sums of a batch's halves fit 63 bits.
HALF = 27


def exact_sums(df: DataFrame, keys: list[str], value: str, name: str = "total") -> DataFrame:
    """keys, n and the sum of ``value`` by key; what is missing or not finite doesn't count.

    A double is a whole number of 53 bits times a power of two. Tasks add the
    upper and lower halves of these whole numbers by key and power, Spark adds
    what the tasks have, in decimals, and a key's few powers are added as fractions
    and rounded to the nearest double. A key without values has a null sum.
    """
    asked, keys = keys, [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(a).alias(k) for a, k in zip(asked, keys, strict=True)], clean_double(value).alias("_v"))
    fields = [rows.schema[k] for k in keys]
    parts = StructType([*fields, StructField("e", LongType()), StructField("high", LongType()), StructField("low", LongType()), StructField("n", LongType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("_v").to_numpy(zero_copy_only=False).astype(float)
            known = ~np.isnan(v)
            m, e = np.frexp(np.where(known, v, 0.0))
            whole = (m * 2.0**53).astype(np.int64)
            made = {"e": np.where(whole != 0, e - 53, 0).astype(np.int64), "high": whole >> HALF, "low": whole & ((1 << HALF) - 1), "n": known.astype(np.int64)}
            told = pa.table({**{k: batch.column(k) for k in keys}, **made}).group_by([*keys, "e"], use_threads=False).aggregate([(c, "sum") for c in ("high", "low", "n")])
            told = told.rename_columns([c.removesuffix("_sum") for c in told.column_names]).select(batch_schema.names).cast(batch_schema).combine_chunks()
            yield from told.to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    batch_schema = to_arrow_schema(parts)
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c)
    sums = rows.mapInArrow(split, parts).groupBy(*keys, "e").agg(wide("high"), wide("low"), F.sum("n").alias("n"))
    each = sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list(F.struct("e", "high", "low")).alias("_p"))  # at most 2,100 powers
    out = StructType([*fields, StructField("n", LongType()), StructField(name, DoubleType())])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sum(((int(p["high"]) << HALF) + int(p["low"])) * Fraction(2) ** int(p["e"]) for p in ps) for ps in batch.column("_p").to_pylist()]
            sums = [_nearest(x) if n else None for x, n in zip(made, batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*keys, "n")], pa.array(sums, pa.float64())], names=out.names)

    return each.mapInArrow(total, out).toDF(*asked, "n", name)


def _nearest(x: Fraction) -> float:
    try:
        return x.numerator / x.denominator
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")
