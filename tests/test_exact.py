"""Exact sums against fractions, and typed bundles with planted faults."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest

from signalloom.functions.exact import exact_sums
from signalloom.sources import sinks


def test_sums_are_rounded_once_for_any_partitions(spark):
    rng = np.random.default_rng(1)
    values = [1e308, 1.0, -1e308, 1e-308, 1e16, 1.0, 1.0, -1e16, 5e-324, 0.1, 0.2, -0.3, *(rng.standard_normal(300) * 10.0 ** rng.integers(-30, 30, 300)).tolist()]
    rows = [("a", v) for v in values] + [("b", None), ("b", math.nan), (None, 0.5), (None, math.inf), ("z", 0.0), ("z", -0.0), ("m", -1.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {"a": math.fsum(values), "b": None, None: 0.5, "z": 0.0, "m": -1.5}
    for parts in (1, 7):
        out = {r["k"]: r for r in exact_sums(df.repartition(parts), ["k"], "v").collect()}
        assert {k: r["total"] for k, r in out.items()} == want and (out["a"]["n"], out["b"]["n"], out[None]["n"]) == (312, 0, 1)
    assert exact_sums(df.limit(0), ["k"], "v").count() == 0
    odd = spark.createDataFrame([(2**53 + 1, 0.1), (2**53 + 1, 0.2), (None, 1.0)], "e long, v double")
    assert {tuple(r) for r in exact_sums(odd, ["e"], "v", "n_total").collect()} == {(2**53 + 1, 2, 0.1 + 0.2), (None, 1, 1.0)}


def test_bundles_are_read_with_their_types_and_bad_cells_are_named(spark, tmp_path):
    path = str(tmp_path / "bundle")
    table = spark.createDataFrame([(1, "x", 0.5, None), (2, None, -1.0, True)], "i int, s string, d double, b boolean")
    files = sinks.write_bundle(path, {"one": table, "none": table.limit(0)}, {"kind": "test"})
    manifest, tables = sinks.read_bundle(spark, path)
    assert manifest["files"] == files and tables["one"].schema.simpleString() == table.schema.simpleString() and sorted(tables["one"].collect()) == sorted(table.collect()) and tables["none"].count() == 0
    cells = spark.createDataFrame([("1", "x", "0.5", None), ("two", "y", "oops", "true")], "i string, s string, d string, b string")
    with pytest.raises(ValueError, match=r"one.i: 'two' is no int; one.d: 'oops' is no double"):
        sinks.typed(cells, manifest["types"]["one"], "one")
    with pytest.raises(ValueError, match="columns"):
        sinks.typed(cells.select("s", "i", "d", "b"), manifest["types"]["one"], "one")
    with open(f"{path}/one.csv", "a") as f:
        f.write("3,z,1.0,false\n")
    with pytest.raises(ValueError, match="isn't the file"):
        sinks.read_bundle(spark, path)
    assert json.load(open(f"{path}/manifest.json"))["kind"] == "test"
