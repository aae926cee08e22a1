"""Queries against their SQL, and the driver's contract."""

from __future__ import annotations

import subprocess
import sys

import pytest
from conftest import ROOT, same_as_sql

import __spark_entry__ as entry
from signalloom.plans import queries

CHOSEN = (
    "membership_overlaps", "coverage_by_date", "coverage_by_security", "panel_full", "factor_ma_distance_63s", "ic_summary", "quantile_spreads",
    "redundancy_pairs", "fold_assignments", "training_weights", "native_daily_metrics", "common_daily_metrics", "paired_summary", "top_k_weights", "ridge_gram", "archive_coverage",
)


@pytest.mark.parametrize("name", CHOSEN)
def test_sql(spark, name):
    same_as_sql(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), queries.ORACLE_SQL[name], "/root/testdata/sf0.01")


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_core_stands_without_the_corpus_operators():
    code = "import sys; sys.modules['signalloom.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'panel_full' in e.queries() and not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
