"""Registered queries against their SQL counterparts at the smallest scale, and plan checks."""

import ast
import os
import pathlib

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent

# one query per plan shape; tests/oracle_check.py runs all of them
CHECKED = [
    "merge_sources", "latest_snapshot", "label_events", "unmatched_keys", "time_override", "signal_panel", "cell_geometry", "valid_cells",
    "focal_cells", "dense_grid", "clip_cells", "neighbour_features", "feature_store", "panel_full_calendar", "yearly_covariates",
    "parse_snapshots", "extract_records", "locf_panel", "target_cascade", "target_summary", "random_proportional", "class_report",
    "model_comparison", "monthly_f1", "key_alignment", "macro_roc", "macro_pr", "ranking_areas", "fold_metrics", "permuted_column",
    "describe_columns", "even_pick",
]

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    verdict, _, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert verdict.startswith("ok"), verdict


@needs_data
@pytest.mark.parametrize("name", ["feature_store", "signal_panel", "target_cascade", "model_comparison", "clip_cells", "unmatched_keys"])
def test_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@needs_data
def test_scan_is_pruned_and_filtered(spark):
    plan = entry.queries()["top_dyads"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "c_acctbal" not in plan
    signals = entry.queries()["signal_panel"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in signals


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_counterpart_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_never_cuts_lineage_locally_or_cross_joins():
    for path in (ROOT / "celltide").rglob("*.py"):
        if path.name == "oracle.py":
            continue
        names = {n.attr for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Attribute)}
        assert not names & {"localCheckpoint", "crossJoin", "udf", "toPandas"}, path
