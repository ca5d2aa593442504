"""Plans: no row products, one exchange by instrument for the feature build, pushed-down scans."""

import pathlib
import re

import pytest

from barloom.plans.catalog import load
from barloom.operators import features
from barloom.sources import views

ROOT = pathlib.Path(__file__).resolve().parent.parent


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["feature_table", "barrier_backtest", "asof_latest", "factor_daily_ic", "range_stats", "fifo_rows", "point_in_time", "chip_distribution"])
def test_no_cartesian_product(name, spark, sf):
    text = plan(load()[name].run(spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_feature_build_exchanges(spark, sf):
    text = plan(features.feature_table(views.bars_flows(spark, sf)))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2  # ticks to bars, bars to instruments


def test_scan_is_pruned(spark, sf):
    text = plan(views.flows(spark, sf).filter("code = 3"))
    assert "PushedFilters: [IsNotNull(l_suppkey), EqualTo(l_suppkey,3)]" in text
    assert "l_tax" not in text


def test_library_rules():
    source = "\n".join(p.read_text() for p in (ROOT / "barloom").rglob("*.py"))
    assert "localCheckpoint" not in source and "crossJoin(" not in source.replace("crossJoin(F.broadcast(", "")
    assert source.count(".collect()") <= 1  # the list of touched partitions in sinks


@pytest.mark.parametrize("name, scans", [("frequency_guard", 2), ("source_consensus", 1), ("limit_up_ladder", 1), ("moments", 1), ("feature_table", 1)])
def test_tables_are_read_once(name, scans, spark, sf):
    text = plan(load()[name].run(spark, sf))
    assert len(re.findall(r"FileScan parquet", text)) == scans
