"""Market clocks over daylight saving and holidays, and places counted level by level."""

import datetime as dt
import random
import re
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from barloom.operators import clocks
from barloom.operators.windows import level_rank, quantiles
from barloom.plans.catalog import load


def test_sessions_follow_the_clock(spark):
    holidays = spark.createDataFrame([("us", "2024-07-04"), ("hk", "2024-07-01")], "market string, day string").withColumn("day", F.to_date("day"))
    days = spark.sql("SELECT explode(sequence(DATE'2024-02-25', DATE'2024-11-20')) AS day")
    pick = random.Random(6)
    start = dt.datetime(2024, 2, 26)
    times = [start + dt.timedelta(minutes=pick.randint(0, 380_000), seconds=pick.randint(0, 59)) for _ in range(3000)]
    # the edges of a New York session on both sides of a change of the clock
    times += [dt.datetime(2024, 3, 8, 9, 0), dt.datetime(2024, 3, 8, 8, 59, 59), dt.datetime(2024, 3, 11, 8, 0), dt.datetime(2024, 3, 12, 0, 0, 59), dt.datetime(2024, 3, 12, 0, 1), dt.datetime(2024, 7, 4, 15, 0), dt.datetime(2024, 7, 1, 3, 0)]
    rows = spark.createDataFrame(list(enumerate(times)), "i long, ts timestamp_ntz")
    got = {(r["i"], r["market"], str(r["day"]), r["part"]) for r in clocks.in_sessions(rows, clocks.session_intervals(days, holidays)).collect()}
    parts = {"a": [(570, 690), (780, 900)], "a_auction": [(555, 690), (780, 900)], "hk": [(540, 720), (780, 970)], "us": [(240, 1200)]}
    zones = {"a": "Asia/Shanghai", "a_auction": "Asia/Shanghai", "hk": "Asia/Hong_Kong", "us": "America/New_York"}
    want = set()
    for i, t in enumerate(times):
        for market, bounds in parts.items():
            local = t.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(zones[market]))
            if local.weekday() >= 5 or (market, str(local.date())) in {("us", "2024-07-04"), ("hk", "2024-07-01")}:
                continue
            for k, (lo, hi) in enumerate(bounds):
                if lo <= local.hour * 60 + local.minute <= hi:
                    want.add((i, market, str(local.date()), k))
    assert got == want and {w[1] for w in want} == set(parts)
    n = len(times) - 7
    us = {i for i, m, _, _ in got if m == "us"}
    assert {n, n + 2, n + 3} <= us and not us & {n + 1, n + 4, n + 5}


def test_no_rows_no_days(spark):
    empty = spark.createDataFrame([], "ts timestamp_ntz")
    assert clocks.local_days(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_level_rank(spark, seed):
    pick = random.Random(seed)
    values = [0.0, 1.0, -1.0, 1e-300, 1e300, float("inf"), 2.5, 1000.0, 1000.5]
    rows = [(pick.choice(["x", "x", "x", "y", None]) or "z", pick.choice(values), k) for k in pick.sample(range(-5000, 100_000), 800)]
    got = {(r["s"], r["code"]): r["rank"] for r in level_rank(spark.createDataFrame(rows, "s string, v double, code long"), ["s"], "v", "code").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            want[key, r[2]] = place
    assert got == want


def test_no_window_over_a_whole_source(spark, sf):
    text = load()["rank_within_source"].run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Window .*\], \[source#\d+\], \[", text)
    specs = re.findall(r"windowspecdefinition\(([^)]*?(?:ASC|DESC))", text)
    assert specs and all("_o#" in s for s in specs)


def test_quantiles_by_hand(spark):
    pick = random.Random(9)
    values = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e-308, *[round(pick.uniform(-3, 3), 2) for _ in range(40)], *[1 + k * 1e-12 for k in range(40)]]
    rows = [(pick.choice(["a", "a", "a", "b", None]), pick.choice([None, *values])) for _ in range(3000)] + [("only", 4.0), ("none", None)]
    total = F.col("total")
    ranks = {"first": F.lit(0), "p10": F.floor((total - 1) * 0.1), "mid": F.floor(total / 2), "last": total - 1, "beyond": total}
    got = {r["k"]: r for r in quantiles(spark.createDataFrame(rows, "k string, v double"), "v", ranks, ["k"]).collect()}
    assert set(got) == {"a", "b", None, "only"}
    for k, r in got.items():
        x = sorted((v for key, v in rows if key == k and v is not None), key=lambda v: (v != v, v))
        n = len(x)
        assert r["total"] == n and r["beyond"] is None
        for name, at in (("first", 0), ("p10", int((n - 1) * 0.1)), ("mid", n // 2), ("last", n - 1)):
            assert r[name] == x[at] or (r[name] != r[name] and x[at] != x[at]), (k, name)
    overall = quantiles(spark.createDataFrame(rows, "k string, v double"), "v", {"mid": F.floor(total / 2)}).collect()
    assert len(overall) == 1 and overall[0]["mid"] == sorted((v for _, v in rows if v is not None), key=lambda v: (v != v, v))[overall[0]["total"] // 2]


@pytest.mark.parametrize("name", ["exact_median", "rank_quantiles"])
def test_quantiles_take_two_passes(spark, sf, name):
    text = load()[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    facts = [x for x in re.findall(r"FileScan parquet \[([^\]]*)\]", text) if "l_suppkey" in x]
    assert len(facts) <= 2 and len(re.findall("Exchange hashpartitioning", text)) <= 9
