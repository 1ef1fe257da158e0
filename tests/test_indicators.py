import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import structure

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, interval string, pos long, open_time timestamp_ntz, close double"


def recurrence(closes, state=None):
    """The averages bar by bar."""
    out = []
    for c in closes:
        if state is None:
            state = (c, c, 0.0)
            out.append((*state, 0.0))
            continue
        fast, slow = 2 / 13 * c + 11 / 13 * state[0], 2 / 27 * c + 25 / 27 * state[1]
        state = (fast, slow, 0.2 * (fast - slow) + 0.8 * state[2])
        out.append((*state, 2 * (fast - slow - state[2])))
    return out


def series(sizes, seed=1):
    r, rows = random.Random(seed), []
    for symbol, n in sizes.items():
        p = 1000.0
        for k in range(n):
            p += r.uniform(-5, 5)
            rows.append((symbol, "7h", k, T0 + dt.timedelta(hours=7 * k), p))
    return rows


@pytest.mark.parametrize("block", [16, 100, 512, 2048])
def test_macd_by_blocks_is_the_recurrence(spark, block):
    rows = series({"A": 3000, "B": 1, "C": 513, "D": 1024, "E": 16})
    off = {"A": 0, "B": 5, "C": 700, "D": block - 1, "E": block}  # a series may begin at any position
    bars = spark.createDataFrame([(s, i, k + off[s], t, c) for s, i, k, t, c in rows], SCHEMA).repartition(3)
    anchors = spark.createDataFrame([("C", "7h", 1003.5, 998.25, -1.75)], "symbol string, interval string, ema_fast double, ema_slow double, dea double")
    for seeds, got in ((None, structure.macd(bars, block=block)), (anchors, structure.macd(bars, anchors, ("open_time",), block))):
        found = {(x.symbol, x.pos - off[x.symbol]): (x.ema_fast, x.ema_slow, x.dea, x.hist) for x in got.collect()}
        assert len(found) == len(rows)
        for s in "ABCDE":
            start = (1003.5, 998.25, -1.75) if seeds is not None and s == "C" else None
            for k, want in enumerate(recurrence([x[4] for x in rows if x[0] == s], start)):
                assert found[s, k] == pytest.approx(want, abs=1e-10)
                assert k or start or found[s, k] == want


def test_one_series_spreads_over_tasks(spark):
    bars = spark.range(20_000).select(F.lit("A").alias("symbol"), F.lit("1m").alias("interval"), F.col("id").alias("pos"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("close"))
    out = structure.macd(bars)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_areas_by_running_sums(spark):
    """Against plain sums: ends on bars and between them, before and behind the series, single bars, long units."""
    rows = series({"A": 400, "B": 30})
    hist = structure.macd(spark.createDataFrame(rows, SCHEMA), keep=("open_time",))
    values = {}
    for x in hist.collect():
        values.setdefault(x.symbol, []).append((x.open_time, x.hist))
    r = random.Random(4)
    units = []
    for k in range(300):
        a, b = sorted(r.choice([r.randint(-20, 2900), 7 * r.randint(0, 399)]) for _ in range(2))
        units.append((r.choice("AABX"), "7h", k, r.choice(["up", "down"]), T0 + dt.timedelta(hours=a), T0 + dt.timedelta(hours=r.choice([a, b, b, b]))))
    frame = spark.createDataFrame(units, "symbol string, interval string, idx long, direction string, source_start timestamp_ntz, source_end timestamp_ntz")
    got = {x.idx: x.area for x in structure.directional_area(frame, hist).collect()}
    for s, _, k, way, a, b in units:
        sign = 1 if way == "up" else -1
        assert got[k] == pytest.approx(sum(max(0.0, sign * h) for t, h in values.get(s, []) if a <= t <= b), abs=1e-9)
    assert len(got) == 300 and structure.directional_area(frame.where("false"), hist).count() == 0
