import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import long_zones, zones

UNIT = "symbol string, interval string, pos long, direction string, start_value double, end_value double, high double, low double, start_dt timestamp_ntz, end_dt timestamp_ntz"


def chain(spark, sizes, seed=1):
    """Alternating units of random walks: quiet stretches make long zones, wild ones short."""
    r, rows = random.Random(seed), []
    for symbol, n in sizes.items():
        p, wild = 1000, 10
        for k in range(n):
            if k % 60 == 0:
                wild = r.choice([3, 10, 60])
            q = p + (1 if k % 2 else -1) * r.randint(0, wild)
            rows.append((symbol, "1m", k, p, q))
            p = q
    df = spark.createDataFrame(rows, "symbol string, interval string, pos long, a long, b long")
    at = lambda k: F.timestamp_seconds(F.col("pos") * 60 + k).cast("timestamp_ntz")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return df.select("symbol", "interval", "pos", F.when(F.col("pos") % 2 == 1, "up").otherwise("down").alias("direction"), a.alias("start_value"), b.alias("end_value"),
                     F.greatest(a, b).alias("high"), F.least(a, b).alias("low"), at(0).alias("start_dt"), at(60).alias("end_dt"))


def plain(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_doubling_gives_the_zones_of_the_fold(spark, monkeypatch):
    monkeypatch.setattr(long_zones, "BLOCK", 64)
    units = chain(spark, {"A": 1500, "B": 700, "C": 3, "D": 2, "E": 1}).repartition(5).cache()
    want = zones.segment_zones(units)
    assert plain(long_zones.zones_by_doubling(units).select(*want.columns)) == plain(want)
    assert want.agg(F.max("size")).first()[0] > 16 and want.count() > 60
    mixed = long_zones.segment_zones(units, long=1000)
    assert plain(mixed.select(*want.columns)) == plain(want)
    units.unpersist()


@pytest.mark.parametrize("seed", range(3))
def test_spans_on_dense_and_flat_series(spark, seed):
    r = random.Random(seed)
    rows = [("A", "1m", k, float(h), float(h - r.randint(0, 3))) for k, h in enumerate(r.choices(range(5 + 3 * seed), k=200))]
    df = spark.createDataFrame(rows, "symbol string, interval string, pos long, high double, low double")
    got = [(x.start_pos, x.end_pos, x.zg, x.zd) for x in long_zones.zone_spans(df).orderBy("zone").collect()]
    want, k = [], 0
    while k + 2 < len(rows):
        zg, zd = min(x[3] for x in rows[k : k + 3]), max(x[4] for x in rows[k : k + 3])
        e = k
        if zg >= zd:
            e = k + 2
            while e + 1 < len(rows) and rows[e + 1][3] >= zd and rows[e + 1][4] <= zg:
                e += 1
            want.append((k, e, zg, zd))
        k = e + 1
    assert got == want


def test_empty(spark):
    units = chain(spark, {"A": 5}).where("false")
    assert long_zones.zones_by_doubling(units).count() == 0 and long_zones.segment_zones(units).count() == 0
