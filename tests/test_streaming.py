import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators.inclusion import Bar
from barloom.operators.segment_machine import Ledger
from barloom.operators.stroke_machine import StrokeMachine
from barloom.plans.analysis import analyze
from barloom.streaming.live_segments import ANCHORS, Tracker, live_segments, net_segments

T0 = dt.datetime(2024, 1, 1)
MINUTE = 60_000_000
SCHEMA = "symbol string, interval string, open_time timestamp_ntz, close_time timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trade_count long, arrival long"


def walk(seed, n):
    r, price, out = random.Random(seed), 1000, []
    for k in range(n):
        o, price = price, price + r.randint(-12, 12)
        out.append((k * MINUTE, k * MINUTE + MINUTE - 1000, float(o), float(max(o, price) + r.randint(0, 3)), float(min(o, price) - r.randint(0, 3)), float(price), 1.0, 1.0))
    return out


def a_feed(seed, n):
    """Bars, some of them first with other prices (once or more), some followed by late rows."""
    r, out = random.Random(seed + 10_000), []
    for k, b in enumerate(walk(seed, n)):
        for _ in range(r.choice([0, 0, 0, 1, 3])):
            wild = r.randint(-40, 40)
            out.append((b[0], b[1], b[2], max(b[3], b[5] + wild), min(b[4], b[5] + wild), b[5] + wild, 1.0, 1.0))
        out.append(b)
        if r.random() < 0.2:
            out.append(b)  # the same row once more changes nothing
        if k > 5 and r.random() < 0.1:
            out.append(out[r.randint(0, k - 4)])
    return out


def shown(rows):
    now = []
    for kind, *r, _ in rows:
        if kind == "segment":
            assert r not in now
            now.append(r)
        elif kind == "retracted":
            now.remove(r)
    return [tuple(r) for r in now]


def batch(bars, least=4):
    ledger, out = Ledger(StrokeMachine(least), True), []
    for k, b in enumerate(bars):
        before = ledger.count
        for j, c in enumerate(ledger.push(Bar(k, *b))):
            a, z = c.strokes[0].a, c.strokes[-1].b
            out.append((before + j, c.strokes[0].direction, a.t, a.value, z.t, z.value, c.outcome.confirmation, c.committed_at))
    return out


def test_revisions_leave_what_a_batch_gives():
    retracted = total = 0
    for seed in range(60):
        r = random.Random(seed)
        feed, tracker, held, log, late = a_feed(seed, 260), Tracker(4), Tracker(4, hold=True), [], []
        while feed:
            cut = r.randint(1, 9)
            log += tracker.feed(feed[:cut])
            late += held.feed(feed[:cut])
            feed = feed[cut:]
        want = batch(walk(seed, 260))
        assert shown(log) == want
        assert shown(late) == batch(walk(seed, 259)) and not [x for x in late if x[0] == "retracted"]
        total, retracted = total + len(want), retracted + sum(x[0] == "retracted" for x in log)
    assert total > 100 and retracted > 0


def rows_of(symbol, feed, start=0):
    at = lambda us: T0 + dt.timedelta(microseconds=us)
    return [(symbol, "1m", at(b[0]), at(b[1]), *b[2:], 1, start + k) for k, b in enumerate(feed)]


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def run(spark, path, place, out, **settings):
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(SCHEMA).parquet(str(path))
    q = live_segments(stream, least=4, arrival="arrival", **settings).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(place)).start(str(out))
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(str(out))


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def plain(df):
    return sorted((r.symbol, r.idx, r.start_value, r.end_value, r.confirmation) for r in df.collect())


def test_stream_with_revisions_and_late_rows(spark, tmp_path, rocksdb):
    rows = [*rows_of("A", a_feed(1, 300)), *rows_of("B", a_feed(2, 200))]
    rows.sort(key=lambda r: r[-1])
    for k in range(0, len(rows), 150):
        put(spark, tmp_path / "bars", rows[k : k + 150])
    log = run(spark, tmp_path / "bars", tmp_path / "state", tmp_path / "out")
    feed = B.revised(spark.createDataFrame(rows, SCHEMA), "arrival")
    want = analyze(feed.where("state = 'current'").drop("arrival", "state"), least=4, trusted=True)
    assert plain(net_segments(log)) == plain(want.evidence.select("symbol", "interval", "pos", "confirmation").join(want.segments, ["symbol", "interval", "pos"]).withColumnRenamed("pos", "idx"))
    assert log.where("kind = 'late'").count() == feed.where("state = 'late'").count() > 0
    want.release()


def test_idle_keys_leave_anchors_and_come_back(spark, tmp_path, rocksdb):
    a, b = walk(5, 400), walk(6, 2000)
    put(spark, tmp_path / "one", rows_of("A", a[:200]) + rows_of("B", b[:200]))
    put(spark, tmp_path / "one", rows_of("B", b[200:1500], 200))
    put(spark, tmp_path / "one", rows_of("B", b[1500:1600], 1500))
    first = run(spark, tmp_path / "one", tmp_path / "s1", tmp_path / "o1", idle="300 minutes")
    anchors = first.where("kind = 'anchor'").select("symbol", "interval", "anchor")
    assert [r.symbol for r in anchors.collect()] == ["A"]  # B goes on
    # Another query starts from the anchor where A broke off.
    put(spark, tmp_path / "two", rows_of("A", a[200:], 200))
    second = run(spark, tmp_path / "two", tmp_path / "s2", tmp_path / "o2", anchors=anchors)
    whole = sorted(("A", r[0], r[3], r[5], r[6]) for r in batch(a))
    parts = net_segments(first.unionByName(second)).where("symbol = 'A'")
    assert plain(parts) == whole and second.where("kind = 'segment'").count() > 0


def test_a_known_endpoint_starts_a_series(spark, tmp_path, rocksdb):
    """From an endpoint known to be final on, the tail of a series has the segments of the whole."""
    bars = walk(9, 700)
    whole = batch(bars)
    end = whole[7]  # its end is final
    cut = end[4] // MINUTE - 60
    t0 = int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    put(spark, tmp_path / "tail", rows_of("A", bars[cut:]))
    anchors = spark.createDataFrame([("A", "1m", None, t0 + end[4], end[5], None)], ANCHORS)
    tail = run(spark, tmp_path / "tail", tmp_path / "s", tmp_path / "o", trusted=False, anchors=anchors)
    got = [(r.start_value, r.end_value) for r in net_segments(tail).orderBy("idx").collect()]
    assert got == [(r[3], r[5]) for r in whole[8:]] and got
    none = run(spark, tmp_path / "tail", tmp_path / "s3", tmp_path / "o3", trusted=False)
    assert none.where("kind = 'segment'").count() == 0
