"""Spark operators against SQL, literal fixtures and their own sequential cores."""

import datetime as dt
import json
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__
from barloom.functions.intervals import interval_seconds, next_open_time
from barloom.operators import bars as B
from barloom.operators import legacy_segments, live, points, recursive_points, structure, validators, zones
from barloom.plans.analysis import analyze
from barloom.plans.frames import frames
from barloom.plans.oracles import ORACLES
from barloom.plans.queries import QUERIES
from barloom.sources import bar_files
from barloom.sources.demo import demo_bars
from barloom.sources.paged_klines import KlineReader, KlineStreamReader, fetch
from barloom.streaming import live_bars

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
K = {"symbol": "X", "interval": "1m"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["resample_by_type", "stream_issues", "bar_gaps", "next_open", "snapshot_merge", "merged_bars", "fractals", "macd", "macd_area", "stroke_zone_groups", "segment_zones", "third_points", "inner_third_points", "legacy_faults"])
def test_against_sql(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cur = sql.execute(ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)


def test_sound_legacy_segments_have_no_issue(spark):
    u = QUERIES["unit_chain"](spark, SF)
    for mode in ("strict", "loose"):
        seg = legacy_segments.legacy_segments(u, mode)
        assert seg.count() and legacy_segments.legacy_issues(seg, u, mode).count() == 0
    assert legacy_segments.legacy_issues(seg.where("false"), u).count() == 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def series(n, seed=1, symbol="X", minutes=1):
    r, p, out = random.Random(seed), 100.0, []
    for i in range(n):
        drift = r.uniform(-1, 1) if i % 18 == 0 else drift
        c = p + drift * 0.6 + r.gauss(0, 0.8)
        t = T0 + dt.timedelta(minutes=minutes * i)
        out.append((symbol, f"{minutes}m", t, t + dt.timedelta(seconds=60 * minutes - 0.001), p, max(p, c) + abs(r.gauss(0, 0.4)), min(p, c) - abs(r.gauss(0, 0.4)), c, 1.0, 1.0, 1))
        p = c
    return out


BAR = "symbol string, interval string, open_time timestamp, close_time timestamp, open double, high double, low double, close double, volume double, quote_volume double, trade_count long"


@pytest.fixture(scope="module")
def walks(spark):
    return spark.createDataFrame(series(1500, 1, "A") + series(1500, 2, "B") + series(700, 3, "C"), BAR)


def units(spark, values, top_first, minutes=None):
    rows, t = [], T0
    for k in range(len(values) - 1):
        a, b = float(values[k]), float(values[k + 1])
        end = t + dt.timedelta(minutes=minutes[k] if minutes else 5)
        rows.append(("X", "1m", k, "down" if b < a else "up", a, b, max(a, b), min(a, b), t, end, t, end, 3, end))
        t = end
    assert (rows[0][3] == "down") == top_first
    return spark.createDataFrame(rows, "symbol string, interval string, pos long, direction string, start_value double, end_value double, high double, low double, start_dt timestamp, end_dt timestamp, source_start timestamp, source_end timestamp, size long, committed_at timestamp")


def judge(spark, values, top_first, areas=None, exact=True):
    u = units(spark, values, top_first)
    a = spark.createDataFrame([("X", "1m", k, float((areas or {}).get(k, 5.0))) for k in range(len(values) - 1)], "symbol string, interval string, pos long, area double")
    e = spark.createDataFrame([("X", "1m", exact)], "symbol string, interval string, exact boolean")
    rows = points.candidates(u, zones.segment_zones(u), a, e, u.select("symbol", "interval", "pos", "committed_at")).collect()
    return {(r.point_type, r.segment_pos, r.status) for r in rows}, rows


DOWN = [140, 120, 135, 125, 132, 100, 112, 102, 110, 90, 108, 80, 95, 85]
UP = [60, 80, 65, 75, 68, 100, 88, 98, 90, 110, 92, 120, 105, 115]


def test_first_and_second_points(spark):
    got, rows = judge(spark, DOWN, True, {4: 50.0})
    assert {("B1", 10, "confirmed"), ("B2", 12, "confirmed")} <= got
    assert all(r.confirmed_at is not None for r in rows if r.status == "confirmed")
    assert {("S1", 10, "confirmed"), ("S2", 12, "confirmed")} <= judge(spark, UP, False, {4: 50.0})[0]
    broken = judge(spark, [*DOWN[:-1], 79], True, {4: 50.0})[0]
    assert {("B1", 10, "confirmed"), ("B2", 12, "rejected")} <= broken
    assert ("B1", 10, "pending") in judge(spark, DOWN, True, {4: 50.0}, exact=False)[0]
    assert ("B1", 10, "rejected") in judge(spark, DOWN, True)[0]
    assert not {x for x in judge(spark, [120, 100, 115, 95, 108, 90], True)[0] if x[0] in ("B1", "S1")}


def test_older_points_look_inside(spark):
    zone = spark.createDataFrame([("X", "1m", 0, 90.0, 100.0, 0)], "symbol string, interval string, zone long, zd double, zg double, end_pos long")
    for values, third, count in [([110, 80, 88, 70, 78, 60, 72, 50], 1, 2), ([110, 80, 95, 70, 78, 60, 72, 50], 3, 2), ([110, 80, 95, 70], None, 1)]:
        for sign in (1, -1):
            v = [x if sign == 1 else 190 - x for x in values]
            strokes = units(spark, v, sign == 1)
            leg = strokes.where("pos = 0").withColumns({"start_pos": F.lit(0).cast("long"), "end_pos": F.lit(len(v) - 1).cast("long")})
            r = recursive_points.inside(zone, leg, strokes).collect()
            assert [(x.symbol, x.third_pos, x.n_zones, x.whole) for x in r] == [("X", third, count, third is not None)]
    u = units(spark, DOWN, True)
    a = u.select("symbol", "interval", "pos", F.when(F.col("pos") == 4, 50.0).otherwise(5.0).alias("area"))
    e, z, key = u.select("symbol", "interval").distinct().withColumn("exact", F.lit(True)), zones.segment_zones(u), ["symbol", "interval"]
    for whole, status in ((True, "confirmed"), (False, "pending")):
        first = points.first_points(u, z, a, e, None, z.select(*key, "zone", F.lit(whole).alias("whole")))
        assert ("B1", 10, status) in {(r.point_type, r.segment_pos, r.status) for r in first.collect()}
    first = points.first_points(u, z, a, e)
    met = u.where("pos = 12").select(*key, F.col("pos").alias("segment"), F.lit("B1").alias("point_type"), F.col("end_dt").alias("dt"), F.col("end_value").alias("price"))
    for lower, reason in ((met, "FIRST_PULLBACK_HOLDS"), (met.withColumn("point_type", F.lit("S1")), "NO_POINT_INSIDE"), (met.withColumn("price", F.col("price") + 1), "NO_POINT_INSIDE")):
        assert [r.reason for r in points.second_points(first, u, None, lower).collect()] == [reason]
    inner = u.withColumn("symbol", F.lit("X"))
    seg = u.where("pos = 0").withColumns({"symbol": F.lit("X"), "start_pos": F.lit(0).cast("long"), "end_pos": F.lit(13).cast("long")})
    got = recursive_points.stroke_first_points(seg, inner, a, e).collect()
    assert [(r.symbol, r.segment, r.point_type, r.price) for r in got] == [("X", 0, "B1", 80.0)]


def test_third_point_and_gates(spark):
    assert ("B3", 5, "confirmed") in judge(spark, [100, 120, 105, 118, 108, 130, 118], False)[0]
    u = units(spark, [10, 20, 12, 18], False)
    assert points.structure_issues(u).count() == points.provenance_issues(u).count() == 0
    assert points.structure_issues(u.withColumn("size", F.lit(2))).first().code == "STROKE_COUNT"
    assert points.provenance_issues(u.withColumn("committed_at", F.lit(None).cast("timestamp"))).first().code == "NOT_COMMITTED"
    _, rows = judge(spark, DOWN, True, {4: 50.0})
    judged = spark.createDataFrame(rows)
    given = points.points(judged)
    assert points.recheck(given, judged).count() == 0
    assert {r.code for r in points.recheck(given.where("point_type <> 'B2'"), judged).collect()} == {"MISSING"}
    assert points.buy_points(given).count() + points.sell_points(given).count() == given.count()


@pytest.mark.parametrize(
    ("values", "spans"),
    [
        ([10, 20, 12, 18], [(0, 2, 12, 18)]), ([10, 20, 12, 18, 13, 17], [(0, 4, 12, 18)]),
        ([10, 20, 12, 25, 22, 28, 23], [(0, 2, 12, 20), (3, 5, 23, 25)]), ([10, 20, 30, 40], []),
    ],
)
def test_segment_zones(spark, values, spans):
    u = units(spark, values, False) if values != [10, 20, 30, 40] else units(spark, [10, 20, 12, 18], False).withColumns({"low": F.col("pos") * 10 + 10.0, "high": F.col("pos") * 10 + 15.0})
    assert sorted((r.start_pos, r.end_pos, r.zd, r.zg) for r in zones.segment_zone_spans(u).collect()) == spans
    z = zones.segment_zones(u)
    assert zones.zone_issues(z, u).count() == 0
    formal = {(r.start_pos, r.end_pos) for r in z.collect()}
    assert not formal & {(r.start_pos, r.end_pos) for r in zones.zone_candidates(u, z).collect()}


def test_stroke_zones(spark):
    z = zones.stroke_zones(units(spark, [10, 20, 12, 18], False)).first()
    assert (z.zd, z.zg, z.zz, z.gg, z.dd) == (12, 18, 15, 20, 10)
    groups = {r.group: r.size for r in zones.stroke_zone_groups(units(spark, [10, 20, 12, 18, 13, 25, 22], False)).collect()}
    assert groups == {0: 5, 1: 1}


def test_analysis_layers(spark, walks):
    a = analyze(walks, least=6, trusted=True)
    committed, detected = a.segments.collect(), a.detected_segments.collect()
    assert len(committed) > 6 and {r.symbol for r in committed} == {"A", "B", "C"}
    key = lambda r: (r.symbol, r.start_dt, r.end_dt)
    assert {key(r) for r in committed} <= {key(r) for r in detected}
    assert a.segment_overlay.count() == len(detected) - len(committed)
    assert all(r.committed_at >= r.end_dt for r in committed)
    assert points.structure_issues(a.segments).count() == 0 and points.provenance_issues(a.segments).count() == 0
    assert a.evidence.count() == len(committed) and a.feature_fractals.count() > 0
    assert {r.layer for r in a.strokes.collect()} == {"stable", "provisional"}
    names = frames(a)
    assert len(names) == 25
    for n in ("strokes", "segments", "fractals", "segment_evidence", "unfinished_bars"):
        assert names[n].count() > 0
    alone = analyze(walks.where("symbol = 'B'"), least=6, trusted=True).segments
    assert sorted(map(key, alone.collect())) == sorted(key(r) for r in committed if r.symbol == "B")
    loose = analyze(walks, least=6)
    assert loose.segments.count() == 0 and loose.detected_segments.count() == len(detected)
    assert validators.stroke_issues(a.strokes, a.fractals, 6).count() == 0
    assert validators.segment_issues(a.detected_segments, a.strokes).count() == 0 == validators.segment_issues(a.segments, a.strokes).count()
    assert validators.feature_coverage(a.feature_elements, a.strokes).count() == 0
    assert validators.superseded_gap_endpoints(a.evidence, a.segments, a.strokes).count() == 0 == validators.commit_conflicts(a.evidence).count()
    bad = a.segments.withColumn("high", F.col("high") + 1)
    assert {r.code for r in validators.segment_issues(bad, a.strokes).collect()} == {"BOUNDS"}
    short = a.strokes.withColumn("length", F.lit(3))
    assert {r.code for r in validators.stroke_issues(short, a.fractals, 6).collect()} == {"STROKE_TOO_SHORT"}
    a.release()
    loose.release()


def older_segments(values, first_top, mode="strict", latest=None):
    """The older finder, plainly: segments as pairs of endpoint positions."""
    top = [(k % 2 == 0) == first_top for k in range(len(values))]
    kept = []
    for k in range(2, len(values) - 2):
        v, left, right = values[k], values[k - 2], values[k + 2]
        if not (left <= v >= right if top[k] else left >= v <= right):
            continue
        if not kept:
            kept.append(k)
            continue
        p = kept[-1]
        if top[p] == top[k]:
            if v > values[p] if top[k] else v < values[p]:
                kept[-1] = k
            continue
        if v >= values[p] if top[p] else v <= values[p]:
            kept.pop()
            continue
        chain, right_side = values[p : k + 1], values[k:]
        if len(chain) < 4:
            continue
        if len(chain) == 4:
            ok = v > chain[-3] if top[k] else v < chain[-3]
            if mode == "strict":
                ok = ok and (chain[-2] < right_side[1] if top[k] else chain[-2] > right_side[1])
            if not ok:
                continue
        kept.append(k)
    if kept and latest and (latest[0] > values[kept[-1]] if top[kept[-1]] else latest[1] < values[kept[-1]]):
        kept.pop()
    return list(zip(kept, kept[1:], strict=False))


def test_older_segments(spark):
    cases = {
        "unconfirmed": ([9, 1, 5, 0, 6, 3, 7, 2, 4, 1, 5, 3, 8, 2, 9], True), "equal tops": ([1, 5, 0, 4, 2, 9, 3, 9, 2, 6, 1, 5, -1, 4, 0, 5], False),
        "order": ([1, 3, 0, 2, 1, 9, 8, 20, 15, 19, 14, 12, 11, 16, 10], False),
    }
    for n in range(60):
        r = random.Random(n)
        values = [r.randint(40, 60)]
        for k in range(r.choice((1, 2, 5, 40, 90))):
            values.append(values[-1] + r.randint(1, 12) * (1 if (k % 2 == 0) == (n % 2 == 0) else -1))
        cases[f"walk {n}"] = (values, n % 2 == 1)
        cases[f"jumps {n}"] = ([r.randint(0, 9) for _ in range(50)], n % 2 == 1)
    t = lambda k: T0 + dt.timedelta(minutes=k)
    rows = [(s, "1m", k, "down" if (k % 2 == 0) == top else "up", float(v[k]), float(v[k + 1]), t(k), t(k + 1)) for s, (v, top) in cases.items() for k in range(len(v) - 1)]
    strokes = spark.createDataFrame(rows, "symbol string, interval string, pos long, direction string, start_value double, end_value double, start_dt timestamp, end_dt timestamp")
    bars = {s: (float(v[-1] + h), float(v[-1] - h)) for s, (v, _) in cases.items() if s != "order" for h in [random.Random(s).randint(0, 12)]}
    merged = spark.createDataFrame([(s, "1m", m, b[0] + 99 * (1 - m), b[1] - 99 * (1 - m)) for s, b in bars.items() for m in (0, 1)], "symbol string, interval string, mpos long, high double, low double")
    found = {}
    for mode in ("strict", "loose"):
        for use in (None, merged):
            got = {}
            for r in legacy_segments.legacy_segments(strokes, mode, use).orderBy("symbol", "idx").collect():
                values, top = cases[r.symbol]
                assert (r.start_value, r.end_value) == (values[r.start_pos], values[r.end_pos]) and (r.direction == "down") == ((r.start_pos % 2 == 0) == top)
                got.setdefault(r.symbol, []).append((r.start_pos, r.end_pos))
            want = {s: older_segments(v, top, mode, bars.get(s) if use is not None else None) for s, (v, top) in cases.items()}
            assert got == {s: x for s, x in want.items() if x}, mode
            found[mode, use is not None] = sum(map(len, got.values()))
    assert len(set(found.values())) == 4 and min(found.values()) > 50
    with pytest.raises(ValueError, match="mode"):
        legacy_segments.turning_points(strokes, "other")


def test_macd_continues_from_its_anchor(spark, walks):
    one = B.with_position(walks.where("symbol = 'A'"))
    whole = structure.macd(one)
    half = structure.macd(one.where("pos < 700"))
    s = structure.macd_anchor(half, one).first()
    assert s.processed_bar_count == 700
    rest = structure.macd(one.where("pos >= 700"), spark.createDataFrame([("A", "1m", s.ema_fast, s.ema_slow, s.dea)], "symbol string, interval string, ema_fast double, ema_slow double, dea double"))
    # Blocks of the two runs begin elsewhere, so sums may differ in their last bits.
    both = rest.select("pos", F.col("hist").alias("h")).join(whole, "pos").select("h", "hist").collect()
    assert len(both) == one.count() - 700 and all(abs(r.h - r.hist) < 1e-10 for r in both)


def test_live(spark, walks):
    a = structure.merged_bars(B.with_position(walks)).withColumnRenamed("mpos", "pos")
    assert {r.length for r in live.common_prefix(a, a.where("pos < 40"), ["dt", "high"]).collect()} == {40}
    assert live.diff_summary(live.positional_diff(a, a, ["pos"], ["dt", "high"])).where("compared <> matched").count() == 0
    snap = B.snapshot(walks, walks.limit(0), F.lit(T0 + dt.timedelta(minutes=1500)).cast("timestamp"), 100)
    assert snap.where("is_closed").groupBy("symbol").count().where("count <> 100").count() == 0
    assert B.all_bars(snap).count() == snap.count() and live.refresh_trigger("1m") == "10 seconds" and live.refresh_trigger("1M") == "1800 seconds"
    with pytest.raises(ValueError, match="2s"):
        live.refresh_trigger("2s")


def test_two_live_layers(spark, walks):
    from barloom.plans.analysis import analyze_snapshot

    snap = walks.where("symbol = 'A'").withColumn("is_closed", F.col("open_time") < walks.where("symbol = 'A'").agg(F.max("open_time")).first()[0])
    first = analyze_snapshot(snap, least=6, trusted=True)
    lines = first.provisional_strokes.collect()
    stable = first.confirmed.resolved_strokes.count()
    assert [r.reason for r in lines].count("RIGHT_TAIL") == first.live.strokes.count() - stable and [r.reason for r in lines].count("PROJECTED") <= 1
    assert all(r.end_dt > r.start_dt and r.end_value != r.start_value for r in lines)
    seg = first.provisional_segments.collect()
    assert sum(r.reason == "RIGHT_TAIL" for r in seg) == first.live.detected_segments.count() - first.confirmed.segments.count()
    moved = snap.withColumn("close", F.when(F.col("is_closed"), F.col("close")).otherwise((F.col("high") + F.col("low")) / 2))
    assert analyze_snapshot(moved, least=6, trusted=True, previous=first).confirmed is first.confirmed
    assert analyze_snapshot(snap.where("open_time > '2024-01-01 05:00:00' OR is_closed = false").limit(50), least=6, trusted=True, previous=first).confirmed is not first.confirmed
    # Without a trusted start nothing is formal: every live unit is dashed, and the next segment starts from unfinished strokes.
    loose = analyze_snapshot(snap, least=6)
    assert {r.reason for r in loose.provisional_strokes.collect()} <= {"UNRESOLVED_BOUNDARY", "PROJECTED"} and loose.live.projected_segment.count() <= 1


def test_left_boundary(spark, walks):
    full = analyze(walks.where("symbol = 'B'"), least=6, trusted=True)
    start = full.segments.orderBy("pos").collect()[1]
    mark = "D" if start.direction == "up" else "G"
    window = walks.where("symbol = 'B'").where(F.col("open_time") >= F.lit(start.start_dt) - F.expr("INTERVAL '10' HOUR"))
    micros = int(spark.createDataFrame([(start.start_dt,)], "t timestamp").select(F.unix_micros("t")).first()[0])
    part = analyze(window, least=6, anchors={("B", start.interval): (micros, start.start_value, mark)})
    ours, theirs = [[(r.start_dt, r.end_dt) for r in a.segments.orderBy("pos").collect()] for a in (part, full)]
    assert not ours or any(theirs[k : k + len(ours)] == ours for k in range(len(theirs)))
    zone = lambda df: [(r.start_dt, r.zg, r.zd) for r in df.collect()]
    held, formal, every = zone(part.unresolved_stroke_zones), zone(part.stroke_zones), zone(zones.stroke_zones(part.resolved_strokes))
    assert len(held) <= 1 and not set(held) & set(formal) and (not every or set(held) | set(formal) >= set(every) or held)
    assert analyze(window, least=6).stroke_zones.count() == 0 and not part.exact.first().exact
    b = window.withColumn("n", F.row_number().over(Window.orderBy("open_time")))
    head, tail = window.join(b.where("n <= 100").select("open_time"), "open_time"), window.join(b.where("n > 100").select("open_time"), "open_time")
    anchor = analyze(head, least=6, trusted=True).macd_anchor
    on = analyze(tail, least=6, macd_anchors=anchor)
    assert on.exact.first().exact
    whole = {r.open_time: r.hist for r in (lambda a: a.macd.join(a.positioned.select("pos", "open_time"), "pos"))(analyze(window, least=6)).collect()}
    assert all(abs(whole[r.open_time] - r.hist) < 1e-9 for r in on.macd.join(on.positioned.select("pos", "open_time"), "pos").collect())
    gap = analyze(tail.where(F.col("open_time") > tail.agg(F.min("open_time")).first()[0]), least=6, macd_anchors=anchor)
    assert not gap.exact.first().exact


def test_gates_look_inside(spark, walks):
    a = analyze(walks.where("symbol = 'A'"), least=6, trusted=True)
    s, k, e = a.segments, a.strokes, a.evidence
    code = lambda df: [r.code for r in df.collect()]
    p = s.where("pos = 0").first().start_pos
    assert code(points.structure_issues(s, k)) == [] == code(points.provenance_issues(s, e))
    assert code(points.structure_issues(s, k.withColumn("low", F.when(F.col("pos") == p + 1, F.col("high") + 500).otherwise(F.col("low"))))) == ["FIRST_THREE_APART"]
    assert code(points.structure_issues(s, k.withColumn("end_value", F.when(F.col("pos") == p, F.col("end_value") + 1).otherwise(F.col("end_value"))))) == ["INNER_ENDPOINT_NOT_SHARED"]
    assert code(points.structure_issues(s.withColumn("start_value", F.when(F.col("pos") == 0, F.col("start_value") - 0.5).otherwise(F.col("start_value"))), k)) in (["ENDPOINT_STROKES"], ["ENDPOINT_DIRECTION"])
    assert code(points.provenance_issues(s, e.where("pos > 0"))) == ["EVIDENCE_MISSING"] and code(points.provenance_issues(s.where("pos > 0"), e)) == ["SEGMENT_MISSING"]
    assert code(points.provenance_issues(s, e.withColumn("fingerprint", F.lit("x")))) == ["EVIDENCE_OF_ANOTHER"]
    judged = spark.createDataFrame(a.judged.collect(), a.judged.schema)
    assert points.formal_issues(points.points(judged), judged, s, k, e).count() == 0
    assert [(r.rule, r.code) for r in points.formal_issues(points.points(judged), judged, s, k, e.withColumn("committed_at", F.lit(None).cast("timestamp"))).collect()] == [("provenance", "NOT_COMMITTED")]


def test_command_line(spark, tmp_path):
    from barloom.__main__ import main

    main(["export-demo", str(tmp_path / "demo"), "--count", "400"], spark)
    main(["analyze", str(tmp_path / "demo"), str(tmp_path / "out"), "--least", "6", "--trusted", "--frames", "strokes", "fractals", "--symbol", "demo"], spark)
    strokes = spark.read.option("header", True).csv(str(tmp_path / "out" / "strokes"))
    assert strokes.count() > 3 and {r.symbol for r in strokes.collect()} == {"DEMO"} and not (tmp_path / "out" / "merged").exists()


def test_intervals(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 31), i) for i in ("1M", "15m", "1w", "x", "3s")], "t timestamp, i string")
    got = rows.select("i", next_open_time(F.col("t"), F.col("i")).alias("n"), interval_seconds(F.col("i")).alias("s")).collect()
    assert [(r.i, r.n and r.n.isoformat(), r.s) for r in got] == [
        ("1M", "2024-02-29T00:00:00", 2592000), ("15m", "2024-01-31T00:15:00", 900), ("1w", "2024-02-07T00:00:00", 604800), ("x", None, None), ("3s", None, 3),
    ]


def test_csv_layouts(spark, tmp_path, walks):
    (tmp_path / "b.csv").write_text("open_timestamp_utc,close_timestamp_utc,open,high,low,close,volume\n1704067200,1704070799,1,3,0.5,2,7\n")
    (tmp_path / "c.csv").write_text("1704067200000000,1,3,0.5,2,7,1704070799999000,14,5,0,0,0\n")
    (tmp_path / "a.csv").write_text("open_time,open,high,low,close\n2024-01-01T00:00:00+00:00,1,3,0.5,2\n")
    got = [bar_files.read_csv(spark, str(tmp_path / f"{n}.csv"), " btc ", "1h").first() for n in "abc"]
    assert {(r.symbol, r.open_time, r.high, r.close) for r in got} == {("BTC", T0, 3.0, 2.0)}
    assert [r.volume for r in got] == [0.0, 7.0, 7.0] and got[0].close_time == T0 + dt.timedelta(seconds=3599.999) and got[2].trade_count == 5
    bar_files.write_csv(walks.where("symbol = 'C'"), str(tmp_path / "out"))
    assert bar_files.read_csv(spark, str(tmp_path / "out"), "C", "1m").exceptAll(walks.where("symbol = 'C'")).count() == 0
    body = json.dumps([[1704067200000, "1", "3", "0.5", "2", "7", 1704070799999, "14", 5, "0", "0", "0"], [1]])
    rows = bar_files.parse_klines(spark.createDataFrame([(body,)], "b string"), "b", "x", "1h").collect()
    assert [(r.symbol, r.open_time, r.low) for r in rows] == [("X", T0, 0.5)]


def test_demo_bars(spark):
    d = demo_bars(spark, 300)
    assert d.count() == 300 and B.bar_violations(d).count() == 0 and B.continuity(d).first().continuous
    assert structure.fractals(structure.merged_bars(B.with_position(d))).count() > 20


def test_paging_and_retries(tmp_path):
    hour = 3_600_000
    rows = [[k * hour, "1", "2", "0", "1", "1", (k + 1) * hour - 1, "1", 1, "0", "0", "0"] for k in range(30)]
    (tmp_path / "k.json").write_text(json.dumps(rows))
    r = KlineReader({"symbol": "x", "interval": "1h", "from": str(5 * hour), "page": "10", "end": str(29 * hour), "url": f"file://{tmp_path}/k.json"})
    pages = r.partitions()
    assert len(pages) == 3 and sorted(x[2] for p in pages for x in r.read(p)) == [k * hour for k in range(5, 30)]
    st = KlineStreamReader({"symbol": "x", "interval": "1h", "page": "10", "url": f"file://{tmp_path}/k.json"}, now=lambda: 25.5 * 3600)
    end = st.latestOffset()
    assert end == {"open": 24 * hour}
    assert sorted(x[2] for p in st.partitions(st.initialOffset(), end) for x in st.read(p)) == [k * hour for k in range(25)]
    assert sorted(x[2] for p in st.partitions({"open": 20 * hour}, end) for x in st.read(p)) == [k * hour for k in range(21, 25)]
    waits, calls = [], []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise TimeoutError
        return open(tmp_path / "k.json", "rb")

    assert fetch("u", sleep=waits.append, opener=opener)[:2] == b"[[" and waits == [0.5, 1.0]


def test_streams(spark, tmp_path, walks):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = tmp_path / "ticks"
    events.where("event_id < 700").coalesce(1).write.parquet(str(src))
    events.where("event_id >= 700").coalesce(1).write.mode("append").parquet(str(src))
    ticks = spark.readStream.schema(events.schema).parquet(str(src))
    q = live_bars.closed_bars(ticks, "4h", F.lit("ALL"), "ts", "value", ["event_id"]).writeStream.outputMode("append").format("memory").queryName("closed").start()
    q.processAllAvailable()
    q.stop()
    batch = B.resample(events, "4h", F.lit("ALL"), "ts", "value", ["event_id"]).select("open_time", "open", "close", "trade_count")
    closed = spark.table("closed").select("open_time", "open", "close", "trade_count")
    assert closed.count() > 100 and closed.exceptAll(batch).count() == 0

    want = {(r.symbol, r.start_value, r.end_value) for r in analyze(walks, least=6, trusted=True).segments.collect()}
    src = tmp_path / "bars"
    cut = F.col("open_time") < F.lit(T0 + dt.timedelta(minutes=600))
    walks.where(cut).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(walks.schema).parquet(str(src))
    place = str(tmp_path / "state")
    go = lambda: live_bars.committed_segments(stream, least=6).writeStream.outputMode("append").format("parquet").option("checkpointLocation", place).start(str(tmp_path / "out"))
    q = go()
    q.processAllAvailable()
    q.stop()
    walks.where(~cut).unionByName(walks.where("symbol = 'A'").limit(1)).coalesce(1).write.mode("append").parquet(str(src))
    q = go()  # a new query takes the state from the checkpoint
    q.processAllAvailable()
    q.stop()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.symbol, r.start_value, r.end_value) for r in out if r.kind == "segment"} == want
    assert sum(r.kind == "late" for r in out) == 1
