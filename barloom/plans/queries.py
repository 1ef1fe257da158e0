"""Named queries over the test tables, each with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.intervals import interval_seconds, next_open_time
from ..operators import bars as B
from ..operators import legacy_segments, live, long_zones, points, recursive_points, segment_faults, structure, validators, zones
from ..operators.folds import KEYS
from ..sources import bar_files
from .analysis import analyze, analyze_snapshot

K = list(KEYS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one symbol, by the hour."""
    return B.resample(read(spark, sf_dir, "events"), "1h", F.lit("ALL"), "ts", "value", ["event_id"])


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resample(read(spark, sf_dir, "events"), "4h", F.col("event_type"), "ts", "value", ["event_id"])


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resample(read(spark, sf_dir, "events"), "1h", F.col("user_id").cast("string"), "ts", "value", ["event_id"])


def weekly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("ts", F.col("l_shipdate").cast("timestamp_ntz"))
    return B.resample(rows, "1w", F.concat("l_returnflag", F.lit("/"), "l_linestatus"), "ts", "l_extendedprice", ["l_orderkey", "l_linenumber"], F.col("l_quantity").cast("double"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp_ntz"))
    return B.resample(rows, "1d", F.col("o_orderpriority"), "ts", "o_totalprice", ["o_orderkey"])


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Sums of doubles, which depend on the order of adding in their last bits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of a whole-numbered random walk per event type, which trends as prices do.

    The running sum is taken within each hour and, over one row an hour, from hour to hour, so no task
    holds all events of a type."""
    step = F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(201)) - 100
    ticks = read(spark, sf_dir, "events").select("event_type", "event_id", "ts", step.alias("step"), F.date_trunc("hour", "ts").alias("hour"))
    hours = ticks.groupBy("event_type", "hour").agg(F.sum("step").alias("total"))
    before = F.sum("total").over(Window.partitionBy("event_type").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    within = F.sum("step").over(Window.partitionBy("event_type", "hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    ticks = ticks.join(hours.select("event_type", "hour", F.coalesce(before, F.lit(0)).alias("before")), ["event_type", "hour"])
    ticks = ticks.withColumn("price", (100000 + F.col("before") + within).cast("double"))
    return B.resample(ticks, "1h", F.concat(F.lit("walk/"), F.col("event_type")), "ts", "price", ["event_id"])


def unit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternating units between extreme fractals: of fractals of one mark in a row the most extreme
    (the latest of equals) stands; neighbours make a unit. All series run side by side."""
    all_bars = hourly(spark, sf_dir).unionByName(walk(spark, sf_dir))
    f = structure.raw_fractals(structure.merged_bars(B.with_position(all_bars)))
    w = Window.partitionBy(*K).orderBy("mpos")
    runs = f.withColumn("new", (F.lag("mark").over(w) != F.col("mark")).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(w))
    rank = F.struct(F.when(F.col("mark") == "G", F.col("value")).otherwise(-F.col("value")), F.col("mpos"))
    ends = runs.groupBy(*K, "run", "mark").agg(F.max_by(F.struct("mpos", "dt", "value"), rank).alias("e")).select(*K, "mark", "e.mpos", "e.dt", "e.value")
    nxt = lambda c: F.lead(c).over(w)
    u = ends.select(*K, "mark", "mpos", F.col("dt").alias("start_dt"), F.col("value").alias("start_value"), nxt("dt").alias("end_dt"), nxt("value").alias("end_value"), nxt("mpos").alias("end_mpos")).where("end_dt IS NOT NULL")
    return u.select(
        *K, (F.row_number().over(w) - 1).cast("long").alias("pos"), F.when(F.col("mark") == "D", "up").otherwise("down").alias("direction"), "start_dt", "start_value", "end_dt", "end_value",
        F.greatest("start_value", "end_value").alias("high"), F.least("start_value", "end_value").alias("low"), F.col("start_dt").alias("source_start"), F.col("end_dt").alias("source_end"),
        (F.col("end_mpos") - F.col("mpos") + 3).alias("length"),
    )


def _areas(spark: SparkSession, sf_dir: str, units: DataFrame) -> DataFrame:
    b = B.with_position(hourly(spark, sf_dir).unionByName(walk(spark, sf_dir)))
    return structure.directional_area(units.withColumnRenamed("pos", "idx"), structure.macd(b, keep=("open_time",))).withColumnRenamed("idx", "pos")


def _judged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    # Many branches read the chain and the zones: kept once, spilling to disk if need be.
    u = unit_chain(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    z = zones.segment_zones(u).persist(StorageLevel.MEMORY_AND_DISK)
    exact = u.select(*K).distinct().withColumn("exact", F.lit(True))
    first = points.first_points(u, z, _areas(spark, sf_dir, u), exact)
    return {"u": u, "z": z, "first": first, "second": points.second_points(first, u), "third": points.third_points(u, z)}


def _show(df: DataFrame) -> DataFrame:
    return df.select(*K, "point_type", "status", "reason", "zone", "segment_pos", "dt", "price")


def q_bar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as bars whose prices do not fit together."""
    o = read(spark, sf_dir, "orders").select(
        F.lit("O").alias("symbol"), F.lit("1d").alias("interval"), "o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("open_time"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL '1' DAY") * (F.col("o_orderkey") % 7 - 1).cast("int")).alias("close_time"),
        F.col("o_totalprice").cast("double").alias("open"), (F.col("o_totalprice") + F.col("o_orderkey") % 5 - 1).cast("double").alias("high"),
        (F.col("o_totalprice") - F.col("o_orderkey") % 3 + 1).cast("double").alias("low"), F.col("o_totalprice").cast("double").alias("close"),
    )
    return B.bar_violations(o).select("o_orderkey", "code")


def q_next_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("interval", F.element_at(F.array(*map(F.lit, ("5m", "4h", "3d", "2w", "1M", "7x"))), (F.col("event_id") % 6 + 1).cast("int")))
    return e.select("event_id", "interval", next_open_time(F.col("ts"), F.col("interval")).alias("next_open"), interval_seconds(F.col("interval")).alias("seconds"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table cut by its own last time: history up to 30 hours before it, newer rows from 46 hours on
    (with other prices), and a cut-off that leaves the last bar open."""
    b = by_type(spark, sf_dir)
    end = F.lit(b.agg(F.max("open_time")).first()[0])
    back = lambda h: end - F.expr(f"INTERVAL '{h}' HOUR")
    latest = b.where(F.col("open_time") >= back(46)).withColumn("close", F.col("close") + 1)
    return B.snapshot(b.where(F.col("open_time") < back(30)), latest, end + F.expr("INTERVAL '3' HOUR"), 40)


def q_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).select(*K, "open_time", "close", "is_closed")


def q_all_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed bars and the current one of a snapshot; of every third series the current bar is an old one."""
    b = by_type(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy(*K).orderBy(F.col("open_time").desc()))
    snap = b.withColumn("n", n).withColumn("is_closed", F.when(F.length("symbol") % 3 == 0, F.col("n") != 2).otherwise(F.col("n") != 1))
    return B.all_bars(snap).select(*K, "open_time", "close", "is_closed")


def q_revised_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as they arrive, every seventh followed by a revision and every ninth by a late one."""
    b = by_type(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy(*K).orderBy("open_time"))
    b = b.withColumns({"n": n.cast("long")}).select(*K, "open_time", "close", "n")
    again = b.where("n % 7 = 0").select(*K, "open_time", (F.col("close") + 1).alias("close"), (F.col("n") * 10 + 1).alias("arrival"))
    late = b.where("n % 9 = 0 AND n > 1").select(*K, (F.col("open_time") - F.expr("INTERVAL '5' HOUR")).alias("open_time"), "close", (F.col("n") * 10 + 2).alias("arrival"))
    feed = b.select(*K, "open_time", "close", (F.col("n") * 10).alias("arrival")).unionByName(again).unionByName(late)
    return B.revised(feed, "arrival").select(*K, "open_time", "close", "arrival", "state")


def q_positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = by_type(spark, sf_dir)
    b = a.where("trade_count <> 8")
    d = live.positional_diff(a, b, ["open_time"], ["open_time", "close"], 1e-9)
    return d.select(*K, "ordinal", F.col("left.close").alias("left_close"), F.col("right.close").alias("right_close"), "match")


def q_contiguous_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit_chain(spark, sf_dir)
    needle = u.where("pos BETWEEN 5 AND 9").withColumn("pos", F.col("pos") - 5)
    return live.overlay(needle, u, ["direction", "start_dt", "end_value"]).select(*K, "pos", "reason")


def damaged(units: DataFrame) -> DataFrame:
    """A unit chain with faults: every eleventh unit missing, every thirteenth ending elsewhere."""
    end = F.when(F.col("pos") % 13 == 3, F.col("start_value") - (F.col("end_value") - F.col("start_value"))).otherwise(F.col("end_value"))
    return units.where("pos % 11 <> 5").withColumn("end_value", end)


def as_segments(units: DataFrame) -> DataFrame:
    """Units dressed as segments: some of two strokes, some committed too early or never."""
    return units.withColumns({
        "size": F.when(F.col("pos") % 17 == 4, 2).otherwise(3).cast("long"),
        "committed_at": F.when(F.col("pos") % 19 == 7, F.lit(None)).when(F.col("pos") % 23 == 9, F.col("start_dt")).otherwise(F.col("end_dt") + F.expr("INTERVAL '1' HOUR")),
    })


def q_zone_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment zones with faults: too short, ranges turned, members lost, ends moved."""
    u = unit_chain(spark, sf_dir)
    z = zones.segment_zones(u).withColumns({
        "size": F.when(F.col("zone") % 7 == 1, 2).when(F.col("zone") % 7 == 2, F.col("size") + 1).otherwise(F.col("size")), "is_valid": F.col("is_valid") & (F.col("zone") % 7 != 3),
        "zg": F.when(F.col("zone") % 7 == 4, F.col("zd") - 1).otherwise(F.col("zg")), "end_pos": F.when((F.col("zone") % 7 == 5) & (F.col("size") > 3), F.col("end_pos") - 1).otherwise(F.col("end_pos")),
    })
    z = z.withColumn("size", F.when((F.col("zone") % 7 == 5) & (F.col("size") > 3), F.col("size") - 1).otherwise(F.col("size")))
    return zones.zone_issues(z, u)


def q_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third points given with faults against their recomputation."""
    u = unit_chain(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    judged = points.third_points(u, zones.segment_zones(u))
    given = points.points(judged).withColumn("n", F.col("segment_pos") % 5)
    given = given.where("n <> 1").withColumns({"price": F.when(F.col("n") == 2, F.col("price") + 1).otherwise(F.col("price")), "segment_pos": F.when(F.col("n") == 3, F.col("segment_pos") + 1000000).otherwise(F.col("segment_pos"))})
    return points.recheck(given, judged).select(*K, "point_type", "segment_pos", "code")


def q_macd_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors made of each series' 20th bar against bars that go on right, too early or too late."""
    b = B.with_position(by_type(spark, sf_dir))
    a = b.where("pos = 19").select(*K, "open_time", "close_time", next_open_time(F.col("open_time"), F.col("interval")).alias("expected_next_open"))
    kind = F.length("symbol") % 4
    rest = b.where(F.col("pos") >= F.when(kind == 0, 20).when(kind == 1, 19).when(kind == 2, 22).otherwise(10**9))
    return validators.macd_anchor_issues(a, rest).select(*K, "code")


def q_common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit_chain(spark, sf_dir)
    other = u.withColumn("end_value", F.when(F.col("pos") % 37 == 30 + F.length("symbol") % 5, F.col("end_value") + 1).otherwise(F.col("end_value")))
    return live.common_prefix(u, other, ["direction", "end_value"])


def q_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line behind the unit chain without its last four units."""
    b = structure.merged_bars(B.with_position(hourly(spark, sf_dir).unionByName(walk(spark, sf_dir))))
    u = unit_chain(spark, sf_dir)
    last = F.max("pos").over(Window.partitionBy(*K))
    return live.next_stroke(u.withColumn("m", last).where("pos <= m - 4").drop("m"), b)


def q_projected_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of half of the series the line goes on from a segment, of the others from unfinished strokes."""
    u = unit_chain(spark, sf_dir)
    u = u.withColumn("m", F.max("pos").over(Window.partitionBy(*K)))
    seg = u.where((F.col("pos") == F.col("m") - 9) & (F.length("symbol") % 2 == 0))
    return live.next_segment(seg, u, u.where("pos >= m - 7"))


def q_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as REST rows and read back."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    row = F.concat(
        F.lit("[["), ms.cast("string"), F.lit(',"1.5","2.5","0.5","2.0","'), (F.col("event_id") % 50).cast("string"), F.lit('",'), (ms + 59999).cast("string"), F.lit(',"10.25",'),
        (F.col("event_id") % 7).cast("string"), F.lit(',"0","0","0"]]'),
    )
    out = bar_files.parse_klines(read(spark, sf_dir, "events").select(row.alias("body")), "body", "evt", "1m")
    return out.select("symbol", "open_time", "close_time", "open", "high", "low", "close", "volume", "quote_volume", "trade_count")


def _analysis(spark: SparkSession, sf_dir: str):
    return analyze(hourly(spark, sf_dir).unionByName(walk(spark, sf_dir)).unionByName(weekly_lines(spark, sf_dir)), least=6, trusted=True)


def q_live_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional strokes and segments of a snapshot whose last bar is still open."""
    b = hourly(spark, sf_dir).unionByName(walk(spark, sf_dir))
    snap = b.withColumn("is_closed", F.col("open_time") < F.max("open_time").over(Window.partitionBy(*K)))
    a = analyze_snapshot(snap, least=6, trusted=True)
    return a.provisional_strokes.withColumn("structure", F.lit("stroke")).unionByName(a.provisional_segments.withColumn("structure", F.lit("segment")))


def q_legacy_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three units as an older segment, with faults: some a unit too long, some ending elsewhere, some missing."""
    u = unit_chain(spark, sf_dir)
    k, by = F.floor(F.col("pos") / 3).cast("long"), Window.partitionBy(*K).orderBy("pos")
    seg = u.withColumns({"idx": k, "end_at": F.lead("end_value", 2).over(by)}).where("pos % 3 = 0 AND end_at IS NOT NULL AND idx % 13 <> 5")
    seg = seg.select(
        *K, "idx", "direction", F.col("pos").alias("start_pos"), (F.col("pos") + F.when(F.col("idx") % 7 == 2, 4).when(F.col("idx") % 17 == 3, 10**9).otherwise(3)).alias("end_pos"),
        "start_value", (F.col("end_at") + F.when(F.col("idx") % 11 == 4, 1.0).otherwise(0.0)).alias("end_value"),
    )
    return legacy_segments.legacy_issues(seg, u)


def q_segment_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three units as a committed segment, with faults in the chain, the evidence and the waits."""
    u = unit_chain(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)  # read by many branches
    k, by = F.floor(F.col("pos") / 3).cast("long"), Window.partitionBy(*K).orderBy("pos")
    on = lambda m, r: F.col("k") % m == r
    base = u.withColumns({"k": k, "e_dt": F.lead("end_dt", 2).over(by), "e_value": F.lead("end_value", 2).over(by), "first": F.col("pos")}).where("pos % 3 = 0 AND e_value IS NOT NULL").withColumn("pos", F.col("k"))
    seg = base.select(
        *K, "pos", F.when(on(13, 6), F.when(F.col("direction") == "up", "down").otherwise("up")).otherwise(F.col("direction")).alias("direction"), "start_dt", "start_value", F.col("e_dt").alias("end_dt"),
        (F.col("e_value") + F.when(on(11, 4), 1.0).otherwise(0.0)).alias("end_value"), F.when(on(17, 4), 2).otherwise(3).cast("long").alias("size"), F.concat(F.lit("f"), "first").alias("fingerprint"),
    )
    end = F.col("first") + 3
    evidence = base.where(~on(19, 7)).select(
        *K, "pos", F.col("first").alias("start_pos"), (end + F.when(on(23, 5), 3).otherwise(0)).alias("end_pos"), F.when(on(2, 0), "NO_GAP").otherwise("GAP_REVERSE_FRACTAL").alias("confirmation"),
        (on(2, 1) != on(29, 3)).alias("gap"), (on(2, 1) != on(29, 3)).alias("primary_gap"), (~on(31, 8)).alias("broken"), (~on(37, 9)).alias("reverse"), end.alias("origin_pos"), (end + 1).alias("origin_at"), (end + F.when(on(5, 0), 6).otherwise(2)).alias("confirmed_at_pos"),
        F.when(~on(59, 13), F.col("e_dt")).alias("available_at"), F.when(~on(41, 11), F.col("e_dt") + F.when(on(43, 12), F.expr("INTERVAL '-120' HOUR")).otherwise(F.expr("INTERVAL '1' HOUR"))).alias("committed_at"),
        F.when(on(47, 2), 0).otherwise(F.col("first")).alias("committed_pos"), F.concat(F.lit("f"), F.col("first") + F.when(on(53, 20), 1).otherwise(0)).alias("fingerprint"),
    )
    # Of each wait two fractals: one behind its end, one at the end itself that is seen later.
    seen = F.inline(F.array(F.struct((end + 2).alias("endpoint_pos"), (end + 3).alias("detected_at_pos")), F.struct(end.alias("endpoint_pos"), (end + 2).alias("detected_at_pos"))))
    ends = u.select(*K, F.col("pos").alias("endpoint_pos"), F.col("start_value").alias("value"))
    candidates = base.select(*K, "pos", on(7, 1).alias("gap"), F.when(on(3, 2), "pending").otherwise("confirmed").alias("status"), seen).join(ends, [*K, "endpoint_pos"])
    expected = seg.where(~on(61, 17))
    stable = u.groupBy(*K).agg((F.max("pos") - 5).alias("stable"))
    return segment_faults.segment_faults(seg, u, evidence, candidates, expected, stable)


#: Strokes of a leg in the queries of the older point rules.
LEG = 9


def _two_levels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The unit chain as strokes and every nine of them as a segment; what several branches read is kept once."""
    keep = lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)
    strokes = keep(unit_chain(spark, sf_dir))
    w = Window.partitionBy(*K).orderBy("pos")
    ahead = w.rowsBetween(0, LEG - 1)
    legs = strokes.withColumns({"e_dt": F.lead("end_dt", LEG - 1).over(w), "e_value": F.lead("end_value", LEG - 1).over(w), "top": F.max("high").over(ahead), "bottom": F.min("low").over(ahead)})
    legs = keep(legs.where(f"pos % {LEG} = 0 AND e_value IS NOT NULL").select(
        *K, F.floor(F.col("pos") / LEG).cast("long").alias("pos"), "direction", "start_dt", "start_value", F.col("e_dt").alias("end_dt"), F.col("e_value").alias("end_value"), F.col("top").alias("high"), F.col("bottom").alias("low"),
        F.col("start_dt").alias("source_start"), F.col("e_dt").alias("source_end"), F.col("pos").alias("start_pos"), (F.col("pos") + LEG).alias("end_pos"),
    ))
    z = keep(zones.segment_zones(legs))
    hist = keep(structure.macd(B.with_position(hourly(spark, sf_dir).unionByName(walk(spark, sf_dir))), keep=("open_time",)))
    area = lambda u: structure.directional_area(u.withColumnRenamed("pos", "idx"), hist).withColumnRenamed("idx", "pos")
    exact = legs.select(*K).distinct().withColumn("exact", F.lit(True))
    first = keep(recursive_points.first_points(legs, strokes, z, area(legs), exact))
    return {"strokes": strokes, "legs": legs, "zones": z, "stroke_areas": area(strokes), "exact": exact, "first": first}


def q_older_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of the older rules, both levels."""
    t = _two_levels(spark, sf_dir)
    return _show(recursive_points.candidates(t["first"], t["legs"], t["strokes"], t["zones"], t["stroke_areas"], t["exact"]))


def q_inner_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third points among the seven units from the end of each zone."""
    u = unit_chain(spark, sf_dir)
    legs = u.select(*K, "pos", "direction", F.col("pos").alias("start_pos"), (F.col("pos") + 7).alias("end_pos"))
    return recursive_points.inner_thirds(zones.segment_zones(u), legs, recursive_points.inner_strokes(legs, u))


Query = Callable[[SparkSession, str], DataFrame]
MACD = ["ema_fast", "ema_slow", "dea", "hist"]
BAR_VIEW = ["open_time", "close_time", "open", "high", "low", "close", "volume", "quote_volume", "trade_count"]

QUERIES: dict[str, Query] = {
    "resample_hourly": lambda s, d: rounded(hourly(s, d), "volume", "quote_volume"),
    "resample_by_type": lambda s, d: rounded(by_type(s, d), "volume", "quote_volume"),
    "resample_weekly_lines": lambda s, d: rounded(weekly_lines(s, d), "volume").drop("quote_volume"),
    "bar_violations": q_bar_violations,
    "stream_issues": lambda s, d: B.stream_issues(by_user(s, d), "open_time").select("symbol", "open_time", "code"),
    "continuity": lambda s, d: B.continuity(daily_orders(s, d)),
    "bar_gaps": lambda s, d: B.gap_count(by_user(s, d)),
    "next_open": q_next_open,
    "last_n_bars": lambda s, d: B.last_n(by_user(s, d), 5).select("symbol", "open_time", "close"),
    "snapshot_merge": q_snapshot,
    "positional_diff": q_positional_diff,
    "merged_bars": lambda s, d: structure.merged_bars(B.with_position(hourly(s, d))).select("mpos", "dt", "open", "high", "low", "close", "raw_count", "first_dt", "last_dt"),
    "fractals_raw": lambda s, d: structure.raw_fractals(structure.merged_bars(B.with_position(hourly(s, d)))).select("mpos", "dt", "mark", "high", "low", "value"),
    "fractals": lambda s, d: structure.fractals(structure.merged_bars(B.with_position(hourly(s, d)))).select("mpos", "dt", "mark", "value"),
    "macd": lambda s, d: rounded(structure.macd(B.with_position(hourly(s, d))).select("pos", *MACD), *MACD, digits=6),
    "unit_chain": lambda s, d: unit_chain(s, d).select(*K, "pos", "direction", "start_dt", "start_value", "end_dt", "end_value"),
    "macd_area": lambda s, d: rounded(_areas(s, d, unit_chain(s, d)), "area"),
    "stroke_zone_groups": lambda s, d: zones.stroke_zone_groups(unit_chain(s, d)).select(*K, "group", "start_pos", "end_pos", "size", "zg", "zd", "gg", "dd", "trend_gg", "trend_dd", "is_valid"),
    "zone_seeds": lambda s, d: zones.zone_seeds(unit_chain(s, d)),
    "segment_zones": lambda s, d: zones.segment_zones(unit_chain(s, d)).select(*K, "zone", "start_pos", "end_pos", "zg", "zd", "gg", "dd", "trend_gg", "trend_dd"),
    "segment_zones_by_doubling": lambda s, d: long_zones.zones_by_doubling(unit_chain(s, d)).select(*K, "zone", "start_pos", "end_pos", "zg", "zd", "gg", "dd", "trend_gg", "trend_dd"),
    "trend_pairs": lambda s, d: points.trend_pairs(zones.segment_zones(unit_chain(s, d))).select(*K, "zone", "prev_zone", "gg", "dd", "strict", "core"),
    "first_points": lambda s, d: _show(_judged(s, d)["first"]),
    "second_points": lambda s, d: _show(_judged(s, d)["second"]),
    "third_points": lambda s, d: _show(_judged(s, d)["third"]),
    "inner_third_points": q_inner_thirds,
    "older_first_points": lambda s, d: _show(_two_levels(s, d)["first"]),
    "older_points": q_older_points,
    "contiguous_block": q_contiguous_block,
    "all_bars": q_all_bars,
    "revised_bars": q_revised_bars,
    "klines": q_klines,
    "macd_anchor": lambda s, d: rounded((lambda b: structure.macd_anchor(structure.macd(b), b))(B.with_position(hourly(s, d))).select(*K, "open_time", *MACD[:3], "processed_bar_count"), *MACD[:3], digits=6),
    "macd_anchor_issues": q_macd_anchors,
    "stroke_faults": lambda s, d: (lambda u: validators.stroke_issues(damaged(u), structure.raw_fractals(structure.merged_bars(B.with_position(hourly(s, d).unionByName(walk(s, d))))), 5))(unit_chain(s, d)),
    "structure_faults": lambda s, d: points.structure_issues(as_segments(damaged(unit_chain(s, d)))),
    "provenance_faults": lambda s, d: points.provenance_issues(as_segments(unit_chain(s, d))),
    "commit_faults": lambda s, d: validators.commit_conflicts(unit_chain(s, d).select(*K, F.concat_ws("/", "direction", F.col("pos") % 40).alias("fingerprint"), (F.col("pos") % 80).alias("committed_at"))),
    "endpoints": lambda s, d: legacy_segments.endpoints(unit_chain(s, d)),
    "legacy_faults": q_legacy_faults,
    "segment_faults": q_segment_faults,
    "committed_segment_faults": lambda s, d: _analysis(s, d).segment_faults,
    "potentials": lambda s, d: legacy_segments.potentials(legacy_segments.endpoints(unit_chain(s, d))),
    "formal_stroke_zones": lambda s, d: zones.stroke_zones(zones.behind_first_group(unit_chain(s, d))).select(*K, "zone", "start_pos", "end_pos", "zg", "zd", "size"),
    "formal_segment_zones": lambda s, d: zones.segment_zones(zones.behind_first_zone(unit_chain(s, d))).select(*K, "zone", "start_pos", "end_pos", "zg", "zd", "size"),
    "zone_candidates": lambda s, d: (lambda u: zones.zone_candidates(u, zones.segment_zones(u)))(unit_chain(s, d)).select(*K, "start_pos", "end_pos", "zd", "zg", "width"),
    "zone_faults": q_zone_issues,
    "divergences": lambda s, d: (lambda u: points.divergences(points.trend_pairs(zones.segment_zones(u)), u, rounded(_areas(s, d, u), "area"), u.select(*K).distinct().withColumn("exact", F.lit(True))))(unit_chain(s, d)).select(
        *K, "zone", "prev_zone", "direction", "b", "c", "price", "has_legs", "new_extreme", "area_b", "area_c", "diverges"
    ),
    "points_recheck": q_recheck,
    "common_prefix": q_common_prefix,
    "diff_summary": lambda s, d: live.diff_summary(live.positional_diff(by_type(s, d), by_type(s, d).where("trade_count <> 8"), ["open_time"], ["open_time", "close"], 1e-9)),
    "projected_strokes": q_projected,
    "projected_segments": q_projected_segments,
    "strokes": lambda s, d: _analysis(s, d).strokes,
    "stroke_issues": lambda s, d: (lambda a: validators.stroke_issues(a.strokes, structure.raw_fractals(a.merged), 6))(_analysis(s, d)),
    "segment_issues": lambda s, d: (lambda a: validators.segment_issues(a.detected_segments, a.strokes))(_analysis(s, d)),
    "feature_coverage": lambda s, d: (lambda a: validators.feature_coverage(a.feature_elements, a.strokes))(_analysis(s, d)),
    "superseded_gap_endpoints": lambda s, d: (lambda a: validators.superseded_gap_endpoints(a.evidence, a.segments, a.strokes))(_analysis(s, d)),
    "commit_conflicts": lambda s, d: validators.commit_conflicts(_analysis(s, d).evidence),
    "detected_segments": lambda s, d: _analysis(s, d).detected_segments,
    "committed_segments": lambda s, d: _analysis(s, d).segments,
    "segment_evidence": lambda s, d: _analysis(s, d).evidence,
    "feature_elements": lambda s, d: _analysis(s, d).feature_elements,
    "feature_fractals": lambda s, d: _analysis(s, d).feature_fractals,
    "diagnostics": lambda s, d: _analysis(s, d).diagnostics,
    "segment_overlay": lambda s, d: _analysis(s, d).segment_overlay,
    "stroke_zones": lambda s, d: _analysis(s, d).stroke_zones,
    "segment_zone_candidates": lambda s, d: _analysis(s, d).segment_zone_candidates,
    "trading_points": lambda s, d: _analysis(s, d).judged,
    "projected_lines": lambda s, d: (lambda a: a.projected_stroke.unionByName(a.projected_segment))(_analysis(s, d)),
    "live_overlay": q_live_overlay,
    "legacy_segments": lambda s, d: (lambda a: legacy_segments.legacy_segments(a.strokes, merged=a.merged))(_analysis(s, d)),
    "user_strokes": lambda s, d: analyze(by_user(s, d), least=6, trusted=True).strokes,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractals of merged hourly bars of all events."""
    return QUERIES["fractals"](spark, sf_dir)
