"""First, second and third class trading points on one level of segments. Joins and aggregates only.

``units``: segments as for zones, with ``source_start``/``source_end``; ``zones``: from
``zones.segment_zones``; ``areas``: MACD area of each unit on its own side (``pos, area``);
``exact``: per key, whether MACD runs from a trusted start without a gap; ``commits``: ``pos,
committed_at`` of final segments. A result row is a judged candidate; confirmed ones are the points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import KEYS

K = list(KEYS)
EPS = 1e-9
COLUMNS = ["point_type", "status", "reason", "zone", "segment_pos", "dt", "price", "related", "confirmed_at"]


def over_range(ranges: DataFrame, units: DataFrame, lo: str, hi: str) -> DataFrame:
    """Each range with the units of its positions: ranges are exploded, so the join stays an
    equi-join. An empty range drops out."""
    at = ranges.where(F.col(hi) >= F.col(lo)).withColumn("pos", F.explode(F.sequence(F.col(lo), F.col(hi))))
    return at.join(units.select(*K, "pos", *[F.col(c).alias(f"u_{c}") for c in ("direction", "start_value", "end_value", "high", "low")]), [*K, "pos"])


def zone_views(zones: DataFrame) -> DataFrame:
    """Zones whose body, the departing last member left out, still has three members."""
    return zones.where("trend_size >= 3").select(*K, "zone", "start_pos", "end_pos", "zg", "zd", F.col("trend_gg").alias("gg"), F.col("trend_dd").alias("dd"))


def trend_pairs(zones: DataFrame) -> DataFrame:
    """Neighbouring zones with the strict and the core relation between them."""
    w = Window.partitionBy(*K).orderBy("zone")
    p = F.lag(F.struct("zone", "start_pos", "end_pos", "zg", "zd", "gg", "dd")).over(w)
    rows = zone_views(zones).withColumn("p", p).where("p IS NOT NULL")
    strict = F.when(F.col("gg") < F.col("p.dd") - EPS, "down").when(F.col("dd") > F.col("p.gg") + EPS, "up")
    core = F.when(F.col("zg") < F.col("p.zd") - EPS, "down").when(F.col("zd") > F.col("p.zg") + EPS, "up")
    return rows.select(
        *K, "zone", "start_pos", "end_pos", "zg", "zd", "gg", "dd", F.col("p.zone").alias("prev_zone"), F.col("p.end_pos").alias("prev_end"), F.col("p.zg").alias("prev_zg"),
        F.col("p.zd").alias("prev_zd"), F.col("p.gg").alias("prev_gg"), F.col("p.dd").alias("prev_dd"), strict.alias("strict"), core.alias("core"),
    )


def divergences(pairs: DataFrame, units: DataFrame, areas: DataFrame, exact: DataFrame) -> DataFrame:
    """For each strict trend: entry leg b, exit leg c, the new extreme and the areas of both."""
    down = F.col("strict") == "down"
    strict = pairs.where("strict IS NOT NULL").withColumns({"lo": F.greatest("prev_end", F.lit(0)), "hi": F.col("start_pos") - 1})
    enters = F.when(down, (F.col("u_start_value") > F.col("zg") + EPS) & (F.col("u_end_value") <= F.col("zg") + EPS)).otherwise(
        (F.col("u_start_value") < F.col("zd") - EPS) & (F.col("u_end_value") >= F.col("zd") - EPS)
    )
    entry = over_range(strict, units, "lo", "hi").where((F.col("u_direction") == F.col("strict")) & enters).groupBy(*K, "zone").agg(F.max("pos").alias("b"))
    leaves = F.when(down, (F.col("u_start_value") >= F.col("zd") - EPS) & (F.col("u_end_value") < F.col("zd") - EPS)).otherwise(
        (F.col("u_start_value") <= F.col("zg") + EPS) & (F.col("u_end_value") > F.col("zg") + EPS)
    )
    exit_ = over_range(strict, units, "end_pos", "end_pos").where((F.col("u_direction") == F.col("strict")) & leaves).select(*K, "zone", F.col("pos").alias("c"), F.col("u_end_value").alias("price"))
    legs = strict.join(entry, [*K, "zone"], "left").join(exit_, [*K, "zone"], "left").withColumn("has_legs", F.coalesce(F.col("c") > F.col("b"), F.lit(False)))
    ranged = over_range(legs.where("has_legs").select(*K, "zone", "b", (F.col("c") - 1).alias("c1")), units, "b", "c1")
    extreme = ranged.groupBy(*K, "zone").agg(F.min("u_low").alias("least"), F.max("u_high").alias("most"))
    area = lambda leg, name: areas.select(*K, F.col("pos").alias(leg), F.col("area").alias(name))
    out = legs.join(extreme, [*K, "zone"], "left").join(area("b", "area_b"), [*K, "b"], "left").join(area("c", "area_c"), [*K, "c"], "left").join(exact.select(*K, "exact"), K, "left")
    return out.select(
        *K, "zone", "prev_zone", F.col("strict").alias("direction"), F.when(F.col("has_legs"), F.col("b")).alias("b"), F.when(F.col("has_legs"), F.col("c")).alias("c"),
        "price", "has_legs", F.when(down, F.col("price") < F.col("least") - EPS).otherwise(F.col("price") > F.col("most") + EPS).alias("new_extreme"),
        "area_b", "area_c", ((F.col("area_b") > EPS) & (F.col("area_c") < F.col("area_b") - EPS)).alias("diverges"), F.coalesce("exact", F.lit(False)).alias("exact"),
    )


def _finish(rows: DataFrame, units: DataFrame, commits: DataFrame | None) -> DataFrame:
    """Date and commit time of the segment that pins a candidate."""
    out = rows.join(units.select(*K, F.col("pos").alias("segment_pos"), F.col("end_dt").alias("dt")), [*K, "segment_pos"], "left")
    if commits is None:
        out = out.withColumn("confirmed_at", F.lit(None).cast(dict(units.dtypes)["end_dt"]))
    else:
        out = out.join(commits.select(*K, F.col("pos").alias("segment_pos"), F.col("committed_at").alias("confirmed_at")), [*K, "segment_pos"], "left")
    return out.withColumn("confirmed_at", F.when(F.col("status") == "confirmed", F.col("confirmed_at"))).select(*K, *COLUMNS)


def first_points(units: DataFrame, zones: DataFrame, areas: DataFrame, exact: DataFrame, commits: DataFrame | None = None, inside: DataFrame | None = None) -> DataFrame:
    """B1 and S1: strict trend, then both legs, then a new extreme, then exact MACD, then divergence. With
    ``inside`` (zone, whole) the leg that leaves must also be whole inside, which is asked behind the legs."""
    pairs = trend_pairs(zones)
    kind = lambda c: F.when(F.col(c) == "down", "B1").otherwise("S1")
    null = F.lit(None)
    weak = pairs.where("strict IS NULL AND core IS NOT NULL").select(
        *K, kind("core").alias("point_type"), F.lit("rejected").alias("status"), F.lit("RANGES_OVERLAP").alias("reason"), "zone",
        null.cast("long").alias("segment_pos"), null.cast("double").alias("price"), F.array().cast("array<bigint>").alias("related"),
    )
    d = divergences(pairs, units, areas, exact)
    reason = F.when(~F.col("has_legs"), "LEGS_INCOMPLETE")
    if inside is not None:
        d = d.join(inside.select(*K, "zone", "whole"), [*K, "zone"], "left")
        reason = reason.when(~F.coalesce("whole", F.lit(False)), "INSIDE_INCOMPLETE")
    reason = (
        reason.when(~F.col("new_extreme"), "NO_NEW_EXTREME").when(~F.col("exact"), "MACD_NOT_EXACT")
        .when(~F.col("diverges"), "NO_DIVERGENCE").otherwise("TREND_DIVERGENCE")
    )
    status = F.when(F.col("reason").isin("LEGS_INCOMPLETE", "INSIDE_INCOMPLETE", "MACD_NOT_EXACT"), "pending").when(F.col("reason") == "TREND_DIVERGENCE", "confirmed").otherwise("rejected")
    related = F.when(F.col("has_legs"), F.array("b", "c")).otherwise(F.array().cast("array<bigint>"))
    strong = d.withColumn("reason", reason).select(
        *K, kind("direction").alias("point_type"), status.alias("status"), "reason", "zone", F.col("c").alias("segment_pos"), F.when(F.col("has_legs"), F.col("price")).alias("price"), related.alias("related")
    )
    return _finish(weak.unionByName(strong), units, commits)


def second_points(first: DataFrame, units: DataFrame, commits: DataFrame | None = None, lower: DataFrame | None = None) -> DataFrame:
    """B2 and S2: the first pullback behind a confirmed first point that does not pass its price. With
    ``lower`` (segment, point_type, dt, price) a first point of the lower level must end the pullback."""
    f = first.where("status = 'confirmed'").select(*K, F.col("point_type").alias("of"), F.col("segment_pos").alias("p0"), F.col("price").alias("first_price")).distinct()
    at = lambda k, n: units.select(*K, (F.col("pos") - k).alias("p0"), F.col("direction").alias(f"{n}_direction"), F.col("end_value").alias(f"{n}_value"))
    rows = f.join(at(1, "back"), [*K, "p0"], "left").join(at(2, "again"), [*K, "p0"], "left")
    buy = F.col("of") == "B1"
    turned = F.when(buy, (F.col("back_direction") == "up") & (F.col("again_direction") == "down")).otherwise((F.col("back_direction") == "down") & (F.col("again_direction") == "up"))
    holds = F.when(buy, F.col("again_value") >= F.col("first_price") - EPS).otherwise(F.col("again_value") <= F.col("first_price") + EPS)
    reason = F.when(F.col("again_value").isNull(), "PULLBACK_INCOMPLETE").when(~(turned & holds), "FIRST_POINT_BROKEN")
    if lower is not None:
        ends = units.select(*K, F.col("pos").alias("segment"), F.col("end_dt").alias("dt"), "end_value")
        met = lower.join(ends, [*K, "segment", "dt"]).where(F.abs(F.col("price") - F.col("end_value")) <= EPS)
        met = met.select(*K, (F.col("segment") - 2).alias("p0"), F.col("point_type").alias("of"), F.lit(True).alias("met")).distinct()
        rows = rows.join(met, [*K, "p0", "of"], "left")
        reason = reason.when(F.col("met").isNull(), "NO_POINT_INSIDE")
    reason = reason.otherwise("FIRST_PULLBACK_HOLDS")
    there = F.col("again_value").isNotNull()
    out = rows.withColumn("reason", reason).select(
        *K, F.when(buy, "B2").otherwise("S2").alias("point_type"),
        F.when(F.col("reason") == "PULLBACK_INCOMPLETE", "pending").when(F.col("reason") == "FIRST_PULLBACK_HOLDS", "confirmed").otherwise("rejected").alias("status"),
        "reason", F.lit(None).cast("long").alias("zone"), F.when(there, F.col("p0") + 2).alias("segment_pos"), F.col("again_value").alias("price"),
        F.when(there, F.array(F.col("p0"), F.col("p0") + 1, F.col("p0") + 2)).otherwise(F.array("p0")).alias("related"),
    )
    return _finish(out, units, commits)


def third_points(units: DataFrame, zones: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """B3 and S3: the first segment that leaves a zone, and a pullback that stays out of it."""
    z = zones.select(*K, "zone", "zg", "zd", F.greatest(F.col("start_pos") + 2, F.lit(0)).alias("lo"), (F.col("end_pos") + 1).alias("hi"))
    leaves = F.when((F.col("u_direction") == "up") & (F.col("u_end_value") > F.col("zg") + EPS), "B3").when((F.col("u_direction") == "down") & (F.col("u_end_value") < F.col("zd") - EPS), "S3")
    out = over_range(z, units, "lo", "hi").withColumn("t", leaves).where("t IS NOT NULL").groupBy(*K, "zone", "zg", "zd").agg(
        F.min_by(F.struct("pos", "t", "u_end_value"), "pos").alias("d")
    )
    nxt = units.select(*K, (F.col("pos") - 1).alias("dp"), F.col("direction").alias("pd"), F.col("end_value").alias("pv"), F.col("high").alias("ph"), F.col("low").alias("pl"))
    rows = out.select(*K, "zone", "zg", "zd", F.col("d.pos").alias("dp"), F.col("d.t").alias("t"), F.col("d.u_end_value").alias("dv")).join(nxt, [*K, "dp"], "left")
    buy = F.col("t") == "B3"
    ok = F.when(buy, (F.col("pd") == "down") & (F.col("pl") >= F.col("zg") - EPS)).otherwise((F.col("pd") == "up") & (F.col("ph") <= F.col("zd") + EPS))
    there = F.col("pv").isNotNull()
    reason = F.when(~there, "PULLBACK_INCOMPLETE").when(ok, "PULLBACK_STAYS_OUT").otherwise("PULLBACK_REENTERS")
    done = rows.withColumn("reason", reason).select(
        *K, F.col("t").alias("point_type"), F.when(~there, "pending").when(ok, "confirmed").otherwise("rejected").alias("status"), "reason", "zone",
        F.when(there, F.col("dp") + 1).otherwise(F.col("dp")).alias("segment_pos"), F.coalesce("pv", "dv").alias("price"),
        F.when(there, F.array(F.col("dp"), F.col("dp") + 1)).otherwise(F.array("dp")).alias("related"),
    )
    return _finish(done, units, commits)


def candidates(units: DataFrame, zones: DataFrame, areas: DataFrame, exact: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """All judged candidates of the six types."""
    first = first_points(units, zones, areas, exact, commits)
    return first.unionByName(second_points(first, units, commits)).unionByName(third_points(units, zones, commits))


def points(judged: DataFrame) -> DataFrame:
    """Confirmed candidates, one per (type, date, segment): the highest zone stands for ties."""
    rn = F.row_number().over(Window.partitionBy(*K, "point_type", "dt", "segment_pos").orderBy(F.col("zone").desc_nulls_last()))
    return judged.where("status = 'confirmed'").withColumn("rn", rn).where("rn = 1").drop("rn", "status")


def buy_points(p: DataFrame) -> DataFrame:
    return p.where(F.col("point_type").startswith("B"))


def sell_points(p: DataFrame) -> DataFrame:
    return p.where(F.col("point_type").startswith("S"))


def structure_issues(segments: DataFrame, strokes: DataFrame | None = None) -> DataFrame:
    """The first broken rule of each key's segments: an odd number of at least three strokes, an end in
    the segment's direction, alternation, shared endpoints. With ``strokes`` also their inside: the first
    stroke's direction, the ends of the inner chain, its alternation and shared endpoints, a range that
    the first three have in common. A key in here gets no formal points."""
    w = Window.partitionBy(*K).orderBy("pos")
    prev = F.lag(F.struct("direction", "end_dt", "end_value")).over(w)
    apart = lambda a, b: F.abs(F.col(a) - F.col(b)) > EPS
    code = F.when((F.col("size") < 3) | (F.col("size") % 2 == 0), "STROKE_COUNT")
    rows = segments
    if strokes is not None:
        before = F.lag(F.struct("direction", "end_dt", "end_value")).over(w)
        s = strokes.withColumn("b", before).select(
            *K, F.col("pos").alias("sp"), F.col("direction").alias("sd"), "high", "low", "start_dt", "start_value", "end_dt", "end_value",
            (F.col("direction") == F.col("b.direction")).alias("same"), ((F.col("start_dt") != F.col("b.end_dt")) | (F.abs(F.col("start_value") - F.col("b.end_value")) > EPS)).alias("torn"),
        )
        at = segments.select(*K, "pos", "start_pos", F.explode(F.sequence(F.col("start_pos"), F.greatest("start_pos", F.col("end_pos") - 1))).alias("sp"))
        later, three = F.col("sp") > F.col("start_pos"), F.col("sp") < F.col("start_pos") + 3
        inner = at.join(s, [*K, "sp"]).groupBy(*K, "pos").agg(
            F.min_by("sd", "sp").alias("i_direction"), F.min_by(F.struct("start_dt", "start_value"), "sp").alias("i_a"), F.max_by(F.struct("end_dt", "end_value"), "sp").alias("i_b"),
            F.bool_or(later & F.col("same")).alias("i_same"), F.bool_or(later & F.col("torn")).alias("i_torn"),
            F.max(F.when(three, F.col("low"))).alias("i_low"), F.min(F.when(three, F.col("high"))).alias("i_high"),
        )
        rows = rows.join(inner, [*K, "pos"], "left")
        code = code.when(~F.col("direction").eqNullSafe(F.col("i_direction")), "FIRST_STROKE_DIRECTION")
    code = code.when((F.col("direction") == "up") & (F.col("end_value") <= F.col("start_value")), "ENDPOINT_DIRECTION").when(
        (F.col("direction") == "down") & (F.col("end_value") >= F.col("start_value")), "ENDPOINT_DIRECTION"
    )
    if strokes is not None:
        code = (
            code.when((F.col("start_dt") != F.col("i_a.start_dt")) | apart("start_value", "i_a.start_value") | (F.col("end_dt") != F.col("i_b.end_dt")) | apart("end_value", "i_b.end_value"), "ENDPOINT_STROKES")
            .when(F.col("i_same"), "INNER_NOT_ALTERNATING").when(F.col("i_torn"), "INNER_ENDPOINT_NOT_SHARED").when(F.col("i_low") > F.col("i_high") + EPS, "FIRST_THREE_APART")
        )
    code = code.when(F.col("direction") == F.col("__p.direction"), "NOT_ALTERNATING").when(
        (F.col("start_dt") != F.col("__p.end_dt")) | (F.abs(F.col("start_value") - F.col("__p.end_value")) > EPS), "ENDPOINT_NOT_SHARED"
    )
    rows = rows.withColumn("__p", prev).withColumn("code", code).where("code IS NOT NULL")
    return rows.groupBy(*K).agg(F.min_by(F.struct("pos", "code"), "pos").alias("f")).select(*K, "f.pos", "f.code")


def provenance_issues(segments: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """The first segment of each key without a commit time at or behind its own end. With ``evidence``
    (pos, fingerprint, committed_at) also: evidence without its segment or the other way round, evidence
    of another segment; the commit time is then the evidence's."""
    rows = segments
    code = F.when(F.col("committed_at").isNull(), "NOT_COMMITTED").when(F.col("committed_at") < F.greatest("end_dt", "source_end"), "COMMITTED_BEFORE_END")
    if evidence is not None:
        e = evidence.select(*K, "pos", F.col("fingerprint").alias("of_print"), "committed_at", F.lit(True).alias("has"))
        rows = segments.drop("committed_at").withColumn("there", F.lit(True)).join(e, [*K, "pos"], "full_outer")
        code = (
            F.when(F.col("has").isNull(), "EVIDENCE_MISSING").when(F.col("there").isNull(), "SEGMENT_MISSING").when(~F.col("fingerprint").eqNullSafe(F.col("of_print")), "EVIDENCE_OF_ANOTHER")
            .when(F.col("committed_at").isNull(), "NOT_COMMITTED").when(F.col("committed_at") < F.greatest("end_dt", "source_end"), "COMMITTED_BEFORE_END")
        )
    rows = rows.withColumn("code", code).where("code IS NOT NULL")
    return rows.groupBy(*K).agg(F.min_by(F.struct("pos", "code"), "pos").alias("f")).select(*K, "f.pos", "f.code")


def formal_issues(given: DataFrame, judged: DataFrame, segments: DataFrame, strokes: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """What is wrong with published points: of a key whose segments fail a gate the gate's finding alone,
    of any other the points that a recomputation does not give."""
    gate = structure_issues(segments, strokes).withColumn("rule", F.lit("structure")).unionByName(provenance_issues(segments, evidence).withColumn("rule", F.lit("provenance")))
    shut = gate.select(*K).distinct()
    points_ = recheck(given.join(shut, K, "left_anti"), judged.join(shut, K, "left_anti"))
    return gate.select(*K, "rule", F.col("pos").alias("segment_pos"), "code").unionByName(points_.select(*K, F.lit("points").alias("rule"), "segment_pos", "code"))


def recheck(given: DataFrame, judged: DataFrame) -> DataFrame:
    """Given points against a recomputation: what is missing, invented or differs."""
    a = given.select(*K, "point_type", "segment_pos", F.col("price").alias("given_price"), F.col("dt").alias("given_dt"))
    b = points(judged).select(*K, "point_type", "segment_pos", F.col("price"), F.col("dt"))
    code = (
        F.when(F.col("price").isNull(), "NOT_REPRODUCED").when(F.col("given_price").isNull(), "MISSING")
        .when((F.abs(F.col("price") - F.col("given_price")) > EPS) | (F.col("dt") != F.col("given_dt")), "DIFFERS")
    )
    return a.join(b, [*K, "point_type", "segment_pos"], "full_outer").withColumn("code", code).where("code IS NOT NULL")
