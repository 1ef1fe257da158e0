"""Validators of derived layers: each returns the rows that break a rule, with a code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import KEYS
from .stroke_machine import MIN_BARS

K = list(KEYS)
EPS = 1e-9


def as_of(rows: DataFrame, marks: DataFrame, row_time: str, mark_time: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of the latest mark of their key at or before their time: both sides in
    one sort, no range join."""
    a = rows.select(*K, F.col(row_time).alias("__t"), F.lit(1).alias("__o"), F.struct(*[c for c in rows.columns if c not in K]).alias("__r"))
    b = marks.select(*K, F.col(mark_time).alias("__t"), F.lit(0).alias("__o"), F.struct(*columns).alias("__m"))
    w = Window.partitionBy(*K).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__m", F.last("__m", ignorenulls=True).over(w))
    return both.where("__o = 1").select(*K, "__r.*", *[F.col(f"__m.{c}").alias(f"of_{c}") for c in columns])


def stroke_issues(strokes: DataFrame, raw_fractals: DataFrame, least: int = MIN_BARS) -> DataFrame:
    """Wrong direction, too short, not alternating, endpoint not shared, or (but for a key's first stroke)
    a fractal of its own that has the start's mark and goes beyond the start. A stroke may break several.

    A stroke's own fractals are the raw ones between its ends; one with the mark of the fractal before it
    does not count, unless that one is the start.
    """
    w = Window.partitionBy(*K).orderBy("pos")
    prev = F.lag(F.struct("direction", "end_dt", "end_value")).over(w)
    up = F.col("direction") == "up"
    codes = F.array_compact(F.array(
        F.when(up != (F.col("end_value") > F.col("start_value")), F.lit("DIRECTION_MARK_MISMATCH")), F.when(F.col("length") < least, F.lit("STROKE_TOO_SHORT")),
        F.when(F.col("direction") == F.col("__p.direction"), F.lit("DIRECTION_NOT_ALTERNATING")),
        F.when((F.col("start_dt") != F.col("__p.end_dt")) | (F.col("start_value") != F.col("__p.end_value")), F.lit("ENDPOINT_NOT_SHARED")),
    ))
    rules = strokes.withColumn("__p", prev).select(*K, "pos", F.explode(codes).alias("code"))
    later = strokes.withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")
    wf = Window.partitionBy(*K).orderBy("mpos")
    f = raw_fractals.withColumns({"before": F.lag(F.struct("dt", "mark")).over(wf)}).select(*K, "dt", "mark", "value", "before")
    inner = as_of(f, later, "dt", "start_dt", ["pos", "direction", "start_dt", "start_value", "end_dt"]).where("dt > of_start_dt AND dt < of_end_dt")
    inner = inner.where("before.dt = of_start_dt OR before.mark <> mark")
    stale = inner.where("(of_direction = 'up' AND mark = 'D' AND value < of_start_value) OR (of_direction = 'down' AND mark = 'G' AND value > of_start_value)")
    return rules.unionByName(stale.select(*K, F.col("of_pos").alias("pos"), F.lit("STALE_SHARED_ENDPOINT").alias("code")).distinct())


def segment_issues(segments: DataFrame, strokes: DataFrame) -> DataFrame:
    """Broken geometric rules of segments over their strokes: count, direction, alternation, shared
    endpoints, range of the first three strokes, bounds and endpoints that the strokes do not have."""
    w = Window.partitionBy(*K).orderBy("pos")
    prev = F.lag(F.struct("direction", "end_dt", "end_value")).over(w)
    at = segments.select(*K, "pos", "start_pos", F.explode(F.sequence(F.col("start_pos"), F.col("end_pos") - 1)).alias("sp"))
    s = strokes.select(*K, F.col("pos").alias("sp"), F.col("high").alias("sh"), F.col("low").alias("sl"), F.col("start_value").alias("sv"), F.col("end_value").alias("ev"))
    first3 = F.col("sp") < F.col("start_pos") + 3
    own = at.join(s, [*K, "sp"]).groupBy(*K, "pos").agg(
        F.max("sh").alias("oh"), F.min("sl").alias("ol"), F.count("*").alias("n"), F.min_by("sv", "sp").alias("ov"), F.max_by("ev", "sp").alias("oe"),
        F.max(F.when(first3, F.col("sl"))).alias("lo3"), F.min(F.when(first3, F.col("sh"))).alias("hi3"),
    )
    codes = F.array_compact(F.array(
        F.when((F.col("size") < 3) | (F.col("size") % 2 == 0), F.lit("STROKE_COUNT")), F.when(F.col("n").isNull() | (F.col("n") != F.col("size")), F.lit("STROKES_MISSING")),
        F.when((F.col("direction") == "up") != (F.col("end_value") > F.col("start_value")), F.lit("ENDPOINT_DIRECTION")),
        F.when(F.col("direction") == F.col("__p.direction"), F.lit("NOT_ALTERNATING")),
        F.when((F.col("start_dt") != F.col("__p.end_dt")) | (F.abs(F.col("start_value") - F.col("__p.end_value")) > EPS), F.lit("ENDPOINT_NOT_SHARED")),
        F.when(F.col("lo3") > F.col("hi3") + 1e-12, F.lit("FIRST_THREE_APART")), F.when((F.col("oh") != F.col("high")) | (F.col("ol") != F.col("low")), F.lit("BOUNDS")),
        F.when((F.abs(F.col("ov") - F.col("start_value")) > EPS) | (F.abs(F.col("oe") - F.col("end_value")) > EPS), F.lit("ENDPOINT_VALUE")),
    ))
    return segments.withColumn("__p", prev).join(own, [*K, "pos"], "left").select(*K, "pos", F.explode(codes).alias("code"))


def feature_coverage(elements: DataFrame, strokes: DataFrame, max_gap: int = 2) -> DataFrame:
    """Keys whose feature scan stops more than ``max_gap`` strokes before the last one."""
    seen = elements.groupBy(*K).agg(F.max(F.array_max("positions")).alias("seen"))
    last = strokes.groupBy(*K).agg(F.max("pos").alias("last"))
    return last.join(seen, K, "left").where(F.col("last") >= 3).where(F.col("last") - F.coalesce("seen", F.lit(-1)) > max_gap)


def superseded_gap_endpoints(evidence: DataFrame, segments: DataFrame, strokes: DataFrame) -> DataFrame:
    """Segments confirmed across a gap although a further endpoint of the same mark came before the
    confirmation."""
    g = evidence.where("confirmation = 'GAP_REVERSE_FRACTAL' AND confirmed_at_pos > end_pos").select(*K, "pos", "end_pos", "confirmed_at_pos")
    g = g.join(segments.select(*K, "pos", "direction", "end_value"), [*K, "pos"])
    at = g.withColumn("sp", F.explode(F.sequence(F.col("end_pos") + 1, F.col("confirmed_at_pos") - 1 + (F.col("confirmed_at_pos") == F.col("end_pos") + 1).cast("int"))))
    s = strokes.select(*K, F.col("pos").alias("sp"), F.col("direction").alias("sd"), F.col("start_value").alias("sv"))
    j = at.where("sp < confirmed_at_pos").join(s, [*K, "sp"]).where("sd <> direction")
    return j.where("(direction = 'up' AND sv > end_value + 1e-12) OR (direction = 'down' AND sv < end_value - 1e-12)").select(*K, "pos", "sp").distinct()


def commit_conflicts(evidence: DataFrame) -> DataFrame:
    """Fingerprints that carry several commit times."""
    return evidence.groupBy(*K, "fingerprint").agg(F.count_distinct("committed_at").alias("n")).where("n > 1")


def macd_anchor_issues(anchors: DataFrame, bars: DataFrame) -> DataFrame:
    """Anchors (``open_time`` and ``close_time`` of their last bar, ``expected_next_open``) that the first
    bar of their key does not continue; an anchor whose key has no bars is one too."""
    first = bars.groupBy(*K).agg(F.min("open_time").alias("first_open"))
    code = (
        F.when(F.col("first_open").isNull(), "NO_BARS").when(F.col("first_open") <= F.col("open_time"), "NOT_AFTER_ANCHOR")
        .when(F.col("first_open") <= F.col("close_time"), "OVERLAPS_ANCHOR").when(F.col("first_open") != F.col("expected_next_open"), "NOT_CONTIGUOUS")
    )
    return anchors.join(first, K, "left").withColumn("code", code).where("code IS NOT NULL")
