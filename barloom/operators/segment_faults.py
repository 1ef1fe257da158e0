"""The full check of a chain of committed segments against its strokes, its evidence and a recomputation.

``segments``: pos, direction, start_dt, start_value, end_dt, end_value, size, fingerprint; ``strokes``: pos, direction,
start_dt, start_value, end_dt, end_value, high, low; ``evidence`` (by pos): start_pos, end_pos, confirmation, gap (of the
fractal that made it wait), primary_gap, broken, reverse, origin_pos, origin_at, confirmed_at_pos, available_at, committed_at, committed_pos, fingerprint; ``candidates`` (by
pos): endpoint_pos, value, gap, status, detected_at_pos of the feature fractals of a segment's own scan. Joins by key and
position only: what a segment covers and what it waited for is exploded into positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import KEYS
from .legacy_segments import endpoints
from .segment_machine import CONFIRMED, EPS, GAP_REVERSE, NO_GAP

K = list(KEYS)


def placed(segments: DataFrame, strokes: DataFrame) -> DataFrame:
    """Segments with the positions ``s`` and ``e`` of their ends among the strokes' endpoints (null: not there), the
    mark of their first end, the common range of their first three strokes and the extremes of either side."""
    ends = endpoints(strokes).select(*K, F.col("pos").alias("p"), "dt", "value", "mark")
    rows = segments
    for side, name in (("start", "s"), ("end", "e")):
        at = ends.select(*K, F.col("dt").alias(f"{side}_dt"), F.col("value").alias(f"__{name}v"), F.col("p").alias(name), F.col("mark").alias(f"{name}_mark"))
        met = rows.select(*K, "pos", f"{side}_dt", f"{side}_value").join(at, [*K, f"{side}_dt"]).where(F.abs(F.col(f"__{name}v") - F.col(f"{side}_value")) <= EPS)
        rows = rows.join(met.select(*K, "pos", name, f"{name}_mark"), [*K, "pos"], "left")
    sound = rows.where("e > s").select(*K, "pos", "direction", "s", "e", F.explode(F.sequence("s", F.greatest(F.col("e") - 1, F.col("s") + 2))).alias("p"))
    st = strokes.select(*K, F.col("pos").alias("p"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("start_value").alias("sv"), F.col("end_value").alias("ev"))
    three, even, inside = F.col("p") < F.col("s") + 3, (F.col("p") - F.col("s")) % 2 == 0, F.col("p") < F.col("e")
    own = sound.join(st, [*K, "p"]).groupBy(*K, "pos").agg(
        F.count_if(three).alias("n3"), F.max(F.when(three, F.col("l"))).alias("lo3"), F.min(F.when(three, F.col("h"))).alias("hi3"),
        *[f(F.when(inside & even, F.col(c))).alias(f"{c}_{n}") for f, n in ((F.min, "min"), (F.max, "max")) for c in ("sv", "ev")],
    )
    return rows.join(own, [*K, "pos"], "left")


def _overlap() -> Column:
    return F.coalesce((F.col("n3") == 3) & (F.col("lo3") <= F.col("hi3") + EPS), F.lit(False))


def _after(a: Column, pa: Column, b: Column, pb: Column, sign: Column) -> Column:
    """Endpoint a goes beyond b, or is as far and comes later."""
    d = sign * (a - b)
    return (d > EPS) | ((F.abs(d) <= EPS) & (pa > pb))


def _waits(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments confirmed across a gap, from the fractal whose gap made them wait (``sign``: 1 if tops are ends)."""
    g = evidence.where(F.col("confirmation") == GAP_REVERSE).select(*K, "pos", "start_pos", "origin_pos", "origin_at", "confirmed_at_pos")
    return g.join(segments.select(*K, "pos", "direction"), [*K, "pos"]).withColumn("sign", F.when(F.col("direction") == "up", 1).otherwise(-1))


def skipped_primaries(evidence: DataFrame, segments: DataFrame, strokes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Waits for a reverse fractal in which a fractal without a gap would have ended the segment before: it
    is broken, far enough from the start, and no endpoint of the wait until then goes beyond its own. ``pos`` and
    the position ``at`` at which the first one was known."""
    wait = _waits(evidence, segments)
    three = strokes.select(*K, F.col("pos").alias("start_pos"), F.max("low").over(_three()).alias("lo3"), F.min("high").over(_three()).alias("hi3"), F.count("*").over(_three()).alias("n3"))
    fine = candidates.where((F.col("status") == CONFIRMED) & ~F.col("gap")).select(*K, "pos", "endpoint_pos", "value", F.col("detected_at_pos").alias("at"))
    n = F.col("endpoint_pos") - F.col("start_pos")
    met = wait.join(fine, [*K, "pos"]).where("at > origin_at AND at > origin_pos AND at <= confirmed_at_pos").where((n >= 3) & (n % 2 == 1)).join(three, [*K, "start_pos"]).where(_overlap())
    best = met.groupBy(*K, "pos", "direction", "sign", "origin_pos", "at").agg(F.max(F.struct((F.col("sign") * F.col("value")).alias("v"), "endpoint_pos")).alias("c"))
    passed = best.select(*K, "pos", "direction", "sign", "at", "c", F.explode(F.sequence("origin_pos", "at")).alias("sp"))
    st = strokes.select(*K, F.col("pos").alias("sp"), F.col("direction").alias("sd"), F.col("start_value").alias("sv"))
    active = passed.join(st, [*K, "sp"]).where("sd <> direction").groupBy(*K, "pos", "at", "c").agg(F.max(F.struct((F.col("sign") * F.col("sv")).alias("v"), "sp")).alias("a"))
    ends = (F.col("c.endpoint_pos") == F.col("a.sp")) | _after(F.col("c.v"), F.col("c.endpoint_pos"), F.col("a.v"), F.col("a.sp"), F.lit(1))
    return active.where(ends).groupBy(*K, "pos").agg(F.min("at").alias("at"))


def _three() -> Window:
    return Window.partitionBy(*K).orderBy("pos").rowsBetween(0, 2)


def superseded(evidence: DataFrame, segments: DataFrame, strokes: DataFrame) -> DataFrame:
    """Waits during which an endpoint of the segment's own kind went beyond its end."""
    wait = _waits(evidence, segments).join(evidence.select(*K, "pos", "end_pos"), [*K, "pos"]).join(segments.select(*K, "pos", "end_value"), [*K, "pos"])
    later = wait.where("confirmed_at_pos > end_pos + 1").withColumn("sp", F.explode(F.sequence(F.col("end_pos") + 1, F.col("confirmed_at_pos") - 1)))
    st = strokes.select(*K, F.col("pos").alias("sp"), F.col("direction").alias("sd"), F.col("start_value").alias("sv"))
    return later.join(st, [*K, "sp"]).where("sd <> direction AND sign * (sv - end_value) > 1e-12").select(*K, "pos").distinct()


def segment_faults(
    segments: DataFrame, strokes: DataFrame, evidence: DataFrame, candidates: DataFrame | None = None, expected: DataFrame | None = None, stable: DataFrame | None = None
) -> DataFrame:
    """``pos, code`` for every broken rule; -1 where the chain as a whole is meant.

    ``expected``: segments recomputed from the strokes, of which the given ones must be a run without a break. ``stable`` (key,
    ``stable``): strokes that cannot be taken back any more. A segment whose ends are not among the strokes gets that
    code and those that ask for no position.
    """
    w = Window.partitionBy(*K).orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    e = evidence.select(*K, "pos", *[F.col(c).alias(f"v_{c}") for c in ("start_pos", "end_pos", "confirmation", "gap", "primary_gap", "broken", "reverse", "available_at", "committed_at", "committed_pos", "fingerprint")], F.lit(True).alias("there"))
    rows = placed(segments, strokes).join(e, [*K, "pos"], "left")
    if stable is not None:
        rows = rows.join(stable.select(*K, "stable"), K, "left")
    else:
        rows = rows.withColumn("stable", F.lit(None).cast("long"))
    rows = rows.withColumns({"p": F.lag(F.struct("direction", "end_dt", "end_value")).over(w), "c_at": F.last("v_committed_at", ignorenulls=True).over(before), "c_pos": F.last("v_committed_pos", ignorenulls=True).over(before)})
    up, has, known = F.col("direction") == "up", F.col("there"), F.col("e") > F.col("s")
    n = F.col("e") - F.col("s")
    marks = F.coalesce((F.col("s_mark") == F.when(up, "D").otherwise("G")) & (F.col("e_mark") == F.when(up, "G").otherwise("D")), F.lit(False))
    extreme = F.when(up, (F.col("start_value") <= F.col("sv_min") + EPS) & (F.col("end_value") >= F.col("ev_max") - EPS)).otherwise((F.col("start_value") >= F.col("sv_max") - EPS) & (F.col("end_value") <= F.col("ev_min") + EPS))
    timed = F.col("v_committed_at").isNotNull() & F.col("v_committed_pos").isNotNull()
    gap = F.col("v_confirmation") == GAP_REVERSE
    rules: list[tuple[str, Column]] = [
        ("DIRECTION_MARK", F.col("s").isNotNull() & F.col("e").isNotNull() & ~marks), ("STROKE_COUNT", (F.col("size") < 3) | (F.col("size") % 2 == 0)), ("ENDPOINT_NOT_IN_CHAIN", ~F.coalesce(known, F.lit(False))),
        ("STROKES_NOT_CONTIGUOUS", known & (F.col("size") != n)), ("FIRST_THREE_APART", known & ~_overlap()), ("FIRST_EXTREME", known & (F.col("pos") == 0) & ~(extreme & (n >= 3) & (n % 2 == 1) & _overlap())),
        ("OUTSIDE_STABLE_PREFIX", known & has & (F.col("v_end_pos") >= F.col("stable"))), ("EVIDENCE_OF_ANOTHER", known & has & ~F.col("v_fingerprint").eqNullSafe(F.col("fingerprint"))), ("COMMIT_MISSING", known & has & ~timed),
        ("COMMIT_TIME_NOT_MONOTONIC", known & timed & (F.col("v_committed_at") < F.col("c_at"))), ("COMMIT_POSITION_NOT_MONOTONIC", known & timed & (F.col("v_committed_pos") < F.col("c_pos"))),
        ("CONFIRMATION_TIME_MISSING", known & timed & F.col("v_available_at").isNull()), ("COMMITTED_BEFORE_EVIDENCE", known & timed & (F.col("v_committed_at") < F.col("v_available_at"))),
        ("EVIDENCE_ENDPOINTS", known & has & ((F.col("v_start_pos") != F.col("s")) | (F.col("v_end_pos") != F.col("e")))), ("NO_ACTUAL_BREAK", known & has & ~F.col("v_broken")),
        ("NO_GAP_HAS_GAP", known & (F.col("v_confirmation") == NO_GAP) & F.col("v_primary_gap")), ("GAP_EVIDENCE_MISSING", known & gap & (~F.col("v_gap") | ~F.col("v_reverse"))),
        ("NOT_ALTERNATING", F.col("direction") == F.col("p.direction")), ("ENDPOINT_NOT_SHARED", (F.col("start_dt") != F.col("p.end_dt")) | (F.abs(F.col("start_value") - F.col("p.end_value")) > EPS)),
    ]
    out = rows.select(*K, "pos", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))).alias("code"))
    out = out.unionByName(superseded(evidence, segments, strokes).withColumn("code", F.lit("GAP_ENDPOINT_SUPERSEDED")))
    if candidates is not None:
        out = out.unionByName(skipped_primaries(evidence, segments, strokes, candidates).select(*K, "pos", F.lit("SKIPPED_PRIMARY_WITHOUT_GAP").alias("code")))
    count = lambda df, name: df.groupBy(*K).agg(F.count("*").alias(name))
    both = count(segments, "a").join(count(evidence, "b"), K, "full_outer").where("NOT a <=> b")
    out = out.unionByName(both.select(*K, F.lit(-1).cast("long").alias("pos"), F.lit("EVIDENCE_COUNT").alias("code")))
    if expected is not None:
        same = ["direction", "start_dt", "start_value", "end_dt", "end_value"]
        x = expected.select(*K, F.col("pos").alias("x"), *same)
        met = segments.select(*K, "pos", *same).join(x, [*K, *same], "left").groupBy(*K).agg(F.count("x").alias("n"), F.count("*").alias("m"), F.min(F.col("x") - F.col("pos")).alias("lo"), F.max(F.col("x") - F.col("pos")).alias("hi"))
        out = out.unionByName(met.where("n < m OR lo <> hi").select(*K, F.lit(-1).cast("long").alias("pos"), F.lit("CHAIN_MISMATCH").alias("code")))
    return out
