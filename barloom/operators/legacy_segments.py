"""The older segment finder by stroke extremes.

Potential turning points are found by window functions over the endpoints of one mark; the reduction
to alternating points at least three strokes apart is a fold. Exactly three strokes need to be
confirmed. A later point may take back any number of turning points, so the fold keeps those of a
key (one in three strokes at most) until its end; strokes are not kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import KEYS, keyed_fold
from .validators import EPS

K = list(KEYS)


def endpoints(strokes: DataFrame) -> DataFrame:
    """N strokes as N + 1 endpoints: every start, and the last end."""
    starts = strokes.select(*K, "pos", F.col("start_dt").alias("dt"), F.col("start_value").alias("value"), F.when(F.col("direction") == "up", "D").otherwise("G").alias("mark"))
    last = strokes.groupBy(*K).agg(F.max_by(F.struct((F.col("pos") + 1).alias("pos"), F.col("end_dt").alias("dt"), F.col("end_value").alias("value"), F.when(F.col("direction") == "up", "G").otherwise("D").alias("mark")), "pos").alias("e"))
    return starts.unionByName(last.select(*K, "e.*"))


def potentials(points: DataFrame) -> DataFrame:
    """Endpoints at least as extreme as both neighbours of their mark."""
    w = Window.partitionBy(*K, "mark").orderBy("pos")
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    top = (F.col("mark") == "G") & (F.col("value") >= before) & (F.col("value") >= after)
    low = (F.col("mark") == "D") & (F.col("value") <= before) & (F.col("value") <= after)
    return points.withColumn("__p", top | low).where("__p").drop("__p")


class _Alternate:
    """Rows ``(pos, mark, value, same, opposite, next)``: the values one mark and one endpoint before, and one behind."""

    def __init__(self, strict: bool) -> None:
        self.strict = strict
        self.points: list[tuple] = []

    def push(self, row: tuple) -> list[tuple]:
        pos, mark, value, same, opposite, after = row
        sign = 1 if mark == "G" else -1
        if not self.points:
            self.points.append(row[:3])
            return []
        last_pos, last_mark, last_value = self.points[-1]
        if last_mark == mark:  # of equal extremes the first stays
            if sign * value > sign * last_value:
                self.points[-1] = row[:3]
        elif sign * value <= sign * last_value:  # a top must be above the bottom before it: that one falls, this one does not stand
            self.points.pop()
        elif pos - last_pos > 3 or pos - last_pos == 3 and sign * value > sign * same and (not self.strict or sign * after > sign * opposite):
            self.points.append(row[:3])
        return []

    def finish(self) -> list[tuple]:
        return self.points


def turning_points(strokes: DataFrame, mode: str = "strict", merged: DataFrame | None = None) -> DataFrame:
    """Alternating extremes at least three strokes apart: the ends of the older segments.

    A turn after exactly three strokes must break the extreme of its mark before it; in ``strict``
    mode the next stroke must also stop short of the opposite extreme before it, in ``loose`` mode
    not. With ``merged`` bars, a last turning point that the latest of them breaks is taken back.
    """
    if mode not in ("strict", "loose"):
        raise ValueError("mode must be strict or loose")
    w = Window.partitionBy(*K).orderBy("pos")
    near = endpoints(strokes).withColumns({"same": F.lag("value", 2).over(w), "opposite": F.lag("value").over(w), "after": F.lead("value").over(w)})
    t = keyed_fold(potentials(near), ["pos", "mark", "value", "same", "opposite", "after"], ["pos"], lambda key: _Alternate(mode == "strict"), "pos long, mark string, value double")
    if merged is None:
        return t
    latest = merged.groupBy(*K).agg(F.max_by(F.struct("high", "low"), "mpos").alias("bar"))
    broken = F.when(F.col("mark") == "D", F.col("bar.low") < F.col("value")).otherwise(F.col("bar.high") > F.col("value"))
    last = t.withColumn("last", F.lead("pos").over(w).isNull()).join(latest, K, "left")
    return last.where(~(F.col("last") & F.coalesce(broken, F.lit(False)))).drop("last", "bar")


def legacy_segments(strokes: DataFrame, mode: str = "strict", merged: DataFrame | None = None) -> DataFrame:
    w = Window.partitionBy(*K).orderBy("pos")
    t = turning_points(strokes, mode, merged).withColumns({"end_pos": F.lead("pos").over(w), "end_value": F.lead("value").over(w)})
    return t.where("end_pos IS NOT NULL").select(
        *K, (F.row_number().over(w) - 1).cast("long").alias("idx"), F.when(F.col("mark") == "D", "up").otherwise("down").alias("direction"), F.col("pos").alias("start_pos"), "end_pos", F.col("value").alias("start_value"), "end_value"
    )


def legacy_issues(segments: DataFrame, strokes: DataFrame, mode: str = "strict") -> DataFrame:
    """Broken rules of older segments (rows of ``legacy_segments``) over their strokes; a segment may break several.

    An end that is no endpoint of the strokes, or not behind the start, is ``ENDPOINT_NOT_IN_CHAIN``;
    marks, values and confirmation are judged only where both ends are found. A null position is found
    nowhere. Without segments there are no rows.
    """
    if mode not in ("strict", "loose"):
        raise ValueError("mode must be strict or loose")
    w = Window.partitionBy(*K).orderBy("pos")
    p = endpoints(strokes).withColumns({"same": F.lag("value", 2).over(w), "opposite": F.lag("value").over(w), "after": F.lead("value").over(w)})
    a = p.select(*K, F.col("pos").alias("start_pos"), F.struct("mark", "value").alias("a"))
    b = p.select(*K, F.col("pos").alias("end_pos"), F.struct("mark", "value", "same", "opposite", "after").alias("b"))
    prev = F.lag(F.struct("direction", "end_pos", "end_value")).over(Window.partitionBy(*K).orderBy("idx"))
    seg = segments.withColumn("prev", prev).join(a, [*K, "start_pos"], "left").join(b, [*K, "end_pos"], "left")
    n, sign = F.col("end_pos") - F.col("start_pos"), F.when(F.col("b.mark") == "G", 1.0).otherwise(-1.0)
    found = F.col("a").isNotNull() & F.col("b").isNotNull() & (n > 0)
    marks = F.when(F.col("direction") == "up", "DG").otherwise("GD")
    confirmed = (sign * F.col("b.value") > sign * F.col("b.same")) & (sign * F.col("b.after") > sign * F.col("b.opposite"))
    codes = F.array_compact(F.array(
        F.when((n < 3) | (n % 2 == 0), F.lit("STROKE_COUNT")), F.when(~found, F.lit("ENDPOINT_NOT_IN_CHAIN")),
        F.when(found & (F.concat("a.mark", "b.mark") != marks), F.lit("DIRECTION_MARK")),
        F.when(found & ((F.abs(F.col("a.value") - F.col("start_value")) > EPS) | (F.abs(F.col("b.value") - F.col("end_value")) > EPS)), F.lit("ENDPOINT_VALUE")),
        F.when(found & F.lit(mode == "strict") & (n == 3) & ~F.coalesce(confirmed, F.lit(False)), F.lit("NOT_CONFIRMED")),
        F.when(F.col("direction") == F.col("prev.direction"), F.lit("NOT_ALTERNATING")),
        F.when((F.col("start_pos") != F.col("prev.end_pos")) | (F.col("start_value") != F.col("prev.end_value")), F.lit("ENDPOINT_NOT_SHARED")),
    ))
    return seg.select(*K, "idx", F.explode(codes).alias("code"))
