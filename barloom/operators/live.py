"""What is not final yet: overlays, contiguous blocks and projected lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import KEYS

K = list(KEYS)

#: Seconds between refreshes by interval.
REFRESH_SECONDS = {
    "1m": 10, "3m": 20, "5m": 30, "15m": 60, "30m": 90, "1h": 120, "2h": 180, "4h": 300, "6h": 300, "8h": 300, "12h": 300, "1d": 600, "3d": 900, "1w": 1800, "1M": 1800,
}


def refresh_trigger(interval: str) -> str:
    """A processing-time trigger that suits an interval; one without a cadence is an error."""
    if interval not in REFRESH_SECONDS:
        raise ValueError(f"no refresh cadence for interval {interval!r}")
    return f"{REFRESH_SECONDS[interval]} seconds"


def contiguous_offset(needle: DataFrame, hay: DataFrame, on: list[str]) -> DataFrame:
    """Per key, the least offset at which all rows of ``needle`` (by ``pos``) appear in ``hay`` in a
    row; keys without one are missing. Equal values of the ``on`` columns match."""
    n = needle.select(*K, *on, F.col("pos").alias("np"))
    hits = n.join(hay.select(*K, *on, F.col("pos").alias("hp")), [*K, *on]).groupBy(*K, (F.col("hp") - F.col("np")).alias("offset")).agg(F.count_distinct("np").alias("c"))
    size = n.groupBy(*K).agg(F.count("*").alias("size"))
    return hits.join(size, K).where("c = size").groupBy(*K).agg(F.min("offset").alias("offset"))


def common_prefix(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Per key, how many rows at the start of both sequences are equal."""
    sig = F.struct(*on)
    both = a.select(*K, "pos", sig.alias("x")).join(b.select(*K, "pos", sig.alias("y")), [*K, "pos"], "full_outer")
    return both.groupBy(*K).agg(F.coalesce(F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("pos"))), F.max("pos") + 1).alias("length"))


def overlay(confirmed: DataFrame, live: DataFrame, on: list[str]) -> DataFrame:
    """Live rows that are not in the formal block: with ``reason`` RIGHT_TAIL or LEFT_PREFIX where the
    block was found, UNRESOLVED_BOUNDARY for all rows of a key where it was not."""
    at = contiguous_offset(confirmed, live, on)
    size = confirmed.groupBy(*K).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    rows = live.join(at, K, "left").join(size, K, "left")
    reason = (
        F.when(F.col("offset").isNull(), "UNRESOLVED_BOUNDARY").when(F.col("pos") > F.col("hi") + F.col("offset"), "RIGHT_TAIL")
        .when(F.col("pos") < F.col("lo") + F.col("offset"), "LEFT_PREFIX")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").drop("offset", "lo", "hi")


LINE = ["direction", "start_dt", "start_value", "end_dt", "end_value"]


def _extreme_end(rows: DataFrame) -> DataFrame:
    """Per key (and start): the end of most extreme value on the side of ``direction``, of equals the
    latest. Lines without height drop out."""
    rank = F.struct(F.when(F.col("direction") == "up", F.col("end_value")).otherwise(-F.col("end_value")), F.col("end_dt"))
    best = rows.groupBy(*K, "direction", "start_dt", "start_value").agg(F.max_by(F.struct("end_dt", "end_value"), rank).alias("e"))
    return best.select(*K, "direction", "start_dt", "start_value", "e.end_dt", "e.end_value").where("abs(end_value - start_value) > 1e-12")


def turned(c: str) -> Column:
    return F.when(F.col(c) == "down", "up").otherwise("down")


def next_stroke(strokes: DataFrame, merged: DataFrame) -> DataFrame:
    """Per key, a line from the last stroke's end to the extreme merged bar behind it; among equal
    extremes the latest."""
    last = strokes.groupBy(*K).agg(F.max_by(F.struct("direction", "end_dt", "end_value"), "pos").alias("l"))
    after = merged.join(last, K).where("dt > l.end_dt").select(
        *K, turned("l.direction").alias("direction"), F.col("l.end_dt").alias("start_dt"), F.col("l.end_value").alias("start_value"), F.col("dt").alias("end_dt"), "high", "low"
    )
    return _extreme_end(after.withColumn("end_value", F.when(F.col("direction") == "up", F.col("high")).otherwise(F.col("low"))))


def next_segment(segments: DataFrame, strokes: DataFrame, unfinished: DataFrame, provisional: DataFrame | None = None) -> DataFrame:
    """Per key, a line from the end of the last committed segment against its direction; without one,
    from the start of the unfinished strokes along the first of them. It ends at the most extreme end of
    a stroke behind its start (an unfinished one in the second case) or of a provisional line
    (``LINE`` columns) that runs its way."""
    last = segments.groupBy(*K).agg(F.max_by(F.struct("direction", "end_dt", "end_value"), "pos").alias("l"))
    begin = last.select(*K, turned("l.direction").alias("direction"), F.col("l.end_dt").alias("start_dt"), F.col("l.end_value").alias("start_value"), F.lit(True).alias("formal"))
    first = unfinished.groupBy(*K).agg(F.min_by(F.struct("direction", "start_dt", "start_value"), "pos").alias("f"))
    begin = begin.unionByName(first.join(last, K, "left_anti").select(*K, "f.direction", "f.start_dt", "f.start_value", F.lit(False).alias("formal")))
    end = lambda df, kind: df.select(*K, F.col("direction").alias("d"), "end_dt", "end_value", F.lit(kind).alias("kind"))
    ends = end(strokes, "stroke").unionByName(end(unfinished, "unfinished"))
    if provisional is not None:
        ends = ends.unionByName(end(provisional, "line"))
    fits = F.when(F.col("formal"), F.col("kind") != "unfinished").otherwise(F.col("kind") != "stroke")
    return _extreme_end(begin.join(ends, K).where((F.col("d") == F.col("direction")) & (F.col("end_dt") > F.col("start_dt")) & fits))


def provisional_lines(confirmed: DataFrame, live: DataFrame, projection: DataFrame) -> DataFrame:
    """What a live chart dashes: the live units outside of the formal block (``overlay``), and the projected
    line unless it equals the last of them."""
    lines = overlay(confirmed, live, LINE).select(*K, *LINE, "reason")
    last = lines.groupBy(*K).agg(F.max_by(F.struct(*LINE), "end_dt").alias("l"))
    new = projection.join(last, K, "left").where(~F.struct(*LINE).eqNullSafe(F.col("l")) | F.col("l").isNull()).select(*K, *LINE, F.lit("PROJECTED").alias("reason"))
    return lines.unionByName(new)


def positional_diff(a: DataFrame, b: DataFrame, order: list[str], compare: list[str], tolerance: float = 0.0) -> DataFrame:
    """Two row lists compared by their ordinal in each key: one row per ordinal with ``match``."""
    def numbered(df: DataFrame, name: str) -> DataFrame:
        rn = F.row_number().over(Window.partitionBy(*K).orderBy(*order)) - 1
        return df.select(*K, rn.cast("long").alias("ordinal"), F.struct(*compare).alias(name))

    both = numbered(a, "left").join(numbered(b, "right"), [*K, "ordinal"], "full_outer")
    types = dict(a.dtypes)
    same = F.col("left").isNotNull() & F.col("right").isNotNull()
    for c in compare:
        x, y = F.col(f"left.{c}"), F.col(f"right.{c}")
        same = same & (x.eqNullSafe(y) | ((F.abs(x - y) <= tolerance) if types[c] in ("double", "float") and tolerance else F.lit(False)))
    return both.withColumn("match", F.coalesce(same, F.lit(False)))


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy(*K).agg(F.count("*").alias("compared"), F.count_if("match").alias("matched"))
