"""The older point rules, which look one level down: a first point needs a complete structure inside the
segment that leaves the last zone, a second point a first point of strokes at the end of its pullback.

``segments``: units with ``start_pos`` and ``end_pos`` (exclusive) of their strokes; ``strokes``: units.
The strokes of a segment become a series of their own, so the operators for zones and points serve both
levels, and no task holds more than a segment's strokes at once.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import points, zones
from .folds import KEYS

K = list(KEYS)
EPS = points.EPS


def inner_strokes(segments: DataFrame, strokes: DataFrame) -> DataFrame:
    """The strokes of each segment; ``symbol`` names key and segment."""
    at = segments.where("end_pos > start_pos").select(*K, F.col("pos").alias("segment"), F.explode(F.expr("sequence(start_pos, end_pos - 1)")).alias("pos"))
    return at.join(strokes, [*K, "pos"]).withColumn("symbol", F.concat_ws("#", "symbol", "segment")).drop("segment")


def outward(inner: DataFrame) -> DataFrame:
    """Rows of inner series under the key of their segments, with ``segment``."""
    number = F.substring_index("symbol", "#", -1)
    return inner.withColumns({"segment": number.cast("long"), "symbol": F.expr("left(symbol, length(symbol) - length(substring_index(symbol, '#', -1)) - 1)")})


def inner_thirds(zones_: DataFrame, segments: DataFrame, inner: DataFrame) -> DataFrame:
    """Per zone whose last segment has one (``segment_pos``): the stroke ``third_pos`` that pulls back after
    a stroke beyond the zone, stays beyond it and is passed by the next one; the first such stroke."""
    w = Window.partitionBy(*K).orderBy("pos")
    nxt = lambda k: F.lead(F.struct("direction", "start_value", "end_value", "high", "low"), k).over(w)
    three = outward(inner.withColumns({"back": nxt(1), "on": nxt(2)}).where("on IS NOT NULL")).select(
        *K, F.col("segment").alias("segment_pos"), F.col("pos").alias("sp"), F.col("direction").alias("sd"), F.col("end_value").alias("sv"), "back", "on"
    )
    legs = zones_.select(*K, "zone", "zg", "zd", F.col("end_pos").alias("segment_pos")).join(segments.select(*K, F.col("pos").alias("segment_pos"), F.col("direction").alias("side")), [*K, "segment_pos"])
    down = (F.col("sv") < F.col("zd") - EPS) & (F.col("back.high") <= F.col("zd") + EPS) & (F.col("on.end_value") < F.col("back.start_value") - EPS)
    up = (F.col("sv") > F.col("zg") + EPS) & (F.col("back.low") >= F.col("zg") - EPS) & (F.col("on.end_value") > F.col("back.start_value") + EPS)
    along = (F.col("sd") == F.col("side")) & (F.col("back.direction") != F.col("side")) & (F.col("on.direction") == F.col("side"))
    found = legs.join(three, [*K, "segment_pos"]).where(along & F.when(F.col("side") == "down", down).otherwise(up))
    return found.groupBy(*K, "zone", "segment_pos").agg((F.min("sp") + 1).alias("third_pos"))


def inside(zones_: DataFrame, segments: DataFrame, strokes: DataFrame) -> DataFrame:
    """Per zone: ``third_pos`` (or null) and ``n_zones`` of strokes in its last segment; ``whole`` if there is a
    third point and there are two zones at least."""
    last = segments.join(zones_.select(*K, F.col("end_pos").alias("pos")).distinct(), [*K, "pos"], "left_semi")
    inner = inner_strokes(last, strokes)
    count = outward(zones.stroke_zones(inner).groupBy(*K).agg(F.count("*").alias("n_zones"))).withColumnRenamed("segment", "end_pos")
    out = zones_.select(*K, "zone", "end_pos").join(inner_thirds(zones_, segments, inner).drop("segment_pos"), [*K, "zone"], "left").join(count, [*K, "end_pos"], "left")
    n = F.coalesce("n_zones", F.lit(0)).cast("long")
    return out.select(*K, "zone", "third_pos", n.alias("n_zones"), (F.col("third_pos").isNotNull() & (n >= 2)).alias("whole"))


def stroke_first_points(segments: DataFrame, strokes: DataFrame, stroke_areas: DataFrame, exact: DataFrame) -> DataFrame:
    """Confirmed first points on the level of strokes inside each segment: ``segment, point_type, dt, price``."""
    inner = inner_strokes(segments, strokes).persist(StorageLevel.MEMORY_AND_DISK)  # read by zones, pairs and legs
    areas = inner_strokes(segments, stroke_areas).persist(StorageLevel.MEMORY_AND_DISK)
    known = segments.select(*K, "pos").join(exact, K).select(F.concat_ws("#", "symbol", "pos").alias("symbol"), "interval", "exact")
    first = points.first_points(inner, zones.stroke_zones(inner).persist(StorageLevel.MEMORY_AND_DISK), areas, known)
    return outward(first.where("status = 'confirmed'").select(*K, "point_type", "dt", "price"))


def first_points(segments: DataFrame, strokes: DataFrame, zones_: DataFrame, areas: DataFrame, exact: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """First points whose last leg is whole inside."""
    return points.first_points(segments, zones_, areas, exact, commits, inside(zones_, segments, strokes))


def candidates(first: DataFrame, segments: DataFrame, strokes: DataFrame, zones_: DataFrame, stroke_areas: DataFrame, exact: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """All judged candidates by the older rules; ``first`` (from ``first_points``) is read several times, so keep
    it. A second point is confirmed with its segment: a commit before the end of the segment's last stroke is
    ``points.provenance_issues``' to report."""
    third = first.unionByName(points.third_points(segments, zones_, commits))
    back = first.where("status = 'confirmed'").select(*K, (F.col("segment_pos") + 2).alias("pos")).distinct()
    if back.isEmpty():  # then there are no second points, and nothing to look for on the lower level
        return third
    pulled = segments.join(back, [*K, "pos"], "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    lower = stroke_first_points(pulled, strokes, stroke_areas, exact)
    return third.unionByName(points.second_points(first, segments, commits, lower))
