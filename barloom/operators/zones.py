"""Overlap zones of alternating units (strokes or segments).

Units are rows ``symbol, interval, pos, direction, start_value, end_value, high, low, start_dt,
end_dt``; which unit belongs to which zone is a fold with a few numbers of state, which passes the
units on with what an aggregate needs, so everything about a zone is one more shuffle and no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import KEYS, keyed_fold, micros, times

K = list(KEYS)


UNIT = ["pos", "direction", "start_value", "end_value", "high", "low", "start_dt", "end_dt"]
_FED = ["pos", "direction", "end_value", "high", "low", "t0", "t1"]
#: A member with the zone's number and range so far, the extremes of the members before it, and whether it meets the range.
MEMBER = (
    "pos long, direction string, end_value double, high double, low double, t0 long, t1 long, zone long, rank long, zg double, zd double, "
    "before_high double, before_low double, meets boolean"
)


def _meets(high: float, low: float, zd: float, zg: float) -> bool:
    return zd <= high <= zg or zd <= low <= zg or (high >= zg and low <= zd)


class _Group:
    """One zone while it grows: its range is the overlap of the first three members."""

    def __init__(self, number: int):
        self.number, self.rank, self.zg, self.zd = number, 0, float("inf"), float("-inf")
        self.top, self.bottom = None, None

    def add(self, row: tuple) -> tuple:
        high, low = row[3], row[4]
        if self.rank < 3:
            self.zg, self.zd = min(self.zg, high), max(self.zd, low)
        self.rank += 1
        # Of the first three each holds their overlap, if there is any.
        out = (*row, self.number, self.rank, self.zg, self.zd, self.top, self.bottom, self.rank <= 3 or _meets(high, low, self.zd, self.zg))
        self.top = high if self.top is None else max(self.top, high)
        self.bottom = low if self.bottom is None else min(self.bottom, low)
        return out


class _Groups:
    def __init__(self) -> None:
        self.now: _Group | None = None

    def push(self, row: tuple) -> list[tuple]:
        g = self.now
        if g is None or (row[3] < g.zd if row[1] == "up" else row[4] > g.zg):
            g = self.now = _Group(g.number + 1 if g else 0)
        return [g.add(row)]

    def finish(self) -> list[tuple]:
        return []


def _members(units: DataFrame, make) -> DataFrame:
    fed = units.withColumns({"t0": micros("start_dt"), "t1": micros("end_dt")})
    out = keyed_fold(fed, _FED, ["pos"], make, MEMBER)
    return times(out, ["t0", "t1"], dict(units.dtypes)["start_dt"])


def group_members(units: DataFrame) -> DataFrame:
    """Every unit with the group it is in: a unit opens a new group if it stays clear of the group's
    zone on its own side; the zone is the overlap of the first three members."""
    return _members(units, lambda key: _Groups()).withColumnRenamed("zone", "group")


def _stats(members: DataFrame, zone: str) -> DataFrame:
    """Per zone: bounds of its first three members, of all, and of all but a departing last one. One
    aggregate: what is needed of earlier members comes along with the last one."""
    last = lambda c: F.max_by(c, "pos")
    base = members.groupBy(*K, zone).agg(
        last("zg").alias("zg"), last("zd").alias("zd"), F.count("*").alias("size"), F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"),
        F.min_by("t0", "pos").alias("start_dt"), last("t1").alias("end_dt"), F.min_by("direction", "pos").alias("first_direction"), last("direction").alias("last_direction"),
        last("end_value").alias("lv"), F.max("high").alias("gg"), F.min("low").alias("dd"), last("before_high").alias("bh"), last("before_low").alias("bl"), F.bool_and("meets").alias("meet"),
    )
    base = base.withColumn("departs", (F.col("lv") < F.col("zd")) | (F.col("lv") > F.col("zg")))
    return base.select(
        *K, zone, "zg", "zd", "size", "start_pos", "end_pos", "start_dt", "end_dt", "first_direction", "last_direction", (F.col("zd") + (F.col("zg") - F.col("zd")) / 2).alias("zz"), "departs",
        "gg", "dd", F.when(F.col("departs"), F.col("bh")).otherwise(F.col("gg")).alias("trend_gg"), F.when(F.col("departs"), F.col("bl")).otherwise(F.col("dd")).alias("trend_dd"),
        (F.col("size") - F.col("departs").cast("int")).alias("trend_size"), ((F.col("size") >= 3) & (F.col("zg") >= F.col("zd")) & F.col("meet")).alias("is_valid"),
    )


def stroke_zone_groups(units: DataFrame) -> DataFrame:
    """All groups with their bounds; ``is_valid`` marks those that are zones."""
    return _stats(group_members(units), "group")


def stroke_zones(units: DataFrame) -> DataFrame:
    """Valid groups, ``zone`` 0, 1, … per key."""
    w = Window.partitionBy(*K).orderBy("group")
    return stroke_zone_groups(units).where("is_valid").withColumn("zone", (F.row_number().over(w) - 1).cast("long"))


def zone_seeds(units: DataFrame) -> DataFrame:
    """Every three units in a row that share a price range; touching counts."""
    w = Window.partitionBy(*K).orderBy("pos").rowsBetween(0, 2)
    rows = units.select(*K, F.col("pos").alias("start_pos"), F.min("high").over(w).alias("zg"), F.max("low").over(w).alias("zd"), F.count("*").over(w).alias("n"))
    return rows.where("n = 3 AND zg >= zd").drop("n")


class _SegmentZones:
    def __init__(self) -> None:
        self.zones, self.held, self.now = 0, [], None

    def push(self, row: tuple) -> list[tuple]:
        if self.now is not None:
            if row[3] >= self.now.zd and row[4] <= self.now.zg:
                return [self.now.add(row)]
            self.now, self.held = None, []
        self.held = [*self.held, row][-3:]
        if len(self.held) < 3 or min(x[3] for x in self.held) < max(x[4] for x in self.held):
            return []
        self.now, held, self.held = _Group(self.zones), self.held, []
        self.zones += 1
        return [self.now.add(x) for x in held]

    def finish(self) -> list[tuple]:
        return []


def segment_zone_members(units: DataFrame) -> DataFrame:
    """The units of each zone: the earliest seed grows as long as the next unit meets its fixed range; the
    search goes on behind it."""
    return _members(units, lambda key: _SegmentZones())


def segment_zone_spans(units: DataFrame) -> DataFrame:
    """``zone, start_pos, end_pos, zd, zg``."""
    return segment_zone_members(units).groupBy(*K, "zone").agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.max_by("zd", "pos").alias("zd"), F.max_by("zg", "pos").alias("zg")
    )


def segment_zones(units: DataFrame) -> DataFrame:
    return _stats(segment_zone_members(units), "zone")


def zone_candidates(units: DataFrame, formal: DataFrame) -> DataFrame:
    """Detected spans and bare seeds that are not formal zones, each position range once."""
    seeds = zone_seeds(units).select(*K, "start_pos", (F.col("start_pos") + 2).alias("end_pos"), "zd", "zg", F.lit(1).alias("o"))
    spans = segment_zone_spans(units).select(*K, "start_pos", "end_pos", "zd", "zg", F.lit(0).alias("o"))
    rn = F.row_number().over(Window.partitionBy(*K, "start_pos", "end_pos").orderBy("o"))
    both = spans.unionByName(seeds).join(formal.select(*K, "start_pos", "end_pos"), [*K, "start_pos", "end_pos"], "left_anti")
    return both.withColumn("rn", rn).where("rn = 1").drop("rn", "o").withColumn("width", F.col("zg") - F.col("zd"))


def quarantined(units: DataFrame, first_end: DataFrame) -> DataFrame:
    """Units behind the first group or zone of each key (``first_end``: key, end_pos), with positions
    kept: for series whose left end cannot be trusted."""
    ends = first_end.select(*K, F.col("end_pos").alias("__first_end"))  # segments have an end_pos of their own
    return units.join(ends, K, "left").where("__first_end IS NULL OR pos > __first_end").drop("__first_end")


def behind_first_group(units: DataFrame) -> DataFrame:
    """Units of a series that may begin inside a stroke zone: those behind the first group count."""
    return quarantined(units, group_members(units).where("group = 0").groupBy(*K).agg(F.max("pos").alias("end_pos")))


def behind_first_zone(units: DataFrame) -> DataFrame:
    """The same with the first segment zone; a key without a zone keeps all its units."""
    return quarantined(units, segment_zone_members(units).where("zone = 0").groupBy(*K).agg(F.max("pos").alias("end_pos")))


def zone_issues(zones: DataFrame, units: DataFrame) -> DataFrame:
    """Zones that break an invariant: too short, no overlap, a member that misses the range, order
    against the zone before, or (for spans) a next unit that should belong."""
    w = Window.partitionBy(*K).orderBy("start_pos")
    prev = F.lag("end_pos").over(w)
    nxt = units.select(*K, (F.col("pos") - 1).alias("end_pos"), F.col("high").alias("nh"), F.col("low").alias("nl"))
    code = (
        F.when(F.col("size") < 3, "ZONE_TOO_SHORT").when(F.col("zg") < F.col("zd"), "ZONE_WITHOUT_OVERLAP").when(~F.col("is_valid"), "MEMBER_OUTSIDE")
        .when(F.col("end_pos") - F.col("start_pos") + 1 != F.col("size"), "NOT_CONTIGUOUS").when(F.col("__prev") >= F.col("start_pos"), "ZONES_OVERLAP")
        .when((F.col("nh") >= F.col("zd")) & (F.col("nl") <= F.col("zg")), "NOT_MAXIMAL")
    )
    return zones.withColumn("__prev", prev).join(nxt, [*K, "end_pos"], "left").withColumn("code", code).where("code IS NOT NULL").select(*K, "start_pos", "end_pos", "code")
