"""All layers of an analysis as lazy tables, for every key at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import next_open_time
from ..operators import bars as B
from ..operators import live, points, segment_faults, structure, validators, zones
from ..operators.folds import KEYS
from ..operators.stroke_machine import MIN_BARS

K = list(KEYS)


@dataclass(frozen=True)
class Analysis:
    """Layers of ``bars`` (without ``pos``). Each property is a DataFrame; the per-key fold runs once,
    its rows are persisted on first use and released by ``release``.

    With neither a trusted start nor an anchor the formal layers are empty and everything is a
    candidate. Where the start is an anchor and not trusted, the first zone of either kind may have begun
    before the window: it stays a candidate (``unresolved_…``) and the formal zones lie behind it.
    ``macd_anchors`` (key, open_time and close_time of the last bar, expected_next_open, ema_fast,
    ema_slow, dea, exact) continue MACD where their bars go on without a gap.
    """

    bars: DataFrame
    least: int = MIN_BARS
    trusted: bool = False
    anchors: dict | None = None
    macd_anchors: DataFrame | None = None

    @cached_property
    def positioned(self) -> DataFrame:
        return B.with_position(self.bars)

    @cached_property
    def merged(self) -> DataFrame:
        return structure.merged_bars(self.positioned)

    @cached_property
    def fractals(self) -> DataFrame:
        return structure.fractals(self.merged)

    @cached_property
    def events(self) -> DataFrame:
        return structure.structure(self.positioned, self.least, self.trusted, self.anchors).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        for name in ("events", "gated_segments"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    def _kind(self, kind: str, layer: str | None = None) -> DataFrame:
        rows = self.events.where(F.col("kind") == kind)
        return (rows.where(F.col("layer") == layer) if layer else rows).withColumn("pos", F.col("idx"))

    @cached_property
    def strokes(self) -> DataFrame:
        """Canonical strokes; ``layer`` is stable, provisional or left_unresolved."""
        return self._kind("stroke").select(
            *K, "pos", "layer", "direction", "start_dt", "start_value", "end_dt", "end_value", "high", "low", F.col("size").alias("length"), "source_start", "source_end", "known_at", "fingerprint"
        )

    def _segments(self, layer: str) -> DataFrame:
        return self._kind("segment", layer).select(
            *K, "pos", "direction", "start_pos", "end_pos", "start_dt", "start_value", "end_dt", "end_value", "high", "low", "size", "source_start", "source_end", "fingerprint", "committed_at"
        )

    @cached_property
    def detected_segments(self) -> DataFrame:
        return self._segments("detected")

    @cached_property
    def segments(self) -> DataFrame:
        """The ledger: committed segments."""
        return self._segments("committed")

    @cached_property
    def evidence(self) -> DataFrame:
        return self._kind("segment", "committed").select(
            *K, "pos", "start_pos", "end_pos", F.col("code").alias("confirmation"), "gap", "moved", "left_pos", "middle_pos", "right_pos",
            F.col("at_pos").alias("confirmed_at_pos"), F.col("known_at").alias("available_at"), "committed_at", "committed_pos", "fingerprint",
            "origin_pos", "origin_at", "broken", "reverse", "primary_gap",
        )

    @cached_property
    def waiting_candidates(self) -> DataFrame:
        """Feature fractals that stood while a committed segment waited for its reverse fractal."""
        return self._kind("candidate").select(*K, "pos", "direction", F.col("code").alias("status"), F.col("end_pos").alias("endpoint_pos"), F.col("end_value").alias("value"), "gap", F.col("at_pos").alias("detected_at_pos"))

    @cached_property
    def segment_faults(self) -> DataFrame:
        """What breaks a rule of committed segments, their evidence and their waits; empty on sound data."""
        stable = self._kind("state").select(*K, F.col("end_pos").alias("stable"))
        return segment_faults.segment_faults(self.segments, self.strokes, self.evidence, self.waiting_candidates, self.detected_segments, stable)

    @cached_property
    def feature_elements(self) -> DataFrame:
        return self._kind("element").select(*K, F.col("start_pos").alias("sequence_start"), "direction", "pos", F.col("code").alias("merge_direction"), F.col("middle_pos").alias("positions"), "high", "low")

    @cached_property
    def feature_fractals(self) -> DataFrame:
        return self._kind("feature").select(
            *K, "pos", "direction", F.col("code").alias("status"), F.col("end_pos").alias("endpoint_pos"), F.col("end_dt").alias("dt"), F.col("end_value").alias("value"),
            "gap", "left_pos", "middle_pos", "right_pos", F.col("at_pos").alias("detected_at_pos"),
        )

    @cached_property
    def diagnostics(self) -> DataFrame:
        return self._kind("note").select(*K, "layer", "pos", "code", F.col("end_dt").alias("dt"), F.col("at_pos").alias("stroke_pos"))

    @cached_property
    def segment_overlay(self) -> DataFrame:
        """Detected segments left and right of the committed block."""
        return live.overlay(self.segments.drop("committed_at"), self.detected_segments.drop("committed_at"), ["direction", "start_dt", "start_value", "end_dt", "end_value"])

    @cached_property
    def resolved_strokes(self) -> DataFrame:
        """Stable strokes from the known start on."""
        return self.strokes.where("layer = 'stable'")

    @cached_property
    def unfinished_strokes(self) -> DataFrame:
        """Strokes behind the last detected segment."""
        at = self._kind("state").select(*K, F.col("at_pos").alias("__from"))
        return self.strokes.join(at, K).where("pos >= __from").drop("__from")

    @cached_property
    def stroke_zones(self) -> DataFrame:
        """Zones of the resolved strokes."""
        s = self.resolved_strokes
        return zones.stroke_zones(s if self.trusted else zones.behind_first_group(s))

    @cached_property
    def unresolved_stroke_zones(self) -> DataFrame:
        """The first group's zone where the start is not trusted."""
        return zones.stroke_zones(self.resolved_strokes).where("group = 0" if not self.trusted else "false")

    @cached_property
    def stroke_zone_candidates(self) -> DataFrame:
        return zones.stroke_zones(self.strokes)

    def formal_zones(self, segments: DataFrame) -> DataFrame:
        return zones.segment_zones(segments if self.trusted else zones.behind_first_zone(segments))

    @cached_property
    def segment_zones(self) -> DataFrame:
        return self.formal_zones(self.segments)

    @cached_property
    def unresolved_segment_zones(self) -> DataFrame:
        return zones.segment_zones(self.segments).where("zone = 0" if not self.trusted else "false")

    @cached_property
    def segment_zone_candidates(self) -> DataFrame:
        return zones.zone_candidates(self.detected_segments, self.segment_zones)

    @cached_property
    def _fine_macd_anchors(self) -> DataFrame | None:
        if self.macd_anchors is None:
            return None
        return self.macd_anchors.join(validators.macd_anchor_issues(self.macd_anchors, self.bars).select(*K).distinct(), K, "left_anti")

    @cached_property
    def _timed_macd(self) -> DataFrame:
        return structure.macd(self.positioned, self._fine_macd_anchors, keep=("open_time",))

    @cached_property
    def macd(self) -> DataFrame:
        return self._timed_macd.drop("open_time")

    @cached_property
    def exact(self) -> DataFrame:
        """MACD is exact where no bar is missing and the start is trusted or continues an exact anchor. A
        gapped series is reported here and never fails the analysis."""
        runs = B.continuity(self.bars).select(*K, "continuous")
        if self._fine_macd_anchors is None:
            return runs.select(*K, (F.col("continuous") & F.lit(self.trusted)).alias("exact"))
        known = runs.join(self._fine_macd_anchors.select(*K, F.col("exact").alias("__e")), K, "left")
        return known.select(*K, (F.col("continuous") & (F.lit(self.trusted) | F.coalesce("__e", F.lit(False)))).alias("exact"))

    @cached_property
    def macd_anchor(self) -> DataFrame:
        """Where to go on from: the state behind the last bar of each key."""
        b = self.positioned
        last = structure.macd_anchor(self.macd, b).join(self.exact, K)
        return last.withColumn("expected_next_open", next_open_time(F.col("open_time"), F.col("interval")))

    @cached_property
    def areas(self) -> DataFrame:
        return structure.directional_area(self.segments.withColumnRenamed("pos", "idx"), self._timed_macd).withColumnRenamed("idx", "pos")

    @cached_property
    def gated_segments(self) -> DataFrame:
        """Committed segments of the keys whose structure and provenance hold."""
        bad = points.structure_issues(self.segments, self.strokes).select(*K).unionByName(points.provenance_issues(self.segments, self.evidence).select(*K)).distinct()
        return self.segments.join(bad, K, "left_anti").persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def judged(self) -> DataFrame:
        s = self.gated_segments
        return points.candidates(s, self.formal_zones(s), self.areas, self.exact, s.select(*K, "pos", "committed_at"))

    @cached_property
    def trading_points(self) -> DataFrame:
        return points.points(self.judged)

    @cached_property
    def divergences(self) -> DataFrame:
        s = self.gated_segments
        return points.divergences(points.trend_pairs(self.formal_zones(s)), s, self.areas, self.exact)

    @cached_property
    def projected_stroke(self) -> DataFrame:
        return live.next_stroke(self.strokes, self.merged)

    @cached_property
    def projected_segment(self) -> DataFrame:
        return live.next_segment(self.segments, self.strokes, self.unfinished_strokes, self.projected_stroke)


@dataclass(frozen=True)
class LiveAnalysis:
    """Two layers: what closed bars confirm, and what the current bar would make of it."""

    confirmed: Analysis
    live: Analysis
    signature: tuple

    @cached_property
    def provisional_strokes(self) -> DataFrame:
        """Live strokes outside of the formal block, and the next one as far as it goes."""
        return live.provisional_lines(self.confirmed.resolved_strokes, self.live.strokes, self.live.projected_stroke)

    @cached_property
    def provisional_segments(self) -> DataFrame:
        a = self.live
        ahead = live.next_segment(a.segments, a.strokes, a.unfinished_strokes, self.provisional_strokes)
        return live.provisional_lines(self.confirmed.segments, a.detected_segments, ahead)


def analyze_snapshot(snap: DataFrame, least: int = MIN_BARS, trusted: bool = False, anchors: dict | None = None, previous: LiveAnalysis | None = None) -> LiveAnalysis:
    """Analyses of a snapshot's closed bars and of all its bars (``is_closed`` tells them apart). The first
    is taken over from ``previous`` if closed bars and settings are the same, so that a refresh of the
    current bar costs one analysis."""
    columns = [c for c in snap.columns if c != "is_closed"]
    closed = snap.where("is_closed").select(*columns)
    mark = closed.select(F.xxhash64(B.fingerprint()).alias("h")).agg(F.count("*"), F.bit_xor("h")).first()
    signature = (tuple(mark), least, trusted, repr(anchors))
    confirmed = previous.confirmed if previous is not None and previous.signature == signature else Analysis(closed, least, trusted, anchors)
    return LiveAnalysis(confirmed, Analysis(B.all_bars(snap).select(*columns), least, trusted, anchors), signature)


def analyze(bars: DataFrame, least: int = MIN_BARS, trusted: bool = False, anchors: dict | None = None, macd_anchors: DataFrame | None = None) -> Analysis:
    return Analysis(bars, least, trusted, anchors, macd_anchors)
