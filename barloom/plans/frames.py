"""Report frames: the layers of an analysis with labels and joined lists, ready to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import legacy_segments, zones
from ..operators.folds import KEYS
from .analysis import Analysis

K = list(KEYS)


def joined(c: str) -> Column:
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), " | ").alias(c)


def label(c: str) -> Column:
    """Readable names for directions, marks and layers."""
    names = {"up": "up", "down": "down", "G": "top", "D": "bottom", "stable": "STABLE", "provisional": "PROVISIONAL", "left_unresolved": "LEFT_UNRESOLVED"}
    out = F.col(c)
    for k, v in names.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out.alias(c)


def power() -> list[Column]:
    """Move of a unit, rounded half to even as reports do."""
    move = F.col("end_value") - F.col("start_value")
    return [F.bround(F.abs(move), 2).alias("power"), F.when(F.col("start_value") == 0, 0.0).otherwise(F.bround(move / F.col("start_value"), 4)).alias("change")]


def frames(a: Analysis) -> dict[str, DataFrame]:
    """All frames of an analysis by name; nothing runs before one is read."""
    seg = a.segments.join(a.evidence.select(*K, "pos", "confirmation", "gap", "moved", "confirmed_at_pos"), [*K, "pos"], "left")
    inner = a.merged.select(*K, "mpos", "raw_count")
    fr = a.fractals
    for k in (-1, 0, 1):
        fr = fr.join(inner.select(*K, (F.col("mpos") - k).alias("mpos"), F.col("raw_count").alias(f"r{k + 1}")), [*K, "mpos"], "left")
    last = a.strokes.groupBy(*K).agg(F.max("end_dt").alias("last_end"))
    return {
        "bars": a.positioned,
        "merged": a.merged,
        "fractals": fr.withColumn("raw_count", F.col("r0") + F.col("r1") + F.col("r2")).drop("r0", "r1", "r2").withColumn("mark", label("mark")),
        "strokes": a.strokes.select(*K, "pos", label("layer"), label("direction"), "start_dt", "start_value", "end_dt", "end_value", "length", *power(), "source_start", "source_end"),
        "segments": seg.select(*K, "pos", label("direction"), "start_dt", "start_value", "end_dt", "end_value", "size", "confirmation", "gap", "moved", "confirmed_at_pos", *power(), "source_start", "source_end", "committed_at"),
        "segment_evidence": a.evidence.select(*[joined(c) if c in ("left_pos", "middle_pos", "right_pos") else F.col(c) for c in a.evidence.columns]),
        "feature_elements": a.feature_elements.select(*[joined(c) if c == "positions" else F.col(c) for c in a.feature_elements.columns]),
        "feature_fractals": a.feature_fractals.select(*[joined(c) if c in ("left_pos", "middle_pos", "right_pos") else F.col(c) for c in a.feature_fractals.columns]),
        "unresolved_prefix": a.segment_overlay.where("reason IN ('LEFT_PREFIX', 'UNRESOLVED_BOUNDARY')"),
        "unresolved_prefix_strokes": a.strokes.where("layer = 'left_unresolved'"),
        "unfinished_segment": a.unfinished_strokes,
        "unfinished_segments": a.segment_overlay.where("reason = 'RIGHT_TAIL'"),
        "unfinished_bars": a.merged.join(last, K, "left").where("last_end IS NULL OR dt > last_end").drop("last_end"),
        "stroke_zones": a.stroke_zones,
        "stroke_zone_groups": zones.stroke_zone_groups(a.strokes),
        "stroke_zone_candidates": a.stroke_zone_candidates,
        "segment_zones": a.segment_zones,
        "segment_zone_candidates": a.segment_zone_candidates,
        "trading_points": a.trading_points.select(*[joined(c) if c == "related" else F.col(c) for c in a.trading_points.columns]),
        "trading_point_candidates": a.judged.select(*[joined(c) if c == "related" else F.col(c) for c in a.judged.columns]),
        "trend_divergences": a.divergences,
        "segment_markers": legacy_segments.endpoints(a.segments).withColumn("mark", label("mark")),
        "diagnostics": a.diagnostics,
        "projected_strokes": a.projected_stroke,
        "projected_segments": a.projected_segment,
    }


def write_frames(a: Analysis, path: str, names: list[str] | None = None, fmt: str = "parquet") -> None:
    """Write the named frames (all by default) below ``path``, partitioned by nothing: one folder each."""
    for name, df in frames(a).items():
        if names is None or name in names:
            flat = df if fmt == "parquet" else df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
            flat.write.mode("overwrite").option("header", "true").format(fmt).save(f"{path}/{name}")


def provenance(source: str, market: str, note: str = "", is_demo: bool = False) -> Column:
    """A one-line header naming where bars came from."""
    return F.lit(f"{'DEMO DATA - ' if is_demo else ''}{source} / {market}{': ' + note if note else ''}")
