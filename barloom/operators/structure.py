"""Merged bars, fractals, MACD and the one fold that yields strokes and segments of every key."""

from __future__ import annotations

import hashlib
from math import ceil, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import segment_machine as seg
from .folds import KEYS, keyed_fold, micros, times
from .inclusion import Bar, InclusionFold, Merged
from .stroke_machine import MIN_BARS, Stroke, StrokeMachine

FEED = ["pos", "t", "t_end", "open", "high", "low", "close", "volume", "quote_volume"]


def feed(bars: DataFrame) -> DataFrame:
    """Bars (with ``pos``) in the form that folds take."""
    return bars.withColumns({"t": micros("open_time"), "t_end": micros("close_time")})


def kind_of_time(bars: DataFrame) -> str:
    return dict(bars.dtypes)["open_time"]


class _Merge:
    def __init__(self) -> None:
        self.fold, self.n = InclusionFold(), 0

    def _row(self, m: Merged) -> tuple:
        self.n += 1
        return (self.n - 1, *m)

    def push(self, row: tuple) -> list[tuple]:
        m = self.fold.push(Bar(*row))
        return [self._row(m)] if m is not None else []

    def finish(self) -> list[tuple]:
        return [self._row(m) for m in self.fold.finish()]


def merged_bars(bars: DataFrame) -> DataFrame:
    """Bars without inclusion, ``mpos`` 0, 1, … per key."""
    out = keyed_fold(
        feed(bars), FEED, ["pos"], lambda key: _Merge(),
        "mpos long, dt long, open double, high double, low double, close double, volume double, quote_volume double, raw_count long, "
        "first_pos long, last_pos long, first_dt long, last_dt long, known_at long",
    )
    return times(out, ["dt", "first_dt", "last_dt", "known_at"], kind_of_time(bars))


def raw_fractals(merged: DataFrame) -> DataFrame:
    """Strict three-bar extremes of merged bars: both high and low beyond both neighbours'."""
    w = Window.partitionBy(*KEYS).orderBy("mpos")
    before, after = F.lag(F.struct("high", "low", "first_dt")).over(w), F.lead(F.struct("high", "low", "last_dt")).over(w)
    top = (F.col("high") > before["high"]) & (F.col("high") > after["high"]) & (F.col("low") > before["low"]) & (F.col("low") > after["low"])
    bottom = (F.col("high") < before["high"]) & (F.col("high") < after["high"]) & (F.col("low") < before["low"]) & (F.col("low") < after["low"])
    return (
        merged.withColumns({"mark": F.when(top, "G").when(bottom, "D"), "source_start": before["first_dt"], "source_end": after["last_dt"]})
        .where("mark IS NOT NULL")
        .select(*KEYS, "mpos", "dt", "mark", "high", "low", F.when(F.col("mark") == "G", F.col("high")).otherwise(F.col("low")).alias("value"), "source_start", "source_end")
    )


def fractals(merged: DataFrame) -> DataFrame:
    """Raw fractals after the alternation rule: from the third on, one with the mark of the last kept
    one is dropped. A dropped one has that mark too, so the previous row tells enough."""
    w = Window.partitionBy(*KEYS).orderBy("mpos")
    rows = raw_fractals(merged).withColumns({"__n": F.row_number().over(w), "__m": F.lag("mark").over(w)})
    return rows.where((F.col("__n") <= 2) | (F.col("mark") != F.col("__m"))).drop("__n", "__m")


FAST, SLOW, SIGNAL = 2 / 13, 2 / 27, 2 / 10
#: Bars of a block of the scan.
BLOCK = 512


def macd(bars: DataFrame, anchors: DataFrame | None = None, keep: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """12/26/9 MACD of each key: ``pos`` (whole numbers without a gap), the columns in ``keep``, ``ema_fast, ema_slow, dea, hist``. The first
    close seeds both averages, unless ``anchors`` (key, ema_fast, ema_slow, dea; one row a key) continue an
    earlier series.

    A scan by blocks, so that one series spreads over tasks. Each average is linear in the state that a block starts
    with: inside a block it is a running sum of closes scaled by powers of the decay. A block's own
    contribution is one row; the state that it starts with is the sum of the contributions of the blocks before it, decayed, of
    which those beyond ``reach`` vanish in a double. Only these rows, one a block, meet by key.
    """
    if not 16 <= block <= 2048:  # powers of the decays stay within doubles, and reach is short
        raise ValueError("a block has 16 to 2048 bars")
    k = list(KEYS)
    qf, qs, qd = 1 - FAST, 1 - SLOW, 1 - SIGNAL
    reach = ceil(64 * log(2) / (block * -log(qs)))
    power = lambda q, n: F.pow(F.lit(q), n)
    slim = bars.select(*k, "pos", *keep, F.col("close").cast("double").alias("close")).withColumns({"__block": F.floor(F.col("pos") / block), "__i": (F.col("pos") % block).cast("double")})
    inside = Window.partitionBy(*k, "__block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # What the closes of the block so far give; the decayed start comes on top.
    ema = lambda a, q: F.lit(a) * power(q, F.col("__i")) * F.sum(F.col("close") * power(q, -F.col("__i"))).over(inside)
    rows = slim.withColumns({"__f": ema(FAST, qf), "__s": ema(SLOW, qs)})
    n = F.col("__n").cast("double")
    sums = rows.groupBy(*k, "__block").agg(
        F.count("*").alias("__n"), F.min("__i").alias("__i0"), F.max_by("__f", "pos").alias("__f"), F.max_by("__s", "pos").alias("__s"), F.min_by("close", "pos").alias("__c"),
        F.sum((F.col("__f") - F.col("__s")) * power(qd, -F.col("__i"))).alias("__d"),
    )
    sums = sums.withColumn("__d", F.lit(SIGNAL) * power(qd, F.col("__i0") + n - 1) * F.col("__d"))
    by_key = Window.partitionBy(*k).orderBy("__block")
    sums = sums.withColumns({"__k": (F.row_number().over(by_key) - 1).cast("double"), "__n0": F.first("__n").over(by_key)})
    first = F.col("__k") == 0
    if anchors is not None:
        sums = sums.join(anchors.select(*k, *[F.col(c).alias(f"__{c}") for c in ("ema_fast", "ema_slow", "dea")]), k, "left")
    else:
        sums = sums.withColumns(dict.fromkeys(("__ema_fast", "__ema_slow", "__dea"), F.lit(None).cast("double")))
    sums = sums.withColumns({
        "__seeded": first & F.col("__ema_fast").isNull(), "__f0": F.when(first, F.coalesce("__ema_fast", "__c")), "__s0": F.when(first, F.coalesce("__ema_slow", "__c")),
        "__d0": F.when(first, F.coalesce("__dea", F.lit(0.0))),
    })

    def at_start(own: str, zero: str, q: float):
        """The state that a block starts with; all blocks before it but the first are full."""
        before = [F.coalesce(F.lag(own, j + 1).over(by_key), F.lit(0.0)) * q ** (block * j) for j in range(reach)]
        since = F.when(first, 0.0).otherwise(F.col("__n0") + (F.col("__k") - 1) * block)
        seen = F.first(zero).over(by_key) * power(q, since)
        return sum(before[1:], before[0]) + F.when(F.col("__k") <= reach + 1, seen).otherwise(0.0)

    sums = sums.withColumns({"__fin": at_start("__f", "__f0", qf), "__sin": at_start("__s", "__s0", qs)})
    response = lambda q: F.lit(SIGNAL * q / (q - qd)) * (power(q, n) - power(qd, n))
    sums = sums.withColumn("__g", F.col("__d") + response(qf) * F.col("__fin") - response(qs) * F.col("__sin"))
    starts = sums.withColumn("__din", at_start("__g", "__d0", qd)).select(*k, "__block", "__fin", "__sin", "__din", "__seeded", "__i0")
    full = rows.join(starts.hint("merge"), [*k, "__block"])
    seeded = F.col("__seeded") & (F.col("__i") == F.col("__i0"))  # the seeding close itself, free of rounding
    step = F.col("__i") - F.col("__i0") + 1
    full = full.withColumns({
        "ema_fast": F.when(seeded, F.col("close")).otherwise(power(qf, step) * F.col("__fin") + F.col("__f")),
        "ema_slow": F.when(seeded, F.col("close")).otherwise(power(qs, step) * F.col("__sin") + F.col("__s")),
    }).withColumn("__dif", F.col("ema_fast") - F.col("ema_slow"))
    dea = power(qd, step) * F.col("__din") + F.lit(SIGNAL) * power(qd, F.col("__i")) * F.sum(F.col("__dif") * power(qd, -F.col("__i"))).over(inside)
    full = full.withColumn("dea", F.when(seeded, F.lit(0.0)).otherwise(dea))
    return full.select(*k, "pos", *keep, "ema_fast", "ema_slow", "dea", (2.0 * (F.col("__dif") - F.col("dea"))).alias("hist"))


def macd_anchor(values: DataFrame, bars: DataFrame) -> DataFrame:
    """The state behind the last bar of each key, to continue from."""
    rows = values.join(bars.select(*KEYS, "pos", "open_time", "close_time"), [*KEYS, "pos"])
    last = rows.groupBy(*KEYS).agg(F.max_by(F.struct("open_time", "close_time", "ema_fast", "ema_slow", "dea", "pos"), "pos").alias("s"))
    return last.select(*KEYS, "s.open_time", "s.close_time", "s.ema_fast", "s.ema_slow", "s.dea", (F.col("s.pos") + 1).alias("processed_bar_count"))


#: Histogram values are summed as decimals, since differences of long running sums of doubles lose digits.
AREA_KIND, TOTAL_KIND = "decimal(24,12)", "decimal(34,12)"


def directional_area(units: DataFrame, hist: DataFrame) -> DataFrame:
    """Area of the histogram on a unit's side of zero over ``[source_start, source_end]``.

    ``units``: key, idx, direction, source_start, source_end. Both ends of a unit look up the running sums of
    either side, and the area is their difference: what is moved are the bars and two rows a unit,
    however long the units. Running sums are taken within days, and over one row a day from day to day, so a
    long series spreads over days.
    """
    k = list(KEYS)
    zero = F.lit(0).cast(AREA_KIND)
    h = F.col("hist").cast(AREA_KIND)
    none = F.lit(None)
    bars = hist.select(*k, F.col("open_time").alias("__t"), F.lit(1).alias("__what"), none.cast("long").alias("idx"), F.when(h > 0, h).otherwise(zero).alias("__up"), F.when(h < 0, -h).otherwise(zero).alias("__down"))
    # At one time the start of a unit stands before the bar, which it counts, and the end behind it.
    ends = F.inline(F.array(F.struct(F.col("source_start").alias("__t"), F.lit(0).alias("__what")), F.struct(F.col("source_end").alias("__t"), F.lit(2).alias("__what"))))
    points = units.select(*k, F.col("idx").cast("long").alias("idx"), ends).select(*k, "__t", "__what", "idx", zero.alias("__up"), zero.alias("__down"))
    rows = bars.unionByName(points).withColumn("__day", F.floor(F.unix_seconds(F.col("__t").cast("timestamp")) / 86400))
    upto = Window.partitionBy(*k, "__day").orderBy("__t", "__what").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumns({"__u": F.sum("__up").over(upto), "__v": F.sum("__down").over(upto)}).where("__what <> 1")
    before = Window.partitionBy(*k).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*k, "__day").agg(F.sum("__up").alias("__du"), F.sum("__down").alias("__dv"))
    days = days.select(*k, "__day", *[F.coalesce(F.sum(c).over(before), zero).cast(TOTAL_KIND).alias(c) for c in ("__du", "__dv")])
    signed = lambda c: F.when(F.col("__what") == 2, c).otherwise(-c)
    found = at.join(days.hint("merge"), [*k, "__day"]).groupBy(*k, "idx").agg(F.sum(signed(F.col("__u") + F.col("__du"))).alias("__up"), F.sum(signed(F.col("__v") + F.col("__dv"))).alias("__down"))
    side = F.when(F.col("direction") == "up", F.col("__up")).when(F.col("direction") == "down", F.col("__down"))
    area = F.greatest(F.coalesce(side, zero), zero).cast("double")  # a unit that ends before it starts has none
    return units.select(*k, "idx", "direction").join(found, [*k, "idx"], "left").select(*k, "idx", area.alias("area"))


EVENTS = (
    "kind string, idx long, layer string, direction string, start_pos long, end_pos long, start_dt long, end_dt long, start_value double, "
    "end_value double, high double, low double, size long, source_start long, source_end long, known_at long, committed_at long, committed_pos long, "
    "code string, gap boolean, moved boolean, left_pos array<long>, middle_pos array<long>, right_pos array<long>, at_pos long, fingerprint string, "
    "origin_pos long, origin_at long, broken boolean, reverse boolean, primary_gap boolean"
)
_WIDTH = len(EVENTS.split(", "))
_NAMES = [c.split()[0] for c in EVENTS.split(", ")]


def _event(**v) -> tuple:
    return tuple(v.get(n) for n in _NAMES)


def stroke_print(key: tuple, s: Stroke) -> str:
    text = "|".join(map(repr, (*key, s.direction, s.a.t, s.a.value, s.b.t, s.b.value, s.high, s.low)))
    return hashlib.sha256(text.encode()).hexdigest()


class _Structure:
    """All structure of one key; committed segments leave as soon as they are final."""

    def __init__(self, key: tuple, least: int, trusted: bool, anchor: tuple | None):
        self.key = key
        self.ledger = seg.Ledger(StrokeMachine(least), trusted, anchor, collect=True)
        self.n = 0

    def push(self, row: tuple) -> list[tuple]:
        out = []
        for c in self.ledger.push(Bar(*row)):
            out += self._segment("committed", self.n, c.outcome, list(c.strokes), c.confirm_stroke, c)
            self.n += 1
        return out

    def _segment(self, layer: str, idx: int, o: seg.Outcome, strokes: list[Stroke], confirm: Stroke, c: seg.Committed | None) -> list[tuple]:
        a, b = strokes[0].a, strokes[-1].b
        prints = [stroke_print(self.key, s) for s in strokes]
        f = o.primary
        origin = o.gap_origin or f
        waits = [t for t, _ in o.audit if (t.origin, t.direction) == (o.start, strokes[0].direction)] if c and o.confirmation == seg.GAP_REVERSE else []
        seen = [x for x in (waits[-1].candidates if waits else []) if x.at <= o.at]
        return [
            *[_event(kind="candidate", idx=idx, layer=layer, direction=x.direction, code=x.status, end_pos=x.endpoint, end_value=x.value, gap=x.gap, at_pos=x.at) for x in seen],
            _event(
                kind="segment", idx=idx, layer=layer, direction=strokes[0].direction, start_pos=o.start, end_pos=o.end, start_dt=a.t, end_dt=b.t,
                start_value=a.value, end_value=b.value, high=max(s.high for s in strokes), low=min(s.low for s in strokes), size=len(strokes),
                source_start=strokes[0].source_start, source_end=strokes[-1].source_end, known_at=confirm.known_at,
                committed_at=c.committed_at if c else None, committed_pos=c.committed_pos if c else None, code=o.confirmation,
                gap=(o.gap_origin or f).gap, moved=o.gap_origin is not None and o.gap_origin.endpoint != o.end, left_pos=list(f.left.positions),
                middle_pos=list(f.middle.positions), right_pos=list(f.right.positions), at_pos=o.at,
                fingerprint=hashlib.sha256("|".join(prints).encode()).hexdigest(),
                origin_pos=origin.endpoint, origin_at=origin.at, broken=f.status == seg.CONFIRMED, reverse=o.reverse is not None, primary_gap=f.gap,
            ),
        ]

    def finish(self) -> list[tuple]:
        led = self.ledger
        chain, stable = led.chain(), led.stable_total
        first = led.resolved_from or 0
        out = []
        for i, s in enumerate(chain):
            layer = "provisional" if i >= stable else "left_unresolved" if i < first else "stable"
            out.append(
                _event(
                    kind="stroke", idx=i, layer=layer, direction=s.direction, start_dt=s.a.t, end_dt=s.b.t, start_value=s.a.value, end_value=s.b.value,
                    high=s.high, low=s.low, size=s.size, source_start=s.source_start, source_end=s.source_end,
                    known_at=s.known_at, fingerprint=stroke_print(self.key, s),
                )
            )
        found = seg.detect(chain)
        for i, o in enumerate(found.segments):
            out += self._segment("detected", i, o, chain[o.start : o.end], chain[o.at], None)
        best: dict[tuple, seg.Element] = {}
        seen: dict[tuple, seg.Feature] = {}
        for o in found.scans:
            for t, e in seg.elements_of(o):
                k = (t.origin, t.direction, e.number)
                if k not in best or len(e.positions) >= len(best[k].positions):
                    best[k] = e
            for f in seg.features_of(o):
                seen.setdefault(f.signature, f)
        for (origin, direction, number), e in sorted(best.items()):
            out.append(_event(kind="element", idx=number, direction=direction, start_pos=origin, code=e.merge, high=e.high, low=e.low, middle_pos=list(e.positions)))
        for i, f in enumerate(sorted(seen.values(), key=lambda f: (f.at, f.endpoint, f.direction))):
            out.append(
                _event(
                    kind="feature", idx=i, direction=f.direction, code=f.status, end_pos=f.endpoint, end_dt=chain[f.endpoint].a.t, end_value=f.value, gap=f.gap,
                    left_pos=list(f.left.positions), middle_pos=list(f.middle.positions), right_pos=list(f.right.positions), at_pos=f.at,
                )
            )
        for i, (code, t) in enumerate(led.machine.notes):
            out.append(_event(kind="note", idx=i, layer="stroke", code=code, end_dt=t))
        for i, (code, p) in enumerate(dict.fromkeys(found.notes)):
            out.append(_event(kind="note", idx=i, layer="segment", code=code, at_pos=p))
        for i, (code, t) in enumerate(led.notes):
            out.append(_event(kind="note", idx=i, layer="ledger", code=code, end_dt=t))
        out.append(_event(kind="state", idx=0, start_pos=led.resolved_from, end_pos=stable, size=len(chain), at_pos=found.unfinished_from, code=str(led.machine.open_bars)))
        return out


def structure(bars: DataFrame, least: int = MIN_BARS, trusted: bool = False, anchors: dict[tuple[str, str], tuple] | None = None) -> DataFrame:
    """One pass over each key's bars: strokes, detected and committed segments, feature elements and
    fractals, notes and the closing state, told apart by ``kind`` and ``layer``.

    ``trusted``: the series begins where history does. ``anchors``: a few known final endpoints
    (microseconds, value, mark or None) by key.
    """
    anchors = anchors or {}
    out = keyed_fold(feed(bars), FEED, ["pos"], lambda key: _Structure(key, least, trusted, anchors.get(key)), EVENTS)
    return times(out, ["start_dt", "end_dt", "source_start", "source_end", "known_at", "committed_at"], kind_of_time(bars))
