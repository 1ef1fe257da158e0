"""Segments of a live feed: the last bar may still be revised, idle keys make room and come back from anchors.

Structured Streaming's arbitrary state (``transformWithState``) holds one ``Tracker`` a key. It keeps the
machine as it stood before the last bar, and that bar. A newer bar settles the last one; a bar with its open time takes
its place, and the machine goes on from where it stood before; an older one is turned away. So a revision
costs one bar and no history, whatever the length of the series.

What the last bar commits is shown at once and taken back by a row of kind ``retracted`` if a revision does
not bear it out: the segments of a key at any time are its rows of kind ``segment`` without those retracted.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import KEYS
from ..operators.inclusion import Bar
from ..operators.segment_machine import Ledger
from ..operators.stroke_machine import MIN_BARS, StrokeMachine

FIELDS = ["t", "t_end", "open", "high", "low", "close", "volume", "quote_volume"]
OUT = (
    "symbol string, interval string, kind string, idx long, direction string, start_dt long, start_value double, end_dt long, end_value double, "
    "confirmation string, committed_at long, anchor binary"
)
ANCHORS = "symbol string, interval string, anchor binary, anchor_t long, anchor_value double, anchor_mark string"
NAMES = [c.split()[0] for c in OUT.split(", ")]


class Tracker:
    """One key's feed, free of Spark: ``feed`` takes rows of ``FIELDS`` in order of arrival and gives output
    rows without the key. With ``hold`` nothing of the last bar is shown before it is settled."""

    def __init__(self, least: int = MIN_BARS, trusted: bool = True, hold: bool = False, anchor: tuple | None = None):
        self.ledger, self.hold = Ledger(StrokeMachine(least), trusted, anchor), hold
        self.n = 0
        self.last: tuple | None = None
        self.shown: list[tuple] = []

    def feed(self, rows: Iterable[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for r in rows:
            if self.last is None or r[0] > self.last[0]:
                if self.last is not None:
                    self._show(self._push(self.ledger), out)
                    self.n += 1
                    self.shown = []
                self.last = r
            elif r[0] < self.last[0]:
                out.append(self._about("late", r))
            elif r != self.last:
                out.append(self._about("revised", r))
                self.last = r
        if self.last is not None and not self.hold:
            self._show(self._push(pickle.loads(pickle.dumps(self.ledger))), out)
        return out

    @staticmethod
    def _about(kind: str, r: tuple) -> tuple:
        return (kind, -1, None, r[0], None, r[1], r[5], None, None, None)

    def _push(self, ledger: Ledger) -> list[tuple]:
        before, rows = ledger.count, []
        for k, c in enumerate(ledger.push(Bar(self.n, *self.last))):
            a, b = c.strokes[0].a, c.strokes[-1].b
            rows.append((before + k, c.strokes[0].direction, a.t, a.value, b.t, b.value, c.outcome.confirmation, c.committed_at))
        ledger.machine.notes.clear()
        ledger.notes.clear()
        return rows

    def _show(self, rows: list[tuple], out: list[tuple]) -> None:
        """Bring what is shown of the last bar to ``rows``, the latest segments first where they go."""
        out += [("retracted", *r, None) for r in reversed(self.shown) if r not in rows]
        out += [("segment", *r, None) for r in rows if r not in self.shown]
        self.shown = rows


class _Keeper(StatefulProcessor):
    def __init__(self, least: int, trusted: bool, hold: bool, idle_ms: int | None):
        self.settings, self.idle_ms = (least, trusted, hold), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tracker", "blob binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A row with ``anchor`` continues where an idle key left off; one with ``anchor_t`` and ``anchor_value``
        begins a series of which that endpoint is known to be final."""
        row = initialState.iloc[-1]
        if row["anchor"] is not None:
            self.state.update((bytes(row["anchor"]),))
        elif pd.notna(row["anchor_t"]):
            least, _, hold = self.settings
            self.state.update((pickle.dumps(Tracker(least, False, hold, (int(row["anchor_t"]), float(row["anchor_value"]), row["anchor_mark"]))),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else Tracker(*self.settings)
        fed = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        out = tracker.feed(fed[FIELDS].itertuples(index=False, name=None))
        self.state.update((pickle.dumps(tracker),))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(tracker.last[1] // 1000 + self.idle_ms)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """An idle key's state leaves as its anchor."""
        blob = bytes(self.state.get()[0])
        self.state.clear()
        yield self._frame(key, [("anchor", -1, *[None] * 7, blob)])

    @staticmethod
    def _frame(key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=NAMES)

    def close(self) -> None:
        pass


def live_segments(
    bars: DataFrame, least: int = MIN_BARS, trusted: bool = True, arrival: str | None = None, hold: bool = False, idle: str | None = None,
    anchors: DataFrame | None = None,
) -> DataFrame:
    """Rows of kind ``segment``, ``retracted``, ``revised``, ``late`` and ``anchor`` from a stream (or table) of bars.

    Rows of a batch are taken in order of ``arrival`` (by default of their open time). With ``idle``
    (a duration) a key is given up once the watermark, which follows ``close_time`` that far behind, has passed its last
    bar by as much again; its state leaves as a row of kind ``anchor``. ``anchors`` (key, ``anchor``; or ``anchor_t``, ``anchor_value``,
    ``anchor_mark`` of a final endpoint) is the state that a new query starts from, one row a key. Rows behind the
    watermark are dropped by the engine before they could be called late.

    The session's state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    order = F.col(arrival) if arrival else us("open_time")
    fed = bars
    if idle:
        fed = fed.withColumn("close_time", F.col("close_time").cast("timestamp")).withWatermark("close_time", idle)
    columns = [*KEYS, us("open_time").alias("t"), us("close_time").alias("t_end"), *FIELDS[2:], order.alias("arrival")]
    fed = fed.select(*columns, *(["close_time"] if idle else []))
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    start = None
    if anchors is not None:
        there = {c.split()[0]: c.split()[1] for c in ANCHORS.split(", ")}
        start = anchors.select(*[F.col(c).cast(kind) if c in anchors.columns else F.lit(None).cast(kind).alias(c) for c, kind in there.items()]).groupBy(*KEYS)
    return fed.groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=_Keeper(least, trusted, hold, idle_ms), outputStructType=OUT, outputMode="append", timeMode="EventTime" if idle else "None", initialState=start
    )


def net_segments(rows: DataFrame) -> DataFrame:
    """What stands of a log of ``live_segments``: segments that were not taken back."""
    columns = [*KEYS, "idx", "direction", "start_dt", "start_value", "end_dt", "end_value", "confirmation", "committed_at"]
    sign = F.when(F.col("kind") == "segment", 1).when(F.col("kind") == "retracted", -1)
    return rows.where(sign.isNotNull()).groupBy(*columns).agg(F.sum(sign).alias("n")).where("n > 0").drop("n")
