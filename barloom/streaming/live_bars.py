"""Structured Streaming: closed bars from ticks, and structure kept per key from bar to bar."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bars import resample
from ..operators.folds import KEYS
from ..operators.inclusion import Bar
from ..operators.segment_machine import Ledger
from ..operators.stroke_machine import MIN_BARS, StrokeMachine


def closed_bars(ticks: DataFrame, interval: str, symbol: Column, ts: str, price: str, tie: list[str], lateness: str = "10 minutes") -> DataFrame:
    """Bars from a stream of ticks. In append mode a bar leaves once the watermark passed its end, so
    it is closed and final; in update mode the current bar shows too."""
    timed = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return resample(timed, interval, symbol, ts, price, tie)


OUT = (
    "symbol string, interval string, kind string, idx long, direction string, start_dt long, start_value double, end_dt long, end_value double, "
    "confirmation string, committed_at long"
)


def committed_segments(bars: DataFrame, least: int = MIN_BARS, trusted: bool = True) -> DataFrame:
    """Segments as they become final, from a stream of bars: an append-only output.

    A key's machine is its state, restored from the checkpoint after a failure. Within a batch bars
    are put in order. The state holds the open part, the strokes behind the last committed end and
    a fixed number before it, so its size does not grow with the series. A bar not newer than the last one seen is turned away as a row of kind
    ``late`` and changes nothing.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ledger, seen, n = pickle.loads(state.get[0]) if state.exists else (Ledger(StrokeMachine(least), trusted), -1, 0)
        rows = []
        for r in pd.concat(list(parts)).sort_values("t").itertuples():
            if r.t <= seen:
                rows.append((*key, "late", -1, None, r.t, None, r.t_end, r.close, None, None))
                continue
            seen = r.t
            before = ledger.count
            for k, c in enumerate(ledger.push(Bar(n, r.t, r.t_end, r.open, r.high, r.low, r.close, r.volume, r.quote_volume))):
                a, b = c.strokes[0].a, c.strokes[-1].b
                rows.append((*key, "segment", before + k, c.strokes[0].direction, a.t, a.value, b.t, b.value, c.outcome.confirmation, c.committed_at))
            n += 1
            ledger.machine.notes.clear()
        state.update((pickle.dumps((ledger, seen, n)),))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    fed = bars.select(
        *KEYS, F.unix_micros(F.col("open_time").cast("timestamp")).alias("t"), F.unix_micros(F.col("close_time").cast("timestamp")).alias("t_end"),
        "open", "high", "low", "close", "volume", "quote_volume",
    )
    return fed.groupBy(*KEYS).applyInPandasWithState(step, OUT, "state binary", "append", GroupStateTimeout.NoTimeout)
