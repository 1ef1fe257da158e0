"""Inclusion removal: the sequential core, free of Spark."""

from __future__ import annotations

from typing import NamedTuple


class Bar(NamedTuple):
    """A raw bar as the folds see it; times are microseconds."""

    pos: int
    t: int
    t_end: int
    open: float
    high: float
    low: float
    close: float
    volume: float
    quote: float


class Merged(NamedTuple):
    """A bar after inclusion removal; ``t`` is the time that stands for it."""

    t: int
    open: float
    high: float
    low: float
    close: float
    volume: float
    quote: float
    count: int
    first_pos: int
    last_pos: int
    first_t: int
    last_t: int
    known_at: int  # when the last member closed


def single(b: Bar) -> Merged:
    return Merged(b.t, b.open, b.high, b.low, b.close, b.volume, b.quote, 1, b.pos, b.pos, b.t, b.t, b.t_end)


def absorb(before: Merged, last: Merged, b: Bar) -> Merged | None:
    """``last`` with ``b`` merged in, or None if ``b`` stands on its own.

    The run from ``before`` to ``last`` gives the direction; equal highs give none, and without one
    nothing is merged. Ties count as inclusion.
    """
    if before.high == last.high:
        return None
    inside = b.high <= last.high and b.low >= last.low
    around = b.high >= last.high and b.low <= last.low
    if not (inside or around):
        return None
    if before.high < last.high:
        keep = last.high > b.high
        high, low = max(last.high, b.high), max(last.low, b.low)
    else:
        keep = last.low < b.low
        high, low = min(last.high, b.high), min(last.low, b.low)
    o, c = (high, low) if b.open > b.close else (low, high)
    return Merged(
        last.t if keep else b.t, o, high, low, c, last.volume + b.volume, last.quote + b.quote, last.count + 1,
        last.first_pos, b.pos, last.first_t, b.t, max(last.known_at, b.t_end),
    )


class InclusionFold:
    """Feeds on bars in order and hands out merged bars once no later bar can change them."""

    def __init__(self) -> None:
        self.before: Merged | None = None
        self.last: Merged | None = None

    def push(self, b: Bar) -> Merged | None:
        done = None
        if self.last is None:
            self.last = single(b)
        else:
            joined = absorb(self.before, self.last, b) if self.before is not None else None
            if joined is not None:
                self.last = joined
            else:
                done = self.before
                self.before, self.last = self.last, single(b)
        return done

    def finish(self) -> list[Merged]:
        return [m for m in (self.before, self.last) if m is not None]
