"""The calendar grid of an interval in plain Python, for sources that ask for bars before any is there."""

from __future__ import annotations

import datetime as dt
import re

from .intervals import UNIT_SECONDS

EPOCH = dt.datetime(1970, 1, 1)
#: Weeks open on Mondays; the epoch is a Thursday.
MONDAY_MS = 4 * 86_400_000


class Grid:
    """Places of bars, 0, 1, …: ``index`` of a time (milliseconds, UTC) and ``open_of`` a place. Months have their own
    length; all other intervals a fixed one from the epoch, weeks from the first Monday on."""

    def __init__(self, interval: str):
        m = re.match(r"([1-9][0-9]*)([smhdwM])\Z", interval)
        if m is None:
            raise ValueError(f"no interval: {interval}")
        self.n, self.unit = int(m[1]), m[2]
        self.step = self.n * UNIT_SECONDS[self.unit] * 1000
        self.origin = MONDAY_MS if self.unit == "w" else 0

    def index(self, ms: int) -> int:
        if self.unit == "M":
            t = EPOCH + dt.timedelta(milliseconds=ms)
            return ((t.year - 1970) * 12 + t.month - 1) // self.n
        return (ms - self.origin) // self.step

    def open_of(self, k: int) -> int:
        if self.unit == "M":
            year, month = divmod(k * self.n, 12)
            return (dt.datetime(1970 + year, month + 1, 1) - EPOCH) // dt.timedelta(milliseconds=1)
        return self.origin + k * self.step
