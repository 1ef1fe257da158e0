"""The stroke machine: alternating legs between fractals, with rollback, free of Spark.

All merged bars lie on one *tape* and all strict three-bar extremes on a list of *turns*; only the last
element of either may still change. Strokes are plain endpoints. What is not in a stroke yet is the
open part of the tape, told by where it begins: a new stroke moves that place ahead, and taking a stroke
back moves it to where the stroke began, with the search as it stood then. So no bar is looked
at twice, and what lies further back than ``MARGIN`` strokes is forgotten.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from .inclusion import Bar, Merged, absorb, single

TOP, BOTTOM = "G", "D"
UP, DOWN = "up", "down"
MIN_BARS = 7
#: Settled strokes that can be taken back before the machine starts anew where its memory ends.
MARGIN = 256
#: Passes over one bar after which something must be wrong.
PASSES = 100


class Fractal(NamedTuple):
    t: int
    mark: str
    high: float
    low: float

    @property
    def value(self) -> float:
        return self.high if self.mark == TOP else self.low

    @property
    def sign(self) -> int:
        """1 for a top, -1 for a bottom: seen with it, extremes are maxima."""
        return 1 if self.mark == TOP else -1

    @property
    def key(self) -> tuple:
        return self.t, self.mark, self.value, self.high, self.low


class Stroke(NamedTuple):
    a: Fractal
    b: Fractal
    size: int  # merged bars, both fractals' neighbours included
    source_start: int
    source_end: int
    known_at: int

    @property
    def direction(self) -> str:
        return UP if self.a.mark == BOTTOM else DOWN

    @property
    def high(self) -> float:
        return max(self.a.high, self.b.high)

    @property
    def low(self) -> float:
        return min(self.a.low, self.b.low)

    @property
    def key(self) -> tuple:
        return self.a.key, self.b.key


def extreme(before: Merged, bar: Merged, after: Merged) -> str | None:
    """The mark of a bar that stands out against both neighbours with high and low alike."""
    over = [(bar.high > x.high) + (bar.low > x.low) - (bar.high < x.high) - (bar.low < x.low) for x in (before, after)]
    return {4: TOP, -4: BOTTOM}.get(sum(over))


class Search(NamedTuple):
    """How far the turns behind the open part's first one have been looked at."""

    done: int  # turns before this one are counted in
    best: int | None = None  # the furthest opposite turn
    best_rival: int | None = None  # the turn that outdoes the start, of those before the furthest one
    rival: int | None = None  # and of all so far


@dataclass
class StrokeMachine:
    """All legs that the bars so far support; the last ones may be taken back.

    Turns keep a rule of their own: behind the first two of the open part, one with the mark of the
    turn before it does not count.
    """

    least: int = MIN_BARS
    margin: int = MARGIN
    tape: list[Merged] = field(default_factory=list)
    turns: list[tuple[int, Fractal]] = field(default_factory=list)  # place on the tape, fractal
    strokes: list[Stroke] = field(default_factory=list)
    first: int = 0  # strokes that were forgotten
    settled: int = 0  # strokes that the owner takes for final
    notes: list[tuple[str, int]] = field(default_factory=list)
    version: int = 0  # changes with every change of the strokes
    low: int = 0  # the least number of strokes since a reader set it
    _open: int = 0  # where the open part begins
    _head: int = 0  # its first turn
    _search: Search = Search(1)
    _back: list[tuple[int, int, Search]] = field(default_factory=list)  # the three above before each stroke
    _resume: bool = False  # every stroke was taken back: the start is known, only its leg is not
    _tape0: int = 0  # forgotten elements of the tape and of the turns
    _turn0: int = 0

    def __post_init__(self) -> None:
        if self.least < 3:
            raise ValueError("a stroke needs at least 3 bars")

    @property
    def total(self) -> int:
        return self.first + len(self.strokes)

    @property
    def open_bars(self) -> int:
        return self._end - self._open

    @property
    def _end(self) -> int:
        return self._tape0 + len(self.tape)

    def _turn(self, k: int) -> tuple[int, Fractal]:
        return self.turns[k - self._turn0]

    @property
    def _turns_end(self) -> int:
        return self._turn0 + len(self.turns)

    def push(self, bar: Bar) -> None:
        joined = absorb(self.tape[-2], self.tape[-1], bar) if self.open_bars >= 2 else None
        # On the tape a bar is known when all before it are.
        if joined is None:
            new = single(bar)
            self.tape.append(new._replace(known_at=max(new.known_at, self.tape[-1].known_at)) if self.tape else new)
        else:
            self.tape[-1] = joined
        middle = self._end - 2
        while self.turns and self.turns[-1][0] >= middle:
            self.turns.pop()
        if len(self.tape) >= 3 and (mark := extreme(*self.tape[-3:])):
            m = self.tape[-2]
            self.turns.append((middle, Fractal(m.t, mark, m.high, m.low)))
        for _ in range(PASSES):
            if self.open_bars < 3 or not self._again():
                self._forget()
                return
        raise RuntimeError(f"strokes did not settle after {PASSES} passes")

    def _again(self) -> bool:
        """One pass over the open part; whether another is due."""
        if not self.strokes and not self._resume:
            self._pick_start()
        found = self._leg()
        if not self.strokes:
            if found is not None:
                self._accept(*found[:2])
            again, self._resume = self._resume and found is not None, self._resume and found is None
            return again
        if found is not None:
            stroke, end, rival = found
            if rival is not None:
                self._take_back("SHARED_ENDPOINT_REPLACED", self._turn(rival)[1].t)
                return True
            self._accept(stroke, end)
        last, tip = self.strokes[-1].b, self.tape[-1]
        if (tip.high if last.mark == TOP else -tip.low) > last.sign * last.value:
            self._take_back("LAST_STROKE_INVALIDATED", tip.t)
        return False

    def _counts(self, k: int) -> bool:
        return k < self._head + 2 or self._turn(k)[1].mark != self._turn(k - 1)[1].mark

    def _pick_start(self) -> None:
        """Before the first stroke: its start is the furthest (of equals the last) turn of the first one's mark."""
        if self._head >= self._turns_end or self._turn(self._head)[0] >= self._end - 1:
            return
        start = self._head
        for k in range(self._search.done if self._search.done > start else start + 1, self._turns_end):
            a, f = self._turn(start)[1], self._turn(k)[1]
            if self._counts(k) and f.mark == a.mark and f.sign * f.value >= a.sign * a.value:
                start = k
        if start != self._head or self._open != self._turn(start)[0] - 1:
            self._open, self._head, self._search = self._turn(start)[0] - 1, start, Search(start + 1)

    def _leg(self) -> tuple[Stroke, int, int | None] | None:
        """The leg to the furthest opposite turn if it may stand: the stroke, its end's turn, and the turn
        within it that outdoes its start, if any."""
        if self._turns_end - self._head < 2:
            return None
        place, a = self._turn(self._head)
        now = self._search
        for k in range(now.done, self._turns_end):
            at, f = self._turn(k)
            done, best, best_rival, rival = now
            if self._counts(k):
                if f.mark != a.mark:
                    bar = a if best is None else self._turn(best)[1]
                    if f.sign * f.value > f.sign * bar.value:
                        best, best_rival = k, rival
                elif self._outdoes(k, rival):
                    rival = k
            now = Search(k + 1, best, best_rival, rival)
            if at < self._end - 2:  # the last turn may still go
                self._search = now
        if now.best is None:
            return None
        end, b = self._turn(now.best)
        inside = (a.high - b.high) * (a.low - b.low) < 0  # one fractal's range holds the other's
        if inside or end - place + 3 < self.least:
            return None
        rival = now.best_rival
        k = now.best + 1  # the bar behind the end belongs to the leg and may be a turn
        if k < self._turns_end and self._turn(k)[0] == end + 1 and self._turn(k)[1].mark == a.mark and self._counts(k) and self._outdoes(k, rival):
            rival = k
        before, behind = self.tape[place - 1 - self._tape0], self.tape[end + 1 - self._tape0]
        return Stroke(a, b, end - place + 3, before.first_t, behind.last_t, behind.known_at), now.best, rival

    def _outdoes(self, k: int, rival: int | None) -> bool:
        """Whether turn ``k``, of the start's mark, goes beyond the start and the rival so far."""
        f, a = self._turn(k)[1], self._turn(self._head)[1]
        if f.sign * f.value <= a.sign * a.value:
            return False
        return rival is None or (f.sign * f.value, f.sign * f.t) > (f.sign * self._turn(rival)[1].value, f.sign * self._turn(rival)[1].t)

    def _accept(self, stroke: Stroke, end: int) -> None:
        self._back.append((self._open, self._head, self._search))
        self.strokes.append(stroke)
        self.version += 1
        self._open, self._head, self._search = self._turn(end)[0] - 1, end, Search(end + 1)

    def _take_back(self, code: str, t: int) -> None:
        self.strokes.pop()
        self._open, self._head, self._search = self._back.pop()
        self.version += 1
        self.low = min(self.low, self.total)
        self.notes.append((code, t))
        self._resume = not self.strokes
        if self._resume and self.first:
            self.notes.append(("ROLLBACK_BEYOND_MARGIN", t))

    def _forget(self) -> None:
        old = min(self.settled, self.total) - self.margin - self.first
        if old < self.margin:
            return
        place, turn, _ = self._back[old]
        del self.strokes[:old], self._back[:old]
        del self.tape[: place - self._tape0], self.turns[: turn - self._turn0]
        self.first, self._tape0, self._turn0 = self.first + old, place, turn
