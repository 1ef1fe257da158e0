"""The sequential cores against hand-built and random series."""

import pickle
import random
import time

import pytest

from barloom.operators import segment_machine as seg
from barloom.operators.inclusion import Bar, InclusionFold
from barloom.operators.stroke_machine import DOWN, UP, Fractal, Stroke, StrokeMachine, extreme

HOUR = 3_600_000_000


def bars(pairs, bearish=()):
    """From (high, low); a bar opens at its low and closes at its high unless it is bearish."""
    return [Bar(i, i * HOUR, (i + 1) * HOUR - 1000, *((h, h, lo, lo) if i in bearish else (lo, h, lo, h)), 1.0, 1.0) for i, (h, lo) in enumerate(pairs)]


def merged(series):
    f, out = InclusionFold(), []
    for b in series:
        m = f.push(b)
        out += [m] if m else []
    return out + f.finish()


@pytest.mark.parametrize(
    ("pairs", "marks"),
    [
        ([(10, 5), (12, 7), (11, 6)], ["G"]), ([(10, 5), (12, 5), (11, 4)], []), ([(12, 5), (12, 7), (11, 6)], []), ([(12, 7), (10, 5), (11, 6)], ["D"]),
        ([(10, 5), (12, 7), (11.5, 8), (11, 6)], ["G"]),
    ],
)
def test_fractals(pairs, marks):
    m = merged(bars(pairs))
    assert [x for x in map(extreme, m, m[1:], m[2:]) if x] == marks


def test_inclusion():
    up = merged(bars([(10, 5), (12, 7), (11, 8)], bearish={2}))
    assert [(m.high, m.low, m.t // HOUR, m.open, m.close) for m in up][1] == (12, 8, 1, 12, 8)
    down = merged(bars([(12, 7), (10, 5), (11, 4)]))
    assert (down[1].high, down[1].low, down[1].t // HOUR, down[1].open, down[1].close) == (10, 4, 2, 4, 10)
    assert len(merged(bars([(10, 5), (10, 6), (9, 7)]))) == 3  # equal highs give no direction
    assert len(merged(bars([(10, 5), (9, 6)]))) == 2  # the first two always stand
    assert [m.count for m in merged(bars([(10, 5), (12, 7), (11.5, 8), (11, 6)]))] == [1, 2, 1]


def run(pairs, least):
    m = StrokeMachine(least)
    for b in bars(pairs):
        m.push(b)
    return m


def test_strokes():
    short = [(10, 8), (9, 7), (11, 9), (12, 10), (14, 12), (13, 11)]
    assert not run(short, 7).strokes and len(run(short, 6).strokes) == 1
    whole = [(10, 8), (9, 7), (11, 9), (12, 10), (13, 11), (15, 13), (14, 12)]
    s = run(whole, 7).strokes
    assert [(x.direction, x.size) for x in s] == [(UP, 7)] and not run(whole, 8).strokes
    far = run([(10, 8), (9, 7), (11, 9), (12, 10), (14, 12), (11, 9), (13, 11), (16, 14), (15, 13)], 6).strokes
    assert [(x.b.value, x.size) for x in far] == [(16, 9)]
    moved = run(
        [(9, 7), (12, 10), (10, 8), (9, 7), (8, 6), (7, 5), (6.5, 4.5), (6, 4), (8, 6), (9, 7), (10, 8), (11, 9), (12, 10), (14, 12), (11, 9), (5, 3), (9, 7), (10, 8),
         (11, 9), (12, 10), (13, 11), (16, 14), (14, 12)], 6,
    )
    assert [(x.a.t // HOUR, x.b.t // HOUR, x.direction) for x in moved.strokes] == [(1, 15, DOWN), (15, 21, UP)] and moved.strokes[0].b.value == 3
    assert "SHARED_ENDPOINT_REPLACED" in [c for c, _ in moved.notes]
    with pytest.raises(ValueError, match="at least 3"):
        StrokeMachine(2)


def chain(values, first_bottom=True):
    """Strokes between alternating endpoint values; an endpoint's bar spans two."""
    out, fs = [], []
    for i, v in enumerate(values):
        top = (i % 2 == 1) == first_bottom
        h, lo = (v, v - 2) if top else (v + 2, v)
        fs.append(Fractal(i, "G" if top else "D", h, lo))
    for a, b in zip(fs, fs[1:]):
        out.append(Stroke(a, b, 3, a.t, b.t, b.t))
    return out


def test_segment_ends():
    d = seg.detect(chain([10, 20, 15, 25, 18, 23, 14]))
    assert [(o.start, o.end, o.confirmation) for o in d.segments] == [(0, 3, "NO_GAP")]
    d = seg.detect(chain([10, 20, 15, 25, 23, 24, 18, 22, 20, 23]))
    assert d.segments[0].end == 3 and d.segments[0].confirmation == "GAP_REVERSE_FRACTAL"
    d = seg.detect(chain([10, 20, 15, 25, 14, 23, 13]))
    f = d.segments[0].primary
    assert (f.left.positions, f.middle.positions, f.right.positions, d.segments[0].end) == ((1,), (3,), (5,), 3)
    late = [10, 20, 15, 25, 18, 26, 16, 24, 17, 23, 15]
    assert not seg.detect(chain(late[:10])).segments
    o = seg.detect(chain(late)).segments[0]
    assert (o.primary.middle.positions, o.end, o.at) == ((3, 5), 5, 9)


def walk(n, seed):
    r, p, out = random.Random(seed), 100.0, []
    for i in range(n):
        drift = r.uniform(-1, 1) if i % 18 == 0 else drift
        c = p + drift * 0.6 + r.gauss(0, 0.8)
        out.append(Bar(i, i * 60_000_000, i * 60_000_000 + 59_999_000, p, max(p, c) + abs(r.gauss(0, 0.4)), min(p, c) - abs(r.gauss(0, 0.4)), c, 1.0, 1.0))
        p = c
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ledger_never_retracts_and_agrees_with_a_rescan(seed):
    led, seen = seg.Ledger(StrokeMachine(6), trusted=True), []
    for b in walk(2500, seed):
        new = led.push(b)
        assert all(c.committed_at == b.t_end for c in new)
        seen += new
        now = led.chain()
        assert [s.key for s in now[: len(led.stable)]] == [s.key for s in led.stable]
    assert len(seen) == led.count > 3
    full = [(o.start, o.end, o.confirmation) for o in seg.detect(led.chain()).segments]
    assert [(c.outcome.start, c.outcome.end, c.outcome.confirmation) for c in seen] == full[: len(seen)]
    for a, b in zip(seen, seen[1:]):
        assert a.strokes[-1].b.key == b.strokes[0].a.key and len(b.strokes) % 2 == 1


def test_short_stretches_decide_like_the_whole_chain():
    m = StrokeMachine(6)
    for b in walk(6000, 9):
        m.push(b)
    s = m.strokes
    assert len(s) > 200
    assert all(seg._scan(s, k, len(s))[:4] == seg.scan(s, k)[:4] for k in range(0, len(s) - 3, 3))


def committed(ledger, series):
    return [c for b in series for c in ledger.push(b)]


def test_left_edge():
    series = walk(3000, 3)
    full, none = committed(seg.Ledger(StrokeMachine(6), trusted=True), series), committed(seg.Ledger(StrokeMachine(6)), series)
    assert full and not none
    start = full[2].strokes[0].a
    part = committed(seg.Ledger(StrokeMachine(6), anchor=(start.t, start.value, start.mark)), [b for b in series if b.t >= start.t - 600 * 60_000_000])
    ours = [(c.strokes[0].a.t, c.strokes[-1].b.t) for c in part]
    theirs = [(c.strokes[0].a.t, c.strokes[-1].b.t) for c in full]
    assert not ours or any(theirs[k : k + len(ours)] == ours for k in range(len(theirs)))


def test_state_stays_flat_and_nothing_depends_on_what_is_forgotten():
    series = walk(60_000, 5)
    short, whole = seg.Ledger(StrokeMachine(6, margin=16), trusted=True), seg.Ledger(StrokeMachine(6, margin=10**9), trusted=True, collect=True)
    sizes, got, want = [], [], []
    for k, b in enumerate(series):
        got += short.push(b)
        want += whole.push(b)
        short.machine.notes.clear()
        if k in (19_999, 59_999):
            sizes.append(len(pickle.dumps(short)))
    assert got == want and len(got) > 100 and sizes[1] < 1.5 * sizes[0] < 300_000
    some = seg.Ledger(StrokeMachine(6, margin=16), trusted=True, collect=True)
    assert committed(some, series[:20_000]) == [c for c in want if c.committed_pos < 20_000]
    again = seg.Ledger(StrokeMachine(6, margin=10**9), trusted=True, collect=True)
    committed(again, series[:20_000])
    assert [s.key for s in some.chain()] == [s.key for s in again.chain()] and some.cut > 0


def test_a_long_trend_takes_linear_time():
    took = []
    for n in (5_000, 40_000):
        m, began = StrokeMachine(7), time.process_time()
        for i in range(n):
            p = i + (3.0 if i % 4 == 0 else 0.0)
            m.push(Bar(i, i * HOUR, i * HOUR + 1, p, p + 1, p - 1, p, 1.0, 1.0))
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0] + 0.5


@pytest.mark.parametrize("seed", range(40))
def test_liveness_and_tail_coverage(seed):
    """On random walks with spikes: commits go on, and the feature scan reaches the last strokes."""
    r, led, last = random.Random(seed), seg.Ledger(StrokeMachine(6), trusted=True), 0
    for b in walk(700, seed):
        if r.random() < 0.02:
            b = b._replace(high=b.high + 6 * r.random(), low=b.low - 6 * r.random())
        led.push(b)
        assert led.base >= last
        last = led.base
    chain = led.chain()
    found = seg.detect(chain)
    assert all(s.b.key == t.a.key and s.direction != t.direction for s, t in zip(chain, chain[1:]))
    assert not [n for n in led.notes if n[0] != "CONFIRMED_SEGMENT_DIVERGENCE_IGNORED"]
    if found.scans and len(chain) >= 4:
        assert max(e.positions[-1] for o in found.scans for _, e in seg.elements_of(o)) >= len(chain) - 3
