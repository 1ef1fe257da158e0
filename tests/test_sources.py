import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from barloom.__main__ import main
from barloom.functions.grid import Grid
from barloom.sources.entry import bars_to_ask, from_klines, refresh
from barloom.sources.paged_klines import KlineReader, KlineSource, KlineStreamReader

HOUR = 3_600_000


def ms(*date):
    return int((dt.datetime(*date) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)


@pytest.fixture
def service():
    """A kline service with the rows it is given: at most ``limit`` of a range, from its start or, without one, its end."""
    state = {"rows": [], "asked": []}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            state["asked"].append(q)
            end, n = int(q.get("endTime", 1 << 62)), int(q["limit"])
            rows = [r for r in state["rows"] if int(q.get("startTime", 0)) <= r[0] <= end]
            body = json.dumps(rows[:n] if "startTime" in q else rows[-n:]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}/klines"
    yield state
    server.shutdown()


def rows_of(opens, interval):
    g = Grid(interval)
    return [[t, "1.5", "3", "1", str(2 + k % 7), "10", g.open_of(g.index(t) + 1) - 1, "15", 4, "0", "0", "0"] for k, t in enumerate(opens)]


@pytest.mark.parametrize("interval", ["1m", "15m", "4h", "1d", "3d", "1w", "1M", "3M"])
def test_grid(interval):
    g = Grid(interval)
    for k in (-3, 0, 1, 500):
        t = g.open_of(k)
        assert g.index(t) == k and g.index(t - 1) == k - 1 and g.index(g.open_of(k + 1) - 1) == k


def test_months_and_weeks_follow_the_calendar():
    g = Grid("1M")
    assert g.open_of(g.index(ms(2024, 2, 29, 23))) == ms(2024, 2, 1) and g.open_of(g.index(ms(2024, 2, 29)) + 1) == ms(2024, 3, 1)
    w = Grid("1w")
    assert dt.datetime.fromtimestamp(w.open_of(w.index(ms(2024, 5, 16))) / 1000, dt.UTC).isoweekday() == 1
    with pytest.raises(ValueError):
        Grid("0m")


def test_last_bars_are_counted_over_gaps(service):
    opens = [k * HOUR for k in range(100) if k % 10 not in (3, 4, 5)]
    service["rows"] = rows_of(opens, "1h")
    o = {"symbol": " x ", "interval": "1h", "page": "7", "limit": "30", "url": service["url"]}
    read = lambda **more: [r[2] for p in KlineReader(o | more).partitions() for r in KlineReader(o | more).read(p)]
    open_now = opens[-1] + HOUR // 2
    assert read(now=str(open_now)) == opens[-31:-1]  # the last one is still open
    assert all(int(q["limit"]) <= 7 and q["symbol"] == "X" and "startTime" not in q for q in service["asked"])
    assert read(now=str(open_now), closed="false") == opens[-30:]
    assert read(limit="500", now=str(opens[-1] + HOUR)) == opens
    assert read(now=str(opens[-1] + HOUR), end=str(50 * HOUR)) == [t for t in opens if t <= 50 * HOUR][-30:]
    service["rows"] = []
    assert read() == []
    for wrong in ("0", "5001"):
        with pytest.raises(ValueError):
            KlineReader(o | {"limit": wrong}).partitions()


def test_ranges_are_cut_on_the_calendar(service):
    g = Grid("1M")
    opens = [g.open_of(k) for k in range(g.index(ms(2019, 1, 1)), g.index(ms(2024, 6, 1)))]
    service["rows"] = rows_of(opens, "1M")
    r = KlineReader({"symbol": "X", "interval": "1M", "page": "10", "from": str(ms(2019, 1, 1)), "end": str(ms(2024, 5, 20)), "now": str(ms(2024, 5, 20)), "url": service["url"]})
    pages = r.partitions()
    assert len(pages) == 7 and [x[2] for p in pages for x in r.read(p)] == opens[:-1]  # May is open


@pytest.mark.parametrize(("interval", "year", "month"), [("1M", 2024, 2), ("1M", 2024, 8), ("1w", 2024, 7)])
def test_stream_reads_bars_once_they_are_closed(service, interval, year, month):
    """Day by day over 80 days: every bar comes once, and none before it is closed (31-day months included)."""
    g = Grid(interval)
    day, first = 86_400_000, ms(year, month, 1)
    opens = [g.open_of(k) for k in range(g.index(first) - 5, g.index(first) + 20)]
    service["rows"] = rows_of(opens, interval)
    clock = {"t": first}
    st = KlineStreamReader({"symbol": "X", "interval": interval, "limit": "3", "url": service["url"]}, now=lambda: clock["t"] / 1000)
    at, got = st.initialOffset(), []
    for d in range(80):
        clock["t"] = first + d * day + 5
        end = st.latestOffset()
        new = [r for p in st.partitions(at, end) for r in st.read(p)]
        assert all(r[3] < clock["t"] for r in new)
        got += [r[2] for r in new]
        at = {"open": max(at["open"], end["open"])}
    want = [t for t in opens if t >= g.open_of(g.index(first) - 3) and g.open_of(g.index(t) + 1) <= clock["t"]]
    assert got == want and len(want) > 4


def test_refresh(spark, service):
    opens = [k * HOUR for k in range(400)]
    service["rows"] = rows_of(opens[:301], "1h")
    o = {"url": service["url"], "symbol": "X", "interval": "1h"}
    view = lambda s: [(int(r.t), r.close, r.is_closed) for r in s.select(F.unix_millis(F.col("open_time").cast("timestamp")).alias("t"), "close", "is_closed").orderBy("open_time").collect()]
    first = refresh(spark, None, opens[300] + 10, 50, **o).cache()
    assert [t for t, _, c in view(first) if c] == opens[250:300] and view(first)[-1][0] == opens[300] and not view(first)[-1][2]
    service["rows"] = rows_of(opens[:311], "1h")
    service["rows"][300][4] = "99"  # revised when it closed
    service["asked"].clear()
    second = refresh(spark, first, opens[310] + 10, 50, **o).cache()
    assert view(second)[:-1] == [(r[0], float(r[4]), True) for r in service["rows"][260:310]] and view(second)[-1][0] == opens[310]
    assert max(int(q["limit"]) for q in service["asked"]) == 14
    service["rows"] = rows_of(opens, "1h")
    third = refresh(spark, second, opens[399] + 10, 50, **o)  # a pause longer than the history
    assert [t for t, _, c in view(third) if c] == opens[349:399]
    assert bars_to_ask("1M", ms(2024, 1, 1), ms(2024, 3, 31), 500) == 6 and bars_to_ask("1h", 0, 60 * HOUR, 50) is None
    first.unpersist(), second.unpersist()


def test_fetch_command_and_stream(spark, service, tmp_path):
    now = int(dt.datetime.now(dt.UTC).timestamp() * 1000)
    g = Grid("1h")
    service["rows"] = rows_of([g.open_of(k) for k in range(g.index(now) - 120, g.index(now) + 1)], "1h")
    main(["fetch", service["url"], str(tmp_path), "--symbol", "x", "--interval", "1h", "--limit", "100", "--frames", "strokes"], spark)
    assert spark.read.option("header", True).csv(f"{tmp_path}/bars").count() == 100
    assert from_klines(spark, url=service["url"], symbol="x", interval="1h", limit=5).count() == 5
    spark.dataSource.register(KlineSource)
    stream = spark.readStream.format("klines").options(url=service["url"], symbol="x", interval="1h", limit="40", page="9").load()
    q = stream.writeStream.format("memory").queryName("klines_read").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert spark.table("klines_read").count() in (40, 41)
