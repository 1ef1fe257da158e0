"""A Spark data source for kline services that page backwards in time.

``spark.dataSource.register(KlineSource)`` makes the format ``klines``. Options: ``symbol``, ``interval``, ``url``, ``page``
(rows a request), ``end`` and ``now`` (milliseconds, by default the clock's), and either ``from`` (milliseconds) or
``limit``. ``url`` is an address to which the query is added, or a template with ``{symbol} {interval} {start} {end} {limit}``.

From ``from`` to ``end`` pages are cut on the calendar grid of the interval; each is an input partition, so they
are fetched in parallel and a lost task fetches its page again. The last ``limit`` bars cannot be told from the
calendar, since series have gaps: one task walks back page by page and counts bars, holding no more than it
was asked for. Bars still open at ``now`` are left out unless ``closed`` is ``false``.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.grid import Grid

#: The most bars that are counted back from the end.
MOST = 5000
#: Answers worth another try.
RETRY = {418, 429, 500, 502, 503, 504}


def fetch(url: str, tries: int = 5, sleep: Callable[[float], None] = time.sleep, opener: Callable = urllib.request.urlopen) -> bytes:
    """The body behind ``url``; waits twice as long after each failure, or as long as it is told."""
    for k in range(tries):
        try:
            with opener(url, timeout=15) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or k == tries - 1:
                raise
            told = e.headers.get("Retry-After") if e.headers else None
            sleep(float(told) if told and told.isdigit() else 0.5 * 2**k)
        except (TimeoutError, urllib.error.URLError):
            if k == tries - 1:
                raise
            sleep(0.5 * 2**k)
    raise AssertionError


class Page(InputPartition):
    """Open times of a page; without a start the last ``count`` bars up to the end."""

    def __init__(self, start: int | None, end: int, now: int, count: int = 0):
        self.start, self.end, self.now, self.count = start, end, now, count


class KlineReader(DataSourceReader):
    def __init__(self, options: dict, clock: Callable[[], float] = time.time):
        self.o, self.clock = options, clock
        self.symbol, self.interval, self.size = options["symbol"].strip().upper(), options["interval"], int(options.get("page", 1000))
        self.grid = Grid(self.interval)
        self.closed = options.get("closed", "true").lower() != "false"
        if not self.symbol:
            raise ValueError("a symbol is needed")

    def partitions(self) -> list[Page]:
        now = int(self.o.get("now") or self.clock() * 1000)
        end = int(self.o.get("end") or now)
        if self.o.get("from") is not None:
            return self.pages(int(self.o["from"]), end, now)
        limit = int(self.o.get("limit", 500))
        if not 1 <= limit <= MOST:
            raise ValueError(f"limit must be 1 to {MOST}; use from and end for more")
        return [Page(None, end, now, limit)]

    def pages(self, start: int, end: int, now: int) -> list[Page]:
        """Pages of open times from ``start`` to ``end``, each of at most ``page`` places of the grid."""
        cuts = [self.grid.open_of(k) for k in range(self.grid.index(start), self.grid.index(end) + 1, self.size)]
        ends = [*(c - 1 for c in cuts[1:]), end]
        return [Page(max(start, lo), hi, now) for lo, hi in zip(cuts, ends, strict=True) if hi >= max(start, lo)]

    def read(self, page: Page) -> Iterator[tuple]:
        rows = self._ask(page.start, page.end, self.size) if page.start is not None else self._walk(page)
        for k in rows:
            if (page.start or 0) <= int(k[0]) <= page.end and not (self.closed and int(k[6]) > page.now):
                yield self.symbol, self.interval, int(k[0]), int(k[6]), *(float(k[i]) for i in (1, 2, 3, 4, 5, 7)), int(k[8])

    def _walk(self, page: Page) -> list[list]:
        """The last bars up to the page's end, one more where an open one will be left out."""
        found: dict[int, list] = {}
        cursor, want = page.end, page.count + self.closed
        while len(found) < want:
            size = min(self.size, want - len(found))
            batch = [k for k in self._ask(None, cursor, size) if int(k[0]) <= cursor]
            found.update((int(k[0]), k) for k in batch)
            if len(batch) < size:
                break
            cursor = min(int(k[0]) for k in batch) - 1
        rows = [found[t] for t in sorted(found)]
        if self.closed:
            rows = [k for k in rows if int(k[6]) <= page.now]
        return rows[-page.count :]

    def _ask(self, start: int | None, end: int, limit: int) -> list[list]:
        url = self.o["url"]
        if "{" in url or url.startswith("file:"):
            url = url.format(symbol=self.symbol, interval=self.interval, start="" if start is None else start, end=end, limit=limit)
        else:
            given = {"symbol": self.symbol, "interval": self.interval, "limit": limit, "endTime": end} | ({} if start is None else {"startTime": start})
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode(given)
        rows = json.loads(fetch(url))
        if not isinstance(rows, list):
            raise ValueError(f"the service answered {str(rows)[:200]}")
        return rows


class KlineStreamReader(DataSourceStreamReader):
    """New closed bars as a stream. The offset is the open time up to which bars were read; a batch asks
    for what lies between two offsets, so a batch that is run again reads the same bars. A stream begins at ``from``, by
    default ``limit`` places of the grid before the bar that is open when it first starts."""

    def __init__(self, options: dict, now: Callable[[], float] = time.time):
        self.o, self.now = options, now
        self.source = KlineReader({**options, "closed": "false"}, now)  # what lies before an offset is closed
        self.grid = self.source.grid

    def _open(self) -> int:
        """The place of the bar that is open now."""
        return self.grid.index(int(self.now() * 1000))

    def initialOffset(self) -> dict:
        start = self.o.get("from")
        return {"open": (int(start) if start is not None else self.grid.open_of(self._open() - int(self.o.get("limit", 500)))) - 1}

    def latestOffset(self) -> dict:
        """The open time of the last bar that is closed by now."""
        return {"open": self.grid.open_of(self._open() - 1)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        if end["open"] <= start["open"]:
            return []
        return self.source.pages(start["open"] + 1, end["open"], 0)

    def read(self, page: Page) -> Iterator[tuple]:
        return self.source.read(page)


class KlineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return (
            "symbol string, interval string, open_ms long, close_ms long, open double, high double, low double, close double, "
            "volume double, quote_volume double, trade_count long"
        )

    def reader(self, schema) -> KlineReader:
        return KlineReader(dict(self.options))

    def streamReader(self, schema) -> KlineStreamReader:
        return KlineStreamReader(dict(self.options))
