"""Ways into the engine: bars of files, tables and ticks, ready for ``analyze``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..operators.bars import BAR_COLUMNS, last_n, resample, snapshot
from .bar_files import read_csv
from .paged_klines import KlineSource


def from_csv(spark: SparkSession, path: str, symbol: str, interval: str, last: int | None = None) -> DataFrame:
    """Bars of CSV files in any of the known layouts, the ``last`` ones if that is given."""
    bars = read_csv(spark, path, symbol, interval)
    return last_n(bars, last) if last else bars


def from_parquet(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Bars of Parquet files that have the bar columns; others are dropped before the scan."""
    bars = spark.read.parquet(path).select(*BAR_COLUMNS)
    return last_n(bars, last) if last else bars


def from_ticks(ticks: DataFrame, interval: str, symbol: Column, ts: str, price: str, tie: list[str], size: Column | None = None) -> DataFrame:
    return resample(ticks, interval, symbol, ts, price, tie, size)


def first_snapshot(bars: DataFrame, now: Column, limit: int = 5000) -> DataFrame:
    """The snapshot that a live run starts with: the last ``limit`` bars closed by ``now`` and the current one."""
    return snapshot(bars.where(F.lit(False)), bars, now, limit)


def from_klines(spark: SparkSession, **options: str | int) -> DataFrame:
    """Bars of a kline service (options of ``KlineSource``)."""
    spark.dataSource.register(KlineSource)
    rows = spark.read.format("klines").options(**{k.rstrip("_"): str(v) for k, v in options.items()}).load()
    time = lambda c: F.timestamp_millis(F.col(c)).cast("timestamp_ntz")
    return rows.withColumns({"open_time": time("open_ms"), "close_time": time("close_ms")}).select(*BAR_COLUMNS)


def bars_to_ask(interval: str, last_open: int, now: int, history_limit: int) -> int | None:
    """How many bars from the end a refresh asks for: those since the last one (milliseconds) and some more that may
    have been revised; None if that is the whole history, which is then read anew."""
    grid = Grid(interval)
    needed = max(3, grid.index(now) - grid.index(last_open) + 4)
    return needed if needed < history_limit else None


def refresh(spark: SparkSession, snap: DataFrame | None, now: int, history_limit: int = 5000, **options: str | int) -> DataFrame:
    """The snapshot of one key at ``now`` (milliseconds): the last ``history_limit`` closed bars and the current one.

    Only the end of the series is asked for if ``snap`` (with ``is_closed``) reaches near enough; beyond the history's
    length all of it is read anew, so that no stale bar stands before a gap. One row, the last open time, comes to the driver.
    """
    at = F.timestamp_millis(F.lit(now)).cast("timestamp_ntz")
    last = None if snap is None else snap.agg(F.max(F.unix_millis(F.col("open_time").cast("timestamp")))).first()[0]
    needed = None if last is None else bars_to_ask(str(options["interval"]), last, now, history_limit)
    ask = lambda n, closed: from_klines(spark, **options, now=now, limit=n, closed=closed)
    if needed is None:
        history, latest = ask(history_limit, "true"), ask(3, "false")
    else:
        history, latest = snap.where("is_closed").select(*BAR_COLUMNS), ask(needed, "false")
    return snapshot(history, latest, at, history_limit)
