"""``spark-submit`` / ``python -m barloom``: analyse bar files into report frames, or write demo bars."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.analysis import analyze
from .plans.frames import frames, write_frames
from .sources import bar_files, entry
from .sources.demo import demo_bars


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="barloom")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("analyze", help="bars of CSV or Parquet files into frames")
    run.add_argument("source")
    run.add_argument("target")
    run.add_argument("--symbol", default="BARS")
    run.add_argument("--interval", default="1h")
    run.add_argument("--last", type=int)
    run.add_argument("--least", type=int, default=7)
    run.add_argument("--trusted", action="store_true", help="the first bar is where the history begins")
    run.add_argument("--format", default="csv", choices=("csv", "parquet"))
    run.add_argument("--frames", nargs="*", help="names of frames; all by default")
    get = sub.add_parser("fetch", help="the last bars of a kline service as CSV, and their frames")
    get.add_argument("url", help="address of the klines, to which the query is added")
    get.add_argument("target", help="folder for the bars and, beside them, the frames")
    get.add_argument("--symbol", default="BTCUSDT")
    get.add_argument("--interval", default="5m")
    get.add_argument("--limit", type=int, default=5000)
    get.add_argument("--page", type=int, default=1000)
    get.add_argument("--least", type=int, default=7)
    get.add_argument("--trusted", action="store_true", help="the first bar is where the history begins")
    get.add_argument("--frames", nargs="*", default=["strokes", "segments", "stroke_zones", "segment_zones", "trading_points"])
    demo = sub.add_parser("export-demo", help="made-up bars as CSV")
    demo.add_argument("target")
    demo.add_argument("--count", type=int, default=180)
    demo.add_argument("--symbol", default="DEMO")
    demo.add_argument("--interval", default="1h")
    o = parser.parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.command == "export-demo":
        bar_files.write_csv(demo_bars(spark, o.count, o.symbol, o.interval), o.target)
        return
    if o.command == "fetch":
        asked = entry.from_klines(spark, url=o.url, symbol=o.symbol, interval=o.interval, limit=o.limit, page=o.page)
        bar_files.write_csv(asked, f"{o.target}/bars")  # asked once: the frames are made of what was written
        a = analyze(bar_files.read_csv(spark, f"{o.target}/bars", o.symbol.strip().upper(), o.interval), o.least, o.trusted)
        known = set(frames(a))
        if unknown := set(o.frames) - known:
            parser.error(f"unknown frames: {sorted(unknown)}; there are {sorted(known)}")
        write_frames(a, f"{o.target}/frames", o.frames or None, "csv")
        a.release()
        return
    bars = entry.from_parquet(spark, o.source, o.last) if o.source.rstrip("/").endswith(".parquet") else entry.from_csv(spark, o.source, o.symbol, o.interval, o.last)
    a = analyze(bars, o.least, o.trusted)
    if o.frames and (unknown := set(o.frames) - set(frames(a))):
        parser.error(f"unknown frames: {sorted(unknown)}")
    write_frames(a, o.target, o.frames or None, o.format)
    a.release()


if __name__ == "__main__":
    main()
