"""CSV bars in three layouts, and the writer.

The layout follows from the first line alone: a header with ``open_time``, a header with
``open_timestamp_utc``, or no header and at least nine columns in kline order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import next_open_time
from ..operators.bars import BAR_COLUMNS

#: The columns of a headerless kline dump, in order.
KLINE_COLUMNS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count", "taker_base", "taker_quote", "ignore",
]
#: From these magnitudes on an epoch counts microseconds and milliseconds.
MICROS_FROM, MILLIS_FROM = 1e14, 1e11


def epoch_or_text(values: Column, largest: Column) -> Column:
    """A timestamp from text that holds an epoch (its unit told by the column's largest absolute
    value) or an ISO time, taken as UTC."""
    number = values.try_cast("double")
    micros = F.when(largest >= MICROS_FROM, number).when(largest >= MILLIS_FROM, number * 1e3).otherwise(number * 1e6)
    return F.coalesce(F.timestamp_micros(micros.cast("long")), values.try_cast("timestamp"))


def read_csv(spark: SparkSession, path: str, symbol: str, interval: str) -> DataFrame:
    """Bars of one file or folder in any of the layouts; other columns are dropped.

    A missing close time is the next open less a millisecond; missing volumes and counts are 0.
    """
    first = spark.read.text(path).first()
    head = [c.strip().strip('"') for c in (first[0] if first else "").split(",")]
    if "open_time" in head or "open_timestamp_utc" in head:
        raw = spark.read.option("header", "true").csv(path)
        raw = raw.withColumnsRenamed({"open_timestamp_utc": "open_time", "close_timestamp_utc": "close_time"})
    elif len(head) >= 9:
        raw = spark.read.csv(path)
        raw = raw.toDF(*KLINE_COLUMNS[: len(raw.columns)], *[f"more{i}" for i in range(len(raw.columns) - len(KLINE_COLUMNS))])
    else:
        raise ValueError("neither a known header nor kline rows")
    need = {"open_time", "open", "high", "low", "close"} - set(raw.columns)
    if need:
        raise ValueError(f"missing columns: {sorted(need)}")
    timed = [c for c in ("open_time", "close_time") if c in raw.columns]
    big = raw.agg(*[F.max(F.abs(F.col(c).try_cast("double"))).alias(c) for c in timed]).first()
    largest = {c: F.lit(float(big[c] or 0)) for c in timed}
    out = raw.withColumns({c: epoch_or_text(F.col(c), largest[c]) for c in timed})
    given = out["close_time"] if "close_time" in timed else F.lit(None).cast("timestamp")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in raw.columns else F.lit(0.0)
    return out.select(
        F.lit(symbol.strip().upper()).alias("symbol"), F.lit(interval).alias("interval"), "open_time",
        F.coalesce(given, next_open_time(F.col("open_time"), interval) - F.expr("INTERVAL '0.001' SECOND")).alias("close_time"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        number("volume").alias("volume"), number("quote_volume").alias("quote_volume"), number("trade_count").cast("long").alias("trade_count"),
    )


def parse_klines(rows: DataFrame, body: str, symbol: str, interval: str) -> DataFrame:
    """Bars from REST bodies, each a JSON array of kline arrays of at least 11 fields (times in
    milliseconds)."""
    k = rows.select(F.explode(F.from_json(F.col(body), "array<array<string>>")).alias("k")).where(F.size("k") >= 11)
    at = lambda i: F.element_at("k", i + 1)
    when = lambda i: F.timestamp_millis(at(i).cast("long"))
    return k.select(
        F.lit(symbol.strip().upper()).alias("symbol"), F.lit(interval).alias("interval"), when(0).alias("open_time"), when(6).alias("close_time"),
        *[at(i).cast("double").alias(n) for i, n in ((1, "open"), (2, "high"), (3, "low"), (4, "close"), (5, "volume"), (7, "quote_volume"))], at(8).cast("long").alias("trade_count"),
    )


def write_csv(bars: DataFrame, path: str) -> None:
    """Bars with a header and ISO times, as ``read_csv`` takes them."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    out = bars.select(*[F.date_format(c, iso).alias(c) if c in ("open_time", "close_time") else F.col(c) for c in BAR_COLUMNS])
    out.write.mode("overwrite").option("header", "true").csv(path)
