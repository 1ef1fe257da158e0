"""Made-up bars for demonstrations: a sum of waves with hashed noise, the same on every run."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import interval_seconds
from ..operators.bars import BAR_COLUMNS


def demo_bars(spark: SparkSession, count: int = 180, symbol: str = "DEMO", interval: str = "1h", seed: int = 7) -> DataFrame:
    """``count`` gap-free bars from 2026-01-01 UTC. Every ninth bar lies inside the one before."""
    noise = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("i")), F.lit(1000)) / 1000.0
    price = lambda i: 100 + 9 * F.sin(i * (2 * math.pi / 41)) + 4 * F.sin(i * (2 * math.pi / 13)) + i / 300
    step = interval_seconds(interval)
    rows = spark.range(count).select(F.col("id").alias("i")).withColumns({"o": price(F.col("i")), "c": price(F.col("i") + 1)})
    inner = F.col("i") % 9 == 8
    rows = rows.withColumns({"c": F.when(inner, F.col("o") + (F.col("c") - F.col("o")) / 10).otherwise(F.col("c")), "room": F.when(inner, 0.05).otherwise(0.4)})
    open_s = F.lit(1767225600) + F.col("i") * step
    return rows.select(
        F.lit(symbol).alias("symbol"), F.lit(interval).alias("interval"), F.timestamp_seconds(open_s).alias("open_time"),
        F.timestamp_millis((open_s + step) * 1000 - 1).alias("close_time"), F.col("o").alias("open"),
        (F.greatest("o", "c") + F.col("room") * (1 + noise(1))).alias("high"), (F.least("o", "c") - F.col("room") * (1 + noise(2))).alias("low"), F.col("c").alias("close"),
        (100 + 50 * noise(3)).alias("volume"), ((100 + 50 * noise(3)) * F.col("o")).alias("quote_volume"), (100 + F.col("i")).cast("long").alias("trade_count"),
    ).select(*BAR_COLUMNS)
