"""Operators on bars: resampling, validation, gaps and snapshots. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import interval_seconds, is_supported, next_open_time
from .folds import KEYS

GRAINS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
BAR_COLUMNS = ["symbol", "interval", "open_time", "close_time", "open", "high", "low", "close", "volume", "quote_volume", "trade_count"]


def by_key(*order: str) -> Window:
    return Window.partitionBy(*KEYS).orderBy(*order)


def with_position(bars: DataFrame) -> DataFrame:
    """``pos`` 0, 1, … per key by open time."""
    return bars.withColumn("pos", (F.row_number().over(by_key("open_time")) - 1).cast("long"))


def resample(ticks: DataFrame, interval: str, symbol: Column, ts: str, price: str, tie: list[str], size: Column | None = None) -> DataFrame:
    """OHLCV bars from ticks: first and last price by ``ts`` and the ``tie`` columns, which must make
    the order strict. Empty windows make no bar; null prices and times are left out. Partial
    aggregates meet in one shuffle on (symbol, window)."""
    n, unit = int(interval[:-1]), interval[-1]
    order = F.struct(ts, *tie)
    size = F.lit(1.0) if size is None else size
    rows = ticks.where(F.col(price).isNotNull() & F.col(ts).isNotNull()).withColumns({"symbol": symbol, "__size": size, "__price": F.col(price).cast("double")})
    out = rows.groupBy("symbol", F.window(ts, f"{n} {GRAINS[unit]}").alias("w")).agg(
        F.min_by("__price", order).alias("open"), F.max("__price").alias("high"), F.min("__price").alias("low"), F.max_by("__price", order).alias("close"),
        F.sum("__size").alias("volume"), F.sum(F.col("__price") * F.col("__size")).alias("quote_volume"), F.count("*").alias("trade_count"),
    )
    return out.select(
        "symbol", F.lit(interval).alias("interval"), F.col("w.start").alias("open_time"), (F.col("w.end") - F.expr("INTERVAL '0.001' SECOND")).alias("close_time"),
        "open", "high", "low", "close", "volume", "quote_volume", "trade_count",
    )


def bar_violations(bars: DataFrame) -> DataFrame:
    """Bars that break a row rule, with the first broken rule's code."""
    code = (
        F.when(F.col("close_time") < F.col("open_time"), "CLOSE_BEFORE_OPEN")
        .when(F.col("high") < F.col("low"), "HIGH_BELOW_LOW")
        .when(F.col("high") < F.greatest("open", "close"), "HIGH_BELOW_BODY")
        .when(F.col("low") > F.least("open", "close"), "LOW_ABOVE_BODY")
    )
    return bars.withColumn("code", code).where("code IS NOT NULL")


def stream_issues(bars: DataFrame, arrival: str) -> DataFrame:
    """Rows of the arrival order that break a stream rule: open time not ascending, the previous bar
    closing later than this one opens, or an open that the interval's grid does not expect."""
    w = by_key(arrival)
    prev = F.lag(F.struct("open_time", "close_time")).over(w)
    code = (
        F.when(~is_supported(F.col("interval")), "UNSUPPORTED_INTERVAL")
        .when(F.col("open_time") <= prev["open_time"], "NOT_ASCENDING")
        .when(prev["close_time"] > F.col("open_time"), "OVERLAP")
        .when(F.col("open_time") != next_open_time(prev["open_time"], F.col("interval")), "GAP")
    )
    return bars.withColumn("code", code).where("code IS NOT NULL").select(*KEYS, arrival, "open_time", "code")


def continuity(bars: DataFrame, arrival: str = "open_time") -> DataFrame:
    """One row per key: is the stream continuous, and its first issue."""
    issues = stream_issues(bars, arrival).groupBy(*KEYS).agg(F.min_by(F.struct("open_time", "code"), arrival).alias("first"), F.count("*").alias("n_issues"))
    keys = bars.groupBy(*KEYS).agg(F.count("*").alias("n_bars"))
    return keys.join(issues, list(KEYS), "left").select(
        *KEYS, "n_bars", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.col("first").isNull().alias("continuous"),
        F.col("first.code").alias("first_code"), F.col("first.open_time").alias("first_open_time"),
    )


def gap_count(bars: DataFrame) -> DataFrame:
    """Per key: steps longer than the interval, and steps shorter than it (which are errors)."""
    step = (F.unix_micros(F.col("open_time").cast("timestamp")) - F.unix_micros(F.lag("open_time").over(by_key("open_time")).cast("timestamp"))) / 1e6
    size = interval_seconds(F.col("interval"))
    return bars.select(*KEYS, (step > size + 1e-6).alias("gap"), (step < size - 1e-6).alias("short")).groupBy(*KEYS).agg(
        F.count_if("gap").alias("gaps"), F.count_if("short").alias("short_steps"), F.count("*").alias("n_bars")
    )


def last_n(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars of each key. The rank limit is pushed below the shuffle by the planner."""
    rn = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("open_time").desc()))
    return bars.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")


def snapshot(history: DataFrame, latest: DataFrame, cutoff: Column, limit: int) -> DataFrame:
    """History upserted by newer rows (the newer wins by open time): the last ``limit`` closed bars of
    each key, and the current bar if it is newer than all of them; ``is_closed`` tells which."""
    both = history.withColumn("__new", F.lit(0)).unionByName(latest.withColumn("__new", F.lit(1)))
    won = both.groupBy(*KEYS, "open_time").agg(F.max_by(F.struct(*[c for c in history.columns if c not in (*KEYS, "open_time")]), "__new").alias("s"))
    rows = won.select(*KEYS, "open_time", "s.*").withColumn("is_closed", F.col("close_time") <= cutoff)
    rank = F.row_number().over(Window.partitionBy(*KEYS, "is_closed").orderBy(F.col("open_time").desc()))
    closed = F.max(F.when(F.col("is_closed"), F.col("open_time"))).over(Window.partitionBy(*KEYS))
    return rows.withColumns({"__rank": rank, "__closed": closed}).where(
        (F.col("is_closed") & (F.col("__rank") <= limit)) | (~F.col("is_closed") & (F.col("__rank") == 1) & (F.col("__closed").isNull() | (F.col("open_time") > F.col("__closed"))))
    ).drop("__rank", "__closed")


def revised(feed: DataFrame, arrival: str) -> DataFrame:
    """A feed of bars in order of ``arrival`` with what becomes of each: ``current``, ``revised`` (a later
    row has its open time, as long as no newer bar had come) or ``late`` (a newer bar came before). The
    ``current`` rows are the series to analyse; late ones change nothing."""
    order = Window.partitionBy(*KEYS).orderBy(arrival)
    newest = F.max("open_time").over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = feed.withColumn("__late", F.coalesce(F.col("open_time") < newest, F.lit(False)))
    again = F.lead(arrival).over(Window.partitionBy(*KEYS, "open_time", "__late").orderBy(arrival)).isNotNull()
    return seen.withColumn("state", F.when(F.col("__late"), "late").when(again, "revised").otherwise("current")).drop("__late")


def all_bars(snap: DataFrame) -> DataFrame:
    """Closed bars and the strictly newer current one."""
    newest = F.max(F.when(F.col("is_closed"), F.col("open_time"))).over(Window.partitionBy(*KEYS))
    return snap.withColumn("__n", newest).where(F.col("is_closed") | F.col("__n").isNull() | (F.col("open_time") > F.col("__n"))).drop("__n")


def fingerprint() -> Column:
    """A bar's identity: SHA-256 of its fields in a fixed order, doubles in their shortest form."""
    fields = ["symbol", "interval", "open_time", "close_time", "open", "high", "low", "close", "volume", "quote_volume", "trade_count"]
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256)
