"""Segment zones of very long series, without a fold: the same zones as ``zones.segment_zones`` gives.

A fold walks a key in one task. Here every seed finds its own end at once, by doubling: tables of the
least high and the greatest low of 1, 2, 4, … units from each position tell how far a range is met in as
many steps as the longest zone has binary digits. Which seeds become zones is greedy (the first, then
the first behind its end, and so on), which is a chain of pointers from seed to seed; it is marked by jumping over 1,
2, 4, … pointers. All of it are equi-joins on (key, position), so a key spreads over all tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folds import KEYS
from .zones import segment_zones as folded_zones

K = list(KEYS)
#: Units of a key beyond which its zones are found by doubling.
LONG = 200_000
#: Positions within which the next seed is looked up in one task.
BLOCK = 4096


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share (``spark.checkpoint.dir``); a session on one machine
    without it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="zones-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/zones-{uuid.uuid4().hex[:12]}"


class Tables:
    """Tables written on the way, so that what follows computes nothing twice; ``drop`` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, shared_folder(spark), 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _meets(least_high: Column, greatest_low: Column) -> Column:
    return (least_high >= F.col("zd")) & (greatest_low <= F.col("zg"))


def _shifted(level: DataFrame, by: int) -> DataFrame:
    return level.select(*K, (F.col("p") - by).alias("p"), F.col("mh").alias("mh2"), F.col("ml").alias("ml2"))


def seed_ends(units: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """All seeds (``s, zg, zd``) with ``e``, the last unit in a row that meets their range; and the cut units."""
    cut = tables.cut
    one = cut(units.select(*K, F.col("pos").alias("p"), F.col("high").alias("mh"), F.col("low").alias("ml")))
    second, third = _shifted(one, 1), _shifted(one, 2).withColumnsRenamed({"mh2": "mh3", "ml2": "ml3"})
    near = one.join(second, [*K, "p"]).join(third, [*K, "p"])
    seeds = near.select(*K, F.col("p").alias("s"), F.least("mh", "mh2", "mh3").alias("zg"), F.greatest("ml", "ml2", "ml3").alias("zd")).where("zg >= zd")
    seeds = cut(seeds)
    levels, alive = [one], seeds
    while True:
        j = len(levels) - 1
        at = levels[j].select(*K, (F.col("p") - 3).alias("s"), "mh", "ml")
        alive = cut(alive.join(at, [*K, "s"]).where(_meets(F.col("mh"), F.col("ml"))).select(*K, "s", "zg", "zd"))
        if alive.isEmpty():
            break
        both = levels[j].join(_shifted(levels[j], 1 << j), [*K, "p"])
        levels.append(cut(both.select(*K, "p", F.least("mh", "mh2").alias("mh"), F.greatest("ml", "ml2").alias("ml"))))
    far = seeds.withColumn("p", F.col("s") + 3)
    for j in range(len(levels) - 2, -1, -1):
        go = F.coalesce(_meets(F.col("mh"), F.col("ml")), F.lit(False))
        far = far.join(levels[j], [*K, "p"], "left").select(*K, "s", "zg", "zd", F.when(go, F.col("p") + (1 << j)).otherwise(F.col("p")).alias("p"))
    return cut(far.select(*K, "s", "zg", "zd", (F.col("p") - 1).alias("e"))), one


def first_seed_from(seeds: DataFrame, positions: DataFrame) -> DataFrame:
    """For each position ``p`` the first seed at or behind it (``to``): looked up within blocks, and over one row a
    block from block to block. Positions without one are left out."""
    block = F.floor(F.col("p") / BLOCK)
    rows = positions.select(*K, "p").join(seeds.select(*K, F.col("s").alias("p"), F.col("s").alias("own")), [*K, "p"], "left").withColumn("b", block)
    here = F.min("own").over(Window.partitionBy(*K, "b").orderBy("p").rowsBetween(0, Window.unboundedFollowing))
    firsts = seeds.withColumn("b", F.floor(F.col("s") / BLOCK)).groupBy(*K, "b").agg(F.min("s").alias("f"))
    blocks = rows.select(*K, "b").distinct().join(firsts, [*K, "b"], "left")
    later = blocks.select(*K, "b", F.min("f").over(Window.partitionBy(*K).orderBy("b").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    return rows.withColumn("here", here).join(later, [*K, "b"], "left").select(*K, "p", F.coalesce("here", "later").alias("to")).where("to IS NOT NULL")


def zone_spans(units: DataFrame) -> DataFrame:
    """``zone, start_pos, end_pos, zd, zg`` of units with positions in a row, by doubling. The result is a written
    table in the shared folder; all others on the way are deleted."""
    tables = Tables(units.sparkSession)
    try:
        return Tables(units.sparkSession).cut(_spans(units, tables))
    finally:
        tables.drop()


def _spans(units: DataFrame, tables: Tables) -> DataFrame:
    cut = tables.cut
    seeds, one = seed_ends(units, tables)
    ahead = first_seed_from(seeds, one)
    pointers = cut(seeds.select(*K, "s", (F.col("e") + 1).alias("p")).join(ahead, [*K, "p"]).select(*K, "s", "to"))
    chosen = cut(seeds.groupBy(*K).agg(F.min("s").alias("s")))
    while True:
        if pointers.isEmpty():
            break
        more = chosen.join(pointers, [*K, "s"]).select(*K, F.col("to").alias("s"))
        chosen = cut(chosen.unionByName(more).distinct())
        then = pointers.select(*K, F.col("s").alias("to"), F.col("to").alias("to2"))
        pointers = cut(pointers.join(then, [*K, "to"]).select(*K, "s", F.col("to2").alias("to")))
    spans = chosen.join(seeds, [*K, "s"])
    number = F.row_number().over(Window.partitionBy(*K).orderBy("s")) - 1
    return spans.select(*K, number.cast("long").alias("zone"), F.col("s").alias("start_pos"), F.col("e").alias("end_pos"), "zd", "zg")


def zones_by_doubling(units: DataFrame) -> DataFrame:
    """The columns of ``zones.segment_zones``, by joins alone."""
    spans = zone_spans(units)
    at = spans.withColumn("pos", F.explode(F.sequence("start_pos", "end_pos")))
    m = at.join(units.select(*K, "pos", "direction", "end_value", "high", "low", "start_dt", "end_dt"), [*K, "pos"])
    inner = F.col("pos") < F.col("end_pos")
    base = m.groupBy(*K, "zone", "start_pos", "end_pos", "zd", "zg").agg(
        F.min_by("start_dt", "pos").alias("start_dt"), F.max_by("end_dt", "pos").alias("end_dt"), F.min_by("direction", "pos").alias("first_direction"),
        F.max_by("direction", "pos").alias("last_direction"), F.max_by("end_value", "pos").alias("lv"), F.max("high").alias("gg"), F.min("low").alias("dd"),
        F.max(F.when(inner, F.col("high"))).alias("bh"), F.min(F.when(inner, F.col("low"))).alias("bl"),
    )
    size, departs = F.col("end_pos") - F.col("start_pos") + 1, (F.col("lv") < F.col("zd")) | (F.col("lv") > F.col("zg"))
    return base.select(
        *K, "zone", "zg", "zd", size.alias("size"), "start_pos", "end_pos", "start_dt", "end_dt", "first_direction", "last_direction", (F.col("zd") + (F.col("zg") - F.col("zd")) / 2).alias("zz"),
        departs.alias("departs"), "gg", "dd", F.when(departs, F.col("bh")).otherwise(F.col("gg")).alias("trend_gg"), F.when(departs, F.col("bl")).otherwise(F.col("dd")).alias("trend_dd"),
        (size - departs.cast("int")).alias("trend_size"), F.lit(True).alias("is_valid"),
    )


def segment_zones(units: DataFrame, long: int = LONG) -> DataFrame:
    """Segment zones of all keys: those of more than ``long`` units by doubling, the rest, many to a task, by
    the fold. Positions of a key are whole numbers without a gap."""
    sizes = units.groupBy(*K).agg(F.count("*").alias("n"))
    big = sizes.where(F.col("n") > long).select(*K).persist()
    if big.isEmpty():
        return folded_zones(units)
    rest = folded_zones(units.join(big, K, "left_anti"))
    # Few keys are long: at most the number of units over ``long``.
    return rest.unionByName(zones_by_doubling(units.join(big, K, "left_semi")).select(*rest.columns))
