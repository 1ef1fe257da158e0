"""What the corpus operators share: scratch space on shared storage, column helpers, pair graphs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters of the text contracts: space and U+0009..U+000D.
ASCII_WS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A table is broadcast only after it was counted and found at or under this many rows.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the storage that driver and executors share.

    The cluster names that storage in ``spark.checkpoint.dir``. Where it is unset a session on one
    machine (a ``local`` master, as in tests) gets a temporary folder; any other session is refused,
    since a folder of one machine would be invisible to the rest.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get() if kept.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/corpus-{uuid.uuid4().hex[:12]}"


#: The folders that each open ``scratch`` block has seen written, innermost last. Every thread has blocks of
#: its own, so operators may run side by side.
_blocks: ContextVar[tuple[list[str], ...]] = ContextVar("scratch_blocks", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables that were materialized inside the block (by the same thread) when it ends, with
    an error too, but for those passed to ``keep``. What the block returns must not read any other of them."""
    mine: list[str] = []
    before = _blocks.set((*_blocks.get(), mine))
    try:
        yield mine
    finally:
        _blocks.reset(before)
        for path in mine:
            delete_path(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """Hand a materialized table over to the scratch block around the current one, if there is any."""
    path, blocks = df._scratch_path, _blocks.get()
    if blocks and path in blocks[-1]:
        blocks[-1].remove(path)
        if len(blocks) > 1:
            blocks[-2].append(path)
    return df


def materialize(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet on shared storage and read it back: the lineage is cut and the
    result survives the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if blocks := _blocks.get():
        blocks[-1].append(path)
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of scratch files through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that clash with none of ``df``'s (which compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case and nothing else. ``lower`` may serve where all characters are ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its counted ``rows`` stay in the limit; else leave the choice
    of a shuffled join to the planner."""
    return F.broadcast(df) if rows <= limit else df


def runs_of(parts: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal values in the first ``keys`` columns (integers without nulls) of a
    sorted stream, each as one batch; a run may lie across any number of incoming batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for part in parts:
        if not part.num_rows:
            continue
        cols = [part.column(k).to_numpy() for k in range(keys)]
        new = np.zeros(part.num_rows - 1, bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), part.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(int(c[lo]) for c in cols)
            if held and now != last:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            held.append(part.slice(lo, hi - lo))
            last = now
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph: ``(id, component)`` for each id on an edge; the component is
    named by its smallest id.

    Works by local contraction: in a round each vertex points to the one of itself and its neighbours
    with the least priority, then to where that one points, and edges are mapped along the pointers.
    Priorities are hashed anew in each round, so the number of vertices falls by a constant factor in
    expectation whatever the ids and the shape: chains and stars of n vertices take O(log n) rounds.
    The vertex of the largest priority always vanishes, so the loop ends. Only minima are aggregated
    (no neighbour list is ever gathered), and each round is written to shared storage.
    """
    spark = edges.sparkSession
    with scratch(spark):
        left = materialize(
            edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges"
        )
        maps: list[DataFrame] = []
        while not left.isEmpty():
            priority = lambda c, k=len(maps): F.xxhash64(F.lit(k), F.col(c))
            both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            near = both.groupBy("a").agg(F.min_by("b", priority("b")).alias("n"), F.min(priority("b")).alias("p"))
            point = near.select(F.col("a").alias("id"), F.when(F.col("p") < priority("a"), F.col("n")).otherwise(F.col("a")).alias("to"))
            then = point.select(F.col("id").alias("to"), F.col("to").alias("to2"))
            hop = materialize(point.join(then, "to").select("id", F.col("to2").alias("to")), "hop")
            maps.append(hop)
            ha = hop.select(F.col("id").alias("a"), F.col("to").alias("a2"))
            hb = hop.select(F.col("id").alias("b"), F.col("to").alias("b2"))
            moved = left.join(ha, "a").join(hb, "b").where("a2 <> b2")
            left = materialize(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        if not maps:
            return spark.createDataFrame([], "id bigint, component bigint")
        # From the last, smallest round back to the first.
        root = maps[-1].select("id", F.col("to").alias("root"))
        for hop in reversed(maps[:-1]):
            root = hop.join(root.select(F.col("id").alias("to"), "root"), "to", "left").select("id", F.coalesce("root", "to").alias("root"))
        root = materialize(root, "roots")
        names = root.groupBy("root").agg(F.min("id").alias("component"))
        return keep(materialize(root.join(names, "root").select("id", "component"), "components"))
