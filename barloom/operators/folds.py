"""Ordered folds per key, as a stream over sorted partitions.

One hash shuffle brings a key's rows together and a sort puts them in order; the fold then sees
them one by one. A group is never gathered: memory is the fold's own state and one Arrow batch,
however long a key's series is, and any number of keys share a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("symbol", "interval")


class Fold(Protocol):
    def push(self, row: tuple) -> list[tuple]: ...

    def finish(self) -> list[tuple]: ...


_ARROW = {
    T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(),
    T.ArrayType(T.LongType()): pa.list_(pa.int64()),
}


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, _ARROW[f.dataType]) for f in schema])


def keyed_fold(df: DataFrame, columns: list[str], order: list[str], make: Callable[[tuple], Fold], schema: str) -> DataFrame:
    """``make(key)`` gives a key's fold; it gets tuples of ``columns`` in ``order`` and returns rows
    of ``schema`` without the key columns, which are put in front."""
    spark_schema = T.StructType.fromDDL("symbol string, interval string, " + schema)
    out_schema = arrow_schema(spark_schema)
    slim = df.select(*KEYS, *columns)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.repartition(parts, *KEYS).sortWithinPartitions(*KEYS, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        fold: Fold | None = None
        rows: list[tuple] = []

        def emit() -> pa.RecordBatch:
            nonlocal rows
            data, rows = list(zip(*rows, strict=True)), []
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(data, out_schema, strict=True)], schema=out_schema)

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for now, row in zip(zip(cols[0], cols[1], strict=True), zip(*cols[2:], strict=True), strict=True):
                if now != key:
                    if fold is not None:
                        rows += [key + r for r in fold.finish()]
                    key, fold = now, make(now)
                rows += [key + r for r in fold.push(row)]
            if len(rows) >= 4096:
                yield emit()
        if fold is not None:
            rows += [key + r for r in fold.finish()]
        if rows:
            yield emit()

    return dealt.mapInArrow(run, spark_schema)


def micros(c: str):
    """A timestamp, with or without zone, as microseconds."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def times(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """Microsecond columns back to timestamps of ``kind`` (``timestamp`` or ``timestamp_ntz``)."""
    return df.withColumns({c: F.timestamp_micros(F.col(c)).cast(kind) for c in columns})
