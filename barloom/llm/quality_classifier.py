"""Quality classifier by compression.

Two Zstandard dictionaries are built, one from good and one from bad labelled text. A text is cut
into chunks of fixed size (all of it, so a dictionary counts to the end of a long text) and each is
compressed with either dictionary. The difference of the two total sizes over their sum, shifted
and scaled by a logistic fit, is the probability of a good text. Nothing else enters the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col

CHUNK = 2048
LEVEL = 3
#: The bounded sample that the model is fitted on: labelled rows taken per class, the first by a hash of
#: the id, and of them those whose texts add up to so many bytes. Every other row builds dictionaries,
#: the rest fits the calibration.
SAMPLE_PER_CLASS = 1500
SAMPLE_BYTES = 12_000_000
DICTIONARY_BYTES = 112 * 1024


def chunks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    #: Constant and slope of the logistic calibration.
    weights: tuple[float, float]

    def difference(self, texts: list[str | None]) -> np.ndarray:
        """How much smaller each text gets by the good dictionary than by the bad one, normalised."""
        if not self.weights[1] and not self.good:
            return np.zeros(len(texts))
        tools = _compressors(self.good, self.bad)
        out = np.zeros(len(texts))
        for k, t in enumerate(texts):
            parts = chunks(t)
            g, b = (sum(len(c.compress(x)) for x in parts) for c in tools)
            if g + b:
                out[k] = (b - g) / (b + g)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.weights[0] + self.weights[1] * self.difference(texts)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


_tools: dict[tuple[int, int], tuple] = {}


def _compressors(good: bytes, bad: bytes) -> tuple:
    key = (hash(good), hash(bad))
    if key not in _tools:
        _tools.clear()
        make = lambda d: zstandard.ZstdCompressor(dict_data=_dictionary(d), level=LEVEL, write_content_size=False, write_dict_id=False)
        _tools[key] = make(good), make(bad)
    return _tools[key]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return d


def build_dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; where the trainer finds too little to work on, the text itself."""
    parts = [p for t in texts for p in chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:] or b"\n" * 64


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method on standardised features; weights returned for the raw ones. Classes count
    by their rows, so the score is calibrated to the labelled mixture."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / dev])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[1:] / dev
    return np.concatenate([[w[0] - raw @ mean], raw])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE_PER_CLASS,
    sample_bytes: int = SAMPLE_BYTES,
) -> CompressionModel:
    """A model from labelled rows (``labels``: id and label 0/1) that have a document.

    At most ``sample`` ids of each class are used, the first by a hash of the id, and of their texts
    those that bring the sum of bytes to at most ``sample_bytes`` in that order; only they reach the
    driver. Null and other labels, null ids and ids with both labels are left out; of several texts
    of one id the first by order counts. Without rows of both classes there is nothing to compare:
    every text gets the smoothed share of label 1, which is 0.5 without any label.
    """
    known = (
        labels.select(col(id_col).alias("k"), col(label_col).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
        .groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("k", "y", F.xxhash64("k").alias("h"))
    )
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("h", "k").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(col(id_col).alias("k"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    # Text lengths first: what is too long never leaves its task.
    found = texts.join(F.broadcast(picked), "k").withColumn("bytes", F.octet_length("t")).where(F.col("bytes") <= sample_bytes)
    found = found.groupBy("y", "h", "k").agg(F.min(F.struct("t", "bytes")).alias("d")).select("y", "h", "k", "d.t", "d.bytes")
    sums = F.sum("bytes").over(Window.partitionBy("y").orderBy("h", "k").rowsBetween(Window.unboundedPreceding, 0))
    rows = sorted(found.withColumn("sum", sums).where(F.col("sum") <= sample_bytes).select("y", "h", "k", "t").collect(), key=lambda r: (r["h"], r["k"]))
    n = {0: 0, 1: 0} | {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    halves: dict[tuple[int, int], list[str]] = {}
    seen = {0: 0, 1: 0}
    for r in rows:
        halves.setdefault((r["y"], seen[r["y"]] % 2), []).append(r["t"])
        seen[r["y"]] += 1
    if not seen[0] or not seen[1]:
        return CompressionModel(b"", b"", (float(np.log((n[1] + 1) / (n[0] + 1))), 0.0))
    first = CompressionModel(build_dictionary(halves[1, 0]), build_dictionary(halves[0, 0]), (0.0, 1.0))
    held = [(y, t) for y in (0, 1) for t in halves.get((y, 1), halves[y, 0])]
    y = np.array([v for v, _ in held], float)
    w = _logistic(first.difference([t for _, t in held])[:, None], y)
    # Rows weigh as their class does among all labelled rows.
    prior = np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return CompressionModel(first.good, first.bad, (float(w[0] + prior), float(w[1])))


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row: null and empty texts get the score of no difference. Whole
    texts count. Ids are numbers and may be null or repeated, equal texts get equal scores, other
    columns are ignored; an empty table gives an empty result."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = score(docs, fit(docs, labels.where(~held)))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
