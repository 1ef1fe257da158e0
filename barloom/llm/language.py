"""Language ID by nearest centroid.

A text is lower-cased, everything but letters becomes one space, and its letter bigrams and
trigrams are hashed into a TF-IDF vector of unit length. Each language has several centroids (found
by spherical k-means, since a language's documents come in kinds); the closest by cosine wins. A
text further from every centroid than nearly all training texts of that language is marked as
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, col

DIMS = 1 << 13
CENTROIDS = 4
#: Distinct rows per language for the centroids, the first by a hash of id and text; document
#: frequencies are counted over all training rows.
SAMPLE_PER_LANGUAGE = 400
REJECT_QUANTILE = 0.002

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram numbers that occur in a text, ascending, and how often. None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, codes, 32)[keep].astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    two = c[:-1] * np.uint64(0x9E3779B1) + c[1:] * np.uint64(0x85EBCA77)
    three = two[:-1] * np.uint64(31) + c[2:] * np.uint64(0xC2B2AE3D) + np.uint64(7)
    h = np.concatenate([two, three])
    h ^= h >> np.uint64(15)
    h *= np.uint64(0x2C1B3C6D)
    h ^= h >> np.uint64(13)
    n = np.bincount((h & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS)
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    owner: np.ndarray  # the language's number of each centroid
    centroids: np.ndarray  # (centroid, dim), unit length
    idf: np.ndarray
    floor: np.ndarray  # the least cosine of each language that is not rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine in 0..1, and whether the text is too far from it. No letters: ``und``."""
        at, n = ngram_counts(text)
        if not len(at) or not len(self.languages):
            return "und", 0.0, True
        v = np.sqrt(n) * self.idf[at]
        size = np.sqrt(v @ v)
        sims = self.centroids[at].T @ (v / size if size else v)
        k = int(np.argmax(sims))
        lang, s = int(self.owner[k]), min(1.0, max(0.0, float(sims[k])))
        return self.languages[lang], s, bool(s < self.floor[lang])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> LanguageModel:
    """A model from all rows with text and language. Document frequencies come from every row;
    centroids from at most ``sample`` distinct (id, text) rows per language, the first by a hash of
    both, so null and repeated ids bias nothing and repeated rows count once. The driver gets no text,
    only the n-gram numbers of the sampled rows (at most ``DIMS`` each). Of equally close centroids the
    first by language name wins. No such row: a model that knows none."""
    rows = docs.where(col(lang_col).isNotNull() & col(text_col).isNotNull()).select(col(id_col).alias("k"), col(text_col).alias("t"), col(lang_col).cast("string").alias("lang"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS + 1, np.int64)
        for part in parts:
            for t in part.column(0).to_pylist():
                at, _ = ngram_counts(t)
                if len(at):
                    df[at] += 1
                    df[DIMS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["dim", "n"])

    df = np.zeros(DIMS + 1, np.int64)
    for r in rows.select("t").mapInArrow(count, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        df[r["dim"]] = r["n"]
    idf = np.log((df[DIMS] + 1.0) / (df[:DIMS] + 1.0)) + 0.05
    # A uniform share of each language's distinct rows by the hash, then the bound for certain.
    u = (F.pmod(F.xxhash64("k", "t"), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    sizes = rows.select("lang", u).groupBy("lang").agg(F.approx_count_distinct("u", 0.05).alias("n"))
    shares = sizes.select(F.col("lang").alias("of"), (F.lit(2.0 * sample) / F.col("n")).alias("share"))
    near = rows.select("lang", "t", u).join(bounded_broadcast(shares, sizes.count()), F.col("lang") == F.col("of")).where("u < share")
    near = near.groupBy("lang", "u").agg(F.min("t").alias("t"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("u"))).where(F.col("rank") <= sample)

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [ngram_counts(t.as_py()) for t in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["lang", "u", "at", "n"]
            )

    by: dict[str, list[tuple]] = {}
    for r in ranked.select("lang", "u", "t").mapInArrow(features, "lang string, u double, at array<long>, n array<long>").toLocalIterator():
        if r["at"]:
            by.setdefault(r["lang"], []).append((r["u"], np.array(r["at"]), np.array(r["n"])))
    names, owner, centres, floor = [], [], [], []
    for lang in sorted(by):
        picked = sorted(by[lang], key=lambda x: x[0])
        x = np.zeros((len(picked), DIMS), np.float32)
        for i, (_, at, n) in enumerate(picked):
            x[i, at] = np.sqrt(n) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _spherical_k_means(x, min(centroids, len(picked)))
        owner += [len(names)] * len(c)
        names.append(lang)
        centres.append(c)
        floor.append(0.8 * float(np.quantile((x @ c.T).max(1), REJECT_QUANTILE)))
    table = np.concatenate(centres).T.copy() if centres else np.zeros((DIMS, 0), np.float32)
    return LanguageModel(tuple(names), np.array(owner, int), table, idf, np.array(floor))


def _spherical_k_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Unit centroids; starts with the row nearest the mean, then the row furthest from all chosen."""
    mean = x.mean(0)
    chosen = [int(np.argmax(x @ mean))]
    while len(chosen) < k:
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    c = x[chosen]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        new = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(k)])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` of every row's whole text. Null texts and texts
    without a letter are ``und`` with score 0. Ids are numbers and may repeat or be null; other columns
    are ignored. An empty table gives an empty result."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [model.predict(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = identify(docs, fit(docs.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
