"""A training corpus out of ``documents``: five stages, each an operator of ``barloom.llm``.

Each stage takes all rows that the one before kept and returns a table which is written as Parquet
and read again as the next stage's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import line_dedup as lines
from barloom.llm import minhash, mixing, packing
from barloom.llm import quality_rules as rules
from barloom.llm.common import delete_path, keep, materialize, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a rule learned from ``labels`` go."""
    return rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the smallest id alone; no document goes."""
    out = lines.dedup_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays."""
    return minhash.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the production weights, in one global shuffled order."""
    return mixing.mix(docs, weights=mixing.WEIGHTS, tags=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens with their ids, and a digest of them; a copy is a document of its own."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned rules, hashed signatures and subword merges are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's tables go once its result is written, and that goes once
    the next stage is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            done = keep(materialize(stage(spark, docs, sf_dir), name))
        before, docs = getattr(docs, "_scratch_path", None), done
        if before:
            delete_path(spark, before)
    return docs
