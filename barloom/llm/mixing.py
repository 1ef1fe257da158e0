"""Mixing sources to target weights by Poisson replication.

Sizes of all sources are counted exactly. A source's mean repetition rate is its share of the
target total over its own size. Each document draws its number of copies by inverting the Poisson
distribution of its source's rate at a uniform number hashed from seed and id, so the draw is the
same on any cluster and for any partitioning. Copies are exploded and put in one global order of
hashed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, col, fresh, materialize

#: Poisson quantiles beyond mean + 12 deviations + 30 have no share that a 52-bit number can hit.
DEVIATIONS, MARGIN = 12, 30


def hashed_uniform(*parts: Column) -> Column:
    """A number in (0, 1) of 52 bits from MD5, which other engines compute alike."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def poisson_table(rate: Column) -> Column:
    """The cumulative probabilities of 0, 1, 2, … copies; the logarithms keep high rates in range."""
    last = F.ceil(rate + DEVIATIONS * F.sqrt(rate) + MARGIN).cast("int")
    zero = F.struct((-rate).alias("lp"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        lp = acc["lp"] + F.log(rate) - F.log(k.cast("double"))
        c = acc["c"] + F.exp(lp)
        return F.struct(lp.alias("lp"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda acc: acc["all"])).otherwise(F.array(F.lit(1.0)))


def key_of(seed: int, id_col: str, copy: str) -> Column:
    """The hashed key that orders all copies."""
    return F.xxhash64(F.lit(seed), col(id_col), F.col(copy))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    total: float | None = None,
    seed: int = 17,
    tags: bool = True,
) -> DataFrame:
    """Rows of ``docs`` repeated so that each source's expected share of characters is its weight.

    ``weights`` maps sources to relative weights, ``default_weight`` holds for all others (null is a
    source of its own); ``total`` is the target number of characters, by default that of the
    corpus. With ``tags`` the result has ``copy`` (1, 2, …), ``rate`` and ``mix_key`` (the global
    order, ascending over partitions) behind the columns of ``docs``; columns of these names are
    replaced.

    A source of no characters has rate 0 and yields nothing, like a weight of 0. Repeated rows with
    one id draw the same number of copies. A null id draws like any other value. An empty table
    gives an empty result. Sizes are read from the texts, not from a stored count.
    """
    if tags:
        docs = docs.drop("copy", "rate", "mix_key")
    src, chars, cdf, rate, copy, key = fresh(docs, "mx_source", "mx_chars", "mx_cdf", "mx_rate", "mx_copy", "mx_key")
    sized = docs.withColumn(src, col(source_col).cast("string"))
    sizes = sized.groupBy(src).agg(F.sum(F.char_length(F.coalesce(col(text_col), F.lit("")))).cast("double").alias("size"))
    weight = F.lit(float(default_weight))
    for name, w in sorted((weights or {}).items()):
        weight = F.when(F.col(src) == name, F.lit(float(w))).otherwise(weight)
    sizes = materialize(sizes.withColumn("weight", weight), "source_sizes")
    n_sources, size_all, weight_all = sizes.agg(F.count("*"), F.sum("size"), F.sum(F.when(F.col("size") > 0, F.col("weight")))).first()
    target = float(total if total is not None else size_all or 0.0)
    rates = sizes.withColumn(
        rate,
        F.when((F.col("size") > 0) & (F.col("weight") > 0), F.lit(target) * (F.col("weight") / F.lit(float(weight_all or 1.0))) / F.col("size")).otherwise(0.0),
    )
    tables = materialize(rates.select(F.col(src).alias(f"{src}_r"), rate, poisson_table(F.col(rate)).alias(cdf)), "source_rates")
    joined = sized.join(bounded_broadcast(tables, n_sources), F.col(src).eqNullSafe(F.col(f"{src}_r")))
    u = hashed_uniform(F.lit(seed), col(id_col))
    drawn = joined.withColumn(copy, F.size(F.filter(F.col(cdf), lambda c: c < u))).where(F.col(copy) > 0)
    copies = drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    # Hashed keys are uniform, so ranges of equal width are even and need no sampling: every row is
    # computed and moved once.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((key_of(seed, id_col, copy).cast("double") / 2.0**64 + 0.5) * n))).cast("int")
    ordered = copies.withColumn(key, key_of(seed, id_col, copy)).repartitionById(n, place).sortWithinPartitions(key)
    kept = [col(c) for c in docs.columns]
    if tags:
        kept += [F.col(copy).alias("copy"), F.col(rate).alias("rate"), F.col(key).alias("mix_key")]
    return ordered.select(*kept)


#: Production weights: all sources alike, one of them at half.
WEIGHTS = {"src0": 0.5}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, weights=WEIGHTS).select("doc_id", "text", "lang", "source", "n_chars", "copy", F.round("rate", 6).alias("rate"))


OP1_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, sum(length(coalesce(text, ''))) * 1e0 AS size,
         CASE WHEN source = 'src0' THEN 0.5e0 ELSE 1e0 END AS weight
  FROM documents GROUP BY source
), totals AS (
  SELECT sum(size) AS size_all, sum(CASE WHEN size > 0 THEN weight END) AS weight_all FROM sizes
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN size_all * (weight / weight_all) / size ELSE 0e0 END AS rate FROM sizes, totals
), cdf(source, rate, k, lp, c) AS (
  SELECT source, rate, 0, -rate, CASE WHEN rate > 0 THEN exp(-rate) ELSE 1e0 END FROM rates
  UNION ALL
  SELECT source, rate, k + 1, lp + ln(rate) - ln((k + 1) * 1e0), c + exp(lp + ln(rate) - ln((k + 1) * 1e0))
  FROM cdf WHERE rate > 0 AND k < ceil(rate + 12 * sqrt(rate) + 30)
), drawn AS (
  SELECT d.*, r.rate, (CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) * 1e0 + 0.5e0) / 4503599627370496e0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.rate, count(*) AS n
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c < d.u
  GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy, round(rate, 6) AS rate FROM counted
"""
