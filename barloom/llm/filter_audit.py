"""Which filter of a chain is to blame: an audit of every order of a few filters.

A filter is applied behind some subset of the others, so with k filters there are k * 2^(k-1) edges
of the subset lattice ((subset already applied, next filter): 80 for five), while there are k! * k
steps of orders (600). Documents fall into few classes, one for each part and set of failed filters;
those are counted first, where the documents are read. A class then contributes to all edges, and
an order's step is a lookup of its edge: an order is a path through the lattice. Nothing is counted
once per order.

What stays and what a filter would do twice depends on the subset alone, never on its order, so edges
hold all that steps need. The Shapley share of a filter is a weighted sum over its edges: the subset S
stands before the filter in |S|! (k - 1 - |S|)! of the orders.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_WS, col, fresh

#: Seven filters have 35,280 steps, which is the most that is broadcast.
MOST_FILTERS = 7

WORD_GAP = r"[\x20\x09-\x0D]+"
ODD = "[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails"]


def text_failures(text: Column) -> dict[str, Column]:
    """The four filters that look at one text: too few words (A), too few distinct ones (B), too many
    capitals (C), an odd character (D). Null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    bare = F.btrim(t, F.lit(ASCII_WS))
    blank = (bare == "").cast("int")
    words = F.split(bare, WORD_GAP)
    n, distinct = F.size(words) - blank, F.size(F.array_distinct(words)) - blank
    capitals = F.octet_length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": F.lit(100) * distinct.cast("long") < F.lit(80) * n.cast("long"),
        "C": F.lit(100) * capitals.cast("long") > F.lit(10) * F.char_length(t).cast("long"),
        "D": t.rlike(ODD),
    }


def failure_classes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``docs`` counted by part and by the set of filters they fail: ``part, mask, n, good_lost,
    toxic_lost`` (bit k of ``mask``: filter k of ABCDE; the last two count labelled documents).

    Filter E fails a text that a smaller id has too, anywhere in the table. Texts are compared by two
    64-bit hashes and their length; copies are counted by (text, part, labels) before they meet, so a text
    that a third of all rows share is a few rows per task. Rows that repeat an id count each; a null id
    is no smaller than any other and has none smaller. Of several labels of one id the larger counts.
    """
    fails = text_failures(col(text_col))
    mask = reduce(lambda a, b: a + b, [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails.values())])
    t = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(
        col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"),
        F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"), F.octet_length(t).alias("size"),
    )
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")
    )
    text = ["h1", "h2", "size"]
    # Rows of one id lie together behind the join, so this costs no further shuffle.
    same = rows.join(known, "id", "left").na.fill(0, ["good", "toxic"]).groupBy("id", *text, "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    copies = same.groupBy(*text, "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id")
    )
    met = copies.withColumn("owner", F.min("first.id").over(Window.partitionBy(*text)))
    # Of a class of copies the rows of the smallest id pass E, and so do those without an id.
    spared = F.col("no_id") + F.when(F.col("first.id") == F.col("owner"), F.col("first.n")).otherwise(0)
    split = met.select("part", "mask", "good", "toxic", F.explode(F.array(F.struct(spared.alias("n"), F.lit(0).alias("e")), F.struct((F.col("n") - spared).alias("n"), F.lit(1 << len(fails)).alias("e")))).alias("x")).where("x.n > 0")
    return split.groupBy("part", (F.col("mask") + F.col("x.e")).alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good_lost"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic_lost")
    )


def lattice_edges(classes: DataFrame, n_filters: int, lost: list[str]) -> DataFrame:
    """Every class (``part, mask, n`` and counts named in ``lost``) on all edges, summed: ``part, filter,
    applied`` (bits of the subset before it), the counts of ``COUNTS``, ``lost`` and ``shapley``."""
    half = 1 << (n_filters - 1)
    edge = classes.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(n_filters * half - 1))))
    f, s = (F.col("edge") / half).cast("int"), F.col("edge") % half
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    # The subset's bits make room for the filter's own, which stays 0.
    at = edge.withColumns({"filter": f, "s": s}).withColumn("bit", bit).withColumn("applied", (F.col("s") % F.col("bit")) + (F.col("s") - F.col("s") % F.col("bit")) * 2)
    there, fails = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    tally = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    out = at.groupBy("part", "filter", "applied").agg(
        tally("n", there & ~fails).alias("kept"), tally("n", there & fails).alias("removed"), tally("n", ~there & fails).alias("redundant"),
        tally("n", F.col("mask") == F.col("bit")).alias("unique_fails"), *[tally(c, there & fails).alias(c) for c in lost],
    )
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n_filters - 1 - k)) for k in range(n_filters)]), F.bit_count("applied") + 1)
    shares = out.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    return out.join(shares, ["part", "filter"])


def audit(classes: DataFrame, names: str = "ABCDE", lost: tuple[str, ...] = ("good_lost", "toxic_lost")) -> DataFrame:
    """One row per part, order of the filters and step, zeros included. ``classes`` has one row or more
    per part and set of failed filters (``part, mask, n`` and the counts of ``lost``). A table without
    rows gives none."""
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters can be audited in all orders")
    steps = [("".join(p), k + 1, names.index(x), sum(1 << names.index(y) for y in p[:k])) for p in permutations(names) for k, x in enumerate(p)]
    paths = classes.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, applied int")
    edges = lattice_edges(classes, len(names), list(lost))
    return edges.join(F.broadcast(paths), ["filter", "applied"]).select("part", "filter_order", "step", *COUNTS, *lost, "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(failure_classes(docs, labels))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
  SELECT d.*, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts d
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), classes AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM judged LEFT JOIN known ON judged.doc_id = known.doc_id GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b
), orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters u WHERE p.b + q.b + r.b + s.b + u.b = 31 AND p.b | q.b | r.b | s.b | u.b = 31
), steps AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest(bits) AS bit, unnest([0, bits[1], bits[1] + bits[2], bits[1] + bits[2] + bits[3], bits[1] + bits[2] + bits[3] + bits[4]]) AS applied FROM orders
), counted AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & applied <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM classes, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
