"""Line dedup over levelled sorted runs of line hashes.

The corpus goes in as batches of ascending document ids. The set of lines seen so far lives in
*runs*: tables bucketed and sorted by the line's 128-bit hash, each row with the document that owns
the line. A batch reduces its own lines to one owner per hash, merge-anti-joins that against every
run (both sides bucketed alike, so a run is neither shuffled nor sorted again) and writes what is
left as a new run of level 0. When a level holds ``fanout`` runs they are merged into one run of the
next level, so the number of runs to join stays logarithmic in the number of batches.

A line of a document survives if and only if the runs name that document as its owner. That test
is an anti-join on (hash, document), which spreads a line found in a third of all documents as
evenly as any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_WS, ascii_lower, col, delete_path, fresh, materialize, shared_dir

SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def split_lines(text: Column) -> Column:
    """All lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_WS)))


class LineRuns:
    """The levelled runs ``(h1, h2, owner)`` on shared storage."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        # As many buckets as a shuffle has partitions: what a group-by on the hash yields is then
        # laid out like a run already.
        self.spark, self.buckets, self.fanout = spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout
        self.root, self.tag = shared_dir(spark), uuid.uuid4().hex[:12]
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{self.tag}_{self.made}"
        self.made += 1
        (
            rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("path", f"{self.root}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
        )
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, f"{self.root}/{name}")

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in reversed(self.levels) for n in level]

    def unseen(self, owners: DataFrame) -> DataFrame:
        """The rows of ``owners`` (partitioned by hash) whose hash is in no run yet."""
        for run in self.tables():
            owners = owners.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return owners

    def add(self, owners: DataFrame) -> DataFrame:
        """Write rows that no run holds as a run of level 0, then compact; returns those rows."""
        name = self._write(owners)
        rows = self.spark.table(name)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        return rows

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            names = self.levels[level]
            if len(names) >= self.fanout:
                merged = self.spark.table(names[0])
                for n in names[1:]:
                    merged = merged.unionByName(self.spark.table(n))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(merged.repartition(self.buckets, "h1", "h2")))
                self.levels[level] = []
                for n in names:
                    self._drop(n)
            level += 1

    def close(self) -> None:
        for level in self.levels:
            for n in level:
                self._drop(n)
        self.levels = []


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    n_batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` added.

    A line's key is the line stripped of ASCII white space with A-Z in lower case. A key of at least
    ``min_chars`` code points that is found in two or more documents loses its lines everywhere but
    in the smallest id that holds it, where all of them stay.

    Null or empty text: one empty line, kept text "". Rows that repeat an id are the same document:
    neither takes a line from the other. A row whose id is null owns nothing and loses nothing. An
    empty table gives an empty result. Other columns pass through; columns of the three new names
    are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    d, th, dropped, lines = fresh(docs, "ld_id", "ld_hash", "ld_dropped", "ld_lines")
    tagged = docs.withColumn(d, col(id_col)).withColumn(th, F.xxhash64(col(text_col)))

    bounds = docs.where(col(id_col).isNotNull()).agg(
        F.percentile_approx(col(id_col), [k / n_batches for k in range(1, n_batches)] or [0.5], 1000)
    ).first()[0] or []
    batch = F.lit(0)
    if n_batches > 1:
        for b in sorted(set(bounds)):
            batch = batch + (F.col("d") > F.lit(b)).cast("int")
    each = (
        tagged.where(F.col(d).isNotNull())
        .select(F.col(d).alias("d"), F.col(th).alias("th"), F.posexplode(split_lines(col(text_col))).alias("pos", "line"))
        .select("d", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(batch.alias("batch"), "d", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    held = materialize(each, "lines", ["batch"])

    runs = LineRuns(spark, fanout)
    before = spark.conf.get(SORTED_SCAN, None)
    spark.conf.set(SORTED_SCAN, "true")
    losses = []
    try:
        for k in range(len(set(bounds)) + 1 if n_batches > 1 else 1):
            part = held.where(F.col("batch") == k)
            owners = part.groupBy("h1", "h2").agg(F.min("d").alias("owner"))
            mine = runs.add(runs.unseen(owners)).select("h1", "h2", F.col("owner").alias("d"))
            lost = part.join(mine, ["h1", "h2", "d"], "left_anti")
            losses.append(materialize(lost.groupBy("d", "th").agg(F.collect_set("pos").alias("gone")), f"lost{k}"))
            runs.compact()
        delete_path(spark, held._scratch_path)
    finally:
        runs.close()
        if before is None:
            spark.conf.unset(SORTED_SCAN)
        else:
            spark.conf.set(SORTED_SCAN, before)

    lost = losses[0]
    for more in losses[1:]:
        lost = lost.unionByName(more)
    lost = lost.select(F.col("d").alias(d), F.col("th").alias(th), F.col("gone").alias(dropped))
    # What is lost grows with the corpus: a shuffled join at any size, never a broadcast.
    joined = tagged.join(lost.hint("merge"), [d, th], "left").withColumn(lines, split_lines(col(text_col)))
    # Positions are distinct, so array_except keeps their order and works through a hash set.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
    return (
        joined.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size(dropped), F.lit(0)).cast("long"))
        .withColumn(
            "kept_text",
            F.when(F.col(dropped).isNull(), F.coalesce(col(text_col), F.lit("")))
            .otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")),
        )
        .select(*[col(c) for c in docs.columns], "n_lines", "n_dropped", "kept_text")
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k
), judged AS (
  SELECT l.doc_id, l.pos, l.line, (o.owner IS NULL OR o.owner = l.doc_id) AS stays
  FROM keyed l LEFT JOIN owners o ON l.k = o.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
