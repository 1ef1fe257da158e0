"""Embedding near-dedup by cross-polytope hashing.

A unit vector is rotated by three rounds of random signs and the fast Hadamard transform; the hash
is the largest coordinate with its sign, a vertex of the cross-polytope. Several such hashes make a
bucket of a table. A vector enters the bucket of its best vertices and, as multiprobe, those in
which a rotation's second-best vertex takes its place: a pair is found in a table if any of its
buckets coincide, on either side's probing.

``plan`` chooses how many rotations make a bucket from the number of vectors, so that unlike vectors
rarely meet at any size, and how many tables a pair at the threshold needs to be missed with a
chance of at most ``MISS``.

Equal vectors are one class from the start. First only (bucket, id) pairs are shuffled: buckets of
one class drop out, and of buckets with the same members one stays. Then each class is fetched with
the list of its remaining buckets, once per bucket, and the cosines of a bucket are computed in
blocks. A pair is counted in the first bucket that both lists name. What leaves a block is one row
per class: how many vectors it links to there and which class of the block it is connected with.
Buckets of over ``BLOCK`` classes are split into blocks that meet pairwise in tasks of their own, so a
group of near copies costs arithmetic but neither one long task nor a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, col, connected_components, keep, materialize, runs_of, scratch

COSINE = 0.98
BLOCK = 1024
#: The chance that a pair at the threshold shares no bucket.
MISS = 1e-5
#: Expected share of other vectors' buckets in a bucket's place, which sets the number of rotations.
CROWD = 0.1
MOST_ROTATIONS = 6
#: Vectors are padded with zeros to this many components at least, or to the next power of two.
LEAST_WIDTH = 32
#: One id in so many is looked at to tell buckets that hold a large share of the rows.
HOT_SAMPLE = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    x = x.copy()
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def _width(dim: int) -> int:
    return max(LEAST_WIDTH, 1 << max(1, (dim - 1).bit_length()))


def vertices(x: np.ndarray, rotations: int, seed: int) -> np.ndarray:
    """(vector, rotation, 2): the best and the second-best vertex of each row under each rotation."""
    n, dim = x.shape
    d = _width(dim)
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    rng = np.random.default_rng(seed)
    out = np.empty((n, rotations, 2), np.int64)
    for r in range(rotations):
        y = padded
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], d)) / np.sqrt(d)
        top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
        size = np.take_along_axis(np.abs(y), top, 1)
        top = np.where((size[:, :1] < size[:, 1:]), top[:, ::-1], top)
        out[:, r] = 2 * top + (np.take_along_axis(y, top, 1) < 0)
    return out


@lru_cache(maxsize=256)
def plan(n: int, dim: int, cosine: float) -> tuple[int, int]:
    """``(tables, rotations)`` for ``n`` vectors of ``dim`` components that may meet.

    A rotation divides chance meetings by about the padded dimension over two; the hit rate of one
    table is measured on made-up pairs exactly at the threshold. Cosines of 0 or less, at which
    hashing cannot help, put all vectors in one bucket."""
    if cosine <= 0:
        return 1, 0
    rotations = 1
    while rotations < MOST_ROTATIONS and n > CROWD * float(_width(dim)) ** rotations:
        rotations += 1
    r = np.random.default_rng(7)
    x = r.normal(size=(min(2000, max(250, (1 << 17) // dim)), dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * z
    def hits(t: int) -> np.ndarray:
        a, b = (vertices(v, rotations, 987 + 31 * t + dim) for v in (x, y))
        return (a[:, :, :, None] == b[:, :, None, :]).any((2, 3)).all(1)

    missed = ~hits(0)
    rate = max(float(missed.mean()), 1e-3)
    tables = max(2, int(np.ceil(np.log(MISS) / np.log(min(rate + 0.01, 0.95)))))
    for t in range(1, tables):
        missed &= ~hits(t)
    while missed.any():  # in few dimensions tables are less independent
        missed &= ~hits(tables)
        tables += 1
    return tables, rotations


def buckets(x: np.ndarray, tables: int, rotations: int) -> np.ndarray:
    """(vector, table * 2**rotations) bucket numbers of the rows of ``x``; equal numbers mean equal
    vertices in all rotations of one table. The numbers of one vector differ."""
    n, dim = x.shape
    d = _width(dim)
    probes = 1 << rotations
    out = np.empty((n, tables * probes), np.int64)
    for t in range(tables):
        keys = np.zeros((n, 1), np.int64)
        for v in vertices(x, rotations, 987 + 31 * t + dim).transpose(1, 0, 2):
            keys = (keys[:, :, None] * (2 * d) + v[:, None, :]).reshape(n, -1)
        out[:, t * probes : (t + 1) * probes] = keys * tables + t
    return out


def block_links(ax: np.ndarray, bx: np.ndarray, a_lists: list, b_lists: list, bucket: int, cosine: float) -> np.ndarray:
    """Which rows of a link with which of b, as a matrix, pairs that share a smaller bucket left out."""
    linked = ax @ bx.T >= cosine
    if not linked.any():
        return linked
    # Smaller buckets that occur on both sides become columns of two 0/1 matrices.
    sides = []
    for lists in (a_lists, b_lists):
        rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        values = np.concatenate(lists)
        low = values < bucket
        sides.append((rows[low], values[low]))
    both = np.intersect1d(sides[0][1], sides[1][1])
    for lo in range(0, len(both), 4096):
        part = both[lo : lo + 4096]
        ones = []
        for (rows, values), n in zip(sides, linked.shape, strict=True):
            m = np.zeros((n, len(part)), np.float32)
            at = np.searchsorted(part, values)
            ok = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == values)
            m[rows[ok], at[ok]] = 1
            ones.append(m)
        linked &= ones[0] @ ones[1].T < 0.5
    return linked


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row it is connected with."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    ``id_col`` is a number. Vectors of equal label and length link if their cosine in double precision
    is at least ``cosine``. Null labels, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing: no links, a component of their own, kept. A null id is
    treated the same way with a null component. Rows that repeat an id count as rows of their own in
    ``n_links``. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    element = dict(vectors.dtypes)[vector_col]
    held = element if element in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(label_col).cast("string").alias("label"), col(vector_col).cast(held).alias("v"))
    fine = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    zero = F.lit(0.0).cast(held[6:-1])
    rows = rows.withColumn("v", F.when(fine, F.transform("v", lambda x: x + zero)))
    # 128 bits stand for a vector where rows and classes meet again, so vectors are not shuffled twice.
    digest = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    with scratch(spark):
        classes = materialize(
            rows.where(F.col("v").isNotNull()).groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).select("*", *digest), "classes"
        )
        found = _links(classes, cosine)
        parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        per_class = (
            classes.select("label", "h1", "h2", "id", "copies")
            .join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
            .join(parts, "id", "left")
            .select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
        )
        slim = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("label")).alias("label"), *digest)
        out = slim.join(per_class, ["label", "h1", "h2"], "left")
        component = F.coalesce("component", "vec_id")
        out = out.select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
        )
        return keep(materialize(out, "near_vectors"))


def _links(classes: DataFrame, cosine: float) -> DataFrame:
    """``id, links, root`` rows of the blocks in which a class has links."""
    spark = classes.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = classes.groupBy("label", F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v = part.column(0)
            flat, sizes = v.flatten().to_numpy().astype(float), np.diff(v.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            sigs: list = [None] * len(sizes)
            for d in np.unique(sizes):
                ks = np.flatnonzero(sizes == d)
                x = flat[starts[ks][:, None] + np.arange(d)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                for k, s in zip(ks, buckets(x, *plan(most, int(d), cosine)), strict=True):
                    sigs[k] = s
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(sizes, pa.int32()), pa.array(sigs, pa.list_(pa.int64()))], ["label", "id", "dim", "sigs"])

    signed = classes.select("v", "label", "id").mapInArrow(hashed, "label string, id long, dim int, sigs array<long>")
    entries = signed.select(F.explode("sigs").alias("s"), "label", "dim", "id").select(F.xxhash64("label", "dim", "s").alias("bucket"), "id")
    entries = materialize(entries, "entries")
    mark, mark2 = F.xxhash64(F.lit(2), "id"), F.xxhash64(F.lit(3), "id")
    members = [F.count("*").alias("n"), F.expr("bit_xor(xxhash64(2, id))").alias("m1"), F.expr("bit_xor(xxhash64(3, id))").alias("m2")]
    # An id has a fixed number of buckets, so at most about BROADCAST_ROWS / 4 of them have that many
    # sampled ids: a bound on what is broadcast, whatever the size of the table.
    floor = max(8, int(np.ceil(entries.count() / HOT_SAMPLE * 4 / BROADCAST_ROWS)))
    sampled = entries.where(F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(HOT_SAMPLE)) == 0)
    hot = materialize(sampled.groupBy("bucket").count().where(F.col("count") >= floor).select("bucket"), "hot_buckets")
    hot = F.broadcast(hot)
    # Other buckets: one shuffle of (bucket, id), counted where they land. Hot ones never move.
    of = entries.join(hot, "bucket", "left_anti").withColumns({"x1": mark, "x2": mark2})
    w = Window.partitionBy("bucket")
    usual = of.select("bucket", "id", F.count("*").over(w).alias("n"), F.expr("bit_xor(x1)").over(w).alias("m1"), F.expr("bit_xor(x2)").over(w).alias("m2")).where("n > 1")
    crowded = entries.join(hot, "bucket").groupBy("bucket").agg(*members)
    multi = materialize(usual, "shared").unionByName(entries.join(hot, "bucket").join(F.broadcast(materialize(crowded, "crowded")), "bucket").select("bucket", "id", "n", "m1", "m2"))
    # Of buckets with equal members the smallest stays.
    stays = multi.groupBy("n", "m1", "m2").agg(F.min("bucket").alias("bucket"))
    stays = materialize(stays.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")), "stays")
    lists = multi.select("bucket", "id").join(stays, "bucket").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("bucket", "chunks"))).alias("at"))
    fetched = classes.select("id", "v", "copies").join(lists, "id").select("id", "v", "copies", F.col("at.bucket").alias("buckets"), F.explode("at").alias("one"))
    fetched = fetched.select("id", "v", "copies", "buckets", F.col("one.bucket").alias("bucket"), F.col("one.chunks").alias("chunks"))
    # Block x meets block y in the task (x, y), x <= y.
    fetched = fetched.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("chunks")).cast("int"))
    met = fetched.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "copies", "buckets", "v"
    )
    tags = ["bucket", "x", "y"]
    met = met.repartition(shuffles, *tags).sortWithinPartitions(*tags)

    def solve(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        m = group.num_rows
        if m < 2:
            return None
        bucket, bx, by = (group.column(k)[0].as_py() for k in range(3))
        block, ids, copies = (group.column(k).to_numpy() for k in (3, 4, 5))
        lists = group.column(6)
        flat = lists.flatten().to_numpy()
        cuts = np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1]
        lists = np.split(flat, cuts)
        x = group.column(7).flatten().to_numpy().astype(float).reshape(m, -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        if bx == by:
            linked = np.triu(block_links(x, x, lists, lists, bucket, cosine), 1)
            i, j = np.nonzero(linked)
        else:
            p, q = np.flatnonzero(block == bx), np.flatnonzero(block == by)
            if not len(p) or not len(q):
                return None
            i, j = np.nonzero(block_links(x[p], x[q], [lists[k] for k in p], [lists[k] for k in q], bucket, cosine))
            i, j = p[i], q[j]
        if not len(i):
            return None
        links = np.bincount(i, copies[j], m) + np.bincount(j, copies[i], m)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(m, int)
        rank[order] = np.arange(m)
        root = ids[order[_roots(m, rank[i], rank[j])[rank]]]
        at = np.flatnonzero(links)
        return ids[at], links[at].astype(np.int64), root[at]

    def linked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in out])) for k in range(3)], ["id", "links", "root"])

        for group in runs_of(parts, 3):
            if f := solve(group):
                out.append(f)
                if len(out) >= 256:
                    yield batch()
                    out = []
        if out:
            yield batch()

    return materialize(met.mapInArrow(linked, "id long, links long, root long"), "links")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), counted AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.y FROM reach JOIN links ON links.x = reach.b
), parts AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT p.vec_id, coalesce(c.n, 0) AS n_links, p.component_id, p.vec_id = p.component_id AS kept
FROM parts p LEFT JOIN counted c ON c.x = p.vec_id
"""
