"""Near-dedup of texts by min-max hashing.

A text's set of word shingles is hashed by ``BANDS * ROWS / 2`` permutations, and both the smallest
and the largest value under each are kept: two nearly independent signature values for one
evaluation. ``ROWS`` values make a band; texts with an equal band share a bucket. Texts with equal
sets are one class from the start, so copies never meet each other again.

Candidates are verified on full sets. In a bucket every member is first compared with one pivot, in
chunks that each hold the pivot once; members that end up in one part need no comparison among
themselves. Where a bucket still holds
several parts, members of different parts are compared as well: a few by pairs, many in blocks whose
tasks send on one link a member. So what is moved and made follows the members of a bucket, not
their pairs, and yet no link between different parts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, connected_components, fresh, keep, materialize, scratch

BANDS = 30
ROWS = 4
WORDS = 2
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 80
#: Buckets of more members than this that are not connected yet are compared in blocks.
SMALL = 8
#: At most so many members or shingles of a side make a block, and so many members a pivot's chunk.
BLOCK = 512
BLOCK_SHINGLES = 4_000_000
STAR = 256

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's ``words``-word shingles, ascending; one hash of the whole
    sequence if it has fewer words, and none if it has no word. Only A-Z are lower-cased, words
    end at ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(h))
    n = len(h) - width + 1
    acc = np.full(n, width, np.uint64)
    for k in range(width):
        acc = _mix(acc * _M3 + h[k : k + n])
    return np.unique(acc)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240117)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(text, band) keys of non-empty sets."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    a, b = _permutations(bands * rows // 2)
    out = np.empty((len(sets), bands), np.uint64)
    half = rows // 2
    for band in range(bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for p in range(band * half, (band + 1) * half):
            y = x * a[p] + b[p]
            y ^= y >> np.uint64(32)
            for v in (np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)):
                key = _mix(key * _M3 + v)
        out[:, band] = key
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int, tag: Column | None = None) -> DataFrame:
    """``doc_id, n_shingles, k1, k2`` (128-bit hash of the set) and the band keys of every row, and ``tag``, a
    long that comes along, if it is given."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0), part.column(1)
            for lo in range(0, len(texts), 256):
                sets = [shingle_set(t, words) for t in texts.slice(lo, 256).to_pylist()]
                some = [s for s in sets if len(s)]
                keys = iter(band_keys(some, bands, rows).view(np.int64)) if some else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, 256), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array(np.array([np.bitwise_xor.reduce(_mix(s + _M3)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)),
                        pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                        *[c.slice(lo, 256) for c in part.columns[2:]],
                    ],
                    ["doc_id", "n_shingles", "k1", "k2", "bands", *["tag"] * tagged],
                )

    tagged = int(tag is not None)
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"), *([tag.alias("tag")] if tagged else [])).mapInArrow(
        run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>" + ", tag long" * tagged
    )


def alike(x: np.ndarray, y: np.ndarray, similar: int) -> bool:
    """Whether two full sets (ascending) have a Jaccard similarity of at least ``similar`` percent."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < similar * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= similar * (len(x) + len(y) - both)


def verified(pairs: DataFrame, texts: DataFrame, words: int, similar: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are similar enough."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, np.ndarray] = {}
        for part in parts:
            good = []
            for ta, tb in zip(part.column(2), part.column(3), strict=True):
                if len(known) > 64:
                    known.clear()
                pair = []
                for text in (ta.as_py(), tb.as_py()):
                    if text not in known:
                        known[text] = shingle_set(text, words)
                    pair.append(known[text])
                good.append(alike(*pair, similar))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), part.column(1).filter(pa.array(good))], ["a", "b"])

    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def star_links(members: DataFrame, texts: DataFrame, words: int, similar: int) -> DataFrame:
    """Links ``(a, b)`` between pivots and members of their buckets (``members``: id, pivot, n).

    A pivot's members are dealt into chunks of about ``STAR``, so neither its id nor its text is one key
    for all of them; a task reads the pivot first and the members one by one."""
    chunks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / STAR, F.lit(1.0))))).cast("long")
    dealt = members.where("id <> pivot").select("pivot", chunks.alias("of"), "id")
    dealt = dealt.select("pivot", "of", F.pmod(F.xxhash64(F.lit(4), "id"), F.col("of")).alias("chunk"), F.lit(1).alias("role"), "id").distinct()
    heads = dealt.select("pivot", "of", "chunk").distinct().select("*", F.lit(0).alias("role"), F.col("pivot").alias("id"))
    keys = ["pivot", "of", "chunk"]
    rows = dealt.unionByName(heads).join(texts, "id").select(*keys, "role", "id", "text")
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "role", "id")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for part in parts:
            good = []
            for role, text in zip(part.column(3).to_pylist(), part.column(5), strict=True):
                x = shingle_set(text.as_py(), words)
                if role == 0:
                    head = x
                good.append(role == 1 and alike(head, x, similar))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(4).filter(mask)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similar: int = SIMILAR,
    bands: int = BANDS,
    rows: int = ROWS,
    tag: Column | None = None,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row, and ``tag``, a long that tells rows of one id
    apart, if it is given.

    Texts link if their shingle sets have a Jaccard similarity of at least ``similar`` percent;
    ``id_col`` is a number. ``component_id`` is the smallest id reachable by links. At that similarity a pair shares no
    band with a chance of about 1e-7. A null or empty text, or one without words, has no shingles
    and links with nothing. A null id links with nothing, has a null component and is kept. Rows
    that repeat an id fall together if their texts are equal; else each has the component of its
    own text, and links found for the id count for either. Whole texts count, whatever their length;
    other columns are ignored. An empty table gives an empty result.
    """
    with scratch(docs.sparkSession):
        all_sketches = materialize(sketches(docs, id_col, text_col, words, bands, rows, tag), "sketches")
        named = all_sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
        first = F.min(F.struct("doc_id", "bands")).alias("first")
        classes = materialize(
            named.groupBy("k1", "k2", "n_shingles").agg(first).select("k1", "k2", "n_shingles", F.col("first.doc_id").alias("id"), F.col("first.bands").alias("bands")), "classes"
        )
        parts = _parts(docs, classes, id_col, text_col, words, similar)
        rep = classes.select("k1", "k2", "n_shingles", "id").join(parts, "id", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "id").alias("component"))
        out = all_sketches.drop("bands").join(rep, ["k1", "k2", "n_shingles"], "left")
        component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
        component = F.when(F.col("doc_id").isNotNull(), component)
        out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *(["tag"] if tag is not None else []))
        return keep(materialize(out, "near_copies"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that are no near copy of a row with a smaller id, columns unchanged.

    Rows are told apart by id and text, so different texts under one id are judged each for itself: all but the first
    of them (by hash) go in under numbers behind the largest id. Rows that repeat both stay or go
    together; rows without an id stay.
    """
    own, tag, new = fresh(docs, "mh_id", "mh_text", "mh_new")
    docs_ = docs.withColumns({own: col(id_col).cast("long"), tag: F.xxhash64(F.coalesce(col(text_col), F.lit("")))})
    seen = docs_.where(F.col(own).isNotNull()).select(own, tag).distinct()
    with scratch(docs.sparkSession):
        twice = materialize(seen.groupBy(own).agg(F.count("*").alias("n"), F.min(tag).alias("first")).where("n > 1").select(own, "first"), "repeated_ids")
        numbered, repeats = docs_, not twice.isEmpty()
        if repeats:
            most = docs_.agg(F.max(own)).first()[0]
            more = materialize(seen.join(twice, own).where(F.col(tag) != F.col("first")).select(own, tag, (F.lit(most + 1) + F.monotonically_increasing_id()).alias(new)), "further_texts")
            numbered = docs_.join(more.hint("merge"), [own, tag], "left").withColumn(own, F.coalesce(new, own)).drop(new)
        judged = near_duplicates(numbered, own, text_col, tag=F.col(tag), **settings)
        gone = judged.where("NOT kept").select(F.col("doc_id").alias(own), F.col("tag").alias(tag)).distinct()
        if repeats:
            back = more.select(F.col(own).alias(new), F.col(new).alias(own), tag)
            gone = keep(materialize(gone.join(back, [own, tag], "left").select(F.coalesce(new, own).alias(own), tag), "near_copies_gone"))
        else:
            keep(judged)
        return docs_.join(gone.hint("merge"), [own, tag], "left_anti").select(*[col(c) for c in docs.columns])


def _parts(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int, similar: int) -> DataFrame:
    """``(id, component)`` of the classes that have verified links: enough of them to connect whatever
    the buckets can connect."""
    each = classes.select("id", F.col("n_shingles").alias("w"), F.explode("bands").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = materialize(each.join(shared, "bucket").select("bucket", "id", "w", "pivot", "n"), "members")
    wanted = members.select("id").distinct()
    texts = materialize(docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).join(wanted.hint("merge"), "id", "left_semi"), "candidate_texts")
    links = materialize(star_links(members, texts, words, similar), "links")
    parts = connected_components(links)
    # Pivots are done with. What is left of a bucket matters if it lies in several parts.
    left = members.where("id <> pivot").select("bucket", "id", "w").join(parts, "id", "left").select("bucket", "id", "w", F.coalesce("component", "id").alias("part"))
    left = materialize(left, "left")
    sizes = left.groupBy("bucket", "part").agg(F.count("*").alias("c"), F.sum("w").alias("cw"))
    mixed = sizes.groupBy("bucket").agg(
        F.count("*").alias("parts"), F.sum("c").alias("m"), F.sum("cw").alias("mw"), F.max("c").alias("most"), F.max_by(F.struct("part", "cw"), F.struct("c", "part")).alias("top")
    )
    mixed = materialize(mixed.where("parts > 1").select("bucket", "m", "mw", "most", F.col("top.part").alias("major"), F.col("top.cw").alias("most_w")), "mixed")
    # Small buckets: their few pairs, each once. Large ones: blocks of members.
    small = left.join(mixed.where(F.col("m") <= SMALL).select("bucket"), "bucket")
    x, y = small.select("bucket", F.col("id").alias("a"), F.col("part").alias("pa")), small.select("bucket", F.col("id").alias("b"), F.col("part").alias("pb"))
    pairs = x.join(y, "bucket").where("a < b AND pa <> pb").select("a", "b").distinct()
    more = materialize(verified(pairs, texts, words, similar), "links").unionByName(
        materialize(_block_links(left, mixed.where(F.col("m") > SMALL), texts, words, similar), "links")
    )
    # Later links join the parts that there are.
    of = lambda c: parts.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
    more = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    joined = connected_components(more).select(F.col("id").alias("part"), F.col("component").alias("whole"))
    every = classes.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("part"))
    return every.join(joined, "part", "left").select("id", F.coalesce("whole", "part").alias("component"))


def shared_counts(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """How many elements each two sets share, as a matrix; elements of one set alone drop out first,
    the rest goes through a dense product in chunks of bounded size."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    number = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]]))
    often = np.bincount(number) > 1
    keep = often[number]
    number, owner = (np.cumsum(often) - 1)[number[keep]], owner[keep]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, chunk):
        a, b = np.searchsorted(number, [lo, lo + chunk])
        block = np.zeros((n, chunk), np.float32)
        block[owner[a:b], number[a:b] - lo] = 1
        out += block @ block.T
    return out


def _block_links(left: DataFrame, mixed: DataFrame, texts: DataFrame, words: int, similar: int) -> DataFrame:
    """Links between different parts of large buckets.

    A bucket's largest part and the rest are cut into blocks apart; every block of the rest meets
    itself and all others in a task of its own, while blocks of the largest part, connected as they
    are, do not meet each other. A task sends on at most one link for each member, enough to connect
    what it found connected.
    """
    spark = left.sparkSession
    up = lambda c, w: F.ceil(F.greatest(c / F.lit(BLOCK), w / F.lit(BLOCK_SHINGLES))).cast("int")
    plan = mixed.select("bucket", "major", up(F.col("most"), F.col("most_w")).alias("cm"), up(F.col("m") - F.col("most"), F.col("mw") - F.col("most_w")).alias("co"))
    rows = left.join(plan, "bucket")
    pick = F.xxhash64(F.lit(3), "id")
    in_major = F.col("part") == F.col("major")
    rows = rows.withColumn("block", F.when(in_major, F.pmod(pick, F.col("cm"))).otherwise(F.col("cm") + F.pmod(pick, F.col("co"))).cast("int"))
    others = F.sequence(F.col("cm"), F.col("cm") + F.col("co") - 1)
    meets = F.when(in_major, others).otherwise(F.concat(F.sequence(F.lit(0), F.col("cm") - 1), others))
    rows = rows.withColumn("with", F.explode(meets)).select(
        "bucket", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "id"
    )
    keys = ["bucket", "x", "y"]
    dealt = rows.join(texts, "id").select(*keys, "block", "id", "text")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "id")

    def solve(x: int, y: int, blocks: list, ids: list, sets: list) -> list[tuple[int, int]]:
        size = np.array([len(s) for s in sets], np.float32)
        both = shared_counts(sets)
        linked = 100 * both >= similar * (size[:, None] + size[None, :] - both)
        if x != y:
            side = np.array(blocks) == x
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        root = np.arange(len(ids))
        while True:  # ids ascend, so the smallest row is the smallest id
            low = np.minimum(root, np.where(linked, root[None, :], len(ids)).min(axis=1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        return [(ids[r], ids[k]) for k, r in enumerate(root) if r != k]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        blocks, ids, sets = [], [], []

        def out() -> pa.RecordBatch:
            found = solve(now[1], now[2], blocks, ids, sets) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for part in parts:
            cols = [part.column(i).to_pylist() for i in range(5)]
            for bucket, x, y, block, key, text in zip(*cols, part.column(5), strict=True):
                if (bucket, x, y) != now:
                    if now is not None:
                        yield out()
                    now, blocks, ids, sets = (bucket, x, y), [], [], []
                if ids and ids[-1] == key:
                    continue
                blocks.append(block)
                ids.append(key)
                sets.append(shingle_set(text.as_py(), words))
        if now is not None:
            yield out()

    return dealt.mapInArrow(run, "a long, b long")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, words=WORDS)


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), inter AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM inter JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.y FROM reach JOIN links ON links.x = reach.b
), parts AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT p.doc_id, coalesce(s.n, 0) AS n_shingles, p.component_id, p.doc_id = p.component_id AS kept
FROM parts p LEFT JOIN sizes s ON s.doc_id = p.doc_id
"""
