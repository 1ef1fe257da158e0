"""Token files in Simple-8b coding.

A corpus is a folder of shards in ascending order of document id. A shard is a Parquet container
whose rows are *pages* of whole documents (``PAGE`` schema); Spark's own writer and reader move
them, so any store that Spark reaches will do. A page's ids are cut into blocks of ``BLOCK`` ids,
each coded on its own:

* a 64-bit little-endian word holds a selector in its top four bits and ``SELECTORS[s]`` = (count,
  bits) values below, the first one lowest; the widest value set wins at each word, greedily;
* selector 0 is the escape: one value too wide for 60 bits, found in the page's ``escapes`` list;
* ``block_words`` and ``block_escapes`` have where each block's words and escapes begin, so a reader
  may decode all blocks at once (``read_tokens``) or only those it needs (``read_range``).

Coding and decoding run over arrays: all blocks of a page advance by one word per step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, col, materialize, shared_dir
from .tokens import batches, crc, encoder, tokenizer_path, with_end

#: Fixed values of the coding: how many ids of how many bits a word holds, by selector; 0 escapes.
SELECTORS = [
    (1, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
]
BLOCK = 512
PAGE_IDS = 1 << 18


_WIDTH16 = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def _widths(x: np.ndarray) -> np.ndarray:
    """The bit length of each value."""
    if int(x.max()) < 1 << 16:
        return _WIDTH16[x.astype(np.uint16)]
    out = np.zeros(x.shape, np.uint8)
    for shift in (48, 32, 16, 0):
        part = ((x >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        out = np.where((out == 0) & (part > 0), _WIDTH16[part] + np.uint8(shift), out)
    return out


def pack_words(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, block_words, escapes)`` of unsigned 64-bit ids."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    blocks = -(-n // block)
    grid = np.zeros(blocks * block, np.uint64)
    grid[:n] = ids
    width = _widths(grid)
    width[n:] = 255  # what lies behind the end fits nowhere
    width = np.ascontiguousarray(width.reshape(blocks, block).T)  # a row holds one position of all blocks
    choice = np.where(width <= 60, 15, 0).astype(np.uint8)  # the selector of a word that starts here
    widest, span = width.copy(), 1  # the widest of ``span`` values from here on
    for s in range(14, 0, -1):
        count, bits = SELECTORS[s]
        more = count - span
        np.maximum(widest[:-more], widest[more:], out=widest[:-more])
        widest[-more:] = 255
        span = count
        fits = widest <= bits
        if not fits.any():
            break  # what follows takes more values of fewer bits
        np.copyto(choice, s, where=fits)
    counts = np.array([c for c, _ in SELECTORS], np.int64)
    at = np.zeros(blocks, np.int64)
    rows = np.arange(blocks)
    ends = np.minimum(block, n - rows * block)
    starts = []  # (block, position) of each word, step by step
    while len(rows):
        starts.append(rows * block + at)
        at = at + counts[choice[at, rows]]
        go = at < ends
        rows, at, ends = rows[go], at[go], ends[go]
    first = np.sort(np.concatenate(starts))
    sel = choice[first % block, first // block]
    flat = grid
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        count, bits = SELECTORS[s]
        if bits:
            k = np.flatnonzero(sel == s)
            value = np.zeros(len(k), np.uint64)
            for j in range(count):
                value |= flat[first[k] + j] << np.uint64(j * bits)
            words[k] |= value
    block_words = np.searchsorted(first, np.arange(blocks) * block)
    return words, block_words, flat[first[sel == 0]]


def unpack_words(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All ids of a row of words (of any number of whole blocks) and their escapes."""
    words = np.asarray(words, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS], np.int64)[sel]
    out = np.zeros(int(counts.sum()), np.uint64)
    at = np.cumsum(counts) - counts
    for s in np.unique(sel):
        count, bits = SELECTORS[s]
        k = np.flatnonzero(sel == s)
        if s == 0:
            out[at[k]] = escapes[: len(k)]
        elif bits:
            mask = np.uint64((1 << bits) - 1)
            j = np.arange(count)
            out[at[k][:, None] + j] = (words[k][:, None] >> (j * bits).astype(np.uint64)) & mask
    return out


def block_escapes(words: np.ndarray, block_words: np.ndarray) -> np.ndarray:
    """How many escapes lie before each block."""
    before = np.concatenate([[0], np.cumsum((words >> np.uint64(60)) == 0)])
    return before[block_words]


def unpack_blocks(words: np.ndarray, escapes: np.ndarray, block_words: np.ndarray, escape_starts: np.ndarray, first: int, last: int) -> np.ndarray:
    """The ids of the blocks ``first`` to ``last`` (left out) of a page; no other word is looked at."""
    end = block_words[last] if last < len(block_words) else len(words)
    return unpack_words(words[block_words[first] : end], escapes[escape_starts[first] :])


PAGE = (
    "shard int, page int, first_id long, n_ids long, doc_ids array<long>, doc_sizes array<int>, "
    "block_words array<int>, block_escapes array<int>, escapes binary, words binary"
)


def write_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, shards: int | None = None
) -> str:
    """Encode all ``docs`` into token files under ``path`` (on storage that executors share).

    ``id_col`` is a number. Ids ascend over shards and within them (null first); rows of one id, or
    without any, stand in the order of their texts' hashes, so they may spread over shards. Every
    row is a document of its own; other columns are ignored. A null or empty text is the end id alone. An
    empty table gives an empty folder of files.
    """
    spark = docs.sparkSession
    source = tokenizer or tokenizer_path("byte_bpe_50k.json")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, page, before = encoder(source, "byte"), TaskContext.get().partitionId(), 0, 0
        keys: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal page, before, keys, held, sizes, total
            ids, each = np.concatenate(held), np.concatenate(sizes)
            words, block_words, escapes = pack_words(ids)
            one = lambda v, t: pa.array([v], t)
            out = pa.RecordBatch.from_arrays(
                [
                    one(shard, pa.int32()), one(page, pa.int32()), one(before, pa.int64()), one(len(ids), pa.int64()), one(keys, pa.list_(pa.int64())),
                    one(each.tolist(), pa.list_(pa.int32())), one(block_words.tolist(), pa.list_(pa.int32())),
                    one(block_escapes(words, block_words).tolist(), pa.list_(pa.int32())),
                    one(escapes.astype("<u8").tobytes(), pa.binary()), one(words.astype("<u8").tobytes(), pa.binary()),
                ],
                ["shard", "page", "first_id", "n_ids", "doc_ids", "doc_sizes", "block_words", "block_escapes", "escapes", "words"],
            )
            page, before, keys, held, sizes, total = page + 1, before + len(ids), [], [], [], 0
            return out

        for part in parts:
            ids_in, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lo, hi in batches(texts):
                ids, n = with_end(*enc.encode([t or "" for t in texts[lo:hi]]), end_id)
                ends, at = np.concatenate([[0], np.cumsum(n)]), 0
                while at < hi - lo:
                    to = min(int(np.searchsorted(ends, ends[at] + PAGE_IDS - total)), hi - lo)  # the document that fills the page is its last
                    keys += ids_in[lo + at : lo + to]
                    held.append(ids[ends[at] : ends[to]])
                    sizes.append(n[at:to])
                    total += len(held[-1])
                    at = to
                    if total >= PAGE_IDS:
                        yield flush()
        if keys:
            yield flush()

    rows.mapInArrow(run, PAGE).write.option("compression", "zstd").parquet(path)
    return path


def _pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages with ``ahead``, the number of ids in all shards before theirs."""
    pages = spark.read.schema(PAGE).parquet(path)
    # One row per file of the folder: as many as there were tasks.
    ahead, at = {}, 0
    for r in sorted(pages.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["shard"]):
        ahead[r["shard"]], at = at, at + r["n"]
    offsets = materialize(spark.createDataFrame(list(ahead.items()) or [(0, 0)], "shard int, ahead long"), "shard_offsets")
    return pages.join(bounded_broadcast(offsets, len(ahead)), "shard")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the token files: ``doc_id, start, n_tokens, ids_crc32, ids``.

    ``start`` counts the ids of all documents before; ``ids`` is an array of long, which ``with_ids``
    may leave out.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                ids = unpack_words(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["escapes"], "<u8"))
                sizes = np.array(r["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                slim = ids.astype("<u4")
                digests = [crc(slim[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
                out = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["ahead"] + r["first_id"] + ends - sizes), pa.array(sizes), pa.array(digests, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names)

    slim = _pages(spark, path).select("ahead", "first_id", "doc_ids", "doc_sizes", "escapes", "words")
    return slim.mapInArrow(run, schema)


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The ids ``start`` to ``stop`` (left out) of the whole corpus as rows ``(start, ids)``, a page each:
    pages outside the range are not decoded, nor are blocks of the others."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                base = r["ahead"] + r["first_id"]
                lo, hi = max(start - base, 0), min(stop - base, r["n_ids"])
                first, last = lo // BLOCK, -(-hi // BLOCK)
                ids = unpack_blocks(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["escapes"], "<u8"), np.array(r["block_words"]), np.array(r["block_escapes"]), first, last)
                ids = ids[lo - first * BLOCK : hi - first * BLOCK].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([base + lo], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], ["start", "ids"])

    begin = F.col("ahead") + F.col("first_id")
    hit = _pages(spark, path).where((begin < stop) & (begin + F.col("n_ids") > start) & F.lit(start < stop))
    return hit.select("ahead", "first_id", "n_ids", "block_words", "block_escapes", "escapes", "words").mapInArrow(run, "start long, ids array<long>")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = write_tokens(docs, f"{shared_dir(spark)}/tokens")
    return read_tokens(spark, path, with_ids=False)
