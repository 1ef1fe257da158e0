"""Packing token sequences: vector bin packing by a dot-product heuristic.

A sequence has three capacities at once: tokens, segments (pieces) and loss-bearing tokens. Full
sequences are cut off long documents directly. What remains of each document waits in a pool of
fixed size; a sequence is filled by the waiting piece whose demand vector has the largest dot
product with what is left of the capacities, both as shares, among those that fit. When none fits,
the best one is cut so that the sequence closes full; if segments or loss run out earlier, the
sequence is trimmed to a power of two, a length that needs no padding. The last pieces of a task are
cut at powers of two the same way.

Each task packs the rows it reads, so nothing is shuffled and a hot source, a long document or a
repeated id has no effect on the balance. Memory is bounded by the pool and one batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col
from .tokens import batches, encoder, tokenizer_path, with_end

POOL = 256


class Packer:
    """Takes documents one by one; yields pieces ``(key, doc_tokens, start, ids, sequence, offset)``."""

    def __init__(self, length: int = 2048, max_segments: int = 64, max_loss: int = 2048, pool: int = POOL):
        if length < 1 or length & (length - 1) or max_segments < 1 or max_loss < 1:
            raise ValueError("length must be a power of two, the other limits at least 1")
        self.length, self.max_segments, self.max_loss, self.pool = length, max_segments, max_loss, pool
        self.items: list[tuple | None] = [None] * (pool + max_segments + 2)
        self.tok = np.zeros(len(self.items))
        self.loss = np.zeros(len(self.items))
        self.free = list(range(len(self.items)))
        self.sequence = 0
        self.out: list[tuple] = []

    def _loss(self, item: tuple, n: int) -> int:
        start, no_loss = item[2], item[4]
        return max(0, start + n - max(start, no_loss))

    def _most(self, item: tuple, tokens: int, loss: int) -> int:
        """How many tokens of an item fit both capacities."""
        return min(len(item[3]), tokens, max(0, item[4] - item[2]) + loss)

    def _wait(self, item: tuple) -> None:
        k = self.free.pop()
        self.items[k] = item
        self.tok[k], self.loss[k] = len(item[3]), self._loss(item, len(item[3]))

    def _take(self, k: int) -> tuple:
        item = self.items[k]
        self.items[k] = None
        self.tok[k] = self.loss[k] = 0
        self.free.append(k)
        return item

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, total, start, ids, _ in pieces:
            self.out.append((key, total, start, ids, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def _cut(self, item: tuple, n: int) -> tuple[tuple, tuple | None]:
        key, total, start, ids, no_loss = item
        rest = (key, total, start + n, ids[n:], no_loss) if n < len(ids) else None
        return (key, total, start, ids[:n], no_loss), rest

    def add(self, key, ids: np.ndarray, no_loss: int = 0) -> None:
        """One document: its ids, and how many at its start bear no loss."""
        total, at = len(ids), 0
        while total - at >= self.length and self._loss((key, total, at, None, no_loss), self.length) <= self.max_loss:
            self._emit([(key, total, at, ids[at : at + self.length], no_loss)])
            at += self.length
        if at < total:
            self._wait((key, total, at, ids[at:].copy(), no_loss))
        while len(self.items) - len(self.free) > self.pool:
            self._fill()

    def _fill(self) -> None:
        tokens, segments, loss = self.length, self.max_segments, self.max_loss
        pieces: list[tuple] = []
        while tokens and segments:
            live = self.tok > 0
            fits = live & (self.tok <= tokens) & (self.loss <= loss)
            score = self.tok * (tokens / self.length**2) + self.loss * (loss / self.max_loss**2) + segments / self.max_segments**2
            # The last segment should close the sequence: something longer than the gap, if there is.
            if fits.any() and (segments > 1 or not (live & (self.tok > tokens)).any()):
                k = int(np.argmax(np.where(fits, score, -1.0)))
                item = self._take(k)
                pieces.append(item)
                n = len(item[3])
            elif live.any():
                k = int(np.argmax(np.where(live, score, -1.0)))
                n = self._most(self.items[k], tokens, loss)
                if n == 0:
                    break
                head, rest = self._cut(self._take(k), n)
                pieces.append(head)
                if rest:
                    self._wait(rest)
            else:
                break
            tokens, segments, loss = tokens - n, segments - 1, loss - self._loss(pieces[-1], n)
        used = self.length - tokens
        over = used - (1 << (used.bit_length() - 1))
        while over:
            last = pieces.pop()
            if len(last[3]) <= over:
                over -= len(last[3])
                self._wait(last)
            else:
                head, rest = self._cut(last, len(last[3]) - over)
                pieces.append(head)
                self._wait(rest)
                over = 0
        self._emit(pieces)

    def finish(self) -> None:
        while len(self.free) < len(self.items):
            self._fill()


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    no_loss_col: str | None = None,
    tokenizer: str | None = None,
    end_id: int = 1,
    length: int = 2048,
    max_segments: int = 64,
    max_loss: int | None = None,
) -> DataFrame:
    """The pieces of all ``docs``; ``ids`` holds a piece's ids as little-endian unsigned 32-bit.

    A document is its text's ids with ``end_id`` behind them; a null or empty text is that id alone.
    ``no_loss_col`` names a long column with the number of leading tokens that bear no loss (a
    prompt); without it, or where it is null, all bear loss. A sequence has at most ``length``
    tokens, ``max_segments`` pieces and ``max_loss`` (default ``length``) loss-bearing tokens.
    Every row is a document of its own: repeated ids are packed once per row, null ids stay null.
    An empty table gives no pieces. Other columns are ignored. ``sequence_id`` is unique in the
    result, made of the task and a count.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    max_loss = length if max_loss is None else max_loss
    no_loss = F.coalesce(col(no_loss_col).cast("long"), F.lit(0)) if no_loss_col else F.lit(0)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"), no_loss.cast("long").alias("no_loss"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path, "word"), Packer(length, max_segments, max_loss)
        base = TaskContext.get().partitionId() << 40

        def flush() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            longs = lambda v: pa.array(v, pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    longs([x[0] for x in out]), longs([x[2] for x in out]), longs([len(x[3]) for x in out]), longs([x[1] for x in out]),
                    longs([base + x[4] for x in out]), longs([x[5] for x in out]), pa.array([x[3].astype("<u4").tobytes() for x in out], pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for part in parts:
            keys, skips, texts = part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(1).to_pylist()
            for lo, hi in batches(texts):
                ids, sizes = with_end(*enc.encode([t or "" for t in texts[lo:hi]]), end_id)
                ends = np.cumsum(sizes)
                for k in range(hi - lo):
                    packer.add(keys[lo + k], ids[ends[k] - sizes[k] : ends[k]], skips[lo + k])
                if packer.out:
                    yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    return rows.mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(pack(docs))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
