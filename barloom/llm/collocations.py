"""Phrases that belong together, mined from position bitmaps.

The corpus is cut into shards of whole documents. A shard gives each word occurrence a position (the
end of a piece takes one too, so nothing spans two pieces) and keeps a compressed bitmap of its
positions per word: only 16-bit blocks that are not zero, each with its number. A phrase's bitmap
marks where it ends: that of the phrase without its last word, shifted by one, AND the bitmap of
that word. Its popcount is the phrase's count in the shard, and sums over shards are counts of the corpus.

A shard walks the tree of phrases depth first, a group of first words at a time, and meets only words
that have a bit in the blocks its shifted bitmaps touch. Support is a matter of the whole corpus, so the walk is
made once per length, and each goes down only through what may be frequent in all shards together: words and
pairs are first counted by hash, which can only count too much, and the hashes with support become a filter of bounded
size that every shard gets. What passes is counted exactly, so a full filter costs time and no results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, col, keep, materialize, scratch

#: A phrase must occur so often in its part of the corpus.
SUPPORT = 10
#: A phrase inside a longer candidate that makes up this percentage of it is dropped.
COVERED = 50
FIRST = 2000
#: Positions after which a shard is closed; one document is never cut.
POSITIONS = 1 << 20
#: Pairs of blocks compared at once.
MEETINGS = 1 << 18
#: The size that a filter of hashes has at most: 16 MB. Every Python worker holds one of words and one of pairs.
FILTER_BITS = 1 << 27
#: Bytes of texts that are cut into words at once, about; one text at least.
TEXT_BYTES = 1 << 22
#: Rows that a shard hands over at once.
ROWS = 1 << 16
WIDTH = 16

_END = b"\xff"  # no byte of UTF-8
#: A-Z in lower case, every end of a piece as an end mark, the tab as a blank.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _END * 10 + b" ")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row as bytes, A-Z in lower case, with an end mark behind each piece, and how many
    words and marks each text has."""
    rows = pc.binary_join_element_wise(texts.cast(pa.binary()).fill_null(b""), pa.scalar(b"", pa.binary()), pa.scalar(_END, pa.binary()))
    _, begins, data = rows.buffers()
    begins = np.frombuffer(begins, np.int32, len(rows) + 1)
    raw = np.frombuffer(data.to_pybytes()[: begins[-1]].translate(_FOLD), np.uint8)
    full, first = raw != 32, raw == 255
    # An end mark stands for itself; a word begins behind a blank, an end mark or nothing.
    first[1:] |= full[1:] & (first[:-1] | ~full[:-1])
    first[:1] |= full[:1]
    raw = raw[full]
    offsets = np.append(np.flatnonzero(first[full]), len(raw)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return words, np.add.reduceat(first, begins[:-1], dtype=np.int64)


def bitmaps_of(at: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words 1 to ``n_words`` - 1 in a sequence of word numbers: blocks and their bits by word, and where
    each word's begin."""
    key = at.astype(np.int64) << 32
    key |= np.arange(len(at))
    key.sort()
    key = key[np.searchsorted(key, 1 << 32) :]
    word, pos = (key >> 32).astype(np.int32), key.astype(np.uint32)
    del key
    block = pos // np.uint32(WIDTH)
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])]) if len(word) else np.zeros(0, np.int64)
    bits = np.bitwise_or.reduceat(np.left_shift(np.uint16(1), (pos % np.uint32(WIDTH)).astype(np.uint16)), first) if len(word) else np.zeros(0, np.uint16)
    starts = np.searchsorted(word[first], np.arange(1, n_words + 1))
    return block[first], bits, starts


def packed(sizes: np.ndarray, blocks: np.ndarray, bits: np.ndarray) -> tuple[bytes, int]:
    """A shard's bitmaps compressed, as tasks hold several shards at a time, and their size before."""
    raw = sizes.astype("<i4").tobytes() + blocks.astype("<u2" if not len(blocks) or blocks.max() < 1 << 16 else "<u4").tobytes() + bits.astype("<u2").tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def unpacked(data: pa.Buffer, size: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``packed`` was given for ``n_words`` words."""
    raw = pa.decompress(data, decompressed_size=size, codec="zstd")
    sizes = np.frombuffer(raw, "<i4", n_words)
    n = int(sizes.sum())
    blocks = np.frombuffer(raw, "<u2" if size == 4 * n_words + 4 * n else "<u4", n, 4 * n_words)
    return sizes, blocks, np.frombuffer(raw, "<u2", n, size - 2 * n)


BITMAPS = "shard long, ids array<long>, n array<long>, part array<string>, text array<string>, bitmaps binary, raw_size long"


def word_bitmaps(docs: DataFrame, text_col: str = "text", part_col: str = "lang", positions: int = POSITIONS, seed: int = 0) -> DataFrame:
    """One row per shard: its words (``ids`` are hashes of part and word, ``n`` occurrences), and ``packed`` how many
    blocks each has, and the blocks and bits of all bitmaps one behind the other. ``part`` is the value of ``part_col``
    (null: ``und``); words of different parts are different words. Block numbers take 2 bytes, in a shard of a very
    long document 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        names: dict[str, int] = {}
        held: list[pa.Array] = []
        owners: list[np.ndarray] = []
        n = 0

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        def close() -> pa.RecordBatch:
            nonlocal shard, n
            coded = pa.chunked_array(held).dictionary_encode().chunks
            distinct = coded[0].dictionary
            code = np.concatenate([c.indices.to_numpy() for c in coded])
            key = np.concatenate(owners).astype(np.int64) * len(distinct) + code
            key[code == pc.index(distinct, pa.scalar(_END, pa.binary())).as_py()] = -1
            held.clear()
            owners.clear()
            # Numbers of the words of all parts; an end is 0.
            kinds, at = np.unique(key, return_inverse=True)
            parts, words = pa.array(names, pa.string()).take(pa.array(kinds[1:] // len(distinct))), distinct.take(pa.array(kinds[1:] % len(distinct)))
            blocks, bits, starts = bitmaps_of(at, len(kinds))
            counts = np.bincount(at, minlength=len(kinds))[1:].astype(np.int64)
            named = pc.binary_join_element_wise(parts.cast(pa.binary()), words, pa.scalar(_END, pa.binary())).to_numpy(zero_copy_only=False)
            ids = np.fromiter(map(xxhash.xxh3_64_intdigest, named, repeat(seed)), np.uint64, len(named)).view(np.int64)
            lists = [pa.array(ids), pa.array(counts), parts, words.cast(pa.string())]
            data, size = packed(np.diff(starts), blocks, bits)
            out = pa.RecordBatch.from_arrays([pa.array([shard]), *map(one, lists), pa.array([data], pa.binary()), pa.array([size])], [c.split()[0] for c in BITMAPS.split(", ")])
            shard, n = shard + 1, 0
            return out

        for batch in batches:
            step = max(1, batch.num_rows * TEXT_BYTES // max(batch.nbytes, 1))
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                words, each = words_of(some.column(1))
                part = np.fromiter((names.setdefault(p, len(names)) for p in some.column(0).to_pylist()), np.int32, some.num_rows)
                upto, at = np.concatenate([[0], np.cumsum(each)]), 0
                while at < some.num_rows:
                    to = min(int(np.searchsorted(upto, upto[at] + positions - n)), some.num_rows)  # the document that fills a shard is its last
                    held.append(words.slice(upto[at], upto[to] - upto[at]))
                    owners.append(np.repeat(part[at:to], each[at:to]))
                    n += len(held[-1])
                    at = to
                    if n >= positions:
                        yield close()
        if held:
            yield close()

    return docs.select(F.coalesce(col(part_col).cast("string"), F.lit("und")).alias("part"), col(text_col).alias("text")).mapInArrow(run, BITMAPS)


class Shard:
    """The bitmaps of one shard's frequent words, by block."""

    def __init__(self, ids: np.ndarray, word: np.ndarray, block: np.ndarray, bits: np.ndarray):
        """``ids``: numbers of the words; an entry is (index of its word, block, bits), entries come by word."""
        self.ids, self.word, self.block, self.bits = ids, word, block, bits
        order = np.argsort(block)
        self.block_word, self.block_bits = word[order], bits[order]
        self.first = np.searchsorted(block[order], np.arange((int(block.max()) if len(block) else 0) + 3))

    def next_words(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bitmaps of all one-word extensions: shift by one, AND. The entries given are (phrase, block, bits)
        and so are those returned, with the word that was added behind the phrase."""
        carry = (bits >> (WIDTH - 1)) != 0
        phrase = np.concatenate([phrase, phrase[carry]])
        block = np.concatenate([block, block[carry] + 1])
        bits = np.concatenate([bits << 1, np.ones(int(carry.sum()), np.uint16)]).astype(np.uint16)
        some = bits != 0
        phrase, block, bits = phrase[some], block[some], bits[some]
        low, many = self.first[block], self.first[block + 1] - self.first[block]
        upto = np.cumsum(many)
        out = []
        at = 0
        while at < len(block):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MEETINGS, "right")))
            m = many[at:to]
            one = np.repeat(np.arange(at, to), m)
            other = np.arange(len(one)) + np.repeat(low[at:to] - np.r_[0, np.cumsum(m)[:-1]], m)
            both = bits[one] & self.block_bits[other]
            met = np.flatnonzero(both)
            out.append((phrase[one[met]], self.block_word[other[met]], block[one[met]], both[met]))
            at = to
        if not out:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def branches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The bitmaps of groups of first words, each group with about as many meetings as are made at once."""
        if not len(self.block):
            return
        work = np.cumsum(self.first[self.block + 1] - self.first[self.block] + 1)
        group = work // MEETINGS
        # A word's bitmap lies in one group.
        starts = np.flatnonzero(np.r_[True, self.word[1:] != self.word[:-1]])
        cuts = starts[np.flatnonzero(np.r_[True, group[starts][1:] != group[starts][:-1]])]
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(self.word)], strict=True):
            yield self.word[lo:hi], self.block[lo:hi], self.bits[lo:hi]


def _tally(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the summed popcounts of their entries."""
    kinds, inverse = np.unique(key, return_inverse=True)
    return kinds, np.bincount(inverse, np.bitwise_count(bits), len(kinds)).astype(np.int64)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32 bits for two word ids, as int64."""
    x = a.view(np.uint64) * _M1 ^ (b.view(np.uint64) >> np.uint64(7)) * _M2 + b.view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * _M2
    return (x >> np.uint64(32)).astype(np.int64)


class Filter:
    """A set of hashes as one bit each; others may seem to be in it. Its size is a power of two."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, len(bits) * 8 - 1

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def filter_of(hashes: DataFrame, rows: int, most: int = FILTER_BITS) -> Filter:
    """The filter of a column ``hash`` of ``rows`` rows: 16 bits a row, from 2^16 up to ``most`` bits in all. The
    bits are set where the rows are; the driver gets the bitmap alone."""
    size = min(most, max(1 << 16, 1 << (16 * rows).bit_length()))
    at = F.col("hash").bitwiseAND(F.lit(size - 1))
    chunk = 1 << 15
    rows_ = hashes.select(F.floor(at / chunk).alias("no"), (at % chunk).alias("bit")).groupBy("no").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows_:
        out[r["no"] * chunk // 8 : (r["no"] + 1) * chunk // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Filter(out)


def pairs_of(s: Shard) -> Iterator[tuple[np.ndarray, ...]]:
    """(first word, second word, count) of all two-word phrases, by ids."""
    n = len(s.ids)
    for branch in s.branches():
        p, w, _, bits = s.next_words(*branch)
        key, count = _tally(p.astype(np.int64) * n + w, bits)
        yield s.ids[key // n], s.ids[key % n], count


def phrases_of(s: Shard, frequent: Filter) -> Iterator[tuple[np.ndarray, ...]]:
    """(first, second, third word, count) of the two-word phrases (third word -1) that pass the filter, and of
    the three-word phrases whose both pairs do, going down through those pairs only."""
    n = len(s.ids)
    for branch in s.branches():
        p, w, block, bits = s.next_words(*branch)
        pair, at = np.unique(p.astype(np.int64) * n + w, return_inverse=True)
        first, second = pair // n, pair % n
        passes = frequent(pair_hash(s.ids[first], s.ids[second]))
        count = np.bincount(at, np.bitwise_count(bits), len(pair)).astype(np.int64)
        yield s.ids[first[passes]], s.ids[second[passes]], np.full(int(passes.sum()), -1), count[passes]
        down = passes[at]
        q, w3, _, bits = s.next_words(at[down], block[down], bits[down])
        last = frequent(pair_hash(s.ids[second[q]], s.ids[w3]))
        key, count = _tally(q[last] * n + w3[last], bits[last])
        q = key // n
        yield s.ids[first[q]], s.ids[second[q]], s.ids[key % n], count


def frequent_shard(ids: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, bits: np.ndarray, frequent: Filter) -> Shard:
    """The shard of the words that pass the filter."""
    stays = frequent(ids)
    held = np.repeat(stays, sizes)
    return Shard(ids[stays], np.repeat(np.arange(int(stays.sum()), dtype=np.int32), sizes[stays]), blocks[held].astype(np.int32), bits[held])


def _walk(bitmaps: DataFrame, words: Filter, pairs: Filter | None) -> DataFrame:
    """What shards find: ``hash, n`` of all pairs of words that pass ``words``; with ``pairs`` the phrases
    ``w1, w2, w3, n`` that pass that."""
    spark = bitmaps.sparkSession
    given = spark.sparkContext.broadcast((words.bits, None if pairs is None else pairs.bits))
    names = ["hash", "n"] if pairs is None else ["w1", "w2", "w3", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bits, pair_bits = given.value
        frequent, deeper = Filter(word_bits), None if pair_bits is None else Filter(pair_bits)
        for batch in batches:
            for ids, data, size in zip(*batch.columns, strict=True):
                shard = frequent_shard(ids.values.to_numpy(), *unpacked(data.as_buffer(), size.as_py(), len(ids)), frequent)
                if deeper is None:
                    found = ((pair_hash(a, b), n) for a, b, n in pairs_of(shard))
                else:
                    found = phrases_of(shard, deeper)
                for x in found:
                    for lo in range(0, len(x[0]), ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + ROWS]) for c in x], names)

    return bitmaps.select("ids", "bitmaps", "raw_size").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact for counts below 10^14."""
    d = lambda c: c.cast("decimal(14,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * d(a) * d(a), d(left) * d(right))


def collocations(docs: DataFrame, text_col: str = "text", part_col: str = "lang", support: int = SUPPORT, covered: int = COVERED, first: int = FIRST, positions: int = POSITIONS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The best phrases of two and three words of each part: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\n\\x0b\\x0c\\r]`` and those into words at blanks and tabs.
    A phrase that occurs ``a`` >= ``support`` times in its part (overlaps included) is a candidate; of its cuts
    into two the lowest score counts (of equals the first), ``l`` and ``r`` are the counts of both sides, ``n`` all
    word occurrences of the part. A candidate inside a longer one with ``covered`` percent of its count
    goes. Each part's ``first`` by score, count and phrase are returned.

    Null and empty texts have no words; a null part is ``und`` (and one with a row of that name); rows count
    each, whatever their id. A table without candidates gives an empty result. Other columns play no part.
    """
    with scratch(docs.sparkSession):
        seed = 0
        while True:
            bitmaps = materialize(word_bitmaps(docs, text_col, part_col, positions, seed), "bitmaps")
            each = bitmaps.select(F.explode(F.arrays_zip("ids", "part", "text", "n")).alias("w")).select(F.col("w.ids").alias("id"), "w.part", "w.text", "w.n")
            words = materialize(each.groupBy("id", "part", "text").agg(F.sum("n").alias("f")), "words")
            # Two words with one 64-bit hash would be counted as one: then all are hashed anew.
            if words.groupBy("id").count().where("count > 1").isEmpty():
                break
            seed += 1
        totals = words.groupBy("part").agg(F.sum("f").alias("total"))
        frequent = materialize(words.where(F.col("f") >= support), "frequent_words")
        n_words = frequent.count()
        known = filter_of(frequent.select(F.col("id").alias("hash")), n_words, filter_bits)
        hashes = materialize(_walk(bitmaps, known, None).groupBy("hash").agg(F.sum("n").alias("a")).where(F.col("a") >= support).select("hash"), "pair_hashes")
        passing = filter_of(hashes, hashes.count(), filter_bits)
        phrases = materialize(_walk(bitmaps, known, passing).groupBy("w1", "w2", "w3").agg(F.sum("n").alias("a")).where(F.col("a") >= support), "phrases")
        pairs, triples = phrases.where("w3 = -1").drop("w3"), phrases.where("w3 <> -1")
        n_pairs = pairs.count()

        def word(k: int, *more: str) -> DataFrame:
            return bounded_broadcast(frequent.select(F.col("id").alias(f"w{k}"), F.col("text").alias(f"t{k}"), F.col("f").alias(f"f{k}"), *more), n_words)

        def pair(k: int) -> DataFrame:
            return bounded_broadcast(pairs.select(F.col("w1").alias(f"w{k}"), F.col("w2").alias(f"w{k + 1}"), F.col("a").alias(f"f{k}{k + 1}")), n_pairs)

        inside = triples.select(F.inline(F.array(F.struct("w1", "w2", "a"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")))).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
        two = pairs.join(inside, ["w1", "w2"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
        two = two.join(word(1, "part"), "w1").join(word(2), "w2").select("part", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r")).withColumn("score", exact_score(F.col("a"), F.col("l"), F.col("r")))
        three = triples.join(pair(1), ["w1", "w2"]).join(pair(2), ["w2", "w3"]).join(word(1, "part"), "w1").join(word(2), "w2").join(word(3), "w3")
        one, other = exact_score(F.col("a"), F.col("f1"), F.col("f23")), exact_score(F.col("a"), F.col("f12"), F.col("f3"))
        three = three.withColumns({"s1": one, "s2": other}).withColumn("late", F.col("s2") < F.col("s1"))
        three = three.select(
            "part", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(F.col("late"), F.col("f12")).otherwise(F.col("f1")).alias("l"),
            F.when(F.col("late"), F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"),
        )
        rows = two.unionByName(three)
        best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
        # A part may hold most candidates: its best are found among the best of salted shares of it.
        salt = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        shares = rows.withColumn("salt", salt).withColumn("k", F.row_number().over(Window.partitionBy("part", "salt").orderBy(*best))).where(F.col("k") <= first)
        top = shares.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
        return keep(materialize(top.join(totals, "part").select(F.col("part").alias("lang"), "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"), "collocations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), spots AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), phrases AS (
  SELECT lang, 1 AS k, w[i] AS phrase FROM spots UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM spots WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM spots WHERE i + 2 <= len(w)
), counts AS (
  SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS a FROM phrases GROUP BY ALL
), totals AS (
  SELECT lang, sum(a) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND a >= {SUPPORT}
), cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)
), scored AS (
  SELECT t.lang, t.k, t.phrase, t.a, t.c, p.a AS l, q.a AS r, (1000000 * t.a * t.a) // (p.a * q.a) AS score
  FROM cuts t JOIN counts p ON p.lang = t.lang AND p.phrase = t.x JOIN counts q ON q.lang = t.lang AND q.phrase = t.y
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN inside i ON s.k = 2 AND i.lang = s.lang AND i.phrase = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < {COVERED} * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {FIRST}
"""
