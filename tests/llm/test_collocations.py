import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, n string, shard int, part string"


def brute(docs, support, covered=50, first=2000):
    out = []
    for lang in {p or "und" if p is None else p for _, _, p in docs}:
        count = Counter()
        for _, t, p in docs:
            if ("und" if p is None else p) != lang:
                continue
            for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate({c: c + 32 for c in range(65, 91)})):
                w = re.findall("[^\x20\x09]+", piece)
                count.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        n = sum(v for k, v in count.items() if len(k) == 1)
        candidates = {k: a for k, a in count.items() if len(k) > 1 and a >= support}
        rows = []
        for w, a in candidates.items():
            if any(len(x) > len(w) and 100 * b >= covered * a and w in (x[:2], x[1:]) for x, b in candidates.items() if len(w) == 2 and len(x) == 3):
                continue
            score, _, l, r = min((10**6 * a * a // (count[w[:k]] * count[w[k:]]), k, count[w[:k]], count[w[k:]]) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def docs():
    r = random.Random(6)
    vocabulary = ["the", "The", "of", "new", "york", "City", "é", "É", "日本", "\x1c", "a\xa0b", "x" * 2000, *[f"w{k}" for k in range(25)]]
    say = lambda n: "".join(r.choice(vocabulary[: r.choice([6, 12, 37])]) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(n))
    out = [(k, say(r.choice([0, 1, 5, 60, 300])), r.choice(["en", "en", "de", None, "und", ""])) for k in range(90)]
    return [*out, (90, None, "en"), (91, "", None), (92, " \t\n.", "none"), (93, "same same same " * 400, "de"), (93, out[3][1], out[3][2]), (None, "new york city " * 30, "en"), out[5]]


def test_against_brute_force(spark, docs):
    frame = spark.createDataFrame([(*d, "x", 1, "p") for d in docs], SCHEMA).repartition(5)
    assert got(C.collocations(frame)) == brute(docs, 10)
    assert got(C.collocations(frame, support=3, covered=80, first=7, positions=500, filter_bits=1 << 16)) == brute(docs, 3, 80, 7)


def test_long_documents_and_dense_meetings(spark, monkeypatch):
    text = "a b c a b. " * 220_000 + "x y " * 90
    docs = [(1, text, "en"), (2, "a b c " * 50, "en")]
    assert got(C.collocations(spark.createDataFrame([(*d, "x", 1, "p") for d in docs], SCHEMA))) == brute(docs, 10)
    r = np.random.default_rng(0)
    at = r.integers(0, 9, 5000).astype(np.int32)
    blocks, bits, starts = C.bitmaps_of(at, 9)
    word = np.repeat(np.arange(8), np.diff(starts))
    shard = C.Shard(np.arange(8), word, blocks.astype(np.int64), bits)
    want = Counter((x - 1, y - 1) for x, y in zip(at, at[1:]) if x and y)
    for most in (1, 40, 1 << 21):
        monkeypatch.setattr(C, "MEETINGS", most)
        found = Counter({(a, b): n for xs in C.pairs_of(shard) for a, b, n in zip(*xs)})
        assert found == want
    three = Counter((x - 1, y - 1, z - 1) for x, y, z in zip(at, at[1:], at[2:]) if x and y and z)
    for some in (lambda h: h == h, lambda h: h % 3 != 0):  # a full filter, and one that holds back pairs
        passes = lambda a, b: bool(some(C.pair_hash(np.array([a], np.int64), np.array([b], np.int64)))[0])  # noqa: E731, B023
        found = Counter({tuple(k): n for xs in C.phrases_of(shard, some) for *k, n in zip(*xs)})
        assert found == Counter({(a, b, -1): n for (a, b), n in want.items() if passes(a, b)}) + Counter({k: n for k, n in three.items() if passes(*k[:2]) and passes(*k[1:])})


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, "a b", "en", "x", 1, "p"), (2, None, None, "x", 1, "p")], SCHEMA)).count() == 0


def test_filters(spark):
    r = np.random.default_rng(1)
    held, other = r.integers(-(2**63), 2**63, 3000), r.integers(-(2**63), 2**63, 3000)
    f = C.filter_of(spark.createDataFrame([(int(x),) for x in held], "hash long"), 3000)
    assert f(held).all() and f(other).mean() < 0.1
    assert len(C.filter_of(spark.createDataFrame([], "hash long"), 0).bits) == 1 << 13 and not C.filter_of(spark.createDataFrame([], "hash long"), 0)(other).any()


def test_scores_are_exact(spark):
    big = 99_999_999_999_999
    rows = [(big, big, big), (10**13 + 7, 10**13 + 9, 10**13 + 11), (10, 10**13, 3 * 10**12), (10, 10, 10)]
    out = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", C.exact_score(*map(C.col, "alr")).alias("s")).collect()
    assert [x.s for x in out] == [10**6 * a * a // (l * r) for a, l, r in rows]


def test_bitmaps_are_packed():
    r = np.random.default_rng(2)
    for at in (np.zeros(3, np.int32), np.array([1, 0], np.int32), r.integers(0, 9, 5000).astype(np.int32)):
        n = int(at.max()) + 1
        blocks, bits, starts = C.bitmaps_of(at, n)
        for far in (blocks, blocks + np.uint32(1 << 20)):
            data, size = C.packed(np.diff(starts), far, bits)
            assert [x.tolist() for x in C.unpacked(pa.py_buffer(data), size, n - 1)] == [np.diff(starts).tolist(), far.tolist(), bits.tolist()]


def test_what_a_worker_holds():
    """A full shard and full filters leave room for the JVM beside two workers."""
    r = np.random.default_rng(0)
    at = np.minimum(r.zipf(1.15, C.POSITIONS), 80_000).astype(np.int32)
    full = C.Filter(np.full(1 << 13, 255, np.uint8))
    ids = r.integers(-(2**63), 2**63, 80_000)

    def peak(f):
        tracemalloc.start()
        try:
            return f(), tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    (blocks, bits, starts), mb = peak(lambda: C.bitmaps_of(at, 80_001))
    assert mb < 40  # 57 with 64-bit positions and keys
    data, size = C.packed(np.diff(starts), blocks, bits)
    assert len(data) < 0.8 * size
    shard = C.frequent_shard(ids, *C.unpacked(pa.py_buffer(data), size, 80_000), full)
    assert sum(x.nbytes for x in vars(shard).values()) < 20e6  # places and words of 32 bits
    n, mb = peak(lambda: sum(len(x[0]) for x in C.phrases_of(shard, full)))
    assert n > 10**6 and mb < 48  # 55 with twice the meetings
    assert C.FILTER_BITS <= 1 << 27  # two of 32 MB each before


def test_words_are_cut_as_arrays(spark, monkeypatch):
    texts = [None, "", " ", "a", "A b", "\ta  b\t", "a.b", "..", " . ", "É é, ÀB\x1cc", "x\u00a0y z", "a\x0b\x0c\r\nb!", "日本 語;Z", ",a", "a,"]
    r = random.Random(3)
    texts += ["".join(r.choice("aB .,\t\né日") for _ in range(r.randint(0, 12))) for _ in range(300)]
    want = []
    for t in texts:
        pieces = re.split("[.,;:!?\x0a-\x0d]", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        want.append([x for p in pieces for x in [*(w.encode() for w in re.findall("[^\x20\x09]+", p)), b"\xff"]])
    rows = pa.array(["before", *texts, "behind"], pa.string())[1:-1]
    words, n = C.words_of(rows)
    words = words.to_pylist()
    assert [words[e - k : e] for k, e in zip(n.tolist(), np.cumsum(n).tolist())] == want and len(words) == n.sum()
    long = ["one two three four " * 50_000]
    C.words_of(pa.array(long))
    tracemalloc.start()
    held = C.words_of(pa.array(long))
    assert tracemalloc.get_traced_memory()[0] < 16 * int(held[1].sum())  # before, a Python object for each word: over 40
    tracemalloc.stop()
    monkeypatch.setattr(C, "TEXT_BYTES", 40)
    docs = [(k, " ".join(r.choice(["x", "Y", "zz", "w.", ",v"]) for _ in range(r.randint(0, 30))), r.choice(["en", None, "und", "de"])) for k in range(60)]
    frame = spark.createDataFrame([(*d, "x", 1, "p") for d in docs], SCHEMA)
    assert got(C.collocations(frame, support=2, positions=70)) == brute(docs, 2)
