import hashlib
import random
import re

from pyspark.sql import functions as F

from barloom.llm import fingerprints as fp


def digests(text):
    return {int(hashlib.md5(p.encode()).hexdigest()[:15], 16) for p in re.findall(r"[^\n]{1,200}", text or "")}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_sketch(found, cells=fp.CELLS):
    out = [[0, 0, 0] for _ in range(3 * cells)]
    for x in found:
        h = ((x % 2**31) * 2654435761 + (x >> 31) * 40503 + 12345) % (2**31 - 1)
        for t in range(3):
            c = out[t * cells + ((x >> 20 * t) & (2**20 - 1)) % cells]
            c[0], c[1], c[2] = c[0] + 1, c[1] ^ x, c[2] ^ h
    return "".join(f"{c % 256:02x}{k:015x}{h:08x}" for c, k, h in out)


def brute(docs):
    """Rows by id; the order of rows of one id is not checked, so tests give those equal texts."""
    known = sorted((d for d in docs if d[0] is not None), key=lambda d: d[0])
    out = []
    for k, (i, t) in enumerate(known):
        out.append((i, t or "", known[(k + 1) % len(known)][1] or ""))
    out += [(None, t or "", "") for i, t in docs if i is None]
    rows = []
    for i, t, nxt in out:
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a = digests(t)
        rows.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_sketch(a), plain_sketch(digests(e)), round(jaccard(a, digests(e)), 9), round(jaccard(a, digests(nxt)), 9)))
    return sorted(rows, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=repr)


def test_edits_against_brute_force(make_docs):
    r = random.Random(8)
    line = lambda: "".join(r.choice("abcé\U0001f600 #") for _ in range(r.choice([1, 5, 60, 500])))
    pool = [line() for _ in range(30)]
    docs = [(k, "\n".join(r.choice(pool) if r.random() < 0.5 else line() for _ in range(r.choice([0, 1, 3, 12, 40])))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "x"), (104, "same\n" * 500), (105, docs[3][1]), (106, docs[3][1]), (107, docs[3][1]), (107, docs[3][1]), (None, docs[4][1]), (None, None)]
    docs += [(200, "".join(r.choice("abc \n") for _ in range(60_000)))]
    assert got(fp.compare_with_edits(make_docs(docs))) == brute(docs)


def test_few_rows(make_docs):
    for docs in ([], [(5, "one text\nof two lines")], [(None, "no id")], [(5, "a"), (6, None)]):
        assert got(fp.compare_with_edits(make_docs(docs))) == brute(docs)


def test_peeling_recovers_all_digests(spark):
    r = random.Random(2)
    new = lambda n: [r.randrange(2**60) for _ in range(n)]
    rows = []
    for k in range(80):
        shared = new(r.choice([0, 3, 50]))
        rows.append((k, shared + new(r.choice([0, 1, 9, 30, 200])), shared + new(r.choice([0, 1, 9, 30]))))
    big = new(4000)
    rows += [(80, big, big[:10] + new(3500)), (81, big, big), (82, None, None), (83, None, [7]), (-1, [3, 5], [])]
    pairs = spark.createDataFrame(rows, "pair long, a array<long>, b array<long>")
    out = {x.pair: x for x in fp.reconcile(pairs).collect()}
    assert len(out) == len(rows)
    for pair, a, b in rows:
        x, a, b = out[pair], set(a or []), set(b or [])
        assert (x.n_a, x.n_b, x.n_only_a, x.n_only_b) == (len(a), len(b), len(a - b), len(b - a))
        assert set(x.only_a) == a - b and set(x.only_b) == b - a


def test_next_rows_over_ranges(spark):
    ids = random.Random(4).sample(range(-(10**12), 10**12), 3000)
    docs = spark.createDataFrame([(i, f"t{i}", i % 7) for i in ids], "doc_id long, text string, h long").repartition(7)
    rows = fp.with_next(docs, ["text"], ["then"]).collect()
    order = sorted(ids)
    assert {r.doc_id: r.then for r in rows} == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert len({r.uid for r in rows}) == len(rows) == len(ids)
    bounds = list(range(0, 1000, 3))
    low = spark.range(-5, 1005).select("id", fp._bucket(F.col("id"), bounds).alias("b")).collect()
    assert all(r.b == sum(x < r.id for x in bounds) for r in low)
