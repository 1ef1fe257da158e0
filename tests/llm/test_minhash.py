import random

from barloom.llm import minhash as m


def shingles(text, n):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split(" ") if text else []
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").translate({c: c + 32 for c in range(65, 91)}).split(" ") if x]
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(texts, n):
    ids = [(d, shingles(t, n)) for d, t in texts]
    parent = {d: d for d, _ in ids if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(ids):
        for b, y in ids[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {(d, len(s), root(d) if d is not None else None, d is None or root(d) == d) for d, s in ids}


def corpus(words):
    r = random.Random(4)
    out = []
    for k in range(12):
        base = words(60, k)
        for j in range(9):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
                copy[r.randrange(60)] = f"new{r.random()}"
            out.append((100 * k + j, " ".join(copy)))
    # a chain: neighbours are similar, the ends are not
    for j in range(10):
        out.append((5000 + j, " ".join(words(100, 77)[3 * j : 3 * j + 50])))
    out += [(9000, None), (9001, ""), (9002, " \n"), (9003, "single"), (9004, "SINGLE"), (9005, "two words"), (9006, "Two\tWORDS"), (None, out[0][1]), (9007, "É a b c"), (9008, "é a b c"), (9009, "w " * 4000)]
    return out


def test_against_brute_force(make_docs, words):
    texts = corpus(words)
    for n in (2, 5):
        got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(make_docs(texts), words=n).collect()}
        assert got == brute(texts, n)


def test_blocks_lose_no_link(make_docs, words, monkeypatch):
    texts = corpus(words)
    # One band for all: every text shares one bucket, so blocks do the work.
    monkeypatch.setattr(m, "band_keys", lambda sets, bands=0, rows=0: __import__("numpy").ones((len(sets), 1), "uint64"))
    monkeypatch.setattr(m, "BLOCK", 20)
    monkeypatch.setattr(m, "BLOCK_SHINGLES", 3000)
    monkeypatch.setattr(m, "STAR", 7)
    keep = m.near_duplicates(make_docs(texts), words=2)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in keep.collect()} == brute(texts, 2)


def test_a_long_chain(make_docs, words):
    # Windows over one long text: neighbours are alike, texts further on are not.
    source = words(60 + 4 * 300, 3)
    texts = [(k, " ".join(source[4 * k : 4 * k + 60])) for k in range(300)]
    rows = m.near_duplicates(make_docs(texts), words=2).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows} == brute(texts, 2) and {r.component_id for r in rows} == {0}


def test_repeated_rows_and_empty(make_docs):
    rows = m.near_duplicates(make_docs([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert m.near_duplicates(make_docs([])).count() == 0
