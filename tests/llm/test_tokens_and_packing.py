import random
import zlib

import numpy as np
import pytest

from barloom.llm import packing, token_files, tokens
from barloom.llm.common import shared_dir
from barloom.llm.tokens import UnitEncoder, tokenizer_path

ODD = [
    "", " ", "\n", "a", "a b", " a", "a ", "a\nb", "a \nb", "a\n b", "a  b", "\ta", "x<|endoftext|>y", "I'm you'll", "ÀÉ Ça", "a\x1cb", "é ́x", "ΑΣ Σ",
    "日本語 テキスト", "a\r\nb", ".\n\n\nfoo", "1 23 456", "#$% !!", "😀 ok", " x y",
]


@pytest.mark.parametrize(("name", "style"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_equal_whole_texts(name, style):
    r = random.Random(1)
    parts = [*" \n\tab.!1é", "'s", "the", " "]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(500)]
    enc = UnitEncoder(tokenizer_path(name), style)
    want = [x.ids for x in enc.tok.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        ids, n = enc.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 511, 512, 513, 5000):
        for hi in (1, 2, 5, 300, 50257, 2**31, 2**63):
            x = rng.integers(0, hi, n, dtype=np.uint64)
            x[rng.random(n) < 0.3] = 0
            words, starts, escapes = token_files.pack_words(x)
            assert (token_files.unpack_words(words, escapes) == x).all()
            assert len(starts) == -(-n // token_files.BLOCK)
            at = token_files.block_escapes(words, starts)
            for lo, hi in ((0, 1), (len(starts) - 1, len(starts)), (len(starts) // 2, len(starts))):
                if 0 <= lo < len(starts):
                    assert (token_files.unpack_blocks(words, escapes, starts, at, lo, hi) == x[lo * token_files.BLOCK : hi * token_files.BLOCK]).all()
    zeros, _, _ = token_files.pack_words(np.zeros(480, np.uint64))
    assert len(zeros) == 4


def test_token_files(spark, make_docs):
    texts = [(k, " ".join(ODD[k % len(ODD) :])) for k in range(40)] + [(50, None), (51, ""), (3, "again"), (60, "word " * 30000), (None, "no id")]
    path = token_files.write_tokens(make_docs(texts), f"{shared_dir(spark)}/t")
    rows = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    enc = UnitEncoder(tokenizer_path("byte_bpe_50k.json"), "byte").tok
    want = sorted(((d if d is not None else -1), [*enc.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in texts)
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in rows) == want
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in rows)
    every = [i for r in rows for i in r.ids]
    for lo, hi in ((0, 5), (700, 2100), (len(every) - 3, len(every) + 9), (5, 5), (-4, 2)):
        got = sorted(token_files.read_range(spark, path, lo, hi).collect(), key=lambda r: r.start)
        assert [i for r in got for i in r.ids] == every[max(lo, 0) : max(hi, 0)]
    slim = token_files.read_tokens(spark, path, with_ids=False)
    assert slim.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and slim.count() == len(rows)
    same = token_files.write_tokens(make_docs([(None, f"text {k}") for k in range(400)]), f"{shared_dir(spark)}/n", shards=4)
    assert len({r.shard for r in spark.read.parquet(same).collect()}) == 4  # rows without an id spread over shards
    empty = token_files.write_tokens(make_docs([]), f"{shared_dir(spark)}/e")
    assert token_files.read_tokens(spark, empty).count() == 0


def check_pieces(rows, want, length=2048, segments=64, loss=None):
    by = {}
    seqs = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    for key, ids in want.items():
        got = np.zeros(len(ids), np.int64)
        covered = np.zeros(len(ids), int)
        for r in by[key]:
            assert r["doc_tokens"] == len(ids)
            got[r["start"] : r["start"] + r["length"]] = np.frombuffer(bytes(r["ids"]), "<u4")
            covered[r["start"] : r["start"] + r["length"]] += 1
        assert (covered == 1).all() and got.tolist() == ids
    padding = 0
    for rs in seqs.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == [sum(x["length"] for x in rs[:k]) for k in range(len(rs))]
        total = sum(r["length"] for r in rs)
        assert total <= length and len(rs) <= segments
        if loss:
            assert sum(max(0, r["start"] + r["length"] - max(r["start"], loss[1][r["doc_id"]])) for r in rs) <= loss[0]
        padding += 0 if total & (total - 1) == 0 else length - total
    return padding


def test_packing(make_docs):
    r = random.Random(2)
    texts = [(k, " ".join(r.choice(["alpha", "beta,", "Gamma!", "d1"]) for _ in range(r.choice([0, 1, 3, 30, 300, 3000])))) for k in range(150)] + [(900, None)]
    enc = UnitEncoder(tokenizer_path("word_bpe_49k.json"), "word").tok
    want = {d: [*enc.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts}
    rows = [x.asDict() for x in packing.pack(make_docs(texts)).collect()]
    assert check_pieces(rows, want) == 0
    assert packing.pack(make_docs([])).count() == 0
    twice = packing.digests(packing.pack(make_docs([(1, "same words here"), (1, "same words here"), (None, "x")]))).collect()
    assert sorted((x.doc_id or 0, x.length) for x in twice) == [(0, 2), (1, 4), (1, 4)]


def test_three_limits_at_once():
    r = np.random.default_rng(1)
    p = packing.Packer(length=64, max_segments=4, max_loss=40, pool=16)
    want, free = {}, {}
    for k in range(300):
        ids = r.integers(0, 1000, int(r.choice([1, 2, 5, 20, 70, 200]))).astype(np.uint32)
        want[k], free[k] = ids.tolist(), int(r.integers(0, len(ids) + 1))
        p.add(k, ids, free[k])
    p.finish()
    rows = [dict(doc_id=a, doc_tokens=b, start=c, ids=d.astype("<u4").tobytes(), length=len(d), sequence_id=s, offset=o) for a, b, c, d, s, o in p.out]
    assert check_pieces(rows, want, 64, 4, (40, free)) == 0


def test_packing_with_prompts_that_bear_no_loss(spark):
    talks = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append(r.text or "")
    enc = UnitEncoder(tokenizer_path("word_bpe_49k.json"), "word").tok
    size = lambda t: len(enc.encode(t, add_special_tokens=False).ids)
    rows = [(c, "\n".join(t), None if c % 7 == 0 else size(t[0])) for c, t in talks.items()]
    want = {c: [*enc.encode(t, add_special_tokens=False).ids, 1] for c, t, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt long")
    got = [x.asDict() for x in packing.pack(docs, no_loss_col="prompt", length=256, max_segments=8, max_loss=100).collect()]
    assert check_pieces(got, want, 256, 8, (100, {c: n or 0 for c, _, n in rows})) == 0
    plain = [x.asDict() for x in packing.pack(docs, length=256, max_segments=8).collect()]
    sums = {}
    for x in plain:
        sums[x["sequence_id"]] = sums.get(x["sequence_id"], 0) + x["length"]
    assert max(sums.values()) > 100  # without the limit sequences bear more


@pytest.mark.parametrize(("name", "style"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_a_full_cache_drops_what_did_not_come_back(monkeypatch, name, style):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 300)
    r = random.Random(4)
    often = [f"often{k}" for k in range(40)]
    enc = tokens.UnitEncoder(tokens.tokenizer_path(name), style)
    sizes = []
    for _ in range(60):
        texts = [r.choice(["", "  ", "\n"]) + r.choice([" ", "\n", "  "]).join(r.choice(often) if r.random() < 0.8 else f"Rare{r.random()}" for _ in range(r.randint(0, 30))) for _ in range(8)]
        ids, lengths = enc.encode(texts)
        assert ids.tolist() == [i for t in texts for i in enc.tok.encode(t, add_special_tokens=False).ids]
        assert lengths.tolist() == [len(enc.tok.encode(t, add_special_tokens=False).ids) for t in texts]
        sizes.append(enc.n_units)
    assert max(sizes) < 1200 and sum(b < a for a, b in zip(sizes, sizes[1:])) > 3
    assert set(often) <= set(enc.after_space) | set(enc.exact)


def test_new_words_of_known_pieces_are_put_together():
    class Counting:
        def __init__(self, tok):
            self.tok, self.sent = tok, 0

        def encode(self, text, **more):
            self.sent += len(text)
            return self.tok.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            self.sent += sum(map(len, texts))
            return self.tok.encode_batch_fast(texts, **more)

    enc = UnitEncoder(tokenizer_path("word_bpe_49k.json"), "word")
    tok = enc.tok
    enc.tok = Counting(tok)
    r = random.Random(8)
    base = ["hello", "world", "collocations", "i", "can", "t", "re", "s", "ll", *"0123456789", *"',.-()!_", "\x00", "\u00e9t\u00e9", "\u00df", "\u00d7", "''", "'s", "'re", "'d"]
    enc.encode([" ".join(base)])
    enc.tok.sent = 0
    words = ["".join(r.choice(base) for _ in range(r.randint(1, 6))) for _ in range(3000)]
    words = [r.choice([w, w.upper(), w.title()]) for w in words]
    texts = [" ".join(words[k : k + 50]) for k in range(0, 3000, 50)] + ["caf\u00e9 Hello, \u0130x e\u0301 \u212a"]
    ids, n = enc.encode(texts)
    assert [v.tolist() for v in np.split(ids, np.cumsum(n)[:-1])] == [v.ids for v in tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.tok.sent < len(" ".join(texts)) / 3  # before, all distinct words


class Sent:
    """A tokenizer that keeps what it was given."""

    def __init__(self, tok):
        self.tok, self.texts = tok, []

    def __getattr__(self, name):
        return getattr(self.tok, name)

    def encode(self, text, **more):
        self.texts.append(text)
        return self.tok.encode(text, **more)

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.tok.encode_batch_fast(texts, **more)


def watched(name, style):
    """An encoder, its tokenizer, and what goes to the whole pattern and to the model alone."""
    enc = UnitEncoder(tokenizer_path(name), style)
    tok = enc.tok
    enc.tok, enc.pieces = Sent(tok), Sent(getattr(enc, "pieces", tok))
    return enc, tok


def syllables(n, seed):
    r = random.Random(seed)
    return sorted({"".join(r.choice(["on", "th", "ère", "ñu", "stra", "ß", "in"]) for _ in range(r.randint(2, 6))) for _ in range(n)})


def test_byte_words_are_encoded_without_what_follows_them():
    enc, tok = watched("byte_bpe_50k.json", "byte")
    words = syllables(400, 3)
    first = ["x " + " ".join(words), "\n".join(w.title() for w in words)]
    texts = ["x " + ", ".join(words) + ".", "x " + ". ".join(words) + ",", ".\n".join(w.title() for w in words), "x 3,5 a.b", "x ,a .b ..c", ",", ".a", "x,\ny.", "a\x1eb c, d."]
    want = lambda t: [v.ids for v in tok.encode_batch(t, add_special_tokens=False)]
    ids, n = enc.encode(first)
    assert [v.tolist() for v in np.split(ids, np.cumsum(n)[:-1])] == want(first)
    assert sum(map(len, enc.tok.texts)) < 50  # words of letters need no pattern
    enc.tok.texts, enc.pieces.texts = [], []
    ids, n = enc.encode(texts)
    assert [v.tolist() for v in np.split(ids, np.cumsum(n)[:-1])] == want(texts)
    assert sum(map(len, enc.tok.texts + enc.pieces.texts)) < 100


@pytest.mark.parametrize(("name", "style"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_files_that_cut_otherwise_keep_whole_words(tmp_path, name, style):
    from tokenizers import Tokenizer, normalizers

    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.normalizer = normalizers.Lowercase() if style == "byte" else normalizers.Replace("a", "e")
    tok.save(str(tmp_path / "t.json"))
    enc = UnitEncoder(str(tmp_path / "t.json"), style)
    texts = ["Hello, World. Again hello", "a.b Été, a"]
    ids, _ = enc.encode(texts)
    assert ids.tolist() == [i for t in texts for i in tok.encode(t, add_special_tokens=False).ids]


def test_words_that_differ_in_case_or_what_follows_share_a_unit():
    enc, tok = watched("word_bpe_49k.json", "word")
    words = syllables(400, 5)
    enc.encode(["Ab, cd. " + " ".join(words)])
    units = enc.n_units
    enc.tok.texts, enc.pieces.texts = [], []
    texts = [", ".join(words) + ".", ". ".join(w.title() for w in words if w[0] != "ß") + ",", "\n".join(w.upper() for w in words if "ß" not in w)]
    ids, n = enc.encode(texts)
    assert [v.tolist() for v in np.split(ids, np.cumsum(n)[:-1])] == [v.ids for v in tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.n_units == units and enc.tok.texts == enc.pieces.texts == []
    odd = ["a.b l'Un, I'LL. 3,5 x ,y .Z ..", ",", "ΑΣ, Σ. İx, É.", "é́, é. ß.", "a B,  c. \t d", "a\x1db, c."]
    ids, n = enc.encode(odd)
    assert [v.tolist() for v in np.split(ids, np.cumsum(n)[:-1])] == [v.ids for v in tok.encode_batch(odd, add_special_tokens=False)]


def test_pages_are_cut_within_a_batch_of_texts(spark, make_docs, monkeypatch):
    texts = [f"some words of text number {k}" for k in range(300)] + ["long " * 900, ""]
    monkeypatch.setattr(token_files, "PAGE_IDS", 500)
    path = token_files.write_tokens(make_docs(list(enumerate(texts))), f"{shared_dir(spark)}/p", shards=1)
    pages = spark.read.parquet(path).orderBy("page").collect()
    assert len(pages) > 4 and all(sum(p.doc_sizes[:-1]) < 500 for p in pages)  # before, a page for all texts of a batch
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    tok = UnitEncoder(tokenizer_path("byte_bpe_50k.json"), "byte").tok
    assert [(r.doc_id, list(r.ids)) for r in rows] == [(k, [*tok.encode(t, add_special_tokens=False).ids, 0]) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("name", "style"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_known_words_are_compared_as_text_and_are_no_python_objects(monkeypatch, name, style):
    import tracemalloc

    words = syllables(30000, 7)
    enc = UnitEncoder(tokenizer_path(name), style)
    tracemalloc.start()
    enc.encode(["x " + " ".join(words)])
    assert tracemalloc.get_traced_memory()[0] < 110 * len(words)  # before, a string and a number of each word besides: over 150
    tracemalloc.stop()
    monkeypatch.setattr(tokens, "_hash", len)  # nearly all words share their hash with others
    monkeypatch.setattr(tokens, "CACHE_UNITS", 300)
    enc = UnitEncoder(tokenizer_path(name), style)
    for lo in (0, 100, 50, 0, 200, 0):
        texts = ["x " + " ".join(words[lo : lo + 150]), "\n".join(words[lo : lo + 20])]
        ids, n = enc.encode(texts)
        assert [v.tolist() for v in np.split(ids, np.cumsum(n)[:-1])] == [v.ids for v in enc.tok.encode_batch(texts, add_special_tokens=False)]
