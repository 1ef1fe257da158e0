import hashlib
import math
import threading
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import AnalysisException

import corpus_pipeline
from barloom.llm import common
from barloom.llm.common import connected_components
from barloom.llm.tokens import UnitEncoder, tokenizer_path

from test_line_dedup import brute as lines_brute
from test_minhash import brute as copies_brute

SF = "/root/testdata/sf0.001"


def draws_brute(rows, weights):
    """Copies by document: Poisson counts by walking the cumulative probabilities of each source's rate."""
    size = Counter()
    for r in rows:
        size[r.source] += len(r.text or "")
    share = {s: weights.get(s, 1.0) for s in size}
    whole = sum(w for s, w in share.items() if size[s])
    out = Counter()
    for r in rows:
        if size[r.source]:
            rate = sum(size.values()) * (share[r.source] / whole) / size[r.source]
            u = (int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            n, p, c = 0, math.exp(-rate), math.exp(-rate)
            while c < u:
                n += 1
                p *= rate / n
                c += p
            if n:
                out[r.doc_id] = n
    return out


def test_stages_on_test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        given = [(r.doc_id, r.text) for r in docs.collect()]
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        texts = sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "line_dedup":
            assert texts == sorted((d, t) for d, _, _, t in lines_brute(given))
        elif name == "minhash_near_dedup":
            kept = {d for d, _, _, stays in copies_brute(given, 5) if stays}
            assert texts == sorted(x for x in given if x[0] in kept)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) <= before
    mixed = corpus_pipeline.materialize(corpus_pipeline.STAGES[3][1](spark, docs, SF), "mixed")
    assert Counter(r.doc_id for r in mixed.collect()) == draws_brute(docs.collect(), corpus_pipeline.mixing.WEIGHTS)
    assert mixed.columns == columns and set(r.doc_id for r in mixed.collect()) <= set(ids)
    pieces = corpus_pipeline.STAGES[4][1](spark, mixed, SF).collect()
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
    size = {p.doc_id: p.doc_tokens for p in pieces}
    assert all(tokens[d] == copies[d] * size[d] for d in copies)


def test_the_last_stage_writes_the_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    pieces = corpus_pipeline.materialize(corpus_pipeline.STAGES[-1][1](spark, docs, SF), "pieces").collect()
    assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in pieces)
    enc = UnitEncoder(tokenizer_path("word_bpe_49k.json"), "word").tok
    for d in docs.collect():
        whole = b"".join(bytes(p.ids) for p in sorted((p for p in pieces if p.doc_id == d.doc_id), key=lambda p: p.start))
        assert np.frombuffer(whole, "<u4").tolist() == [*enc.encode(d.text or "", add_special_tokens=False).ids, 1]


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_all_stages_take_repeated_null_and_clashing_rows(spark, words):
    """Rows that repeat an id keep what no copy of another row makes superfluous."""
    new = lambda seed: " ".join(f"{w}{k}" for k, w in enumerate(words(90, seed)))
    a, b, c = new(1), new(2), new(3)
    rows = [(0, a), (1, a + " more"), (1, b), (2, c), (2, c), (3, None), (4, ""), (None, a), (None, None), (5, new(5) + "\n" + new(6)), (5, new(5)), (6, "x " * 50_000)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}" if k % 3 else None, None, "x", k, "y") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, np_id string, tag int, kept string")
    near = corpus_pipeline.near_dedup(spark, docs, SF)
    assert near.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in near.collect())
    assert left == Counter(x for x in rows if x != (1, a + " more"))
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, out, SF), name)
        assert name == "packing" or out.columns == docs.columns
        if name == "quality_rules":
            assert {r.text for r in out.collect()} >= {a, b, c}
        if name == "minhash_near_dedup":
            assert {r.text for r in out.collect()} >= {a, b, c}
    assert out.count() > 0


def test_scratch_blocks_belong_to_their_thread(spark):
    """A block deletes its own tables, after an error too, and none of another thread's."""
    paths, held, done = {}, threading.Event(), threading.Event()

    def other():
        with common.scratch(spark):
            paths["other"] = common.materialize(spark.range(3), "t")._scratch_path
            held.set()
            done.wait(60)
            paths["rows"] = spark.read.parquet(paths["other"]).count()

    t = threading.Thread(target=other)
    t.start()
    held.wait(60)
    with pytest.raises(ValueError), common.scratch(spark):
        with common.scratch(spark):
            kept = common.keep(common.materialize(spark.range(5), "inner"))
        assert kept.count() == 5
        raise ValueError
    done.set()
    t.join()
    assert paths["rows"] == 3
    for p in (kept._scratch_path, paths["other"]):
        with pytest.raises(AnalysisException):
            spark.read.parquet(p)


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 61)} == {1} and {got[k] for k in range(100, 150)} == {100} and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_chains_contract(spark):
    n = 5000
    for k, ids in enumerate((list(range(n)), list(range(n, 0, -1)), np.random.default_rng(1).permutation(n).tolist())):
        edges = spark.createDataFrame(list(zip(ids[:-1], ids[1:], strict=True)), "a long, b long")
        got = connected_components(edges).agg({"id": "count", "component": "max", "*": "count"}).first()
        assert (got["count(id)"], got["max(component)"]) == (n, min(ids)), k
