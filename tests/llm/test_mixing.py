from collections import Counter

from barloom.llm.mixing import mix


def texts(n=400):
    return [(k, "x" * (10 + k % 7)) for k in range(n)]


def test_shares_follow_weights_and_draws_are_stable(make_docs):
    docs = make_docs(texts(3000))
    out = mix(docs, weights={"s0": 3.0, "s1": 1.0}, default_weight=0.0, total=60000.0)
    rows = out.collect()
    size = Counter()
    for r in rows:
        size[r.source] += len(r.text)
    assert set(size) == {"s0", "s1"} and abs(size["s0"] / 45000 - 1) < 0.1 and abs(size["s1"] / 15000 - 1) < 0.15
    draws = Counter(r.doc_id for r in rows)
    again = Counter(r.doc_id for r in mix(docs.repartition(7), weights={"s0": 3.0, "s1": 1.0}, default_weight=0.0, total=60000.0).collect())
    assert draws == again
    assert [r.mix_key for r in rows] == sorted(r.mix_key for r in rows)
    mean = sum(draws[k] for k in range(3000) if k % 3 and k % 2 == 0) / 1000
    var = sum((draws[k] - mean) ** 2 for k in range(3000) if k % 3 and k % 2 == 0) / 1000
    assert abs(var / mean - 1) < 0.15  # a Poisson variable has variance = mean


def test_high_rates(make_docs):
    rows = mix(make_docs([(1, "abc"), (2, "abcd")]), total=7000.0).groupBy("doc_id").count().collect()
    assert all(700 < r["count"] < 1300 for r in rows)


def test_edges(make_docs):
    assert mix(make_docs([])).count() == 0
    docs = make_docs([(1, None), (2, ""), (3, "abc"), (3, "abc"), (None, "abc")])
    out = mix(docs, total=300.0, tags=False)
    assert out.columns == docs.columns
    n = Counter(r.doc_id for r in out.collect())
    assert n[1] == n[2] == 0 or n[2] > 0  # a source of no characters yields nothing; one that shares a source may
    assert n[3] % 2 == 0
