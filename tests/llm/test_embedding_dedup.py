import numpy as np

from barloom.llm import embedding_dedup as e


def brute(rows, cosine=0.98):
    fine = {}
    for k, (i, v, lab) in enumerate(rows):
        if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[k] = np.array(v, float) / np.linalg.norm(v)
    links = {k: [j for j in fine if j != k and rows[j][2] == rows[k][2] and len(fine[j]) == len(fine[k]) and fine[j] @ fine[k] >= cosine] for k in fine}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen), default=None) if i is not None else None
        out.append((i, len(links.get(k, [])), low, i is None or low == i))
    return sorted(out, key=repr)


def data():
    r = np.random.default_rng(3)
    rows, i = [], 0
    for c in range(25):
        base = r.normal(size=24)
        for _ in range(r.integers(1, 9)):
            v = base + r.normal(size=24) * r.choice([0.0, 0.08, 0.16, 0.2]) * np.linalg.norm(base) / 5
            rows.append((i, [float(np.float32(x)) for x in v * r.uniform(0.5, 3)], int(c % 3)))
            i += 1
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, rows[0][1], None), (904, rows[0][1], 0), (905, [1.0, None], 0), (906, [], 0), (907, [1e30, 1e30], 0), (908, [1.0, 1.0], 0), (None, rows[0][1], 0), (909, [float("inf"), 1.0], 0)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    for block in (e.BLOCK, 3):
        monkeypatch.setattr(e, "BLOCK", block)
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in e.near_duplicates(df).collect()), key=repr)
        assert got == brute(rows32)


def test_empty(spark):
    assert e.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_rotation_keeps_length():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(e.hadamard(x), axis=1), 8 * np.linalg.norm(x, axis=1))
    s = e.buckets(np.concatenate([x, x * 2]), 5, 2)
    assert (s[:5] == s[5:]).all() and s.shape == (10, 5 * 4)


def test_plan_keeps_recall_and_grows_with_the_table():
    assert e.plan(100, 64, 0.98)[1] < e.plan(10**5, 64, 0.98)[1] < e.plan(10**9, 64, 0.98)[1] <= e.MOST_ROTATIONS
    r = np.random.default_rng(1)
    for n, dim in ((100, 64), (10**6, 64), (10**5, 300), (1000, 5)):
        x = r.normal(size=(1000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = r.normal(size=x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * z
        a, b = e.buckets(x, *e.plan(n, dim, 0.98)), e.buckets(y, *e.plan(n, dim, 0.98))
        assert np.mean([bool(np.intersect1d(p, q).size) for p, q in zip(a, b, strict=True)]) >= 0.999


def test_chain_of_links(spark):
    # Neighbours are three degrees apart, so three steps link and four do not.
    t = np.radians(3.0) * np.arange(100)
    rows = [(k, [float(np.cos(x)), float(np.sin(x)), 1e-9 * k], 0) for k, x in enumerate(t)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in e.near_duplicates(df).collect()), key=repr)
    assert got == brute(rows) and {r[2] for r in got} == {0}


def test_crowded_buckets_and_clashing_columns(spark, monkeypatch):
    r = np.random.default_rng(8)
    base = r.normal(size=16)
    rows = [(k, [float(x) for x in base + r.normal(size=16) * 0.12 * (k % 3)], 1) for k in range(700)]
    df = spark.createDataFrame([(*x, 0, "b", True, 1.0) for x in rows], "vec_id long, embedding array<double>, label int, id long, bucket string, kept boolean, v double")
    monkeypatch.setattr(e, "BLOCK", 50)
    monkeypatch.setattr(e, "HOT_SAMPLE", 8)
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in e.near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)
