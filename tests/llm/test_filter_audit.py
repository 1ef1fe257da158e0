import random
import re
from itertools import permutations

import pytest

from barloom.llm.filter_audit import audit, failure_classes, lattice_edges

LABELS = "doc_id long, quality int, toxic int"


def failing(text, smaller):
    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    marks = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
    return marks + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (t in smaller)


def brute(docs, labels):
    """Every order applied to every document, one by one."""
    rows = [(p or "", failing(t, {u or "" for j, u, _ in docs if None not in (i, j) and j < i}), {k for j, q, x in labels if j is not None and j == i for k, v in (("q", q), ("x", x)) if v == 1}) for i, t, p in docs]
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                before = [r for r in mine if f in r[1] and r not in gone and any(x in r[1] for x in order[:k])]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(before), sum(r[1] == f for r in mine), sum("q" in r[2] for r in gone), sum("x" in r[2] for r in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def got(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_against_all_orders(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["aa", "Bb", "CCC", "d#", "e\xa0f", "ÉÀ", *[f"w{k}" for k in range(300)]][: r.choice([4, 6, 306])]) for _ in range(r.choice([0, 5, 99, 100, 130]))) for _ in range(40)]
    texts += [None, "", " \t\n", "\x0b".join("abc" * 120), "X" * 100_000]
    docs = [(k, r.choice(texts), r.choice(["en", "de", None, ""])) for k in range(150)]
    docs += [(7, texts[0], "en"), (7, texts[0], "en"), (3, None, "en"), (None, texts[0], "de"), (None, "lonely", None), docs[5]]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, n string, mask int")
    classes = failure_classes(frame, spark.createDataFrame(labels, LABELS))
    out = audit(classes)
    assert got(out) == brute(docs, labels)
    assert out.count() == 600 * len({d[2] or "" for d in docs})
    assert lattice_edges(classes, 5, ["good_lost"]).where("part = 'en'").count() == 80


def test_empty_tables_and_other_filters(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS)
    assert audit(failure_classes(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    rows = audit(failure_classes(one, labels)).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows) == 120
    classes = spark.createDataFrame([("p", 3, 10), ("p", 0, 5)], "part string, mask int, n long")
    two = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in audit(classes, "XY", ()).collect()}
    assert two == {("XY", 1): (5, 10, 0, 10), ("XY", 2): (5, 0, 10, 10), ("YX", 1): (5, 10, 0, 10), ("YX", 2): (5, 0, 10, 10)}
    with pytest.raises(ValueError):
        audit(classes, "ABCDEFGH")
